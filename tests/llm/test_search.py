"""Additive quantisation against every distance."""

import numpy as np
from pyspark.sql import functions as F

from arbor.llm.additive_ann import beam_encode, fit, nearest


def test_recall_ties_and_rows_without_part(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[50:90] = x[7]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2101, [float("inf"), *[0.0] * 15]), (2102, [None, *[1.0] * 15]), (None, [1.0] * 16), (2150, [1.0, 2.0]), (2151, [1.0, 3.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = nearest(df, F.col("vec_id") % 50 == 0, sample=600).toPandas()
    d = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2))
    hits = 0
    for q in range(0, 1200, 50):
        own = got[got.query_id == q].sort_values("rank")
        near = [i for i in np.lexsort((np.arange(1200), d[q])) if i != q][:10]
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[q][own.vec_id])
        assert own[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        hits += len({*near} & {*own.vec_id})
    assert hits >= 0.9 * 240
    assert got[got.query_id == 50].vec_id.tolist()[:9] == [7, *range(51, 59)]
    assert got[got.query_id == 2150].vec_id.tolist() == [2151] and set(got.query_id) == {*range(0, 1200, 50), 2150}
    assert nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(6).normal(size=(800, 8)).astype(np.float32)
    books = fit(x, 3, 16)
    error = lambda beam: ((x - sum(b[c] for b, c in zip(books, beam_encode(x, books, beam).T))) ** 2).sum()
    assert error(8) <= error(1) < (x**2).sum()
