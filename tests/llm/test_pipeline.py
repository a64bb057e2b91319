"""The stages in order, on the smallest tables."""

import corpus_pipeline
from arbor.llm.common import table

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, D, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        before = docs
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0 and 0 < docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_columns_of_any_name_stay(spark):
    """A table that has the names that stages use themselves."""
    docs = table(spark, D, "documents").selectExpr("*", "'a' AS score", "'b' AS rejected", "'c' AS _row", "'d' AS _text", "'e' AS lang_pred")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and {tuple(r) for r in out.select("score", "rejected", "_row", "_text", "lang_pred").distinct().collect()} == {tuple("abcde")}
        assert stage(spark, docs.where("false"), D).count() == 0


def test_near_duplicates_are_judged_by_row(spark):
    """Null, repeated and shared ids: one row of each class stays, and every row that no link connects."""
    words = lambda tag, n=40: [f"{tag}{i}" for i in range(n)]
    a, b, c, d = (" ".join(words(t)) for t in "abcd")
    near = " ".join(["x", *words("a")[1:]])  # 35 of 37 shingles are a's
    rows = [
        (5, a, "1"), (5, b, "2"), (3, b, "3"),  # (5, b) goes although 5 stays for a
        (7, near, "4"), (None, a, "5"),  # linked with (5, a)
        (None, c, "6"), (None, c, "7"),  # a class of rows without ids
        (None, d, "8"), (9, " ".join(words("e")), "9"), (9, " ".join(words("f")), "10"),  # alone
        (6, " ".join(words("g")), "11"), (6, " ".join(words("g")), "12"),  # repeated whole
        (None, None, "13"), (None, "", "14"), (1, " \n", "15"), (1, " \n", "16"),  # without words
        *((20, " ".join(words("h")), f"h{i}") for i in range(30)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.deduplicate(spark, docs, D)
    assert got.columns == docs.columns
    kept = [r["source"] for r in got.collect()]
    assert sorted(kept) == sorted(set(kept)) and {"1", "3", "8", "9", "10", "13", "14", "15", "16"} <= set(kept)
    assert [len({*g} & {*kept}) for g in (["6", "7"], ["11", "12"], [f"h{i}" for i in range(30)])] == [1, 1, 1]
    assert len(kept) == 12 and corpus_pipeline.deduplicate(spark, docs.where("false"), D).collect() == []
