"""Nearest neighbours by additive quantisation: a vector is coded as a sum of
full-dimensional codewords, found by beam search over the residuals; lookup
tables and stored norms score the codes, and the best are ranked exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.llm.common import table, tidied
from arbor.session import ship, written

BOOKS = 16
WORDS = 256
BEAM = 4
#: Vectors that the codebooks are fitted on, those whose vec_id has the least hash.
SAMPLE = 8192
#: Rows of a block of candidates and of a block of queries, about.
CANDIDATES = 8192
QUERIES = 2048
#: Candidates of each block that are ranked exactly for a query: one in so many, and so many times k at least.
SHARE, TIMES = 16, 4


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        count = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(x.dtype)
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The code, a codeword of each book, whose sum is nearest to each row among
    those that a beam of that width finds."""
    out = np.zeros((len(x), len(books)), np.uint8 if books.shape[1] <= 256 else np.uint16)
    for s in range(0, len(x), 1024):
        part = x[s : s + 1024]
        n = len(part)
        rest, codes, error = part[:, None, :], np.zeros((n, 1, 0), out.dtype), (part * part).sum(1)[:, None]
        for book in books:
            # error of each beam with each codeword: |r|^2 - 2 r.c + |c|^2
            e = error[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
            e = e.reshape(n, -1)
            width = min(beam, e.shape[1])
            best = np.argpartition(e, width - 1, 1)[:, :width]
            from_, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            rest = rest[row, from_] - book[word]
            codes = np.concatenate([codes[row, from_], word[:, :, None].astype(out.dtype)], 2)
            error = e[row, best]
        out[s : s + 1024] = codes[np.arange(n), error.argmin(1)]
    return out


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1) -> np.ndarray:
    """Codebooks: k-means on residuals, then, in rounds, codes by beam search
    and all codewords together by least squares."""
    rng = np.random.default_rng(7)
    x = x.astype(np.float32)
    c = np.zeros((books, words, x.shape[1]), np.float32)
    rest = x
    for m in range(books):
        c[m] = _means(rest, words, rng)
        at = ((c[m] * c[m]).sum(1) - 2 * rest @ c[m].T).argmin(1)
        rest = rest - c[m][at]
    size = books * words
    for _ in range(rounds):
        code = beam_encode(x, c).astype(np.int64) + np.arange(books) * words
        gram = np.zeros((size, size))
        for a in range(books):
            for b in range(books):
                pair = np.bincount((code[:, a] - a * words) * words + code[:, b] - b * words, minlength=words * words)
                gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = pair.reshape(words, words)
        right = np.zeros((size, x.shape[1]))
        for m in range(books):
            for d in range(x.shape[1]):
                right[m * words : (m + 1) * words, d] = np.bincount(code[:, m] - m * words, x[:, d], words)
        # a little weight on the codewords that are there already
        weight = 0.1
        c = np.linalg.solve(gram + weight * np.eye(size), right + weight * c.reshape(size, -1)).reshape(c.shape).astype(np.float32)
    return c


def search_block(q_id, q, c_id, c, code, norm, books, k: int, share: int = SHARE):
    """The k nearest of a block of candidates to each query: (query, candidate,
    distance). Equal vectors of the block are ranked together, all of them."""
    order = np.argsort(c_id, kind="stable")
    c_id, c, code, norm = c_id[order], c[order], code[order], norm[order]
    q, c = q.astype(np.float64), c.astype(np.float64) + 0.0  # no negative zero
    _, first, of = np.unique(np.ascontiguousarray(c).view(f"V{c.itemsize * c.shape[1]}").ravel(), return_index=True, return_inverse=True)
    members = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of))
    one, code, norm = c[first].astype(np.float64), code[first].astype(np.int64), norm[first]
    out_q, out_c, out_d = [], [], []
    for s in range(0, len(q), 128):
        part = q[s : s + 128]
        score = np.broadcast_to(norm, (len(part), len(norm))).astype(np.float32)
        for m, book in enumerate(books):
            score -= 2 * (part.astype(np.float32) @ book.T)[:, code[:, m]]
        width = min(max(TIMES * k, len(norm) // share), len(norm))
        best = np.argpartition(score, width - 1, 1)[:, :width] if width < len(norm) else np.broadcast_to(np.arange(len(norm)), score.shape)
        exact = np.sqrt(((one[best] - part.astype(np.float64)[:, None, :]) ** 2).sum(2))
        near = np.argsort(exact, 1, kind="stable")
        for i in range(len(part)):
            own, found = q_id[s + i], []
            for x in near[i]:
                d = exact[i, x]
                if len(found) >= k and d > found[k - 1][0]:
                    break
                u = best[i, x]
                ids = c_id[members[ends[u - 1] if u else 0 : ends[u]][: k + 1]]
                found = sorted(found + [(d, y) for y in ids.tolist() if y != own])[:k]
            out_q += [own] * len(found)
            out_c += [y for _, y in found]
            out_d += [d for d, _ in found]
    return np.array(out_q, np.int64), np.array(out_c, np.int64), np.array(out_d, np.float64)


def nearest(vectors: DataFrame, queries, k: int = 10, sample: int = SAMPLE, share: int = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest
    rows of vectors(vec_id, embedding) to those of its rows that the condition
    queries picks, by distance, ties by vec_id; a row is not its own neighbour.

    A vector that is null, all zero or holds a null or a non-finite component
    takes no part, nor a null vec_id; vectors of different lengths are no
    neighbours. Rows that repeat a vec_id count each as candidates, and once as
    a query. Fewer than k candidates are all returned; an empty table gives none."""
    spark = vectors.sparkSession
    ship(spark)
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # floats are kept as they are, anything else as doubles, so that distances are those of the vectors given
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("dim", F.size("embedding"))
    out = None
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).collect()  # a row a length
    for dim, n, q in sorted(counts):
        found = _nearest(rows.where(F.col("dim") == dim).drop("dim"), queries, dim, n, q, k, sample, share)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _nearest(rows: DataFrame, queries, dim: int, n: int, q: int, k: int, sample: int, share: int) -> DataFrame:
    spark = rows.sparkSession
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("embedding").combine_chunks()
    books = spark.sparkContext.broadcast(fit(fitted.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))  # 1 MB at 64 dimensions
    parts, sides = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))

    def index(batches):
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            code = beam_encode(x, books.value)
            sums = sum(book[code[:, m]] for m, book in enumerate(books.value))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([r.tobytes() for r in code]), pa.array((sums * sums).sum(1).astype(np.float32))], names=["vec_id", "embedding", "code", "norm"])

    indexed = written(rows.select("vec_id", "embedding").mapInArrow(tidied(index), f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, code binary, norm float"), "aq")
    # block pairs: each candidate meets each block of queries once, and the other way round
    part, side = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sides)).cast("int")
    right = indexed.withColumn("part", part).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    left = indexed.where(queries).select("vec_id", "embedding").withColumn("side", side).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def search(key, l, r):  # noqa: E741
        if not l.num_rows or not r.num_rows:
            return schema.empty_table()
        l = l.sort_by("vec_id")  # noqa: E741
        ids = l.column("vec_id").to_numpy()
        once = np.concatenate([[True], ids[1:] != ids[:-1]])
        code = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint8).reshape(-1, BOOKS)
        found = search_block(ids[once], matrix(l)[once], r.column("vec_id").to_numpy(), matrix(r), code, r.column("norm").to_numpy(), books.value, k, share)
        return pa.table(list(found), schema=schema)

    best = left.groupBy("part", "side").cogroup(right.groupBy("part", "side")).applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
