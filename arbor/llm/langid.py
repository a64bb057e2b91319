"""Language identification by the nearest of several centroids of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.llm.common import chunks, few, fresh, give_back, same, table, tidied, utf8
from arbor.llm.textnum import LOWER, U, mix
from arbor.session import ship

BUCKETS = 4096
CENTROIDS = 4
#: Labelled documents of each language that the centroids are fitted on, those of least hash.
SAMPLE = 800
#: Letters (bytes of them) of the starts of the learned documents, by which the limits of short texts are set.
STARTS = tuple(4 << i for i in range(8))
#: Shares of the learned documents' cosines that still pass: of whole documents' 1 % quantile and of starts' 5 % quantile.
#: A start may be digits or markup throughout, which says nothing of its language, hence the other quantile.
SLACK, START_SLACK = 0.75, 0.6

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of each row's byte 1- to 3-grams, hashed; other bytes than
    letters count as a space."""
    n = len(offsets) - 1
    x = _FOLD[LOWER[data]].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    total = np.zeros(n * BUCKETS, np.int64)
    for size in (1, 2, 3):
        if len(x) < size:
            break
        code = x[: len(x) - size + 1].copy()
        for k in range(1, size):
            code = code * 256 + x[k : len(x) - size + 1 + k]
        inside = row[: len(code)] == row[size - 1 :]
        bucket = _BUCKET[size][code[inside]] if size < 3 else (mix(code[inside].astype(U) + U(3 << 32)) % U(BUCKETS)).astype(np.int64)
        total += np.bincount(row[: len(code)][inside] * BUCKETS + bucket, minlength=n * BUCKETS)
    return np.log1p(total.reshape(n, BUCKETS)).astype(np.float32)


_BUCKET = {s: (mix(np.arange(256**s, dtype=U) + U(s << 32)) % U(BUCKETS)).astype(np.int64) for s in (1, 2)}


def letter_count(data: np.ndarray) -> np.ndarray:
    """How many bytes of letters stand before each place of data."""
    return np.concatenate([[0], np.cumsum(_FOLD[LOWER[data]] != 32)])


def starts(data: np.ndarray, offsets: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of more than so many bytes of letters, cut after these, and their numbers."""
    count = letter_count(data)
    rows = np.flatnonzero(count[offsets[1:]] - count[offsets[:-1]] > letters)
    ends = np.searchsorted(count, count[offsets[rows]] + letters)
    parts = []
    for s, e in zip(offsets[rows].tolist(), ends.tolist()):
        while 128 <= data[e] < 192:  # within a character
            e += 1
        parts.append(data[s:e])
    return np.concatenate([data[:0], *parts]), np.cumsum([0, *map(len, parts)]), rows


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def weighted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """unit(x * by), made in place of x: whole samples stand in the driver's memory once."""
    for i in range(0, len(x), 256):
        x[i : i + 256] = unit(x[i : i + 256] * by)
    return x


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first centroids."""
    centre = unit(x.mean(0, keepdims=True))
    chosen = [int((x @ centre[0]).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = unit(np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))]))
    return c


def dense(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
    tf = np.zeros((len(rows), BUCKETS), np.float32)
    for r, (at, value) in zip(tf, rows):
        r[np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float16)
    return tf


class Model:
    """Centroids, their languages, the idf weights, and for each language the
    least cosine that is not rejected, by the text's letters.

    tf is used up. cut has the starts of the learned documents: letters, language, and places and values of the profile."""

    def __init__(self, tf: np.ndarray, lang: list[str], k: int = CENTROIDS, cut: list[tuple[int, str, bytes, bytes]] = ()):
        names = sorted(set(lang))
        df = (tf > 0).sum(0)
        self.idf = np.log((1 + len(tf)) / (1 + df)).astype(np.float32) + 1
        x, y = weighted(tf, self.idf), np.array(lang)
        parts = [cluster(x[y == n], k) for n in names]
        self.names = names
        self.centroids = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, BUCKETS), np.float32)
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.least = np.array([SLACK * np.quantile((x[y == n] @ p.T).max(1), 0.01) for n, p in zip(names, parts)])
        # short texts share few n-grams with any centroid: their limits are those of the documents' starts
        found: dict[tuple[str, int], list[tuple[bytes, bytes]]] = {}
        for letters, name, *row in cut:
            found.setdefault((name, letters), []).append(tuple(row))
        self.short = []
        for n, p in zip(names, parts):
            at = [s for s in STARTS if (n, s) in found]
            self.short.append((np.log(at), [START_SLACK * np.quantile((weighted(dense(found[n, s]), self.idf) @ p.T).max(1), 0.05) for s in at]))

    def limit(self, lang: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The least cosine that is not rejected, for rows of these languages and bytes of letters."""
        out = np.ones(len(lang))
        for i, (at, least) in enumerate(self.short):
            k = lang == i
            out[k] = np.minimum(self.least[i], np.interp(np.log(np.maximum(letters[k], 1)), at, least) if len(at) else np.inf)
        return out

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's language number and cosine."""
        if not len(self.centroids):
            return np.full(len(tf), -1), np.zeros(len(tf))
        cos = unit(tf * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        return self.owner[best], np.clip(cos[np.arange(len(tf)), best].astype(np.float64), 0, 1)


def remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents of each language, none of them
    held out, about those whose doc_id has the least hash."""
    ship(docs.sparkSession)
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(3) != 1))
    # a language's rows are many: those of least hash, some times more than are wanted, meet in one task
    times = known.groupBy("lang").agg(F.count("*").alias("n"))
    least = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < F.lit(4.0 * sample) / F.col("n")
    some = known.select("doc_id", "lang").join(few(times), "lang").where(least)
    chosen = some.select("doc_id", "lang").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= sample).select("doc_id").distinct()
    rows = known.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi")

    def out(letters, lang, tf):
        sparse = [np.flatnonzero(r) for r in tf]
        return pa.RecordBatch.from_arrays([pa.array([letters] * len(tf), pa.int32()), lang, pa.array([s.astype(np.int16).tobytes() for s in sparse]), pa.array([r[s].astype(np.float16).tobytes() for r, s in zip(tf, sparse)])], names=["letters", "lang", "at", "value"])

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                tf = profiles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield out(0, same(b.column("lang"), i, j), tf)
                for letters in STARTS:
                    *cut, at = starts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters)
                    if len(at):
                        yield out(letters, same(b.column("lang"), i, j).take(pa.array(at)), profiles(*cut))

    got = rows.select("text", "lang").mapInArrow(tidied(run), "letters int, lang string, at binary, value binary").toArrow()
    got = list(zip(*(got.column(c).to_pylist() for c in ("letters", "lang", "at", "value"))))
    whole = [r for r in got if not r[0]]
    model = Model(dense([r[2:] for r in whole]), [r[1] for r in whole], cut=[r for r in got if r[0]])
    del got, whole
    give_back()
    return model


def identify(docs: DataFrame, model: Model, *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """lang_pred, score (cosine to the nearest centroid) and rejected beside the
    columns keep of docs(text, ...). A text that is null or has no letter is
    `und`, scores 0 and is rejected, as is one too far from all centroids of its
    language: farther than almost all learned documents, or their starts of as many letters. Without any labelled document everything is `und`. Repeated rows
    give a row each; an empty table gives none. names are those of the new columns."""
    told = names
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = docs.select(*keep)

    def run(batches):
        m = shared.value
        for b in batches:
            data, offsets = utf8(b.column(0))
            held = b.columns[1:]
            for i, j in chunks(offsets, 1 << 19):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                low = LOWER[part]
                count = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                letters = count[off[1:]] > count[off[:-1]]
                for k in np.flatnonzero(~letters & (np.diff(off) > 0)):
                    letters[k] = any(c.isalpha() for c in part[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
                size = letter_count(part)[off]
                size = size[1:] - size[:-1]
                names, scores, rejected = [], [], []
                for s in range(0, j - i, 256):
                    e = min(s + 256, j - i)
                    lang, score = m.predict(profiles(part[off[s] : off[e]], off[s : e + 1] - off[s]))
                    ok = letters[s:e] & (lang >= 0)
                    names += [m.names[x] if y else "und" for x, y in zip(lang.tolist(), ok.tolist())]
                    scores += np.where(ok, score, 0.0).tolist()
                    rejected += (~ok | (score < m.limit(lang, size[s:e]))).tolist()
                yield pa.RecordBatch.from_arrays([*(same(c, i, j) for c in held), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, *told])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"`{n}` {k}" for n, k in zip(told, ("string", "double", "boolean"))])
    return docs.select(F.col("text").alias(*fresh(docs, "_text")), *keep).mapInArrow(tidied(run), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs), "doc_id")
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
