"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.common import chunks, fresh, give_back, same, table, tidied, utf8
from arbor.llm.langid import remainder
from arbor.llm.textnum import _BYTE, LOWER, U, exact_codes, span_hashes, word_spans
from arbor.session import ship

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5)
EPOCHS = 4
#: Documents seen in training at least, over more epochs if need be.
STEPS = 16_000
RATE = 0.5
#: A word counts so often in a text's average at most, so that one word repeated doesn't stand out by itself. Compared
#: on a quarter of the rows that may be learned from (crc32 mod 4 = 3), never on held-out ones.
MOST = 2
#: Words whose parts a task remembers.
KNOWN_WORDS = 200_000
#: Toxic documents that the model is fitted on, those of least hash, and three times as many others.
SAMPLE = 1000
OTHERS = 3

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes; start and end of each distinct word; row and number of
    each word."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets, _WORD)
    if not len(start):
        none = np.zeros(0, np.int64)
        return low, none, none, none, none
    first, code = exact_codes(low, _BYTE[low], start, end)
    return low, start[first], end[first], row, code


def weights(row: np.ndarray, code: np.ndarray, words: int, rows: int):
    """(row, word, weight) of the distinct words of each row; a row's weights sum to one."""
    pair, times = np.unique(row * max(1, words) + code, return_counts=True)
    row, code, times = pair // max(1, words), pair % max(1, words), np.minimum(times, MOST)
    return row, code, times / np.bincount(row, times, rows)[row]


def subwords(low: np.ndarray, s: np.ndarray, e: np.ndarray):
    """(bucket, word) of each subword of words: the word itself and the byte
    3- to 5-grams of <word>."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = e - s
    edge = np.concatenate([[0], np.cumsum(size + 2)])
    word = np.repeat(np.arange(len(s)), size + 2)
    inner = np.arange(edge[-1]) - edge[word]
    marked = low[np.clip(s[word] + inner - 1, 0, len(low) - 1)]
    marked[edge[:-1]] = 60
    marked[edge[1:] - 1] = 62
    values = _BYTE[marked]
    at, of = [edge[:-1]], [np.arange(len(s))]
    ends = [edge[1:]]
    for n in GRAMS:
        p = np.flatnonzero(inner + n <= (size + 2)[word])
        at.append(p)
        ends.append(p + n)
        of.append(word[p])
    bucket = (span_hashes(values, np.concatenate(at), np.concatenate(ends)) % U(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate(of)


class Model:
    """The score of a text needs of embeddings and softmax no more than each
    subword's part in the difference of the two logits."""

    def __init__(self, part: np.ndarray, bias: float, share: float = 0.5):
        self.part, self.bias, self.share = part, bias, share

    def score(self, data: np.ndarray, offsets: np.ndarray, known: dict | None = None) -> np.ndarray:
        """known: parts of words, kept from one call to the next."""
        known = {} if known is None else known
        n = len(offsets) - 1
        low, s, e, row, code = words_of(data, offsets)
        z = np.zeros(n)
        wordless = np.bincount(row, minlength=n) == 0
        if len(s):
            raw = low.tobytes()
            keys = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            each = np.fromiter((known.get(k, np.nan) for k in keys), np.float64, len(keys))
            new = np.flatnonzero(np.isnan(each))
            if len(new):
                bucket, of = subwords(low, s[new], e[new])
                each[new] = np.bincount(of, self.part[bucket], len(new)) / np.bincount(of, minlength=len(new))
                if len(known) + len(new) > KNOWN_WORDS:
                    known.clear()
                known.update(zip((keys[i] for i in new.tolist()), each[new].tolist()))
            row, code, weight = weights(row, code, len(s), n)
            z = np.bincount(row, each[code] * weight, n)
        return np.where(wordless, self.share, 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))))


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Adagrad over documents: embeddings and softmax weights together."""
    rng = np.random.default_rng(7)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-2, np.float32)
    bags = []
    for t in texts:
        low, s, f, row, code = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        words = len(s)
        bucket, of = subwords(low, s, f)
        if words:
            _, _, weight = weights(row, code, words, 1)
            weight = weight / np.bincount(of, minlength=words)
            at, back = np.unique(bucket, return_inverse=True)
            bags.append((at.astype(np.int32), np.bincount(back, weight[of]).astype(np.float32)))
        else:
            bags.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
    # a scarce class takes more turns: one in OTHERS + 1 at least
    bad, rest = np.flatnonzero(toxic == 1), np.flatnonzero(toxic != 1)
    turn = np.concatenate([rest, np.resize(bad, max(len(bad), len(rest) // OTHERS))]) if len(bad) else rest
    epochs = max(EPOCHS, -(-STEPS // max(1, len(turn))))
    for epoch in range(epochs):
        for i in rng.permutation(turn):
            at, weight = bags[i]
            v = weight @ e[at]
            z = v @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(toxic[i])] -= 1
            back = w @ p
            g = weight * weight * float(back @ back) / DIM
            ge[at] += g
            step = RATE * (1 - epoch / epochs)
            e[at] -= (step * weight / np.sqrt(ge[at]))[:, None] * back[None, :]
            gw += np.outer(v, p) ** 2
            w -= step * np.outer(v, p) / np.sqrt(gw)
            gb += p * p
            b -= step * 0.2 * p / np.sqrt(gb)
    seen = np.bincount(np.concatenate([at for at, _ in bags]), minlength=BUCKETS) if bags else np.zeros(BUCKETS)
    # what was never seen has learned nothing and is as good as zero
    return Model((e @ (w[:, 1] - w[:, 0]) * (seen > 0)).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample toxic documents and OTHERS times as many others,
    none of them held out, those whose doc_id has the least hash. A document with several
    labels counts as toxic if one says so."""
    seen = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(4) != 2))
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    share = seen.agg(F.avg("toxic")).first()[0]
    if share is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    chosen = seen.where("toxic = 1").orderBy(*order).limit(sample).unionAll(seen.where("toxic = 0").orderBy(*order).limit(OTHERS * sample))
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "toxic").toArrow()
    got = got.sort_by("doc_id")
    if not got.num_rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    model = train(got.column("text").to_pylist(), got.column("toxic").to_numpy())
    model.share = float(share)
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """A score, from 0 to 1, beside the columns keep of docs(text, ...). A null or
    empty text, or one without words, scores the share of toxic documents among the labelled ones; repeated rows
    give a row each; an empty table gives none. Without labels all score 0.5."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = docs.select(*keep)

    def run(batches):
        known: dict[bytes, float] = {}
        for b in batches:
            data, offsets = utf8(b.column(0))
            held = b.columns[1:]
            for i, j in chunks(offsets, 1 << 19):
                value = shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known)
                yield pa.RecordBatch.from_arrays([*(same(c, i, j) for c in held), pa.array(value, pa.float64())], names=[*keep, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"`{name}` double"])
    return docs.select(F.col("text").alias(*fresh(docs, "_text")), *keep).mapInArrow(tidied(run), schema)


#: A score from here on is toxic.
THRESHOLD = 0.3


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
