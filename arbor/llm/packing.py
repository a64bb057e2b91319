"""Packing of token sequences into windows by best-fit decreasing."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.blocks import coded
from arbor.llm.common import chunks, table, tidied, utf8
from arbor.llm.token_counts import SPECIAL
from arbor.session import ship, written

WINDOW = 2048
#: Pieces that one task packs.
SHARD = 50_000
#: Pre-tokens whose ids a worker remembers, and those of one more chunk of texts; they take about 200 bytes each.
KNOWN_WORDS = 300_000
#: Pre-tokens that the library is given in one call.
AT_ONCE = 20_000


class WordIds:
    """Ids of pre-tokens, encoded once each while they are remembered. When
    they are too many, those asked for only once since the last time go."""

    def __init__(self, tokenizer, most: int = KNOWN_WORDS):
        self.tokenizer, self.most = tokenizer, most
        self._hold({}, np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _hold(self, place: dict[str, int], size: np.ndarray, flat: np.ndarray) -> None:
        self.place, self.size, self.flat = place, size, flat
        self.again = np.zeros(len(size), bool)

    def forget(self) -> None:
        stay = self.again if np.count_nonzero(self.again) <= self.most // 2 else np.zeros(len(self.again), bool)
        words = [w for w, s in zip(self.place, stay.tolist()) if s]  # places are in the order of the words
        self._hold({w: i for i, w in enumerate(words)}, self.size[stay], self.flat[np.repeat(stay, self.size)])

    def _learn(self, words: list[str]) -> None:
        at = len(self.place)
        self.place.update(zip(words, range(at, at + len(words))))
        sizes, ids = [self.size], [self.flat]
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(got.ids, np.uint32))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(ids)
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place and number of the ids of each word (words are distinct), and all ids."""
        if len(self.place) > self.most:
            self.forget()
        row = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        self.again[row[row >= 0]] = True
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = np.arange(len(self.place), len(self.place) + len(new))
            self._learn([words[i] for i in new.tolist()])
        ends = np.cumsum(self.size)
        return ends[row] - self.size[row], self.size[row], self.flat


@lru_cache(maxsize=1)
def _word_ids(path: str, stamp: tuple) -> WordIds:
    """Kept from task to task of a worker; stamp tells a changed file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return WordIds(t)


class OpenWindows:
    """Open windows by their remaining capacity: a segment tree over capacities,
    whose nodes tell how many windows lie below, finds the tightest that holds
    a piece."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give the window of least capacity >= need, with it."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i and (i & 1 or not count[i + 1]):
                i >>= 1
            if not i:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of equal length in their order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size) if size < window else None
        if found is None:
            capacity, w = window, n
            n += 1
        else:
            capacity, w = found
        where[i], offset[i] = w, window - capacity
        if capacity > size:
            tree.put(capacity - size, w)
    return where, offset


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, end_id: int, window: int, special: str, special_id: int) -> DataFrame:
    """Documents' ids, ended by end_id, cut into full windows and a rest."""

    def run(batches):
        told = os.stat(path)
        word_ids = _word_ids(path, (told.st_mtime_ns, told.st_size))
        for b in batches:
            _, offsets = utf8(b.column("text"))
            for i, j in chunks(offsets):
                ids = b.column("doc_id").slice(i, j - i).to_pylist()
                parts, owner = [], []
                for k, text in enumerate(b.column("text").slice(i, j - i).to_pylist()):
                    cut = text.split(special) if text and special in text else [text or ""]
                    parts += cut
                    owner += [k] * len(cut)
                code, words, spans = coded(parts)
                first, size, flat = word_ids.of(words)
                each = size[code] if len(code) else np.zeros(0, np.int64)
                ends = np.cumsum(each)
                all_ids = flat[np.repeat(first[code] - (ends - each), each) + np.arange(ends[-1])] if len(code) else flat
                edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(spans)]).astype(np.int64)]
                out = []
                k = 0
                while k < len(parts):
                    m = k + 1
                    while m < len(parts) and owner[m] == owner[k]:
                        m += 1
                    seq = [all_ids[edge[k] : edge[k + 1]]]
                    for x in range(k + 1, m):
                        seq += [np.array([special_id], np.uint32), all_ids[edge[x] : edge[x + 1]]]
                    seq = np.concatenate([*seq, np.array([end_id], np.uint32)]).astype("<u4")
                    for s in range(0, len(seq), window):
                        piece = seq[s : s + window]
                        out.append((ids[owner[k]], s, len(piece), zlib.crc32(piece.tobytes()), len(seq)))
                    k = m
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, special: str = SPECIAL, special_id: int = 50256, shard: int = SHARD) -> DataFrame:
    """Pieces of docs(doc_id, text) with sequence_id and offset. No window is
    shared by two shards: each packs about shard pieces, and its last windows
    alone are padded. A null or empty text is one piece, of end_id; repeated
    rows are packed each; a null doc_id stays null; other columns are ignored;
    an empty table gives no sequence."""
    cut = written(pieces(docs, path, end_id, window, special, special_id), "pieces")
    shards = max(1, -(-cut.count() // shard))

    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit_decreasing(group.column("length").to_numpy(), window)
        out = group.drop_columns(["shard"]).append_column("sequence_id", pa.array(where + (key[0].as_py() << 40)))
        return out.append_column("offset", pa.array(offset))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
