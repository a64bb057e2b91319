"""Documents as blocks of coded pre-tokens, and a dictionary that is coded once.

A block holds some documents and its distinct pre-tokens; the pre-tokens are
dealt by hash into buckets, so that a pre-token, wherever it stands, is encoded
once, in its bucket. Within a block frequent pre-tokens have small codes, and
each code's bucket is kept: what comes back from a bucket is in the order of
codes. A frequent pre-token gives a row a block at most, so none makes a bucket
hot. Blocks are a bucketed table: what comes back goes to them, they don't move."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm import textnum
from arbor.llm.common import chunks, tidied, utf8
from arbor.session import scratch, ship

BLOCK_BYTES = 4 << 20
PART_BYTES = 1 << 19

BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, specials array<int>, sizes array<int>, codes binary, buckets binary, counts binary, words array<struct<bucket:int,packed:binary>>"
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("buckets", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())])))])


def press(a: np.ndarray) -> bytes:
    """An array of uint32 as its length and its bytes by significance, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = int(planes.any(1).sum() and np.flatnonzero(planes.any(1))[-1] + 1)
    return struct.pack("<IB", len(a), used) + zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())


def spread(b: bytes) -> tuple[np.ndarray, bytes]:
    """The array, and the bytes after it."""
    n, used = struct.unpack_from("<IB", b)
    d = zstandard.ZstdDecompressor().decompressobj()
    planes = np.zeros((4, n), np.uint8)
    planes[:used] = np.frombuffer(d.decompress(b[5:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel(), d.unused_data


def pack_words(words: list[str]) -> bytes:
    return press(np.fromiter(map(len, words), np.uint32, len(words))) + zstandard.ZstdCompressor(level=3).compress("".join(words).encode("utf-8", "surrogatepass"))


def unpack_words(b: bytes) -> list[str]:
    n, rest = spread(b)
    text = zstandard.ZstdDecompressor().decompress(rest).decode("utf-8", "surrogatepass")
    ends = np.cumsum(n, dtype=np.int64).tolist()
    return [text[s:e] for s, e in zip([0, *ends], ends)]


def coded(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts' pre-tokens: each span's code, the distinct ones, and the number
    of spans of each text."""
    cp, offsets = textnum.code_points(texts)
    start, row = textnum.pre_tokens(cp, offsets)
    first, code = textnum.distinct_spans(cp, start)
    whole = "".join(texts)
    end = np.append(start[1:], len(cp))
    words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
    return code, words, np.bincount(row, minlength=len(texts))


def make_blocks(docs: DataFrame, buckets: int, ordered: bool, special: str | None = None) -> DataFrame:
    """Blocks of docs(doc_id, text): codes in the order of the text if ordered,
    else each document's distinct codes and their counts. Occurrences of
    special are no text: they part it and are counted in specials."""

    def of(ids, texts, sizes_bytes, number):
        known: dict[str, int] = {}
        codes, sizes, pieces, owner = [], [], [], []
        specials = np.zeros(len(texts), np.int32)
        for i, t in enumerate(texts):
            cut = t.split(special) if special and special in t else [t]
            specials[i] = len(cut) - 1
            pieces += cut
            owner += [i] * len(cut)
        lens = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        for i, j in chunks(lens, PART_BYTES):
            c, w, n = coded(pieces[i:j])
            codes.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w))[c])
            sizes.append(n)
        words = list(known)
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[every]
        bucket = np.fromiter((zlib.crc32(words[x].encode("utf-8", "surrogatepass")) for x in order.tolist()), np.int64, len(order)) % buckets
        n = np.bincount(np.array(owner, np.int64), weights=np.concatenate(sizes) if sizes else None, minlength=len(texts)).astype(np.int64) if pieces else np.zeros(len(texts), np.int64)
        counts = b""
        if not ordered:
            doc = np.repeat(np.arange(len(texts)), n)
            pair, times = np.unique(doc * max(1, len(order)) + code, return_counts=True)
            n = np.bincount(pair // max(1, len(order)), minlength=len(texts))
            code, counts = pair % max(1, len(order)), press(times)
        dealt = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1)).tolist()
        firsts = order[dealt].tolist()
        packs = [{"bucket": b, "packed": pack_words([words[x] for x in firsts[cuts[b] : cuts[b + 1]]])} for b in range(buckets) if cuts[b] < cuts[b + 1]]
        values = (number, ids, sizes_bytes, specials, n.astype(np.int32), press(code), press(bucket), counts, packs)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCKS)], schema=_BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, nb, held = [], [], [], 0
        for b in batches:
            _, offsets = utf8(b.column("text"))
            size = np.diff(offsets)
            for i, j in chunks(offsets, PART_BYTES):
                ids += b.column("doc_id").slice(i, j - i).to_pylist()
                texts += [t or "" for t in b.column("text").slice(i, j - i).to_pylist()]
                nb += size[i:j].tolist()
                held += int(offsets[j] - offsets[i])
                if held >= BLOCK_BYTES:
                    yield of(ids, texts, nb, number)
                    number += 1
                    ids, texts, nb, held = [], [], [], 0
        if ids:
            yield of(ids, texts, nb, number)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), BLOCKS)


def bucket_count(docs: DataFrame) -> int:
    """Buckets grow with the cluster's own number of shuffle partitions."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(blocks: DataFrame, tag: str, buckets: int) -> DataFrame:
    """Blocks as a table below the shared folder that is bucketed by block, so
    that a join on block doesn't shuffle them."""
    spark = blocks.sparkSession
    name = f"arbor_{tag}_{uuid.uuid4().hex}"
    writer = blocks.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, tag))
    sc = spark.sparkContext
    sc._arbor_tables = [*getattr(sc, "_arbor_tables", ()), name]
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def through_dictionary(docs: DataFrame, tag: str, ordered: bool, special: str | None, encode, gather, schema: str, schema_arrow: pa.Schema) -> DataFrame:
    """encode: list of distinct pre-tokens -> list of their values (numpy arrays
    of uint32), asked once for each pre-token of a bucket. gather: block as a
    dict, values' sizes and values by code -> columns of the result."""
    buckets = bucket_count(docs)
    blocks = bucketed(make_blocks(docs, buckets, ordered, special), tag, buckets)
    known_most = 1_000_000

    def coder(batches):
        known: dict[str, np.ndarray] = {}
        for b in batches:
            out = []
            for packed in b.column("packed").to_pylist():
                words = unpack_words(packed)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > known_most:
                    known.clear()
                    new = words
                known.update(zip(new, encode(new)))
                values = [known[w] for w in words]
                out.append(press(np.fromiter(map(len, values), np.uint32, len(values))) + press(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "coded"])

    def back(key, left, right):
        block = {c: left.column(c)[0].as_py() for c in ("doc_ids", "n_bytes", "specials", "sizes")}
        block["codes"], block["counts"] = spread(left.column("codes")[0].as_py())[0], left.column("counts")[0].as_py()
        dealt = np.argsort(spread(left.column("buckets")[0].as_py())[0], kind="stable")
        sizes, values = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for _, b in sorted(zip(right.column("bucket").to_pylist(), right.column("coded").to_pylist())):
            n, rest = spread(b)
            sizes.append(n)
            values.append(spread(rest)[0])
        sizes, values = np.concatenate(sizes), np.concatenate(values)
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        first = (np.cumsum(sizes, dtype=np.int64) - sizes)[place]
        sizes = sizes[place]
        ends = np.cumsum(sizes, dtype=np.int64)
        values = values[np.repeat(first - ends + sizes, sizes) + np.arange(len(values))]
        columns = gather(block, sizes, values)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema_arrow)], schema=schema_arrow)

    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.packed")
    coded_words = words.repartition(buckets, "bucket").mapInArrow(tidied(coder), "block long, bucket int, coded binary")
    return blocks.drop("words").groupBy("block").cogroup(coded_words.groupBy("block")).applyInArrow(back, schema)
