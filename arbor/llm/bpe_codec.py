"""Byte-level BPE: distinct words meet in a global shuffle, are encoded once,
and their ids go back to be put in the words' places; decoding looks ids up in
the vocabulary's table of token bytes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from arbor.llm.blocks import through_dictionary
from arbor.llm.common import table, tidied
from arbor.session import ship


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(path: str, pattern: str):
    held = {}

    def encode(words: list[str]) -> list[np.ndarray]:
        if "e" not in held:
            import tiktoken

            held["e"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        e = held["e"].encode_ordinary
        return [np.array(e(w), np.uint32) for w in words]

    return encode


class TokenBytes:
    """The vocabulary's table of token bytes, by id: all bytes one after
    another, and where each token's begin. Ids are joined to it by place."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.ends = np.cumsum([0, *map(len, by_id)])
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's begin (and the last's end)."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.ends) - 1 or ids.min() < 0):
            raise ValueError("an id outside the vocabulary")
        first, n = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        if not n.all():
            raise ValueError("an id outside the vocabulary")
        at = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(first - at[:-1], n) + np.arange(at[-1])], at


def _code(docs: DataFrame, path: str, pattern: str, digests: bool) -> DataFrame:
    held = {}

    def gather(block, sizes, values):
        ends = np.cumsum(sizes, dtype=np.int64)
        n = np.cumsum([0, *block["sizes"]], dtype=np.int64)
        codes = block["codes"].astype(np.int64)
        # the ids of all documents of the block, in the order of their texts
        each = sizes[codes].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(each)])
        ids = values[np.repeat((ends - sizes)[codes] - at[:-1], each) + np.arange(at[-1])]
        edge = at[n].tolist()
        if not digests:
            return block["doc_ids"], [ids[s:e].astype(np.int32) for s, e in zip(edge, edge[1:])]
        if not held:
            held["table"] = TokenBytes(path)
        words = values.tolist()
        texts = [b",".join([b"%d" % x for x in words[e - m : e]]) for e, m in zip(ends.tolist(), sizes.tolist())]
        id_sum, byte_sum = [], []
        for s, e, x, y in zip(edge, edge[1:], n.tolist(), n.tolist()[1:]):
            id_sum.append(hashlib.sha256(b",".join(map(texts.__getitem__, codes[x:y].tolist()))).hexdigest())
            byte_sum.append(hashlib.sha256(held["table"].decode(ids[s:e])[0]).hexdigest())
        return block["doc_ids"], np.diff(edge), id_sum, byte_sum

    if digests:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema, ddl = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>"
    return through_dictionary(docs, "bpe", True, None, encoder(path, pattern), gather, ddl, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row of docs(doc_id, text). A null or empty text
    has no ids; repeated rows and null doc_ids give a row each; other columns
    are ignored; an empty table gives none."""
    return _code(docs, path, pattern, False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of encode()'s rows; null ids give null bytes; an id
    outside the vocabulary raises."""
    ship(encoded.sparkSession)

    def run(batches):
        known = TokenBytes(path)
        for b in batches:
            ids = b.column("ids")
            flat, at = known.decode(ids.flatten().to_numpy(zero_copy_only=False))
            edge = at[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])].tolist()
            out = [flat[s:e].tobytes() if ok else None for s, e, ok in zip(edge, edge[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens and digests of encode()'s ids and of the bytes that these ids
    decode to. A null or empty text has none; repeated rows and null doc_ids
    give a row each; other columns are ignored; an empty table gives none."""
    return _code(docs, path, pattern, True)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
