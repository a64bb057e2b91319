"""Token counts: each distinct pre-token's pieces are counted once, and joined
to the documents' pre-token frequencies."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.blocks import spread, through_dictionary
from arbor.llm.common import table

SPECIAL = "<|endoftext|>"


def pieces_of(path: str):
    """Counter of the pieces of pre-tokens; the tokenizer is loaded in the task."""
    held = {}

    def count(words: list[str]) -> list[np.ndarray]:
        if "t" not in held:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            held["t"] = Tokenizer.from_file(path)
            held["t"].encode_special_tokens = True
        out = []
        for i in range(0, len(words), 20_000):
            out += [np.array([len(e)], np.uint32) for e in held["t"].encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]
        return out

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, special: str = SPECIAL) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs(doc_id, text).

    A null text is empty, with 0 bytes and tokens; special, the vocabulary's
    special string, is one token wherever it stands, as the library has it;
    repeated rows and null ids give a row each; other columns are ignored; an
    empty table gives none."""

    def gather(block, sizes, values):
        n = np.array(block["sizes"], np.int64)
        row = np.repeat(np.arange(len(n)), n)
        times = spread(block["counts"])[0].astype(np.int64)
        total = np.bincount(row, values.astype(np.int64)[block["codes"]] * times, len(n)).astype(np.int64)
        total += np.array(block["specials"], np.int64)
        return block["doc_ids"], block["n_bytes"], total, total > limit

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return through_dictionary(docs, "counts", False, special, pieces_of(path), gather, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
