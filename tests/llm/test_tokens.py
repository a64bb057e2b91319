"""Counts, ids and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from arbor.llm import bpe_codec, packing, token_counts
from tests.llm.conftest import empty, frame

JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(spark, cases, library):
    got = sorted(map(str, token_counts.token_counts(frame(spark, cases), JSON, limit=100).collect()))
    want = []
    for i, t in cases:
        n = len(library[0].encode(t or "", add_special_tokens=False).ids)
        want.append(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={n}, over_limit={n > 100})")
    assert got == sorted(want)


def test_ids_and_round_trip(spark, cases, library):
    docs = frame(spark, cases)
    encoded = bpe_codec.encode(docs, RANKS, P.PATTERN)
    assert sorted(str((r["doc_id"], r["ids"])) for r in encoded.collect()) == sorted(str((i, library[1].encode_ordinary(t or ""))) for i, t in cases)
    assert sorted(str((r["doc_id"], bytes(r["bytes"]))) for r in bpe_codec.decode(encoded, RANKS).collect()) == sorted(str((i, (t or "").encode())) for i, t in cases)
    ids = [",".join(map(str, library[1].encode_ordinary(t or ""))) for _, t in cases]
    want = sorted(str((i, hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for (i, t), s in zip(cases, ids))
    assert sorted(str((r["doc_id"], r["ids_sha256"], r["decoded_sha256"])) for r in bpe_codec.round_trip(docs, RANKS, P.PATTERN).collect()) == want


def test_all_texts_empty(spark):
    docs = frame(spark, [(1, ""), (2, None)])
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(docs, JSON).collect()) == [0, 0]
    assert sorted(r["n_tokens"] for r in bpe_codec.round_trip(docs, RANKS, P.PATTERN).collect()) == [0, 0]


def test_empty_tables(spark):
    assert token_counts.token_counts(empty(spark), JSON).collect() == []
    assert bpe_codec.round_trip(empty(spark), RANKS, P.PATTERN).collect() == []
    assert packing.pack(empty(spark), JSON).collect() == []


@pytest.mark.parametrize("shard", [7, 50_000])
def test_packing_keeps_every_id_once(spark, cases, library, shard):
    rows = [(i, t) for i, t in cases if i is not None and (i, t) != cases[12]] + [(12, cases[12][1])]
    got = packing.pack(frame(spark, rows), JSON, shard=shard).toPandas()
    for i, t in {i: t for i, t in rows}.items():
        ids = np.array([*library[0].encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for r in own.drop_duplicates("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    where, offset = packing.best_fit_decreasing(lengths, 100)
    room: list[int] = []  # plain best fit, window by window
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            room[room.index(min(fits))] -= size
        else:
            room.append(100 - size)
    assert where.max() + 1 == len(room) and sorted(100 - np.bincount(where, lengths)) == sorted(room)


def test_remembered_words_are_forgotten_in_parts():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng, held = random.Random(3), packing.WordIds(t, 50)
    often = [" the", "é", " \n", "'s", "<|endoftext|>"]
    for _ in range(40):
        words = list(dict.fromkeys(often + ["".join(rng.choice("abcé 你\t") for _ in range(rng.randrange(1, 9))) for _ in range(30)]))
        rng.shuffle(words)
        first, size, flat = held.of(words)
        assert [flat[f : f + n].tolist() for f, n in zip(first, size)] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
        assert len(held.place) <= 50 + len(words) and set(often) <= held.place.keys()
    assert all(len(x) == 0 for x in packing.WordIds(t).of([]))
