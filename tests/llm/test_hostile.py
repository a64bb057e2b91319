"""Words made to share a hash, code points that libraries class on their own,
repeated ids, very long texts, and each operator first in its session."""

import hashlib
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from arbor.llm import bpe_codec, langid, licenses, media, packing, textnum, token_counts, toxicity
from arbor.llm.ngram_jaccard import jaccard_classes
from tests.llm.conftest import frame
from tests.llm.test_jaccard import brute, got

JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def thue_morse(bits: int, a: str, b: str) -> str:
    out = a
    for _ in range(bits):
        out += out.translate(str.maketrans(a + b, b + a))
    return out


ONE, TWO = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")  # equal under any polynomial modulo 2^64


@pytest.fixture(scope="module")
def hostile():
    pad = " ".join(f"w{i}" for i in range(30))
    return [(1, ONE), (2, TWO), (3, f"{ONE} {pad}"), (4, f"{TWO} {pad}"), (5, f"{pad} {TWO} {ONE}"), (6, f"{ONE}\t{ONE} {TWO}"), (7, TWO)]


def test_words_of_one_hash_are_told_apart():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    start, end = np.array([0, len(ONE)]), np.array([len(ONE), 2 * len(ONE)])
    h = textnum.span_hashes(textnum._BYTE[data], start, end)
    assert h[0] == h[1]
    assert textnum.exact_codes(data, textnum._BYTE[data], start, end)[1].tolist() == [0, 1]


def test_hostile_words(spark, hostile):
    docs = frame(spark, hostile).coalesce(1)
    library = Tokenizer.from_file(JSON)
    ids = {i: library.encode(t).ids for i, t in hostile}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, JSON).collect()} == {i: len(x) for i, x in ids.items()}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})
    for r in bpe_codec.round_trip(docs, RANKS, P.PATTERN).collect():
        text = dict(hostile)[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, tik.encode_ordinary(text))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    for r in packing.pack(docs, JSON).collect():
        own = np.array([*ids[r["doc_id"]], 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert got(jaccard_classes(docs, 3, 90, 100)) == brute(hostile, 3, 90, 100)
    model = toxicity.train([ONE.encode()] * 40 + [TWO.encode()] * 40, np.array([1] * 40 + [0] * 40))
    raw = (ONE + TWO).encode()
    together = model.score(np.frombuffer(raw, np.uint8), np.array([0, len(ONE), len(raw)]))
    apart = [model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in (ONE, TWO)]
    assert np.allclose(together, apart)


def test_every_code_point_is_split_as_the_libraries_do():
    """All code points in six surroundings, many to a text."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    forms = ("a{}b", "1{}2", " {} ", "!{}?", "{}'s", "'{}")
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True)
    for form in forms:
        lines = [form.format(chr(c)) for c in points]
        for s in range(0, len(lines), 1 << 17):
            part = "\n".join(lines[s : s + (1 << 17)])
            own, _ = textnum.pre_tokens(*textnum.code_points([part]))
            assert own.tolist() == [x[0] for _, x in split.pre_tokenize_str(part)], form


def test_rows_that_share_a_doc_id_have_the_component_of_their_text(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (3, a + " x"), (7, b + " y"), (5, a), (9, "alone here now")]
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_classes(frame(spark, rows), 3, 90, 100).collect()) == sorted(str(x) for x in [(5, 58, 3), (5, 58, 3), (5, 58, 5), (3, 59, 3), (7, 59, 5), (9, 1, 9)])


def test_one_very_long_text(spark):
    """Two megabytes in one row, beside short ones."""
    long = " ".join(f"word{i % 5000} license mit license copyright (c) 2020" for i in range(40_000))
    rows = [(1, long), (2, "short text"), (3, long)]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[1]["n_base"] == 40_000 and found[2]["n_base"] == 0 and found[1]["labels"] == found[3]["labels"]
    assert {r["doc_id"]: r["payload_bytes"] for r in media.media_columns(docs).collect()}[1] == -(-len(long) // 576) * 576
    model = toxicity.train([b"bad words here", b"good words there"] * 20, np.array([1, 0] * 20))
    assert len(toxicity.score(docs, model, "doc_id").collect()) == 3
    assert [r["component_id"] for r in jaccard_classes(docs, 3, 90, 100).orderBy("doc_id").collect()] == [1, 2, 1]
    assert sum(r["length"] for r in packing.pack(docs, JSON).where("doc_id = 1").collect()) == len(Tokenizer.from_file(JSON).encode(long).ids) + 1


def test_a_wordless_text_is_not_toxic(spark):
    docs = frame(spark, [(i, "nasty words" if i % 8 == 0 else f"plain words {i}") for i in range(1000)] + [(2000, None), (2001, ""), (2002, " ?! ")])
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(1000)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels), "doc_id").collect()}
    assert all(scored[i] < toxicity.THRESHOLD for i in (2000, 2001, 2002)) and scored[0] > 0.5 > scored[1]


@pytest.mark.parametrize("name", ["op10_language_id", "op7_toxicity", "op4_bpe_codec", "op1_ngram_jaccard"])
def test_first_in_a_session_outside_the_repository(name, tmp_path):
    """Workers find the package though they can't see the repository's folder."""
    import arbor

    root = arbor.__path__[0].rpartition("/")[0]
    code = f"import sys; sys.path.insert(0, {root!r}); from arbor.session import local_session; s = local_session(2, '2g', 2); import __spark_entry__ as e; print('rows', e.queries()[{name!r}](s, '/root/testdata/sf0.001').count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
