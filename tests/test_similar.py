"""Similar contents against all pairs."""

import random

from arbor.functions import chunking
from arbor.operators import storage


def expected(rows, least=2):
    sig = {i: set(chunking.signature(raw)) for i, raw in rows}
    best = {}
    for i in sig:
        shared = [(-len(sig[i] & sig[j]), j) for j in sig if j < i and len(sig[i] & sig[j]) >= least]
        if shared:
            best[i] = (-min(shared)[0], min(shared)[1])
    return best


def found(spark, rows, least=2):
    got = storage.similar(spark.createDataFrame(rows, "content_id string, bytes binary"), least).select("content_id", "shared", "candidate").collect()
    assert len({r["content_id"] for r in got}) == len(got)
    return {r["content_id"]: (r["shared"], r["candidate"]) for r in got}


def test_every_content_is_told_its_best_earlier_one(spark):
    rng = random.Random(3)
    pieces = [bytes(rng.randrange(97, 123) for _ in range(40)) for _ in range(30)]
    rows = [(f"{rng.randrange(10**6):06d}-{i}", b" ".join(rng.sample(pieces, rng.randrange(1, 6)))) for i in range(150)]
    # short ones, whose few hashes others hold as well, and other bytes with an equal signature
    rows += [("s1", pieces[0][:17]), ("s0", pieces[0][:16]), ("s2", pieces[0][:17] * 2), ("t", b"short"), ("u", b"")]
    rows += [(f"{c}same", b"a" * n + b"0123456789abcdef") for n, c in ((300, "m"), (301, "a"), (302, "z"), (303, "k"))]
    rows += rows[:3]
    assert found(spark, rows) == expected(rows) and len(found(spark, rows)) > 100
    assert found(spark, rows, 1) == expected(rows, 1)
    assert found(spark, []) == {}


def test_a_hash_that_all_hold_loses_no_link(spark):
    rng = random.Random(5)
    stamp = bytes(rng.randrange(256) for _ in range(60))
    rows = [(f"{i:05d}", stamp + bytes(rng.randrange(256) for _ in range(40))) for i in range(400)]
    assert found(spark, rows) == expected(rows) and len(expected(rows)) > 300
