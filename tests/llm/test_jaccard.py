"""The Jaccard join against every pair, on small texts."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from arbor.llm import ngram_jaccard
from arbor.llm.ngram_jaccard import components, jaccard_classes
from arbor.session import shared_dir
from tests.llm.conftest import empty, frame


def brute(rows, k, num, den):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    groups = list(range(len(sets)))
    find = lambda x: x if groups[x] == x else find(groups[x])
    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                groups[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((str(i), len(s), str(least[find(x)] if i is not None else None)) for x, (i, s) in enumerate(sets))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_odd_texts(spark, cases, k, num):
    assert got(jaccard_classes(frame(spark, cases), k, num, 100)) == brute(cases, k, num, 100)


def test_groups_of_near_copies_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    rows, chain = [], list(base)
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 50)}"
        rows.append((1000 - i, " ".join(w)))
    for i in range(30):  # each near the one before, not near the first
        chain = list(chain)
        chain[2 * i] = f"c{i}"
        rows.append((i, " ".join(chain)))
    common = " ".join(f"shared{i}" for i in range(40))
    rows += [(2000 + i, common + " " + " ".join(f"d{rng.randint(0, 9999)}" for _ in range(60))) for i in range(100)]
    for k, num in ((3, 90), (5, 80), (2, 70)):
        assert got(jaccard_classes(frame(spark, rows), k, num, 100)) == brute(rows, k, num, 100)


def test_empty_table(spark):
    assert jaccard_classes(empty(spark)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100)], "x long, y long")
    found = {r["node"]: r["component_id"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_large_steps_go_before_candidates_meet(spark, monkeypatch):
    """The heads and the blocks of both rounds are used up by then; what stays is small, but the sets that can have a partner."""
    rng = random.Random(5)
    rows = []
    for i in range(200):
        w = [f"w{rng.randint(0, 4000)}" for _ in range(120)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:60], "other", *w[61:]]))]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before, seen, verified = set(folder.iterdir()), [], ngram_jaccard._verified
    there = lambda: sorted(p.name.split("-")[1] for p in folder.iterdir() if p not in before)

    def watched(*args):
        seen.append(there())
        return verified(*args)

    monkeypatch.setattr(ngram_jaccard, "_verified", watched)
    classes = jaccard_classes(frame(spark, rows), 3, 90, 100)
    assert seen == [["alive", "ordered", "reps", "rows"], ["alive", "ordered", "prefixes", "reps", "rows", "star"]]
    assert there() == ["edges", "reps", "rows"]
    assert got(classes) == brute(rows, 3, 90, 100)


def test_tokens_move_by_their_gaps():
    tokens = np.unique(np.random.default_rng(7).integers(0, 2**64, 1 << 19, np.uint64))
    for t in (tokens, tokens[:1], tokens[:0], np.array([0, 1, 2**32 - 1, 2**32, 2**64 - 1], np.uint64)):
        assert np.array_equal(ngram_jaccard._unpressed(ngram_jaccard._pressed(t)), t)
    assert len(ngram_jaccard._pressed(tokens)) < 6.2 * len(tokens)
