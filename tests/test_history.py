"""Runs and frontiers of random histories against plain sets of ancestors."""

import random

import pytest
from pyspark.sql import functions as F

from arbor.operators import history as H
from arbor.operators import storage, trace


def _dag(seed, n):
    """id, first and second parent; few parents for long runs, many for knots."""
    r = random.Random(seed)
    back = r.choice([2, 5, n])
    rows = []
    for k in range(n):
        near = list(range(max(0, k - back), k))
        first = r.choice(near) if near and r.random() < 0.9 else None
        second = r.choice(near) if near and first is not None and r.random() < 0.4 else None
        rows.append((f"{r.randrange(10**6):06d}-{k}", first, second))
    name = [x[0] for x in rows]
    return [(i, None if p is None else name[p], None if q is None else name[q]) for i, p, q in rows]


def _ancestors(rows):
    held = {}
    for i, p, q in rows:
        held[i] = {i} | held.get(p, set()) | held.get(q, set())
    return held


@pytest.mark.parametrize("seed", range(4))
def test_frontier_tells_what_the_sets_of_ancestors_tell(spark, seed):
    rows = _dag(seed, 40)
    held, r = _ancestors(rows), random.Random(seed)
    ids = [x[0] for x in rows]
    depth = {}
    for i, p, _ in rows:
        depth[i] = 0 if p is None else depth[p] + 1
    commits = spark.createDataFrame(rows, "id string, parent string, second string")
    edges = commits.selectExpr("id as child", "parent").unionAll(commits.selectExpr("id", "second")).where("parent is not null")
    chain = H.lineage(commits).cache()
    assert {x.id: x.depth for x in chain.collect()} == depth
    cross = H.crossings(chain, edges)
    found = H.frontier(commits, chain, cross)
    told = found.toDF("node", "run", "low").join(chain, "run").where("depth <= low")
    assert sorted((x.node, x.id) for x in told.collect()) == sorted((n, a) for n in held for a in held[n])

    pairs = [(a, b) for a in r.sample(ids, 15) for b in r.sample(ids, 15)]
    asked = spark.createDataFrame(pairs, "l string, r string")
    assert {(x.l, x.r) for x in H.holds(asked, found, chain).collect()} == {(a, b) for a, b in pairs if b in held[a]}
    height = {i: k % 3 for k, i in enumerate(ids)}
    rank = spark.createDataFrame([(i, height[i], depth[i]) for i in ids], "id string, height int, depth int")
    want = {}
    for a, b in pairs:
        common = held[a] & held[b]
        best = [c for c in common if not any(c in held[o] and o != c for o in common)]
        if best:
            want[a, b] = min(best, key=lambda c: (-height[c], -depth[c], c))
    assert {(x.l, x.r): x.base for x in H.merge_bases(asked, found, chain, cross, rank).collect()} == want

    picked = r.sample(ids, 6)
    layers = spark.createDataFrame([(c, k + 1) for k, c in enumerate(picked)], "source_commit string, height int")
    first = {}
    for k, c in enumerate(picked):
        for a in held[c]:
            first.setdefault(a, k + 1)
    sources = H.frontier(layers.select(F.col("source_commit").alias("id")), chain, cross)
    assert {x.id: x.height for x in H.absorbed(sources, chain, layers).collect()} == first
    heads = spark.createDataFrame([(f"b{i}", i) for i in ids], "branch string, id string")
    covered = {f"b{i}": max([k + 1 for k, c in enumerate(picked) if c in held[i]], default=0) for i in ids}
    assert {x.branch: (x.covered, x.overwrote) for x in H.covered(heads, found, chain, layers).collect()} == {b: (c, 6 - c) for b, c in covered.items()}


@pytest.mark.parametrize("least", [False, True])
@pytest.mark.parametrize("step", [1, 3, 100])
def test_running_values_carry_over_ranges(spark, step, least):
    r = random.Random(step)
    left = [(k, r.randrange(3), r.randrange(20)) for k in range(40)]
    right = [(r.randrange(3), r.randrange(20), r.randrange(9)) for _ in range(12)]
    got = H.running(spark.createDataFrame(left, "k int, run int, depth int"), spark.createDataFrame(right, "run int, depth int, height int"), "depth", "height", step, least)
    want = {}
    for k, run, at in left:
        here = [h for q, d, h in right if q == run and (d >= at if least else d <= at)]
        want[k] = (min if least else max)(here, default=None)
    assert {x.k: x.height for x in got.collect()} == want


def test_no_commits_have_no_history(spark):
    commits = spark.createDataFrame([], "id string, parent string")
    edges = spark.createDataFrame([], "child string, parent string")
    chain = H.lineage(commits)
    assert H.frontier(commits, chain, H.crossings(chain, edges)).isEmpty()


def test_ranges_meet_only_their_steps(spark):
    runs = spark.createDataFrame([(1, "[[3, 9], [10, 10], [8, 2]]"), (2, "[[0, 30]]"), (3, None), (4, "[]")], "id int, json string")
    values = spark.createDataFrame([(i, o, o * i) for i in (1, 2, 3) for o in range(0, 40, 2)], "id int, ordinal long, value long")
    want = sorted([(1, o) for o in (4, 6, 8, 10)] + [(2, o) for o in range(0, 31, 2)])
    for step in (1, 4, 1024):
        assert sorted((x.id, x.ordinal) for x in trace.run_values(runs, values, step).collect()) == want
    pieces = spark.createDataFrame([("a", 0, 5, "x"), ("a", 5, 0, "none"), ("a", 5, 20, "y"), ("b", 0, 3, "z")], "f string, offset long, length long, c string")
    asked = spark.createDataFrame([("a", 4), ("a", 5), ("a", 24), ("a", 25), ("b", 2), ("c", 0)], "f string, at long")
    for step in (1, 7, 1 << 20):
        assert sorted((x.f, x.at, x.c) for x in storage.covering(pieces, asked, "f", step).collect()) == [("a", 4, "x"), ("a", 5, "y"), ("a", 24, "y"), ("b", 2, "z")]
