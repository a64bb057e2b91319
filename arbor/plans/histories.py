"""Queries over the commit graph, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import history as H
from arbor.session import written
from arbor.sources.adapter import oracle, view


def _commit(s, d):
    return view(s, d, "commit")


def _heads(s, d):
    c = _commit(s, d)
    return c.join(view(s, d, "branch").select("branch", F.col("last").alias("depth")), ["branch", "depth"]).select("branch", "conv_id", "id", "logical")


def _reach(s, d):
    return H.closure(_commit(s, d), view(s, d, "edge"))


def _index(s, d, ids):
    """The frontier of ids(id), and the runs and crossings that it is made of."""
    commits = written(_commit(s, d).select("id", "parent", "second_parent"), "commits")
    edges = commits.select(F.col("id").alias("child"), "parent").unionAll(commits.select("id", "second_parent")).where("parent is not null")
    chain = H.lineage(commits)
    cross = H.crossings(chain, edges)
    return H.frontier(ids, chain, cross), chain, cross


def _sources(s, d):
    return view(s, d, "layer").select(F.col("source_commit").alias("id"))


_REACH = "RECURSIVE WITH reach AS (SELECT id AS node, id AS ancestor FROM commit UNION SELECT r.node, e.parent FROM reach r JOIN edge e ON e.child = r.ancestor), heads AS (SELECT c.* FROM commit c JOIN branch b ON b.branch = c.branch AND b.last = c.depth) "
#: base layer of a commit: the newest published from an earlier conversation
_HEIGHT = "(SELECT coalesce(max(height), 0) FROM layer l WHERE l.conv_id < c.conv_id)"


def _ranked(s, d):
    c = _commit(s, d).select("id", "depth", "conv_id")
    layers = view(s, d, "layer").select((F.col("conv_id") + 1).alias("conv_id"), "height")
    return H.as_of_all(c, layers, "conv_id", "height", RANGE).select("id", F.coalesce("height", F.lit(0)).alias("height"), "depth")


def _pairs(s, d):
    h = _heads(s, d)
    return h.select("conv_id", F.col("id").alias("l")).join(h.select((F.col("conv_id") + 1).alias("conv_id"), F.col("id").alias("r")), "conv_id").select("l", "r")


def merge_base_pairs(s, d):
    return H.merge_bases(_pairs(s, d), *_index(s, d, _heads(s, d)), _ranked(s, d))


def is_ancestor_pairs(s, d):
    p = _pairs(s, d)
    found, chain, _ = _index(s, d, p.select(F.col("l").alias("id")))
    return p.join(H.holds(p, found, chain).withColumn("yes", F.lit(True)), ["l", "r"], "left").select("l", "r", F.coalesce("yes", F.lit(False)).alias("is_ancestor"))


def overwritten_layers(s, d):
    layers = view(s, d, "layer")
    top = layers.agg(F.max_by("id", "height")).first()[0]
    return H.overwritten(layers, top, 3)


def containment(s, d):
    chain = H.lineage(_commit(s, d))
    c = _commit(s, d).select("id", "conv_id")
    low = chain.where("depth = 1").select("run", F.col("id").alias("low"), F.col("depth").alias("d"))
    return chain.join(low, "run").select("low", F.col("id").alias("high"), (F.col("depth") >= F.col("d")).alias("contains")).join(c.select(F.col("id").alias("high")), "high")


def branch_snapshot(s, d):
    b = view(s, d, "branch").select("branch", "conv_id")
    layers = view(s, d, "layer")
    base = H.as_of_all(b, layers.select((F.col("conv_id") + 1).alias("conv_id"), "id"), "conv_id", "id", RANGE).select("branch", F.col("id").alias("base"))
    heads = _heads(s, d).where("conv_id % 4 <> 1").select("branch", F.col("id").alias("head"))
    return base.join(heads, "branch", "left").select("branch", "head", "base", F.coalesce("head", "base").alias("effective"))


def _chat(s, d):
    return view(s, d, "chat")


def list_revisions(s, d):
    return H.revisions(_chat(s, d), "conv_id", "n")


def publish_layer(s, d):
    found, chain, _ = _index(s, d, _sources(s, d))
    return H.publish(_heads(s, d).select("branch", "id"), found, chain, view(s, d, "layer"))


def absorbed_height(s, d):
    found, chain, _ = _index(s, d, _sources(s, d))
    return H.absorbed(found, chain, view(s, d, "layer"))


def covered_layers(s, d):
    found, chain, _ = _index(s, d, _heads(s, d))
    return H.covered(_heads(s, d), found, chain, view(s, d, "layer"))


def commit_branch(s, d):
    heads = _heads(s, d).select("branch", "conv_id", "id", F.col("logical").alias("root"))
    tries = heads.select("branch", F.when(F.col("conv_id") % 3 == 0, F.lit("old")).otherwise(F.col("id")).alias("seen"), F.when(F.col("conv_id") % 5 == 0, F.col("root")).otherwise(F.lit(-1)).alias("root"))
    return H.commit_checks(tries, heads)


def fork_branch(s, d):
    b = view(s, d, "branch").select("branch", "conv_id", "commits")
    return H.fork(b, "feat", "c1").unionByName(H.fork(b, "main", "c1")).unionByName(H.fork(b, "c2", "c1")).unionByName(H.fork(b, "f.2", "absent")).unionByName(H.fork(b, "No", "c1")).unionByName(H.fork(b, "z", "c3"))


def reserve_inodes(s, d):
    demands = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 10).alias("scope"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("long").alias("count"))
    return H.reserve(demands.groupBy("scope", "seq").agg(F.sum("count").alias("count")), 1000)


def get_comparable(s, d):
    commits = _commit(s, d).select("id", (F.col("logical") % 50).alias("root"), "conv_id").where("conv_id % 3 <> 0").select("id", "root")
    layers = view(s, d, "layer").select("id", (F.col("logical") % 50).alias("root"), F.when(F.col("height") % 4 != 0, F.col("source_commit")).alias("source_commit"))
    return H.comparable(layers, commits)


def resolve_names(s, d):
    heads, layers = _heads(s, d).select("branch", "id"), view(s, d, "layer")
    names = heads.select(F.col("branch").alias("name")).unionAll(_commit(s, d).where("depth = 1").select("id")).unionAll(layers.select("id")).unionAll(s.createDataFrame([("main",), ("absent",)], "name string"))
    return H.resolve(names, heads, _commit(s, d), layers)


def record_bindings(s, d):
    from arbor.operators.diff import bindings

    base, ours = bindings(view(s, d, "tree_base")), bindings(view(s, d, "tree_ours"))
    return H.record_bindings(base, ours.unionAll(ours))


def first_absorbing(s, d):
    """The first layer of each conversation or a later one."""
    b, layers = view(s, d, "branch").select("branch", "conv_id"), view(s, d, "layer").select("conv_id", "height")
    return H.as_of_all(b, layers, "conv_id", "height", RANGE, forward=True).select("branch", "height")


def merge_outcomes(s, d):
    from arbor.operators import merge

    h = _heads(s, d)
    two = h.select("conv_id", F.col("branch").alias("a"), F.col("id").alias("l")).join(h.select((F.col("conv_id") + 1).alias("conv_id"), F.col("branch").alias("b"), F.col("id").alias("r")), "conv_id")
    # a head against itself under another name, an older commit of the same branch, and a branch with itself
    older = _commit(s, d).where("depth = 0").select("branch", F.col("id").alias("r"))
    behind = h.select("branch", F.col("branch").alias("a"), F.col("id").alias("l")).join(older, "branch").select("a", F.concat("branch", F.lit("-old")).alias("b"), "l", "r")
    pairs = two.select("a", "b", "l", "r").unionAll(behind).unionAll(h.select(F.col("branch").alias("a"), F.col("branch").alias("b"), F.col("id").alias("l"), F.col("id").alias("r")))
    found, chain, cross = _index(s, d, pairs.select(F.col("l").alias("id")).unionAll(pairs.select("r")))
    both = pairs.select("l", "r").unionAll(pairs.select("r", "l"))
    return merge.merge_outcomes(pairs, H.holds(both, found, chain), H.merge_bases(pairs.where("a <> b"), found, chain, cross, _ranked(s, d)))


def publish_rows(s, d):
    layers = view(s, d, "layer").withColumn("root", F.col("logical") % 5)
    top = layers.agg(F.max_by("id", "height")).first()[0]  # what each caller has seen
    heads = _heads(s, d).select("branch", "id", (F.col("logical") % 5).alias("root"), F.when(F.col("conv_id") % 4 == 0, F.lit("old")).otherwise(F.lit(top)).alias("seen"))
    found, chain, _ = _index(s, d, _sources(s, d))
    return H.publish_rows(heads, found, chain, layers)


def commit_rows(s, d):
    heads = _heads(s, d).select("branch", "conv_id", "id", F.col("logical").alias("root"))
    tries = heads.select("branch", F.when(F.col("conv_id") % 3 == 0, F.lit("old")).otherwise(F.col("id")).alias("seen"), F.when(F.col("conv_id") % 5 == 0, F.col("root")).otherwise(F.lit(-1)).alias("root"), (F.col("conv_id") % 2 == 0).alias("force"))
    return H.commit_rows(tries, heads).drop("id")


#: Conversations of a range of as-of joins.
RANGE = 1000
_LINE = "SELECT t.conv_id, t.n, t.id, string_split(t.text, chr(10)) AS l, b.last FROM turns t JOIN branch b USING (conv_id)"
QUERIES = {
    "resolve_heads": (lambda s, d: _heads(s, d).select("branch", F.col("id").alias("node")), oracle("SELECT c.branch, c.id AS node FROM commit c JOIN branch b ON b.branch = c.branch AND b.last = c.depth")),
    "list_branches": (lambda s, d: H.branch_list(view(s, d, "branch")), oracle("SELECT branch FROM branch UNION ALL SELECT 'main' ORDER BY 1")),
    "list_commits": (lambda s, d: H.first_parents(_heads(s, d), _commit(s, d)), oracle("SELECT branch, id, depth FROM commit")),
    "list_layers": (lambda s, d: view(s, d, "layer").select("id", "parent", "height", "source_commit").orderBy(F.desc("height")), oracle("SELECT id, parent, height, source_commit FROM layer")),
    "ancestors": (_reach, oracle(_REACH + "SELECT node, ancestor FROM reach")),
    "is_ancestor_pairs": (is_ancestor_pairs, oracle(_REACH + "SELECT l.id AS l, r.id AS r, EXISTS (SELECT 1 FROM reach x WHERE x.node = l.id AND x.ancestor = r.id) AS is_ancestor FROM heads l JOIN heads r ON r.conv_id = l.conv_id - 1")),
    "merge_base_pairs": (merge_base_pairs, oracle(_REACH + f""", common AS (SELECT l.id AS l, r.id AS r, a.ancestor AS id FROM heads l JOIN heads r ON r.conv_id = l.conv_id - 1 JOIN reach a ON a.node = l.id JOIN reach z ON z.node = r.id AND z.ancestor = a.ancestor),
        most AS (SELECT * FROM common k WHERE NOT EXISTS (SELECT 1 FROM common o JOIN reach x ON x.node = o.id AND x.ancestor = k.id WHERE o.l = k.l AND o.r = k.r AND o.id <> k.id))
        SELECT l, r, base FROM (SELECT m.l, m.r, m.id AS base, row_number() OVER (PARTITION BY m.l, m.r ORDER BY {_HEIGHT} DESC, c.depth DESC, c.id) AS n FROM most m JOIN commit c ON c.id = m.id) q WHERE n = 1""")),
    "lineage_depth_run": (lambda s, d: H.lineage(_commit(s, d)), oracle("SELECT c.id, f.id AS run, c.depth FROM commit c JOIN commit f ON f.branch = c.branch AND f.depth = 0")),
    "absorbed_height": (absorbed_height, oracle(_REACH + "SELECT r.ancestor AS id, min(l.height) AS height FROM layer l JOIN reach r ON r.node = l.source_commit GROUP BY r.ancestor")),
    "covered_layers": (covered_layers, oracle(_REACH + ", k AS (SELECT h.branch, coalesce(max(l.height), 0) AS covered FROM heads h LEFT JOIN (reach r JOIN layer l ON l.source_commit = r.ancestor) ON r.node = h.id GROUP BY h.branch) SELECT branch, covered, (SELECT max(height) FROM layer) - covered AS overwrote FROM k")),
    "overwritten_layers": (overwritten_layers, oracle("SELECT id, height, conv_id FROM layer WHERE height < (SELECT max(height) FROM layer) AND height >= (SELECT max(height) FROM layer) - 3")),
    "first_parent_containment": (containment, oracle("SELECT l.id AS low, h.id AS high, h.depth >= 1 AS contains FROM commit l JOIN commit h USING (conv_id) WHERE l.depth = 1")),
    "base_layer_as_of": (_ranked, oracle(f"SELECT c.id, {_HEIGHT} AS height, c.depth FROM commit c")),
    "branch_snapshot": (branch_snapshot, oracle("SELECT h.branch, CASE WHEN h.conv_id % 4 <> 1 THEN h.id END AS head, l.id AS base, CASE WHEN h.conv_id % 4 <> 1 THEN h.id ELSE l.id END AS effective FROM (SELECT c.* FROM commit c JOIN branch b ON b.branch = c.branch AND b.last = c.depth) h LEFT JOIN layer l ON l.height = (SELECT max(height) FROM layer m WHERE m.conv_id < h.conv_id)")),
    "history_model": (lambda s, d: H.history_model(_commit(s, d), 3).drop("version"), oracle("SELECT branch, least(count(*), 3) AS commits, max(depth) AS newest FROM commit GROUP BY branch")),
    "list_revisions": (list_revisions, oracle("SELECT conv_id, n, id, CASE WHEN n = 0 THEN 'Added' ELSE 'Modified' END AS change, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS object FROM chat")),
    "file_stats": (lambda s, d: H.file_stats(list_revisions(s, d), "conv_id"), oracle("SELECT conv_id, max(CAST(strlen(text) AS BIGINT)) AS size, count(*) AS revisions, false AS more, sum(CAST(strlen(text) AS BIGINT)) AS logical FROM chat GROUP BY conv_id")),
    "blame_append_only": (lambda s, d: H.blame(_chat(s, d), "conv_id", "n").groupBy("conv_id", "id").agg(F.count("*").alias("lines")), oracle(f"SELECT x.conv_id, x.id, count(*) AS lines FROM (SELECT p.conv_id, CASE WHEN k < len(p.l) OR p.n = p.last THEN p.id ELSE q.id END AS id FROM ({_LINE}) p LEFT JOIN turns q ON q.conv_id = p.conv_id AND q.n = p.n + 1, unnest(range(1, len(p.l) + 1)) AS u(k)) x GROUP BY ALL")),
    "get_comparable": (get_comparable, oracle("SELECT l.id AS layer, coalesce(m.same, CASE WHEN l.height % 4 <> 0 THEN l.source_commit END) AS commit, CASE WHEN m.same IS NOT NULL OR l.height % 4 <> 0 THEN m.same IS NOT NULL END AS exact FROM layer l LEFT JOIN (SELECT logical % 50 AS root, min(id) AS same FROM commit WHERE conv_id % 3 <> 0 GROUP BY 1) m ON m.root = l.logical % 50")),
    "resolve_names": (resolve_names, oracle("SELECT branch AS name, id AS node, 'branch' AS kind FROM (SELECT c.* FROM commit c JOIN branch b ON b.branch = c.branch AND b.last = c.depth) h UNION ALL SELECT id, id, 'commit' FROM commit WHERE depth = 1 UNION ALL SELECT id, id, 'layer' FROM layer UNION ALL SELECT 'main', (SELECT id FROM layer ORDER BY height DESC LIMIT 1), 'layer' UNION ALL SELECT 'absent', NULL, NULL")),
    "record_bindings": (record_bindings, oracle("SELECT parent_path, name, serial AS child FROM tree_ours WHERE path NOT IN (SELECT path FROM tree_base)")),
    "publish_layer": (publish_layer, oracle(_REACH + ", a AS (SELECT r.ancestor AS id, min(l.height) AS layer FROM layer l JOIN reach r ON r.node = l.source_commit GROUP BY r.ancestor) SELECT h.branch, CASE WHEN a.layer IS NULL THEN 'Added' ELSE 'UpToDate' END AS result, a.layer FROM heads h LEFT JOIN a USING (id)")),
    "commit_branch": (commit_branch, oracle("SELECT branch, CASE WHEN conv_id % 5 = 0 THEN 'UpToDate' WHEN conv_id % 3 = 0 THEN 'Moved' ELSE 'Committed' END AS result FROM branch")),
    "first_absorbing_layer": (first_absorbing, oracle("SELECT branch, (SELECT min(height) FROM layer l WHERE l.conv_id >= b.conv_id) AS height FROM branch b")),
    "layer_heights": (lambda s, d: H.chain_heights(view(s, d, "layer").select("id", "parent")), oracle("SELECT id, height FROM layer")),
    "merge_outcomes": (merge_outcomes, oracle(_REACH + f""", common AS (SELECT l.id AS l, r.id AS r, a.ancestor AS id FROM heads l JOIN heads r ON r.conv_id = l.conv_id - 1 JOIN reach a ON a.node = l.id JOIN reach z ON z.node = r.id AND z.ancestor = a.ancestor),
        most AS (SELECT * FROM common k WHERE NOT EXISTS (SELECT 1 FROM common o JOIN reach x ON x.node = o.id AND x.ancestor = k.id WHERE o.l = k.l AND o.r = k.r AND o.id <> k.id)),
        bases AS (SELECT l, r, base FROM (SELECT m.l, m.r, m.id AS base, row_number() OVER (PARTITION BY m.l, m.r ORDER BY {_HEIGHT} DESC, c.depth DESC, c.id) AS n FROM most m JOIN commit c ON c.id = m.id) q WHERE n = 1),
        two AS (SELECT l.branch AS a, r.branch AS b, l.id AS l, r.id AS r, EXISTS (SELECT 1 FROM reach x WHERE x.node = l.id AND x.ancestor = r.id) AS up, EXISTS (SELECT 1 FROM reach x WHERE x.node = r.id AND x.ancestor = l.id) AS down FROM heads l JOIN heads r ON r.conv_id = l.conv_id - 1)
        SELECT a, b, CASE WHEN up OR down THEN 'FastForward' WHEN base IS NOT NULL THEN 'Merge' ELSE 'Unrelated' END AS result, CASE WHEN up THEN l WHEN down THEN r END AS head, CASE WHEN NOT (up OR down) THEN base END AS base FROM two LEFT JOIN bases USING (l, r)
        UNION ALL SELECT branch, branch || '-old', 'FastForward', id, NULL FROM heads UNION ALL SELECT branch, branch, 'InvalidInput', NULL, NULL FROM heads""")),
    "publish_rows": (publish_rows, oracle(_REACH + """, a AS (SELECT r.ancestor AS id, min(l.height) AS layer FROM layer l JOIN reach r ON r.node = l.source_commit GROUP BY r.ancestor), t AS (SELECT id AS top, height AS high, logical % 5 AS top_root FROM layer ORDER BY height DESC LIMIT 1),
        j AS (SELECT h.branch, h.id, a.layer, t.*, CASE WHEN a.layer IS NOT NULL THEN 'UpToDate' WHEN h.conv_id % 4 = 0 THEN 'Moved' WHEN h.logical % 5 = t.top_root THEN 'NoChanges' ELSE 'Added' END AS result FROM heads h LEFT JOIN a USING (id), t)
        SELECT branch, result, CASE WHEN result = 'Added' THEN high + 1 ELSE layer END AS layer, CASE WHEN result = 'Added' THEN top END AS parent, CASE WHEN result = 'Added' THEN id END AS source_commit FROM j""")),
    "commit_rows": (commit_rows, oracle("SELECT c.branch, CASE WHEN b.conv_id % 3 = 0 THEN 'old' ELSE c.id END AS parent, -1 AS root, CASE WHEN b.conv_id % 3 = 0 THEN c.id END AS displaced FROM commit c JOIN branch b ON b.branch = c.branch AND b.last = c.depth WHERE b.conv_id % 5 <> 0 AND (b.conv_id % 3 <> 0 OR b.conv_id % 2 = 0)")),
    "fork_branch": (fork_branch, oracle("SELECT CASE conv_id WHEN 1 THEN 'feat' ELSE 'z' END AS branch, conv_id, commits, branch AS forked_from FROM branch WHERE conv_id IN (1, 3)")),
    "reserve_inodes": (reserve_inodes, 'WITH x AS (SELECT l_suppkey % 10 AS scope, l_orderkey * 10 + l_linenumber AS seq, sum(CAST(l_quantity AS BIGINT)) AS c FROM lineitem GROUP BY ALL) SELECT scope, seq, CAST(1000 + sum(c) OVER w - c AS BIGINT) AS start, CAST(1000 + sum(c) OVER w AS BIGINT) AS "end" FROM x WINDOW w AS (PARTITION BY scope ORDER BY seq ROWS UNBOUNDED PRECEDING)'),
}
