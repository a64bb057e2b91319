"""The graph of commits, branches and layers.

Ancestry is told by runs of first parents: what a commit holds of a run is told
by one depth (frontier). Only the list of all ancestors is a closure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import lines as L
from arbor.session import ship, written


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and ancestor, itself included, for all nodes(id) over edges(child, parent)."""
    reach = written(nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor")).unionAll(edges.select("child", "parent")).distinct(), "reach")
    size = -1
    while size != (now := reach.count()):
        size = now
        step = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"))
        reach = written(reach.join(step, "ancestor").select("node", F.col("above").alias("ancestor")).distinct(), "reach")
    return reach


def lineage(commits: DataFrame) -> DataFrame:
    """id, run and depth: a run follows first parents; of several children of a
    commit the one of least id goes on, others begin their own run."""
    heirs = commits.where("parent is not null").groupBy("parent").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("goes_on"))
    here = commits.select("id", "parent").join(heirs, "id", "left")
    hops = written(here.select("id", F.when(F.col("goes_on"), F.col("parent")).otherwise(F.col("id")).alias("to"), F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth")), "hops")
    while True:
        to = hops.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        up = hops.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        after = hops.join(to, "to").join(up, "up").select("id", F.col("to2").alias("to"), F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), ((F.col("to") != F.col("to2")) | (F.col("up") != F.col("up2"))).alias("moved"))
        hops = written(after, "hops")
        if hops.where("moved").isEmpty():
            return hops.select("id", F.col("to").alias("run"), "depth")
        hops = hops.drop("moved")


def crossings(chain: DataFrame, edges: DataFrame) -> DataFrame:
    """run, at, to_run, to_depth: the commit of a run at depth `at` has a parent
    in another run. Only those that lead further up that run than all before."""
    child, parent = chain.toDF("child", "run", "at"), chain.toDF("parent", "to_run", "to_depth")
    met = edges.join(child, "child").join(parent, "parent").where("run <> to_run").groupBy("run", "to_run", "at").agg(F.max("to_depth").alias("to_depth"))
    w = Window.partitionBy("run", "to_run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    best = met.withColumn("before", F.max("to_depth").over(w)).where("before is null or to_depth > before")
    return written(best.select("run", "at", "to_run", "to_depth"), "crossings")


def frontier(wanted: DataFrame, chain: DataFrame, cross: DataFrame) -> DataFrame:
    """node, run and depth: of each run that the ancestry of wanted(id) meets,
    how far down it goes; all commits of a run above are ancestors, too. A row a
    run instead of one an ancestor; as many rounds as runs lie one behind another."""
    best = written(wanted.select("id").distinct().join(chain, "id").select(F.col("id").alias("node"), "run", "depth", F.lit(True).alias("new")), "best")
    while True:
        front = best.where("new").select("node", "run", "depth").join(cross, "run").where("at <= depth")
        step = front.select("node", F.col("to_run").alias("run"), F.col("to_depth").alias("depth"), F.lit(None).cast("int").alias("old"))
        both = best.select("node", "run", "depth", F.col("depth").alias("old")).unionAll(step).groupBy("node", "run").agg(F.max("depth").alias("depth"), F.max("old").alias("old"))
        best = written(both.select("node", "run", "depth", F.expr("old is null or depth > old").alias("new")), "best")
        if best.where("new").isEmpty():
            return best.select("node", "run", "depth")


def holds(pairs: DataFrame, found: DataFrame, chain: DataFrame) -> DataFrame:
    """Those of pairs(l, r) where l's ancestry, of the frontier, holds r."""
    at = pairs.select("l", "r").distinct().join(chain.toDF("r", "run", "at"), "r")
    return at.join(found.withColumnRenamed("node", "l"), ["l", "run"]).where("depth >= at").select("l", "r")


def first_parents(heads: DataFrame, commits: DataFrame) -> DataFrame:
    """branch, id and depth of every commit of each branch's first-parent chain
    from heads(branch, id), down to the base."""
    chain = lineage(commits)
    own = heads.join(chain, "id").select("branch", "run", F.col("depth").alias("top"))
    return own.join(chain, "run").where("depth <= top").select("branch", "id", "depth")


def merge_bases(pairs: DataFrame, found: DataFrame, chain: DataFrame, cross: DataFrame, rank: DataFrame) -> DataFrame:
    """l, r and their merge base: of the common ancestors that no other one
    descends from, that of the newest layer, the greatest depth, the least id.
    found is the frontier of both sides' commits; rank(id, height, depth).

    Of each run only the lowest common commit can be the base, and what descends
    from it in common does so through a child in another run: a crossing."""
    left, right = found.toDF("l", "run", "dl"), found.toDF("r", "run", "dr")
    common = pairs.select("l", "r").distinct().join(left, "l").join(right, ["r", "run"]).select("l", "r", "run", F.least("dl", "dr").alias("depth"))
    passed = common.join(cross, "run").where("at <= depth").groupBy("l", "r", F.col("to_run").alias("run")).agg(F.max("to_depth").alias("passed"))
    lowest = common.join(passed, ["l", "r", "run"], "left").where("passed is null or passed < depth")
    best = lowest.select("l", "r", "run", "depth").join(chain, ["run", "depth"]).select("l", "r", "id").join(rank, "id")
    order = F.row_number().over(Window.partitionBy("l", "r").orderBy(F.desc("height"), F.desc("depth"), "id"))
    return best.withColumn("n", order).where("n = 1").select("l", "r", F.col("id").alias("base"))


def running(left: DataFrame, right: DataFrame, at: str, value: str, step: int, least: bool = False) -> DataFrame:
    """left with the greatest `value` of right's rows of the same run at or
    before left's `at`; or the least of those at or after it. By ranges of
    `step` of the axis, and what the other ranges of a run carry over."""
    pick, kind = (F.min if least else F.max), right.schema[value].dataType
    ranged = lambda df: df.withColumn("_range", F.floor(F.col(at) / step))
    l, r = ranged(left), ranged(right.select("run", at, value))  # noqa: E741
    both = l.withColumn("_v", F.lit(None).cast(kind)).withColumn("_left", F.lit(True)).unionByName(r.select("run", at, "_range", F.col(value).alias("_v"), F.lit(False).alias("_left")), allowMissingColumns=True)
    order = [F.col(at).desc() if least else F.col(at), "_left"]
    near = both.withColumn("_near", pick("_v").over(Window.partitionBy("run", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where("_left")
    edge = both.groupBy("run", "_range").agg(pick("_v").alias("_edge"))
    far = edge.withColumn("_far", pick("_edge").over(Window.partitionBy("run").orderBy(F.desc("_range") if least else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)))
    told = near.join(far.select("run", "_range", "_far"), ["run", "_range"])
    return told.withColumn(value, (F.least if least else F.greatest)("_near", "_far")).drop("_v", "_left", "_near", "_range", "_far")


#: Depths of a range in running().
RANGE = 4096


def absorbed(found: DataFrame, chain: DataFrame, layers: DataFrame) -> DataFrame:
    """id and the height of the first layer whose ancestry holds the commit;
    found is the frontier of the layers' source commits."""
    tops = layers.select(F.col("source_commit").alias("node"), "height").join(found, "node").groupBy("run", "depth").agg(F.min("height").alias("height"))
    return running(chain, tops, "depth", "height", RANGE, least=True).where("height is not null").select("id", "height")


def covered(heads: DataFrame, found: DataFrame, chain: DataFrame, layers: DataFrame) -> DataFrame:
    """branch, the newest layer published from its head's ancestry (0 if none),
    and how many layers lie above that: what a publish would pass over. found
    is the frontier of the heads."""
    top = layers.agg(F.coalesce(F.max("height"), F.lit(0)).alias("head"))
    at = layers.select(F.col("source_commit").alias("id"), "height").join(chain, "id").groupBy("run", "depth").agg(F.max("height").alias("height"))
    reach = running(found, at, "depth", "height", RANGE).groupBy("node").agg(F.max("height").alias("height"))
    out = heads.select("branch", F.col("id").alias("node")).join(reach, "node", "left").crossJoin(F.broadcast(top))  # one row
    return out.select("branch", F.coalesce("height", F.lit(0)).alias("covered"), (F.col("head") - F.coalesce("height", F.lit(0))).alias("overwrote"))


def overwritten(layers: DataFrame, layer: str, count: int) -> DataFrame:
    """The `count` layers directly below one, newest first."""
    at = F.broadcast(layers.where(F.col("id") == layer).select(F.col("height").alias("top")))
    return layers.join(at, (F.col("height") < F.col("top")) & (F.col("height") >= F.col("top") - count)).select("id", "height", "conv_id").orderBy(F.desc("height"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, forward: bool = False) -> DataFrame:
    """left with the value of right's latest row at or before (first at or
    after) left's `at`, of the same `by`: one sort of both together, no pairs."""
    both = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left")).unionByName(right.select(by, at, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    order = [F.col(at).desc() if forward else F.col(at), "_left"]
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")


def as_of_all(left: DataFrame, right: DataFrame, at: str, value: str, step: int, forward: bool = False) -> DataFrame:
    """as_of() of whole tables, without a key: within ranges of `step` of the
    axis, and, where a range has nothing to carry, from the ranges before (or
    behind). What meets in one task is a row a range."""
    ranged = lambda df: df.withColumn("_range", F.floor(F.col(at) / step))
    l, r = ranged(left), ranged(right)  # noqa: E741
    near = as_of(l, r, "_range", at, value, forward)
    edge = r.groupBy("_range").agg((F.min_by if forward else F.max_by)(value, at).alias("_edge"))
    order = F.desc("_range") if forward else F.asc("_range")
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    every = edge.unionByName(l.select("_range").distinct().withColumn("_edge", F.lit(None).cast(right.schema[value].dataType)))
    carried = every.groupBy("_range").agg(F.max("_edge").alias("_edge")).withColumn("_carried", F.last("_edge", ignorenulls=True).over(w)).select("_range", "_carried")
    return near.join(carried, "_range", "left").withColumn(value, F.coalesce(value, "_carried")).drop("_range", "_carried")


def chain_heights(chain: DataFrame) -> DataFrame:
    """id and height, from 1, of chain(id, parent): pointers double each round."""
    return lineage(chain).select("id", (F.col("depth") + 1).alias("height"))


def revisions(versions: DataFrame, ref: str, order: str) -> DataFrame:
    """ref, order, change, size and object of each version of a file that
    differs from the one before it along first parents."""
    w = Window.partitionBy(ref).orderBy(order)
    told = versions.withColumn("object", F.sha2("text", 256)).withColumn("was", F.lag("object").over(w)).withColumn("first", F.row_number().over(w) == 1)
    change = F.when(F.col("first"), "Added").otherwise("Modified")
    return told.where(F.col("first") | ~F.col("object").eqNullSafe(F.col("was"))).select(ref, order, "id", change.alias("change"), F.octet_length("text").cast("long").alias("size"), "object")


def file_stats(revisions: DataFrame, ref: str, cap: int = 1000) -> DataFrame:
    """Size of the newest revision, how many there are, and the sum of their
    sizes; from the cap on more is told, and no sum."""
    out = revisions.groupBy(ref).agg(F.max_by("size", "n").alias("size"), F.count("*").alias("k"), F.sum("size").alias("sum"))
    return out.select(ref, "size", F.least("k", F.lit(cap)).alias("revisions"), (F.col("k") > cap).alias("more"), F.when(F.col("k") <= cap, F.col("sum")).alias("logical"))


def blame(versions: DataFrame, ref: str, order: str) -> DataFrame:
    """ref, line (from 1), text, id of the commit that each line of the newest
    version comes from, and whether large steps were compared coarsely."""
    ship(versions.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=False)
        texts = [t or "" for t in pdf["text"]]
        owner, coarse = L.blame(texts)
        ids = pdf["id"].tolist()
        rows = [(pdf[ref].iloc[0], k + 1, line, ids[o], coarse) for k, (line, o) in enumerate(zip(L.window_lines(texts[0]), owner))]
        return pd.DataFrame(rows, columns=[ref, "line", "text", "id", "coarse"])

    kind = versions.schema[ref].dataType.simpleString()
    return versions.select(ref, order, "id", "text").groupBy(ref).applyInPandas(run, f"{ref} {kind}, line int, text string, id string, coarse boolean")


def branch_list(branches: DataFrame) -> DataFrame:
    """Branches and main, in the order of names."""
    main = branches.sparkSession.createDataFrame([("main",)], "branch string")
    return branches.select("branch").unionByName(main).orderBy("branch")


def history_model(commits: DataFrame, newest: int) -> DataFrame:
    """The newest commits of each branch, once each, and a digest of them all
    that changes when something shown does."""
    w = Window.partitionBy("branch").orderBy(F.desc("depth"))
    shown = commits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= newest).select("id", "branch", "depth").dropDuplicates(["id"])
    # a digest that needs no order: the sum of the rows' own
    digest = F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "id", "branch", "depth"), 256), 1, 12), 16, 10).cast("decimal(38,0)"))
    return shown.groupBy("branch").agg(F.count("*").alias("commits"), F.max("depth").alias("newest"), digest.cast("decimal(38,0)").cast("string").alias("version"))


# rows that a write appends


def fork(branches: DataFrame, name: str, source: str) -> DataFrame:
    """A branch from another's head, or no row if the name is taken, reserved
    or malformed, or the source is absent."""
    from arbor.functions.paths import valid_history_name

    taken = branches.where(F.col("branch") == name).limit(1)
    new = branches.where(F.col("branch") == source).join(taken.select(F.lit(1).alias("taken")), F.lit(True), "left_anti")
    return new.where(F.lit(name != "main") & valid_history_name(F.lit(name))).withColumn("forked_from", F.col("branch")).withColumn("branch", F.lit(name))


def publish(heads: DataFrame, found: DataFrame, chain: DataFrame, layers: DataFrame) -> DataFrame:
    """What publishing each branch's head does: UpToDate if a layer's ancestry
    has it already, else Added at the height that the first such branch gets."""
    done = absorbed(found, chain, layers)
    return heads.join(done, "id", "left").select("branch", F.when(F.col("height").isNotNull(), "UpToDate").otherwise("Added").alias("result"), F.col("height").alias("layer"))


def commit_checks(attempts: DataFrame, heads: DataFrame) -> DataFrame:
    """attempts(branch, seen, root) against heads(branch, id, root): UpToDate on
    an equal root, Moved if the head is no more the one seen, else Committed."""
    j = attempts.join(heads.select("branch", F.col("id").alias("head"), F.col("root").alias("at")), "branch", "left")
    return j.select("branch", F.when(F.col("root").eqNullSafe(F.col("at")), "UpToDate").when(~F.col("seen").eqNullSafe(F.col("head")), "Moved").otherwise("Committed").alias("result"))


def publish_rows(heads: DataFrame, found: DataFrame, chain: DataFrame, layers: DataFrame) -> DataFrame:
    """What publishing heads(branch, id, root, seen) does, in the order of
    branches, and the layer rows that it appends. UpToDate if a layer's ancestry
    has the head already; Moved if the newest layer is no more the one seen;
    NoChanges if its root is the newest layer's; else Added, above the newest."""
    top = layers.agg(F.max_by("id", "height").alias("top"), F.max_by("root", "height").alias("top_root"), F.coalesce(F.max("height"), F.lit(0)).alias("high"))
    j = heads.join(absorbed(found, chain, layers), "id", "left").crossJoin(F.broadcast(top))  # one row
    result = F.when(F.col("height").isNotNull(), "UpToDate").when(~F.col("seen").eqNullSafe(F.col("top")), "Moved").when(F.col("root").eqNullSafe(F.col("top_root")), "NoChanges").otherwise("Added")
    return j.select("branch", result.alias("result"), F.when(result == "Added", F.col("high") + 1).otherwise(F.col("height")).alias("layer"), F.when(result == "Added", F.col("top")).alias("parent"), F.when(result == "Added", F.col("id")).alias("source_commit"))


def commit_rows(attempts: DataFrame, heads: DataFrame) -> DataFrame:
    """The commit rows that attempts(branch, seen, root, force) append to
    heads(branch, id, root): none on an equal root, or where the head has moved
    and force is not set. A forced commit keeps the parent that was seen, and
    tells the head that it displaced."""
    told = commit_checks(attempts, heads).join(attempts, "branch").join(heads.select("branch", "id"), "branch", "left")
    made = told.where("result = 'Committed' or result = 'Moved' and force")
    return made.select("branch", F.sha2(F.concat_ws(":", "branch", "seen", F.col("root").cast("string")), 256).alias("id"), F.col("seen").alias("parent"), "root", F.when(F.col("result") == "Moved", F.col("id")).alias("displaced"))


def reserve(demands: DataFrame, high: int) -> DataFrame:
    """Half-open ranges of serials from high on for demands(scope, seq, count)."""
    w = Window.partitionBy("scope").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(high) + F.coalesce(F.sum("count").over(w), F.lit(0))
    return demands.select("scope", "seq", start.cast("long").alias("start"), (start + F.col("count")).cast("long").alias("end"))


def comparable(layers: DataFrame, commits: DataFrame) -> DataFrame:
    """layer, the commit that it can be compared by, and whether exactly: a
    listed commit of the same root (the least id), else the layer's source;
    null if it has none."""
    same = commits.groupBy("root").agg(F.min("id").alias("same"))
    j = layers.join(same, "root", "left")
    return j.select(F.col("id").alias("layer"), F.coalesce("same", "source_commit").alias("commit"), F.when(F.coalesce("same", "source_commit").isNotNull(), F.col("same").isNotNull()).alias("exact"))


def resolve(names: DataFrame, heads: DataFrame, commits: DataFrame, layers: DataFrame) -> DataFrame:
    """What each name means: main is the newest layer, an id of 66 hex digits a
    commit or layer, else a branch's head. Null where nothing is found."""
    ids = commits.select("id", F.lit("commit").alias("kind")).unionAll(layers.select("id", F.lit("layer").alias("kind")))
    main = layers.agg(F.max_by("id", "height").alias("node")).select(F.lit("main").alias("name"), "node", F.lit("layer").alias("kind"))
    known = main.unionAll(heads.select(F.col("branch").alias("name"), F.col("id").alias("node"), F.lit("branch").alias("kind")))
    known = known.unionAll(ids.select(F.col("id").alias("name"), F.col("id").alias("node"), "kind"))
    return names.join(known, "name", "left").select("name", "node", "kind")


def record_bindings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The bindings that are to be appended: found ones, once, not stored yet."""
    keys = ["parent_path", "name", "child"]
    return found.select(*keys).dropDuplicates(keys).join(stored, keys, "left_anti")
