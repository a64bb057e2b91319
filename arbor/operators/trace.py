"""Call traces: sources, pairs of start and end, summaries, timing trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "trace int, id string, method string, project string, start string, ms double, ok boolean, code string, phase string, scope string"


def read_lines(spark: SparkSession, path: str, project: str | None = None, since: str | None = None) -> DataFrame:
    """Calls of JSON lines below path, the file's name as actor; lines that are
    malformed or of another version are dropped."""
    raw = spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path).withColumn("actor", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl?)?$", 1))
    return wanted(raw, project, since)


def wanted(lines: DataFrame, project: str | None, since: str | None) -> DataFrame:
    out = lines.where("trace = 1")
    if project is not None:
        out = out.where(F.col("project") == project)
    return out if since is None else out.where(F.to_timestamp("start") >= F.to_timestamp(F.lit(since)))


def pairs(calls: DataFrame) -> DataFrame:
    """id, start and end of each call; one that has no end is running. One
    aggregation by id, whatever the order in which lines came."""
    out = calls.groupBy("id").agg(F.min(F.when(F.col("phase") == "start", F.col("at"))).alias("start"), F.max(F.when(F.col("phase") == "end", F.col("at"))).alias("end"))
    return out.withColumn("running", F.col("end").isNull())


def summary(calls: DataFrame, by: str) -> DataFrame:
    """Calls, first and last start, most and total of a value, and how often it
    went down from one call to the next; the change is null if it ever did."""
    w = Window.partitionBy(by).orderBy("start", "id")
    down = (F.col("value") < F.lag("value").over(w)).cast("int")
    told = calls.withColumn("down", F.coalesce(down, F.lit(0)))
    out = told.groupBy(by).agg(F.count("*").alias("calls"), F.min("start").alias("first"), F.max("start").alias("last"), F.max("value").alias("most"), F.sum("down").alias("gaps"), F.min_by("value", F.struct("start", "id")).alias("a"), F.max_by("value", F.struct("start", "id")).alias("z"))
    return out.select(by, "calls", "first", "last", "most", "gaps", F.when(F.col("gaps") == 0, F.col("z") - F.col("a")).alias("change"))


def windows(calls: DataFrame, every: str) -> DataFrame:
    """First, last and greatest value of each window of time."""
    return calls.groupBy(F.window("start", every).alias("w")).agg(F.min_by("value", F.struct("start", "id")).alias("first"), F.max_by("value", F.struct("start", "id")).alias("last"), F.max("value").alias("most"), F.count("*").alias("samples")).select(F.col("w.start").alias("window"), "first", "last", "most", "samples")


def counter_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """after - before of each counter, null (not 0) where either is missing."""
    return before.select(key, F.col("value").alias("b")).join(after.select(key, F.col("value").alias("a")), key, "full_outer").select(key, (F.col("a") - F.col("b")).alias("change"))


def run_values(runs: DataFrame, values: DataFrame, step: int = 1024) -> DataFrame:
    """runs(id, json), json a list of [first, last] ordinals, joined to
    values(id, ordinal, value) within each run: equal id, ordinal in range. A
    run meets only the values of the steps of the axis that it lies on."""
    run = runs.select("id", F.explode(F.from_json("json", "array<array<long>>")).alias("r")).select("id", F.col("r")[0].alias("first"), F.col("r")[1].alias("last"))
    cells = run.where("first <= last").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor(F.col("last") / step))))
    return cells.join(values.withColumn("cell", F.floor(F.col("ordinal") / step)), ["id", "cell"]).where("ordinal between first and last").select("id", "ordinal", "value")


def observations(rows: DataFrame) -> DataFrame:
    """rows(scope, section, value) as sections by scope: what was not available
    is null, never 0; a scope is complete if section 99 came."""
    return rows.groupBy("scope").agg(F.sort_array(F.collect_set(F.when(F.col("value").isNotNull(), F.col("section")))).alias("sections"), F.sum("value").alias("total"), F.max(F.col("section") == 99).alias("complete"))


def flatten_timings(trees: DataFrame) -> DataFrame:
    """id, index, name, parent, micros and level of trees(id, nodes), nodes in
    pre-order with a parent's index, -1 at the root. A level is a parent's plus
    one: found within the row, node by node."""
    level = "aggregate(nodes, cast(array() as array<int>), (acc, x) -> concat(acc, array(if(x.parent < 0, 0, acc[x.parent] + 1))))"
    return trees.withColumn("levels", F.expr(level)).select("id", F.posexplode(F.arrays_zip("nodes", "levels")).alias("index", "z")).select("id", "index", "z.nodes.name", "z.nodes.parent", "z.nodes.micros", F.col("z.levels").alias("level"))


def rebuild_timings(flat: DataFrame, most: int = 256) -> DataFrame:
    """id, nodes (in pre-order, parents by their place among those kept) and
    omitted, from the rows of flatten_timings(). A tree keeps at most `most`
    nodes, a fixed value of the interface: the shallowest levels that fit whole;
    what is left out is counted."""
    level = flat.groupBy("id", "level").agg(F.count("*").alias("n"))
    total = level.withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy("level")))
    deepest = total.groupBy("id").agg(F.max(F.when(F.col("upto") <= most, F.col("level"))).alias("deepest"), F.sum("n").alias("n"))
    kept = flat.join(deepest, "id").where("level <= deepest")
    kept = kept.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("index")) - 1)
    place = kept.select("id", F.col("index").alias("parent"), F.col("at").alias("up"))
    node = kept.join(place, ["id", "parent"], "left").select("id", "n", F.struct("at", "name", F.coalesce("up", F.lit(-1)).alias("parent"), "micros").alias("node"))
    nodes = F.transform(F.sort_array(F.collect_list("node")), lambda x: F.struct(x["name"], x["parent"], x["micros"]))
    return node.groupBy("id").agg(nodes.alias("nodes"), (F.first("n") - F.count("*")).alias("omitted"))


def observed_calls(trace: DataFrame, observed: DataFrame) -> DataFrame:
    """Calls of trace(id, scope, ...) with the sections that were observed of
    their scope; null where none were, never empty."""
    return trace.join(observed, "scope", "left")


def read_model(workspaces: DataFrame, branches: DataFrame) -> DataFrame:
    """Workspaces with whether their branch's head has moved since; null where
    the branch is unknown."""
    j = workspaces.join(branches.select("branch", F.col("head").alias("now"), F.lit(True).alias("known")), "branch", "left")
    return j.select("workspace", "branch", F.when(F.col("known"), ~F.col("head").eqNullSafe(F.col("now"))).alias("moved"))
