"""Differences of two trees and of texts; sizes; changes of a workspace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.functions import lines as L
from arbor.operators.scan import kind_name
from arbor.session import ship


def _sides(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    a = left.select(*on, *(F.col(c).alias("l_" + c) for c in left.columns if c not in on), F.lit(True).alias("l_here"))
    b = right.select(*on, *(F.col(c).alias("r_" + c) for c in right.columns if c not in on), F.lit(True).alias("r_here"))
    return a.join(b, list(on), "full_outer")


def differs(a: str, b: str):
    return ~F.col(a).eqNullSafe(F.col(b))


def diff_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, change, type, inodes before and after, content, identity and
    metadata of each path that differs. Contents are compared by their bytes'
    id, and never for a directory on both sides; a directory that differs by
    its children alone is not listed. One full outer join on path."""
    j = _sides(left.drop("parent_path", "name"), right.drop("parent_path", "name"), "path")
    both = F.col("l_here") & F.col("r_here")
    content = both & ~((F.col("l_kind") == 2) & (F.col("r_kind") == 2)) & (differs("l_content_id", "r_content_id") | differs("l_kind", "r_kind"))
    identity = both & differs("l_serial", "r_serial")
    metadata = both & (differs("l_mode", "r_mode") | differs("l_mtime_s", "r_mtime_s") | differs("l_mtime_ns", "r_mtime_ns"))
    change = F.when(F.col("l_here").isNull(), "Added").when(F.col("r_here").isNull(), "Removed").otherwise("Modified")
    out = j.select("path", change.alias("change"), kind_name(F.coalesce("r_kind", "l_kind")).alias("type"), F.col("l_serial").alias("before"), F.col("r_serial").alias("after"), *(F.coalesce(e, F.lit(False)).alias(n) for e, n in ((content, "content"), (identity, "identity"), (metadata, "metadata"))))
    return out.where("change <> 'Modified' or content or identity or metadata")


def diff_flags(changes: DataFrame) -> DataFrame:
    """How many changes of each kind, and the flags they carry."""
    return changes.groupBy("change", "type").agg(F.count("*").alias("paths"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in ("content", "identity", "metadata")))


def root_changes(changes: DataFrame, limit: int) -> DataFrame:
    """The first `limit` paths in component order, and whether there are more:
    a top-k, no sort of all."""
    first = changes.select("path").orderBy(F.split("path", "/")).limit(limit + 1)
    return first.agg(F.slice(F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("c"), "path"))), 1, limit).alias("p"), (F.count("*") > limit).alias("truncated")).select(F.explode("p.path").alias("path"), "truncated")


def inode_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """serial and whether the value, and whether the count of links, differ."""
    def inodes(t):
        return t.groupBy("serial").agg(F.first("kind").alias("kind"), F.first("content_id").alias("content_id"), F.first("mode").alias("mode"), F.first("mtime_s").alias("mtime_s"), F.first("mtime_ns").alias("mtime_ns"), F.count("*").alias("nlink"))

    j = _sides(inodes(left), inodes(right), "serial")
    value = differs("l_kind", "r_kind") | differs("l_content_id", "r_content_id") | differs("l_mode", "r_mode") | differs("l_mtime_s", "r_mtime_s") | differs("l_mtime_ns", "r_mtime_ns")
    return j.select("serial", value.alias("value"), differs("l_nlink", "r_nlink").alias("links")).where("value or links")


def bindings(tree: DataFrame) -> DataFrame:
    return tree.where("path <> '/'").select("parent_path", "name", F.col("serial").alias("child"))


def binding_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """parent_path and names whose child differs."""
    j = _sides(bindings(left), bindings(right), "parent_path", "name")
    return j.where(differs("l_child", "r_child")).select("parent_path", "name", F.col("l_child").alias("before"), F.col("r_child").alias("after"))


def new_bindings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bindings that right has and left lacks."""
    return bindings(right).join(bindings(left), ["parent_path", "name", "child"], "left_anti")


def logical_size(tree: DataFrame) -> DataFrame:
    """Bytes of all files, a hard link for each of its paths."""
    return tree.where("kind = 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical"))


def logical_change(left: DataFrame, right: DataFrame) -> DataFrame:
    """What to add to left's logical size for right's, from what differs."""
    j = _sides(left.where("kind = 1").select("path", "size", "content_id"), right.where("kind = 1").select("path", "size", "content_id"), "path")
    moved = j.where(differs("l_content_id", "r_content_id"))
    return moved.agg(F.coalesce(F.sum(F.coalesce("r_size", F.lit(0)) - F.coalesce("l_size", F.lit(0))), F.lit(0)).alias("change"))


def text_pairs(left: DataFrame, right: DataFrame, left_content: DataFrame, right_content: DataFrame) -> DataFrame:
    """path and both texts of the files whose content differs. Only contents
    that differ are read."""
    a = left.where("kind = 1").select("path", F.col("content_id").alias("l_id"))
    b = right.where("kind = 1").select("path", F.col("content_id").alias("r_id"))
    j = a.join(b, "path").where("l_id <> r_id")
    j = j.join(left_content.select(F.col("content_id").alias("l_id"), F.col("text").alias("l_text")), "l_id")
    return j.join(right_content.select(F.col("content_id").alias("r_id"), F.col("text").alias("r_text")), "r_id").select("path", "l_text", "r_text")


def diff_files(pairs: DataFrame) -> DataFrame:
    """path, kind (Equal, Text or Binary: a NUL, or more than 1 MiB) and hunks."""
    ship(pairs.sparkSession)
    hunk = "array<struct<l_line:int,r_line:int,removed:array<string>,added:array<string>>>"

    @F.pandas_udf(hunk)
    def hunks(l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([[dict(zip(("l_line", "r_line", "removed", "added"), h)) for h in L.hunks(x, y)] for x, y in zip(l, r)])

    text = ~F.contains("l_text", F.lit("\0")) & ~F.contains("r_text", F.lit("\0")) & (F.greatest(F.octet_length("l_text"), F.octet_length("r_text")) <= L.TEXT_BYTES)
    kind = F.when(F.col("l_text") == F.col("r_text"), "Equal").when(text, "Text").otherwise("Binary")
    told = pairs.withColumn("kind", kind)
    return told.where("kind = 'Text'").select("path", "kind", hunks("l_text", "r_text").alias("hunks")).unionAll(told.where("kind <> 'Text'").select("path", "kind", F.lit(None).cast(hunk).alias("hunks")))


def diff_lines(pairs: DataFrame) -> DataFrame:
    """path, n, op ('=', '-', '+') and line of the difference of each text pair."""
    ship(pairs.sparkSession)

    def run(batches):
        for b in batches:
            out = [(p, n, op, line) for p, x, y in zip(b.path, b.l_text, b.r_text) for n, (op, line) in enumerate(L.diff_rows(x, y), 1)]
            yield pd.DataFrame(out, columns=["path", "n", "op", "line"])

    return pairs.mapInPandas(run, "path string, n int, op string, line string")


def list_changes(base: DataFrame, live: DataFrame, content: DataFrame) -> DataFrame:
    """path, change, type and whether a changed file still holds conflict
    markers, of all that a workspace shows otherwise than its base."""
    from arbor.operators.scan import marked

    changes = diff_trees(base, live).select("path", "change", "type")
    files = changes.where("change <> 'Removed'").join(live.where("kind = 1").select("path", "content_id"), "path")
    held = files.join(marked(content), "content_id", "left_semi").select("path", F.lit(True).alias("held"))
    return changes.join(held, "path", "left").select("path", "change", "type", F.coalesce("held", F.lit(False)).alias("markers"))
