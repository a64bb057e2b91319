"""Reading a snapshot: walk, stat, list, read, glob, grep, rules, lookups.

A tree is a DataFrame (path, parent_path, name, serial, kind, content_id, mode,
mtime_s, mtime_ns, size), a content table (content_id, text, length). Orders
are left to the caller, who has them with paths.components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import globs, paths
from arbor.session import written

KINDS = {1: "file", 2: "dir", 3: "symlink"}
#: Characters of a line that grep shows.
SHOWN = 1024


def kind_name(kind):
    return F.when(kind == 1, "file").when(kind == 2, "dir").when(kind == 3, "symlink")


def walk(tree: DataFrame, top: str = "/") -> DataFrame:
    """Entries at and below top; a file stands for itself."""
    return tree.where(paths.below(F.col("path"), top))


def subtree(tree: DataFrame, top: str) -> DataFrame:
    """walk() with paths relative to top."""
    return walk(tree, top).withColumn("relative", F.when(F.col("path") == top, "").otherwise(F.substring("path", len(top.rstrip("/")) + 2, 4096)))


def stat(tree: DataFrame, path: str) -> DataFrame:
    """One row, or none if path is absent; directories have size 0."""
    return tree.where(F.col("path") == path).select("path", kind_name(F.col("kind")).alias("type"), F.col("serial").alias("inode"), "size", "mode")


def list_directory(tree: DataFrame, path: str) -> DataFrame:
    """The entries of one directory."""
    return tree.where((F.col("parent_path") == path) & (F.col("path") != "/")).select("name", "path", kind_name(F.col("kind")).alias("type"), F.col("serial").alias("inode"))


def lines(content: DataFrame) -> DataFrame:
    """content_id, n (from 1) and line; a last newline ends a line, opens none."""
    ended = F.when(F.col("text").endswith("\n"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return content.where(F.length("text") > 0).select("content_id", F.posexplode(F.split(ended, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def read(tree: DataFrame, content: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 2000) -> DataFrame:
    """Lines start to end of a file, at most `most`."""
    last = start + most - 1 if end is None else min(end, start + most - 1)
    file = tree.where((F.col("path") == path) & (F.col("kind") == 1)).select("path", "content_id")
    return lines(content.join(F.broadcast(file.select("content_id")), "content_id", "left_semi")).join(F.broadcast(file), "content_id").where(F.col("n").between(start, last)).select("path", "n", "line")


def read_window(tree: DataFrame, content: DataFrame, demands: DataFrame, most: int = 2000) -> DataFrame:
    """For demands(path, start, end): the file's size and lines, the last line of
    the window (at most `most`, a fixed value of the interface) and the next one
    to read, null at the end; a null end is the file's."""
    files = tree.where("kind = 1").select("path", "content_id", "size").join(demands, "path")
    ended = F.col("text").endswith("\n")
    total = F.when(F.length("text") == 0, 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when(ended, 0).otherwise(1))
    j = files.join(content.select("content_id", total.alias("lines")), "content_id")
    last = F.least(F.coalesce("end", "lines"), F.col("start") + most - 1, "lines")
    return j.select("path", "size", F.col("lines").cast("long").alias("lines"), last.cast("long").alias("last"), F.when(last < F.col("lines"), last + 1).cast("long").alias("next"))


def glob(tree: DataFrame, pattern: str, top: str = "/") -> DataFrame:
    """Entries whose whole path matches; the literal directories that an anchored
    pattern begins with reach the scan as a prefix."""
    rule = globs.rule(pattern)
    found = walk(tree, top).where(F.col("path") != "/")
    if rule.prefix():
        found = found.where(F.col("path").startswith("/" + rule.prefix() + "/"))
    return found.where(F.substring("path", 2, 4096).rlike(rule.regex(True)))


def grep(tree: DataFrame, content: DataFrame, literal: str, top: str = "/") -> DataFrame:
    """path, n, line and truncated of the lines that hold a literal. Each
    distinct content is searched once, whatever number of paths it has, and
    only contents that hold the literal are split; binary contents are skipped."""
    if "\n" in literal[:-1]:
        return tree.where("false").select("path", F.lit(0).alias("n"), F.lit("").alias("line"), F.lit(False).alias("truncated"))
    files = walk(tree, top).where("kind = 1").select("path", "content_id")
    wanted = content.where(~F.contains("text", F.lit("\0")) & F.contains("text", F.lit(literal)))
    wanted = wanted.join(files.select("content_id").distinct(), "content_id", "left_semi")
    sought = literal.removesuffix("\n")
    hits = lines(wanted).where(F.contains("line", F.lit(sought)) if sought == literal else F.col("line").endswith(sought))
    return hits.join(files, "content_id").select("path", "n", F.substring("line", 1, SHOWN).alias("line"), (F.length("line") > SHOWN).alias("truncated"))


def grep_skipped(tree: DataFrame, content: DataFrame, top: str = "/") -> DataFrame:
    """How many paths grep searches, and skips as binary."""
    files = walk(tree, top).where("kind = 1").join(content.select("content_id", F.contains("text", F.lit("\0")).alias("binary")), "content_id")
    return files.agg(F.count(F.when(~F.col("binary"), 1)).alias("searched"), F.count(F.when(F.col("binary"), 1)).alias("skipped"))


def match_rules(tree: DataFrame, rules: list[globs.Rule]) -> DataFrame:
    """path and the rule that decides it: the last that matches the path or a
    directory above it; where that is negated there is none. Rules are few and
    compiled into the plan."""
    deciding = F.lit(None).cast("int")
    name = F.substring("path", 2, 4096)
    for i, rule in enumerate(rules):
        deciding = F.when(name.rlike(rule.regex(False)), F.lit(i)).otherwise(deciding)
    numbered = F.array(*[F.lit(r.pattern) for r in rules] or [F.lit("")])
    negated = [i for i, r in enumerate(rules) if r.negated]
    hit = tree.withColumn("_rule", deciding).where(F.col("_rule").isNotNull() & ~F.col("_rule").isin(negated or [-1]))
    return hit.select("path", F.element_at(numbered, F.col("_rule") + 1).alias("rule"))


def locate(tree: DataFrame, serials: DataFrame) -> DataFrame:
    """serial and its first path: fewest components, then component order."""
    order = Window.partitionBy("serial").orderBy(F.size(F.split("path", "/")), F.split("path", "/"))
    found = tree.join(serials, "serial", "left_semi").withColumn("r", F.row_number().over(order))
    return found.where("r = 1").select("serial", "path")


def lookup(tree: DataFrame, demands: DataFrame) -> DataFrame:
    """demands(ordinal, path) with what is there, null where nothing is."""
    return demands.join(tree.select("path", "serial", "kind", "size"), "path", "left").select("ordinal", "path", "serial", "kind", "size")


def marked(content: DataFrame) -> DataFrame:
    """Contents with a whole marker block: an opening line, later a separator,
    later a closing line."""
    n = lines(content)
    first = n.where(F.col("line").startswith("<<<<<<< ")).groupBy("content_id").agg(F.min("n").alias("a"))
    middle = n.where("line = '======='").join(first, "content_id").where("n > a").groupBy("content_id").agg(F.min("n").alias("b"))
    return n.where(F.col("line").startswith(">>>>>>> ")).join(middle, "content_id").where("n > b").select("content_id").distinct()


def climb(tree: DataFrame) -> DataFrame:
    """serial and path by climbing from child to parent binding: what is known
    of the way up doubles each round, so that rounds grow with the logarithm of
    the depth, whatever it is."""
    names = tree.select(F.col("serial").alias("child"), "path", "parent_path", "name")
    way = names.where("path <> '/'").select("child", F.col("path").alias("at"), F.col("parent_path").alias("next"), F.concat(F.lit("/"), "name").alias("built"))
    root = names.where("path = '/'").select("child", F.lit("/").alias("built"))
    way = written(way, "climb")
    while not way.where("next <> '/'").isEmpty():
        up = way.select(F.col("at").alias("next"), F.col("next").alias("above"), F.col("built").alias("front"))
        step = way.where("next <> '/'").join(up, "next").select("child", "at", F.col("above").alias("next"), F.concat("front", "built").alias("built"))
        way = written(way.where("next = '/'").unionAll(step), "climb")
    return root.unionAll(way.select("child", "built")).select(F.col("child").alias("serial"), F.col("built").alias("path"))


def with_attributes(tree: DataFrame, attributes: DataFrame) -> DataFrame:
    """tree with its attributes(serial, domain, key, value) as one map by
    domain:key."""
    own = attributes.groupBy("serial").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.concat_ws(":", "domain", "key").alias("k"), F.col("value").alias("v"))))).alias("attributes"))
    return tree.join(own, "serial", "left")


def attribute_keys(tree: DataFrame) -> DataFrame:
    """path and its attributes' keys, sorted by domain and key."""
    return tree.select("path", F.sort_array(F.map_keys("attributes")).alias("keys"))


def read_attribute(tree: DataFrame, domain: str, key: str) -> DataFrame:
    return tree.select("path", F.try_element_at("attributes", F.lit(f"{domain}:{key}")).alias("value"))


def read_link(tree: DataFrame) -> DataFrame:
    """path and target of the symbolic links."""
    return tree.where("kind = 3").select("path", "target")
