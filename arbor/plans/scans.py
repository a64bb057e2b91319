"""Queries over one snapshot, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.functions import globs, paths
from arbor.operators import scan
from arbor.sources.adapter import oracle, view

RULES = [globs.rule(p) for p in ("*.txt", "!/en/", "/en/src1*/**/doc-*[0-9].txt", "/en/**/doc-?5.txt", "fr")]


def _tree(spark, d):
    return view(spark, d, "tree_base")


def _pages(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+:/", "")
    return spark.read.parquet(f"{d}/pages.parquet").select(path.alias("path"), F.col("page_id").alias("serial"))


_PAGES = r"(SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+:/', '') AS path, page_id AS serial FROM pages) p"


def _glob_sql(pattern, source, columns):
    return f"SELECT {columns} FROM {source} WHERE path <> '/' AND regexp_matches(substr(path, 2), '{globs.rule(pattern).regex(True)}')"


def rule_match_last_wins(spark, d):
    return scan.match_rules(_tree(spark, d), RULES)


_WHEN = "\n".join(f"WHEN regexp_matches(substr(path, 2), '{r.regex(False)}') THEN {'NULL' if r.negated else repr(r.pattern)}" for r in reversed(RULES))
_LINES = "(SELECT content_id, n, line FROM content_base, unnest(string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) WITH ORDINALITY AS u(line, n) WHERE length(text) > 0) l"


def walk_tree(spark, d):
    return scan.walk(_tree(spark, d), "/en").select("path", "kind", "serial", paths.depth(F.col("path")).alias("depth"), F.array_join(paths.parents(F.col("path")), "|").alias("parents"))


def read_lines(spark, d):
    tree, content = _tree(spark, d), view(spark, d, "content_base")
    first = tree.where("kind = 1 and size > 200").agg(F.min_by("path", "serial")).first()[0]  # one path, resolved as a caller would
    return scan.read(tree, content, first, 1, 20)


def resolve_lookup(spark, d):
    tree = _tree(spark, d)
    wanted = tree.where("kind = 1").select(F.col("serial").alias("ordinal"), F.when(F.col("serial") % 2 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"))
    return scan.lookup(tree, wanted)


def locate_first_path(spark, d):
    tree = _tree(spark, d)
    linked = tree.unionByName(tree.where("kind = 1 and serial % 3 = 0").withColumn("path", F.concat(F.lit("/aliases/"), "name")))
    return scan.locate(linked, tree.where("kind = 1").select("serial"))


def conflict_markers(spark, d):
    files = view(spark, d, "content_base").withColumn("text", F.when(F.length("text") % 3 == 0, F.concat(F.lit("<<<<<<< ours\n"), "text", F.lit("\n=======\nx\n>>>>>>> theirs\n"))).when(F.length("text") % 3 == 1, F.concat(F.lit(">>>>>>> theirs\n=======\n"), "text", F.lit("\n<<<<<<< ours"))).otherwise(F.col("text")))
    return scan.marked(files)


def valid_names(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").withColumn("name", F.element_at(F.split("url", "/"), -1))
    return p.select("page_id", paths.valid_name(F.col("name")).alias("file_name"), paths.valid_history_name(F.col("name")).alias("history_name"))


def hardlink_aliases(spark, d):
    """One canonical position for each (device, inode) of an import."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 4).alias("device"), F.col("l_partkey").alias("inode"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return e.groupBy("device", "inode").agg(F.min("position").alias("position"), (F.count("*") - 1).alias("aliases"))


def climb_paths(spark, d):
    return scan.climb(_tree(spark, d))


def _attributed(s, d):
    tree = _tree(s, d).where("kind = 1")
    own = view(s, d, "files_base").select((F.col("doc_id") + 1000).alias("serial"), F.explode(F.array(F.struct(F.lit("user").alias("domain"), F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("sys").alias("domain"), F.lit("source").alias("key"), F.col("source").alias("value")))).alias("a")).where("serial % 3 <> 0 or a.domain = 'sys'")
    return scan.with_attributes(tree, own.select("serial", "a.*"))


def read_windows(s, d):
    tree = _tree(s, d)
    demands = tree.where("kind = 1").select("path", (F.col("serial") % 3 + 1).cast("int").alias("start"), F.when(F.col("serial") % 2 == 0, 4).alias("end"))
    return scan.read_window(tree, view(s, d, "content_base"), demands, 5)


ANCHORED = "en/src?/**/doc-*1.txt"
QUERIES = {
    "walk_tree": (walk_tree, oracle("SELECT path, kind, serial, len(string_split(path, '/')) - 1 AS depth, CASE len(string_split(path, '/')) WHEN 2 THEN '/' WHEN 3 THEN '/|/en' ELSE '/|/en|' || parent_path END AS parents FROM tree_base WHERE path = '/en' OR starts_with(path, '/en/')")),
    "subtree_relative": (lambda s, d: scan.subtree(_tree(s, d), "/en").select("path", "relative"), oracle("SELECT path, CASE WHEN path = '/en' THEN '' ELSE substr(path, 5) END AS relative FROM tree_base WHERE path = '/en' OR starts_with(path, '/en/')")),
    "stat_path": (lambda s, d: scan.stat(_tree(s, d), "/en/src1/doc-1.txt").unionAll(scan.stat(_tree(s, d), "/en")).unionAll(scan.stat(_tree(s, d), "/absent")), oracle("SELECT path, CASE kind WHEN 1 THEN 'file' WHEN 2 THEN 'dir' END AS type, serial AS inode, size, mode FROM tree_base WHERE path IN ('/en/src1/doc-1.txt', '/en', '/absent')")),
    "list_dir": (lambda s, d: scan.list_directory(_tree(s, d), "/en").unionAll(scan.list_directory(_tree(s, d), "/en/src1")), oracle("SELECT name, path, CASE kind WHEN 1 THEN 'file' WHEN 2 THEN 'dir' END AS type, serial AS inode FROM tree_base WHERE parent_path IN ('/en', '/en/src1')")),
    "read_lines": (read_lines, oracle(f"SELECT t.path, l.n, l.line FROM {_LINES} JOIN (SELECT path, content_id FROM tree_base WHERE kind = 1 AND size > 200 ORDER BY serial LIMIT 1) t USING (content_id) WHERE l.n <= 20")),
    "read_windows": (read_windows, oracle("SELECT path, size, n AS lines, least(n, serial % 3 + 5, CASE WHEN serial % 2 = 0 THEN 4 ELSE n END) AS last, CASE WHEN least(n, serial % 3 + 5, CASE WHEN serial % 2 = 0 THEN 4 ELSE n END) < n THEN least(n, serial % 3 + 5, CASE WHEN serial % 2 = 0 THEN 4 ELSE n END) + 1 END AS next FROM (SELECT t.path, t.serial, t.size, CASE WHEN length(c.text) = 0 THEN 0 ELSE len(string_split(c.text, chr(10))) - CASE WHEN suffix(c.text, chr(10)) THEN 1 ELSE 0 END END AS n FROM tree_base t JOIN content_base c USING (content_id) WHERE t.kind = 1) x")),
    "glob_paths": (lambda s, d: scan.glob(_tree(s, d), "doc-*7.txt").select("path", "serial"), oracle(_glob_sql("doc-*7.txt", "tree_base", "path, serial"))),
    "glob_anchored": (lambda s, d: scan.glob(_tree(s, d), ANCHORED).select("path", "serial"), oracle(_glob_sql(ANCHORED, "tree_base", "path, serial"))),
    "glob_pages": (lambda s, d: scan.glob(_pages(s, d), "*.example.com/**/?[0-9]*").union(scan.glob(_pages(s, d), "/*.com/en/*")).select("path", "serial"), _glob_sql("*.example.com/**/?[0-9]*", _PAGES, "path, serial") + " UNION ALL " + _glob_sql("/*.com/en/*", _PAGES, "path, serial")),
    "rule_match_last_wins": (rule_match_last_wins, oracle(f"SELECT path, rule FROM (SELECT path, CASE {_WHEN} END AS rule FROM tree_base) r WHERE rule IS NOT NULL")),
    "grep_literal": (lambda s, d: scan.grep(_tree(s, d), view(s, d, "content_base"), "the", "/en"), oracle(f"SELECT t.path, l.n, substr(l.line, 1, 1024) AS line, length(l.line) > 1024 AS truncated FROM {_LINES} JOIN tree_base t USING (content_id) WHERE contains(l.line, 'the') AND starts_with(t.path, '/en/')")),
    "grep_skipped": (lambda s, d: scan.grep_skipped(_tree(s, d), view(s, d, "content_base").withColumn("text", F.when(F.col("length") % 5 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text")))), oracle("SELECT count(*) FILTER (WHERE size % 5 <> 0) AS searched, count(*) FILTER (WHERE size % 5 = 0) AS skipped FROM tree_base WHERE kind = 1")),
    "resolve_lookup": (resolve_lookup, oracle("SELECT serial AS ordinal, CASE WHEN serial % 2 = 0 THEN path || '.gone' ELSE path END AS path, CASE WHEN serial % 2 <> 0 THEN serial END AS serial, CASE WHEN serial % 2 <> 0 THEN kind END AS kind, CASE WHEN serial % 2 <> 0 THEN size END AS size FROM tree_base WHERE kind = 1")),
    "locate_first_path": (locate_first_path, oracle("SELECT serial, CASE WHEN serial % 3 = 0 THEN '/aliases/' || name ELSE path END AS path FROM tree_base WHERE kind = 1")),
    "conflict_markers": (conflict_markers, oracle("SELECT content_id FROM content_base WHERE length(text) % 3 = 0")),
    "valid_names": (valid_names, r"SELECT page_id, strlen(name) BETWEEN 1 AND 255 AND NOT contains(name, '\') AND name NOT IN ('.', '..') AS file_name, length(name) <= 63 AND regexp_matches(name, '^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$') AS history_name FROM (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages) p"),
    "hardlink_aliases": (hardlink_aliases, "SELECT l_suppkey % 4 AS device, l_partkey AS inode, min(l_orderkey * 10 + l_linenumber) AS position, count(*) - 1 AS aliases FROM lineitem GROUP BY ALL"),
    "attribute_keys": (lambda s, d: scan.attribute_keys(_attributed(s, d)).withColumn("keys", F.array_join("keys", ",")), oracle("SELECT path, CASE WHEN serial % 3 <> 0 THEN 'sys:source,user:lang' ELSE 'sys:source' END AS keys FROM tree_base WHERE kind = 1")),
    "read_attribute": (lambda s, d: scan.read_attribute(_attributed(s, d), "user", "lang"), oracle("SELECT path, CASE WHEN serial % 3 <> 0 THEN string_split(path, '/')[2] END AS value FROM tree_base WHERE kind = 1")),
    "read_link": (lambda s, d: scan.read_link(_tree(s, d).withColumn("kind", F.when((F.col("kind") == 1) & (F.col("serial") % 9 == 0), 3).otherwise(F.col("kind"))).withColumn("target", F.concat(F.lit("../"), "name"))), oracle("SELECT path, '../' || name AS target FROM tree_base WHERE kind = 1 AND serial % 9 = 0")),
    "climb_paths": (climb_paths, oracle("SELECT serial, path FROM tree_base")),
}
