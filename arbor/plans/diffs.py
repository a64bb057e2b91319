"""Queries over two trees and over three, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.functions import globs
from arbor.operators import diff, merge
from arbor.sources.adapter import oracle, view


def _t(s, d, side="base"):
    return view(s, d, f"tree_{side}")


def _texts(s, d):
    c = view(s, d, "content_base")
    for side in ("ours", "theirs"):
        c = c.unionAll(view(s, d, f"content_{side}"))
    return c.select("content_id", "text").distinct()


_J = "tree_base l FULL OUTER JOIN tree_ours r ON l.path = r.path"
_DIFF = f"""WITH j AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'Added' WHEN r.path IS NULL THEN 'Removed' ELSE 'Modified' END AS change,
    CASE coalesce(r.kind, l.kind) WHEN 1 THEN 'file' ELSE 'dir' END AS type, l.serial AS before, r.serial AS after, l.path IS NOT NULL AND r.path IS NOT NULL AS both_,
    l.content_id IS DISTINCT FROM r.content_id OR l.kind IS DISTINCT FROM r.kind AS c, l.serial IS DISTINCT FROM r.serial AS i, l.mode IS DISTINCT FROM r.mode OR l.mtime_s IS DISTINCT FROM r.mtime_s AS m FROM {_J}),
    d AS (SELECT path, change, type, before, after, both_ AND c AS content, both_ AND i AS identity, both_ AND m AS metadata FROM j WHERE NOT both_ OR c OR i OR m)
    """
RULES = [globs.rule(p) for p in ("/en/", "!doc-*0.txt", "/fr/src1*/*", "doc-?5.txt")]
UNITS = [("english", ["/en/src1/", "!doc-*7.txt"]), ("rest", ["/en/", "/fr/"]), ("never", ["/xx/"])]


def _rule_sql(path):
    return "CASE " + " ".join(f"WHEN regexp_matches(substr({path}, 2), '{r.regex(False)}') THEN {'NULL' if r.negated else repr(r.pattern)}" for r in reversed(RULES)) + " END"


def _three(on):
    cols = ", ".join(f"{x}.{c} AS {x}_{c}" for x in "bot" for c in ("path", "serial", "kind", "content_id", "mode", "mtime_s"))
    return f"(SELECT coalesce(b.{on}, o.{on}, t.{on}) AS k, {cols} FROM tree_base b FULL OUTER JOIN tree_ours o ON b.{on} = o.{on} FULL OUTER JOIN tree_theirs t ON coalesce(b.{on}, o.{on}) = t.{on}) s"


def _same_sql(a, b):
    return "(" + " AND ".join(f"s.{a}_{c} IS NOT DISTINCT FROM s.{b}_{c}" for c in ("kind", "content_id", "mode", "mtime_s")) + ")"


_DECIDE = f"""WITH p AS (SELECT s.*, {_rule_sql("s.k")} AS r FROM {_three("path")}),
    s2 AS (SELECT *, CASE WHEN {_same_sql("o", "t")} OR {_same_sql("b", "o")} THEN 'theirs' WHEN {_same_sql("b", "t")} THEN 'ours' WHEN r IS NOT NULL THEN 'lww'
      WHEN o_kind = 1 AND t_kind = 1 THEN 'text' WHEN o_kind IS NOT NULL AND t_kind IS NULL AND o_kind <> 2 THEN 'modify/delete' WHEN o_kind IS NULL AND t_kind IS NOT NULL AND t_kind <> 2 THEN 'delete/modify' ELSE 'type' END AS pick FROM p s)
    """


def _sides(s, d):
    """By path, with the time of the nearest directory that is left for what a side deleted."""
    sides = merge.three_way(_t(s, d), _t(s, d, "ours"), _t(s, d, "theirs"), "path")
    for x, side in (("o", "ours"), ("t", "theirs")):
        gone = merge.deletion_times(_t(s, d, side), sides.where(f"{x}_here is null").select("path"))
        sides = sides.join(gone.withColumnRenamed("time", f"{x}_gone"), "path", "left")
    return sides


def merge_decide(s, d):
    return merge.decide(_sides(s, d), RULES).select("path", "pick")


def merge_lww(s, d):
    out = merge.decide(_sides(s, d), RULES).where("pick = 'lww'")
    return out.select("path", "rule", "kept_ours", F.when(F.col("kept_ours"), F.col("o_here").isNull()).otherwise(F.col("t_here").isNull()).alias("deleted"))


def merge_conflicts(s, d):
    return merge.decide(_sides(s, d)).where("pick not in ('ours', 'theirs', 'lww')").groupBy("pick").agg(F.count("*").alias("paths"))


def merge_metadata(s, d):
    return merge.merge_metadata(merge.three_way(_t(s, d), _t(s, d, "ours").withColumn("mode", F.when((F.col("kind") == 1) & (F.col("serial") % 34 == 28), 384).otherwise(F.col("mode"))), _t(s, d, "theirs"))).select("serial", "mode", "mtime_s", "mode_conflict")


def _pairs(s, d):
    return diff.text_pairs(_t(s, d), _t(s, d, "ours"), view(s, d, "content_base"), view(s, d, "content_ours"))


def _merge_texts(s, d):
    w = {x: view(s, d, f"files_{n}").select("doc_id", F.col("text").alias(f"{x}_text")) for x, n in (("b", "base"), ("o", "ours"), ("t", "theirs"))}
    three = w["o"].join(w["t"], "doc_id").join(w["b"], "doc_id", "left").where("o_text <> t_text")
    return merge.merge_texts(three.select(F.col("doc_id").cast("string").alias("path"), "b_text", "o_text", "t_text"))


def merge_text(s, d):
    return _merge_texts(s, d).select("path", F.sha2("text", 256).alias("text_id"), F.size("hunks").alias("hunks"), "conflict")


def merge_trees(s, d):
    tree, conflicts = merge.merged_tree(_t(s, d), _t(s, d, "ours"), _t(s, d, "theirs"), _texts(s, d))
    return tree.where("kind = 1").join(conflicts, "path", "left").select("path", F.sha2("text", 256).alias("text_id"), "mode", "mtime_s", "mtime_ns", "conflict", F.sha2("marked", 256).alias("marked_id"))


def list_changes(s, d):
    live = view(s, d, "content_theirs").withColumn("text", F.when(F.col("text").startswith("THEIRS"), F.concat(F.lit("<<<<<<< a\n=======\n>>>>>>> b\n"), "text")).otherwise(F.col("text")))
    return diff.list_changes(_t(s, d), _t(s, d, "theirs"), live)


_HEADED = "SELECT doc_id, o.text AS o, t.text AS t, b.text AS b FROM files_ours o JOIN files_theirs t USING (doc_id) LEFT JOIN files_base b USING (doc_id) WHERE o.text <> t.text"
QUERIES = {
    "diff_trees": (lambda s, d: diff.diff_trees(_t(s, d), _t(s, d, "ours")), oracle(_DIFF + "SELECT * FROM d")),
    "diff_flags": (lambda s, d: diff.diff_flags(diff.diff_trees(_t(s, d), _t(s, d, "ours"))), oracle(_DIFF + "SELECT change, type, count(*) AS paths, count(*) FILTER (WHERE content) AS content, count(*) FILTER (WHERE identity) AS identity, count(*) FILTER (WHERE metadata) AS metadata FROM d GROUP BY change, type")),
    "root_changes": (lambda s, d: diff.root_changes(diff.diff_trees(_t(s, d), _t(s, d, "ours")), 50), oracle(_DIFF + "SELECT path, (SELECT count(*) FROM d) > 50 AS truncated FROM d ORDER BY string_split(path, '/') LIMIT 50")),
    "diff_inodes": (lambda s, d: diff.inode_changes(_t(s, d), _t(s, d, "theirs")), oracle("SELECT coalesce(l.serial, r.serial) AS serial, l.kind IS DISTINCT FROM r.kind OR l.content_id IS DISTINCT FROM r.content_id OR l.mode IS DISTINCT FROM r.mode OR l.mtime_s IS DISTINCT FROM r.mtime_s AS value, l.serial IS NULL OR r.serial IS NULL AS links FROM tree_base l FULL OUTER JOIN tree_theirs r ON l.serial = r.serial WHERE value OR links")),
    "diff_bindings": (lambda s, d: diff.binding_changes(_t(s, d), _t(s, d, "ours")), oracle(f"SELECT coalesce(l.parent_path, r.parent_path) AS parent_path, coalesce(l.name, r.name) AS name, l.serial AS before, r.serial AS after FROM {_J} WHERE l.serial IS DISTINCT FROM r.serial")),
    "new_bindings": (lambda s, d: diff.new_bindings(_t(s, d), _t(s, d, "ours")), oracle("SELECT parent_path, name, serial AS child FROM tree_ours WHERE path NOT IN (SELECT path FROM tree_base)")),
    "logical_size": (lambda s, d: diff.logical_size(_t(s, d, "ours")), oracle("SELECT sum(size) AS logical FROM tree_ours WHERE kind = 1")),
    "logical_size_incremental": (lambda s, d: diff.logical_change(_t(s, d), _t(s, d, "ours")).crossJoin(diff.logical_size(_t(s, d))).select((F.col("logical") + F.col("change")).alias("logical")), oracle("SELECT sum(size) AS logical FROM tree_ours WHERE kind = 1")),
    "workspace_changes": (lambda s, d: diff.diff_trees(_t(s, d), _t(s, d, "theirs")).groupBy().agg(*(F.count(F.when(F.col("change") == c, 1)).alias(c.lower()) for c in ("Added", "Modified", "Removed"))), oracle("SELECT count(*) FILTER (WHERE l.path IS NULL) AS added, count(*) FILTER (WHERE l.path = r.path AND (l.content_id IS DISTINCT FROM r.content_id OR l.mode <> r.mode OR l.mtime_s <> r.mtime_s)) AS modified, count(*) FILTER (WHERE r.path IS NULL) AS removed FROM tree_base l FULL OUTER JOIN tree_theirs r ON l.path = r.path")),
    "diff_files": (lambda s, d: diff.diff_files(_pairs(s, d)).select("path", "kind", F.size("hunks").alias("hunks"), F.array_join(F.flatten("hunks.added"), "|").alias("added"), F.array_join(F.flatten("hunks.removed"), "|").alias("removed")), oracle("SELECT l.path, 'Text' AS kind, 1 AS hunks, 'OURS' AS added, '' AS removed FROM tree_base l JOIN tree_ours r USING (path) WHERE l.kind = 1 AND l.content_id <> r.content_id")),
    "diff_lines": (lambda s, d: diff.diff_lines(_pairs(s, d)).groupBy("path", "op").agg(F.count("*").alias("lines")), oracle("SELECT '/' || b.lang || '/' || b.source || '/doc-' || CAST(b.doc_id AS STRING) || '.txt' AS path, u.op, u.n AS lines FROM files_base b JOIN files_ours o USING (doc_id), unnest([{'op': '+', 'n': 1}, {'op': '=', 'n': len(string_split(b.text, chr(10)))}]) AS x(u) WHERE b.text <> o.text")),
    "merge_decide": (merge_decide, oracle(_DECIDE + "SELECT k AS path, pick FROM s2")),
    "merge_conflicts": (merge_conflicts, oracle(_DECIDE.replace("WHEN r IS NOT NULL THEN 'lww'", "") + "SELECT pick, count(*) AS paths FROM s2 WHERE pick NOT IN ('ours', 'theirs') GROUP BY pick")),
    "merge_lww": (merge_lww, oracle(_DECIDE + "SELECT k AS path, r AS rule, coalesce(o_mtime_s, 0) >= coalesce(t_mtime_s, 0) AS kept_ours, CASE WHEN coalesce(o_mtime_s, 0) >= coalesce(t_mtime_s, 0) THEN o_kind IS NULL ELSE t_kind IS NULL END AS deleted FROM s2 WHERE pick = 'lww'")),
    "merge_metadata": (merge_metadata, oracle("""WITH o2 AS (SELECT * REPLACE (CASE WHEN kind = 1 AND serial % 34 = 28 THEN 384 ELSE mode END AS mode) FROM tree_ours)
        SELECT serial, CASE WHEN t.mode = b.mode THEN o.mode WHEN o.mode = b.mode THEN t.mode ELSE o.mode END AS mode, CASE WHEN t.mtime_s = b.mtime_s THEN o.mtime_s WHEN o.mtime_s = b.mtime_s THEN t.mtime_s ELSE o.mtime_s END AS mtime_s,
        t.mode <> b.mode AND o.mode <> b.mode AND t.mode <> o.mode AND o.kind <> 2 AS mode_conflict FROM tree_base b JOIN o2 o USING (serial) JOIN tree_theirs t USING (serial)""")),
    "merge_units": (lambda s, d: merge.unit_decisions(_t(s, d), _t(s, d, "ours"), _t(s, d, "theirs"), UNITS), oracle(f"""WITH u AS (SELECT s.*, CASE WHEN (s.k = '/en/src1' OR starts_with(s.k, '/en/src1/')) AND NOT regexp_matches(s.k, '/doc-[^/]*7[.]txt$') THEN 'english' WHEN regexp_matches(s.k, '^/(en|fr)(/.*)?$') THEN 'rest' END AS unit FROM {_three("path")})
        SELECT unit, count(*) FILTER (WHERE NOT {_same_sql("b", "o")}) AS ours_changed, count(*) FILTER (WHERE NOT {_same_sql("b", "t")}) AS theirs_changed,
        CASE WHEN count(*) FILTER (WHERE NOT {_same_sql("b", "o")}) > 0 AND count(*) FILTER (WHERE NOT {_same_sql("b", "t")}) > 0 THEN CASE WHEN max(o_mtime_s) FILTER (WHERE NOT {_same_sql("b", "o")}) >= max(t_mtime_s) FILTER (WHERE NOT {_same_sql("b", "t")}) THEN 'ours' ELSE 'theirs' END END AS kept FROM u s WHERE unit IS NOT NULL GROUP BY unit""")),
    "merge_text": (merge_text, oracle(f"""SELECT CAST(doc_id AS STRING) AS path, sha256(CASE WHEN b = o THEN t WHEN b = t THEN o ELSE '<<<<<<< ours' || chr(10) || 'OURS' || chr(10) || '=======' || chr(10) || 'THEIRS' || chr(10) || '>>>>>>> theirs' || chr(10) || b END) AS text_id,
        CASE WHEN b = o OR b = t THEN 0 ELSE 1 END AS hunks, CASE WHEN b <> o AND b <> t THEN 'content' END AS conflict FROM ({_HEADED}) h""")),
    "merge_trees": (merge_trees, oracle(f"""WITH s AS (SELECT *, k - 1000 AS doc_id FROM {_three("serial")} WHERE coalesce(b_kind, o_kind, t_kind) = 1),
        p AS (SELECT s.*, CASE WHEN {_same_sql("o", "t")} OR {_same_sql("b", "o")} THEN 'theirs' WHEN {_same_sql("b", "t")} THEN 'ours' WHEN o_kind = 1 AND t_kind = 1 THEN 'text' WHEN t_kind IS NULL THEN 'modify/delete' ELSE 'delete/modify' END AS pick, b.text AS bx, o.text AS ox, t.text AS tx
          FROM s LEFT JOIN files_base b USING (doc_id) LEFT JOIN files_ours o USING (doc_id) LEFT JOIN files_theirs t USING (doc_id)),
        q AS (SELECT *, b_kind IS NOT NULL AND o_kind IS NOT NULL AND t_kind IS NOT NULL AS every, pick = 'theirs' OR pick = 'delete/modify' AS theirs_, pick = 'text' AND ox <> tx AND bx <> ox AND bx <> tx AS clash FROM p),
        m AS (SELECT *, CASE WHEN clash THEN '<<<<<<< ours' || chr(10) || 'OURS' || chr(10) || '=======' || chr(10) || 'THEIRS' || chr(10) || '>>>>>>> theirs' || chr(10) || bx WHEN pick = 'text' THEN CASE WHEN bx = ox THEN tx ELSE ox END WHEN theirs_ THEN tx ELSE ox END AS text FROM q)
        SELECT coalesce(o_path, t_path) AS path, sha256(text) AS text_id, CASE WHEN every THEN CASE WHEN t_mode = b_mode THEN o_mode WHEN o_mode = b_mode THEN t_mode ELSE o_mode END WHEN theirs_ THEN t_mode ELSE o_mode END AS mode,
          CASE WHEN every THEN CASE WHEN t_mtime_s = b_mtime_s THEN o_mtime_s WHEN o_mtime_s = b_mtime_s THEN t_mtime_s ELSE o_mtime_s END WHEN theirs_ THEN t_mtime_s ELSE o_mtime_s END AS mtime_s, 0 AS mtime_ns,
          CASE WHEN clash THEN 'content' WHEN pick LIKE '%/%' THEN pick END AS conflict,
          sha256(CASE WHEN clash THEN text WHEN pick = 'modify/delete' THEN '<<<<<<< ours' || chr(10) || text || chr(10) || '=======' || chr(10) || '>>>>>>> theirs (deleted)' WHEN pick = 'delete/modify' THEN '<<<<<<< ours (deleted)' || chr(10) || '=======' || chr(10) || text || chr(10) || '>>>>>>> theirs' END) AS marked_id
        FROM m WHERE text IS NOT NULL""")),
    "list_changes": (list_changes, oracle("SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'Added' WHEN r.path IS NULL THEN 'Removed' ELSE 'Modified' END AS change, CASE coalesce(r.kind, l.kind) WHEN 1 THEN 'file' ELSE 'dir' END AS type, coalesce(starts_with(c.text, 'THEIRS'), false) AS markers FROM tree_base l FULL OUTER JOIN tree_theirs r ON l.path = r.path LEFT JOIN content_theirs c ON c.content_id = r.content_id WHERE l.path IS NULL OR r.path IS NULL OR l.content_id IS DISTINCT FROM r.content_id OR l.mode <> r.mode OR l.mtime_s <> r.mtime_s OR l.serial <> r.serial")),
}
