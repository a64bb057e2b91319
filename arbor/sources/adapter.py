"""Versioned trees and their history derived from the star-schema test tables.

The views are SQL that Spark and DuckDB both read, so that an oracle starts
from the same rows; what is asked of them is written twice."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: text and content as the three sides of a merge have them
VIEWS = {
    "files_base": """SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, coalesce(text, '') AS text, 420 AS mode, doc_id AS mtime_s
        FROM documents WHERE doc_id % 10 <> 9""",
    "files_ours": """SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source,
        CASE WHEN doc_id % 10 <> 9 AND doc_id % 7 = 0 THEN 'OURS' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text, 420 AS mode,
        CASE WHEN doc_id % 10 <> 9 AND doc_id % 7 = 0 THEN doc_id + 1000 ELSE doc_id END AS mtime_s
        FROM documents WHERE doc_id % 11 <> 0""",
    "files_theirs": """SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source,
        CASE WHEN doc_id % 5 = 0 THEN 'THEIRS' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text,
        CASE WHEN doc_id % 17 = 0 THEN 493 ELSE 420 END AS mode, CASE WHEN doc_id % 5 = 0 THEN doc_id + 2000 ELSE doc_id END AS mtime_s
        FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 13 <> 0""",
    "dirs": """SELECT '/' AS path, '' AS parent_path, '' AS name, 4 * min(doc_id) + 10000000000 AS serial FROM documents HAVING count(*) > 0
        UNION ALL SELECT '/' || lang, '/', lang, 4 * min(doc_id) + 10000000001 FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang FROM documents) l GROUP BY lang
        UNION ALL SELECT '/' || lang || '/' || source, '/' || lang, source, 4 * min(doc_id) + 10000000002 FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source FROM documents) s GROUP BY lang, source""",
}
for _side in ("base", "ours", "theirs"):
    VIEWS[f"tree_{_side}"] = f"""SELECT '/' || lang || '/' || source || '/doc-' || CAST(doc_id AS STRING) || '.txt' AS path, '/' || lang || '/' || source AS parent_path,
        'doc-' || CAST(doc_id AS STRING) || '.txt' AS name, doc_id + 1000 AS serial, 1 AS kind, SHA(text) AS content_id, mode, mtime_s, 0 AS mtime_ns, BYTES(text) AS size FROM files_{_side}
        UNION ALL SELECT path, parent_path, name, serial, 2 AS kind, CAST(NULL AS STRING) AS content_id, 493 AS mode, CAST(0 AS BIGINT) AS mtime_s, 0 AS mtime_ns, CAST(0 AS BIGINT) AS size FROM dirs
        WHERE path IN (SELECT '/' FROM files_{_side} UNION ALL SELECT '/' || lang FROM files_{_side} UNION ALL SELECT '/' || lang || '/' || source FROM files_{_side})"""
    VIEWS[f"content_{_side}"] = f"SELECT DISTINCT SHA(text) AS content_id, text, BYTES(text) AS length FROM files_{_side}"
VIEWS |= {
    # a branch a conversation, a commit a turn; every third one merges its neighbour's, eight in a row at most
    "turns": "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, '12' || SHA(CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING)) AS id FROM conversations",
    "branch": "SELECT 'c' || CAST(conv_id AS STRING) AS branch, conv_id, max(n) AS last, count(*) AS commits FROM turns GROUP BY conv_id",
    "commit": """SELECT t.id, 'c' || CAST(t.conv_id AS STRING) AS branch, t.conv_id, t.n AS depth, p.id AS parent, CASE WHEN t.n % 3 = 2 AND t.conv_id % 8 <> 0 THEN o.id END AS second_parent, t.role AS message,
        BYTES(t.text) AS logical, BYTES(t.text) % 97 AS new_canonical, BYTES(t.text) % 31 AS new_stored, BYTES(t.text) % 7 AS new_metadata, t.conv_id * 1000 + t.n AS created_ms
        FROM turns t LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.n = t.n - 1 LEFT JOIN turns o ON o.conv_id = t.conv_id - 1 AND o.n = t.n""",
    # each third conversation publishes its last commit; layers are a chain
    "layer": """SELECT id, lag(id) OVER (ORDER BY conv_id) AS parent, row_number() OVER (ORDER BY conv_id) AS height, source_commit, conv_id, logical FROM (
        SELECT '32' || SHA('layer' || CAST(c.conv_id AS STRING)) AS id, c.id AS source_commit, c.conv_id, c.logical FROM commit c JOIN branch b ON b.conv_id = c.conv_id AND b.last = c.depth WHERE c.conv_id % 3 = 0) p""",
    "edge": "SELECT id AS child, parent FROM commit WHERE parent IS NOT NULL UNION ALL SELECT id, second_parent FROM commit WHERE second_parent IS NOT NULL",
    # /chat.txt as each commit has it
    "chat": "SELECT t.conv_id, t.n, t.id, JOINED(t.conv_id, t.n) AS text FROM turns t",
    "object_location": "SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS object_id, l_orderkey AS pack, l_linenumber AS slot, CAST(l_quantity AS BIGINT) AS length FROM lineitem",
    "pack": "SELECT o_orderkey AS pack, o_orderstatus AS state, CAST(floor(o_totalprice) AS BIGINT) AS stored FROM orders",
    "trace": "SELECT event_id AS id, user_id AS actor, event_type AS method, ts AS start, value AS ms, props AS args FROM events",
}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_CHAT = {
    "spark": "array_join(transform(sort_array(collect_list(struct(u.n, u.text))), x -> x.text), chr(10))",
    "duckdb": "string_agg(u.text, chr(10) ORDER BY u.n)",
}


def _dialect(sql: str, name: str) -> str:
    spark = name == "spark"
    sql = re.sub(r"SHA\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)" if spark else r"sha256(\1)", sql)
    sql = re.sub(r"BYTES\(([\w.]+)\)", r"CAST(octet_length(\1) AS BIGINT)" if spark else r"CAST(strlen(\1) AS BIGINT)", sql)
    if "JOINED(" in sql:
        sql = f"SELECT t.conv_id, t.n, t.id, {_CHAT[name]} AS text FROM turns t JOIN turns u ON u.conv_id = t.conv_id AND u.n <= t.n GROUP BY t.conv_id, t.n, t.id"
    return sql


def _wanted(text: str) -> list[str]:
    """The views that text names, each after those that it needs."""
    order: list[str] = []

    def visit(name):
        if name not in order:
            for v in VIEWS:
                if v != name and re.search(rf"\b{v}\b", VIEWS[name]):
                    visit(v)
            order.append(name)

    for v in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b|\b{v}\b", text):
            visit(v)
    return order


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    parts = [(v, _dialect(VIEWS[v], "spark")) for v in _wanted(name)]
    body = ", ".join(f"{v} AS ({sql})" for v, sql in parts)
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", body)]
    body = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", lambda m: f"{m[1]} {{{m[2]}}}", body)
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """DuckDB SQL over the views that sql names; RECURSIVE where it says so."""
    recursive = "RECURSIVE " if sql.startswith("RECURSIVE ") else ""
    sql = sql.removeprefix("RECURSIVE ").strip()
    parts = [f'{v} AS ({_dialect(VIEWS[v], "duckdb")})' for v in _wanted(sql)]
    if sql.startswith("WITH "):
        return f"WITH {recursive}" + ", ".join(parts + [sql.removeprefix("WITH ")])
    return (f"WITH {recursive}" + ", ".join(parts) + " " if parts else "") + sql
