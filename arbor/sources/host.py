"""Import of a host folder as a tree and its contents."""

from __future__ import annotations

import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, parent_path string, name string, kind int, mode int, mtime_s long, mtime_ns int, size long, device long, inode long, target string"


def entries(folder: str):
    """Every entry below a folder, hidden ones too; links are not followed."""
    todo = [("/", folder)]
    while todo:
        path, real = todo.pop()
        s = os.lstat(real)
        kind = 2 if stat.S_ISDIR(s.st_mode) else 3 if stat.S_ISLNK(s.st_mode) else 1
        if kind == 1 and not stat.S_ISREG(s.st_mode):
            continue
        up, _, name = path.rpartition("/")
        target = os.readlink(real) if kind == 3 else None
        mode = 0o777 if kind == 3 else s.st_mode & (0o1777 if kind == 2 else 0o777)
        size = {1: s.st_size, 2: 0, 3: len(os.fsencode(target or ""))}[kind]
        yield path, "" if path == "/" else up or "/", name, kind, mode, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, size, s.st_dev, s.st_ino, target
        if kind == 2:
            todo += [(f"{path.rstrip('/')}/{e.name}", e.path) for e in os.scandir(real)]


def import_tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """tree and content of a folder that driver and executors both see. The
    driver lists names and metadata; the bytes are read in tasks, those of hard
    links once. A serial is the place of the entry's first path, links share it."""
    listed = spark.createDataFrame(list(entries(folder)), ENTRY)
    linked = F.when(F.col("kind") == 1, F.struct("device", "inode")).otherwise(F.struct(F.lit(-1).cast("long").alias("device"), F.xxhash64("path").alias("inode")))
    keyed = listed.withColumn("key", linked)
    first = keyed.groupBy("key").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), F.split("path", "/"))).alias("first"))
    keyed = keyed.join(first, "key")

    def read(batches):
        for b in batches:
            raw = []
            for p in b["first"]:
                with open(folder + p, "rb") as f:
                    raw.append(f.read())
            yield pd.DataFrame({"first": b["first"], "bytes": raw})

    files = keyed.where("kind = 1 and path = first").select("first").repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "first string, bytes binary")
    read_once = files.withColumn("content_id", F.sha2("bytes", 256))
    tree = keyed.join(read_once.select("first", "content_id"), "first", "left").withColumn("serial", F.abs(F.xxhash64("first")))
    content = read_once.groupBy("content_id").agg(F.first("bytes").alias("bytes")).withColumn("length", F.octet_length("bytes").cast("long"))
    return tree.select("path", "parent_path", "name", "serial", "kind", "content_id", "mode", "mtime_s", "mtime_ns", "size", "target"), content


def readable(content: DataFrame) -> DataFrame:
    """content with is_text and the text of what is UTF-8 without a NUL."""
    text = F.is_valid_utf8(F.col("bytes").cast("string")) & ~F.contains("bytes", F.lit(b"\0"))
    return content.withColumn("is_text", text).withColumn("text", F.when(text, F.col("bytes").cast("string")))
