"""An uncommitted layer over a snapshot: generations of rows, newest wins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective(entries: DataFrame, keys: list[str], top: int, installed: int = -1) -> DataFrame:
    """The newest row of each key of a generation above installed, up to top."""
    rest = [c for c in entries.columns if c not in keys]
    live = entries.where(F.col("generation").between(installed + 1, top))
    return live.groupBy(*keys).agg(F.max_by(F.struct(*rest), "generation").alias("e")).select(*keys, "e.*")


def listing(base: DataFrame, entries: DataFrame, top: int, installed: int = -1) -> DataFrame:
    """parent_path, name and inode as the overlay shows them: a null inode
    hides the name, what the overlay does not name is the base's."""
    own = effective(entries, ["parent_path", "name"], top, installed).select("parent_path", "name", F.col("inode").alias("o"), F.lit(True).alias("named"))
    j = base.select("parent_path", "name", F.col("serial").alias("b")).join(own, ["parent_path", "name"], "full_outer")
    return j.withColumn("inode", F.when(F.col("named"), F.col("o")).otherwise(F.col("b"))).where("inode is not null").select("parent_path", "name", "inode")


def file_bytes(base: DataFrame, pieces: DataFrame) -> DataFrame:
    """file and bytes of base(file, bytes) under pieces(file, generation, offset,
    data, truncate): in the order of generations each writes data at offset, or
    cuts the file, gaps being zeros."""
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"file": [], "bytes": []})
        raw = bytearray(left["bytes"].iloc[0])
        for _, at, data, cut in sorted(zip(right["generation"], right["offset"], right["data"], right["truncate"]), key=lambda p: p[0]):
            if not pd.isna(cut):
                cut = int(cut)
                raw = raw[:cut] + bytes(max(0, cut - len(raw)))
            if data is not None:
                at = int(at)
                raw += bytes(max(0, at - len(raw)))
                raw[at : at + len(data)] = data
        return pd.DataFrame({"file": [key[0]], "bytes": [bytes(raw)]})

    return base.groupBy("file").cogroup(pieces.groupBy("file")).applyInPandas(run, "file long, bytes binary")


def final_changes(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the last change alone, never the ones before it."""
    return effective(log.withColumnRenamed("seq", "generation"), keys, 2**62).withColumnRenamed("generation", "seq")


def accounting(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("bytes"))


def dirty(base: DataFrame, entries: DataFrame, top: int) -> DataFrame:
    """Whether the overlay shows anything but the base, name for name."""
    shown = listing(base, entries, top)
    was = base.select("parent_path", "name", F.col("serial").alias("inode"))
    moved = shown.exceptAll(was).unionAll(was.exceptAll(shown))
    return moved.agg((F.count("*") > 0).alias("dirty"), F.count("*").alias("differences"))


def digests(writes: DataFrame, files: DataFrame) -> DataFrame:
    """file and digest of append-only writes; stale where the file's sequence
    has moved since."""
    return writes.join(files.select("file", F.col("sequence").alias("now")), "file").select("file", F.sha2("data", 256).alias("digest"), (F.col("sequence") != F.col("now")).alias("stale"))
