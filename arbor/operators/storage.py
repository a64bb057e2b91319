"""Objects, packs, deduplication, chunks, similarity and accounting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import chunking
from arbor.session import ship, written


def locate(ids: DataFrame, locations: DataFrame, packs: DataFrame) -> DataFrame:
    """Where each distinct demanded object lies."""
    return locations.join(ids.select("object_id").distinct(), "object_id", "left_semi").join(packs, "pack").select("object_id", "pack", "slot", "length", "state")


def missing(references: DataFrame, objects: DataFrame, on: str) -> DataFrame:
    """References to objects that are not there."""
    return references.join(objects.select(on).distinct(), on, "left_anti")


def publish(saved: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows that a save adds: objects not stored yet, once each. An id that
    is stored with another length is a collision, and refused by the caller."""
    return saved.dropDuplicates(["object_id"]).join(stored.select("object_id"), "object_id", "left_anti")


def collisions(saved: DataFrame, stored: DataFrame) -> DataFrame:
    return saved.join(stored.select("object_id", F.col("length").alias("was")), "object_id").where("length <> was").select("object_id", "length", "was")


def dedup(saves: DataFrame) -> DataFrame:
    """For each save, in the order of seq, of saves(save, seq, object_id,
    length): objects, those seen first there, and their bytes."""
    first = saves.groupBy("object_id").agg(F.min(F.struct("seq", "save")).alias("f"), F.first("length").alias("length"))
    new = first.groupBy(F.col("f.save").alias("save")).agg(F.count("*").alias("new_objects"), F.sum("length").alias("new_bytes"))
    told = saves.groupBy("save").agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))
    out = told.join(new, "save", "left").select("save", "objects", "bytes", F.coalesce("new_objects", F.lit(0)).alias("new_objects"), F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"))
    return out.withColumn("reused", F.col("objects") - F.col("new_objects"))


def ratio(a, b):
    """Six decimals, null over zero."""
    return F.when(b == 0, None).otherwise(F.format_string("%.6f", a / b))


def store_statistics(commits: DataFrame, layers: DataFrame) -> DataFrame:
    """Sums over commits, logical over layers too, and their ratios."""
    c = commits.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("logical", "new_canonical", "new_stored", "new_metadata")))
    lay = layers.agg(F.coalesce(F.sum("logical"), F.lit(0)).alias("layered"))
    both = c.crossJoin(lay).withColumn("logical", F.col("logical") + F.col("layered"))  # one row each
    return both.select("logical", F.col("new_canonical").alias("canonical"), F.col("new_stored").alias("stored"), F.col("new_metadata").alias("metadata"), ratio(F.col("logical"), F.col("new_canonical")).alias("dedupe"), ratio(F.col("new_canonical"), F.col("new_stored")).alias("compression"))


def digest_reuse(seen: DataFrame) -> DataFrame:
    """(digest, length) and the root that was recorded last."""
    return seen.groupBy("digest", "length").agg(F.max_by("root", "seq").alias("root"), F.count("*").alias("times"))


CHUNK = "array<struct<seq:int,offset:long,length:long,chunk_id:string,repeat:int>>"


def chunk_manifest(content: DataFrame) -> DataFrame:
    """content_id and the chunks of its bytes."""
    ship(content.sparkSession)

    @F.pandas_udf(CHUNK)
    def cut(raw: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("seq", "offset", "length", "chunk_id", "repeat"), c)) for c in chunking.chunks(bytes(x))] for x in raw])

    return content.select("content_id", F.inline(cut("bytes")))


def chunk_dedup(manifest: DataFrame) -> DataFrame:
    """Bytes as chunked, and as stored once a chunk."""
    once = manifest.groupBy("chunk_id").agg(F.first("length").alias("length"), F.sum("repeat").alias("uses"))
    return once.agg(F.count("*").alias("chunks"), F.sum(F.col("length") * F.col("uses")).alias("logical"), F.sum("length").alias("stored"), F.max("length").alias("longest"))


def extent_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """content_id, offset and length of the bytes that differ between two
    manifests(content_id, offset, length, chunk_id): extents that both have at
    one place are shared and never read; those of one side alone are told by side."""
    keys = ["content_id", "offset", "length", "chunk_id"]
    a = left.join(right, keys, "left_anti").select(*keys, F.lit("left").alias("side"))
    return a.unionAll(right.join(left, keys, "left_anti").select(*keys, F.lit("right").alias("side")))


def edited_manifest(manifest: DataFrame, edits: DataFrame, cut: int) -> DataFrame:
    """manifest(content_id, offset, length, chunk_id) after edits(content_id, at,
    removed, data), at most one of a content: extents wholly before or behind the
    edit stay, those behind shifted; the ends of extents that it cuts and its own
    bytes, in pieces of at most `cut`, are new, named by place (their bytes are to
    be read, which those of the others are not)."""
    e = edits.select("content_id", "at", "removed", F.octet_length("data").cast("long").alias("n"), F.sha2("data", 256).alias("named"))
    j = manifest.join(e, "content_id", "left")
    end, stop, shift = F.col("offset") + F.col("length"), F.col("at") + F.col("removed"), F.col("n") - F.col("removed")
    before = j.where(F.col("at").isNull() | (end <= F.col("at"))).select("content_id", "offset", "length", "chunk_id", F.lit(True).alias("reused"))
    behind = j.where(F.col("offset") >= stop).where(end > F.col("at")).select("content_id", (F.col("offset") + shift).alias("offset"), "length", "chunk_id", F.lit(True).alias("reused"))
    head = j.where((F.col("offset") < F.col("at")) & (end > F.col("at"))).select("content_id", "offset", (F.col("at") - F.col("offset")).alias("length"), F.concat_ws(":", "chunk_id", F.lit("0")).alias("chunk_id"), F.lit(False).alias("reused"))
    tail = j.where((F.col("offset") < stop) & (end > stop)).select("content_id", (stop + shift).alias("offset"), (end - stop).alias("length"), F.concat_ws(":", "chunk_id", (stop - F.col("offset")).cast("string")).alias("chunk_id"), F.lit(False).alias("reused"))
    piece = e.where("n > 0").select("content_id", "at", "n", "named", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(cut).cast("long"))).alias("k"))
    own = piece.select("content_id", (F.col("at") + F.col("k")).alias("offset"), F.least(F.lit(cut).cast("long"), F.col("n") - F.col("k")).alias("length"), F.concat_ws(":", "named", F.col("k").cast("string")).alias("chunk_id"), F.lit(False).alias("reused"))
    return before.unionAll(behind).unionAll(head).unionAll(tail).unionAll(own)


def covering(manifest: DataFrame, wanted: DataFrame, by: str, step: int = 1 << 20) -> DataFrame:
    """wanted(by, at) with the piece of manifest(by, offset, length, ...) that
    holds byte `at`: an equi join on `by` and the step of the axis, of which a
    piece has as many as it lies on; the range within it."""
    cells = manifest.where("length > 0").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("offset") / step), F.floor((F.col("offset") + F.col("length") - 1) / step))))
    return wanted.withColumn("_cell", F.floor(F.col("at") / step)).join(cells, [by, "_cell"]).where("offset <= at and at < offset + length").drop("_cell")


def similar(content: DataFrame, least: int = 2) -> DataFrame:
    """content_id, the earlier content (by its id) of most shared signature
    hashes, ties to the smaller id, and how many; at least `least`. A proposal
    only, which the bytes decide. content may repeat an id, with the same bytes.

    No pairs are made. Of each set of hashes that a signature holds, the least
    content that holds it, too, is told; the largest set whose least content is
    an earlier one tells both. A hash of one signature alone is in no such set.
    Contents with equal signatures are one kind, known by its least content;
    every one of them is told its own earlier content."""
    ship(content.sparkSession)

    @F.pandas_udf("array<long>")
    def sign(raw: pd.Series) -> pd.Series:
        return pd.Series([chunking.signature(bytes(x)) for x in raw])

    signed = content.select("content_id", sign("bytes").alias("sig")).groupBy("content_id").agg(F.first("sig").alias("sig"))
    signed = written(signed.where(F.size("sig") >= least), "signatures")
    # numbers in the order of the ids stand for them
    kinds = signed.groupBy("sig").agg(F.min("content_id").alias("content_id"), F.count("*").alias("times")).orderBy("content_id")
    kinds = written(kinds.withColumn("no", F.monotonically_increasing_id()), "kinds")
    at = kinds.select("no", F.explode("sig").alias("h"))
    common = at.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # a hash has 32 bits
    held = at.join(common, "h", "left_semi").groupBy("no").agg(F.sort_array(F.collect_list((F.col("h") - F.lit(1 << 31)).cast("int"))).alias("held"))
    held = written(held.where(F.size("held") >= least), "common")
    every = F.aggregate("held", F.array(F.array().cast("array<int>")), lambda a, h: F.concat(a, F.transform(a, lambda x: F.concat(x, F.array(h)))))
    sets = held.select("no", F.explode(F.filter(every, lambda x: F.size(x) >= least)).alias("part"))
    first = sets.groupBy("part").agg(F.min("no").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = sets.join(first, "part").where("first < no").groupBy("no").agg(F.min(F.struct((-F.size("part")).alias("less"), "first")).alias("best"))
    named = kinds.select(F.col("no").alias("first"), F.col("content_id").alias("candidate"))
    found = found.select("no", (-F.col("best.less")).cast("long").alias("shared"), F.col("best.first").alias("first")).join(named, "first").drop("first")
    told = written(kinds.join(found, "no", "left").select("content_id", "sig", "times", "shared", "candidate"), "similar")
    # another content of a kind shares all with its least one, if not with one before that
    again = signed.join(told.where("times > 1").select("sig", F.col("content_id").alias("least"), "shared", "candidate"), "sig").where("content_id <> least")
    size = F.size("sig").cast("long")
    again = again.select("content_id", size.alias("shared"), F.when(F.col("shared") == size, F.col("candidate")).otherwise(F.col("least")).alias("candidate"))
    return told.where("shared is not null").select("content_id", "shared", "candidate").unionByName(again)


def qualify(inodes: DataFrame, bindings: DataFrame, root: int) -> DataFrame:
    """What is wrong with a root: bindings to no inode or to the root, a
    directory bound twice, an inode bound more or less often than its links."""
    lost = bindings.join(inodes, F.col("child") == F.col("serial"), "left_anti").select("child", F.lit("missing").alias("fault"))
    rooted = bindings.where(F.col("child") == root).select("child", F.lit("root bound").alias("fault"))
    count = bindings.groupBy("child").agg(F.count("*").alias("bound"))
    told = inodes.where(F.col("serial") != root).join(count, F.col("serial") == F.col("child"), "left")
    alias = told.where("kind = 2 and bound > 1").select(F.col("serial").alias("child"), F.lit("directory bound twice").alias("fault"))
    links = told.where("coalesce(bound, 0) <> nlink").select(F.col("serial").alias("child"), F.lit("links").alias("fault"))
    return lost.unionAll(rooted).unionAll(alias).unionAll(links)


def running_peaks(events: DataFrame, by: str) -> DataFrame:
    """What each operation held at its end and at most, from signed changes."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("held", F.sum("change").over(w))
    return held.groupBy(by).agg(F.max_by("held", "seq").alias("held"), F.greatest(F.max("held"), F.lit(0)).alias("peak"), F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0)).alias("removed"))
