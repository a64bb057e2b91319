"""Live traces: files as they land, running calls, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.operators.trace import LINE, wanted


def tail(spark: SparkSession, path: str, project: str | None = None, since: str | None = None) -> DataFrame:
    """Calls of JSON-line files as they land below path: a stream. A poll that
    finds more of a file lands it as a new one."""
    return wanted(spark.readStream.schema(LINE).option("mode", "DROPMALFORMED").json(path), project, since)


def poll(held: DataFrame, files: DataFrame, first: bool, since: bool) -> tuple[DataFrame, DataFrame]:
    """One poll of growing files(file, text) against held(file, offset, rest),
    the bytes read so far and the partial line that they ended with. Gives the
    whole lines that are new (file, n, line, in the file's order) and what is held now.

    Without `since`, files that the first poll finds begin at their end; later
    ones at 0. A file shorter than its offset was cut, and begins at 0 again. A
    line that has no end yet is held until the rest of it comes."""
    size = F.octet_length("text").cast("long")
    j = files.join(held, "file", "left").withColumn("size", size)
    known = F.col("offset").isNotNull()
    begin = F.when(known, F.when(F.col("size") < F.col("offset"), 0).otherwise(F.col("offset"))).otherwise(F.col("size") if first and not since else F.lit(0))
    rest = F.when(known & (F.col("size") >= F.col("offset")), F.coalesce("rest", F.lit(""))).otherwise("")
    new = F.decode(F.substring(F.encode("text", "UTF-8"), (begin + 1).cast("int"), size.cast("int")), "UTF-8")
    j = j.select("file", "size", F.split(F.concat(rest, new), "\n", -1).alias("parts"))
    lines = j.select("file", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("n", "line"))
    return lines, j.select("file", F.col("size").alias("offset"), F.element_at("parts", -1).alias("rest"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table, a file or a folder, as a stream. Its name
    stands as a pattern, which the source takes for either."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def running_calls(calls: DataFrame) -> DataFrame:
    """Start and end of each call so far, of a stream of calls(id, phase, at)."""
    return calls.groupBy("id").agg(F.min(F.when(F.col("phase") == "start", F.col("at"))).alias("start"), F.max(F.when(F.col("phase") == "end", F.col("at"))).alias("end"))


def sampled(calls: DataFrame, every: str, late: str) -> DataFrame:
    """First, last and greatest value of each window of a stream of
    calls(start, id, value); windows end when the watermark has passed."""
    return calls.withWatermark("start", late).groupBy(F.window("start", every).alias("w")).agg(F.min_by("value", F.struct("start", "id")).alias("first"), F.max_by("value", F.struct("start", "id")).alias("last"), F.max("value").alias("most"), F.count("*").alias("samples"))


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now; each batch's rows land in out.
    With complete the last batch's table replaces the one before."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    else:
        q = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()


def changed(previous: str | None, model: DataFrame) -> tuple[bool, str]:
    """Whether a read model differs from the version that a poll last saw."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in model.columns]
    digest = model.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    now = f"{digest['n']}:{digest['s']}"
    return now != previous, now
