"""Spark session, code shipping and shared scratch storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _local_folder() -> str:
    """A folder that a local session, whose driver is its only executor, shares with itself."""
    folder = tempfile.mkdtemp(prefix="arbor-shared-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("arbor")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", _local_folder())
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of an Arrow batch: whole texts and sets are long rows, and a batch stands
#: in the JVM and in Python at once.
BATCH_ROWS = 250
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python
    tasks import it wherever they run, and keep Arrow batches small."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(size, None) or "").rstrip("b") == str(64 << 20):  # still Spark's own
        spark.conf.set(size, str(BATCH_BYTES))
    if getattr(sc, "_arbor_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arbor-")
    target = os.path.join(folder, "arbor-src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("arbor") / p.relative_to(root)))
    sc.addPyFile(target)
    sc._arbor_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only
    where it is unset, as in tests, a local folder takes its place."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_arbor_shared", None)
        if found is None:
            found = sc._arbor_shared = _local_folder()
            sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/arbor-{tag}-{uuid.uuid4().hex}"
    sc._arbor_scratch = [*getattr(sc, "_arbor_scratch", ()), path]
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this context; for when the results that
    read them have been used or written."""
    sc = spark.sparkContext
    for name in getattr(sc, "_arbor_tables", ()):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in getattr(sc, "_arbor_scratch", ()):
        _delete(sc, path)
    sc._arbor_scratch, sc._arbor_tables = [], []


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and place that Spark gives it: one without a
    scheme, such as /shared/x, lies on Spark's default file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def scratch_mark(spark: SparkSession) -> int:
    """The place in the list of scratch paths from which later ones stand."""
    return len(getattr(spark.sparkContext, "_arbor_scratch", ()))


def forget(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the scratch paths made after scratch_mark(), but those that the
    DataFrames kept read: steps whose rows have been used up."""
    sc = spark.sparkContext
    used = {f.rpartition("/arbor-")[2].partition("/")[0] for df in kept for f in df.inputFiles()}
    left = []
    for path in sc._arbor_scratch[since:]:
        if path.rpartition("/arbor-")[2] in used:
            left.append(path)
        else:
            _delete(sc, path)
    sc._arbor_scratch[since:] = left


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage, and a
    lost executor costs nothing that came before."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
