"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """The session of tests and benchmarks: UTC, adaptive plans, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleaner")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder as Parquet and read back.

    Cuts the lineage: a lost executor costs no recomputation of what lies
    before, and the planner sees the true size of what it reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored(), once nothing that is still to be computed reads them."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of new shuffle files upon which the driver collects its garbage.
RELEASE_BYTES = 32_000_000
_released: dict[str, int] = {}


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of finished jobs.

    Spark does this by itself only when the driver's heap fills; what a written
    table no longer needs would stay on the executors' disks until then.  Nothing
    is done until jobs have written RELEASE_BYTES since the last time.
    """
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    written = sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))
    name = spark.sparkContext.applicationId
    if written - _released.get(name, 0) >= RELEASE_BYTES:
        _released[name] = written
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most this many rows, so that long texts fit in a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
