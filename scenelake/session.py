"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings the operators rely on; memory and executor sizing belong to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: str | int = "*", app: str = "scenelake", **conf: str) -> SparkSession:
    """Session on this machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCENELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: How tables are written: texts and postings take about a third less than by default.
PACKED = {"compression": "zstd"}

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and interim tables: the one the cluster names in `spark.checkpoint.dir`,
    else, only when everything runs on this machine, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-scenelake-")
    return _LOCAL_FOLDERS[context.applicationId]


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; `clean_up` deletes it."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the interim and derived tables of this application. Call it when a job's results are written:
    what was read from them can't be computed again afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an interim result to the shared folder and go on from there.

    A lost executor then costs a re-read instead of recomputing every step before, and unlike an RDD
    checkpoint the rows are computed once.
    """
    path = f"{run_folder(df.sparkSession)}/interim-{uuid.uuid4().hex}"
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(
    df: DataFrame, path: str, order: tuple[str, ...] = (), by: tuple[str, ...] = (), as_read: bool = False
) -> DataFrame:
    """Write a table once, in evenly sized files, and read it back. With `as_read` a file holds what one task reads:
    rows made one by one from a large table need no shuffle.

    What is read back has known file sizes and column statistics, so later plans prune columns, push
    filters down and broadcast small tables on their own. With `order` files hold ranges of these columns, so
    filters on the leading ones leave out files and row groups. Finding ranges reads the rows twice; wide rows are dealt
    `by` a few values of the leading column instead, where large ones are spread over many files.
    """
    if as_read:
        dealt = df
    else:
        dealt = df.hint("rebalance", *by) if by or not order else df.repartitionByRange(*order)
    if order:
        dealt = dealt.sortWithinPartitions(*order)
    dealt.write.mode("errorifexists").options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
