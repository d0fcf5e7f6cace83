"""Session defaults and the two ways this library cuts work: staged tables and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A side is broadcast only when its counted rows stay at or below this.
BROADCAST_ROWS = 200_000
# ... and their size, as JSON text, at or below this.
BROADCAST_BYTES = 64 << 20


def local_session(app: str = "plumbline", cores: str | int = "*") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: the cluster's checkpoint folder. A new local one only for a local master."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and stops several consumers from recomputing one plan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"{shared_folder(spark).rstrip('/').rsplit(':', 1)[-1].lstrip('/')}/plumbline/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows and bytes fit, else leave the join to shuffle.

    Call it on a staged or otherwise cheap table: the count is an action.
    """
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables below ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
