"""Session helpers: shared checkpoint folder, table access and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest build side, in rows, that is ever hinted for broadcasting.
BROADCAST_ROWS = 2_000_000
#: Largest build side, in bytes, and the part of the driver's heap that it may take: the driver holds a build side as rows, as
#: a hash table and in pieces to send, and several of them at a time.
BROADCAST_BYTES, HEAP_PART = 256 << 20, 16


def build_session(app: str = "strandloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session used by tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset, in local mode, a temporary one is set; a cluster
    must name a folder that all its machines share."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="strandloom-"))
    return at or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts lineage as ``cut`` does, and later readers take
    only the (nested) columns they need."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def driver_heap(spark: SparkSession) -> int:
    return int(spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory())


def broadcast_rows(spark: SparkSession, row_bytes: int) -> int:
    """Rows of ``row_bytes`` that a build side may have on this driver."""
    return min(BROADCAST_BYTES, driver_heap(spark) // HEAP_PART) // row_bytes


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether a table (scanned, checkpointed or stored, as it is counted) of ``row_bytes`` a row may be broadcast."""
    rows = broadcast_rows(df.sparkSession, row_bytes)
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint df for broadcasting only if it has at most ``limit`` rows; else leave the join to the planner (shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
