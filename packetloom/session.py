"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; pass more settings as keyword pairs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Most bytes of shuffled rows that adaptive execution puts into one task.  Rows of a few numbers compress about twentyfold.
PARTITION_BYTES = 8 << 20
#: Where there are fewer tasks than cores, adaptive execution merges only partitions smaller than this.
LEAST_BYTES = 64 << 10


def small_partitions(spark: SparkSession) -> None:
    """Keep merged shuffle partitions of narrow rows small in this session; a smaller setting of the user's own stays."""
    for name, most in (("advisoryPartitionSizeInBytes", PARTITION_BYTES), ("coalescePartitions.minPartitionSize", LEAST_BYTES)):
        name = f"spark.sql.adaptive.{name}"
        digits, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", spark.conf.get(name).lower()).groups()
        if int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > most:
            spark.conf.set(name, str(most))


def small_batches(spark: SparkSession, rows: int) -> None:
    """Keep Arrow batches of long values small in this session; a smaller setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if given <= 0 or given > rows:
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """Folder for data cut from its lineage: the one the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named, and only in local mode, where every task sees
    the same disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            current = tempfile.mkdtemp(prefix="packetloom-")
        context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written copy.

    Readers of the copy take only the columns they need and know its size.  The folder is the cluster's to
    clear, as with checkpoints.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
