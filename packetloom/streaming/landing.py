"""Land packet-field exports as they arrive, with the same accounting as the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from packetloom.sources.fields import CORRUPT, field_schema, split_malformed


def read_new_fields(spark: SparkSession, folder: str, protocol: str) -> DataFrame:
    """Stream of typed rows from the files that appear in a folder."""
    return (
        spark.readStream.schema(field_schema(protocol))
        .options(sep="\t", quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .csv(folder)
    )


def land_fields(spark: SparkSession, folder: str, protocol: str, target: str, state: str) -> StreamingQuery:
    """Write usable rows to ``target/rows`` and rejected ones, with reasons, to ``target/rejected``.

    Each run takes the files that no earlier run has taken and then ends.  A batch is written under its own
    number and replaces what an interrupted attempt at it left, so a repeated run adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_malformed(batch, protocol)
        good.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        bad.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    return (
        read_new_fields(spark, folder, protocol)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
