"""Tab-separated packet fields: read, write, and keep account of rows that do not parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.schemas import PROTOCOLS, REQUIRED

CORRUPT = "corrupt_record"
_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "header": "false", "multiLine": "false"}


def field_schema(protocol: str) -> T.StructType:
    return T.StructType(
        [*PROTOCOLS[protocol].fields, T.StructField(CORRUPT, T.StringType())]
    )


def read_fields(spark: SparkSession, path: str, protocol: str | T.StructType) -> DataFrame:
    """Typed rows of one protocol; a row with a wrong column count or type keeps its raw line."""
    schema = field_schema(protocol) if isinstance(protocol, str) else T.StructType(
        [*protocol.fields, T.StructField(CORRUPT, T.StringType())]
    )
    return (
        spark.read.schema(schema)
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **_OPTIONS)
        .csv(path)
    )


def write_fields(df: DataFrame, path: str) -> None:
    df.write.mode("error").options(**_OPTIONS).csv(path)


def split_malformed(df: DataFrame, required: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejected rows with the reason of each."""
    names = REQUIRED[required] if isinstance(required, str) else list(required)
    reason: Column = F.lit(None).cast("string")
    for name in reversed(names):
        absent = F.col(name).isNull()
        if dict(df.dtypes)[name] == "string":
            absent = absent | (F.col(name) == "")
        reason = F.when(absent, F.lit(f"missing-{name}")).otherwise(reason)
    if CORRUPT in df.columns:
        reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt-row")).otherwise(reason)
    marked = df.withColumn("reason", reason)
    good = marked.where("reason IS NULL").drop("reason", CORRUPT)
    return good, marked.where("reason IS NOT NULL")


def normalize_inventory(df: DataFrame) -> DataFrame:
    """One row per frame with chosen address family, transport, lengths and protocol labels."""
    tcp = F.col("tcp_stream").isNotNull()
    udp = F.col("udp_stream").isNotNull()

    def side(tcp_name: str, udp_name: str) -> Column:
        return F.when(tcp, F.col(tcp_name)).when(udp, F.col(udp_name))

    flag = {name: F.lower(F.col(name)).isin("1", "true") for name in ("tcp_syn", "tcp_ack")}
    return df.select(
        "frame_number",
        "time_epoch",
        F.col("time_epoch").cast("decimal(20,9)").alias("frame_time"),
        "frame_length",
        "captured_length",
        F.filter(F.split(F.lower("protocols"), ":"), lambda label: label != "").alias("labels"),
        F.when(tcp, "tcp").when(udp, "udp").alias("transport"),
        side("tcp_stream", "udp_stream").alias("stream_index"),
        address("ip_src", "ipv6_src").alias("source"),
        address("ip_dst", "ipv6_dst").alias("destination"),
        side("tcp_srcport", "udp_srcport").alias("source_port"),
        side("tcp_dstport", "udp_dstport").alias("destination_port"),
        F.when(tcp, F.col("tcp_len")).when(udp, F.greatest(F.col("udp_length") - 8, F.lit(0))).alias("payload_length"),
        flag["tcp_syn"].alias("syn"),
        flag["tcp_ack"].alias("ack"),
    )


def address(ipv4: str, ipv6: str) -> Column:
    return F.coalesce(F.nullif(F.col(ipv4), F.lit("")), F.nullif(F.col(ipv6), F.lit("")))


def http_kind() -> Column:
    """Request if the row has a method, response if it has a code, else null (a malformed row)."""
    return F.when(F.coalesce(F.col("method"), F.lit("")) != "", "request").when(
        F.col("response_code").isNotNull(), "response"
    )


def endpoint(host: Column, port: Column) -> Column:
    """``host:port``, the bare host when there is no port, empty when there is no host."""
    return F.when(host.isNull(), "").otherwise(F.concat_ws(":", host, port.cast("string")))


def direction(source: Column, source_port: Column, destination: Column, destination_port: Column) -> Column:
    return F.concat(endpoint(source, source_port), F.lit(">"), endpoint(destination, destination_port))


def hex_bytes(text: Column) -> Column:
    """Bytes of ``aa:bb:cc`` or ``aabbcc``; null when the text is not hexadecimal."""
    return F.try_to_binary(F.replace(text, F.lit(":"), F.lit("")), F.lit("hex"))
