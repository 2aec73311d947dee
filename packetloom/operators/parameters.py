"""Query strings and form bodies as rows, with the byte range of every raw value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import form_decode, octets


def _pairs(text: Column, base: Column) -> Column:
    """``array<struct>`` of the ``&``-separated pairs of one text; offsets are bytes from ``base``."""
    empty = F.array().cast(
        "array<struct<raw_name:string,raw_value:string,name_offset:int,value_offset:int>>"
    )
    start = F.struct(base.cast("int").alias("cursor"), empty.alias("pairs"))

    def step(state: Column, part: Column) -> Column:
        at = F.instr(part, "=")
        raw_name = F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part)
        raw_value = F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise(F.lit(""))
        skip = F.when(at > 0, octets(raw_name) + 1).otherwise(octets(part))
        pair = F.struct(
            raw_name.alias("raw_name"),
            raw_value.alias("raw_value"),
            state["cursor"].alias("name_offset"),
            (state["cursor"] + skip).cast("int").alias("value_offset"),
        )
        return F.struct(
            (state["cursor"] + octets(part) + 1).cast("int").alias("cursor"),
            F.concat(state["pairs"], F.array(pair)).alias("pairs"),
        )

    return F.aggregate(F.split(text, "&"), start, step)["pairs"]


def _explode(df: DataFrame, pairs: Column) -> DataFrame:
    rows = df.select("*", F.posexplode_outer(pairs).alias("ordinal", "pair"))
    return rows.select(
        *df.columns,
        "ordinal",
        form_decode(F.col("pair.raw_name")).alias("name"),
        form_decode(F.col("pair.raw_value")).alias("value"),
        F.col("pair.name_offset").alias("name_offset"),
        F.col("pair.value_offset").alias("value_offset"),
        octets(F.col("pair.raw_value")).alias("raw_length"),
    )


def query_parameters(df: DataFrame, uri: str = "uri") -> DataFrame:
    """Parameters after the first ``?`` and before the next ``#``; rows without ``?`` give none."""
    marked = df.where(F.contains(F.col(uri), F.lit("?")))
    mark = F.instr(F.col(uri), "?")
    tail = F.substring(F.col(uri), mark + 1, F.length(F.col(uri)))
    query = F.substring_index(tail, "#", 1)
    base = octets(F.substring(F.col(uri), F.lit(1), mark))
    return _explode(marked, _pairs(query, base))


def form_fields(df: DataFrame, body: str = "request_body") -> DataFrame:
    """Fields of a URL-encoded body in order; repeated names stay separate rows."""
    return _explode(df.where(F.col(body).isNotNull()), _pairs(F.col(body), F.lit(0)))


def target_key(method: Column, path: Column, name: Column) -> Column:
    return F.concat(method, F.lit(" "), path, F.lit("#"), F.lower(name))


def uri_path(uri: Column) -> Column:
    """Path of a relative or absolute URI."""
    bare = F.substring_index(F.substring_index(uri, "#", 1), "?", 1)
    return F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
