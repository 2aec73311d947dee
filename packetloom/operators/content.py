"""Content-addressed values, part headers and body completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern: name=value parameters of a disposition header, quoted or bare.
PARAMETER = '([A-Za-z0-9_-]+)\\s*=\\s*(?:"([^"]*)"|([^;\\s]+))'


def content_table(df: DataFrame, value: str, owner: str) -> DataFrame:
    """One row per distinct value with how often it occurs and its first owner.

    Copies collapse before the shuffle; which owner holds which hash stays in ``content_links``.  Readers that drop
    ``content`` move no text: the length is aggregated on its own.
    """
    return (
        df.where(F.col(value).isNotNull())
        .select(F.sha2(F.col(value).cast("binary"), 256).alias("content_hash"), F.col(owner).alias("owner"), F.col(value).alias("content"))
        .groupBy("content_hash")
        .agg(
            F.first("content").alias("content"),
            F.count(F.lit(1)).alias("copies"),
            F.min("owner").alias("first_owner"),
            F.max(F.octet_length("content")).cast("long").alias("byte_length"),
        )
    )


def content_links(df: DataFrame, value: str, owner: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(
        F.col(owner).alias("owner"), F.sha2(F.col(value).cast("binary"), 256).alias("content_hash")
    )


def _header_parameter(header: Column, name: str) -> Column:
    quoted = F.regexp_extract(header, f'(?i)(?:^|[;\\s]){name}\\s*=\\s*"([^"]*)"', 1)
    bare = F.regexp_extract(header, f"(?i)(?:^|[;\\s]){name}\\s*=\\s*([^\";\\s]+)", 1)
    return F.nullif(F.trim(F.when(quoted != "", quoted).otherwise(bare)), F.lit(""))


def explode_parts(df: DataFrame) -> DataFrame:
    """One row per part from two ``|``-joined header columns; the shorter side is filled with nulls."""

    def pieces(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
            F.split(F.col(name), "\\|")
        )

    zipped = F.arrays_zip(pieces("dispositions").alias("disposition"), pieces("media_types").alias("media_type"))
    filled = F.when(F.size(zipped) > 0, zipped).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("disposition"), F.lit(None).cast("string").alias("media_type")))
    )
    rest = [c for c in df.columns if c not in ("dispositions", "media_types")]
    rows = df.select(*rest, F.posexplode_outer(filled).alias("ordinal", "part"))
    disposition = F.col("part.disposition")
    return rows.select(
        *rest,
        "ordinal",
        F.nullif(disposition, F.lit("")).alias("disposition"),
        _header_parameter(disposition, "name").alias("field_name"),
        _header_parameter(disposition, "filename").alias("filename"),
        F.nullif(F.lower(F.trim("part.media_type")), F.lit("")).alias("declared_type"),
    )


def body_class(declared: Column, extracted: Column, limit_hit: Column) -> Column:
    """How complete an extracted body is, given the declared length."""
    return (
        F.when(limit_hit, "limit-truncated")
        .when((extracted == 0) & (declared == 0), "empty")
        .when((extracted == 0) & declared.isNull(), "absent")
        .when(extracted == 0, "missing")
        .when(declared.isNull() | (extracted == declared), "complete")
        .when(extracted < declared, "partial")
        .otherwise("length-mismatch")
    )


def classify_body(df: DataFrame, limit: int | None = None) -> DataFrame:
    hit = F.lit(False) if limit is None else F.col("extracted_length") >= limit
    return df.withColumn("body_status", body_class(F.col("declared_length"), F.col("extracted_length"), hit))


def trailing_ranges(ranges: DataFrame, parents: DataFrame) -> DataFrame:
    """Bytes of a parent before and after each accepted range, as ranges of their own.

    ``ranges(parent_id, start, end)`` and ``parents(parent_id, parent_length)``.
    """
    located = ranges.join(parents, "parent_id")
    sides = F.array(
        F.struct(F.lit("prefix-data").alias("kind"), F.lit(0).cast("long").alias("start"), F.col("start").cast("long").alias("end")),
        F.struct(F.lit("trailing-data").alias("kind"), F.col("end").cast("long").alias("start"), F.col("parent_length").cast("long").alias("end")),
    )
    return (
        located.select("parent_id", F.col("start").alias("range_start"), F.explode(sides).alias("side"))
        .select("parent_id", "range_start", "side.kind", "side.start", "side.end")
        .where("end > start")
        .withColumn("byte_length", F.col("end") - F.col("start"))
    )
