"""Column helpers for text, bytes and ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_SEPARATOR = "\x1f"


def stable_id(namespace: str, *parts: Column) -> Column:
    """Deterministic id: hash of a namespace and the parts, nulls kept apart from empty text."""
    texts = [F.coalesce(part.cast("string"), F.lit("\x00")) for part in parts]
    return F.sha2(F.concat_ws(ID_SEPARATOR, F.lit(namespace), *texts), 256)


def octets(text: Column) -> Column:
    return F.octet_length(text)


def form_decode(text: Column) -> Column:
    """Percent-decode with ``+`` as a blank: every valid escape is decoded, a percent sign without two hex digits stays."""
    stray = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(stray), F.translate(text, "+", " "))


def bounded_preview(text: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes that ends on a whole character."""
    raw = F.encode(text, "UTF-8")
    # A cut inside a character leaves at most three bytes of it; the shorter cuts drop them.
    cuts = [F.substring(raw, 1, max(0, max_bytes - back)).cast("string") for back in range(4)]
    whole = F.coalesce(*[F.try_validate_utf8(piece) for piece in cuts])
    return F.when(octets(text) <= max_bytes, text).otherwise(whole)


def escaped_preview(data: Column) -> Column:
    """Bytes as visible text: printable ASCII as it is, tab, line feed, return and backslash as escapes,
    every other byte as ``\\xNN``."""
    # Bytes with an escape of their own.
    named = {9: "\\t", 10: "\\n", 13: "\\r", 92: "\\\\"}

    def shown(pair: Column) -> Column:
        code = F.conv(pair, 16, 10).cast("int")
        text = F.when(code.between(32, 126), F.char(code)).otherwise(F.concat(F.lit("\\x"), F.lower(pair)))
        for value, escape in named.items():
            text = F.when(code == value, escape).otherwise(text)
        return text

    return F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), shown), "")


HITS = "array<struct<offset:int,value:string>>"


def _walk(between: Column, values: Column) -> Column:
    """Offsets of matches from the pieces between them, walked in step."""
    empty = F.array().cast(HITS)
    start = F.struct(F.lit(0).alias("cursor"), empty.alias("hits"))

    def step(state: Column, item: Column) -> Column:
        offset = state["cursor"] + octets(item["gap"])
        hit = F.struct(offset.cast("int").alias("offset"), item["value"].alias("value"))
        return F.struct(
            (offset + octets(item["value"])).cast("int").alias("cursor"),
            F.concat(state["hits"], F.array(hit)).alias("hits"),
        )

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
    return F.when(F.size(values) > 0, F.aggregate(pairs, start, step)["hits"]).otherwise(empty)


def with_matches(df: DataFrame, patterns: Mapping[str, str], text: str, needs: Mapping[str, str] | None = None) -> DataFrame:
    """Add one array of ``struct<offset, value>`` per pattern, with byte offsets; rows without any match
    are dropped.

    Matches and the text between them are columns of their own.  The texts that hold a match of any pattern are searched for
    all of them and split where one is found, the others are only tested.  ``needs`` names, for some patterns, a literal that
    all their matches hold: texts without it are not searched at all.  All of it stays in the JVM.
    """
    text_column, literals = F.col(text), needs or {}

    def may(name: str) -> Column:
        return F.contains(text_column, F.lit(literals[name])) if name in literals else F.lit(True)

    some = F.lit(False)
    for name, pattern in patterns.items():
        some = some | (may(name) & F.rlike(text_column, F.lit(pattern)))
    none = F.array().cast("array<string>")
    found = df.where(some).select(
        "*",
        *[F.when(may(name), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"__v_{name}")
          for name, pattern in patterns.items()],
    )
    found = found.select(
        "*", *[F.when(F.size(f"__v_{name}") > 0, F.split(text, pattern, -1)).alias(f"__g_{name}") for name, pattern in patterns.items()]
    )
    return found.select(
        *df.columns, *[_walk(F.col(f"__g_{name}"), F.col(f"__v_{name}")).alias(name) for name in patterns]
    )


def each(df: DataFrame, keep: Sequence[str], items: Column, name: str) -> DataFrame:
    """One row per item of a costly array.

    The outer form is used because a plain ``explode`` adds a filter on the array's size below itself, which
    computes the array a second time.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def explode_matches(df: DataFrame, pattern: str, text: str) -> DataFrame:
    """One row per match: the columns of ``df`` without the text, and ``hit``."""
    keep = [c for c in df.columns if c != text]
    return each(with_matches(df, {"__hits": pattern}, text), keep, F.col("__hits"), "hit")
