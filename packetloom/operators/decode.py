"""Recognised encodings and chains of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import each

BASE64 = "^[A-Za-z0-9+/]*={0,2}$"
BASE64URL = "^[A-Za-z0-9_-]*={0,2}$"
HEX = "^[0-9A-Fa-f]+$"
MAX_DEPTH = 8


def recognized(value: Column) -> Column:
    """``struct<transform, output>`` for one text; both null when no encoding is certain enough."""
    text = F.trim(value)
    length = F.length(text)
    is_hex = (length >= 8) & (length % 2 == 0) & F.rlike(text, F.lit(HEX))
    plain = F.rlike(text, F.lit(BASE64))
    marked = F.rlike(text, F.lit("[+/=]"))
    url = F.rlike(text, F.lit(BASE64URL)) & F.rlike(text, F.lit("[-_]"))
    name = F.when(is_hex, "hex").when(
        length >= 8,
        F.when(plain & marked, "base64").when(url, "base64url").when(plain & (length % 4 == 0), "base64"),
    )
    standard = F.translate(text, "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), ((4 - length % 4) % 4).cast("int")))
    output = F.when(name == "hex", F.try_to_binary(text, F.lit("hex"))).when(
        name.isNotNull(), F.try_to_binary(padded, F.lit("base64"))
    )
    usable = output.isNotNull() & (F.octet_length(output) > 0)
    return F.struct(F.when(usable, name).alias("transform"), F.when(usable, output).alias("output"))


def decode_recognized(df: DataFrame, value: str = "value") -> DataFrame:
    decoded = df.withColumn("__decoded", recognized(F.col(value)))
    return decoded.where("__decoded.transform IS NOT NULL").select(
        *df.columns, F.col("__decoded.transform").alias("transform"), F.col("__decoded.output").alias("output")
    )


def decode_chain(df: DataFrame, owner: str, value: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Edges of repeated decoding: parent hash, transform, output and depth, one row per hop.

    All hops of a value are columns of its row, in one stage without a shuffle.  Where an output at ``max_depth`` could be
    decoded again, a row one deeper has no output and the status ``depth-limit``; all others are ``decoded``.
    """
    rows = df.select(F.col(owner).alias("owner"), F.col(value).alias("__t1"))
    hops = []
    for depth in range(1, max_depth + 2):
        text, hop = F.col(f"__t{depth}"), f"__d{depth}"
        over = depth > max_depth
        rows = rows.withColumn(hop, recognized(text))
        output = F.lit(None).cast("binary") if over else F.col(f"{hop}.output")
        hops.append(F.when(F.col(f"{hop}.transform").isNotNull(), F.struct(
            F.lit(depth).alias("depth"), F.sha2(F.encode(text, "UTF-8"), 256).alias("parent_hash"), F.col(f"{hop}.transform").alias("transform"),
            output.alias("output"), F.sha2(output, 256).alias("output_hash"), F.octet_length(output).cast("int").alias("output_length"),
            F.lit("depth-limit" if over else "decoded").alias("status"),
        )))
        # Only text can carry a further encoding.
        rows = rows.withColumn(f"__t{depth + 1}", F.try_validate_utf8(F.col(f"{hop}.output").cast("string")))
    return each(rows, ["owner"], F.array(*hops), "__hop").select("owner", "__hop.*")
