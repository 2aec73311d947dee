"""Scores of matches and fields, and the merge of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import stable_id
from packetloom.session import cut

# Field names that hold secrets, those that hold passwords, and values that are placeholders.
SENSITIVE = ["api_key", "key", "passphrase", "passwd", "password", "secret", "token"]
PASSWORDS = ["passphrase", "passwd", "password"]
PLACEHOLDERS = ["********", "changeme", "none", "null", "password", "secret", "test", "undefined", "your_password"]


def candidate_id(kind: Column, value: Column) -> Column:
    return stable_id("candidate", kind, F.trim(value))


def _candidates(df: DataFrame, kind: Column, score: Column, evidence: Column, role: str, cap: float) -> DataFrame:
    return df.select(
        candidate_id(kind, F.col("value")).alias("candidate_id"),
        kind.alias("kind"),
        F.trim("value").alias("value"),
        score.cast("double").alias("score"),
        F.least(F.lit(cap), score / 100.0).alias("confidence"),
        evidence.cast("string").alias("evidence_id"),
        F.lit(role).alias("role"),
    )


def score_known(hits: DataFrame, evidence: Column) -> DataFrame:
    score = F.when(F.col("prefix") == "flag", 100.0).otherwise(95.0)
    return _candidates(hits, F.lit("flag"), score, evidence, "direct-match", 0.99)


def score_unknown(hits: DataFrame, evidence: Column) -> DataFrame:
    score = F.when(F.col("kind") == "unknown-brace", 78.0).otherwise(45.0)
    return _candidates(hits, F.lit("unknown-flag"), score, evidence, "unknown-match", 0.9)


def field_shape(value: Column) -> Column:
    length = F.length(value)
    return (
        F.when((length >= 16) & (length % 2 == 0) & F.rlike(value, F.lit("^[0-9a-fA-F]+$")), "hex")
        .when((length >= 8) & (length % 4 == 0) & F.rlike(value, F.lit("^[A-Za-z0-9+/_-]+={0,2}$")), "base64-like")
        .otherwise("plain")
    )


def sensitive_messages(fields: DataFrame) -> DataFrame:
    return fields.where(F.lower("name").isin(SENSITIVE)).select("capture_id", "tx_id").distinct()


def score_fields(fields: DataFrame) -> DataFrame:
    """Fields of forms that hold a sensitive name, with the four parts of their score."""
    chosen = fields.join(sensitive_messages(fields), ["capture_id", "tx_id"], "left_semi")
    value = F.trim("value")
    usable = ~F.rlike(F.col("value"), F.lit("[^\\x20-\\x7E]")) & (value != "") & ~F.lower(value).isin(PLACEHOLDERS)
    name = F.lower(F.trim("name"))
    sensitive = name.isin(SENSITIVE)
    shape = field_shape(value)
    parts = chosen.where(usable).select(
        "capture_id", "tx_id", "ordinal", name.alias("field_name"), value.alias("value"),
        F.when(sensitive, "sensitive-field").otherwise("context-field").alias("kind"),
        F.when(name.isin(PASSWORDS), 60.0).when(sensitive, 50.0).otherwise(10.0).alias("role_score"),
        F.when(F.length(value) >= 32, 10.0).when(F.length(value) >= 8, 5.0).otherwise(1.0).alias("length_score"),
        shape.alias("shape"),
        F.when(shape == "hex", 8.0).when(shape == "base64-like", 6.0).otherwise(0.0).alias("shape_score"),
    )
    return parts.withColumn("score", F.col("role_score") + F.col("length_score") + F.col("shape_score") + F.lit(2.0))


def field_candidates(scored: DataFrame) -> DataFrame:
    evidence = F.concat_ws(":", F.col("tx_id").cast("string"), F.col("ordinal").cast("string"))
    return _candidates(scored, F.col("kind"), F.col("score"), evidence, "structured-field", 0.99)


def field_signals(scored: DataFrame) -> DataFrame:
    """The parts of each field's score as rows."""
    parts = F.array(
        F.struct(F.lit("field-role").alias("signal"), F.col("role_score").alias("contribution")),
        F.struct(F.lit("printable").alias("signal"), F.lit(2.0).alias("contribution")),
        F.struct(F.lit("length").alias("signal"), F.col("length_score").alias("contribution")),
        F.struct(F.lit("value-shape").alias("signal"), F.col("shape_score").alias("contribution")),
    )
    return scored.select(
        candidate_id(F.col("kind"), F.col("value")).alias("candidate_id"), "tx_id", "ordinal", F.explode(parts).alias("s")
    ).select("candidate_id", "tx_id", "ordinal", "s.signal", "s.contribution")


def merge_candidates(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per candidate with its best score, and the distinct evidence links.

    Evidence stays in rows, so a value found in very many places is never gathered into one list.  Both results and all that
    is made from them read one written copy, so the texts behind the parts are scanned once.
    """
    both = cut(reduce(DataFrame.unionByName, parts))
    merged = both.groupBy("candidate_id", "kind", "value").agg(
        F.max("score").alias("score"), F.max("confidence").alias("confidence")
    )
    links = both.select("candidate_id", "evidence_id", "role").distinct()
    counts = links.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("evidence_links"))
    return merged.join(counts, "candidate_id"), links


def current_inputs(*classes: DataFrame) -> DataFrame:
    """Distinct union of the evidence classes to scan: ``(source_kind, source_id, content_hash, byte_length)``."""
    columns = ["source_kind", "source_id", "content_hash", "byte_length"]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in classes]).distinct()


def evidence(df: DataFrame, source_kind: str, source_id: Column, content_hash: Column, byte_length: Column, complete: Column, parent: Column | None = None) -> DataFrame:
    """Rows of one evidence class: what it is, its content, whether it passes its class's test, and what it came from."""
    return df.select(
        F.lit(source_kind).alias("source_kind"), source_id.cast("string").alias("source_id"), content_hash.alias("content_hash"),
        byte_length.cast("long").alias("byte_length"), F.coalesce(complete, F.lit(False)).alias("complete"),
        (F.lit(None) if parent is None else parent).cast("string").alias("parent_id"),
    )


def triage_inputs(*classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to scan, from all evidence classes, and the edges of contents to what they came from.

    Inputs are the rows with content that pass the test of their class, once each.  An edge (``content_hash``, ``source_kind``,
    ``source_id``, ``parent_id``) leads from each derived input to its parent; ``usable`` tells whether the same content is
    an input at all, through whichever class: a content that is whole in one place is whole.
    """
    rows = reduce(DataFrame.unionByName, classes)
    usable = rows.where(F.col("complete") & (F.col("byte_length") > 0))
    inputs = usable.select("source_kind", "source_id", "content_hash", "byte_length").distinct()
    derived = rows.where("parent_id IS NOT NULL AND content_hash IS NOT NULL").select("content_hash", "source_kind", "source_id", "parent_id").distinct()
    known = usable.select("content_hash", F.lit(True).alias("usable")).distinct()
    return inputs, derived.join(known, "content_hash", "left").fillna(False, ["usable"])
