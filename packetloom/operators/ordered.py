"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(frame)`` puts a whole key into one task.  ``scan`` splits every
key by its position into spans, runs the window inside each ``(key, span)``, carries one small summary
row per span across the key, and adds the carry back.  Results equal those of the plain window.

Within a span there are at most ``span`` distinct positions, so a task's share is bounded by the span
size; the window across spans sees one summary row per span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 65_536


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column
    inclusive: bool = True
    unwrap: bool = False
    where: Column | None = None


def running_sum(value: Column, inclusive: bool = True) -> Spec:
    return Spec("sum", value, inclusive)


def running_count(condition: Column | None = None, inclusive: bool = True) -> Spec:
    one = F.lit(1).cast("long")
    return Spec("sum", one if condition is None else F.when(condition, one).otherwise(F.lit(0)), inclusive)


def row_number() -> Spec:
    return running_count()


def running_max(value: Column, inclusive: bool = True) -> Spec:
    return Spec("max", value, inclusive)


def running_peak(value: Column, where: Column | None = None, inclusive: bool = True) -> Spec:
    """Highest running sum of ``value`` so far, taken at the rows where the condition holds."""
    return Spec("peak", value, inclusive, where=F.lit(True) if where is None else where)


def last_value(value: Column, inclusive: bool = False) -> Spec:
    """Last non-null value among the earlier rows (and this one, if inclusive)."""
    return Spec("last", value, inclusive)


def next_value(value: Column, inclusive: bool = False) -> Spec:
    """First non-null value among the later rows (and this one, if inclusive)."""
    return Spec("next", value, inclusive)


def lag(value: Column) -> Spec:
    return Spec("last", F.struct(value.alias("v")), False, True)


def lead(value: Column) -> Spec:
    return Spec("next", F.struct(value.alias("v")), False, True)


def group_sum(value: Column) -> Spec:
    return Spec("group_sum", value)


def group_max(value: Column) -> Spec:
    return Spec("group_max", value)


def group_min(value: Column) -> Spec:
    return Spec("group_min", value)


def group_first(value: Column) -> Spec:
    """Non-null value of the earliest row of the key."""
    return Spec("group_first", value)


def span_of(position: str, span: int = SPAN) -> Column:
    return F.expr(f"`{position}` div {span}")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    specs: Mapping[str, Spec],
    ties: Sequence[str] = (),
    span: int = SPAN,
) -> DataFrame:
    """Add one column per spec.  ``position`` is an integral column; keys and order columns are non-null."""
    keys = list(keys)
    order = [position, *ties]
    # A single long keeps the summary a hash aggregate.
    at = F.struct(*order) if ties else F.col(position)
    base = df.withColumn("__span", span_of(position, span))

    peaks = {name: spec for name, spec in specs.items() if spec.kind == "peak"}
    summary_aggs, carry_cols, local_cols, final = [], [], [], {}
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys)
    inside = Window.partitionBy(*keys, "__span").orderBy(*order)
    backward = Window.partitionBy(*keys, "__span").orderBy(*[F.desc(name) for name in order])

    for name, spec in peaks.items():
        # Sums inside the span first; the carried sum is added to the span's own peak afterwards.
        base = base.withColumn(f"__s_{name}", F.sum(spec.value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    for name, spec in specs.items():
        part, carry, local = f"__p_{name}", f"__c_{name}", f"__l_{name}"
        end = 0 if spec.inclusive else -1
        forward = inside.rowsBetween(Window.unboundedPreceding, end)
        reverse = backward.rowsBetween(Window.unboundedPreceding, end)
        present = F.when(spec.value.isNotNull(), at)
        if spec.kind in ("sum", "max"):
            agg = F.sum if spec.kind == "sum" else F.max
            summary_aggs.append(agg(spec.value).alias(part))
            carry_cols.append(agg(part).over(before).alias(carry))
            local_cols.append(agg(spec.value).over(forward).alias(local))
            if spec.kind == "sum":
                result = F.coalesce(F.col(local), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
            else:
                result = F.greatest(F.col(local), F.col(carry))
        elif spec.kind == "peak":
            at_rows = F.when(spec.where, F.col(f"__s_{name}"))
            summary_aggs += [F.sum(spec.value).alias(f"{part}_sum"), F.max(at_rows).alias(part)]
            carry_cols.append(F.coalesce(F.sum(f"{part}_sum").over(before), F.lit(0)).alias(f"{carry}_sum"))
            carry_cols.append(F.col(part))
            local_cols.append(F.max(at_rows).over(forward).alias(local))
            result = F.greatest(F.col(local) + F.col(f"{carry}_sum"), F.col(carry))
        elif spec.kind == "last":
            summary_aggs.append(F.max_by(spec.value, present).alias(part))
            carry_cols.append(F.last(part, ignorenulls=True).over(before).alias(carry))
            local_cols.append(F.last(spec.value, ignorenulls=True).over(forward).alias(local))
            result = F.coalesce(F.col(local), F.col(carry))
        elif spec.kind == "next":
            summary_aggs.append(F.min_by(spec.value, present).alias(part))
            carry_cols.append(F.last(part, ignorenulls=True).over(after).alias(carry))
            local_cols.append(F.last(spec.value, ignorenulls=True).over(reverse).alias(local))
            result = F.coalesce(F.col(local), F.col(carry))
        else:
            if spec.kind == "group_first":
                summary_aggs.append(F.min_by(F.struct(spec.value.alias("v")), present).alias(part))
                carry_cols.append(
                    F.min_by(F.col(part), F.when(F.col(part).isNotNull(), F.col("__span"))).over(across)["v"].alias(carry)
                )
            else:
                agg = {"group_sum": F.sum, "group_max": F.max, "group_min": F.min}[spec.kind]
                summary_aggs.append(agg(spec.value).alias(part))
                carry_cols.append(agg(part).over(across).alias(carry))
            result = F.col(carry)
        final[name] = result["v"] if spec.unwrap else result

    carries = (
        base.groupBy(*keys, "__span").agg(*summary_aggs).select(*keys, "__span", *carry_cols)
    )
    for name in peaks:
        reach = F.max(F.col(f"__p_{name}") + F.col(f"__c_{name}_sum")).over(before)
        carries = carries.withColumn(f"__c_{name}", reach).drop(f"__p_{name}")
    joined = base.select("*", *local_cols).join(carries, [*keys, "__span"], "left")
    kept = [F.col(c) for c in df.columns if c not in final]
    return joined.select(*kept, *[column.alias(name) for name, column in final.items()])


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    position: str,
    how: str = "left",
    span: int = SPAN,
) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``keys``) when one key may hold most of ``big``.

    The small row is first copied to the spans in which its key occurs, so the wide join runs on
    ``(keys, span)`` and a hot key is spread over many tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError("spread_join supports left and inner joins")
    spanned = big.withColumn("__span", span_of(position, span))
    routed = spanned.select(*keys, "__span").distinct().join(small, list(keys))
    return spanned.join(routed, [*keys, "__span"], how).drop("__span")
