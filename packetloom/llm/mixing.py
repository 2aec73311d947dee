"""Mix sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probability.

Tokens are added up in cells (source, language, topic).  Raking multiplies the weights of a dimension's values in turn so
that their sums meet its targets, round after round, by grouped sums over cells; no cell table passes through the
driver.  Weights become probabilities: the whole scale is chosen so that a stated share of all tokens is expected, and
no probability is over one.  A document is drawn if a hash of its doc_id is below its probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.quality import form
from packetloom.llm.text import small_batches
from packetloom.session import cut

DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-4
MAX_ROUNDS = 25
SHARE = 0.9
SEED = 20240517
#: Targets are drawn from the corpus toward equal shares by these powers of the present share.
TEMPER = {"source": 0.9, "lang": 0.95, "topic": 0.95}


@F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())]))
def measured(column: pa.Array) -> pa.Array:
    """Words of the whole text, and its kind by form: empty, tabular, symbolic, numeric, shouted, short, article or long."""
    x = form(column)
    tokens = np.rint(np.expm1(x[:, 0])).astype(np.int64)
    topic = np.select(
        [tokens == 0, x[:, 5] > 0.2, x[:, 2] > 0.1, x[:, 3] > 0.1, x[:, 4] > 0.3, tokens < 100, tokens < 1000],
        ["empty", "tabular", "symbolic", "numeric", "shouted", "short", "article"], "long")
    return pa.StructArray.from_arrays([pa.array(tokens), pa.array(topic.astype(object), pa.string())], ["tokens", "topic"])


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value and target share: the present share to a power, made to sum to one.  Power 1 keeps shares, 0 makes them equal."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    scaled = sums.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w"))
    total = scaled.agg(F.sum("w")).first()[0] or 1.0
    return scaled.select("value", (F.col("w") / F.lit(float(total))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions and tokens) with ``weight``: tokens raked to the targets, which are shares of all tokens.

    A value without a target keeps its share; targets of values that have no tokens are left out, and each dimension's
    targets are scaled to one.  The last dimension is met exactly, the others within ``tolerance`` unless ``rounds`` end first.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    names = list(targets)
    for k, (name, wanted) in enumerate(targets.items()):
        # Targets ride along with their cells, scaled to one over the values that have tokens.
        sums = state.groupBy(F.col(name).alias("__own")).agg(F.sum("weight").alias("__present"))
        known = wanted.select(F.col("value").alias("__value"), F.col("target").cast("double").alias("__target"))
        goal = sums.join(known, F.col("__own").eqNullSafe(F.col("__value")), "left").select("__own", F.coalesce("__target", "__present").alias("__goal"))
        scale = goal.agg(F.sum("__goal")).first()[0] or 1.0
        goal = goal.select("__own", (F.col("__goal") / F.lit(scale)).alias(f"__goal{k}"))
        state = cut(state.join(goal, F.col(name).eqNullSafe(F.col("__own"))).drop("__own"))
    for _ in range(rounds):
        far = F.lit(0.0)
        for k, name in enumerate(names):
            # Sums are joined by sort and merge: nothing is gathered on the driver, and a value of very many cells is split.
            sums = state.groupBy(F.col(name).alias("__own")).agg(F.sum("weight").alias("__sum")).hint("merge")
            factor = F.col(f"__goal{k}") / F.col("__sum")
            # Written after each step: the next one reads its input twice, and plans would double.
            state = cut(state.join(sums, F.col(name).eqNullSafe(F.col("__own"))).withColumn(f"__far{k}", F.abs(factor - 1)).withColumn(
                "weight", F.col("weight") * factor).drop("__own", "__sum"))
            far = F.greatest(far, F.col(f"__far{k}"))
        moved = state.agg(F.max(far)).first()[0] or 0.0
        state = state.drop(*(f"__far{k}" for k in range(len(names))))
        if moved <= tolerance:
            break
    return state.drop(*(f"__goal{k}" for k in range(len(names))))


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``probability``: proportional to weight over tokens, at most one, and expecting ``share`` of all tokens.

    Cells that reach one are full, and the rest is scaled up for what they lack; each step fills at least one more.
    """
    state = cells.withColumn("ratio", F.col("weight") / F.col("tokens"))
    total = state.agg(F.sum("tokens")).first()[0] or 0
    scale = 0.0
    for _ in range(200):
        full = F.col("ratio") * scale >= 1
        row = state.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not total or not row[1]:
            break
        after = (share * total - row[0]) / row[1]
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    return state.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(float(scale)))).drop("ratio")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = SEED, text: str = "text"
) -> DataFrame:
    """``docs`` with tokens, topic, token_weight, probability and sampled beside its own columns (like-named ones are replaced).

    Needs doc_id, source, lang and the text column.  ``targets`` gives (value, target) per dimension; without, they are the
    corpus shares drawn toward equal ones.  token_weight is the raked weight of one token against one of the corpus at large.
    A null source or language is a value of its own.  A null or empty text has no tokens, no weight, and stays (probability
    one).  Repeated rows and equal doc_ids share one draw; a null doc_id draws as a value of its own.  No rows: no rows.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("tokens", "topic", "token_weight", "probability", "sampled")]
    whole = docs.select(*own, measured(F.col(text).cast("string")).alias("__m"))
    cells = cut(whole.groupBy("source", "lang", F.col("__m.topic").alias("topic")).agg(F.sum("__m.tokens").alias("tokens"), F.count("*").alias("documents")))
    wanted = targets or {name: tempered_targets(cells, name, TEMPER[name]) for name in DIMENSIONS}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    # Written, so that its size is known: Spark broadcasts it below its threshold, and splits hot cells of a join above.
    drawn = cut(probabilities(rake(cells, wanted), share).select(
        F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"),
        (F.col("weight") * F.lit(float(total)) / F.col("tokens")).alias("__w"), F.col("probability").alias("__p")))
    match = F.col("source").eqNullSafe(F.col("__s")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.col("__m.topic") == F.col("__t"))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return whole.join(drawn, match, "left").select(
        *own, F.col("__m.tokens").alias("tokens"), F.col("__m.topic").alias("topic"), F.coalesce("__w", F.lit(0.0)).alias("token_weight"),
        F.coalesce("__p", F.lit(1.0)).alias("probability"), (uniform < F.coalesce("__p", F.lit(1.0))).alias("sampled"))
