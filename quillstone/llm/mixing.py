"""Mixing sources to target shares by weighted fair queueing.

The records of a source are shuffled by a hash and queue up once per allowed repeat; the
virtual finish time of a record is the tokens of its source up to and with it, divided by
the source's share.  Records with a finish time within the total budget make the mix; in
order of finish time every prefix of it has the target shares as well.

Edge cases: a source without a target or with share 0 takes no part; a target without
records keeps its row in the report with an actual share of 0, and the other shares are
scaled up to 1; records of 0 tokens take no part; spellings of a source count as one; a
null or non-positive max_repeats counts as 1; no records or no targets give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .token_budget import canonical_source


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where("target_share > 0").groupBy(canonical_source(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).alias("max_repeats"))


def _weights(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats, stock, records): targets that have records, shares scaled to 1."""
    stock = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("stock"), F.count(F.lit(1)).alias("records"))
    both = _targets(targets).join(stock, "source")
    return both.withColumn("share", F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(1)))).select(
        "source", "share", "max_repeats", "stock", "records")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, parts: int | None = None, slice_records: int = 200_000, seed: int = 1) -> DataFrame:
    """(source, id, repeat_no, n_tokens, finish) for sizes (id, source, n_tokens), in order of finish.

    Without total_tokens the budget is the largest at which no source runs out.  Prefix sums
    run over slices of the shuffle of about slice_records of the largest source, however many
    that makes (or over `parts`), so a source with most of the records is no one task.
    """
    weights = _weights(sizes, targets)
    whole, most = weights.agg(F.min(F.col("stock") * F.col("max_repeats") / F.col("share")), F.max("records")).first()
    parts = parts or max(16, -(-(most or 0) // slice_records))
    budget = float(total_tokens if total_tokens is not None else whole or 0)
    # repeats that the budget reaches; the list of sources is as short as the targets
    wanted = weights.withColumn("rounds", F.least("max_repeats", F.ceil(F.lit(budget) * F.col("share") / F.col("stock"))))
    hashed = sizes.where("n_tokens > 0").join(F.broadcast(wanted), "source").select(
        "source", "id", "n_tokens", "share", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int"))).alias("repeat_no")).withColumn(
        "h", F.xxhash64("id", "repeat_no", F.lit(seed)))
    hashed = hashed.withColumn("h", F.shiftrightunsigned("h", 1))
    sliced = hashed.withColumn("slice", F.floor(F.col("h") / F.lit(float(2**63) / parts)).cast("int"))
    before = Window.partitionBy("source").orderBy("repeat_no", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("source", "repeat_no", "slice").agg(F.sum("n_tokens").alias("t")).select(
        "source", "repeat_no", "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("source", "repeat_no", "slice").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    timed = sliced.withColumn("run", F.sum("n_tokens").over(inside)).join(offsets, ["source", "repeat_no", "slice"])
    finish = (F.col("skip") + F.col("run")) / F.col("share")
    return timed.select("source", "id", "repeat_no", "n_tokens", finish.alias("finish")).where(
        F.col("finish") <= budget * (1 + 1e-12)).orderBy("finish", "source", "id", "repeat_no")


def mix_report(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: what was wanted and what the mix holds."""
    used = mix(sizes, targets, total_tokens).groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_uses"), F.countDistinct("id").alias("n_records"),
        F.max("repeat_no").alias("most_repeats"))
    weights = _weights(sizes, targets).select("source", F.col("share").alias("scaled_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    all_ = F.sum(F.coalesce("n_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return _targets(targets).join(weights, "source", "left").join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("scaled_share", F.lit(0.0)).alias("scaled_share"),
        F.when(all_ > 0, F.coalesce("n_tokens", F.lit(0)) / all_).otherwise(F.lit(0.0)).alias("actual_share"),
        zero("n_tokens"), zero("n_records"), zero("n_uses"), zero("most_repeats"))
