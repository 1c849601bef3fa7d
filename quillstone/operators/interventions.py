"""Arithmetic of patched and steered runs: token sequences, log-probabilities, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add_scaled, known
from .projection import softmax

# Subtasks and the metric that only they are judged by; the last two hold for all.
SUBTASK_METRICS = {"json_format": "is_json_valid", "quotation": "has_quotation_wrap", "no_comma": "no_comma_compliance"}
COMMON_METRICS = ("target_lang_script_ratio", "chrf_to_global")


def first_divergence(a: Column, b: Column) -> Column:
    """0-based index of the first difference; the shorter length for a prefix; null for equal arrays."""
    n = F.least(F.size(a), F.size(b))
    other = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.when(F.size(other) > 0, F.element_at(other, 1) - 1).when(F.size(a) != F.size(b), n)


def relevant(subtask: Column, metric: Column) -> Column:
    """Whether a metric counts for a subtask."""
    own = F.lit(False)
    for s, m in SUBTASK_METRICS.items():
        own = own | ((subtask == s) & (metric == m))
    return own | metric.isin(*COMMON_METRICS)


def token_log_probs(logits: DataFrame, tokens: DataFrame, case: list[str]) -> DataFrame:
    """(case, pos, token_id, log_prob) of given tokens under logits (case, pos, token_id, logit).

    tokens: (case, pos, token_id) with pos the place in the continuation whose logits sit at the
    same pos; tokens without logits have no row.
    """
    p = softmax(logits.join(tokens.select(*case, "pos").distinct(), [*case, "pos"]), [*case, "pos"])
    return tokens.join(p.select(*case, "pos", "token_id", "log_prob"), [*case, "pos", "token_id"]).select(*case, "pos", "token_id", "log_prob")


def sequence_log_prob(per_token: DataFrame, cases: DataFrame, case: list[str]) -> DataFrame:
    """(case, log_prob, n_tokens); an empty continuation has log-probability 0."""
    s = per_token.groupBy(*case).agg(F.sum("log_prob").alias("log_prob"), F.count(F.lit(1)).alias("n_tokens"))
    return cases.select(*case).distinct().join(s, case, "left").select(*case, F.coalesce("log_prob", F.lit(0.0)).alias("log_prob"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def effects(rows: DataFrame) -> DataFrame:
    """rows (.., baseline_value, patched_value) with effect = patched - baseline, null if either is missing."""
    return rows.withColumn("effect", known(F.col("patched_value")) - known(F.col("baseline_value")))


def lifted(relevant_: Column, baseline: Column, steered: Column) -> Column:
    return F.coalesce(relevant_ & (known(steered) > known(baseline)), F.lit(False))


def summarise(rows: DataFrame, keys: list[str], value: str = "effect") -> DataFrame:
    """n, mean, median and sample deviation of the known values; null keys are groups of their own."""
    v = known(F.col(value))
    return rows.groupBy(*keys).agg(F.count(v).alias("n_observations"), F.avg(v).alias("mean_effect"), F.percentile(v, 0.5).alias("median_effect"), F.stddev_samp(v).alias("std_effect"))


def patch_states(states: DataFrame, donors: DataFrame, keys: list[str]) -> DataFrame:
    """states with h replaced where a donor (keys, donor) is given: a patched position."""
    return states.join(donors, keys, "left").withColumn("h", F.coalesce("donor", "h")).drop("donor")


def steer_states(states: DataFrame, direction: list[float], scale: float) -> DataFrame:
    return states.withColumn("h", add_scaled(F.col("h"), F.array(*map(F.lit, direction)), scale))


def block_to_level(block: Column) -> Column:
    """Output of block b is level b + 1; level 0 is the embedding."""
    return block + 1
