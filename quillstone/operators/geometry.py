"""Paired cosine contrasts of hidden states, with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, known
from .ranking import mix_integers

CONDITIONS = ("B_same_meaning_cross", "C_diff_meaning_same_A", "D_diff_meaning_cross", "E_diff_meaning_same_B")


def with_partner(pairs: DataFrame, group: list[str], rotation: int) -> DataFrame:
    """Each row i of (group, i, a, b) with the vectors a2, b2 of row (i + rotation) % n of its group.

    n, the rows of a group, is counted where pairs has no such column.
    """
    counted = pairs if "n" in pairs.columns else pairs.join(pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), group)
    left = counted.withColumn("j", F.pmod(F.col("i") + rotation, F.col("n")))
    other = pairs.select(*group, F.col("i").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return left.join(other, [*group, "j"])


def paired_cosines(pairs: DataFrame, group: list[str], rotation: int) -> DataFrame:
    """(group, i, j, condition, cosine) for pairs (group, i, a, b), i dense from 0 in each group."""
    p = with_partner(pairs, group, rotation)
    sides = (("a", "b"), ("a", "a2"), ("a", "b2"), ("b", "b2"))
    long = F.explode(F.array(*[
        F.struct(F.lit(name).alias("condition"), cosine(F.col(x), F.col(y)).alias("cosine")) for name, (x, y) in zip(CONDITIONS, sides)]))
    return p.select(*group, "i", "j", long.alias("c")).select(*group, "i", "j", "c.condition", "c.cosine")


def paired_deltas(pairs: DataFrame, group: list[str], rotation: int) -> DataFrame:
    """(group, i, n, value): same-meaning minus other-meaning cosine."""
    p = with_partner(pairs, group, rotation)
    return p.select(*group, "i", "n", (cosine(F.col("a"), F.col("b")) - cosine(F.col("a"), F.col("b2"))).alias("value"))


# 2^31 times the cumulative Poisson(1) probabilities of 0 to 9.
POISSON = (790015084, 1580030169, 1975037711, 2106706892, 2139624187, 2146207646, 2147304889, 2147461638, 2147481232, 2147483409)


def draws(x: np.ndarray) -> np.ndarray:
    """How often a value is drawn in a resample, from its mixed integer: Poisson with mean 1."""
    return np.searchsorted(np.array(POISSON), x, "right")


def bootstrap_ci(values: DataFrame, group: list[str], seed: Column, n_boot: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(group, n, mean, lo, hi): mean of `value` and its percentile interval over resamples.

    values: (group, i, value) with i dense from 0.  How often a value enters a resample is a
    Poisson count of (i, resample, seed) through an integer mix that SQL can repeat, so no
    value is looked up: tasks keep weighted sums per group and resample, and only these are
    shuffled.  Null and NaN values are left out of the means; a group without values has null
    mean and limits.
    """
    v = values.withColumn("value", known(F.col("value")))
    stats = v.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    keyed = v.where("value is not null").select(*group, F.col("i").cast("bigint").alias("i"), F.col("value").cast("double").alias("value"), seed.cast("bigint").alias("_seed"))
    fields = {c: keyed.schema[c].dataType.simpleString() for c in group}
    every = np.arange(n_boot, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, w in held.items():
                cols = [pa.array([k] * n_boot, type=batch.schema.field(c).type) for c, k in zip(group, key)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(every), pa.array(w[0]), pa.array(w[1])], names=[*group, "boot", "w", "wv"])
            held.clear()

        batch = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group))) if group else [()] * batch.num_rows
            i, value, sd = (batch.column(c).to_numpy() for c in ("i", "value", "_seed"))
            order: dict[tuple, list[int]] = {}
            for row, key in enumerate(keys):
                order.setdefault(key, []).append(row)
            for key, rows in order.items():
                total = held.setdefault(key, np.zeros((2, n_boot)))
                for lo in range(0, len(rows), 256):
                    r = rows[lo: lo + 256]
                    w = draws(mix_integers(i[r][:, None] * n_boot + every + sd[r][:, None] * 7919))
                    total[0] += w.sum(axis=0)
                    total[1] += value[r] @ w
            if len(held) > 512:
                yield from out()
        if batch is not None:
            yield from out()

    schema = ", ".join(f"{c} {k}" for c, k in fields.items()) + ", boot bigint, w double, wv double"
    means = keyed.mapInArrow(sums, schema).groupBy(*group, "boot").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv")).where("w > 0")
    limits = means.groupBy(*group).agg(*[F.percentile(F.col("wv") / F.col("w"), q).alias(c) for c, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group]
    return stats.alias("s").join(limits.alias("l"), same, "left").select(*[f"s.{c}" for c in group], "n", "mean", "lo", "hi")


def bootstrap_mean_ci(values: np.ndarray, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple:
    """Mean and interval of one sample with NumPy's generator; three Nones for an empty one."""
    # fixed by the given seeds' results: the order of the draws and the kind of quantile
    x = np.asarray(values, float)
    if not x.size:
        return (None, None, None)
    means = x[np.random.default_rng(seed).integers(0, x.size, size=(n_boot, x.size))].mean(axis=1)
    return (float(x.mean()), float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2)))


def bootstrap_ci_exact(values: DataFrame, group: list[str], seed_of, n_boot: int = 2000, alpha: float = 0.05) -> DataFrame:
    """As bootstrap_ci, with NumPy's generator and seed_of(group key...): one experiment's sample per task."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        mean, lo, hi = bootstrap_mean_ci(pdf.sort_values("i")["value"].dropna().to_numpy(), n_boot, alpha, seed_of(*key))
        return pd.DataFrame([[*key, len(pdf), mean, lo, hi]], columns=[*group, "n", "mean", "lo", "hi"])

    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in group)
    return values.groupBy(*group).applyInPandas(run, f"{kinds}, n bigint, mean double, lo double, hi double")


def gate(summary: DataFrame, first: int, last: int) -> DataFrame:
    """Half-width, whether the level lies in the window, and whether it passes there."""
    inside = F.col("level").between(first, last)
    return summary.withColumn("halfwidth", (F.col("hi") - F.col("lo")) / 2).withColumn("in_gate_window", inside).withColumn(
        "gate_pass", inside & F.coalesce(F.col("lo") > 0, F.lit(False)))


def extreme_level(summary: DataFrame, group: list[str], value: str, first: int, last: int, largest: bool = True) -> DataFrame:
    """The row of the largest (or smallest) value per group among levels first..last; the lowest level of equals."""
    v = F.col(value)
    order = Window.partitionBy(*group).orderBy(v.desc_nulls_last() if largest else v.asc_nulls_last(), "level")
    return summary.where(F.col("level").between(first, last) & v.isNotNull()).withColumn(
        "_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def cross_checkpoint(states: DataFrame, keys: list[str], base: str, carry: list[str] = ()) -> DataFrame:
    """(post_slug, keys, carry, cosine): states of each other model against the base model's."""
    b = states.where(F.col("model_slug") == base).select(*keys, F.col("h").alias("hb"))
    post = states.where(F.col("model_slug") != base)
    return post.join(b, keys).select(F.col("model_slug").alias("post_slug"), *keys, *carry, cosine(F.col("h"), F.col("hb")).alias("cosine"))


def base_slug(slugs: DataFrame, word: str = "base") -> str | None:
    """First model name, by name, that contains the word."""
    row = slugs.where(F.lower("model_slug").contains(word)).agg(F.min("model_slug")).first()
    return row[0] if row else None
