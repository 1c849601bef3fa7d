"""Row numbers and resetting sums over groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mixed(x: Column) -> Column:
    """Three rounds of a 31-bit integer mix that any SQL engine can evaluate alike."""
    for _ in range(3):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))
    return x


def mix_integers(x: np.ndarray) -> np.ndarray:
    """The same for an array."""
    x = x % 2147483648
    for _ in range(3):
        x = ((x ^ (x >> 15)) * 1103515245 + 12345) % 2147483648
    return x


def dense_index(df: DataFrame, group: list[str], order: list[Column], slice_: Column, out: str = "idx", total: str | None = None) -> DataFrame:
    """0-based row number in each group, in the order of (slice_, *order), and on demand the group's size.

    slice_ must not contradict the order (a prefix of it, such as a range of the sort key).
    Rows are numbered inside a slice and shifted by the counts of the slices before, so the
    largest sort is one slice, not one group.
    """
    s = df.withColumn("_slice", slice_)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    skip = s.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_skip", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    skip = skip.withColumn("_total", F.sum("_c").over(Window.partitionBy(*group))) if total else skip
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = s.withColumn("_n", F.row_number().over(inside) - 1)
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*group, "_slice")]
    joined = numbered.alias("x").join(skip.alias("y"), on)
    size = [F.col("y._total").alias(total)] if total else []
    return joined.select("x.*", (F.col("y._skip") + F.col("x._n")).cast("bigint").alias(out), *size).drop("_slice", "_n")


def minibatches(df: DataFrame, key: str, batch: int, epoch: int = 0, seed: int = 0, parts: int = 64) -> DataFrame:
    """(key, batch): a permutation by an integer mix, floor-divided; the remainder is dropped, one batch stays at least."""
    h = mixed(F.pmod(F.col(key) + F.lit(seed * 7919 + epoch * 104729), F.lit(2147483648)))
    rows = dense_index(df.select(key).distinct().withColumn("_h", h), [], [F.col("_h"), F.col(key)],
                       F.floor(F.col("_h") / F.lit(2147483648 // parts)).cast("int"), "_idx")
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("_total"))
    return rows.crossJoin(F.broadcast(n)).withColumn("batch", F.floor(F.col("_idx") / batch)).where(
        F.col("batch") < F.greatest(F.lit(1), F.floor(F.col("_total") / batch))).select(key, F.col("batch").cast("bigint").alias("batch"))


def shard_assignment(df: DataFrame, group: str, order: str, size: str, target: int) -> DataFrame:
    """(group, order, size, shard): whole rows are appended to a shard that closes once it holds `target`.

    The sum restarts at every close, so a group is folded in order; only (group, order, size)
    reaches that fold, it streams through sorted partitions and keeps two numbers per group.
    Null sizes count as 0; ties in `order` are in order of size.
    """
    rows = df.where(F.col(order).isNotNull()).select(F.col(group).cast("string").alias(group), order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, held = object(), 0, 0
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            names = np.array(b.column(group).to_pylist(), dtype=object)
            total = np.cumsum(b.column(size).to_numpy())
            ends = np.r_[np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)] if len(names) else []
            lo = 0
            for end in ends:
                if names[lo] != current:
                    current, shard, held = names[lo], 0, 0
                while lo < end:  # a step for each shard that closes, not for each row
                    base = total[lo - 1] if lo else 0
                    close = min(lo + int(np.searchsorted(total[lo:end], base + target - held)), end - 1)
                    out[lo: close + 1] = shard
                    held += total[close] - base
                    if held >= target:
                        shard, held = shard + 1, 0
                    lo = close + 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (group, order, size)), pa.array(out)], names=[group, order, size, "shard"])

    kind = rows.schema[order].dataType.simpleString()
    return rows.repartition(group).sortWithinPartitions(group, order, size).mapInArrow(
        fold, f"{group} string, {order} {kind}, {size} bigint, shard bigint")
