"""Projection of vectors on a weight matrix: logits, softmax, script mass, sparse codes.

The weights (a vocabulary or a dictionary of features) are the small side.  Their size is
checked; above max_bytes they go out in blocks of at most that size and the partial
results are merged, so no task ever holds more.  Vectors stream past in Arrow batches and
only what is asked for (the k best, or a mass per class) leaves the task.

Edge cases: null vectors and vectors of another length give no rows; no weights give no
rows; equal logits are in order of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

_CHUNK = 512


def _blocks(weights: DataFrame, columns: list[str], max_bytes: int) -> Iterator[pa.Table]:
    """The weights in order of id, a block of at most max_bytes at a time."""
    row = weights.agg(F.count(F.lit(1)), F.max(F.size("w")), F.min("id"), F.max("id")).first()
    if not row[0]:
        return
    rows = max(1, max_bytes // (8 * max(1, row[1]) + 64))
    if row[0] <= rows:
        yield weights.select(*columns).orderBy("id").toArrow()
        return
    bounds = weights.stat.approxQuantile("id", [i / -(-2 * row[0] // rows) for i in range(1, -(-2 * row[0] // rows))], 0.001)
    edges = [row[2], *sorted({int(b) for b in bounds}), row[3] + 1]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield weights.where(F.col("id").between(lo, hi - 1)).select(*columns).orderBy("id").toArrow()


def _dense(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as a matrix, and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else (int(size.max()) if len(size) else 0)
    at = np.flatnonzero(size == dim)
    x = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(at) else np.zeros((0, dim))
    return x, at


def _best(z: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, equal values by column."""
    m = z.shape[1]
    if k >= m:
        return np.argsort(-z, axis=1, kind="stable")
    at = np.argpartition(-z, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(z, at, 1)
    tied = np.flatnonzero((z >= value.min(axis=1)[:, None]).sum(axis=1) > k)
    by = np.lexsort((at, -value), axis=1)
    out = np.take_along_axis(at, by, 1)
    if len(tied):  # the k-th value is there more than once: the first columns have it
        out[tied] = np.argsort(-z[tied], axis=1, kind="stable")[:, :k]
    return out


def project_top_k(vectors: DataFrame, weights: DataFrame, k: int, *, bias: bool = False, relu: bool = False,
                  max_bytes: int = 256 << 20, digits: int | None = None, carry: list[str] = ()) -> DataFrame:
    """(key, carry, id, value, rank): the k largest products of each vector (key, v, carry) with weights (id, w[, b]).

    relu keeps positive values only (a top-k sparse code).  digits rounds before ranking.
    Columns to carry pass through the task, so that nothing is joined again.  Weights in one
    block are ranked where the vector is; the best of several blocks are ranked once more.
    """
    spark = vectors.sparkSession
    keys = ["key", *carry]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys)
    parts = []
    for block in _blocks(weights, ["id", "w", *(["b"] if bias else [])], max_bytes):
        w, at = _dense(block["w"])
        held = spark.sparkContext.broadcast((w, block["id"].to_numpy()[at].astype(np.int64), block["b"].to_numpy()[at].astype(float) if bias else None))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, ids, b = held.value
            for batch in batches:
                x, at = _dense(batch.column("v"), w.shape[1])
                for lo in range(0, len(at), _CHUNK):
                    z = x[lo: lo + _CHUNK] @ w.T
                    if b is not None:
                        z = z + b
                    if digits is not None:
                        z = np.round(z, digits) + 0.0
                    best = _best(z, k)
                    r = np.repeat(np.arange(len(z)), best.shape[1])
                    rank = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(z))
                    c = best.ravel()
                    if relu:
                        keep = z[r, c] > 0
                        r, c, rank = r[keep], c[keep], rank[keep]
                    rows = pa.array(at[lo: lo + _CHUNK][r])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(x_).take(rows) for x_ in keys), pa.array(ids[c]), pa.array(z[r, c]), pa.array(rank)], names=[*keys, "id", "value", "rank"])

        parts.append(vectors.select(*keys, "v").mapInArrow(run, f"{kinds}, id bigint, value double, rank int"))
    if not parts:
        return vectors.select(*keys, F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("value"), F.lit(0).alias("rank")).limit(0)
    if len(parts) == 1:
        return parts[0]
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("key").orderBy(F.col("value").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def project_log_probs(vectors: DataFrame, weights: DataFrame, *, ids: str | None = None, carry: list[str] = (), max_bytes: int = 256 << 20) -> DataFrame:
    """(key, carry, id, logit, log_prob) of the ids in a vector's ARRAY<BIGINT> column `ids`, or of all weights.

    A task sums the exponentials over a block against its maximum and gathers what is asked
    for; only that leaves the task.  Sums of several blocks merge by key.  Ids that are not
    among the weights have no row; a repeated id has one for each time.
    """
    spark = vectors.sparkSession
    keys = ["key", *carry]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys)
    parts = []
    for block in _blocks(weights, ["id", "w"], max_bytes):
        w, at = _dense(block["w"])
        if not len(at):
            continue
        held = spark.sparkContext.broadcast((w, block["id"].to_numpy()[at].astype(np.int64)))  # in order of id

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, known = held.value
            for batch in batches:
                x, at = _dense(batch.column("v"), w.shape[1])
                for lo in range(0, len(at), _CHUNK):
                    part = at[lo: lo + _CHUNK]
                    z = x[lo: lo + _CHUNK] @ w.T
                    top = z.max(axis=1)
                    total = np.exp(z - top[:, None]).sum(axis=1)
                    if ids is None:
                        size, asked, found = np.full(len(z), len(known)), np.tile(known, len(z)), z.ravel()
                    else:
                        lists = batch.column(ids).take(pa.array(part))
                        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                        asked = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                        r = np.repeat(np.arange(len(z)), size)
                        c = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                        ok = known[c] == asked
                        size = np.bincount(r[ok], minlength=len(z))
                        asked, found = asked[ok], z[r[ok], c[ok]]
                    offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                    rows = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(x_).take(rows) for x_ in keys), pa.array(top), pa.array(total),
                         pa.ListArray.from_arrays(offsets, pa.array(asked, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(found, pa.float64()))],
                        names=[*keys, "top", "part", "ids", "logits"])

        parts.append(vectors.select(*keys, "v", *([ids] if ids else [])).mapInArrow(
            run, f"{kinds}, top double, part double, ids array<bigint>, logits array<double>"))
    if not parts:
        return vectors.select(*keys, F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("logit"), F.lit(0.0).alias("log_prob")).limit(0)
    found = parts[0]
    if len(parts) > 1:  # a list entry for each block
        found = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
            F.max("top").alias("top"), F.collect_list(F.struct("top", "part")).alias("p"),
            F.flatten(F.collect_list(F.arrays_zip("ids", "logits"))).alias("z")).select(
            *keys, "top", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"] * F.exp(x["top"] - F.col("top"))).alias("part"),
            F.col("z.ids").alias("ids"), F.col("z.logits").alias("logits"))
    return found.select(*keys, "top", "part", F.explode(F.arrays_zip("ids", "logits")).alias("z")).select(
        *keys, F.col("z.ids").alias("id"), F.col("z.logits").alias("logit"), (F.col("z.logits") - F.col("top") - F.log("part")).alias("log_prob"))


def project_softmax_mass(vectors: DataFrame, weights: DataFrame, *, max_bytes: int = 256 << 20) -> DataFrame:
    """(key, class, mass): softmax over all weights (id, w, class), summed by class, in one pass.

    Every block gives its maximum and its sums against that maximum; blocks merge by
    shifting to the common maximum.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["key"].dataType.simpleString()
    parts = None
    for block in _blocks(weights, ["id", "w", "class"], max_bytes):
        w, at = _dense(block["w"])
        names = np.array(block["class"].to_pylist(), dtype=object)[at]
        classes, which = np.unique(names.astype(str), return_inverse=True)
        onehot = np.zeros((len(names), len(classes)))
        onehot[np.arange(len(names)), which] = 1
        held = spark.sparkContext.broadcast((w, classes.tolist(), onehot))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, classes, onehot = held.value
            for batch in batches:
                x, at = _dense(batch.column("v"), w.shape[1])
                for lo in range(0, len(at), _CHUNK):
                    z = x[lo: lo + _CHUNK] @ w.T
                    top = z.max(axis=1)
                    mass = np.exp(z - top[:, None]) @ onehot
                    r = np.repeat(np.arange(len(z)), len(classes))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(at[lo: lo + _CHUNK][r])), pa.array(classes * len(z), pa.string()),
                         pa.array(top[r]), pa.array(mass.ravel())], names=["key", "class", "top", "part"])

        p = vectors.select("key", "v").mapInArrow(run, f"key {kind}, class string, top double, part double")
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        return vectors.select("key", F.lit("").alias("class"), F.lit(0.0).alias("mass")).limit(0)
    whole = Window.partitionBy("key")
    shifted = parts.withColumn("part", F.col("part") * F.exp(F.col("top") - F.max("top").over(whole)))
    return shifted.withColumn("all", F.sum("part").over(whole)).groupBy("key", "class").agg(
        (F.sum("part") / F.first("all")).alias("mass"))


def softmax(logits: DataFrame, group: list[str], logit: str = "logit") -> DataFrame:
    """logits with log_prob and prob over each group, shifted by the group's maximum."""
    w = Window.partitionBy(*group)  # a group is one vocabulary
    shifted = logits.withColumn("_z", F.col(logit) - F.max(logit).over(w))
    out = shifted.withColumn("log_prob", F.col("_z") - F.log(F.sum(F.exp("_z")).over(w)))
    return out.withColumn("prob", F.exp("log_prob")).drop("_z")


def entropy(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """(group, n_distinct, total, entropy): -sum p log2(p + 1e-10) over the rows of a group."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    return counts.join(total, group).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.first("total").alias("total"), (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))


def target_in_top(ids: Column, tokens: Column, target_id: Column, target: Column) -> Column:
    """Whether a target is among the likeliest tokens: by id, or as text that either holds the other, whatever the case.

    Blank tokens match nothing; a null token or target text leaves the id to decide.
    """
    wanted = F.lower(target)
    close = lambda t: (t != "") & (F.contains(t, wanted) | F.contains(wanted, t))
    by_text = F.exists(F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: stripped(F.lower(t))), close)
    return F.coalesce(F.array_contains(ids, target_id), F.lit(False)) | F.coalesce(by_text, F.lit(False))


def first_level(rows: DataFrame, key: list[str], conditions: dict) -> DataFrame:
    """The lowest level at which each condition holds, null where it never does."""
    return rows.groupBy(*key).agg(*[F.min(F.when(c, F.col("level"))).alias(name) for name, c in conditions.items()])
