"""Sparse-autoencoder features: codes, reconstruction, ranking and matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .projection import project_top_k
from .ranking import minibatches


def encode(vectors: DataFrame, encoder: DataFrame, k: int, digits: int | None = 9, carry: list[str] = ()) -> DataFrame:
    """(key, carry, feature_idx, z): the k largest of relu(w.x + b); zeros are left out."""
    code = project_top_k(vectors, encoder, k, bias=True, relu=True, digits=digits, carry=carry)
    return code.select("key", *carry, F.col("id").alias("feature_idx"), F.col("value").alias("z"))


def reconstruction_error(vectors: DataFrame, code: DataFrame, decoder: DataFrame) -> DataFrame:
    """(key, mse): mean squared difference of each vector and the sum of its z * decoder rows.

    The error expands to |x|^2 - 2 sum z (d.x) + |sum z d|^2 per dimension; the decoded vector
    is summed by (key, dimension), so nothing larger than a code row is held.
    """
    parts = code.join(decoder.select(F.col("id").alias("feature_idx"), "d"), "feature_idx").select(
        "key", "z", F.posexplode("d").alias("dim", "x")).groupBy("key", "dim").agg(F.sum(F.col("z") * F.col("x").cast("double")).alias("x_hat"))
    x = vectors.select("key", F.posexplode("v").alias("dim", "x"))
    diff = F.col("x").cast("double") - F.coalesce("x_hat", F.lit(0.0))
    return x.join(parts, ["key", "dim"], "left").groupBy("key").agg(F.avg(diff * diff).alias("mse"))


def dead_features(fires: DataFrame, features: DataFrame, steps: DataFrame, window: int) -> DataFrame:
    """(step, n_dead, dead_ratio): features that have not fired in the last `window` steps.

    fires: (step, feature_idx); a feature that never fired counts from step -1.
    """
    once = fires.select("step", "feature_idx").distinct()
    after = F.lead("step").over(Window.partitionBy("feature_idx").orderBy("step"))
    # a firing keeps its feature alive up to the end of its window or its next firing
    alive = once.withColumn("end", F.least(F.col("step") + window + 1, F.coalesce(after, F.col("step") + window + 1)))
    early = steps.agg(F.min("step").alias("step")).where(F.lit(window) > 0).crossJoin(F.broadcast(features)).select(
        F.lit(-1).cast("bigint").alias("step"), F.lit(window).cast("bigint").alias("end"), "feature_idx")
    first = once.groupBy("feature_idx").agg(F.min("step").alias("first"))
    early = early.join(first, "feature_idx", "left").select("step", F.least(F.col("end"), F.coalesce("first", "end")).alias("end"))
    change = lambda df, c, by: df.select(F.col(c).cast("bigint").alias("step"), F.lit(by).alias("d"), F.lit(False).alias("real"))
    spans = alive.select("step", "end").unionByName(early)
    moved = change(spans, "step", 1).unionByName(change(spans, "end", -1)).unionByName(steps.select(F.col("step").cast("bigint"), F.lit(0).alias("d"), F.lit(True).alias("real")))
    # one row per step from here on
    running = moved.groupBy("step").agg(F.sum("d").alias("d"), F.bool_or("real").alias("real")).withColumn(
        "alive", F.sum("d").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).where("real")
    n = features.agg(F.count(F.lit(1)).alias("n"))
    return running.crossJoin(F.broadcast(n)).select("step", (F.col("n") - F.col("alive")).alias("n_dead"), ((F.col("n") - F.col("alive")) / F.col("n")).alias("dead_ratio"))


def discrimination(code: DataFrame, pairs: DataFrame, group: list[str], features: DataFrame, rotation: int) -> DataFrame:
    """(group, feature_idx, mean_b, mean_d, score): mean activation of own pairs minus rotated pairs.

    As defined by its formula; the rotation only permutes one side, so both means are equal
    up to rounding and the score is 0.  co_activation() is a measure that does tell them apart.
    pairs: (group, i, key_a, key_b), i dense in each group.
    """
    n = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    partner = pairs.select(*group, F.col("i").alias("j"), F.col("key_b").alias("key_d"))
    p = pairs.join(n, group).withColumn("j", F.pmod(F.col("i") + rotation, F.col("n"))).join(partner, [*group, "j"])
    long = p.select(*group, "n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cond"), F.col(k).alias("key")) for c, k in (("b", "key_a"), ("b", "key_b"), ("d", "key_a"), ("d", "key_d"))])).alias("s")).select(*group, "n", "s.*")
    sums = long.join(code, "key").groupBy(*group, "n", "feature_idx").agg(
        F.sum(F.when(F.col("cond") == "b", F.col("z")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("cond") == "d", F.col("z")).otherwise(0.0)).alias("d"))
    grid = n.crossJoin(F.broadcast(features))
    full = grid.join(sums.drop("n"), [*group, "feature_idx"], "left")
    mean = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / (2 * F.col("n"))
    return full.select(*group, "feature_idx", mean("b").alias("mean_b"), mean("d").alias("mean_d"), (mean("b") - mean("d")).alias("score"))


def co_activation(code: DataFrame, pairs: DataFrame, group: list[str], rotation: int) -> DataFrame:
    """(group, feature_idx, own, rotated, contrast): mean of the smaller activation of both sides."""
    n = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    partner = pairs.select(*group, F.col("i").alias("j"), F.col("key_b").alias("key_d"))
    p = pairs.join(n, group).withColumn("j", F.pmod(F.col("i") + rotation, F.col("n"))).join(partner, [*group, "j"])
    long = p.select(*group, "n", "key_a", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cond"), F.col(k).alias("key")) for c, k in (("own", "key_b"), ("rotated", "key_d"))])).alias("s")).select(*group, "n", "key_a", "s.*")
    a = code.select(F.col("key").alias("key_a"), "feature_idx", F.col("z").alias("za"))
    b = code.select("key", "feature_idx", F.col("z").alias("zb"))
    mean = lambda c: F.sum(F.when(F.col("cond") == c, F.least("za", "zb")).otherwise(0.0)) / F.first("n")
    m = long.join(a, "key_a").join(b, ["key", "feature_idx"]).groupBy(*group, "feature_idx").agg(mean("own").alias("own"), mean("rotated").alias("rotated"))
    return m.withColumn("contrast", F.col("own") - F.col("rotated"))


def top_per_group(df: DataFrame, group: list[str], score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows per group; equal scores in order of `tie`."""
    order = Window.partitionBy(*group).orderBy(score.desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_features(df: DataFrame, n: int, score: str, **equal) -> DataFrame:
    """The n best features among rows that match those filters whose column is there; fails when none is left."""
    for c, v in equal.items():
        if c in df.columns:
            df = df.where(F.col(c) == v)
    top = df.orderBy(F.desc(score), "feature_idx").limit(n)
    if top.isEmpty():
        raise ValueError("no features left after filtering")
    return top


def match(global_features: DataFrame, base_features: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """(key, id, value): for each global feature (key, v) the base feature (id, w) of the highest cosine."""
    g = global_features.select("key", unit(F.col("v")).alias("v"))
    b = base_features.select("id", unit(F.col("w")).alias("w"))
    return project_top_k(g, b, 1, digits=9, max_bytes=max_bytes).select("key", "id", "value")


def max_activating(acts: DataFrame, n: int) -> DataFrame:
    """The n highest rows per feature, from shards in which the feature is active at all.

    acts: (feature_idx, shard, pos, activation, ...), zero activations included or not.
    """
    alive = acts.withColumn("_m", F.max("activation").over(Window.partitionBy("feature_idx", "shard"))).where("_m > 0").drop("_m")
    order = Window.partitionBy("feature_idx").orderBy(F.col("activation").desc(), "shard", "pos")
    return alive.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def max_activating_rows(code: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """max_activating from a sparse code (feature_idx, key, shard, pos, z) and all rows (key, shard, pos).

    Rows without the feature count with 0.  They matter only to features with fewer than n
    active rows, and of these only the first 2n rows of a shard can be among the n.
    """
    order = Window.partitionBy("feature_idx").orderBy(F.col("activation").desc(), "shard", "pos")
    active = code.select("feature_idx", "key", "shard", "pos", F.col("z").alias("activation"))
    best = active.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")
    short = best.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < n).select("feature_idx")
    few = best.join(short, "feature_idx", "left_semi")  # all active rows of those features
    head = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard").orderBy("pos"))).where(F.col("_k") <= 2 * n).drop("_k")
    zero = few.select("feature_idx", "shard").distinct().join(head, "shard").join(few.select("feature_idx", "key"), ["feature_idx", "key"], "left_anti")
    full = best.unionByName(zero.select("feature_idx", "key", "shard", "pos", F.lit(0.0).alias("activation")))
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


class SparseAutoencoder:
    """Top-k autoencoder with an auxiliary loss for dead features, trained by Adam in NumPy.

    It sees a batch at a time; decoder columns keep unit norm after every step.
    """

    def __init__(self, hidden: int, size: int, k: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = rng.standard_normal((size, hidden))
        self.d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-8)
        self.w, self.b, self.c = self.d.copy(), np.zeros(size), np.zeros(hidden)
        self.k, self.step = k, 0
        self.last = np.full(size, -1)
        self._m = {n: np.zeros_like(getattr(self, n)) for n in "wdbc"}
        self._v = {n: np.zeros_like(getattr(self, n)) for n in "wdbc"}

    def encode(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.c) @ self.w.T + self.b, 0)
        cut = np.argsort(-z, axis=1, kind="stable")[:, self.k:]
        np.put_along_axis(z, cut, 0.0, 1)
        return z

    def decode(self, z: np.ndarray) -> np.ndarray:
        return z @ self.d + self.c

    def update(self, x: np.ndarray, lr: float = 1e-3, window: int = 200, aux_k: int = 64, aux: float = 0.03) -> dict:
        pre = (x - self.c) @ self.w.T + self.b
        z = self.encode(x)
        err = self.decode(z) - x
        mse = float((err**2).mean())
        g = 2 * err / err.size
        gz = (g @ self.d.T) * (z > 0)
        gd = z.T @ g
        dead = self.step - self.last > window
        if dead.any():  # the dead features explain what is left of the error
            some = np.flatnonzero(dead)
            za = np.maximum(pre[:, some], 0)
            if len(some) > aux_k:
                np.put_along_axis(za, np.argsort(-za, axis=1, kind="stable")[:, aux_k:], 0.0, 1)
            ga = aux * 2 * (za @ self.d[some] + err) / err.size
            gd[some] += za.T @ ga
            gz[:, some] += (ga @ self.d[some].T) * (za > 0)
        grads = {"w": gz.T @ (x - self.c), "b": gz.sum(axis=0), "d": gd, "c": g.sum(axis=0) - (gz @ self.w).sum(axis=0)}
        self.last[(z > 0).any(axis=0)] = self.step
        self.step += 1
        for n, grad in grads.items():
            self._m[n] = 0.9 * self._m[n] + 0.1 * grad
            self._v[n] = 0.999 * self._v[n] + 0.001 * grad**2
            m, v = self._m[n] / (1 - 0.9**self.step), self._v[n] / (1 - 0.999**self.step)
            setattr(self, n, getattr(self, n) - lr * m / (np.sqrt(v) + 1e-8))
        self.d /= np.maximum(np.linalg.norm(self.d, axis=1, keepdims=True), 1e-8)
        return {"recon_mse": mse, "num_dead": int(dead.sum()), "dead_ratio": float(dead.mean())}


def train(x: np.ndarray, size: int, k: int, batch: int, epochs: int, lr: float = 1e-3, seed: int = 0) -> tuple[SparseAutoencoder, list[dict]]:
    """A trained autoencoder and one metrics row per step; batches drop the remainder."""
    sae, rng, log = SparseAutoencoder(x.shape[1], size, k, seed), np.random.default_rng(seed), []
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for b in range(max(1, len(x) // batch)):
            m = sae.update(x[order[b * batch: (b + 1) * batch]], lr)
            log.append({"step": sae.step - 1, "epoch": epoch, "batch": b, **m})
    return sae, log


def train_log(vectors: DataFrame, size: int, k: int, batch: int, epochs: int, lr: float = 1e-3, seed: int = 0) -> DataFrame:
    """(step, epoch, batch, recon_mse, num_dead, dead_ratio): one row per step of a training over all vectors.

    vectors: (key, v), one row per key, v of one length.  Every epoch permutes all of them by
    minibatches().  Steps depend on each other, so one task takes the batches in order; they
    stream through it and it holds one batch and the model.
    """
    x = vectors.where("v is not null").select("key", F.col("v").cast("array<double>").alias("v"))
    plan = None
    for e in range(epochs):
        p = minibatches(x, "key", batch, epoch=e, seed=seed).withColumn("epoch", F.lit(e))
        plan = p if plan is None else plan.unionByName(p)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sae, held, at = None, [], None

        def step() -> pa.RecordBatch:
            nonlocal sae
            rows = np.concatenate(held)
            sae = sae or SparseAutoencoder(rows.shape[1], size, k, seed)
            m = sae.update(rows, lr)
            log = {"step": sae.step - 1, "epoch": at[0], "batch": at[1], **m}
            return pa.RecordBatch.from_pylist([log], schema=pa.schema([
                ("step", pa.int32()), ("epoch", pa.int32()), ("batch", pa.int32()), ("recon_mse", pa.float64()), ("num_dead", pa.int32()), ("dead_ratio", pa.float64())]))

        for b in parts:
            if not b.num_rows:
                continue
            rows = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            epoch, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("epoch", "batch"))
            start = np.flatnonzero(np.r_[True, (epoch[1:] != epoch[:-1]) | (number[1:] != number[:-1])])
            for lo, hi in zip(start, np.r_[start[1:], b.num_rows]):
                now = (int(epoch[lo]), int(number[lo]))
                if held and now != at:
                    yield step()
                    held = []
                at = now
                held.append(rows[lo:hi])
        if held:
            yield step()

    return plan.join(x, "key").repartition(1).sortWithinPartitions("epoch", "batch", "key").select("epoch", "batch", "v").mapInArrow(
        run, "step int, epoch int, batch int, recon_mse double, num_dead int, dead_ratio double")
