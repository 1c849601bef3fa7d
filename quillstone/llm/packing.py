"""Filling containers of fixed capacity, and cutting the length range into buckets.

Both work on the histogram of item lengths, at most one entry per length up to the
capacity, so the plan is made on the driver whatever the number of items; items then
find their place by their rank among items of their length.

* length_buckets: dynamic programming over the histogram chooses the bucket boundaries
  with the fewest containers when a container holds items of one bucket, each padded to
  its boundary.  Items above half the capacity then sit alone.
* pack_plan: best fit, longest first, over the histogram.  An item joins the container
  whose room it fills best; whole ranges of equal containers are filled at a time.

Edge cases: items of 0 tokens (null, empty text) fill no container and get none; an item
above the capacity gives full pieces and a remainder that is packed like an item; equal
lengths are told apart by a hash of the id, then the id; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_buckets(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = 16) -> list[int]:
    """Upper boundaries, ascending, of at most `buckets` buckets with the fewest containers."""
    n = len(lengths)
    if not n:
        return []
    total = np.r_[0, np.cumsum(counts)].astype(float)
    each = 1.0 / (capacity // lengths)  # containers per item of a bucket that ends here
    rate, kind = np.unique(each, return_inverse=True)
    best = np.r_[0.0, np.full(n, np.inf)]
    back: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0.0
        for r, w in enumerate(rate):
            value = best - total * w
            low = np.minimum.accumulate(value)
            at = np.maximum.accumulate(np.where(value <= low, np.arange(n + 1), 0))
            ends = np.flatnonzero(kind == r) + 1
            new[ends] = low[ends - 1] + total[ends] * w
            came[ends] = at[ends - 1]
        back.append(came)
        if new[n] >= best[n] - 1e-9:
            back.pop()
            break
        best = new
    out, end = [], n
    for came in reversed(back):
        if end == 0:
            break
        out.append(int(lengths[end - 1]))
        end = int(came[end])
    return sorted(out)


def pack_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Rows (length, rank_from, rank_to, per, first): items of `length` with rank in
    [rank_from, rank_to) go to container first + (rank - rank_from) // per."""
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first container, how many)
    rooms: list[int] = []
    plan, next_ = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, many))

    for length, left in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        rank = 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = min(capacity // length, left)
                many = left // per
                first, room, next_ = next_, capacity, next_ + many
            else:
                room = rooms[i]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                per = min(room // length, left)
                use = min(many, left // per)
                put(room, first + use, many - use)
                many = use
            plan.append((length, rank, rank + many * per, per, first))
            rank += many * per
            left -= many * per
            put(room - per * length, first, many)
    return pd.DataFrame(plan, columns=["length", "rank_from", "rank_to", "per", "first"])


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, piece_no, n_tokens, full): full pieces of exactly the capacity, and the rest."""
    whole = F.floor(F.col("n_tokens") / capacity)
    parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    return sizes.where("n_tokens > 0").select("id", "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece_no"), whole.alias("w")).select(
        "id", "piece_no", F.when(F.col("piece_no") < F.col("w"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("w") * capacity).cast("bigint").alias("n_tokens"))


def _ranked(pieces: DataFrame, most: int, carry: list[str] = (), part_rows: int = 200_000) -> DataFrame:
    """rank of each piece among those of its length; the most frequent one has `most` pieces and is ranked in parts of about part_rows."""
    parts = max(16, -(-most // part_rows))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece_no"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("c")).select(
        "n_tokens", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"))  # a row per length and part
    inside = Window.partitionBy("n_tokens", "part").orderBy(F.xxhash64("id", "piece_no"), "id", "piece_no")
    return salted.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["n_tokens", "part"]).select(
        "id", "piece_no", "n_tokens", *carry, (F.col("skip") + F.col("n")).alias("rank"))


def _histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    h = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).orderBy("n_tokens").toPandas()  # at most capacity rows
    return h["n_tokens"].to_numpy(np.int64), h["c"].to_numpy(np.int64)


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, piece_no, n_tokens, container_id) for sizes (id, n_tokens)."""
    spark = sizes.sparkSession
    pieces = _pieces(sizes, capacity)
    lengths, counts = _histogram(pieces)
    plan = pack_plan(lengths, counts, capacity)
    held = spark.sparkContext.broadcast({
        int(k): g[["rank_from", "per", "first"]].to_numpy(np.int64) for k, g in plan.groupby("length")})

    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), np.int64)
        for k, at in length.groupby(length).indices.items():
            table, r = held.value[int(k)], rank.to_numpy()[at]
            row = table[np.searchsorted(table[:, 0], r, "right") - 1]
            out[at] = row[:, 2] + (r - row[:, 0]) // row[:, 1]
        return pd.Series(out)

    where = F.pandas_udf(place, "bigint")
    return _ranked(pieces, int(counts.max(initial=0))).select("id", "piece_no", "n_tokens", where("n_tokens", "rank").alias("container_id"))


def bucket_batches(sizes: DataFrame, capacity: int, buckets: int = 16) -> DataFrame:
    """(id, piece_no, n_tokens, bucket, batch_no): batches of one bucket, each item padded to its boundary."""
    pieces = _pieces(sizes, capacity)
    lengths, counts = _histogram(pieces)
    bounds = length_buckets(lengths, counts, capacity, buckets)
    if not bounds:
        return pieces.select("id", "piece_no", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("batch_no")).limit(0)
    upper = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds])
    most = int(np.bincount(np.searchsorted(bounds, lengths), weights=counts).max())
    ranked = _ranked(pieces.select("id", "piece_no", F.col("n_tokens").alias("size"), upper.alias("n_tokens")), most, ["size"])
    return ranked.select(
        "id", "piece_no", F.col("size").alias("n_tokens"), F.col("n_tokens").alias("bucket"),
        F.floor(F.col("rank") / F.floor(F.lit(capacity) / F.col("n_tokens"))).alias("batch_no"))
