"""Most similar vectors for every vector (cosine), through robust-pruned graphs.

Every group is cut into shards of about shard_rows around centroids fitted on a bounded
sample; groups of less share tasks.  One task builds the proximity graph of one shard and
answers, by beam search, the vectors at home in it and those that look in from outside:
a vector looks into every shard whose border is at most `margin` away from it, however
many these are (into all of its group without a margin).  A near pair on both sides of a border is found from either side.

Edge cases: vectors that are null, of another length, with a null, NaN or infinite
element, or all zero are unusable and take no part.  Null group columns form a group
of their own, as in GROUP BY.  A re-delivered id counts once; if its deliveries
differ, the best cosine over them holds.  Exact copies are neighbours of cosine 1;
of more copies than k, any k may be returned.  An empty table gives an empty result.
Only the named columns are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .proximity_graph import ProximityGraph

_ROUTED = "shard int, home boolean, grp string, id bigint, tag string, other bigint, vec binary"
_FOUND = "grp string, id bigint, neighbour bigint, neighbour_tag string, cosine double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as float64 rows and their positions in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = column.take(pa.array(at)).flatten() if len(at) else pa.array([], pa.float32())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _centroids(x: np.ndarray, rows_each: float, limit: float, seed: int = 11) -> np.ndarray:
    """Spherical k-means on a sample, by levels of at most 64 cells, until a cell stands for `limit` rows at most.

    rows_each: how many rows a sampled one stands for.
    """
    count = min(64, len(x), int(np.ceil(len(x) * rows_each / limit)))
    if count < 2:
        return _unit(x.mean(axis=0, dtype=np.float64, keepdims=True) + 1e-12).astype(np.float32)
    c = x[np.random.default_rng(seed).permutation(len(x))[:count]]
    for _ in range(6):
        own = np.concatenate([(x[lo: lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-20), c)
    size = np.bincount(own, minlength=count)
    if size.max() == len(x):  # copies of one vector can't be told apart
        return c[size > 0]
    return np.concatenate([
        c[i: i + 1] if size[i] * rows_each <= 1.5 * limit else _centroids(x[own == i], rows_each, limit, seed + 1) for i in np.flatnonzero(size)])


def _shards_of(x: np.ndarray, c: np.ndarray, margin: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): the shard of the nearest centroid, and those whose border is at most `margin` away."""
    sims = x @ c.T
    home = sims.argmax(axis=1)
    if margin is None:
        r = np.repeat(np.arange(len(x)), len(c))
        shard = np.tile(np.arange(len(c)), len(x))
        return r, shard, shard == home[r]
    between = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))  # distance of unit centroids
    near = sims[np.arange(len(x)), home][:, None] - sims <= margin * between
    near[np.arange(len(x)), home] = True
    r, shard = np.nonzero(near)
    return r, shard, shard == home[r]


def nearest_neighbours(
    df: DataFrame, id_col: str, vec_col: str, group_cols: list[str], *, tag_col: str | None = None, k: int = 5,
    min_cosine: float | None = None, dim: int = 48, degree: int = 32, beam: int = 48, search_beam: int = 96,
    shard_rows: int = 16_000, margin: float | None = None, sample_per_shard: int = 64, max_shards: int = 8192,
) -> DataFrame:
    """(grp, id, neighbour, neighbour_tag, cosine, rank): at most k neighbours of each usable vector.

    The driver holds sample_per_shard rows for each of at most max_shards shards while it
    fits the centroids (the sample is bounded by these two parameters); the centroids, about
    max_shards vectors, are what tasks receive.  Every row is indexed.  Past max_shards *
    shard_rows rows the shards grow instead of their number.  margin is in units of the
    distance between unit vectors: a pair at distance d that a border separates has a side
    at most d / 2 away from it, and far less in most directions.  Without one, every vector
    looks into every shard of its group.  With min_cosine, insertions
    into a graph are the searches of the vectors at home, and search_beam serves those from outside.
    """
    spark = df.sparkSession
    grp: Column = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in group_cols])
    base = df.select(
        grp.alias("grp"), F.col(id_col).cast("bigint").alias("id"),
        (F.col(tag_col).cast("string") if tag_col else F.lit(None).cast("string")).alias("tag"),
        F.col(vec_col).alias("vec"),
    ).where("id is not null")
    sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total, groups = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    rows = max(shard_rows, -(-total // max_shards))
    large = {r.grp: r.n for r in sizes.where(F.col("n") > rows).collect()}  # at most total / rows
    model: dict[str, tuple[int, np.ndarray]] = {}
    shards = 0
    if large:
        share = min(1.0, sample_per_shard / rows)
        sample = (
            base.where(F.col("grp").isin(list(large)) if len(large) < 200 else F.lit(True))
            .where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
            .select("grp", "vec").toArrow()
        )
        names = np.array(sample["grp"].to_pylist(), dtype=object)
        x, at = _matrix(sample["vec"], dim)
        x = _unit(x).astype(np.float32) if len(x) else x
        for name in sorted(large):
            own = x[names[at] == name]
            if len(own) < 2:  # next to no usable vectors
                continue
            c = _centroids(own, 1 / share, rows)
            model[name] = (shards, c)
            shards += len(c)
    rest = total - sum(large[n] for n in model)
    small = max(1, min(-(-rest // rows), groups - len(model)))
    n_parts = shards + small
    held = spark.sparkContext.broadcast(model)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        hot: dict[tuple[str, bytes], list[int]] = {}
        for b in batches:
            x, at = _matrix(b.column("vec"), dim)
            if not len(at):
                continue
            x = _unit(x).astype(np.float32)
            names = np.array(b.column("grp").to_pylist(), dtype=object)[at]
            ids = b.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64)
            tags = np.array(b.column("tag").to_pylist(), dtype=object)[at]
            # exact copies beyond k + 1 need no index entry: their neighbours are known here
            code = np.unique(names.astype(str), return_inverse=True)[1].astype(np.int64)
            raw = np.ascontiguousarray(np.concatenate([x.view(np.int32), code[:, None].astype(np.int32)], axis=1))
            kind = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 4))).ravel(), return_inverse=True)[1]
            keep = np.ones(len(ids), bool)
            answers: list[tuple[int, int]] = []
            for u in np.flatnonzero(np.bincount(kind) > k + 1) if not hot else range(kind.max() + 1):
                rows_ = np.flatnonzero(kind == u)
                if hot and (names[rows_[0]], x[rows_[0]].tobytes()) not in hot and len(rows_) <= k + 1:
                    continue
                key = (names[rows_[0]], x[rows_[0]].tobytes())
                first: dict[int, int] = {}
                for r in rows_:
                    first.setdefault(int(ids[r]), int(r))
                keep[rows_] = False
                if key in hot:
                    surplus = sorted(set(first) - set(hot[key][0]))
                elif len(first) > k + 1:
                    reps = sorted(first)[: k + 1]
                    hot[key] = (reps, [tags[first[i]] for i in reps])
                    keep[[first[i] for i in reps]] = True
                    surplus = sorted(first)[k + 1:]
                else:
                    keep[list(first.values())] = True
                    surplus = []
                answers += [(first[i], j) for i in surplus for j in range(k)]
            if answers:
                src = [r for r, _ in answers]
                keys = [hot[(names[r], x[r].tobytes())] for r in src]
                yield pa.RecordBatch.from_arrays([
                    pa.array((ids[src] % n_parts).astype(np.int32)), pa.array([True] * len(src)),
                    pa.array(names[src], pa.string()), pa.array(ids[src]),
                    pa.array([h[1][j] for h, (_, j) in zip(keys, answers)], pa.string()),
                    pa.array([h[0][j] for h, (_, j) in zip(keys, answers)], pa.int64()),
                    pa.nulls(len(src), pa.binary()),
                ], names=["shard", "home", "grp", "id", "tag", "other", "vec"])
            x, names, ids, tags = x[keep], names[keep], ids[keep], tags[keep]
            if not len(ids):
                continue
            for name in sorted(set(names.tolist())):
                mine = np.flatnonzero(names == name)
                start, c = held.value.get(name, (shards + zlib.crc32(name.encode()) % small, None))
                step = 4096 if c is None else max(1, (1 << 20) // len(c))
                for lo in range(0, len(mine), step):
                    r = mine[lo: lo + step]
                    if c is None:
                        shard, home = np.zeros(len(r), np.int64), np.ones(len(r), bool)
                    else:
                        row, shard, home = _shards_of(x[r], c, margin)
                        r = r[row]
                    for at_ in range(0, len(r), 4096):  # batches of one size, however many shards are looked into
                        part = slice(at_, at_ + 4096)
                        raw = np.ascontiguousarray(x[r[part]])
                        n = len(raw)
                        offsets = np.arange(n + 1, dtype=np.int32) * (dim * 4)
                        vecs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays([
                            pa.array((start + shard[part]).astype(np.int32)), pa.array(home[part]), pa.array(names[r[part]], pa.string()),
                            pa.array(ids[r[part]]), pa.array(tags[r[part]], pa.string()), pa.nulls(n, pa.int64()), vecs,
                        ], names=["shard", "home", "grp", "id", "tag", "other", "vec"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows at home come first; those that only look here stream past the finished graph
        batches = iter(batches)
        got, late = [], []
        for b in batches:
            own = np.count_nonzero(b.column("home").to_numpy(zero_copy_only=False))
            if own:
                got.append(b.slice(0, own))
            if own < b.num_rows:
                late.append(b.slice(own))
                break
        if not got:
            deque(batches, maxlen=0)
            return
        t = pa.Table.from_batches(got)
        known = t.filter(pa.compute.is_valid(t["other"]))
        for b in known.to_batches():
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("id"), b.column("other"), b.column("tag"), pa.array(np.ones(b.num_rows))],
                names=["grp", "id", "neighbour", "neighbour_tag", "cosine"])
        t = t.filter(pa.compute.is_null(t["other"]))
        if not t.num_rows:
            deque(batches, maxlen=0)
            return
        vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(-1, dim)
        ids = t["id"].to_numpy()
        tags, names = np.array(t["tag"].to_pylist(), dtype=object), np.array(t["grp"].to_pylist(), dtype=object)

        def pick(name, q_id, q_vec, r, to, q_tag=None):
            """The k best of the candidates `to` of queries r, by exact cosine, then id; with q_tag also the way back."""
            real = (to >= 0) & (ids[np.maximum(to, 0)] != q_id[r])
            r, to = r[real], to[real]
            a, b = q_vec[r].astype(np.float64), vec[to].astype(np.float64)
            cos = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            if min_cosine is not None:
                ok = cos >= min_cosine
                r, to, cos = r[ok], to[ok], cos[ok]
            if q_tag is not None and len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(r), pa.string()), pa.array(ids[to]), pa.array(q_id[r]), pa.array(q_tag[r], pa.string()), pa.array(cos)],
                    names=["grp", "id", "neighbour", "neighbour_tag", "cosine"])
            by = np.lexsort((ids[to], -cos, r))
            r, to, cos = r[by], to[by], cos[by]
            if len(r):
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                best = rank < k
                r, to, cos = r[best], to[best], cos[best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(r), pa.string()), pa.array(q_id[r]), pa.array(ids[to]),
                     pa.array(tags[to], pa.string()), pa.array(cos)],
                    names=["grp", "id", "neighbour", "neighbour_tag", "cosine"])

        for name in sorted(set(names.tolist())):
            inside = np.flatnonzero(names == name)
            # one entry per (id, vector), by id; then one point per distinct vector
            inside = inside[np.lexsort((inside, ids[inside]))]
            points, point_of = np.unique(vec[inside], axis=0, return_inverse=True)
            point_of = point_of.ravel()
            pair = np.unique(np.stack([point_of, ids[inside]], axis=1), axis=0, return_index=True)[1]
            inside, point_of = inside[pair], point_of[pair]  # sorted by point, then id
            begin = np.searchsorted(point_of, np.arange(len(points)))
            rank = np.arange(len(inside)) - begin[point_of]
            wide = min(int(rank.max()) + 1, k + 1)
            member = np.full((len(points) + 1, wide), -1, np.int64)
            fits = rank < wide
            member[point_of[fits], rank[fits]] = inside[fits]
            floor = None if min_cosine is None else min_cosine - 1e-5  # float32 sums; the exact test follows
            graph = ProximityGraph(points, degree=degree, beam=beam, min_sim=floor)
            if floor is not None:  # every insertion was a search: what the insertions met is the answer
                a, b = graph.pairs()
                a, b = np.concatenate([a, np.arange(len(points))]), np.concatenate([b, np.arange(len(points))])
                by = np.argsort(a, kind="stable")
                a, b = a[by], b[by]
                count = np.searchsorted(a, np.arange(len(points)), "right") - np.searchsorted(a, np.arange(len(points)))
                some = np.flatnonzero((count[point_of] > 1) | (np.bincount(point_of)[point_of] > 1))
                for lo in range(0, len(some), 4096):
                    q = inside[some[lo: lo + 4096]]
                    p = point_of[some[lo: lo + 4096]]
                    first = np.searchsorted(a, p)
                    r = np.repeat(np.arange(len(q)), count[p])
                    to_point = b[np.repeat(first - np.r_[0, np.cumsum(count[p])[:-1]], count[p]) + np.arange(len(r))]
                    cand = member[to_point]
                    r = np.repeat(r, cand.shape[1])
                    yield from pick(name, ids[q], vec[q], r, cand.ravel())
                continue
            for lo in range(0, len(inside), 4096):
                q = inside[lo: lo + 4096]
                o = point_of[lo: lo + 4096].astype(np.int32)
                near = np.concatenate([o[:, None], graph.search(vec[q], search_beam, block=o)[1][:, : k + 1]], axis=1)
                cand = member[near].reshape(len(q), -1)
                yield from pick(name, ids[q], vec[q], np.repeat(np.arange(len(q)), cand.shape[1]), cand.ravel())
        for b in chain(late, batches):  # a shard of a large group holds nothing else
            q_vec = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(-1, dim)
            q_id = b.column("id").to_numpy()
            q_tag = None if min_cosine is None else np.array(b.column("tag").to_pylist(), dtype=object)
            for lo in range(0, len(q_id), 4096):
                v = q_vec[lo: lo + 4096]
                cand = member[graph.search(v, search_beam)[1][:, : k + 1]].reshape(len(v), -1)
                yield from pick(name, q_id[lo: lo + 4096], v, np.repeat(np.arange(len(v)), cand.shape[1]), cand.ravel(),
                                None if q_tag is None else q_tag[lo: lo + 4096])

    routed = base.mapInArrow(route, _ROUTED).repartitionById(n_parts, F.col("shard"))
    if shards:
        routed = routed.sortWithinPartitions(F.desc("home"))
    found = routed.mapInArrow(search, _FOUND)
    best = found.groupBy("grp", "id", "neighbour").agg(
        F.max("cosine").alias("cosine"), F.min("neighbour_tag").alias("neighbour_tag"))
    order = Window.partitionBy("grp", "id").orderBy(F.col("cosine").desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "grp", "id", "neighbour", "neighbour_tag", "cosine", "rank")
