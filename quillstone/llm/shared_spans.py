"""Long spans that occur verbatim in more than one record.

Every window of a text is hashed (Rabin-Karp, modulo 2^64).  Of the windows of half the
span length the smallest hash of each run is an anchor: two texts with a common span of
min_chars have a common anchor inside it.  Spark counts the anchors; only around repeated
ones are the windows of min_chars hashed (128 bits) and counted.  Repeated windows merge
into maximal intervals.  Records are first brought to distinct texts by an aggregate, so
copies and re-delivered rows add no work and no result depends on where rows meet; no
list of owners is ever gathered: a set of owners travels as a signature that texts with
the same shared windows have in common.  Both hashing passes run once each, their results
are written to the shared folder.

Edge cases: null ids or texts and texts under min_chars share nothing (their share is 0);
a re-delivered record counts once; an id with several texts has all of them, and for its share
a span that two of its own texts have in common counts as shared; whole texts are read (a long
one by blocks that overlap by min_chars - 1) and line ends count as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import written

# Odd multipliers of the rolling and the mixing hash.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Windows hashed at once, whatever the length of the text.
BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of every window of `length` codes, from prefix sums of code * base^position."""
    n = len(codes)
    if n < length:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        power = np.full(n, base, np.uint64)
        back = np.full(n - length + 1, inverse, np.uint64)
        power[0] = back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(base)) * power, out=total[1:])
        return _mix((total[length:] - total[:-length]) * back)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchors(codes: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors; their choice depends on the window's content only."""
    k = min_chars // 2
    run = min_chars - k + 1
    h = window_hashes(codes, k)
    if len(h) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # sliding minimum by doubling; (hash, first position) decides
    best, width = np.arange(len(h)), 1
    while width < run:
        step = min(width, run - width)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    at = np.unique(best)
    return at, h[at]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _records(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    t = F.col(text_col)
    return df.where(F.col(id_col).isNotNull() & (F.length(t) >= min_chars)).select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"),
        t.alias("text"))


def _blocks(codes: np.ndarray, min_chars: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, part of codes): every window of min_chars lies in exactly one part."""
    for lo in range(0, max(1, len(codes) - min_chars + 1), BLOCK):
        yield lo, codes[lo: lo + BLOCK + min_chars - 1]


def _text_anchors(text: str, min_chars: int) -> np.ndarray:
    return np.unique(np.concatenate([_anchors(c, min_chars)[1] for _, c in _blocks(_codes(text), min_chars)]))


def _text_windows(text: str, repeated: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, start) of the windows around repeated anchors, in order of hash, then start."""
    out = []
    for lo, codes in _blocks(_codes(text), min_chars):
        at, h = _anchors(codes, min_chars)
        at = at[np.isin(h, repeated)]
        last = len(codes) - min_chars
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, np.clip(at - (min_chars - min_chars // 2), 0, last + 1), 1)
        np.add.at(edge, np.clip(at + 1, 0, last + 1), -1)
        start = np.flatnonzero(np.cumsum(edge)[: last + 1])
        out.append((*(window_hashes(codes, min_chars, i)[start] for i in (0, 1)), start + lo))
    h1, h2, start = (np.concatenate(x) for x in zip(*out))
    by = np.lexsort((start, h2, h1))
    return h1[by], h2[by], start[by]


def _texts(records: DataFrame) -> DataFrame:
    """(k1, k2, text, lo, hi): one row per distinct text with its first and last id; copies combine before the shuffle."""
    return records.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _shared_windows(records: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, starts, n, s1, s2): the windows of each distinct text that another distinct text has too."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [_text_anchors(t, min_chars) for t in part.column("text").to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(found)), part.column("k1").take(pa.array(at)), part.column("k2").take(pa.array(at))],
                        names=["anchor", "k1", "k2"])

    texts = _texts(records).select("k1", "k2", "text")
    marked = written(texts.mapInArrow(anchors, "anchor bigint, k1 bigint, k2 bigint"))
    pair = F.struct("k1", "k2")
    repeated = marked.groupBy("anchor").agg(F.min(pair).alias("a"), F.max(pair).alias("b")).where("a != b").select("anchor")
    wanted = marked.join(repeated, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"))  # of one text

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                h1, h2, start = _text_windows(row["text"], np.array(row["anchors"], np.int64).view(np.uint64), min_chars)
                if not len(start):
                    continue
                first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
                starts = pa.ListArray.from_arrays(pa.array(np.r_[first, len(start)].astype(np.int32)), pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [_signed(h1[first]), _signed(h2[first]), pa.array(np.full(len(first), row["k1"])), pa.array(np.full(len(first), row["k2"])), starts],
                    names=["h1", "h2", "k1", "k2", "starts"])

    found = written(texts.join(wanted, ["k1", "k2"]).mapInArrow(windows, "h1 bigint, h2 bigint, k1 bigint, k2 bigint, starts array<int>"))
    owners = found.groupBy("h1", "h2").agg(  # one row per window and text, so each owner counts once
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k1", "k2")).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(2), "k1", "k2")).alias("s2")).where("n > 1")
    return found.join(owners, ["h1", "h2"]).select("k1", "k2", "starts", "n", "s1", "s2")


def span_pairs(df: DataFrame, id_col: str, text_col: str, min_chars: int = 100) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different records with a common span of at least min_chars."""
    records = _records(df, id_col, text_col, min_chars)
    members = records.select("id", "k1", "k2").distinct()
    sets = written(_shared_windows(records, min_chars).select("k1", "k2", "n", "s1", "s2").distinct())
    a, b = sets.alias("a"), sets.alias("b")
    same_set = (F.col("a.n") == F.col("b.n")) & (F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2") == F.col("b.s2"))
    texts = a.join(b, same_set & (F.struct("a.k1", "a.k2") < F.struct("b.k1", "b.k2"))).select(
        F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")).distinct()
    left = members.select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    right = members.select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    across = texts.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).where("x != y").select("x", "y")
    equal = left.join(right, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def shared_intervals(df: DataFrame, id_col: str, text_col: str, min_chars: int = 100) -> DataFrame:
    """(id, k1, k2, start_char, end_char): maximal intervals of each record's text that occur in another record."""
    records = _records(df, id_col, text_col, min_chars)
    members = records.select("id", "k1", "k2", F.length("text").alias("n_chars")).distinct()
    # a text owned by several ids is shared from end to end
    copied = members.groupBy("k1", "k2", "n_chars").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    windows = _shared_windows(records, min_chars)
    covered = windows.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = np.array(row["s"], np.int64)
                new = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + min_chars])
                yield pa.RecordBatch.from_pydict({
                    "k1": np.full(len(new), row["k1"]), "k2": np.full(len(new), row["k2"]),
                    "start_char": s[new].astype(np.int32),
                    "end_char": (s[np.r_[new[1:] - 1, len(s) - 1]] + min_chars).astype(np.int32)})

    spans = covered.mapInArrow(merge, "k1 bigint, k2 bigint, start_char int, end_char int")
    whole = copied.where("lo != hi").select("k1", "k2", F.lit(0).alias("start_char"), F.col("n_chars").alias("end_char"))
    spans = spans.join(whole.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(whole)
    return members.join(spans, ["k1", "k2"]).select("id", "k1", "k2", "start_char", "end_char")


def shared_share(df: DataFrame, id_col: str, text_col: str, min_chars: int = 100) -> DataFrame:
    """(id, n_chars, shared_chars, shared_share): one row per record; several texts of one id add up."""
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("k2"),
        F.length(text_col).alias("n")).distinct().groupBy("id").agg(F.sum("n").alias("n_chars"))
    spans = shared_intervals(df, id_col, text_col, min_chars).groupBy("id").agg(
        F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return texts.join(spans, "id", "left").select(
        "id", "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
