"""Pieces of bounded length, cut at natural boundaries, with an overlap.

Every position of a text has a boundary strength.  A sparse table answers, for a range
of positions, which is the strongest (the rightmost of equals); each piece ends at the
answer for its permissible window, and the next one begins about `overlap` characters
before, again at the strongest boundary near there.

Edge cases: null and empty texts and texts within the limit give one piece or, where only
oversized items are asked for, none; repeated rows (same id and text) give one set of
pieces; an id with several texts gives a set for each, told apart by text_hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters of each kind of boundary, weakest kind first.
_CLAUSE = ",;:،؛、，；："
_SENTENCE = ".!?。！？؟…।"
_CLOSING = "\"'”’)]}»」』）】"
_SPACE = " \t               　"
_LINE = "\n\r\u0085  "


def _one_of(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], np.uint32))


def strengths(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut after each character: 0 inside a word, 1 space, 2 clause, 3 sentence, 4 line, 5 paragraph.

    -1 where a cut would part a character from its mark or joiner.
    """
    n = len(codes)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    space, line = _one_of(codes, _SPACE), _one_of(codes, _LINE)
    blank = space | line
    clause, sentence, closing = (_one_of(codes, c) for c in (_CLAUSE, _SENTENCE, _CLOSING))
    wide = codes >= 0x2E80  # scripts written without spaces end a sentence without one
    out[space] = 1
    # the mark before a space (or, in scripts without spaces, the mark itself) decides
    behind = lambda flag: np.r_[False, flag[:-1]]
    ends = sentence | closing & behind(sentence)
    out[space & behind(clause)] = 2
    out[clause & wide] = 2
    out[space & behind(ends)] = 3
    out[ends & wide] = 3
    out[line] = 4
    again = line & behind(line) & ~((codes == 10) & behind(codes == 13))
    out[again] = 5
    # a break of several blanks is cut at its end
    out[:-1][blank[1:] & ~line[1:] & blank[:-1]] = np.minimum(out[:-1], 1)[blank[1:] & ~line[1:] & blank[:-1]]
    out[:-1][line[1:]] = 0
    mark = (codes >= 0x300) & (codes <= 0x36F) | (codes >= 0xFE00) & (codes <= 0xFE0F) | (codes == 0x200D) | (codes >= 0x1160) & (codes <= 0x11FF) | (codes == 0x3099) | (codes == 0x309A)
    out[:-1][mark[1:] | (codes[:-1] == 0x200D)] = -1
    return out


class RangeMax:
    """Sparse table: position of the largest value in a range, the rightmost of equals."""

    def __init__(self, values: np.ndarray, widest: int):
        n = max(1, len(values))
        self.n = n
        level = (values.astype(np.int64) + 1) * n + np.arange(len(values))
        self.levels = [level]
        while 2 << (len(self.levels) - 1) <= min(widest, n):
            half = 1 << (len(self.levels) - 1)
            level = np.maximum(level[:-half], level[half:])
            self.levels.append(level)

    def best(self, lo: int, hi: int) -> int:
        """For lo <= position < hi."""
        k = (hi - lo).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k)]) % self.n)


def cut(text: str, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the pieces; a piece before the last has at least `least` of the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    # the slack around the overlap, and pieces long enough to move forward
    slack = overlap // 4
    shortest = max(int(limit * least), overlap + slack + 1)
    if shortest >= limit:
        raise ValueError("overlap must leave room below the limit")
    strength = strengths(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    block, low, table = 64 * limit, 0, None

    def best(lo: int, hi: int) -> int:
        nonlocal low, table  # the index covers a block around the place reached, not the whole text
        if table is None or lo < low or hi > low + block:
            low = lo
            table = RangeMax(strength[low: low + block], limit)
        return low + table.best(lo - low, hi - low)

    out, start = [], 0
    while n - start > limit:
        end = best(start + shortest - 1, start + limit) + 1
        out.append((start, end))
        start = best(end - overlap - slack - 1, end - overlap + slack) + 1 if overlap else end
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 200,
                    only_oversized: bool = True) -> DataFrame:
    """(id, text_hash, piece_no, n_pieces, start_char, end_char, piece), pieces numbered from 0.

    piece = text[start_char:end_char]; consecutive pieces overlap by about `overlap`
    characters and together hold every character of the text.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    if only_oversized:
        rows = rows.where(F.length(text_col) > limit)
    rows = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.dropDuplicates(["id", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                at, out = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    spans = cut(text, limit, overlap)
                    at += [i] * len(spans)
                    out += [(k, len(spans), s, e, text[s:e]) for k, (s, e) in enumerate(spans)]
                if out:
                    cols = list(zip(*out))
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take), part.column("text_hash").take(take),
                         *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                        names=["id", "text_hash", "piece_no", "n_pieces", "start_char", "end_char", "piece"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"id {kind}, text_hash bigint, piece_no int, n_pieces int, start_char int, end_char int, piece string")
