"""A piece tokenizer: the longest piece that comes next, single bytes where none does.

Edge cases: null text has null tokens, empty text none; a vocabulary without byte pieces
gives the id -1 for a byte; of equal pieces the lowest id counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PieceTokenizer:
    def __init__(self, pieces: dict[int, str]):
        self.text = dict(pieces)
        self.byte_id: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        for i in sorted(pieces, reverse=True):
            p = pieces[i]
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.byte_id[int(p[3:5], 16)] = i
            elif p:
                self.ids[p] = i
        longest: dict[str, int] = {}
        for p in self.ids:
            longest[p[0]] = max(longest.get(p[0], 0), len(p))
        self.longest = longest

    def encode(self, text: str) -> list[int]:
        out, at, ids = [], 0, self.ids
        while at < len(text):
            for n in range(self.longest.get(text[at], 0), 0, -1):
                found = ids.get(text[at: at + n])
                if found is not None:
                    out.append(found)
                    at += n
                    break
            else:
                out += [self.byte_id.get(b, -1) for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    def decode(self, ids: list[int]) -> str:
        back = {i: bytes([b]) for b, i in self.byte_id.items()}
        return b"".join(back[i] if i in back else self.text[i].encode() for i in ids).decode()


def piece_tokenizer(vocabulary: DataFrame, max_pieces: int = 500_000) -> PieceTokenizer:
    """From (token_id, piece); a vocabulary is a fixed list, and its size is checked."""
    rows = vocabulary.select("token_id", "piece").where("piece is not null").distinct().limit(max_pieces + 1).collect()
    if len(rows) > max_pieces:
        raise ValueError("vocabulary above max_pieces")
    return PieceTokenizer({r.token_id: r.piece for r in sorted(rows)})


def token_ids(text: Column, vocabulary: DataFrame) -> Column:
    """ARRAY<BIGINT>: the ids of a text's tokens, whole texts in Arrow batches."""
    held = vocabulary.sparkSession.sparkContext.broadcast(piece_tokenizer(vocabulary))

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(held.value.encode, na_action="ignore")

    return run(text)
