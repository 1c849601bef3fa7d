"""Text measures as expressions and plans."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it.
BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def squashed(t: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(stripped(t), f"{BLANK}+", " ")


def script_ratio(t: Column, side: Column) -> Column:
    """Share of letters that are kana or Han (JA) or Hangul syllables (KO); 0 without letters or for other sides."""
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    ja = F.regexp_count(t, F.lit(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}&&\p{L}]"))
    ko = F.regexp_count(t, F.lit(r"[\x{ac00}-\x{d7af}&&\p{L}]"))
    hits = F.when(side == "JA", ja).when(side == "KO", ko).otherwise(F.lit(0))
    return F.when(letters > 0, hits / letters).otherwise(F.lit(0.0))


def is_json(t: Column) -> Column:
    """1.0 for a text that json.loads takes, else 0.0 (also where it fails in another way, as by depth)."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def ok(x):
            try:
                json.loads(x)
                return 1.0
            except (ValueError, RecursionError):
                return 0.0

        return s.map(ok, na_action="ignore").astype("float64")

    return run(t)


def _gram_scores(p: list[str], r: list[str], max_n: int, beta: float) -> np.ndarray:
    """The F-score of each pair of texts that aren't empty; n-grams get whole numbers, order by order, for all pairs at once."""
    m = len(p)
    size = np.array([len(t) for t in p] + [len(t) for t in r], np.int64)
    codes = np.frombuffer("".join(p + r).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(2 * m), size)
    pair, other = text % m, text >= m
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the end of the text
    char = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    gram = np.unique(pair * (char.max() + 1) + char, return_inverse=True)[1].astype(np.int64)
    orders, precision, recall = np.zeros(m), np.zeros(m), np.zeros(m)
    at = np.arange(len(codes))
    for n in range(1, max_n + 1):
        if n > 1:
            keep = left[at] >= n
            at, gram = at[keep], gram[keep]
            if not len(at):
                break
            gram = np.unique(gram * (char.max() + 1) + char[at + n - 1], return_inverse=True)[1].astype(np.int64)
        a = np.bincount(gram[~other[at]], minlength=gram.max() + 1)
        b = np.bincount(gram[other[at]], minlength=gram.max() + 1)
        of = np.zeros(len(a), np.int64)
        of[gram] = pair[at]
        hit, na, nb = (np.bincount(of, weights=x, minlength=m) for x in (np.minimum(a, b), a, b))
        both = (na > 0) & (nb > 0)
        orders += both
        precision[both] += hit[both] / na[both]
        recall[both] += hit[both] / nb[both]
    precision, recall = precision / np.maximum(orders, 1), recall / np.maximum(orders, 1)
    below = beta * beta * precision + recall
    return np.where(below > 0, (1 + beta * beta) * precision * recall / np.where(below > 0, below, 1), 0.0)


def char_f_score(prediction: Column, reference: Column, max_n: int = 6, beta: float = 2.0, chars: int = 1 << 20) -> Column:
    """Character n-gram F-score of each pair; blank or null sides score 0.

    A score depends on its pair only, so the grams are counted where the row is: in parts of
    an Arrow batch of about `chars` characters (a longer pair is a part of its own).
    """

    @F.pandas_udf("double")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        out = np.zeros(len(p))
        p, r = p.to_numpy(), r.to_numpy()
        part, held = [], 0
        for i in range(len(p)):
            if p[i] and r[i]:
                part.append(i)
                held += len(p[i]) + len(r[i])
            if part and (held >= chars or i == len(p) - 1):
                out[part] = _gram_scores([p[j] for j in part], [r[j] for j in part], max_n, beta)
                part, held = [], 0
        return pd.Series(out)

    return run(squashed(F.coalesce(prediction, F.lit(""))), squashed(F.coalesce(reference, F.lit(""))))


def char_f_scores(pairs: DataFrame, key: str, prediction: str, reference: str, max_n: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf): char_f_score of each row."""
    return pairs.select(F.col(key), char_f_score(F.col(prediction), F.col(reference), max_n, beta).alias("chrf"))
