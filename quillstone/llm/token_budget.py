"""Token counts under an existing tokenizer, estimated for every record, and their totals.

The tokenizer is greedy: the longest piece that matches next, single bytes where none
does.  A bounded sample of records is tokenized; on two thirds of it a ridge regression
per language is fitted (tokens from bytes, words, digits, punctuation and characters of
each script), drawn towards the regression over all languages; the other third corrects
the bias of each language in each record set.  The sample is drawn by record set and
language, so that a rare language has its share of labels.  The estimate then runs over every record in one pass.

Edge cases: null, empty and blank text is estimated like any other (null and empty: 0);
null, `und` or unknown languages are `und`; spellings of one language or source count as
one; a re-delivered record counts once, its latest delivery; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Three-letter language codes by their two-letter code.
LANGUAGES = {
    "ar": ("arb", "ara"), "de": ("deu", "ger"), "en": ("eng",), "es": ("spa",), "fr": ("fra", "fre"), "id": ("ind",),
    "ja": ("jpn",), "ko": ("kor",), "th": ("tha",), "vi": ("vie",), "zh": ("cmn", "zho", "chi"),
}
# First code point and class of the ranges told apart; classes are named below.
_RANGES = (
    (0x30, 1), (0x3A, 2), (0x41, 3), (0x5B, 2), (0x61, 4), (0x7B, 2), (0x7F, 0), (0xA1, 2), (0xC0, 5), (0x250, 12), (0x300, 5),
    (0x370, 12), (0x400, 12), (0x600, 6), (0x660, 1), (0x66A, 6), (0x700, 12), (0xE00, 7), (0xE80, 12), (0x1100, 11),
    (0x1200, 12), (0x1E00, 5), (0x1F00, 12), (0x2000, 2), (0x2070, 12), (0x2E80, 8), (0x3000, 2), (0x3040, 9), (0x30A0, 10),
    (0x3100, 12), (0x3130, 11), (0x3190, 12), (0x3400, 8), (0xA000, 12), (0xAC00, 11), (0xD7B0, 12), (0xF900, 8),
    (0xFB00, 12), (0xFF00, 2), (0xFF10, 1), (0xFF1A, 12), (0x20000, 8), (0x30000, 12), (0x110000, 12),
)
CLASSES = ("space", "digit", "punctuation", "upper", "latin", "latin_marked", "arabic", "thai", "han", "hiragana",
           "katakana", "hangul", "other")
FEATURES = ("records", "bytes", "words", "digit_runs", "spaced_words", *CLASSES)


def canonical_language(c: Column) -> Column:
    head = F.split(F.lower(F.trim(c)), "[_-]")[0]
    pairs = [x for two, threes in LANGUAGES.items() for three in threes for x in (F.lit(three), F.lit(two))]
    return F.when(head.isNull() | head.isin("", "und", "unknown", "none"), "und").otherwise(
        F.coalesce(F.create_map(*pairs)[head], head))


def canonical_source(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[_ -]+", "-"), "^-|-$", ""), F.lit("")), F.lit("unknown"))


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text, counted over the whole batch at once."""
    starts = np.array([a for a, _ in _RANGES])
    kinds = np.array([k for _, k in _RANGES], np.int64)
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    raw = "".join(t for t in texts if t).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    small = kinds[np.searchsorted(starts, np.arange(0x3000), "right") - 1]
    small[: 0x30] = 2
    small[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
    small[0x2000: 0x200B] = 0
    kind = small[np.minimum(codes, 0x2FFF)]
    high = codes >= 0x3000
    kind[high] = kinds[np.searchsorted(starts, codes[high], "right") - 1]
    kind[codes == 0x3000] = 0
    row = np.repeat(np.arange(len(texts)), lengths)
    n = len(texts)
    by_class = np.bincount(row * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    first = np.zeros(len(codes), bool)
    first[np.cumsum(lengths)[:-1][np.cumsum(lengths)[:-1] < len(codes)]] = True
    first[:1] = True
    before = np.r_[0, kind[:-1]] if len(kind) else kind
    begins = (kind != 0) & (first | (before == 0))
    digit = (kind == 1) & (first | (before != 1))
    letters = kind >= 3
    word = letters & (first | (before < 3))
    count = lambda flag: np.bincount(row[flag], minlength=n)
    return np.column_stack([
        (lengths > 0).astype(float), np.bincount(row, weights=width, minlength=n), count(word), count(digit), count(begins),
        by_class]).astype(float)


class GreedyTokenizer:
    """Longest piece first; a character in no piece costs its bytes."""

    def __init__(self, pieces: list[str]):
        self.pieces: dict[str, list[int]] = {}
        by_head: dict[str, set[int]] = {}
        self.known = {p for p in pieces if p and not (len(p) == 6 and p.startswith("<0x") and p.endswith(">"))}
        for p in self.known:
            by_head.setdefault(p[:2], set()).add(len(p))
            if len(p) == 1:
                by_head.setdefault(p, set()).add(1)
        self.lengths = {h: sorted(s, reverse=True) for h, s in by_head.items()}

    def count(self, text: str) -> int:
        i = n = 0
        size, known, lengths = len(text), self.known, self.lengths
        while i < size:
            for step in lengths.get(text[i: i + 2], ()):
                if text[i: i + step] in known:
                    i += step
                    break
            else:
                if text[i] in known:
                    i += 1
                else:
                    n += len(text[i].encode("utf-8", "surrogatepass")) - 1
                    i += 1
            n += 1
        return n


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Ridge towards `prior`, errors weighed relative to the square root of the size."""
    w = 1 / np.sqrt(np.maximum(y, 1))
    scale = np.maximum(np.sqrt(((x * w[:, None]) ** 2).mean(axis=0)), 1e-9)
    a = x * w[:, None] / scale
    b = y * w - a @ (prior * scale)
    return prior + np.linalg.solve(a.T @ a + strength * np.eye(a.shape[1]), a.T @ b) / scale


def stratum(where: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return np.array([f"{a}\t{b}" for a, b in zip(where.tolist(), lang.tolist())], dtype=object)


class TokenModel:
    """Coefficients and bias factors by record set and language; those without labels use what lies above them."""

    def __init__(self, lang: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray, where: np.ndarray, least: int = 20):
        zero = np.zeros(x.shape[1])
        fit = ~held
        self.pooled = _fit(x[fit], y[fit], zero, 0.1) if fit.any() else zero
        self.coefs = {}
        for name in sorted(set(lang.tolist())):
            own = fit & (lang == name)
            if own.any():
                self.coefs[name] = _fit(x[own], y[own], self.pooled, 3.0)
        for name, key in sorted({*zip(lang.tolist(), stratum(where, lang).tolist())}):  # drawn towards the language's
            own = fit & (stratum(where, lang) == key)
            if own.sum() >= least:
                self.coefs[key] = _fit(x[own], y[own], self.coefs[name], 3.0)
        guess = self.raw(lang, x, where)
        ratio = lambda m: float(y[m].sum() / guess[m].sum()) if m.any() and guess[m].sum() > 0 else 1.0
        self.overall = ratio(held)
        self.bias = {}
        for keys in (lang, stratum(where, lang)):
            self.bias |= {name: ratio(held & (keys == name)) for name in set(keys.tolist()) if (held & (keys == name)).sum() >= least}

    def raw(self, lang: np.ndarray, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        out, keys = np.zeros(len(x)), stratum(where, lang)
        for name, key in {*zip(lang.tolist(), keys.tolist())}:
            m = keys == key
            out[m] = x[m] @ self.coefs.get(key, self.coefs.get(name, self.pooled))
        return np.maximum(out, x[:, 0])  # a text that isn't empty has a token

    def predict(self, lang: np.ndarray, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        factor = np.array([self.bias.get(key, self.bias.get(name, self.overall)) for key, name in zip(stratum(where, lang).tolist(), lang.tolist())])
        return self.raw(lang, x, where) * factor


def estimate_tokens(records: DataFrame, vocabulary: DataFrame, max_labels: int = 6000, max_pieces: int = 500_000, max_strata: int = 512) -> DataFrame:
    """(record_set, record_id, source, language, domain, n_tokens) with n_tokens a double.

    records: record_set, record_id, text, source, language, domain and delivered (any order
    of deliveries).  vocabulary: piece.  max_labels bounds the sample that is tokenized and
    collected, max_pieces the vocabulary, max_strata the pairs of record set and language that
    labels are drawn from (the largest); all are bounds of the model, not of the data.
    """
    spark = records.sparkSession
    pieces = [r[0] for r in vocabulary.select("piece").where("piece is not null").distinct().limit(max_pieces + 1).collect()]
    if len(pieces) > max_pieces:
        raise ValueError("vocabulary above max_pieces")
    base = records.select(
        "record_set", F.col("record_id").cast("string").alias("record_id"), canonical_source(F.col("source")).alias("source"),
        canonical_language(F.col("language")).alias("language"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "text", "delivered")
    # labels by record set and language: half in proportion to the root of its size, and a least number for each
    key = F.concat_ws("\t", "record_set", "language")
    strata = base.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(max_strata).collect()
    roots = sum(r.n ** 0.5 for r in strata) or 1.0
    rate = {r.k: min(1_000_000, int(1_000_000 * (0.6 * max_labels * r.n ** 0.5 / roots + 0.3 * max_labels / len(strata)) / r.n) + 1) for r in strata}
    rates = F.create_map(*[F.lit(v) for kv in rate.items() for v in kv]) if rate else F.create_map(F.lit(""), F.lit(0))
    drawn = base.where(F.pmod(F.xxhash64("record_set", "record_id", F.lit(17)), F.lit(1_000_000)) < F.coalesce(F.try_element_at(rates, key), F.lit(0)))
    held_pieces = spark.sparkContext.broadcast(pieces)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = GreedyTokenizer(held_pieces.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "record_set": b.column("record_set"), "language": b.column("language"), "held": b.column("held"), "x": list(features(texts)),
                "n": [tokenizer.count(t) if t else 0 for t in texts]}, schema=pa.schema(
                    [("record_set", pa.string()), ("language", pa.string()), ("held", pa.bool_()), ("x", pa.list_(pa.float64())), ("n", pa.int64())]))

    got = drawn.dropDuplicates(["record_set", "record_id"]).select(
        "record_set", "language", "text", (F.pmod(F.xxhash64("record_id", F.lit(5)), F.lit(3)) == 0).alias("held")
    ).mapInArrow(label, "record_set string, language string, held boolean, x array<double>, n bigint").limit(2 * max_labels).toArrow()
    model = TokenModel(
        np.array(got["language"].to_pylist(), dtype=object), np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES)),
        got["n"].to_numpy().astype(float), got["held"].to_numpy(zero_copy_only=False).astype(bool),
        np.array(got["record_set"].to_pylist(), dtype=object))
    held_model = spark.sparkContext.broadcast((model.pooled, model.coefs, model.overall, model.bias))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TokenModel.__new__(TokenModel)
        own.pooled, own.coefs, own.overall, own.bias = held_model.value
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                out.append(own.predict(
                    np.array(part.column("language").to_pylist(), dtype=object), features(part.column("text").to_pylist()),
                    np.array(part.column("record_set").to_pylist(), dtype=object)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*keep, "n_tokens"])

    keep = ["record_set", "record_id", "source", "language", "domain", "delivered"]
    when = base.schema["delivered"].dataType.simpleString()
    each = base.select(*keep, "text").mapInArrow(
        predict, f"record_set string, record_id string, source string, language string, domain string, delivered {when}, n_tokens double")
    latest = each.groupBy("record_set", "record_id").agg(
        F.max(F.struct("delivered", "source", "language", "domain", "n_tokens")).alias("r"))
    return latest.select("record_set", "record_id", "r.source", "r.language", "r.domain", "r.n_tokens")


def token_totals(estimates: DataFrame) -> DataFrame:
    """Totals of each record_set by source, language and domain, singly and together."""
    dims = ["source", "language", "domain"]
    one = estimates.groupingSets(
        [["record_set"], *[["record_set", d] for d in dims], ["record_set", *dims]], "record_set", *dims)
    return one.agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().alias("level")).select(
        "record_set", *dims, "level", "n_records", "n_tokens")
