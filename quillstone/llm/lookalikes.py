"""One consistent form for text that reads the same: a look-alike skeleton.

skeleton(text) decomposes, replaces every character by its prototype and decomposes
again.  Texts with equal skeletons read the same; case, digits, accents, punctuation
and raised, lowered or circled forms stay apart.

Edge cases: null stays null, empty text has the empty skeleton (as has a text of
characters that show nothing); lone surrogates pass unchanged; whole texts are used.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import written

# Letters and digits that look like those of another script, by prototype.
PROTOTYPES = {
    # Cyrillic, Greek, Armenian, Cherokee, Coptic and Lisu letters -> Latin
    "a": "аɑα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳյ", "l": "ӏ", "n": "ո",
    "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗⲔ", "L": "ԼᏞꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛ", "R": "Ꮢꓣ", "S": "ЅՏᏚꓢ",
    "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ᏙѴꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    # Persian digits of the same shape -> Arabic
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹",
    # Persian and Urdu letters -> Arabic
    "ك": "ک", "ه": "ھہە",
    # two strokes of one vowel -> the vowel written twice (Thai, Lao)
    "เเ": "แ", "ເເ": "ແ",
    # Katakana and Hiragana -> Han, Hiragana -> Katakana
    "二": "ニ", "八": "ハ", "力": "カ", "夕": "タ", "工": "エ", "口": "ロ囗", "卜": "ト", "一": "ー㇐", "ヘ": "へ", "丿": "ノ㇒", "厶": "ム", "亻": "イ",
    # radicals and strokes that are the ideograph itself and have no decomposition
    "西": "⻄", "见": "⻅", "贝": "⻉", "车": "⻋", "长": "⻓", "门": "⻔", "青": "⻘", "韦": "⻙", "页": "⻚", "风": "⻛", "食": "⻝", "马": "⻢",
    "骨": "⻣", "鬼": "⻤", "鱼": "⻥", "卤": "⻧", "麦": "⻨", "黄": "⻩", "斉": "⻫", "齐": "⻬", "歯": "⻭", "竜": "⻯", "龙": "⻰", "龟": "⻱", "亀": "⻲",
    "丨": "㇑", "丶": "㇔", "亅": "㇚",
}
# Kinds of compatibility decomposition that change nothing a reader sees.
_SAME_LOOK = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
# Ranges of characters that show nothing.
_INVISIBLE = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF))


def _same_look(c: str) -> str:
    """The compatibility decomposition of c where it only undoes width, position, a ligature or a copy."""
    d = unicodedata.decomposition(c)
    if not d:
        return c
    kind, _, rest = d.partition(" ")
    if kind[0] != "<":
        return unicodedata.normalize("NFD", c)
    to = "".join(chr(int(x, 16)) for x in rest.split())
    letters = all(unicodedata.category(x)[0] in "LM" for x in to)
    if kind in _SAME_LOOK or kind == "<compat>" and letters and unicodedata.category(c) in ("Lo", "Ll", "Lu", "Lt", "So", "Nl"):
        # U+2F00-2FD5 and the like (So) are copies of one ideograph; enclosed and squared forms have other kinds
        return unicodedata.normalize("NFD", "".join(map(_same_look, to)))
    return c

# a voiced mark stands on kana only: a Han prototype before it goes back to its kana
_KANA = {"二": "ニ", "八": "ハ", "力": "カ", "夕": "タ", "工": "エ", "口": "ロ", "卜": "ト", "丿": "ノ"}
_VOICED = re.compile("[" + "".join(_KANA) + "][\u3099\u309a]")
# the Farsi yeh has the dots of the Arabic one before a letter, and none at the end
_YEH = re.compile("\u06cc(?=[\u064b-\u065f\u0670]*[\u0620-\u064a\u066e-\u06d3])")
_STROKE = "\u0335"


def _stroked() -> dict[str, str]:
    """Letters with a stroke through them and the letter with a stroke put over it, by their names."""
    names = {unicodedata.name(chr(i), ""): chr(i) for i in range(0x2C80)}
    return {c: names[base] + _STROKE for name, c in names.items() if name.endswith(" WITH STROKE") and (base := name.removesuffix(" WITH STROKE")) in names}


def table() -> dict[int, str]:
    """For str.translate: every character that changes, derived from the rules above."""
    out: dict[int, str] = {}
    for i in range(sys.maxunicode + 1):
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF:
            continue  # syllables decompose by NFD
        c = chr(i)
        if unicodedata.category(c) == "Zs" or c == "\u2800":  # an empty Braille cell is a space
            to = " "
        else:
            to = _same_look(c)
        if to != c:
            out[i] = to
    for a, b in _INVISIBLE:
        out.update(dict.fromkeys(range(a, b + 1), ""))
    alike = {x: to for to, chars in PROTOTYPES.items() for x in chars}
    alike |= dict.fromkeys("\u0336\u0337\u0338", _STROKE) | _stroked()
    for x, to in alike.items():
        out[ord(x)] = to
    for i, to in list(out.items()):  # a decomposed character may have a prototype of its own
        out[i] = "".join(alike.get(x, x) for x in to)
    return out


def skeleton(text: str | None, t: dict[int, str]) -> str | None:
    """The skeleton of text by the table t."""
    if text is None or text.isascii() and text.isprintable():
        return text
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.translate(t)).translate(t))
    text = _VOICED.sub(lambda m: _KANA[m.group()[0]] + m.group()[1], text)
    return _YEH.sub("\u064a", text).replace("\u06cc", "\u0649") if "\u06cc" in text else text


def skeleton_column(text: Column) -> Column:
    t = table()  # some 8,000 entries, fixed; they travel with the plan

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: skeleton(x, t), na_action="ignore").astype(object)

    return run(text)


def canonical_text(df: DataFrame, text_col: str, out_col: str = "canonical_text") -> DataFrame:
    """df with the consistent form of text_col, recomposed (NFC), in out_col."""
    return df.withColumn(out_col, _composed(F.col(text_col)))


def _composed(text: Column) -> Column:
    t = table()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", skeleton(x, t)), na_action="ignore").astype(object)

    return run(text)


def same_reading_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_class, skeleton_hash): one row per id and distinct text that shares its reading with another text.

    Texts are compared through two 64-bit hashes of the skeleton and of the text, so no text is shuffled.
    """
    keyed = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    keyed = keyed.withColumn("s", skeleton_column(F.col("t"))).select(
        "id", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), F.xxhash64("t").alias("text_class"),
        F.xxhash64(F.lit(1), "t").alias("c2"))
    return keyed.distinct()


def same_reading_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_ids, n_texts): one row per id and reading that differing texts share.

    class_id is the first id of the reading; nothing is paired, so a reading of any size is one aggregate and one join.
    """
    keyed = written(same_reading_groups(df, id_col, text_col))
    ids = keyed.select("k1", "k2", "id").distinct()
    texts = keyed.groupBy("k1", "k2").agg(F.count_distinct("text_class", "c2").alias("n_texts"), F.min("id").alias("class_id")).where("n_texts > 1")
    sizes = ids.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_ids"))
    return ids.join(texts.join(sizes, ["k1", "k2"]), ["k1", "k2"]).where("n_ids > 1").select("id", "class_id", "n_ids", "n_texts").distinct()


def same_reading_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose texts differ and read the same.

    A reading whose rows all carry one text has no pairs and leaves before the join; rows
    of the others meet on the reading, so the work is the number of pairs asked for.
    """
    keyed = written(same_reading_groups(df, id_col, text_col))  # hashes only; skeletons are made once
    varied = keyed.groupBy("k1", "k2").agg(
        (F.min("text_class") != F.max("text_class")).alias("varied")).where("varied").select("k1", "k2")
    rows = keyed.join(varied, ["k1", "k2"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(
        b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.text_class") != F.col("b.text_class"))
    ).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
