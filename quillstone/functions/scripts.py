"""Coarse script of a code point, from the names of the Unicode character database."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words in a character's name and the script they stand for, first match first.
NAME_WORDS = (
    ("LATIN", "Latn"), ("CJK UNIFIED IDEOGRAPH", "Hani"), ("CJK COMPATIBILITY", "Hani"), ("HIRAGANA", "Jpan"),
    ("KATAKANA", "Jpan"), ("HANGUL", "Hang"), ("ARABIC", "Arab"), ("GREEK", "Grek"), ("CYRILLIC", "Cyrl"), ("DEVANAGARI", "Deva"))


@lru_cache(maxsize=1)
def intervals() -> list[tuple[int, int, str]]:
    """(first, last, script) of every run of code points with a script; some 200 runs."""
    out: list[list] = []
    for cp in range(sys.maxunicode + 1):
        name = unicodedata.name(chr(cp), "")
        script = next((s for words, s in NAME_WORDS if words in name), None) if name else None
        if script is None:
            continue
        if out and out[-1][1] == cp - 1 and out[-1][2] == script:
            out[-1][1] = cp
        else:
            out.append([cp, cp, script])
    return [tuple(x) for x in out]


def char_scripts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cp, script, n): each distinct character of each text with its count; classification
    runs once per distinct code point (at most the size of Unicode, which is broadcast)."""
    chars = df.where(F.col(text).isNotNull()).select(key, F.explode(F.split(text, "")).alias("c")).where("c != ''")
    counts = chars.groupBy(key, "c").agg(F.count(F.lit(1)).alias("n")).withColumn("cp", F.expr("ascii(c)"))
    spark = df.sparkSession
    table = spark.createDataFrame(intervals(), "lo int, hi int, script string")
    codes = table.select(F.explode(F.sequence("lo", "hi")).alias("cp"), "script")
    return counts.join(codes, "cp", "left").select(key, "cp", F.coalesce("script", F.lit("OTHER")).alias("script"), "n")


def majority_script(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, script): most frequent script of a text's characters, OTHER only where alone; ties by label."""
    per = char_scripts(df, key, text).groupBy(key, "script").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy((F.col("script") == "OTHER"), F.col("n").desc(), "script")
    best = per.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(key, "script")
    return df.select(key).distinct().join(best, key, "left").select(key, F.coalesce("script", F.lit("OTHER")).alias("script"))
