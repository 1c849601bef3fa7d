"""Building and inspecting text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Id prefixes and the family they stand for, first match first.
FAMILIES = ("ja-flores", "ko-flores", "ja-mif", "ko-mif", "ja-datapilot", "ko-law", "ko-legal-qa")
CONTROLS = ("ja-datapilot", "ko-law", "ko-legal-qa")


def family_of(row_id: Column, families=FAMILIES, default: str | None = "unknown") -> Column:
    out = F.lit(default).cast("string")
    for f in reversed(families):
        out = F.when(row_id.startswith(f + "-"), F.lit(f)).otherwise(out)
    return out


def expect_rows(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """df, failing when it is read if it does not have n rows; the count is one small aggregate."""
    have = df.agg(F.count(F.lit(1)).alias("_have"))
    check = have.select(F.when(F.col("_have") != n, F.raise_error(F.concat(F.lit(f"{what}: expected {n}, found "), F.col("_have").cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).where("_ok").drop("_ok")


def packet_corpus(packet: DataFrame) -> DataFrame:
    """Packet rows in the corpus layout, with the family from the id."""
    return packet.select(
        F.lit("v2-packet").alias("source"), F.col("packet_row_id").alias("row_id"), F.coalesce("language", F.lit("unknown")).alias("language"),
        F.col("prompt").alias("text"), F.lit(True).alias("is_enterprise_prompt"), family_of(F.col("packet_row_id")).alias("task_family"))


def sentence_corpus(sentences: DataFrame, split: str) -> DataFrame:
    """(language, idx, text) in the corpus layout, with ids language-split-index."""
    return sentences.select(
        F.lit(f"flores-{split}").alias("source"), F.concat_ws("-", "language", F.lit(split), F.col("idx").cast("string")).alias("row_id"),
        "language", "text", F.lit(False).alias("is_enterprise_prompt"), F.lit(None).cast("string").alias("task_family"))


def bidirectional_pairs(sentences: DataFrame, pairs: list[tuple[str, str, str]], names: dict[str, str], template: Column, first: int | None = None) -> DataFrame:
    """Two rows, side A and side B, per pair and sentence index (below `first`, if given).

    sentences: (language, idx, text).  template builds the prompt from target_lang and source_text.
    A sentence that one language of a pair lacks gives no rows.
    """
    spark = sentences.sparkSession
    wanted = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair_rank int, pair_label string, x string, y string")
    label = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    s = sentences if first is None else sentences.where(F.col("idx") < first)
    x = s.select(F.col("language").alias("x"), "idx", F.col("text").alias("tx"))
    y = s.select(F.col("language").alias("y"), "idx", F.col("text").alias("ty"))
    both = x.join(F.broadcast(wanted), "x").join(y, ["y", "idx"])
    side = lambda name, a, b, t: F.struct(F.lit(name).alias("side"), F.col(a).alias("source_lang_code"), F.col(b).alias("target_lang_code"), F.col(t).alias("source_text"))
    rows = both.select("pair_rank", "pair_label", "idx", F.explode(F.array(side("A", "x", "y", "tx"), side("B", "y", "x", "ty"))).alias("s")).select(
        "pair_rank", "pair_label", F.col("idx").cast("string").alias("source_row_id"), "s.*")
    rows = rows.withColumn("source_lang", label[F.col("source_lang_code")]).withColumn("target_lang", label[F.col("target_lang_code")])
    rows = rows.withColumn("packet_row_id", F.concat_ws("-", F.lower("pair_label"), "side", F.lit("flores"), "source_row_id"))
    return rows.withColumn("prompt", template)


def pairs_with_both_sides(rows: DataFrame, keys: list[str], text: str, tail: int = 80) -> DataFrame:
    """(keys, preview_a, preview_b): the first row of each side where both are there; last characters on one line."""
    order = Window.partitionBy(*keys, "side").orderBy("packet_row_id", text)
    one = rows.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    short = F.regexp_replace(F.expr(f"right({text}, {tail})"), "\n", " ")
    wide = one.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "A", short)).alias("preview_a"), F.max(F.when(F.col("side") == "B", short)).alias("preview_b"),
        F.count(F.lit(1)).alias("_n"))
    return wide.where("_n = 2").drop("_n")


def profile(rows: DataFrame, dims: list[str], text: str) -> DataFrame:
    """(dimension, value, n, mean_chars): counts by each dimension in one pass."""
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("value")) for d in dims])).alias("d"),
                       F.length(text).alias("n_chars"))
    return flat.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


def first_theta_match(left: DataFrame, right: DataFrame, left_key: str, equal: Column, theta: Column, order: list[Column]) -> DataFrame:
    """Inner equi-join with a further condition; the first match, by order, of each left row."""
    m = left.alias("l").join(right.alias("r"), equal & theta)
    return m.withColumn("_k", F.row_number().over(Window.partitionBy(f"l.{left_key}").orderBy(*order))).where("_k = 1")


def chat(prompt: Column, template: str | None = None) -> Column:
    """The prompt in a chat template with {prompt}, or unchanged without one."""
    if template is None:
        return prompt
    head, _, tail = template.partition("{prompt}")
    return F.concat(F.lit(head), prompt, F.lit(tail))
