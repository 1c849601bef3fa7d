"""Queries: projection on the vocabulary, and what levels predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rms_norm, rounded, scaled, top_k, unit
from ..operators.projection import entropy, first_level, project_log_probs, project_softmax_mass, project_top_k, target_in_top
from .bindings import LOGITS, probes, table, unembed
from .registry import query

_LONG = lambda c: F.col(c).cast("bigint").alias(c)


def _top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    p = probes(spark, sf_dir)
    carry = ["level", "model_slug", "r"]
    return project_top_k(p.select(F.col("vec_id").alias("key"), F.col("h").alias("v"), *carry), unembed(spark, sf_dir), k, digits=9, carry=carry)


_TOPS = LOGITS + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(logit, 9) DESC, token_id) AS rank FROM logits) WHERE rank <= 10)"""


@query(f"WITH {_TOPS} SELECT vec_id, CAST(rank AS BIGINT) AS rank, token_id, round(round(logit, 9), 6) + 0.0 AS logit FROM top")
def vocab_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 likeliest tokens of every probe."""
    return _top(spark, sf_dir).select(F.col("key").alias("vec_id"), _LONG("rank"), F.col("id").alias("token_id"), rounded(F.col("value")).alias("logit"))


@query("""WITH u AS (SELECT vec_id AS token_id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 100), e AS (SELECT vec_id, embedding::DOUBLE[] AS h FROM embeddings WHERE vec_id >= 100),
    l AS (SELECT vec_id, token_id, round(list_dot_product(h, w) * 0.5 / sqrt(list_dot_product(h, h) / len(h) + 1e-6), 9) AS logit FROM e, u)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS rank, token_id, logit + 0.0 AS logit FROM l QUALIFY rank <= 10""")
def vocab_projection_normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 likeliest tokens after the final norm, with logits scaled by 0.5."""
    e = table(spark, sf_dir, "embeddings").where("vec_id >= 100")
    t = project_top_k(e.select(F.col("vec_id").alias("key"), scaled(rms_norm(F.col("embedding")), 0.5).alias("v")), unembed(spark, sf_dir), 10, digits=9)
    return t.select(F.col("key").alias("vec_id"), _LONG("rank"), F.col("id").alias("token_id"), F.col("value").alias("logit"))


@query(f"WITH {LOGITS} SELECT vec_id, token_id, round(prob, 6) + 0.0 AS prob FROM probs")
def vocab_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every probe over the whole vocabulary."""
    p = probes(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("h").alias("v"))
    return project_log_probs(p, unembed(spark, sf_dir)).select(
        F.col("key").alias("vec_id"), F.col("id").alias("token_id"), rounded(F.exp("log_prob")).alias("prob"))


def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = probes(spark, sf_dir)
    m = project_softmax_mass(p.select(F.col("vec_id").alias("key"), F.col("h").alias("v")), unembed(spark, sf_dir))
    side = F.when(F.pmod("r", F.lit(2)) == 0, "A").otherwise("B")
    return m.join(p.select(F.col("vec_id").alias("key"), "level", "model_slug", side.alias("side")), "key").withColumnRenamed("class", "lang_script")


_MASS = LOGITS + """, mass AS (SELECT vec_id, level, model_slug, CASE WHEN r % 2 = 0 THEN 'A' ELSE 'B' END AS side, class AS lang_script, sum(prob) AS mass FROM probs GROUP BY ALL),
    summ AS (SELECT model_slug, level, side, lang_script, avg(mass) AS mean, stddev_samp(mass) AS std, count(*) AS n FROM mass GROUP BY ALL)"""


@query(f"WITH {_MASS} SELECT vec_id, CAST(level AS BIGINT) AS level, model_slug, side, lang_script, round(mass, 6) + 0.0 AS mass FROM mass")
def script_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability mass per script, for every probe."""
    return _mass(spark, sf_dir).select(F.col("key").alias("vec_id"), _LONG("level"), "model_slug", "side", "lang_script", rounded(F.col("mass")).alias("mass"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mass(spark, sf_dir).groupBy("model_slug", "level", "side", "lang_script").agg(
        F.avg("mass").alias("mean"), F.stddev_samp("mass").alias("std"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MASS} SELECT model_slug, CAST(level AS BIGINT) AS level, side, lang_script, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, n FROM summ")
def script_mass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("model_slug", _LONG("level"), "side", "lang_script", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "n")


@query(f"""WITH {_MASS}, w AS (SELECT model_slug AS model, max(CASE WHEN side='A' AND level=4 THEN mean END) AS a_early, max(CASE WHEN side='A' AND level=8 THEN mean END) AS a_late,
      max(CASE WHEN side='B' AND level=4 THEN mean END) AS b_early, max(CASE WHEN side='B' AND level=8 THEN mean END) AS b_late FROM summ WHERE lang_script='Latn' GROUP BY 1),
    v AS (SELECT *, a_late / greatest(a_early, 1e-8) AS a_climb, b_late / greatest(b_early, 1e-8) AS b_climb, a_late / greatest(b_late, 1e-8) AS a_over_b FROM w
      WHERE a_early IS NOT NULL AND a_late IS NOT NULL AND b_early IS NOT NULL AND b_late IS NOT NULL),
    t AS (SELECT avg(CASE WHEN round(a_climb, 6) >= 2 AND round(a_over_b, 6) >= 2 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM v)
    SELECT model, round(a_early, 6) AS a_early, round(a_late, 6) AS a_late, round(a_climb, 6) AS a_climb, round(b_climb, 6) AS b_climb, round(a_over_b, 6) AS a_over_b,
      round(a_climb, 6) >= 2 AS a_climbs_2x, round(a_over_b, 6) >= 2 AS a_2x_b, CASE WHEN share >= 0.75 THEN 'PASS' WHEN share >= 0.5 THEN 'MIXED' ELSE 'FAIL' END AS verdict FROM v, t""")
def script_pivot_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does Latin mass climb between two levels, on one side more than on the other?"""
    s = _summary(spark, sf_dir).where("lang_script = 'Latn'")
    at = lambda side, level: F.max(F.when((F.col("side") == side) & (F.col("level") == level), F.col("mean")))
    w = s.groupBy(F.col("model_slug").alias("model")).agg(at("A", 4).alias("a_early"), at("A", 8).alias("a_late"), at("B", 4).alias("b_early"), at("B", 8).alias("b_late")).dropna()
    ratio = lambda x, y: rounded(F.col(x) / F.greatest(F.col(y), F.lit(1e-8)))
    v = w.select("model", rounded(F.col("a_early")).alias("a_early"), rounded(F.col("a_late")).alias("a_late"), ratio("a_late", "a_early").alias("a_climb"),
                 ratio("b_late", "b_early").alias("b_climb"), ratio("a_late", "b_late").alias("a_over_b"))
    v = v.withColumn("a_climbs_2x", F.col("a_climb") >= 2).withColumn("a_2x_b", F.col("a_over_b") >= 2)
    t = v.agg(F.avg((F.col("a_climbs_2x") & F.col("a_2x_b")).cast("double")).alias("share"))
    return v.crossJoin(F.broadcast(t)).withColumn("verdict", F.when(F.col("share") >= 0.75, "PASS").when(F.col("share") >= 0.5, "MIXED").otherwise("FAIL")).drop("share")


@query(f"""WITH {_TOPS}, c AS (SELECT level, token_id, count(*) AS n FROM top WHERE rank = 1 GROUP BY ALL), t AS (SELECT level, sum(n) AS total FROM c GROUP BY 1)
    SELECT CAST(level AS BIGINT) AS level, count(*) AS n_distinct, CAST(any_value(total) AS BIGINT) AS total, round(-sum(n / total * log2(n / total + 1e-10)), 6) + 0.0 AS entropy FROM c JOIN t USING (level) GROUP BY 1""")
def layer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the likeliest tokens per level."""
    c = _top(spark, sf_dir, 1).groupBy("level", "id").agg(F.count(F.lit(1)).alias("n"))
    return entropy(c, ["level"]).select(_LONG("level"), "n_distinct", "total", rounded(F.col("entropy")).alias("entropy"))


_LENS = _TOPS + """, tgt AS (SELECT model_slug, r, token_id AS target FROM top WHERE rank = 1 AND level = 9),
    em AS (SELECT t.model_slug, t.r, g.target, min(CASE WHEN t.token_id = g.target THEN t.level END) AS emergence, min(CASE WHEN t.token_id = g.target AND rank = 1 THEN t.level END) AS crystallization
           FROM top t JOIN tgt g USING (model_slug, r) GROUP BY ALL)"""


def _emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _top(spark, sf_dir)
    target = t.where("rank = 1 and level = 9").select("model_slug", "r", F.col("id").alias("target"))
    hit = F.col("id") == F.col("target")
    return first_level(t.join(target, ["model_slug", "r"]), ["model_slug", "r", "target"], {"emergence": hit, "crystallization": hit & (F.col("rank") == 1)})


@query(f"WITH {_LENS} SELECT model_slug, CAST(r AS BIGINT) AS r, target, CAST(emergence AS BIGINT) AS emergence, CAST(crystallization AS BIGINT) AS crystallization, CAST(crystallization - emergence AS BIGINT) AS gap FROM em")
def lens_emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First level with the final token among the 10 likeliest, first level with it on top, and the gap."""
    e = _emergence(spark, sf_dir)
    return e.select("model_slug", _LONG("r"), "target", _LONG("emergence"), _LONG("crystallization"), (F.col("crystallization") - F.col("emergence")).cast("bigint").alias("gap"))


_PIECES = "pc AS (SELECT token_id - 500 AS token_id, min(piece) AS piece FROM token_vocab WHERE token_id BETWEEN 500 AND 599 GROUP BY 1)"


@query(f"""WITH {_LENS}, {_PIECES}, m AS (SELECT t.model_slug, t.r, t.level, t.token_id = g.target AS same, trim(lower(a.piece)) AS tok, lower(b.piece) AS want
      FROM top t JOIN tgt g USING (model_slug, r) LEFT JOIN pc a ON a.token_id = t.token_id LEFT JOIN pc b ON b.token_id = g.target)
    SELECT model_slug, CAST(r AS BIGINT) AS r, CAST(level AS BIGINT) AS level, bool_or(same) AS by_id, bool_or(same OR coalesce(tok <> '' AND (contains(tok, want) OR contains(want, tok)), false)) AS is_match FROM m GROUP BY ALL""")
def lens_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the final token, by id or by its text, is among the 10 likeliest of a level (vocabulary pieces from 500 on stand for the texts)."""
    pieces = table(spark, sf_dir, "token_vocab").where("token_id between 500 and 599").groupBy((F.col("token_id") - 500).cast("bigint").alias("id")).agg(F.min("piece").alias("piece"))
    t = _top(spark, sf_dir).join(F.broadcast(pieces), "id", "left")  # at most a hundred pieces
    target = t.where("rank = 1 and level = 9").select("model_slug", "r", F.col("id").alias("target"), F.col("piece").alias("want"))
    tops = t.groupBy("model_slug", "r", "level").agg(F.collect_list("id").alias("ids"), F.collect_list("piece").alias("tokens"))
    return tops.join(target, ["model_slug", "r"]).select(
        "model_slug", _LONG("r"), _LONG("level"), F.array_contains("ids", F.col("target")).alias("by_id"),
        target_in_top(F.col("ids"), F.col("tokens"), F.col("target"), F.col("want")).alias("is_match"))


@query(f"WITH {_TOPS} SELECT model_slug, CAST(r AS BIGINT) AS r, CAST(level AS BIGINT) AS level, token_id AS top_token FROM top WHERE rank = 1")
def lens_layer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest token per row and level."""
    return _top(spark, sf_dir, 1).select("model_slug", _LONG("r"), _LONG("level"), F.col("id").alias("top_token"))


@query(f"""WITH {_LENS}, nm(code, name) AS (VALUES ('base', 'Base'), ('global', 'Global'))
    SELECT coalesce(name, model_slug) AS language_name, round(avg(emergence), 6) AS mean_emergence, round(avg(crystallization), 6) AS mean_crystallization, round(avg(crystallization - emergence), 6) + 0.0 AS mean_gap
    FROM em LEFT JOIN nm ON code = model_slug GROUP BY 1""")
def lens_language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per group under its display name; a group without one keeps its code."""
    names = spark.createDataFrame([("base", "Base"), ("global", "Global")], "model_slug string, name string")
    e = _emergence(spark, sf_dir).join(F.broadcast(names), "model_slug", "left").withColumn("language_name", F.coalesce("name", "model_slug"))
    return e.groupBy("language_name").agg(rounded(F.avg("emergence")).alias("mean_emergence"), rounded(F.avg("crystallization")).alias("mean_crystallization"),
                                          rounded(F.avg(F.col("crystallization") - F.col("emergence"))).alias("mean_gap"))


@query("""SELECT vec_id, CAST(i AS BIGINT) AS rank, x.idx - 1 AS idx, round(x.value, 6) + 0.0 AS value FROM (
    SELECT vec_id, unnest(s[1:4]) AS x, unnest(range(1, 5)) AS i FROM (SELECT vec_id, list_sort(list_transform(range(1, len(embedding) + 1), lambda k: {'neg': -embedding[k]::DOUBLE, 'idx': k, 'value': embedding[k]::DOUBLE})) AS s FROM embeddings))""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 largest entries of each vector, with their places."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(top_k(F.col("embedding"), 4)).alias("k", "t"))
    return e.select("vec_id", (F.col("k") + 1).cast("bigint").alias("rank"), F.col("t.idx").cast("bigint").alias("idx"), rounded(F.col("t.value")).alias("value"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, round(v[i] / (sqrt(list_dot_product(v, v)) + 1e-8), 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e)""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length 1, one row per entry."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"), 1e-8)).alias("dim", "value")).select(
        "vec_id", _LONG("dim"), rounded(F.col("value")).alias("value"))
