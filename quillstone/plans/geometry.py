"""Queries: paired cosine geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators.geometry import (
    base_slug, bootstrap_ci, cross_checkpoint, extreme_level, gate, paired_cosines, paired_deltas)
from .bindings import SIDES, STATES, boot_sql, cos_sql, sides, states, table
from .registry import query

_LONG = lambda c: F.col(c).cast("bigint").alias(c)
_PARTNER = "JOIN pairs q ON q.level = p.level AND q.i = (p.i + {k}) % c.n"


@query(f"""WITH {SIDES}, x AS (SELECT p.level, p.i, q.i AS j, p.a, p.b, q.a AS a2, q.b AS b2
    FROM pairs p JOIN cnt c USING (level) {_PARTNER.format(k=7)})
    SELECT CAST(level AS BIGINT) AS level, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, condition, round(cosine, 6) + 0.0 AS cosine FROM (
    SELECT level, i, j, 'B_same_meaning_cross' AS condition, {cos_sql('a', 'b')} AS cosine FROM x UNION ALL
    SELECT level, i, j, 'C_diff_meaning_same_A', {cos_sql('a', 'a2')} FROM x UNION ALL
    SELECT level, i, j, 'D_diff_meaning_cross', {cos_sql('a', 'b2')} FROM x UNION ALL
    SELECT level, i, j, 'E_diff_meaning_same_B', {cos_sql('b', 'b2')} FROM x)""")
def paired_cosine_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same- and other-meaning cosines of every pair, with rotation 7."""
    c = paired_cosines(sides(spark, sf_dir), ["level"], 7)
    return c.select(_LONG("level"), _LONG("i"), _LONG("j"), "condition", rounded(F.col("cosine")).alias("cosine"))


def _summary(values: DataFrame, group: list[str], seed) -> DataFrame:
    ci = bootstrap_ci(values, group, seed)
    return ci.select(*group, "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


def _delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(paired_deltas(sides(spark, sf_dir), ["level"], 7), ["level"], F.col("level") * 13 + 5)


_DELTA = f"""{SIDES}, vals AS (SELECT p.level, p.i, {cos_sql('p.a', 'p.b')} - {cos_sql('p.a', 'q.b')} AS value
    FROM pairs p JOIN cnt c USING (level) {_PARTNER.format(k=7)}), {boot_sql('vals', 'level', 'level * 13 + 5')}"""
_R = "round(mean, 6) + 0.0 AS mean, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi"


@query(f"""WITH {_DELTA}, s AS (SELECT CAST(level AS BIGINT) AS level, n, {_R} FROM ci)
    SELECT *, round((hi - lo) / 2, 9) + 0.0 AS halfwidth, level BETWEEN 2 AND 7 AS in_gate_window, level BETWEEN 2 AND 7 AND lo > 0 AS gate_pass FROM s""")
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean same-minus-other contrast per level with its bootstrap interval and the gate."""
    g = gate(_delta_summary(spark, sf_dir), 2, 7)
    return g.select(_LONG("level"), "n", "mean", "lo", "hi", rounded(F.col("halfwidth"), 9).alias("halfwidth"), "in_gate_window", "gate_pass")


def _lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary lens has the even pairs with rotation 4, the other all pairs with rotation 8."""
    p = sides(spark, sf_dir)
    primary = paired_deltas(p.where("i % 2 = 0").withColumn("i", (F.col("i") / 2).cast("int")).withColumn("n", F.ceil(F.col("n") / 2)), ["level"], 4)
    both = primary.withColumn("lens", F.lit("primary")).withColumn("rotation_k", F.lit(4)).unionByName(
        paired_deltas(p, ["level"], 8).withColumn("lens", F.lit("all")).withColumn("rotation_k", F.lit(8)))
    return _summary(both, ["lens", "rotation_k", "level"], F.col("level") * 17 + 11)


_LENS = f"""{SIDES}, sub AS (SELECT level, i // 2 AS i, a, b FROM pairs WHERE i % 2 = 0), subn AS (SELECT level, count(*) AS n FROM sub GROUP BY level),
    vals AS (SELECT 'all' AS lens, 8 AS rotation_k, p.level, p.i, {cos_sql('p.a', 'p.b')} - {cos_sql('p.a', 'q.b')} AS value
             FROM pairs p JOIN cnt c USING (level) {_PARTNER.format(k=8)}
             UNION ALL SELECT 'primary', 4, p.level, p.i, {cos_sql('p.a', 'p.b')} - {cos_sql('p.a', 'q.b')}
             FROM sub p JOIN subn c USING (level) JOIN sub q ON q.level = p.level AND q.i = (p.i + 4) % c.n),
    {boot_sql('vals', 'lens, rotation_k, level', 'level * 17 + 11')}, s AS (SELECT lens, CAST(rotation_k AS BIGINT) AS rotation_k, CAST(level AS BIGINT) AS level, n, {_R} FROM ci)"""


@query(f"WITH {_LENS} SELECT * FROM s")
def paired_delta_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lenses(spark, sf_dir).select("lens", _LONG("rotation_k"), _LONG("level"), "n", "mean", "lo", "hi")


@query(f"""WITH {_LENS}, k AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY mean DESC, level) AS rn FROM s WHERE level BETWEEN 1 AND 8)
    SELECT lens, n, level AS peak_level, mean, lo, hi, level BETWEEN 5 AND 8 AS peak_in_band, mean > 0.1 AND lo > 0 AS peak_clear FROM k WHERE rn = 1""")
def peak_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of the largest contrast per lens, with flags."""
    p = extreme_level(_lenses(spark, sf_dir), ["lens"], "mean", 1, 8)
    return p.select("lens", "n", F.col("level").cast("bigint").alias("peak_level"), "mean", "lo", "hi",
                    F.col("level").between(5, 8).alias("peak_in_band"), ((F.col("mean") > 0.1) & (F.col("lo") > 0)).alias("peak_clear"))


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_checkpoint(states(spark, sf_dir, "i"), ["level", "i"], "base")


_CROSS = f"""{STATES}, x AS (SELECT p.model_slug AS post_slug, p.level, p.i, {cos_sql('p.h', 'b.h')} AS cosine
    FROM states p JOIN states b ON b.model_slug = 'base' AND b.level = p.level AND b.i = p.i WHERE p.model_slug <> 'base')"""


@query(f"WITH {_CROSS} SELECT post_slug, CAST(level AS BIGINT) AS level, CAST(i AS BIGINT) AS i, round(cosine, 6) + 0.0 AS cosine FROM x")
def cross_checkpoint_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir).select("post_slug", _LONG("level"), _LONG("i"), rounded(F.col("cosine")).alias("cosine"))


def _cross_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _cross(spark, sf_dir).select("post_slug", F.pmod("i", F.lit(3)).alias("family"), "level", F.floor(F.col("i") / 3).alias("i"), F.col("cosine").alias("value"))
    return _summary(x, ["post_slug", "family", "level"], F.col("level") * 19 + 23)


_CROSS_SUM = f"""{_CROSS}, vals AS (SELECT post_slug, i % 3 AS family, level, i // 3 AS i, cosine AS value FROM x),
    {boot_sql('vals', 'post_slug, family, level', 'level * 19 + 23')},
    s AS (SELECT post_slug, CAST(family AS BIGINT) AS family, CAST(level AS BIGINT) AS level, n, {_R} FROM ci)"""


@query(f"WITH {_CROSS_SUM} SELECT * FROM s")
def cross_checkpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross_summary(spark, sf_dir).select("post_slug", _LONG("family"), _LONG("level"), "n", "mean", "lo", "hi")


@query(f"""WITH {_CROSS_SUM}, k AS (SELECT *, row_number() OVER (PARTITION BY post_slug, family ORDER BY mean, level) AS rn FROM s WHERE level BETWEEN 1 AND 8)
    SELECT post_slug, family, level AS min_level, mean AS min_mean, lo AS min_lo, hi AS min_hi, level BETWEEN 5 AND 8 AS in_band FROM k WHERE rn = 1""")
def min_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level at which models differ most, per model and family."""
    p = extreme_level(_cross_summary(spark, sf_dir), ["post_slug", "family"], "mean", 1, 8, largest=False)
    return p.select("post_slug", _LONG("family"), F.col("level").cast("bigint").alias("min_level"), F.col("mean").alias("min_mean"),
                    F.col("lo").alias("min_lo"), F.col("hi").alias("min_hi"), F.col("level").between(5, 8).alias("in_band"))


@query("""SELECT model_slug, model_slug = (SELECT min(model_slug) FROM activations WHERE contains(lower(model_slug), 'base')) AS is_base,
    count(DISTINCT vec_id) AS n_vectors FROM activations WHERE model_slug IS NOT NULL GROUP BY model_slug""")
def checkpoint_base_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "activations").where("model_slug is not null")
    base = base_slug(a.select("model_slug").distinct())
    return a.groupBy("model_slug").agg(F.count_distinct("vec_id").alias("n_vectors")).select(
        "model_slug", (F.col("model_slug") == F.lit(base)).alias("is_base"), "n_vectors")


@query(f"""WITH {_LENS}, h AS (SELECT lens, min(n) AS n_least, max(n) AS n_most, max((hi - lo) / 2) AS mx, quantile_cont((hi - lo) / 2, 0.5) AS md FROM s GROUP BY lens)
    SELECT lens, n_least, n_most, round(mx, 9) + 0.0 AS max_halfwidth, round(md, 9) + 0.0 AS median_halfwidth, CASE WHEN round(mx, 9) <= 0.05 THEN 'RESOLVABLE' ELSE 'NOT RESOLVABLE' END AS verdict FROM h""")
def mde_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and median half-width over levels, and whether an effect of 0.05 can be resolved."""
    h = _lenses(spark, sf_dir).withColumn("w", (F.col("hi") - F.col("lo")) / 2).groupBy("lens").agg(
        F.min("n").alias("n_least"), F.max("n").alias("n_most"), rounded(F.max("w"), 9).alias("max_halfwidth"), rounded(F.percentile("w", 0.5), 9).alias("median_halfwidth"))
    return h.withColumn("verdict", F.when(F.col("max_halfwidth") <= 0.05, "RESOLVABLE").otherwise("NOT RESOLVABLE"))
