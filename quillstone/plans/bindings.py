"""The project's relations over the given tables, for Spark and (as WITH clauses) for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.geometry import POISSON
from ..operators.ranking import dense_index

SLUGS = ("base", "global", "water")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the latest delivery; of equal ones the first by the other columns."""
    others = [c for c, k in df.dtypes if c not in (key, "loaded_at")]
    order = Window.partitionBy(key).orderBy(F.col("loaded_at").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in others])
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def states(spark: SparkSession, sf_dir: str, ranks: str = "ri") -> DataFrame:
    """(vec_id, level, model_slug, h, r, n_r, i): one vector per level and rank r; i ranks within level and model.

    Only keys are numbered, in slices of the key, and only by the ranks asked for; the vectors join afterwards.
    """
    e = table(spark, sf_dir, "embeddings")
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.pmod("vec_id", F.lit(3)) + 1).cast("int"))
    ranked = e.select("vec_id", F.col("label").alias("level"), slug.alias("model_slug"))
    block = F.floor(F.col("vec_id") / 65536)
    if "r" in ranks:
        ranked = dense_index(ranked, ["level"], [F.col("vec_id")], block, "r", "n_r")
    if "i" in ranks:
        ranked = dense_index(ranked, ["level", "model_slug"], [F.col("vec_id")], block, "i")
    return ranked.join(e.select("vec_id", F.col("embedding").alias("h")), "vec_id")


STATES = """states AS (
    SELECT vec_id, label AS level, embedding::DOUBLE[] AS h, list_extract(['base','global','water'], CAST(vec_id % 3 + 1 AS INTEGER)) AS model_slug,
           row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r,
           row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS i FROM embeddings)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, i, a, b, n): ranks 2i and 2i+1 of a level as the two sides of pair i of n."""
    s = states(spark, sf_dir, "r")
    pick = lambda k: F.max(F.when(F.pmod("r", F.lit(2)) == k, F.col("h")))
    return s.groupBy("level", F.floor(F.col("r") / 2).cast("int").alias("i"), F.floor(F.col("n_r") / 2).alias("n")).agg(
        pick(0).alias("a"), pick(1).alias("b")).where("a is not null and b is not null")


SIDES = STATES + """, pairs AS (
    SELECT x.level, x.r // 2 AS i, x.h AS a, y.h AS b FROM states x JOIN states y ON x.level = y.level AND y.r = x.r + 1 WHERE x.r % 2 = 0),
    cnt AS (SELECT level, count(*) AS n FROM pairs GROUP BY level)"""


def cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a},{b})/(sqrt(list_dot_product({a},{a}))*sqrt(list_dot_product({b},{b}))+1e-12)"


def boot_sql(values: str, group: str, seed: str, n_boot: int = 2000) -> str:
    """CTEs after `values` (group, i, value): ci(group, n, mean, lo, hi)."""
    g = [c.strip() for c in group.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c}={b}.{c}" for c in g)
    step = "SELECT * REPLACE ((xor(x, x >> 15) * 1103515245 + 12345) % 2147483648 AS x) FROM "
    count = " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in POISSON)
    return f"""st AS (SELECT {group}, count(*) AS n, avg(value) AS mean FROM {values} GROUP BY {group}),
    d0 AS (SELECT {group}, value, boot, CAST((i * {n_boot} + boot + ({seed}) * 7919) % 2147483648 AS BIGINT) AS x
           FROM {values}, (SELECT unnest(range({n_boot})) AS boot)),
    d1 AS ({step} d0), d2 AS ({step} d1), d3 AS ({step} d2), dw AS (SELECT {group}, value, boot, {count} AS w FROM d3),
    bm AS (SELECT {group}, boot, sum(w * value) / sum(w) AS m FROM dw GROUP BY {group}, boot HAVING sum(w) > 0),
    ci AS (SELECT {', '.join('st.' + c for c in g)}, st.n, st.mean, q.lo, q.hi FROM st LEFT JOIN
           (SELECT {group}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY {group}) q ON {on('st', 'q')})"""


def latest_sql(name: str, key: str, cols: str, alias: str | None = None) -> str:
    """CTE: one row per key of a table, by the rule of latest()."""
    order = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in cols.split(",") if c.strip() not in (key, "loaded_at"))
    return f"""{alias or name + '_1'} AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST, {order}) = 1)"""


CORPUS_COLS = "source, row_id, language, text, is_enterprise_prompt, task_family, exported_at, loaded_at"
PACKET_COLS = "packet_row_id, source_row_id, prompt, language, task_family, reference_text, exported_at, loaded_at"
CORPUS = latest_sql("corpus_rows", "row_id", CORPUS_COLS)
PACKET = latest_sql("eval_packet", "packet_row_id", PACKET_COLS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "corpus_rows"), "row_id")


def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "eval_packet"), "packet_row_id")


def unembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 0-99 as vocabulary rows (id, w, class)."""
    script = F.element_at(F.array(*map(F.lit, ("Latn", "Jpan", "Hang", "Hani", "OTHER"))), (F.pmod("label", F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("id"), F.col("embedding").alias("w"), script.alias("class"))


UNEMBED = """unembed AS (SELECT vec_id AS id, embedding::DOUBLE[] AS w, list_extract(['Latn','Jpan','Hang','Hani','OTHER'], CAST(label % 5 + 1 AS INTEGER)) AS class
    FROM embeddings WHERE vec_id < 100)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir, "r").where("vec_id >= 100")


LOGITS = STATES + ", " + UNEMBED + """, probes AS (SELECT * FROM states WHERE vec_id >= 100),
    logits AS (SELECT p.vec_id, p.level, p.model_slug, p.r, p.i, u.id AS token_id, u.class, list_dot_product(p.h, u.w) AS logit FROM probes p, unembed u),
    probs AS (SELECT *, exp(logit - max(logit) OVER v) / sum(exp(logit - (SELECT max(logit) FROM logits))) OVER v * exp(max(logit) OVER v - (SELECT max(logit) FROM logits)) AS prob
              FROM logits WINDOW v AS (PARTITION BY vec_id))"""
