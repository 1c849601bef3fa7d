"""Queries: sparse-autoencoder features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import features as O
from ..operators.ranking import dense_index
from .bindings import table
from .registry import query

_LONG = lambda c: F.col(c).cast("bigint").alias(c)
K = 8


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 0-63 as encoder rows without bias; the same rows decode."""
    return _emb(spark, sf_dir).where("vec_id < 64").select(F.col("vec_id").alias("id"), F.col("embedding").alias("w"), F.lit(0.0).alias("b"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoder(spark, sf_dir).select(F.col("id").alias("feature_idx"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from 128 on as activations (key, v, shard, pos)."""
    n = F.col("vec_id") - 128
    return _emb(spark, sf_dir).where("vec_id >= 128").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), F.floor(n / 64).alias("shard"), F.pmod(n, F.lit(64)).alias("pos"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.encode(_acts(spark, sf_dir).select("key", "v"), _encoder(spark, sf_dir), K)


_CODE = """enc AS (SELECT vec_id AS id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 64),
    acts AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v, (vec_id - 128) // 64 AS shard, (vec_id - 128) % 64 AS pos, label FROM embeddings WHERE vec_id >= 128),
    z AS (SELECT key, id AS feature_idx, round(greatest(list_dot_product(v, w), 0), 9) AS z FROM acts, enc),
    code AS (SELECT key, feature_idx, z FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z DESC, feature_idx) AS rn FROM z) WHERE rn <= 8 AND z > 0)"""


@query(f"WITH {_CODE} SELECT key AS vec_id, feature_idx, round(z, 6) + 0.0 AS z FROM code")
def sae_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse codes: at most 8 positive features per vector."""
    return _code(spark, sf_dir).select(F.col("key").alias("vec_id"), "feature_idx", rounded(F.col("z")).alias("z"))


@query(f"""WITH {_CODE}, xh AS (SELECT key, i AS dim, sum(z * w[i]) AS x FROM (SELECT key, z, w, unnest(range(1, 65)) AS i FROM code JOIN enc ON id = feature_idx) GROUP BY ALL),
    x AS (SELECT key, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM acts)
    SELECT key AS vec_id, round(avg((x.x - coalesce(xh.x, 0)) * (x.x - coalesce(xh.x, 0))), 6) + 0.0 AS mse FROM x LEFT JOIN xh USING (key, dim) GROUP BY 1""")
def sae_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of the vectors decoded from their codes."""
    dec = _encoder(spark, sf_dir).select("id", F.col("w").alias("d"))
    e = O.reconstruction_error(_acts(spark, sf_dir), _code(spark, sf_dir), dec)
    return e.select(F.col("key").alias("vec_id"), rounded(F.col("mse")).alias("mse"))


@query(f"""WITH {_CODE}, fires AS (SELECT DISTINCT shard AS step, feature_idx FROM code JOIN acts USING (key)), steps AS (SELECT DISTINCT shard AS step FROM acts),
    grid AS (SELECT s.step, e.id AS feature_idx, coalesce((SELECT max(f.step) FROM fires f WHERE f.feature_idx = e.id AND f.step <= s.step), -1) AS last FROM steps s, enc e)
    SELECT step, CAST(count(*) FILTER (step - last > 0) AS BIGINT) AS n_dead, round(avg(CASE WHEN step - last > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 AS dead_ratio FROM grid GROUP BY 1""")
def dead_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that did not fire, with one shard as a step."""
    acts = _acts(spark, sf_dir)
    fires = _code(spark, sf_dir).join(acts.select("key", "shard"), "key").select(F.col("shard").alias("step"), "feature_idx")
    d = O.dead_features(fires, _features(spark, sf_dir), acts.select(F.col("shard").alias("step")).distinct(), 0)
    return d.select("step", "n_dead", rounded(F.col("dead_ratio")).alias("dead_ratio"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, i, key_a, key_b): neighbouring ranks of a level, among the activations."""
    s = dense_index(_emb(spark, sf_dir).where("vec_id >= 128").select("vec_id", F.col("label").alias("level")), ["level"], [F.col("vec_id")], F.floor(F.col("vec_id") / 65536), "q")
    side = lambda k: F.max(F.when(F.pmod("q", F.lit(2)) == k, F.col("vec_id")))
    return s.groupBy("level", F.floor(F.col("q") / 2).alias("i")).agg(side(0).alias("key_a"), side(1).alias("key_b")).dropna()


_PAIRS = """q AS (SELECT key, label AS level, row_number() OVER (PARTITION BY label ORDER BY key) - 1 AS q FROM acts),
    pr AS (SELECT x.level, x.q // 2 AS i, x.key AS key_a, y.key AS key_b FROM q x JOIN q y ON x.level = y.level AND y.q = x.q + 1 WHERE x.q % 2 = 0),
    cn AS (SELECT level, count(*) AS n FROM pr GROUP BY 1), rot AS (SELECT p.*, n, o.key_b AS key_d FROM pr p JOIN cn USING (level) JOIN pr o ON o.level = p.level AND o.i = (p.i + 4) % n)"""


@query(f"""WITH {_CODE}, {_PAIRS}, u AS (SELECT level, n, key_a AS key, 1 AS b, 1 AS d FROM rot UNION ALL SELECT level, n, key_b, 1, 0 FROM rot UNION ALL SELECT level, n, key_d, 0, 1 FROM rot),
    s AS (SELECT level, feature_idx, sum(z * b) AS b, sum(z * d) AS d FROM u JOIN code USING (key) GROUP BY ALL)
    SELECT CAST(level AS BIGINT) AS level, e.id AS feature_idx, round(coalesce(b, 0) / (2 * n), 6) + 0.0 AS mean_b, round(coalesce(d, 0) / (2 * n), 6) + 0.0 AS mean_d,
    round(coalesce(b, 0) / (2 * n) - coalesce(d, 0) / (2 * n), 6) + 0.0 AS score FROM cn, enc e LEFT JOIN s ON s.level = cn.level AND s.feature_idx = e.id""".replace("FROM cn, enc e LEFT", "FROM (SELECT * FROM cn, enc) e LEFT").replace("s.level = cn.level", "s.level = e.level").replace("CAST(level AS", "CAST(e.level AS"))
def feature_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean activation on own and on rotated pairs; the score of this formula is 0 (see the operator)."""
    d = O.discrimination(_code(spark, sf_dir), _pairs(spark, sf_dir), ["level"], _features(spark, sf_dir), 4)
    return d.select(_LONG("level"), "feature_idx", *[rounded(F.col(c)).alias(c) for c in ("mean_b", "mean_d", "score")])


_CO = f"""{_CODE}, {_PAIRS}, own AS (SELECT level, a.feature_idx, sum(least(a.z, b.z)) AS s FROM rot JOIN code a ON a.key = key_a JOIN code b ON b.key = key_b AND b.feature_idx = a.feature_idx GROUP BY ALL),
    ro AS (SELECT level, a.feature_idx, sum(least(a.z, b.z)) AS s FROM rot JOIN code a ON a.key = key_a JOIN code b ON b.key = key_d AND b.feature_idx = a.feature_idx GROUP BY ALL),
    co AS (SELECT level, feature_idx, coalesce(own.s, 0) / n AS own, coalesce(ro.s, 0) / n AS rotated FROM own FULL JOIN ro USING (level, feature_idx) JOIN cn USING (level)),
    cr AS (SELECT CAST(level AS BIGINT) AS level, feature_idx, round(own, 6) + 0.0 AS own, round(rotated, 6) + 0.0 AS rotated, round(own - rotated, 6) + 0.0 AS contrast FROM co)"""


@query(f"WITH {_CO} SELECT * FROM cr")
def feature_co_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contrast that does tell own from rotated pairs: the smaller activation of both sides."""
    d = O.co_activation(_code(spark, sf_dir), _pairs(spark, sf_dir), ["level"], 4)
    return d.select(_LONG("level"), "feature_idx", *[rounded(F.col(c)).alias(c) for c in ("own", "rotated", "contrast")])


@query(f"WITH {_CO} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY contrast DESC, feature_idx) AS rank FROM cr) WHERE rank <= 5")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 features of the highest contrast per level."""
    return O.top_per_group(feature_co_activation(spark, sf_dir), ["level"], F.col("contrast"), "feature_idx", 5).withColumn("rank", F.col("rank").cast("bigint"))


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    g = e.where("vec_id between 64 and 127").select((F.col("vec_id") - 64).alias("key"), F.col("embedding").alias("v"))
    return O.match(g, _encoder(spark, sf_dir))


_MATCH = """bd AS (SELECT vec_id AS id, embedding::DOUBLE[] AS d FROM embeddings WHERE vec_id < 64), gd AS (SELECT vec_id - 64 AS key, embedding::DOUBLE[] AS d FROM embeddings WHERE vec_id BETWEEN 64 AND 127),
    cs AS (SELECT key, id, round(list_dot_product(gd.d, bd.d) / ((sqrt(list_dot_product(gd.d, gd.d)) + 1e-12) * (sqrt(list_dot_product(bd.d, bd.d)) + 1e-12)), 9) AS value FROM gd, bd),
    mt AS (SELECT key, id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS rn FROM cs) WHERE rn = 1)"""


@query(f"WITH {_MATCH} SELECT key AS global_feature_idx, id AS matched_base_feature_idx, round(value, 6) + 0.0 AS decoder_cosine FROM mt")
def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base feature nearest to each feature of the other model."""
    return _match(spark, sf_dir).select(F.col("key").alias("global_feature_idx"), F.col("id").alias("matched_base_feature_idx"), rounded(F.col("value")).alias("decoder_cosine"))


@query(f"""WITH {_MATCH} SELECT count(*) AS n, round(quantile_cont(value, 0.5), 6) + 0.0 AS median_cosine, round(avg(value), 6) + 0.0 AS mean_cosine,
    round(avg(CASE WHEN value > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_05, round(avg(CASE WHEN value > 0.8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_08 FROM mt""")
def feature_match_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda t: rounded(F.avg((F.col("value") > t).cast("double")))
    return _match(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), rounded(F.percentile("value", 0.5)).alias("median_cosine"), rounded(F.avg("value")).alias("mean_cosine"),
                                     share(0.5).alias("above_05"), share(0.8).alias("above_08"))


@query(f"""WITH {_CO}, {_MATCH}, g AS (SELECT feature_idx, contrast FROM cr WHERE level = 1), b AS (SELECT feature_idx, contrast FROM cr WHERE level = 0)
    SELECT key AS global_feature_idx, id AS matched_base_feature_idx, round(value, 6) + 0.0 AS decoder_cosine, coalesce(g.contrast, 0) AS global_score, coalesce(b.contrast, 0) AS base_matched_score,
    round(coalesce(g.contrast, 0) - coalesce(b.contrast, 0), 6) + 0.0 AS installation_score FROM mt LEFT JOIN g ON g.feature_idx = key LEFT JOIN b ON b.feature_idx = id
    ORDER BY installation_score DESC, key LIMIT 20""")
def installation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 features whose score rose most over the score of their match."""
    co = feature_co_activation(spark, sf_dir)
    g = co.where("level = 1").select(F.col("feature_idx").alias("key"), F.col("contrast").alias("gs"))
    b = co.where("level = 0").select(F.col("feature_idx").alias("id"), F.col("contrast").alias("bs"))
    m = _match(spark, sf_dir).join(g, "key", "left").join(b, "id", "left").fillna(0.0, ["gs", "bs"])
    out = m.select(F.col("key").alias("global_feature_idx"), F.col("id").alias("matched_base_feature_idx"), rounded(F.col("value")).alias("decoder_cosine"),
                   F.col("gs").alias("global_score"), F.col("bs").alias("base_matched_score"), rounded(F.col("gs") - F.col("bs")).alias("installation_score"))
    return out.orderBy(F.desc("installation_score"), "global_feature_idx").limit(20)


def _max_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _acts(spark, sf_dir)
    code = O.encode(acts.select("key", "v", "shard", "pos"), _encoder(spark, sf_dir), K, carry=["shard", "pos"])
    return O.max_activating_rows(code, acts.select("key", "shard", "pos"), 5)


_MAX = f"""{_CODE}, full_ AS (SELECT e.id AS feature_idx, a.key, a.shard, a.pos, coalesce(c.z, 0) AS activation FROM acts a, enc e LEFT JOIN code c ON c.key = a.key AND c.feature_idx = e.id),
    mx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY activation DESC, shard, pos) AS rank FROM
      (SELECT *, max(activation) OVER (PARTITION BY feature_idx, shard) AS m FROM full_) WHERE m > 0) WHERE rank <= 5)""".replace("FROM acts a, enc e LEFT JOIN code c ON c.key = a.key AND c.feature_idx = e.id", "FROM (SELECT * FROM acts, enc) a LEFT JOIN code c ON c.key = a.key AND c.feature_idx = a.id").replace("e.id AS", "a.id AS")


@query(f"WITH {_MAX} SELECT feature_idx, rank, shard, pos, round(activation, 6) + 0.0 AS activation FROM mx")
def max_activating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows on which each feature is strongest."""
    return _max_acts(spark, sf_dir).select("feature_idx", _LONG("rank"), "shard", "pos", rounded(F.col("activation")).alias("activation"))


@query(f"WITH {_MAX} SELECT feature_idx, rank, doc_id, replace(left(text, 80), chr(10), ' ') AS preview FROM mx JOIN (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) ON doc_id = key")
def max_activating_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those rows with the beginning of their text; rows without text are left out."""
    docs = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return _max_acts(spark, sf_dir).join(docs, F.col("key") == F.col("doc_id")).select(
        "feature_idx", _LONG("rank"), "doc_id", F.regexp_replace(F.left("text", F.lit(80)), "\n", " ").alias("preview"))


@query()
def sae_train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log of a small autoencoder on all vectors."""
    return O.train_log(_emb(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), 128, K, 128, 3)
