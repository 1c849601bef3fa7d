"""Queries: text metrics, scripts and steering scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions.text import BLANK, char_f_score, char_f_scores, is_json, script_ratio, stripped
from ..functions.vectors import rounded
from ..operators.interventions import SUBTASK_METRICS, COMMON_METRICS, lifted, relevant
from .bindings import CORPUS, PACKET, corpus, packet, table
from .registry import query

_LONG = lambda c: F.col(c).cast("bigint").alias(c)
_STRIP = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
_SQUASH = lambda c: f"regexp_replace({_STRIP(c)}, '{BLANK}+', ' ', 'g')"


def chrf_sql(source: str, key: str, p: str, r: str) -> str:
    """CTE chrf(key, chrf) over `source`."""
    return f"""sq AS (SELECT {key} AS key, {_SQUASH(f"coalesce({p}, '')")} AS p, {_SQUASH(f"coalesce({r}, '')")} AS r FROM {source}),
    sd AS (SELECT key, 0 AS side, p AS t, n FROM sq, range(1, 7) t(n) WHERE p <> '' AND r <> '' UNION ALL SELECT key, 1, r, n FROM sq, range(1, 7) t(n) WHERE p <> '' AND r <> ''),
    gr AS (SELECT key, side, n, substring(t, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM sd WHERE length(t) >= n)),
    ct AS (SELECT key, n, gram, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM gr GROUP BY ALL),
    od AS (SELECT key, n, sum(least(a, b)) AS hit, sum(a) AS a, sum(b) AS b FROM ct GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0),
    pr_ AS (SELECT key, avg(hit / a) AS p, avg(hit / b) AS r FROM od GROUP BY 1),
    chrf AS (SELECT sq.key, CASE WHEN pr_.p IS NULL OR (pr_.p = 0 AND pr_.r = 0) THEN 0 ELSE 5 * pr_.p * pr_.r / (4 * pr_.p + pr_.r) END AS chrf FROM sq LEFT JOIN pr_ USING (key))"""


@query(f"WITH {PACKET}, src AS (SELECT * FROM eval_packet_1 WHERE reference_text IS NOT NULL), {chrf_sql('src', 'packet_row_id', 'prompt', 'reference_text')} SELECT key AS packet_row_id, round(chrf, 6) + 0.0 AS chrf FROM chrf")
def chrf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character F-score of each prompt against its reference text."""
    p = packet(spark, sf_dir).where("reference_text is not null")
    return char_f_scores(p, "packet_row_id", "prompt", "reference_text").select("packet_row_id", rounded(F.col("chrf")).alias("chrf"))


def _ratio_sql(t: str, side: str) -> str:
    letters = f"regexp_replace({t}, '[^\\p{{L}}]', '', 'g')"
    return f"""CASE WHEN length({letters}) = 0 THEN 0 WHEN {side} = 'JA' THEN length(regexp_replace({letters}, '[^\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / length({letters})
      WHEN {side} = 'KO' THEN length(regexp_replace({letters}, '[^\\x{{ac00}}-\\x{{d7af}}]', '', 'g')) / length({letters}) ELSE 0 END"""


@query(f"WITH {CORPUS}, s AS (SELECT row_id, text, CASE WHEN language IN ('ja','jpn_Jpan') THEN 'JA' WHEN language IN ('ko','kor_Hang') THEN 'KO' ELSE 'EN' END AS side FROM corpus_rows_1 WHERE text IS NOT NULL) SELECT row_id, side, round({_ratio_sql('text', 'side')}, 6) + 0.0 AS ratio FROM s")
def script_ratio_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of letters in the script of each row's side."""
    side = F.when(F.col("language").isin("ja", "jpn_Jpan"), "JA").when(F.col("language").isin("ko", "kor_Hang"), "KO").otherwise("EN")
    rows = corpus(spark, sf_dir).where("text is not null").select("row_id", "text", side.alias("side"))
    return rows.select("row_id", "side", rounded(script_ratio(F.col("text"), F.col("side"))).alias("ratio"))


def _iv() -> str:
    return "iv(lo, hi, script) AS (VALUES " + ", ".join(map(repr, S.intervals())) + ")"


@query(f"""WITH {CORPUS}, {_iv()}, c AS (SELECT language, unicode(ch) AS cp, count(*) AS n FROM (SELECT language, unnest(string_split(text, '')) AS ch FROM corpus_rows_1 WHERE text IS NOT NULL) WHERE ch <> '' GROUP BY ALL)
    SELECT coalesce(language, '(none)') AS language, coalesce(script, 'OTHER') AS script, CAST(sum(n) AS BIGINT) AS n_chars FROM c LEFT JOIN iv ON cp BETWEEN lo AND hi GROUP BY ALL""")
def char_script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per script and language."""
    rows = corpus(spark, sf_dir).select(F.coalesce("language", F.lit("(none)")).alias("language"), "text")
    return S.char_scripts(rows, "language", "text").groupBy("language", "script").agg(F.sum("n").alias("n_chars"))


@query(f"""WITH {_iv()}, v AS (SELECT token_id, min(piece) AS piece FROM token_vocab WHERE piece IS NOT NULL GROUP BY 1), c AS (SELECT token_id, unicode(ch) AS cp FROM (SELECT token_id, unnest(string_split(piece, '')) AS ch FROM v) WHERE ch <> ''),
    s AS (SELECT token_id, coalesce(script, 'OTHER') AS script, count(*) AS n FROM c LEFT JOIN iv ON cp BETWEEN lo AND hi GROUP BY ALL),
    k AS (SELECT token_id, script, row_number() OVER (PARTITION BY token_id ORDER BY script = 'OTHER', n DESC, script) AS rn FROM s)
    SELECT v.token_id, coalesce(script, 'OTHER') AS script FROM v LEFT JOIN k ON k.token_id = v.token_id AND rn = 1""")
def token_script_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prevailing script of every vocabulary piece."""
    v = table(spark, sf_dir, "token_vocab").where("piece is not null").groupBy("token_id").agg(F.min("piece").alias("piece"))
    return S.majority_script(v, "token_id", "piece")


def _side():
    return F.upper(F.left(F.col("packet_row_id"), F.lit(2)))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet_row_id, subtask, metrics...): the prompt as a continuation, the reference text as the global one."""
    p = packet(spark, sf_dir).withColumn("t", stripped(F.col("prompt")))
    chrf = F.when(F.col("reference_text").isNotNull(), char_f_score(F.col("prompt"), F.col("reference_text")))
    return p.select(
        "packet_row_id", _side().alias("side"), F.split_part("packet_row_id", F.lit("-"), F.lit(3)).alias("subtask"), is_json(F.col("t")).alias("is_json_valid"),
        (F.col("t").startswith('"') & F.col("t").endswith('"')).cast("double").alias("has_quotation_wrap"), (~F.contains("t", F.lit(","))).cast("double").alias("no_comma_compliance"),
        rounded(script_ratio(F.col("t"), _side())).alias("target_lang_script_ratio"), rounded(chrf).alias("chrf_to_global"))


_METRICS = f"""{PACKET}, src AS (SELECT * FROM eval_packet_1 WHERE reference_text IS NOT NULL), {chrf_sql('src', 'packet_row_id', 'prompt', 'reference_text')},
    m0 AS (SELECT packet_row_id, upper(left(packet_row_id, 2)) AS side, split_part(packet_row_id, '-', 3) AS subtask, {_STRIP('prompt')} AS t FROM eval_packet_1),
    metrics AS (SELECT packet_row_id, side, subtask, CAST(json_valid(t) AS DOUBLE) AS is_json_valid, CAST(starts_with(t, '"') AND ends_with(t, '"') AS DOUBLE) AS has_quotation_wrap,
      CAST(NOT contains(t, ',') AS DOUBLE) AS no_comma_compliance, round({_ratio_sql('t', 'side')}, 6) + 0.0 AS target_lang_script_ratio, round(chrf, 6) + 0.0 AS chrf_to_global
      FROM m0 LEFT JOIN chrf ON key = packet_row_id)"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def continuation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics of each continuation; the F-score is null without a reference."""
    return _metrics(spark, sf_dir)


@query("""SELECT DISTINCT subtask, metric_name, (subtask, metric_name) IN (('json_format','is_json_valid'),('quotation','has_quotation_wrap'),('no_comma','no_comma_compliance')) OR metric_name IN ('target_lang_script_ratio','chrf_to_global') AS is_relevant
    FROM (SELECT split_part(packet_row_id, '-', 3) AS subtask FROM eval_packet WHERE contains(packet_row_id, '-mif-')), (VALUES ('is_json_valid'),('has_quotation_wrap'),('no_comma_compliance'),('target_lang_script_ratio'),('chrf_to_global')) v(metric_name)""")
def metric_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics count for which subtask."""
    subtasks = table(spark, sf_dir, "eval_packet").where(F.contains("packet_row_id", F.lit("-mif-"))).select(F.split_part("packet_row_id", F.lit("-"), F.lit(3)).alias("subtask")).distinct()
    names = F.explode(F.array(*map(F.lit, (*SUBTASK_METRICS.values(), *COMMON_METRICS))))
    return subtasks.select("subtask", names.alias("metric_name")).withColumn("is_relevant", relevant(F.col("subtask"), F.col("metric_name")))


@query(f"""WITH {PACKET}, g AS (SELECT CASE WHEN starts_with(packet_row_id, 'ja') THEN 'JA' WHEN starts_with(packet_row_id, 'ko') THEN 'KO' END AS side, split_part(packet_row_id, '-', 2) AS subtask, source_row_id, reference_text AS continuation, packet_row_id FROM eval_packet_1 WHERE reference_text IS NOT NULL),
    l AS (SELECT side, subtask, source_row_id, continuation FROM (SELECT *, row_number() OVER (PARTITION BY side, subtask, source_row_id ORDER BY packet_row_id DESC) AS rn FROM g) WHERE rn = 1)
    SELECT p.packet_row_id, l.continuation, l.continuation IS NOT NULL AS is_found FROM eval_packet_1 p LEFT JOIN l ON l.side = upper(left(p.packet_row_id, 2)) AND l.subtask = split_part(p.packet_row_id, '-', 2) AND l.source_row_id = p.source_row_id""")
def continuation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference continuation by side, subtask and source id; of several the last by id."""
    p = packet(spark, sf_dir).withColumn("side", F.when(F.col("packet_row_id").startswith("ja"), "JA").when(F.col("packet_row_id").startswith("ko"), "KO")).withColumn(
        "subtask", F.split_part("packet_row_id", F.lit("-"), F.lit(2)))
    keys = ["side", "subtask", "source_row_id"]
    last = p.where("reference_text is not null").groupBy(*keys).agg(F.max(F.struct("packet_row_id", "reference_text")).alias("m")).select(*keys, F.col("m.reference_text").alias("continuation"))
    return p.withColumn("side", _side()).join(last, keys, "left").select("packet_row_id", "continuation", F.col("continuation").isNotNull().alias("is_found"))


@query(f"""WITH {_METRICS}, l AS (UNPIVOT metrics ON is_json_valid, has_quotation_wrap, no_comma_compliance, target_lang_script_ratio, chrf_to_global INTO NAME metric_name VALUE steered),
    b AS (SELECT m0.packet_row_id, 0.25::DOUBLE AS baseline FROM m0), j AS (SELECT subtask, side, packet_row_id, metric_name, ((subtask, metric_name) IN (('json_format','is_json_valid'),('quotation','has_quotation_wrap'),('no_comma','no_comma_compliance'))
      OR metric_name IN ('target_lang_script_ratio','chrf_to_global')) AND steered > baseline AS lifted FROM l JOIN b USING (packet_row_id)),
    c AS (SELECT subtask, side, packet_row_id, bool_or(lifted) AS lifted FROM j GROUP BY ALL)
    SELECT subtask, side, count(*) FILTER (lifted) AS lifted_cases, count(*) AS total_cases FROM c GROUP BY ALL""")
def steering_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in which a relevant metric rises above its baseline (0.25 here), per subtask and side."""
    names = [*SUBTASK_METRICS.values(), *COMMON_METRICS]
    long = _metrics(spark, sf_dir).unpivot(["packet_row_id", "side", "subtask"], names, "metric_name", "steered")
    up = lifted(relevant(F.col("subtask"), F.col("metric_name")), F.lit(0.25), F.col("steered"))
    case = long.groupBy("subtask", "side", "packet_row_id").agg(F.bool_or(up).alias("lifted"))
    return case.groupBy("subtask", "side").agg(F.count_if("lifted").alias("lifted_cases"), F.count(F.lit(1)).alias("total_cases"))
