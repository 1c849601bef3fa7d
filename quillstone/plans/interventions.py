"""Queries: divergence, log-probabilities, patch effects and their summaries, files and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import add_scaled, rounded
from ..operators import interventions as I
from ..operators.projection import project_log_probs
from ..sources import files
from .bindings import LOGITS, PACKET, packet, states, table, unembed
from .registry import query
from .texts import _METRICS, _metrics

_LONG = lambda c: F.col(c).cast("bigint").alias(c)
_SPLIT = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _tokens(c: str):
    return F.filter(F.split(c, "[ \t\n\r]+"), lambda x: x != "")


_DIV = f"""{PACKET}, tk AS (SELECT packet_row_id, {_SPLIT.format('prompt')} AS a, {_SPLIT.format('reference_text')} AS b FROM eval_packet_1 WHERE prompt IS NOT NULL AND reference_text IS NOT NULL)"""


@query(f"""WITH {_DIV}, d AS (SELECT packet_row_id, len(a) AS n_a, len(b) AS n_b, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) AS o FROM tk)
    SELECT packet_row_id, n_a, n_b, CASE WHEN len(o) > 0 THEN o[1] - 1 WHEN n_a <> n_b THEN least(n_a, n_b) END AS divergence FROM d""")
def token_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where prompt and reference first differ, in words."""
    p = packet(spark, sf_dir).where("prompt is not null and reference_text is not null").select("packet_row_id", _tokens("prompt").alias("a"), _tokens("reference_text").alias("b"))
    return p.select("packet_row_id", F.size("a").cast("bigint").alias("n_a"), F.size("b").cast("bigint").alias("n_b"), I.first_divergence(F.col("a"), F.col("b")).cast("bigint").alias("divergence"))


def _case_log_probs(spark: SparkSession, sf_dir: str, tokens: dict[str, Column]) -> DataFrame:
    """(arm, case_id, pos, id, logit, log_prob) of the tokens asked for, given by (i, level); levels are positions of the case (arm, rank)."""
    p = states(spark, sf_dir, "i").where("vec_id >= 100").select(
        F.col("vec_id").alias("key"), F.col("h").alias("v"), F.col("model_slug").alias("arm"), F.col("i").cast("bigint").alias("case_id"),
        F.col("level").cast("bigint").alias("pos"))
    p = p.withColumns(tokens).withColumn("ids", F.array_distinct(F.array(*tokens)))
    return project_log_probs(p, unembed(spark, sf_dir), ids="ids", carry=["arm", "case_id", "pos", *tokens])


def _given() -> Column:
    return F.pmod(F.col("case_id") * 7 + F.col("pos"), F.lit(100)).cast("bigint")


def _branch() -> Column:
    return F.pmod(F.col("case_id") * 11 + F.col("pos") + 1, F.lit(100)).cast("bigint")


_TF = LOGITS + """, lp AS (SELECT model_slug AS arm, i AS case_id, CAST(level AS BIGINT) AS pos, token_id, logit, ln(prob) AS log_prob FROM probs),
    tf AS (SELECT * FROM lp WHERE token_id = (case_id * 7 + pos) % 100), tb AS (SELECT case_id, pos, token_id, max(CASE WHEN arm = 'base' THEN log_prob END) AS base, max(CASE WHEN arm = 'global' THEN log_prob END) AS global_ FROM tf GROUP BY ALL)"""


def _per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_log_probs(spark, sf_dir, {"given": _given()}).select("arm", "case_id", "pos", F.col("id").alias("token_id"), "log_prob")


@query(f"WITH {_TF} SELECT arm, case_id, round(sum(log_prob), 6) + 0.0 AS log_prob, count(*) AS n_tokens FROM tf GROUP BY ALL")
def teacher_forced_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of a given continuation, per case and arm."""
    cases = states(spark, sf_dir, "i").where("vec_id >= 100").select(F.col("model_slug").alias("arm"), F.col("i").cast("bigint").alias("case_id"))
    s = I.sequence_log_prob(_per_token(spark, sf_dir), cases, ["arm", "case_id"])
    return s.select("arm", "case_id", rounded(F.col("log_prob")).alias("log_prob"), "n_tokens")


@query(f"WITH {_TF} SELECT arm, case_id, pos, token_id, round(log_prob, 6) + 0.0 AS log_prob FROM tf")
def per_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, token by token."""
    return _per_token(spark, sf_dir).select("arm", "case_id", "pos", "token_id", rounded(F.col("log_prob")).alias("log_prob"))


@query(f"""WITH {_TF}, a AS (SELECT arm, pos, count(*) AS n, avg(log_prob) AS m FROM tf GROUP BY ALL), b AS (SELECT pos, m FROM a WHERE arm = 'base')
    SELECT a.arm AS direction, pos AS layer, n, round(a.m - b.m, 6) + 0.0 AS mean_shift FROM a JOIN b USING (pos) WHERE a.arm <> 'base'""")
def logprob_shift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log-probability shift against the base arm, per arm and layer."""
    m = _per_token(spark, sf_dir).groupBy("arm", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("log_prob").alias("m"))
    b = m.where("arm = 'base'").select("pos", F.col("m").alias("b"))
    return m.where("arm != 'base'").join(b, "pos").select(F.col("arm").alias("direction"), F.col("pos").alias("layer"), "n", rounded(F.col("m") - F.col("b")).alias("mean_shift"))


@query(f"""WITH {_TF}, g AS (SELECT arm, case_id, pos, max(CASE WHEN token_id = (case_id * 7 + pos) % 100 THEN logit END) AS one, max(CASE WHEN token_id = (case_id * 11 + pos + 1) % 100 THEN logit END) AS other FROM lp GROUP BY ALL),
    m AS (SELECT arm, case_id, pos, one - other AS margin FROM g)
    SELECT b.case_id, b.pos, round(b.margin, 6) + 0.0 AS baseline_value, round(w.margin, 6) + 0.0 AS patched_value, round(w.margin - b.margin, 6) + 0.0 AS effect FROM m b JOIN m w ON w.arm <> 'base' AND b.arm = 'base' AND b.case_id = w.case_id AND b.pos = w.pos""")
def branch_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit of one token less that of another, before and after."""
    l = _case_log_probs(spark, sf_dir, {"given": _given(), "branch": _branch()})
    at = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("logit")))
    m = l.groupBy("arm", "case_id", "pos").agg((at("given") - at("branch")).alias("margin"))
    b = m.where("arm = 'base'").select("case_id", "pos", F.col("margin").alias("baseline_value"))
    w = m.where("arm != 'base'").select("case_id", "pos", F.col("margin").alias("patched_value"))
    e = I.effects(b.join(w, ["case_id", "pos"]))
    return e.select("case_id", "pos", *[rounded(F.col(c)).alias(c) for c in ("baseline_value", "patched_value", "effect")])


_REL = "((subtask, metric_name) IN (('json_format','is_json_valid'),('quotation','has_quotation_wrap'),('no_comma','no_comma_compliance')) OR metric_name IN ('target_lang_script_ratio','chrf_to_global'))"
_EFF = f"""{_METRICS}, lg AS (SELECT packet_row_id, side, subtask, unnest(['is_json_valid','has_quotation_wrap','no_comma_compliance','target_lang_script_ratio','chrf_to_global']) AS metric_name,
      unnest([is_json_valid, has_quotation_wrap, no_comma_compliance, target_lang_script_ratio, chrf_to_global]) AS patched_value FROM metrics),
    mean_ AS (SELECT metric_name, avg(patched_value) AS baseline_value FROM lg GROUP BY 1),
    eff AS (SELECT packet_row_id AS case_id, subtask, side, metric_name, round(baseline_value, 6) + 0.0 AS baseline_value, patched_value, round(patched_value - baseline_value, 6) + 0.0 AS effect, {_REL} AS is_relevant_metric FROM lg JOIN mean_ USING (metric_name))"""


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric against its mean over all cases as the baseline."""
    names = [*I.SUBTASK_METRICS.values(), *I.COMMON_METRICS]
    long = _metrics(spark, sf_dir).unpivot(["packet_row_id", "side", "subtask"], names, "metric_name", "patched_value")
    mean = long.groupBy("metric_name").agg(rounded(F.avg("patched_value")).alias("baseline_value"))
    e = I.effects(long.join(F.broadcast(mean), "metric_name")).withColumn("is_relevant_metric", I.relevant(F.col("subtask"), F.col("metric_name")))
    return e.select(F.col("packet_row_id").alias("case_id"), "subtask", "side", "metric_name", "baseline_value", "patched_value", rounded(F.col("effect")).alias("effect"), "is_relevant_metric")


_EFF = _EFF.replace("avg(patched_value) AS baseline_value", "round(avg(patched_value), 6) + 0.0 AS baseline_value")


@query(f"WITH {_EFF} SELECT * FROM eff")
def patch_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case and metric: baseline, patched, effect (missing if either is)."""
    return _effects(spark, sf_dir)


@query(f"WITH {_EFF} SELECT subtask, side, round(avg(effect), 8) + 0.0 AS mean_effect, count(effect) AS n FROM eff WHERE is_relevant_metric GROUP BY ALL")
def patch_effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean effect over relevant metrics."""
    return _effects(spark, sf_dir).where("is_relevant_metric").groupBy("subtask", "side").agg(rounded(F.avg("effect"), 8).alias("mean_effect"), F.count("effect").alias("n"))


@query(f"""WITH {_EFF}, grid AS (SELECT DISTINCT case_id, d AS direction, l AS layer FROM eff, (VALUES ('base_to_global'), ('global_to_base')) v(d), (VALUES (20), (26), (30)) w(l)),
    m AS (SELECT case_id, avg(effect) AS effect FROM eff WHERE is_relevant_metric AND effect IS NOT NULL GROUP BY 1)
    SELECT case_id, direction, CAST(layer AS BIGINT) AS layer, round(CASE WHEN direction = 'base_to_global' THEN effect ELSE -effect END, 8) + 0.0 AS effect FROM grid LEFT JOIN m USING (case_id)""")
def isolation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case x direction x layer grid with the mean change of the relevant metrics, missing where none is known."""
    e = _effects(spark, sf_dir)
    m = e.where("is_relevant_metric and effect is not null").groupBy("case_id").agg(F.avg("effect").alias("effect"))
    grid = e.select("case_id").distinct().select("case_id", F.explode(F.array(F.lit("base_to_global"), F.lit("global_to_base"))).alias("direction")).select(
        "case_id", "direction", F.explode(F.array(F.lit(20), F.lit(26), F.lit(30)).cast("array<bigint>")).alias("layer"))
    signed = F.when(F.col("direction") == "base_to_global", F.col("effect")).otherwise(-F.col("effect"))
    return grid.join(m, "case_id", "left").select("case_id", "direction", "layer", rounded(signed, 8).alias("effect"))


_EV = "ev AS (SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS effect, event_type AS task, user_id % 3 AS layer, event_id % 2 AS direction FROM events)"


@query(f"""WITH {_EV} SELECT layer, task, direction, count(effect) AS n_observations, round(avg(effect), 6) + 0.0 AS mean_effect, round(quantile_cont(effect, 0.5), 6) + 0.0 AS median_effect, round(stddev_samp(effect), 6) + 0.0 AS std_effect FROM ev GROUP BY ALL""")
def isolation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, median and deviation of effects, missing ones left out (events stand for observations)."""
    s = I.summarise(_observations(spark, sf_dir), ["layer", "task", "direction"])
    return s.select("layer", "task", "direction", "n_observations", *[rounded(F.col(c)).alias(c) for c in ("mean_effect", "median_effect", "std_effect")])


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.pmod("event_id", F.lit(17)) != 0, F.col("value")).alias("effect"), F.col("event_type").alias("task"), F.pmod("user_id", F.lit(3)).alias("layer"), F.pmod("event_id", F.lit(2)).alias("direction"))


_S2 = "s AS (SELECT label AS level, vec_id, embedding::DOUBLE[] AS h, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)"


@query(f"""WITH {_S2}, d AS (SELECT r, h FROM s WHERE level = 9) SELECT s.vec_id, round(list_sum(CASE WHEN s.level = 5 THEN coalesce(d.h, s.h) ELSE s.h END), 6) + 0.0 AS total FROM s LEFT JOIN d ON d.r = s.r""")
def state_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of level 5 replaced by those of level 9 of the same row, where there is one."""
    s = states(spark, sf_dir, "r").select("level", "r", "vec_id", "h")
    donors = s.where("level = 9").select(F.lit(5).alias("level"), "r", F.col("h").alias("donor"))
    p = I.patch_states(s, donors, ["level", "r"])
    return p.select("vec_id", rounded(F.aggregate("h", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))


@query("""WITH d AS (SELECT embedding::DOUBLE[] AS d FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS h FROM embeddings)
    SELECT vec_id, round(list_dot_product(h, d) + 2.5 * list_dot_product(d, d), 6) + 0.0 AS along FROM e, d""")
def state_steer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each state lies along a direction after 2.5 times the direction was added."""
    from ..functions.vectors import dot

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = e.where("vec_id = 0").select(F.col("embedding").alias("d"))
    return e.crossJoin(F.broadcast(d)).select("vec_id", rounded(dot(add_scaled(F.col("embedding"), F.col("d"), 2.5), F.col("d"))).alias("along"))


@query("SELECT DISTINCT row_id, source, language, text, is_enterprise_prompt, task_family FROM corpus_rows")
def io_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as JSON lines to the shared folder and read again."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "corpus_rows").select("row_id", "source", "language", "text", "is_enterprise_prompt", "task_family").distinct()
    files.write_jsonl(rows, f"{folder}/corpus.jsonl")
    return files.read_jsonl(spark, f"{folder}/corpus.jsonl", files.CORPUS_SCHEMA).select("row_id", "source", "language", "text", "is_enterprise_prompt", "task_family")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one where it is unset and all tasks run here."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query()
def experiment_summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown table and a JSON text of the effect summary."""
    s = isolation_summary(spark, sf_dir)
    lines = files.markdown(s, ["layer", "task", "direction", "n_observations", "mean_effect", "median_effect", "std_effect"], ["layer", "task", "direction"])
    return lines.unionByName(spark.createDataFrame([(files.summary_json({"isolation": s}, ["events"]),)], "line string"))
