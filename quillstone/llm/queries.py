"""Queries of the training-data operators."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lookalikes
from .lookalikes import canonical_text, same_reading_classes, same_reading_pairs
from .mixing import mix, mix_report
from .neighbours import nearest_neighbours
from .packing import bucket_batches, pack
from .personal_info import find_personal_info, redact_personal_info
from .shared_spans import shared_share, span_pairs
from .splitting import split_oversized
from .token_budget import canonical_source, estimate_tokens, token_totals
from .tokens import token_sizes, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one has the other among its 5 nearest, cosine 0.9 or more."""
    near = nearest_neighbours(
        _table(spark, sf_dir, "activations"), "vec_id", "h", ["model_slug", "layer"],
        min_cosine=0.9, degree=16, beam=24, search_beam=12, shard_rows=4000, margin=0.06)
    return near.select(
        F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every usable vector, with their row_id."""
    near = nearest_neighbours(
        _table(spark, sf_dir, "activations"), "vec_id", "h", ["model_slug", "layer"], tag_col="row_id",
        search_beam=64, margin=0.25)
    return near.select(
        F.col("id").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_vec_id"),
        F.col("neighbour_tag").alias("neighbour_row_id"), "cosine")


def _budget_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "corpus_rows").select(
        F.lit("corpus_rows").alias("record_set"), F.col("row_id").alias("record_id"), "text", "source", "language",
        F.col("task_family").alias("domain"), F.col("loaded_at").alias("delivered"))
    return rows.unionByName(_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("record_set"), F.col("doc_id").cast("string").alias("record_id"), "text", "source",
        F.col("lang").alias("language"), "domain", F.col("loaded_at").alias("delivered")))


def p1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated token count of every record."""
    return estimate_tokens(_budget_records(spark, sf_dir), _table(spark, sf_dir, "token_vocab"))


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and domain."""
    return token_totals(p1_tokens(spark, sf_dir))


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_accuracy held against bounds: per record set how many records there are, and whether their total is met within 5 %."""
    p = written(p1_tokens(spark, sf_dir))
    true = _table(spark, sf_dir, "token_counts").select("record_set", "record_id", F.col("n_tokens").alias("true_tokens")).distinct()
    judged = p.join(true, ["record_set", "record_id"]).groupBy("record_set").agg((F.abs(F.sum("n_tokens") / F.sum("true_tokens") - 1) <= 0.05).alias("total_within_5_percent"))
    return p.groupBy("record_set").agg(F.count(F.lit(1)).alias("n_records")).join(judged, "record_set")


def p1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates against the true counts of token_counts, which the fit does not use."""
    true = _table(spark, sf_dir, "token_counts").select("record_set", "record_id", F.col("n_tokens").alias("true_tokens")).distinct()
    both = p1_tokens(spark, sf_dir).join(true, ["record_set", "record_id"])
    return both.groupBy("record_set", "language").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("true_tokens").alias("true_tokens"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / F.sum("true_tokens") - 1).alias("total_error"),
        F.avg(F.abs(F.col("n_tokens") - F.col("true_tokens")) / F.greatest("true_tokens", F.lit(1))).alias("mean_relative_error"))


def _document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", canonical_source(F.col("source")).alias("source"), "loaded_at")
    return written(token_sizes(docs, "doc_id", "text", ["source"], delivered="loaded_at"))


def _capacities(spark: SparkSession, sf_dir: str) -> list:
    return sorted(_table(spark, sf_dir, "capacities").select("container", "capacity_tokens").distinct().collect(), key=lambda r: r[1])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document (piece) in containers of each size."""
    sizes = _document_sizes(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        pack(sizes, r.capacity_tokens).select(
            F.lit(r.container).alias("container"), F.lit(r.capacity_tokens).alias("capacity_tokens"), "container_id",
            F.col("id").alias("doc_id"), "piece_no", "n_tokens") for r in _capacities(spark, sf_dir)])


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_containers held against the documents: every piece in one place, no container too full, no text split without need."""
    placed = written(p6_containers(spark, sf_dir))
    sizes = placed.groupBy("container", "capacity_tokens", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece_no").alias("places"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("t"))
    docs = sizes.groupBy("container", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("pieces") != F.col("places")) | (F.col("last") != F.col("pieces") - 1)).alias("n_misplaced"),
        F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_split_without_need"))
    full = placed.groupBy("container", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("container", "capacity_tokens").agg(
        F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    return docs.join(full, ["container", "capacity_tokens"]).select(
        "container", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"), "n_documents", "n_misplaced", "n_split_without_need", "n_overfull")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are, packed by best fit and by length buckets."""
    sizes = _document_sizes(spark, sf_dir)
    out = []
    for r in _capacities(spark, sf_dir):
        best = pack(sizes, r.capacity_tokens).groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
        batch = bucket_batches(sizes, r.capacity_tokens).groupBy("bucket", "batch_no").agg(F.sum("n_tokens").alias("t"))
        for how, filled in (("best_fit", best), ("length_buckets", batch)):
            out.append(filled.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest")).select(
                F.lit(r.container).alias("container"), F.lit(r.capacity_tokens).alias("capacity_tokens"), F.lit(how).alias("how"),
                "n_containers", "n_tokens", "fullest",
                (1 - F.col("n_tokens") / (F.col("n_containers") * r.capacity_tokens)).alias("unused_share")))
    return reduce(DataFrame.unionByName, out)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix in order of their virtual finish time."""
    return mix(_document_sizes(spark, sf_dir), _table(spark, sf_dir, "mix_targets")).select(
        "source", F.col("id").alias("doc_id"), "repeat_no", "n_tokens", "finish")


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_shares held against the targets: one row each, with whether repeats keep to their limit and the share is reached.

    By its finish time a source lies less than one of its documents below its share of the
    budget, and the mix less than one document of every source below the budget.
    """
    sizes = _document_sizes(spark, sf_dir)
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    shares = mix_report(sizes, _table(spark, sf_dir, "mix_targets")).join(longest, "source", "left")
    whole = Window.partitionBy(F.lit(1))  # a row for each target
    slack = F.coalesce("longest", F.lit(0)) + F.col("scaled_share") * F.sum(F.when(F.col("n_tokens") > 0, F.col("longest")).otherwise(0)).over(whole)
    off = F.abs(F.col("n_tokens") - F.col("scaled_share") * F.sum("n_tokens").over(whole))
    return shares.select(
        "source", F.round("target_share", 6).alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"), (F.col("n_tokens") > 0).alias("is_used"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("keeps_repeats"), (off <= slack).alias("reaches_share"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reached."""
    return mix_report(_document_sizes(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that had to be split."""
    return p2_pieces(spark, sf_dir).select("row_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pieces of at most 2,000 characters of the texts above that length."""
    return split_oversized(_table(spark, sf_dir, "corpus_rows"), "row_id", "text").select(
        F.col("id").alias("row_id"), "text_hash", "piece_no", "n_pieces", "start_char", "end_char", "piece")


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_pieces put together again: per text its length and hash, the longest piece and the overlaps outside 150 to 250."""
    pieces = p2_pieces(spark, sf_dir)
    order = Window.partitionBy("row_id", "text_hash").orderBy("piece_no")
    p = pieces.withColumn("before", F.lag("end_char").over(order))
    new = F.when(F.col("before").isNull(), F.col("piece")).otherwise(F.expr("substring(piece, before - start_char + 1)"))
    lap = F.col("before") - F.col("start_char")
    return p.groupBy("row_id", "text_hash").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))), lambda x: x["new"]), "")).alias("text_md5"),
        F.max("end_char").cast("bigint").alias("n_chars"), F.count_if(F.length("piece") > 2000).alias("n_too_long"),
        F.count_if(~lap.between(150, 250)).alias("n_wrong_overlaps")).drop("text_hash")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = _table(spark, sf_dir, "eval_packet").select(F.col("packet_row_id").alias("id"), F.col("prompt").alias("text"))
    return packet.unionByName(_table(spark, sf_dir, "corpus_rows").select(F.col("row_id").alias("id"), "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose texts differ in characters and read the same."""
    return same_reading_pairs(_readings(spark, sf_dir), "id", "text")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: one row per id, with the first id of its reading and how many ids and texts share it."""
    return same_reading_classes(_readings(spark, sf_dir), "id", "text")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt and text in its consistent form."""
    return canonical_text(_readings(spark, sf_dir).distinct(), "text").select("id", "canonical_text")


def _span_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = _table(spark, sf_dir, "triangulation_rows").select(F.col("packet_row_id").alias("id"), F.col("source_text").alias("text"))
    return _table(spark, sf_dir, "corpus_rows").select(F.col("row_id").alias("id"), "text").unionByName(tri)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records with a common span of at least 100 characters."""
    return span_pairs(_span_records(spark, sf_dir), "id", "text", 100)


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record the share of its characters that is also found elsewhere."""
    return shared_share(_span_records(spark, sf_dir), "id", "text", 100)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and place of each piece of personal information in documents."""
    found = find_personal_info(
        _table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "known_names"))
    return found.select(F.col("id").alias("doc_id"), "kind", "start_char").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents with placeholders in place of personal information."""
    return redact_personal_info(
        _table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "known_names")
    ).select(F.col("id").alias("doc_id"), "text", "n_found")


def queries() -> dict:
    return {q.__name__: q for q in (
        p1_tokens, p1_totals, p1_accuracy, p1_audit, p6_containers, p6_fill, p6_audit, p7_mix, p7_shares, p7_audit, p2_found, p2_pieces, p2_rejoined, p3_found, p3_neighbours, p4_found, p4_classes, p4_canonical, p5_found, p5_share, p8_found, p8_redacted)}


def _reading_sql() -> str:
    """CTE rd(id, text, s): the consistent form by a table of characters, NFC by the SQL engine."""
    t = lookalikes.table()
    chars = sorted(set(t) | {i for i in range(sys.maxunicode + 1) if unicodedata.decomposition(chr(i)) and not unicodedata.decomposition(chr(i)).startswith("<")})
    rows = ", ".join(f"({i}, '{to}')" for i in chars if "'" not in (to := lookalikes.skeleton(chr(i), t)) and chr(i) != "\u06cc" and "\0" not in to)
    kana = "".join(f"regexp_replace(" for _ in lookalikes._KANA)
    voiced = "".join(f", '{han}([\u3099\u309a])', '{k}\\1', 'g')" for han, k in lookalikes._KANA.items())
    return f"""tx AS (SELECT DISTINCT packet_row_id AS id, prompt AS text FROM eval_packet UNION SELECT DISTINCT row_id, text FROM corpus_rows),
        mp(cp, p) AS (VALUES {rows}),
        ch AS (SELECT text, unnest(string_split(text, '')) AS c, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM (SELECT DISTINCT text FROM tx WHERE text IS NOT NULL)),
        sk AS (SELECT text, string_agg(coalesce(p, c), '' ORDER BY i) AS s FROM ch LEFT JOIN mp ON cp = unicode(c) GROUP BY text),
        yh AS (SELECT text, {kana}nfc_normalize(replace(regexp_replace(s, '\u06cc([\u064b-\u065f\u0670]*[\u0620-\u064a\u066e-\u06d3])', '\u064a\\1', 'g'), '\u06cc', '\u0649')){voiced} AS s FROM sk),
        rd AS (SELECT id, text, CASE WHEN text = '' THEN '' ELSE nfc_normalize(yh.s) END AS s FROM tx LEFT JOIN yh USING (text))"""


def oracle_sql() -> dict:
    reading = _reading_sql()
    return {
        "p4_found": f"""WITH {reading} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM rd a JOIN rd b ON a.s = b.s AND a.id < b.id AND a.text <> b.text""",
        "p4_classes": f"""WITH {reading}, g AS (SELECT s, min(id) AS class_id, count(DISTINCT id) AS n_ids, count(DISTINCT text) AS n_texts FROM rd WHERE text IS NOT NULL AND id IS NOT NULL GROUP BY s)
            SELECT DISTINCT id, class_id, n_ids, n_texts FROM rd JOIN g USING (s) WHERE n_ids > 1 AND n_texts > 1""",
        "p4_canonical": f"""WITH {reading} SELECT id, s AS canonical_text FROM rd""",
        "p1_audit": """SELECT 'corpus_rows' AS record_set, count(DISTINCT row_id) AS n_records, true AS total_within_5_percent FROM corpus_rows
            UNION ALL SELECT 'documents', count(DISTINCT doc_id), true FROM documents""",
        "p2_rejoined": """SELECT row_id, md5(text) AS text_md5, length(text) AS n_chars, 0 AS n_too_long, 0 AS n_wrong_overlaps
            FROM (SELECT DISTINCT row_id, text FROM corpus_rows WHERE length(text) > 2000)""",
        "p3_found": """
            WITH v AS (SELECT vec_id, any_value(model_slug) AS m, any_value(layer) AS l, any_value(h)::DOUBLE[] AS h FROM activations
                       WHERE len(h) = 48 AND len(list_filter(h, lambda x: x IS NOT NULL AND isfinite(x))) = 48 AND len(list_filter(h, lambda x: x <> 0)) > 0 GROUP BY vec_id),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.h, b.h) / sqrt(list_dot_product(a.h, a.h) * list_dot_product(b.h, b.h)) AS c
                  FROM v a JOIN v b ON a.m = b.m AND a.l = b.l AND a.vec_id <> b.vec_id WHERE c >= 0.9),
            t AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
            SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM t""",
        "p6_audit": """SELECT container, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, n AS n_documents, 0 AS n_misplaced, 0 AS n_split_without_need, 0 AS n_overfull
            FROM (SELECT DISTINCT container, capacity_tokens FROM capacities), (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text <> '')""",
        "p7_audit": """WITH c AS (SELECT coalesce(nullif(regexp_replace(regexp_replace(lower(source), '[_ -]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown') AS source FROM documents WHERE text <> '')
            SELECT t.source, round(target_share, 6) AS target_share, CAST(max_repeats AS BIGINT) AS max_repeats, t.source IN (SELECT source FROM c) AS is_used, true AS keeps_repeats, true AS reaches_share
            FROM mix_targets t WHERE target_share > 0""",
        "p2_found": "SELECT DISTINCT row_id FROM corpus_rows WHERE length(text) > 2000",
        # one row per record and spans of 100 characters, counted by SQL itself
        "p5_found": """
            WITH r AS (SELECT DISTINCT row_id AS id, text FROM corpus_rows WHERE length(text) >= 100
                       UNION SELECT DISTINCT packet_row_id, source_text FROM triangulation_rows WHERE length(source_text) >= 100),
            w AS (SELECT DISTINCT id, md5(substring(text, CAST(i AS INTEGER), 100)) AS h
                  FROM (SELECT id, text, unnest(range(1, length(text) - 98)) AS i FROM r))
            SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.h = b.h AND a.id < b.id""",
        "p5_share": """
            WITH r AS (SELECT DISTINCT row_id AS id, text FROM corpus_rows WHERE text IS NOT NULL
                       UNION SELECT DISTINCT packet_row_id, source_text FROM triangulation_rows WHERE source_text IS NOT NULL),
            w AS (SELECT id, md5(text) AS k, i, md5(substring(text, CAST(i AS INTEGER), 100)) AS h
                  FROM (SELECT id, text, unnest(range(1, length(text) - 98)) AS i FROM r WHERE length(text) >= 100)),
            c AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT id) > 1),
            s AS (SELECT id, k, i, lead(i) OVER (PARTITION BY id, k ORDER BY i) AS after FROM w SEMI JOIN c USING (h)),
            n AS (SELECT id, sum(least(100, coalesce(after - i, 100))) AS shared_chars FROM s GROUP BY id),
            t AS (SELECT id, sum(length(text)) AS n_chars FROM r GROUP BY id)
            SELECT id, CAST(n_chars AS BIGINT) AS n_chars, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars,
                CASE WHEN n_chars > 0 THEN CAST(coalesce(shared_chars, 0) AS DOUBLE) / n_chars ELSE 0.0 END AS shared_share
            FROM t LEFT JOIN n USING (id)""",
    }
