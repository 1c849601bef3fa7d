"""Queries: corpora, packets, tokens and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenizer import token_ids
from ..functions.vectors import rounded
from ..operators import corpus as C
from ..operators.ranking import dense_index, minibatches, shard_assignment
from ..sources import catalogue
from .bindings import CORPUS, PACKET, corpus, latest_sql, packet, table
from .registry import query

_LONG = lambda c: F.col(c).cast("bigint").alias(c)
# Pair labels and the languages of their sides.
PAIRS = [("JA-EN", "jpn_Jpan", "eng_Latn"), ("KO-EN", "kor_Hang", "eng_Latn"), ("AR-EN", "arb_Arab", "eng_Latn"), ("JA-Zh", "jpn_Jpan", "cmn_Hans")]
NAMES = {"jpn_Jpan": "Japanese", "kor_Hang": "Korean", "arb_Arab": "Arabic", "eng_Latn": "English", "cmn_Hans": "Chinese"}
_FAMILY_SQL = "CASE " + " ".join(f"WHEN starts_with(packet_row_id, '{f}-') THEN '{f}'" for f in C.FAMILIES) + " ELSE 'unknown' END"


@query(f"WITH {PACKET} SELECT packet_row_id, {_FAMILY_SQL} AS task_family, coalesce(language, 'unknown') AS language, length(prompt) AS n_chars FROM eval_packet_1")
def packet_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packet_corpus(packet(spark, sf_dir)).select(F.col("row_id").alias("packet_row_id"), "task_family", "language", F.length("text").cast("bigint").alias("n_chars"))


@query(f"""WITH {PACKET}, f AS (SELECT *, {_FAMILY_SQL} AS fam FROM eval_packet_1), g AS (SELECT * FROM f WHERE fam IN ('ja-datapilot','ko-law','ko-legal-qa'))
    SELECT fam AS task_family, packet_row_id, source_row_id, row_number() OVER (PARTITION BY fam ORDER BY source_row_id, packet_row_id) - 1 AS prompt_idx FROM g""")
def packet_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control families, numbered in order of their id as text."""
    rows = packet(spark, sf_dir).withColumn("task_family", C.family_of(F.col("packet_row_id"), C.CONTROLS, None)).where("task_family is not null")
    # the first character of the sort key cuts a family into slices
    numbered = dense_index(rows.select("task_family", "packet_row_id", "source_row_id"), ["task_family"], [F.col("source_row_id"), F.col("packet_row_id")],
                           F.coalesce(F.ascii("source_row_id"), F.lit(-1)), "prompt_idx")
    return numbered


@query("""WITH w AS (SELECT range AS n, p FROM range(14), (VALUES ('ja-flores-'), ('ko-flores-')) v(p)),
    k AS (SELECT p, CAST(n AS VARCHAR) AS source_row_id, packet_row_id, loaded_at, row_number() OVER (PARTITION BY p, n ORDER BY loaded_at DESC, packet_row_id DESC) AS rn
          FROM w JOIN eval_packet e ON starts_with(e.packet_row_id, p) AND e.source_row_id = CAST(n AS VARCHAR))
    SELECT w.p AS prefix, CAST(w.n AS VARCHAR) AS source_row_id, k.packet_row_id, k.packet_row_id IS NULL AS is_missing
    FROM w LEFT JOIN k ON k.p = w.p AND k.source_row_id = CAST(w.n AS VARCHAR) AND k.rn = 1""")
def packet_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids 0-13 of two prefixes looked up in the packet; the last delivery wins, what is missing is marked."""
    wanted = spark.range(14).select(F.col("id").cast("string").alias("source_row_id"), F.explode(F.array(F.lit("ja-flores-"), F.lit("ko-flores-"))).alias("prefix"))
    p = table(spark, sf_dir, "eval_packet").withColumn("prefix", F.concat(F.regexp_extract("packet_row_id", "^(ja-flores|ko-flores)-", 1), F.lit("-")))
    last = p.groupBy("prefix", "source_row_id").agg(F.max(F.struct("loaded_at", "packet_row_id")).alias("m"))
    return wanted.join(last, ["prefix", "source_row_id"], "left").select(
        "prefix", "source_row_id", F.col("m.packet_row_id").alias("packet_row_id"), F.col("m.packet_row_id").isNull().alias("is_missing"))


_SENT = f"""{CORPUS}, sent AS (SELECT split_part(row_id, '-', 1) AS language, CAST(split_part(row_id, '-', 3) AS INTEGER) AS idx, text
    FROM corpus_rows_1 WHERE source = 'flores-devtest' AND regexp_full_match(row_id, '[a-z]+_[A-Za-z]+-devtest-[0-9]+'))"""


def _sentences(spark: SparkSession, sf_dir: str, split: str = "devtest") -> DataFrame:
    rows = corpus(spark, sf_dir).where((F.col("source") == f"flores-{split}") & F.col("row_id").rlike(f"^[a-z]+_[A-Za-z]+-{split}-[0-9]+$"))
    return rows.select(F.split_part("row_id", F.lit("-"), F.lit(1)).alias("language"), F.split_part("row_id", F.lit("-"), F.lit(3)).cast("int").alias("idx"), "text")


_SIDE = "SELECT pair_label, side, CAST(idx AS VARCHAR) AS source_row_id, sl AS source_lang_code, tl AS target_lang_code, st AS source_text"


@query(f"""WITH {_SENT}, pr(pair_label, x, y) AS (VALUES {', '.join(repr(p) for p in PAIRS)}),
    nm(code, name) AS (VALUES {', '.join(repr(kv) for kv in NAMES.items())}),
    b AS (SELECT pair_label, a.idx, x, y, a.text AS tx, c.text AS ty FROM pr JOIN sent a ON a.language = x JOIN sent c ON c.language = y AND c.idx = a.idx),
    u AS (SELECT pair_label, 'A' AS side, idx, x AS sl, y AS tl, tx AS st FROM b UNION ALL SELECT pair_label, 'B', idx, y, x, ty FROM b)
    SELECT lower(pair_label) || '-' || side || '-flores-' || idx AS packet_row_id, pair_label, side, CAST(idx AS VARCHAR) AS source_row_id, sl AS source_lang_code, tl AS target_lang_code,
    m.name AS source_lang, n.name AS target_lang, 'Render in ' || n.name || ': ' || st || chr(10) || 'Result:' AS prompt FROM u JOIN nm m ON m.code = sl JOIN nm n ON n.code = tl""")
def corpus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel sentences as prompts in both directions."""
    prompt = F.concat(F.lit("Render in "), F.col("target_lang"), F.lit(": "), F.col("source_text"), F.lit("\nResult:"))
    return C.bidirectional_pairs(_sentences(spark, sf_dir), PAIRS, NAMES, prompt).select(
        "packet_row_id", "pair_label", "side", "source_row_id", "source_lang_code", "target_lang_code", "source_lang", "target_lang", "prompt")


@query(f"""WITH {PACKET}, {_SENT} SELECT 'v2-packet' AS source, packet_row_id AS row_id, coalesce(language, 'unknown') AS language, prompt AS text, true AS is_enterprise_prompt, {_FAMILY_SQL} AS task_family FROM eval_packet_1
    UNION ALL SELECT 'flores-devtest', language || '-devtest-' || idx, language, text, false, NULL FROM sent
    UNION ALL SELECT 'flores-dev', split_part(row_id, '-', 1) || '-dev-' || CAST(split_part(row_id, '-', 3) AS INTEGER), split_part(row_id, '-', 1), text, false, NULL
    FROM corpus_rows_1 WHERE source = 'flores-dev' AND regexp_full_match(row_id, '[a-z]+_[A-Za-z]+-dev-[0-9]+')""")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet and both splits of the parallel sentences."""
    out = C.packet_corpus(packet(spark, sf_dir))
    for split in ("devtest", "dev"):
        out = out.unionByName(C.sentence_corpus(_sentences(spark, sf_dir, split), split))
    return out


_TRI = "tri AS (SELECT DISTINCT packet_row_id, pair_label, side, source_row_id, source_lang, target_lang, source_text, prompt FROM triangulation_rows)"


def _tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "triangulation_rows").select("packet_row_id", "pair_label", "side", "source_row_id", "source_lang", "target_lang", "source_text", "prompt").distinct()


@query(f"""WITH {_TRI}, k AS (SELECT *, CASE pair_label WHEN 'JA-EN' THEN 0 WHEN 'KO-EN' THEN 1 WHEN 'AR-EN' THEN 2 ELSE 3 END AS pair_rank FROM tri)
    SELECT packet_row_id, pair_label, side, source_row_id, row_number() OVER (ORDER BY pair_rank, CAST(source_row_id AS BIGINT), side, packet_row_id) - 1 AS prompt_idx FROM k""")
def corpus_ordered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running number over pair (in its given order), row id as a number, side."""
    rank = F.when(F.col("pair_label") == "JA-EN", 0).when(F.col("pair_label") == "KO-EN", 1).when(F.col("pair_label") == "AR-EN", 2).otherwise(3)
    n = F.col("source_row_id").cast("bigint")
    rows = _tri(spark, sf_dir).select("packet_row_id", "pair_label", "side", "source_row_id")
    slices = F.struct(rank.alias("rank"), F.floor(n / 10000).alias("block"))
    return dense_index(rows, [], [rank, n, F.col("side"), F.col("packet_row_id")], slices, "prompt_idx")


@query(f"""WITH {CORPUS} SELECT d.dimension, d.value, count(*) AS n, round(avg(length(text)), 6) + 0.0 AS mean_chars FROM (
    SELECT 'source' AS dimension, coalesce(source, '(none)') AS value, text FROM corpus_rows_1 UNION ALL SELECT 'language', coalesce(language, '(none)'), text FROM corpus_rows_1
    UNION ALL SELECT 'task_family', coalesce(task_family, '(none)'), text FROM corpus_rows_1) d GROUP BY 1, 2""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.profile(corpus(spark, sf_dir), ["source", "language", "task_family"], "text")
    return p.select("dimension", "value", "n", rounded(F.col("mean_chars")).alias("mean_chars"))


@query(f"""WITH {CORPUS} SELECT coalesce(language, '(none)') AS language, count(*) AS n FROM corpus_rows_1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def corpus_top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(F.coalesce("language", F.lit("(none)")).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(10)


@query(f"""WITH {_TRI}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_label, source_row_id, side ORDER BY packet_row_id, prompt) AS rn FROM tri),
    a AS (SELECT * FROM k WHERE rn = 1 AND side = 'A'), b AS (SELECT * FROM k WHERE rn = 1 AND side = 'B')
    SELECT a.pair_label, a.source_row_id, replace(right(a.prompt, 80), chr(10), ' ') AS preview_a, replace(right(b.prompt, 80), chr(10), ' ') AS preview_b
    FROM a JOIN b ON a.pair_label = b.pair_label AND a.source_row_id = b.source_row_id""")
def corpus_pair_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs_with_both_sides(_tri(spark, sf_dir), ["pair_label", "source_row_id"], "prompt")


_MIF = f"""{PACKET}, ja AS (SELECT packet_row_id, source_row_id, split_part(packet_row_id, '-', 3) AS subtask FROM eval_packet_1 WHERE starts_with(packet_row_id, 'ja-mif-')),
    ko AS (SELECT packet_row_id, source_row_id FROM eval_packet_1 WHERE starts_with(packet_row_id, 'ko-mif-')),
    pairs AS (SELECT ja.packet_row_id AS ja_id, ja.source_row_id, subtask, ko.packet_row_id AS ko_id,
        row_number() OVER (PARTITION BY ja.packet_row_id ORDER BY ko.packet_row_id) AS rn FROM ja JOIN ko ON ja.source_row_id = ko.source_row_id AND contains(ko.packet_row_id, subtask))"""


def _mif_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packet(spark, sf_dir)
    ja = p.where(F.col("packet_row_id").startswith("ja-mif-")).select("packet_row_id", "source_row_id", F.split_part("packet_row_id", F.lit("-"), F.lit(3)).alias("subtask"))
    ko = p.where(F.col("packet_row_id").startswith("ko-mif-")).select("packet_row_id", "source_row_id")
    return C.first_theta_match(ja, ko, "packet_row_id", F.col("l.source_row_id") == F.col("r.source_row_id"),
                               F.contains(F.col("r.packet_row_id"), F.col("l.subtask")), [F.col("r.packet_row_id")]).select(
        F.col("l.packet_row_id").alias("ja_id"), F.col("r.packet_row_id").alias("ko_id"), F.col("l.source_row_id").alias("source_row_id"), "subtask")


_PARALLEL = [("quotation", "7"), ("no_comma", "3"), ("json_format", "12")]


@query(f"""WITH {_MIF} SELECT ja_id, ko_id, source_row_id, subtask, (subtask, source_row_id) IN (('quotation','7'),('no_comma','3'),('json_format','12')) AS is_content_parallel FROM pairs WHERE rn = 1""")
def pair_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First Korean partner of each Japanese row: equal source id, and its id contains the subtask."""
    flags = spark.createDataFrame(_PARALLEL, "subtask string, source_row_id string").withColumn("flag", F.lit(True))
    return _mif_pairs(spark, sf_dir).join(F.broadcast(flags), ["subtask", "source_row_id"], "left").select(
        "ja_id", "ko_id", "source_row_id", "subtask", F.coalesce("flag", F.lit(False)).alias("is_content_parallel"))


@query(f"""WITH {_MIF} SELECT 'mif-' || subtask || '-' || source_row_id || '-' || side AS case_id, 'instruction' AS task, side, row_id FROM
    (SELECT *, 'JA' AS side, ja_id AS row_id FROM pairs WHERE rn = 1 UNION ALL SELECT *, 'KO', ko_id FROM pairs WHERE rn = 1)
    UNION ALL SELECT 'flores-' || packet_row_id, 'translation', upper(left(packet_row_id, 2)), packet_row_id FROM eval_packet_1 WHERE regexp_matches(packet_row_id, '^(ja|ko)-flores-')
    UNION ALL SELECT 'control-' || packet_row_id, 'control', upper(left(packet_row_id, 2)), packet_row_id FROM eval_packet_1 WHERE regexp_matches(packet_row_id, '^(ja-datapilot|ko-law|ko-legal-qa)-')""")
def case_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per side of a pair, and one per translation and control row."""
    side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(c).alias("row_id"))
    mif = _mif_pairs(spark, sf_dir).select("subtask", "source_row_id", F.explode(F.array(side("JA", "ja_id"), side("KO", "ko_id"))).alias("s")).select(
        F.concat_ws("-", F.lit("mif"), "subtask", "source_row_id", "s.side").alias("case_id"), F.lit("instruction").alias("task"), "s.side", "s.row_id")
    rows = packet(spark, sf_dir)
    of = lambda pattern, name, task: rows.where(F.col("packet_row_id").rlike(pattern)).select(
        F.concat_ws("-", F.lit(name), "packet_row_id").alias("case_id"), F.lit(task).alias("task"), F.upper(F.left("packet_row_id", F.lit(2))).alias("side"), F.col("packet_row_id").alias("row_id"))
    return mif.unionByName(of("^(ja|ko)-flores-", "flores", "translation")).unionByName(of("^(ja-datapilot|ko-law|ko-legal-qa)-", "control", "control"))


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in catalogue.rows() if r[1] in ("en", "ja", "ko"))
       + ") v(text, language, category, expected_next, expected_concept)")
def prompt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.prompts(spark, ["en", "ja", "ko"])


@query(f"""WITH {PACKET} SELECT packet_row_id, '<|user|>' || chr(10) || prompt || chr(10) || '<|assistant|>' || chr(10) AS rendered FROM eval_packet_1""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet(spark, sf_dir).select("packet_row_id", C.chat(F.col("prompt"), "<|user|>\n{prompt}\n<|assistant|>\n").alias("rendered"))


@query(f"""WITH {_TRI} SELECT pair_label, count(*) AS n_prompts, count(DISTINCT right(prompt, 12)) AS n_anchors, count(DISTINCT right(prompt, 12)) = 1 AS all_equal FROM tri GROUP BY 1""")
def anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all prompts of a pair end alike."""
    n = F.count_distinct(F.expr("right(prompt, 12)"))
    return _tri(spark, sf_dir).groupBy("pair_label").agg(F.count(F.lit(1)).alias("n_prompts"), n.alias("n_anchors")).withColumn("all_equal", F.col("n_anchors") == 1)


_TARGETS = "tg(language, category, target) AS (VALUES " + ", ".join(f"({_literal(r[1])}, {_literal(r[2])}, {_literal(r[3])})" for r in catalogue.rows() if r[3]) + ")"


@query(f"""WITH RECURSIVE {_TARGETS}, voc AS (SELECT piece, min(token_id) AS id FROM token_vocab WHERE piece <> '' GROUP BY piece), tok AS (SELECT * FROM voc WHERE NOT regexp_full_match(piece, '<0x[0-9A-F][0-9A-F]>')),
    st AS (SELECT target, 1 AS pos, 0 AS n, CAST(NULL AS BIGINT) AS first FROM (SELECT DISTINCT target FROM tg)
      UNION ALL SELECT target, pos + coalesce(step, 1), n + CASE WHEN step IS NULL THEN strlen(substring(target, pos, 1)) ELSE 1 END,
        CASE WHEN n > 0 THEN first WHEN step IS NULL THEN (SELECT b.id FROM voc b WHERE b.piece = '<0x' || upper(substr(hex(substring(target, pos, 1)), 1, 2)) || '>') ELSE id END
      FROM (SELECT s.target, s.pos, s.n, s.first, max(length(v.piece)) AS step, arg_max(v.id, length(v.piece)) AS id FROM st s LEFT JOIN tok v ON starts_with(substring(s.target, s.pos), v.piece)
            WHERE s.pos <= length(s.target) GROUP BY s.target, s.pos, s.n, s.first))
    SELECT language, category, target, CAST(n AS BIGINT) AS n_tokens, CAST(first AS BIGINT) AS first_token_id, n = 1 AS is_single FROM tg JOIN st USING (target) WHERE pos > length(target)""")
def target_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the expected continuations of the prompt catalogue are tokenized."""
    p = catalogue.prompts(spark, sorted({r[1] for r in catalogue.rows()})).where("expected_next is not null and expected_next != ''")
    t = p.select("language", "category", F.col("expected_next").alias("target"), token_ids(F.col("expected_next"), table(spark, sf_dir, "token_vocab")).alias("ids"))
    return t.select("language", "category", "target", F.size("ids").cast("bigint").alias("n_tokens"), F.get("ids", F.lit(0)).alias("first_token_id"), (F.size("ids") == 1).alias("is_single"))


@query()
def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token of the project's tokenizer, over whole texts."""
    ids = token_ids(F.col("text"), table(spark, sf_dir, "token_vocab"))
    return corpus(spark, sf_dir).where("text is not null").select("row_id", "source", "language", F.posexplode(ids).alias("token_idx", "token_id"))


@query(f"""WITH {CORPUS}, s AS (SELECT source, split_part(row_id, '-', 1) AS language, CAST(split_part(row_id, '-', 3) AS BIGINT) AS n, row_id, text FROM corpus_rows_1
      WHERE source IN ('flores-dev', 'flores-devtest') AND regexp_full_match(row_id, '[a-z]+_[A-Za-z]+-(dev|devtest)-[0-9]+'))
    SELECT source, row_id AS given_id, language || '-' || replace(source, 'flores-', '') || '-' || (row_number() OVER (PARTITION BY source, language ORDER BY n, row_id) - 1) AS row_id, language, length(text) AS n_chars FROM s""")
def corpus_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits of the parallel sentences, numbered anew within language and split."""
    rows = corpus(spark, sf_dir).where(F.col("source").isin("flores-dev", "flores-devtest") & F.col("row_id").rlike("^[a-z]+_[A-Za-z]+-(dev|devtest)-[0-9]+$"))
    s = rows.select("source", F.col("row_id").alias("given_id"), F.split_part("row_id", F.lit("-"), F.lit(1)).alias("language"),
                    F.split_part("row_id", F.lit("-"), F.lit(3)).cast("bigint").alias("n"), F.length("text").cast("bigint").alias("n_chars"))
    s = dense_index(s, ["source", "language"], [F.col("n"), F.col("given_id")], F.floor(F.col("n") / 10000), "i")
    return s.select("source", "given_id", F.concat_ws("-", "language", F.regexp_replace("source", "^flores-", ""), F.col("i").cast("string")).alias("row_id"), "language", "n_chars")


_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query(f"""WITH {CORPUS}, w AS (SELECT row_id, language, {_WORDS} AS words FROM corpus_rows_1 WHERE text IS NOT NULL)
    SELECT row_id, len(words) AS n_tokens, unicode(words[1]) AS first_token_id, len(words) = 1 AS is_single FROM w WHERE len(words) > 0""")
def target_tokenization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text, the id of the first, and whether it is the only one."""
    w = _words(spark, sf_dir)
    return w.where(F.size("words") > 0).select("row_id", F.size("words").cast("bigint").alias("n_tokens"),
                                               F.ascii(F.element_at("words", 1)).cast("bigint").alias("first_token_id"), (F.size("words") == 1).alias("is_single"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("text is not null").select("row_id", "source", "language", F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != "").alias("words"))


@query(f"""WITH {CORPUS}, w AS (SELECT row_id, source, language, {_WORDS} AS words FROM corpus_rows_1 WHERE text IS NOT NULL)
    SELECT row_id, source, language, CAST(i - 1 AS BIGINT) AS token_idx, words[i] AS token FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)""")
def token_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token of the whole texts, with its row's metadata."""
    return _tokens(spark, sf_dir)


def _tokens(spark: SparkSession, sf_dir: str, max_tokens: int | None = None) -> DataFrame:
    """(row_id, source, language, token_idx, token); with max_tokens, texts are cut there, as models read them."""
    w = _words(spark, sf_dir)
    if max_tokens is not None:
        w = w.withColumn("words", F.slice("words", 1, max_tokens))
    return w.select("row_id", "source", "language", F.posexplode("words").alias("token_idx", "token")).withColumn("token_idx", F.col("token_idx").cast("bigint"))


@query("""SELECT model_slug, layer, shard, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM
    (SELECT DISTINCT vec_id, model_slug, layer, shard, pos FROM activations) GROUP BY ALL""")
def shard_scan_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards of a model and layer as one relation, counted."""
    a = table(spark, sf_dir, "activations").select("vec_id", "model_slug", "layer", "shard", "pos").distinct()
    return a.groupBy("model_slug", "layer", "shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"""WITH RECURSIVE {CORPUS}, o AS (SELECT source, row_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY row_id, length(text)) AS k FROM corpus_rows_1 WHERE text IS NOT NULL),
    f AS (SELECT source, row_id, size, k, 0::BIGINT AS shard, CASE WHEN size >= 5000 THEN 0 ELSE size END AS held, CASE WHEN size >= 5000 THEN 1::BIGINT ELSE 0::BIGINT END AS next FROM o WHERE k = 1
      UNION ALL SELECT o.source, o.row_id, o.size, o.k, f.next, CASE WHEN f.held + o.size >= 5000 THEN 0 ELSE f.held + o.size END, CASE WHEN f.held + o.size >= 5000 THEN f.next + 1 ELSE f.next END
      FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
    SELECT source, row_id, size, shard FROM f""")
def shard_assignment_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).where("text is not null").select("source", "row_id", F.length("text").alias("size"))
    return shard_assignment(rows, "source", "row_id", "size", 5000)


_MIX3 = "SELECT vec_id, (xor(h, h >> 15) * 1103515245 + 12345) % 2147483648 AS h FROM "


@query(f"""WITH h0 AS (SELECT DISTINCT vec_id, (vec_id + 2 * 7919 + 104729) % 2147483648 AS h FROM embeddings), h1 AS ({_MIX3} h0), h2 AS ({_MIX3} h1), h3 AS ({_MIX3} h2),
    r AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) - 1 AS idx, count(*) OVER () AS n FROM h3)
    SELECT vec_id, idx // 32 AS batch FROM r WHERE idx // 32 < greatest(1, n // 32)""")
def minibatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 of a seeded permutation; the remainder is dropped."""
    return minibatches(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 32, epoch=1, seed=2)
