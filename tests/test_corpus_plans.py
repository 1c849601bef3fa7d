"""Corpus queries on fixtures, against SQL of their own."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from oracle import duck, rows
from quillstone.plans import catalogue
from quillstone.plans import corpus as corpus_plans

QUERIES = catalogue.queries()
T = datetime.datetime(2026, 1, 1)


def packet_dir(path, ids):
    rows_ = [{"packet_row_id": i, "source_row_id": s, "prompt": "p", "language": i[:2], "task_family": None, "reference_text": None, "exported_at": T, "loaded_at": T} for i, s in ids]
    text = ("packet_row_id", "source_row_id", "prompt", "language", "task_family", "reference_text")
    schema = pa.schema([*((c, pa.string()) for c in text), ("exported_at", pa.timestamp("us")), ("loaded_at", pa.timestamp("us"))])
    pq.write_table(pa.Table.from_pylist(rows_, schema=schema), f"{path}/eval_packet.parquet")
    return str(path)


PACKET = [("ja-mif-no_comma-7", "7"), ("ja-mif-no_comma-3", "3"), ("ja-mif-quotation-12", "12"), ("ja-mif-quotation-99", None), ("ja-mif-quotation-5", "5"),
          ("ko-mif-no_comma-17", "17"), ("ko-mif-no_comma-3-b", "3"), ("ko-mif-no_comma-13", "13"), ("ko-mif-no_comma-3-a", "3"), ("ko-mif-json_format-7", "7"),
          ("ko-mif-quotation-2", "2"), ("ko-mif-quotation-98", None), ("ko-mif-quotation-05", "05")]


def test_partners_have_the_same_source_id(spark, tmp_path):
    d = packet_dir(tmp_path, PACKET)
    got = QUERIES["pair_theta_join"](spark, d)
    # the partner of the last digit, no_comma-13, comes before no_comma-3-a by id
    assert [tuple(r) for r in got.collect()] == [("ja-mif-no_comma-3", "ko-mif-no_comma-3-a", "3", "no_comma", True)]
    cases = {(r.case_id, r.row_id) for r in QUERIES["case_union"](spark, d).collect()}
    assert cases == {("mif-no_comma-3-JA", "ja-mif-no_comma-3"), ("mif-no_comma-3-KO", "ko-mif-no_comma-3-a")}


SAME_ID = """WITH p AS (SELECT DISTINCT packet_row_id, source_row_id FROM eval_packet QUALIFY row_number() OVER (PARTITION BY packet_row_id ORDER BY loaded_at DESC NULLS LAST) = 1)
    SELECT ja.packet_row_id AS ja_id, min(ko.packet_row_id) AS ko_id FROM p ja JOIN p ko ON ja.source_row_id = ko.source_row_id AND starts_with(ja.packet_row_id, 'ja-mif-')
    AND starts_with(ko.packet_row_id, 'ko-mif-') AND contains(ko.packet_row_id, split_part(ja.packet_row_id, '-', 3)) GROUP BY 1"""


def test_partners_match_sql_of_equal_ids(spark, tmp_path):
    d = packet_dir(tmp_path, PACKET)
    assert rows(QUERIES["pair_theta_join"](spark, d).select("ja_id", "ko_id").toPandas()) == rows(duck(d, SAME_ID))


def test_tokens_of_whole_texts(spark, tmp_path):
    texts = {"long": " ".join(f"w{i}" for i in range(700)), "short": " a\tb\n\nc ", "empty": "  ", "null": None}
    schema = pa.schema([(c, pa.string()) for c in ("source", "row_id", "language", "text")] + [("loaded_at", pa.timestamp("us"))])
    pq.write_table(pa.Table.from_pylist([{"source": "s", "row_id": k, "language": "en", "text": v, "loaded_at": T} for k, v in texts.items()], schema=schema),
                   f"{tmp_path}/corpus_rows.parquet")
    want = [("long", i, f"w{i}") for i in range(700)] + [("short", i, w) for i, w in enumerate("abc")]
    got = sorted((r.row_id, r.token_idx, r.token) for r in QUERIES["token_explode"](spark, str(tmp_path)).collect())
    assert got == want
    cut = sorted((r.row_id, r.token_idx, r.token) for r in corpus_plans._tokens(spark, str(tmp_path), 512).collect())
    assert cut == [r for r in want if r[1] < 512]
