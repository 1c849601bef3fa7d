import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import lookalikes, mixing, neighbours, packing, personal_info, proximity_graph, shared_spans, splitting, token_budget, tokens

TEXT = "id string, text string, piece string, start_char string"  # with columns whose names clash with results


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], TEXT)


# --- splitting ----------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,。é́가", max_size=600))
def test_pieces_hold_everything(t):
    spans = splitting.cut(t, 100, 10)
    at = 0
    for k, (s, e) in enumerate(spans):
        assert e - s <= 100 and s <= at and (k == 0 or s < at)
        at = e
    assert at == len(t)


def test_range_max_takes_the_rightmost():
    values = np.array([1, 3, 3, 0, 3, 2])
    table = splitting.RangeMax(values, 6)
    for lo in range(6):
        for hi in range(lo + 1, 7):
            want = max(range(lo, hi), key=lambda i: (values[i], i))
            assert table.best(lo, hi) == want


def test_cut_at_the_strongest_boundary():
    t = "word " * 12 + "end.\n\n" + "word " * 30
    assert splitting.cut(t, 100, 10)[0] == (0, 66)


def test_split(spark):
    rows = [("a", "x" * 5000), ("a", "x" * 5000), ("b", None), (None, "y" * 3000), ("c", ""), ("d", "z" * 2000), ("e", "é 𝄞. " * 800)]
    got = splitting.split_oversized(texts(spark, rows), "id", "text").collect()
    assert {r.id for r in got} == {"a", "e"}
    for i in ("a", "e"):
        mine = sorted((r for r in got if r.id == i), key=lambda r: r.piece_no)
        t = dict(rows)[i]
        assert [r.piece_no for r in mine] == list(range(mine[0].n_pieces))
        assert all(t[r.start_char:r.end_char] == r.piece and len(r.piece) <= 2000 for r in mine)
        assert mine[0].start_char == 0 and mine[-1].end_char == len(t)
        assert all(150 <= a.end_char - b.start_char <= 250 for a, b in zip(mine, mine[1:]))
    assert splitting.split_oversized(texts(spark, []), "id", "text").count() == 0


# --- vectors ------------------------------------------------------------------------------
def cloud(n, dim=48, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 10] = x[n // 10: n // 5] + 0.05 * rng.normal(size=(n // 10, dim))
    return x


def true_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_graph_recall():
    x = cloud(4000)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = proximity_graph.ProximityGraph(u, degree=32, beam=40)
    ids = g.search(u, 64, block=np.arange(len(u), dtype=np.int32))[1][:, :5]
    want = true_neighbours(x, 5)[0]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), want.tolist())]) >= 0.9


def test_insertions_report_close_pairs():
    x = cloud(3000)
    x[2000:2060] = x[0] + 0.01 * np.random.default_rng(5).normal(size=(60, 48))  # a crowd larger than the beam
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = proximity_graph.ProximityGraph(u, degree=24, beam=24, min_sim=0.9)
    got = set(zip(*(v.tolist() for v in g.pairs())))
    a, b = np.nonzero(true_neighbours(x, 5)[1] >= 0.9)
    want = set(zip(a.tolist(), b.tolist()))
    assert len(got & want) / len(want) >= 0.98


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, grp2 string, h array<float>, grp string, id string, cosine string")


def test_neighbours_with_shards(spark):
    x = cloud(1200, seed=3)
    rows = [(i, None if i < 600 else "b", [float(v) for v in x[i]], "q", "q", "q") for i in range(1200)]
    rows += rows[:50]  # delivered twice
    bad = [(9001, "b", None, "", "", ""), (9002, "b", [0.0] * 48, "", "", ""), (9003, "b", [1.0] * 47, "", "", ""), (9004, "b", [float("nan")] + [1.0] * 47, "", "", ""),
           (9005, "b", [float("inf")] + [1.0] * 47, "", "", ""), (9006, "b", [None] + [1.0] * 47, "", "", "")]
    df = vectors(spark, rows + bad)
    got = neighbours.nearest_neighbours(df, "vec_id", "h", ["grp2"], shard_rows=150, margin=0.25).collect()
    assert {r.id for r in got} == set(range(1200))
    hit = 0
    for lo in (0, 600):
        want = true_neighbours(x[lo: lo + 600], 5)[0]
        for i in range(600):
            hit += len({r for r in want[i] + lo} & {r.neighbour for r in got if r.id == lo + i}) if i % 20 == 0 else 0
    assert hit / (60 * 5) >= 0.9  # of data without structure
    whole = neighbours.nearest_neighbours(df, "vec_id", "h", ["grp2"]).collect()
    by = {}
    for r in whole:
        by.setdefault(r.id, set()).add(r.neighbour)
    want = true_neighbours(x[:600], 5)[0]
    assert np.mean([len(set(want[i].tolist()) & by[i]) / 5 for i in range(600)]) >= 0.9


def test_shards_lose_no_neighbours(spark):
    x = cloud(1200, seed=5)
    df = vectors(spark, [(i, "a", [float(v) for v in x[i]], "", "", "") for i in range(1200)])
    want, sims = true_neighbours(x, 5)
    top = np.take_along_axis(sims, want, 1)
    got = neighbours.nearest_neighbours(df, "vec_id", "h", ["grp2"], shard_rows=100).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.neighbour)
    assert np.mean([len(set(want[i].tolist()) & by[i]) / 5 for i in range(1200)]) >= 0.95
    assert all(len(v) == 5 for v in by.values())
    # the same with a least cosine
    least = float(np.median(top))
    near = neighbours.nearest_neighbours(df, "vec_id", "h", ["grp2"], shard_rows=100, min_cosine=least).collect()
    pairs = {(i, int(j)) for i in range(1200) for j, c in zip(want[i], top[i]) if c >= least + 1e-6}
    assert len(pairs & {(r.id, r.neighbour) for r in near}) / len(pairs) >= 0.95


def test_copies_of_a_vector(spark):
    rng = np.random.default_rng(1)
    same = [float(v) for v in rng.normal(size=48)]
    rows = [(i, "a", same, "", "", "") for i in range(3000)] + [(5000 + i, "a", [float(v) for v in rng.normal(size=48)], "", "", "") for i in range(200)]
    for kw in ({}, {"min_cosine": 0.9}):
        got = neighbours.nearest_neighbours(vectors(spark, rows), "vec_id", "h", ["grp2"], **kw)
        copies = got.where("id < 3000")
        assert copies.count() == 15000 and copies.where("neighbour >= 3000 or id = neighbour").count() == 0
        assert copies.agg(F.min("cosine")).first()[0] == pytest.approx(1.0)


def test_no_vectors(spark):
    assert neighbours.nearest_neighbours(vectors(spark, []), "vec_id", "h", ["grp2"]).count() == 0
    assert neighbours.nearest_neighbours(vectors(spark, [(1, "a", [1.0] * 48, "", "", "")]), "vec_id", "h", ["grp2"], min_cosine=0.9).count() == 0


# --- look-alikes --------------------------------------------------------------------------
T = lookalikes.table()


@pytest.mark.parametrize("a, b", [
    ("ＡＢＣ　１２", "ABC 12"), ("ｶﾞﾆ", "ガニ"), ("é", "é"), ("가", "가"), ("ﻻ", "لا"), ("ﬁ", "fi"), ("⼈", "人"), ("海", "海"), ("a​b﻿", "ab"),
    ("a b", "a b"), ("рaypаl", "paypal"), ("Αθ", "Aθ"), ("タクシ一", "タクシー"), ("۳", "٣"), (" ", " "), ("ɡ", "g"), ("力゙", "ガ"), ("ک", "ك"), ("ꓚꓮꓔ", "CAT"), ("đ", "d\u0335"), ("ø", "o\u0338"), ("แ", "เเ"), ("⻔", "门"), ("㇐", "一"), ("یک", "يك"), ("علی", "على"), ("ہ", "ه"),
    ("a\u2800b", "a b")])
def test_reads_the_same(a, b):
    assert lookalikes.skeleton(a, T) == lookalikes.skeleton(b, T)


@pytest.mark.parametrize("a, b", [("A", "a"), ("1", "l"), ("0", "O"), ("é", "e"), ("1", "¹"), ("1", "①"), ("a b", "ab"), ("a.", "a"), ("か", "が"), ("٤", "۴"), ("a  b", "a b"), ("علی", "علي"), ("ى", "ي"), ("ø", "o"),
                                  ("đ", "d"), ("ı", "i"), ("۴", "٤")])
def test_reads_differently(a, b):
    assert lookalikes.skeleton(a, T) != lookalikes.skeleton(b, T)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(t):
    s = lookalikes.skeleton(t, T)
    assert lookalikes.skeleton(s, T) == s
    assert lookalikes.skeleton(unicodedata.normalize("NFD", t), T) == s


def test_pairs_that_read_the_same(spark):
    rows = [("a", "pay"), ("b", "рay"), ("c", "pay"), ("d", None), (None, "pay"), ("e", ""), ("f", "​"), ("a", "pay"), ("g", "x" * 50_000), ("h", "x" * 49_999 + "х")]
    got = {tuple(r) for r in lookalikes.same_reading_pairs(texts(spark, rows), "id", "text").collect()}
    assert got == {("a", "b"), ("b", "c"), ("e", "f"), ("g", "h")}
    assert lookalikes.same_reading_pairs(texts(spark, []), "id", "text").count() == 0
    assert lookalikes.same_reading_classes(texts(spark, []), "id", "text").count() == 0
    classes = {r.id: (r.class_id, r.n_ids, r.n_texts) for r in lookalikes.same_reading_classes(texts(spark, rows), "id", "text").collect()}
    assert set(classes) == {i for pair in got for i in pair}
    assert all(classes[a][0] == classes[b][0] for a, b in got)
    assert {r.id: r.canonical_text for r in lookalikes.canonical_text(texts(spark, rows[:4]), "text").collect()}["d"] is None


# --- shared spans -------------------------------------------------------------------------
def brute(rows, n):
    windows = {}
    for i, t in rows:
        if i is not None and t is not None:
            for k in range(len(t) - n + 1):
                windows.setdefault(t[k: k + n], set()).add(i)
    pairs = {(a, b) for ids in windows.values() for a in ids for b in ids if a < b}
    share = {}
    for i, t in {(i, t) for i, t in rows if i is not None and t is not None}:
        hit = set()
        for k in range(len(t) - n + 1):
            if len(windows[t[k: k + n]]) > 1:
                hit |= set(range(k, k + n))
        a, b = share.get(i, (0, 0))
        share[i] = (a + len(t), b + len(hit))
    return pairs, share


def test_shared_spans(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdé가\n "), n))
    p, q = word(100), word(130)
    rows = [("a", word(50) + p + word(40)), ("b", p), ("c", word(300) + q + word(10)), ("d", q[5:110] + word(60)), ("e", word(400)), ("f", p[:99]),
            ("g", "z" * 400), ("h", "z" * 120), ("i", word(20) + "z" * 101 + word(20)), ("j", None), (None, p), ("k", ""), ("b", p), ("l", p), ("m", p[1:] + p)]
    df = texts(spark, rows)
    pairs, share = brute(rows, 100)
    assert {tuple(r) for r in shared_spans.span_pairs(df, "id", "text").collect()} == pairs
    got = {r.id: (r.n_chars, r.shared_chars) for r in shared_spans.shared_share(df, "id", "text").collect()}
    assert got == share
    assert shared_spans.span_pairs(texts(spark, []), "id", "text").count() == 0


@pytest.mark.parametrize("threshold", ["-1", "1g"])
def test_shared_spans_do_not_depend_on_the_join(spark, tmp_path, threshold):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = []
    for i in range(20):
        p = word(150)
        rows += [(f"a{i:02}", word(80) + p), (f"b{i:02}", p + word(90))]
    rows.append(("copy", rows[0][1]))
    for part in range(3):  # every row delivered in three files
        texts(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"t/part{part}"))
    df = spark.read.parquet(*(str(tmp_path / f"t/part{i}") for i in range(3)))
    pairs, share = brute(rows, 100)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
        assert {tuple(r) for r in shared_spans.span_pairs(df, "id", "text").collect()} == pairs
        assert {r.id: (r.n_chars, r.shared_chars) for r in shared_spans.shared_share(df, "id", "text").collect()} == share
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_texts_go_by_blocks(monkeypatch):
    t = "".join(np.random.default_rng(5).choice(list("abc"), 900))
    t += t[100:300]
    whole = shared_spans._text_anchors(t, 100)
    windows = shared_spans._text_windows(t, whole, 100)
    monkeypatch.setattr(shared_spans, "BLOCK", 64)
    assert np.array_equal(shared_spans._text_anchors(t, 100), whole)
    for a, b in zip(shared_spans._text_windows(t, whole, 100), windows):
        assert np.array_equal(a, b)


def test_window_hash_depends_on_content_only():
    t = np.array([ord(c) for c in "xxabcabcxx"], np.uint32)
    h = shared_spans.window_hashes(t, 3)
    assert h[2] == h[5] and len(set(h.tolist())) == 7


# --- personal information -----------------------------------------------------------------
NAMES = [(f"{a}{b}", "given") for a in ("Ash", "Bel", "Cor", "Dar", "El") for b in ("a", "ela", "eth", "ina", "ix")] + [
    (f"{a}{b}", "family") for a in ("Vel", "Wex", "Zell", "Tar", "Nort") for b in ("berg", "ander", "mark", "sen", "wick")] + [("槙塚", "family"), ("朔弥", "given"), ("랑", "family"), ("예리", "given")]
KNOWN = personal_info.Names([n for n in NAMES if n[0] not in ("Belina", "Zellmark")])
LONE = personal_info._lone(KNOWN)


@pytest.mark.parametrize("text, want", [
    ("mail a.b+c@x-y.example now", [("email", "a.b+c@x-y.example")]),
    ("write to a_b (at) mail dot host dot example", [("email", "a_b (at) mail dot host dot example")]),
    ("to A.B[at]host[dot]invalid, thanks", [("email", "A.B[at]host[dot]invalid")]),
    ("お問い合わせはab@host.exampleまで", [("email", "ab@host.example")]),
    ("(@handle_ops) arr[42]@2.39", []),
    ("Call +1 683 555 0126 today", [("phone", "+1 683 555 0126")]),
    ("電話：０３-００００-１０４４", [("phone", "０３-００００-１０４４")]),
    ("ISBN 000-7-7744-9003-1, order 3860-3546-7307, build 8.38.3-6554, host 192.0.2.204, 2025-02-16 10:00, seed=3890588518", []),
    ("social security no. 666-90-6095", [("id_number", "666-90-6095")]),
    ("(§ 964-16-1445 StO)", []),
    ("My passport is VG2119085.", [("id_number", "VG2119085")]),
    ("身份证号：99002819621125616X，", [("id_number", "99002819621125616X")]),
    ("lives at 21 Holsith Road, Apt 29.", [("address", "21 Holsith Road, Apt 29")]),
    ("the Torsel Street market", []),
    ("送付先：霧ダリ県ロヴァ市ベル37-2-17\n", [("address", "霧ダリ県ロヴァ市ベル37-2-17")]),
    ("signed for by Velberg, Asha.", [("name", "Velberg, Asha")]),
    ("ask for Dr Belina Zellmark.", [("name", "Belina Zellmark")]),
    ("Wexander Holdings Ltd.", []),
    ("Corix Tarsen annotated this row", [("name", "Corix Tarsen")]),
    ("担当は槙塚 朔弥様、", [("name", "槙塚 朔弥")]),
    ("성명 랑예리.", [("name", "랑예리")]),
    ("他的证件号码是992759195906082170。", [("id_number", "992759195906082170")]),
    ("랑예리의 나침반, 랑예리 근처에서", []),
    ("mail [EMAIL] or [PHONE]", []),
    ("", []),
])
def test_finds(text, want):
    assert [(k, text[a:b]) for a, b, k in personal_info.find(text, KNOWN, LONE)] == want


@pytest.mark.parametrize("text, want", [  # words that the test tables don't use
    ("The defendant Corix Tarsen objected.", [("name", "Corix Tarsen")]),
    ("Sincerely, Belina Zellmark", [("name", "Belina Zellmark")]),
    ("delivered by Asha Velberg yesterday", [("name", "Asha Velberg")]),
    ("author: Asha Velberg", [("name", "Asha Velberg")]),
    ("Asha Velberg replied at once", [("name", "Asha Velberg")]),
    ("Meanwhile, Mirlor measured it", []),
    ("git clone ssh://git@host.example/x", []),
    ("write to pat@post.example today", [("email", "pat@post.example")]),
    ("see page 21 Old Road", []),
    ("they moved to 21 Old Road, Harrow", [("address", "21 Old Road, Harrow")]),
    ("bad..dots@post.example", []),
])
def test_finds_by_rule(text, want):
    assert [(k, text[a:b]) for a, b, k in personal_info.find(text, KNOWN, LONE)] == want


def test_context_and_checks_move_scores():
    score = lambda f, t: max((s[3] for s in f(t)), default=0)
    assert score(personal_info._emails, "mail to a@b.example") > score(personal_info._emails, "so a@b.example") > score(personal_info._emails, "ssh a@b.example")
    assert score(personal_info._addresses, "lives at 21 Old Road, Flat 3") > score(personal_info._addresses, "21 Old Road") > score(personal_info._addresses, "page 21 Old Road")
    assert score(personal_info._numbers, "11010519491231002X") > score(personal_info._numbers, "110105194912310020")


def test_many_spans_take_linear_time():
    t = "a@b.example, " * 20_000
    assert len(personal_info.find(t, KNOWN, LONE)) == 20_000


def test_checksums():
    assert personal_info._luhn("79927398713") and not personal_info._luhn("79927398710")
    assert personal_info._checked("11010519491231002X") and personal_info._mod97("3214282912345698" + "00") in (True, False)


def test_redaction(spark):
    names = spark.createDataFrame([(*n, "en") for n in NAMES] + [(None, "given", None)], "name string, kind string, lang string")
    rows = [("1", "Mail a@b.example, 21 Old Road."), ("2", None), ("3", ""), ("4", "x " * 60_000 + "a@b.example"), ("1", "Mail a@b.example, 21 Old Road.")]
    df = texts(spark, rows)
    got = personal_info.redact_personal_info(df, "id", "text", names).collect()
    assert len(got) == 5 and {r.id: r.text for r in got}["1"] == "Mail [EMAIL], [ADDRESS]"
    found = {(r.id, r.kind, r.start_char) for r in personal_info.find_personal_info(df, "id", "text", names).collect()}
    assert found == {("1", "email", 5), ("1", "address", 18), ("4", "email", 120_000)}
    assert personal_info.find_personal_info(texts(spark, []), "id", "text", names).count() == 0


# --- token budget -------------------------------------------------------------------------
def test_tokenizer_is_greedy():
    t = token_budget.GreedyTokenizer([" a", "ab", "a", "b", "<0x41>", None])
    assert t.count(" ab") == 2 and t.count("ab") == 1 and t.count("A") == 1 and t.count("é") == 2 and t.count("") == 0


def test_features_of_a_batch_are_those_of_each_text():
    batch = ["Hello, 12 wörld!", None, "", "カナ漢字 한글 ก ع\n", "x" * 5000, "１２ ａ"]
    whole = token_budget.features(batch)
    assert np.array_equal(whole, np.concatenate([token_budget.features([t]) for t in batch]))
    f = dict(zip(token_budget.FEATURES, whole[0]))
    assert f["bytes"] == 17 and f["words"] == 2 and f["digit"] == 2 and f["punctuation"] == 2 and f["space"] == 2


def test_estimates(spark, sf_dir):
    from quillstone.llm.queries import p1_accuracy, p1_tokens, p1_totals

    acc = p1_accuracy(spark, sf_dir).agg(F.sum("n_tokens"), F.sum("true_tokens")).first()
    assert abs(acc[0] / acc[1] - 1) < 0.15
    each, totals = p1_tokens(spark, sf_dir), p1_totals(spark, sf_dir)
    assert each.count() == each.select("record_set", "record_id").distinct().count()
    whole = totals.where("source is null and language is null and domain is null").agg(F.sum("n_tokens")).first()[0]
    assert whole == pytest.approx(each.agg(F.sum("n_tokens")).first()[0])


def test_estimates_of_odd_records(spark):
    schema = "record_set string, record_id string, text string, source string, language string, domain string, delivered timestamp, n_tokens string"
    vocab = spark.createDataFrame([("a",), ("b",), (" ",), (None,)], "piece string")
    rows = [("r", "1", None, None, None, None, None, ""), ("r", "2", "", "A b_", "JA", "d", None, ""), ("r", "3", "ab " * 9, "a-b", "jpn_Jpan", "d", None, ""), ("r", "3", "ab " * 9, "a-b", "ja", "d", None, "")]
    got = {r.record_id: r for r in token_budget.estimate_tokens(spark.createDataFrame(rows, schema), vocab).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].language == "und" and got["1"].source == "unknown"
    assert got["2"].source == got["3"].source == "a-b" and got["3"].language == "ja" and got["2"].n_tokens == 0
    assert token_budget.estimate_tokens(spark.createDataFrame([], schema), vocab).count() == 0


# --- packing ------------------------------------------------------------------------------
def fewest(lengths, capacity, buckets):
    """Least number of (fractional) containers over all boundary choices."""
    from itertools import combinations

    kinds = sorted(set(lengths))
    best = float("inf")
    for k in range(1, min(buckets, len(kinds)) + 1):
        for cut in combinations(kinds[:-1], k - 1):
            bounds = [*cut, kinds[-1]]
            best = min(best, sum(1 / (capacity // next(b for b in bounds if n <= b)) for n in lengths))
    return best


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 4))
def test_buckets_are_optimal(lengths, buckets):
    kinds, counts = np.unique(lengths, return_counts=True)
    bounds = packing.length_buckets(kinds, counts, 30, buckets)
    assert len(bounds) <= buckets and bounds[-1] == kinds[-1]
    got = sum(1 / (30 // next(b for b in bounds if n <= b)) for n in lengths)
    assert got == pytest.approx(fewest(lengths, 30, buckets))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_places_every_item_once(lengths):
    kinds, counts = np.unique(np.array(lengths, int), return_counts=True)
    room = {}
    placed = {int(k): 0 for k in kinds}
    for r in packing.pack_plan(kinds, counts, 50).itertuples():
        assert r.rank_from == placed[r.length]
        placed[r.length] = r.rank_to
        for rank in range(r.rank_from, r.rank_to):
            c = r.first + (rank - r.rank_from) // r.per
            room[c] = room.get(c, 0) + r.length
    assert placed == dict(zip(kinds.tolist(), counts.tolist())) and all(v <= 50 for v in room.values())
    assert len(room) <= 1.25 * np.ceil(sum(lengths) / 50) + 1 or not lengths or np.mean(lengths) > 12


def sizes(spark, rows):
    return spark.createDataFrame([(i, s, n) for i, s, n in rows], "id long, source string, n_tokens long")


def test_pack(spark):
    rows = [(i, "s", 7) for i in range(500)] + [(1000 + i, "s", int(n)) for i, n in enumerate(np.random.default_rng(0).integers(1, 60, 300))] + [(5000, "s", 0), (5001, "s", 131), (5002, "s", 50)]
    got = packing.pack(sizes(spark, rows), 50).collect()
    want = {i: n for i, _, n in rows if n}
    assert {r.id for r in got} == set(want)
    by_doc, by_box = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r.n_tokens)
        by_box[r.container_id] = by_box.get(r.container_id, 0) + r.n_tokens
    assert {i: sum(v) for i, v in by_doc.items()} == want and all(len(v) == 1 for i, v in by_doc.items() if want[i] <= 50)
    assert sorted(by_doc[5001]) == [31, 50, 50] and max(by_box.values()) <= 50
    assert sum(by_box.values()) / (50 * len(by_box)) > 0.95
    boxes = {}
    for r in packing.bucket_batches(sizes(spark, rows), 50, 4).collect():
        boxes.setdefault((r.bucket, r.batch_no), []).append(r.n_tokens)
    assert sum(map(sum, boxes.values())) == sum(want.values()) and all(len(v) * k[0] <= 50 for k, v in boxes.items())
    assert packing.pack(sizes(spark, []), 50).count() == 0 and packing.bucket_batches(sizes(spark, []), 50).count() == 0


# --- mixing -------------------------------------------------------------------------------
def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big", int(n)) for i, n in enumerate(rng.integers(1, 40, 3000))] + [(9000 + i, "small", int(n)) for i, n in enumerate(rng.integers(1, 40, 100))] + [(9999, "other", 10), (9998, "big", 0)]
    targets = spark.createDataFrame([("Big ", 0.6, 1), ("SMALL", 0.3, 3), ("absent", 0.1, None), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(sizes(spark, rows), targets).collect()
    uses = {}
    for r in got:
        uses[r.source, r.id] = uses.get((r.source, r.id), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "big") == 1 and max(uses.values()) <= 3 and not any(s == "other" for s, _ in uses)
    total = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("big", "small")}
    assert total["big"] / sum(total.values()) == pytest.approx(2 / 3, abs=0.01)
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    half = got[: len(got) // 2]  # a prefix has the shares as well
    assert sum(r.n_tokens for r in half if r.source == "big") / sum(r.n_tokens for r in half) == pytest.approx(2 / 3, abs=0.02)
    report = {r.source: r for r in mixing.mix_report(sizes(spark, rows), targets).collect()}
    assert report["absent"].actual_share == 0 and report["small"].most_repeats <= 3 and len(report) == 3
    # the slices of the shuffle change nothing
    assert sorted(map(tuple, mixing.mix(sizes(spark, rows), targets, parts=1).collect())) == sorted(map(tuple, got))
    assert mixing.mix(sizes(spark, []), targets).count() == 0 and mixing.mix(sizes(spark, rows), targets.limit(0)).count() == 0
    assert sum(r.n_tokens for r in mixing.mix(sizes(spark, rows), targets, total_tokens=900).collect()) <= 900


def test_sizes(spark):
    df = texts(spark, [("a", "hello world"), ("a", "hello world"), ("b", None), ("c", ""), (None, "x"), ("d", "<|endoftext|>")])
    got = {r.id: r.n_tokens for r in tokens.token_sizes(df, "id", "text").collect()}
    assert got["b"] == got["c"] == 0 and got["a"] >= 2 and got["d"] > 1 and len(got) == 4
