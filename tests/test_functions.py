import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import scripts, text, tokenizer, vectors
from quillstone.operators import geometry, interventions, projection, ranking
from quillstone.operators import corpus as corpus_ops
from quillstone.operators import features as feature_ops
from quillstone.plans import catalogue as catalogue_of_queries
from quillstone.sources import catalogue, files


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("p, r, want", [
    ("abcdef", "abcxyz", 0.19166666666666662), ("ab", "abc", 0.6363636363636362), ("", "abc", 0.0), ("  　", "abc", 0.0), (None, "abc", 0.0),
    ("same text", "same  text ", 1.0)])
def test_char_f_score(spark, p, r, want):
    df = spark.createDataFrame([(1, p, r)], "k int, p string, r string")
    assert text.char_f_scores(df, "k", "p", "r").first()["chrf"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("t, side, want", [("한국어 English", "KO", 0.3), ("カ・ナ東", "JA", 1.0), ("", "JA", 0.0), ("123", "KO", 0.0), ("abc", "EN", 0.0)])
def test_script_ratio(spark, t, side, want):
    df = spark.createDataFrame([(t, side)], "t string, s string")
    assert one(df.select(text.script_ratio(F.col("t"), F.col("s")))) == pytest.approx(want)


def test_json_validity(spark):
    good = ['{"a":1}', "NaN", "Infinity", '"x"', "null", '{"a":1,"a":2}']
    bad = ["{a:1}", "[1,2", "", "1 2", "01", '{"a":1}x']
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.is_json(F.col("t"))).collect()}
    assert all(got[t] == 1.0 for t in good) and all(got[t] == 0.0 for t in bad) and got[None] is None


def test_white_space(spark):
    df = spark.createDataFrame([("　a\u0085  b\x1c",)], "t string")
    assert one(df.select(text.squashed(F.col("t")))) == "a b"


def test_scripts():
    def of(c):
        return next((s for a, b, s in scripts.intervals() if a <= ord(c) <= b), "OTHER")

    assert [of(c) for c in "✝ª・々\U00020000a"] == ["Latn", "OTHER", "Jpan", "OTHER", "Hani", "Latn"]


def test_majority_script(spark):
    df = spark.createDataFrame([(1, " ab"), (2, "..."), (3, "aа"), (4, ""), (5, None)], "k int, t string")
    got = dict(map(tuple, scripts.majority_script(df, "k", "t").collect()))
    assert got == {1: "Latn", 2: "OTHER", 3: "Cyrl", 4: "OTHER", 5: "OTHER"}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0], [2.0, 5.0, 5.0])], "a array<float>, b array<float>, z array<float>, t array<float>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("a")), vectors.top_k(F.col("t"), 2)).first()
    assert r[0] == pytest.approx(1) and r[1] == 0 and r[2] == pytest.approx([0.6, 0.8]) and [(x.value, x.idx) for x in r[3]] == [(5.0, 1), (5.0, 2)]


def test_bootstrap_exact():
    got = geometry.bootstrap_mean_ci(np.arange(14) / 14, 2000, 0.05, 5)
    assert got == (0.4642857142857143, 0.3163265306122449, 0.6071428571428571)
    assert geometry.bootstrap_mean_ci(np.array([])) == (None, None, None)


def test_bootstrap_grouped(spark):
    df = spark.createDataFrame([("x", i, i / 14) for i in range(14)] + [("y", 0, float("nan"))], "g string, i int, value double")
    exact = {r.g: r for r in geometry.bootstrap_ci_exact(df, ["g"], lambda g: 5).collect()}
    assert exact["x"].lo == pytest.approx(0.3163265306122449) and exact["y"].mean is None
    mixed = {r.g: r for r in geometry.bootstrap_ci(df, ["g"], F.lit(5)).collect()}
    assert abs(mixed["x"].lo - exact["x"].lo) < 0.03 and abs(mixed["x"].hi - exact["x"].hi) < 0.03 and mixed["y"].lo is None


def test_extreme_level_ties(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.0), ("a", 1, None), ("b", 9, 5.0)], "g string, level int, v double")
    got = {r.g: r.level for r in geometry.extreme_level(df, ["g"], "v", 0, 5).collect()}
    assert got == {"a": 2}


@pytest.mark.parametrize("a, b, want", [(["x"], ["x"], None), (["x"], ["x", "y"], 1), (["x"], ["z"], 0), ([], [], None), ([], ["z"], 0)])
def test_first_divergence(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert one(df.select(interventions.first_divergence(F.col("a"), F.col("b")))) == want


def test_effects_and_summary(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, float("nan")), (1, 1.0, 4.0)], "k int, baseline_value double, patched_value double")
    e = interventions.effects(df)
    got = {r.k: r for r in interventions.summarise(e, ["k"]).collect()}
    assert got[None].n_observations == 1 and got[None].std_effect is None and got[1].mean_effect == 3.0


def test_dense_index_is_row_number(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(37)], "g string, i int")
    got = ranking.dense_index(df, ["g"], [F.col("i")], F.floor(F.col("i") / 10)).collect()
    assert all(r.idx == r.i for r in got) and len(got) == 74


@pytest.mark.parametrize("sizes, want", [([5, 5, 3], [0, 0, 1]), ([12, 1], [0, 1]), ([4, 6, 10, 1], [0, 0, 1, 2]), ([], [])])
def test_shards(spark, sizes, want):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i int, n int")
    got = ranking.shard_assignment(df, "g", "i", "n", 10).orderBy("i").collect()
    assert [r.shard for r in got] == want


def test_minibatches_drop_the_remainder(spark):
    got = ranking.minibatches(spark.range(70).withColumnRenamed("id", "k"), "k", 32).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in got) == [(0, 32), (1, 32)]
    assert ranking.minibatches(spark.range(3).withColumnRenamed("id", "k"), "k", 32).count() == 3


def test_projection_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(20)] + [(99, None)], "key long, v array<double>")
    w = spark.createDataFrame([(i, rng.normal(size=8).tolist(), "ab"[i % 2]) for i in range(50)], "id long, w array<double>, class string")
    def table(df):
        return sorted((r.key, r.id, round(r.value, 9), r["rank"]) for r in df.collect())

    assert table(projection.project_top_k(v, w, 5)) == table(projection.project_top_k(v, w, 5, max_bytes=900))
    mass = lambda df: {(r.key, r["class"]): r.mass for r in df.collect()}
    a, b = mass(projection.project_softmax_mass(v, w)), mass(projection.project_softmax_mass(v, w, max_bytes=900))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
    assert all(math.isclose(a[i, "a"] + a[i, "b"], 1) for i in range(20))
    assert projection.project_top_k(v, w.limit(0), 5).count() == 0


def test_codes_are_sparse_and_discrimination_is_zero(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(24)], "key long, v array<double>")
    enc = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 0.0) for i in range(32)], "id long, w array<double>, b double")
    code = feature_ops.encode(v, enc, 4)
    assert code.groupBy("key").count().where("count > 4").count() == 0 and code.where("z <= 0").count() == 0
    pairs = spark.createDataFrame([("g", i, 2 * i, 2 * i + 1) for i in range(12)], "g string, i int, key_a long, key_b long")
    d = feature_ops.discrimination(code, pairs, ["g"], enc.select(F.col("id").alias("feature_idx")), 5).collect()
    assert len(d) == 32 and max(abs(r.score) for r in d) < 1e-12


def test_training_lowers_the_error():
    x = np.random.default_rng(0).normal(size=(512, 16)) @ np.random.default_rng(1).normal(size=(16, 32))
    _, log = feature_ops.train(x, 64, 8, 64, 10, lr=3e-3)
    assert log[-1]["recon_mse"] < log[0]["recon_mse"]


def test_training_sees_every_vector(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5000, 8)).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(5000)], "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    log = catalogue_of_queries.queries()["sae_train_metrics"](spark, str(tmp_path)).orderBy("step").toPandas()
    assert list(log["step"]) == list(range(3 * (5000 // 128)))
    assert log.groupby("epoch")["batch"].agg(list).map(lambda b: b == list(range(39))).all()
    # the same steps in NumPy, from the batches of the plan
    sae, want = feature_ops.SparseAutoencoder(8, 128, 8), []
    for e in range(3):
        plan = ranking.minibatches(spark.range(5000).withColumnRenamed("id", "vec_id"), "vec_id", 128, epoch=e).toPandas().sort_values(["batch", "vec_id"])
        want += [sae.update(x[g["vec_id"].to_numpy()].astype(float))["recon_mse"] for _, g in plan.groupby("batch")]
    assert log["recon_mse"].tolist() == pytest.approx(want)


def test_expect_rows(spark):
    df = spark.range(3)
    assert corpus_ops.expect_rows(df, 3).count() == 3
    with pytest.raises(Exception, match="expected 4"):
        corpus_ops.expect_rows(df, 4).collect()


def test_state_arithmetic(spark):
    s = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, h array<double>")
    own = s.select("k", F.col("h").alias("donor"))
    assert interventions.patch_states(s, own, ["k"]).orderBy("k").collect() == s.orderBy("k").collect()
    assert interventions.steer_states(s, [1.0, 0.0], 2.0).orderBy("k").first().h == [3.0, 2.0]


def test_catalogue_grid(spark):
    df = catalogue.prompts(spark)
    assert df.count() == 70 and df.groupBy("language").count().where("count != 10").count() == 0
    assert catalogue.prompts(spark, ["en"], "sequence_days").first().expected_next == "Wednesday"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("s", "1", None, 'a "b"\n,c', True, None), ("s", "01", "ja", "", False, "f")], files.CORPUS_SCHEMA)
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(map(str, files.read_jsonl(spark, f"{tmp_path}/j", files.CORPUS_SCHEMA).collect())) == sorted(map(str, df.collect()))
    files.write_csv(df.select("row_id", "text"), f"{tmp_path}/c")
    assert {r.row_id for r in files.read_csv(spark, f"{tmp_path}/c", "row_id string, text string").collect()} == {"1", "01"}
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "x.npy", a)
    got = {tuple(r.idx): r.h for r in files.read_npy(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[1, 2] == a[1, 2].tolist()
    sae, _ = feature_ops.train(np.random.default_rng(0).normal(size=(64, 8)), 16, 4, 16, 1)
    files.write_checkpoint(spark, sae, f"{tmp_path}/sae")
    back = files.read_checkpoint(spark, f"{tmp_path}/sae")
    assert back["config"] == {"hidden": 8, "dict_size": 16, "k": 4} and back["encoder"].count() == 16


def test_continuations(spark):
    df = spark.createDataFrame([("ja-x-1", "a", "1", "one"), ("ja-x-2", "a", "1", "two"), ("zz", "a", "1", "no")], "packet_row_id string, subtask string, source_row_id string, response string")
    assert [tuple(r) for r in files.continuations(df).collect()] == [("JA", "a", "1", "two")]
    with pytest.raises(ValueError):
        files.continuations(df.drop("response"))


def test_summary_has_no_nan(spark):
    out = files.summary_json({"x": spark.createDataFrame([(float("nan"),)], "v double")}, ["b", "a"])
    assert "NaN" not in out and '"a"' in out


def test_log_probs_in_blocks_are_the_same(spark):
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=(40, 6)), rng.normal(size=(15, 6))
    weights = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(w)] + [(500, None)], "id bigint, w array<double>")
    asked = [[0, 39, 39, 7], [], None, [117, 60]] + [[3 * i] for i in range(11)]  # 7 and unknown ids give nothing
    vectors = spark.createDataFrame([(i, [float(x) for x in r], a, "t") for i, (r, a) in enumerate(zip(v, asked))] + [(99, None, [0], "t")], "key bigint, v array<double>, ids array<bigint>, tag string")
    z = v @ w.T
    lp = z - np.log(np.exp(z).sum(axis=1))[:, None]
    want = sorted((i, t, round(lp[i, t // 3], 9)) for i, a in enumerate(asked) for t in a or () if t % 3 == 0)
    for size in (1 << 20, 500):
        got = projection.project_log_probs(vectors, weights, ids="ids", carry=["tag"], max_bytes=size).collect()
        assert sorted((r.key, r.id, round(r.log_prob, 9)) for r in got) == want and {r.tag for r in got} == {"t"}
        whole = projection.project_log_probs(vectors, weights, max_bytes=size).collect()
        assert len(whole) == 600 and sum(np.exp(r.log_prob) for r in whole if r.key == 4) == pytest.approx(1)
    assert projection.project_log_probs(vectors, weights.limit(0), ids="ids").count() == 0


def test_best_with_ties():
    z = np.random.default_rng(1).integers(0, 4, (50, 12)).astype(float)
    for k in (1, 3, 11, 12, 20):
        assert np.array_equal(projection._best(z, k), np.argsort(-z, axis=1, kind="stable")[:, :k])


@pytest.mark.parametrize("window", [0, 1, 3])
def test_dead_features_by_steps(spark, window):
    rng = np.random.default_rng(window)
    fires = {(int(s), int(f)) for s, f in zip(rng.integers(0, 9, 20), rng.integers(0, 6, 20))}
    steps = spark.createDataFrame([(s,) for s in range(9)], "step bigint")
    features_ = spark.createDataFrame([(f,) for f in range(8)], "feature_idx bigint")
    got = {r.step: r.n_dead for r in feature_ops.dead_features(spark.createDataFrame(list(fires) + list(fires)[:3], "step bigint, feature_idx bigint"), features_, steps, window).collect()}
    assert got == {s: sum(s - max((t for t, g in fires if g == f and t <= s), default=-1) > window for f in range(8)) for s in range(9)}


def test_max_activating_rows_are_those_of_the_dense_grid(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k // 7, k % 7) for k in range(40)]
    code = [(f, k, k // 7, k % 7, float(rng.integers(1, 4))) for f, share in ((0, 0.5), (1, 0.05), (2, 0.0), (3, 1.0)) for k in range(40) if rng.random() < share]
    active = {(c[0], c[1]): c[4] for c in code}
    grid = [(f, k, s, p, active.get((f, k), 0.0)) for f in range(4) for k, s, p in rows]
    c = spark.createDataFrame(code, "feature_idx int, key int, shard int, pos int, z double")
    r = spark.createDataFrame(rows, "key int, shard int, pos int")
    want = feature_ops.max_activating(spark.createDataFrame(grid, "feature_idx int, key int, shard int, pos int, activation double"), 5)
    pick = lambda df: sorted((x.feature_idx, x["rank"], x.key, x.activation) for x in df.collect())
    assert pick(feature_ops.max_activating_rows(c, r, 5)) == pick(want)


def test_scores_of_pairs_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abé가 "), rng.integers(0, 40))) for _ in range(60)]
    pairs = list(zip(texts[::2], texts[1::2]))
    alone = [text._gram_scores([" ".join(p.split())], [" ".join(r.split())], 6, 2.0)[0] if p.strip() and r.strip() else 0.0 for p, r in pairs]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)] + [(90, None, "a"), (91, "a" * 70_000, "a" * 70_001)], "id int, p string, r string")
    got = {r.id: r.chrf for r in text.char_f_scores(df, "id", "p", "r").collect()}
    assert [got[i] for i in range(len(pairs))] == pytest.approx(alone) and got[90] == 0 and got[91] > 0.99


def test_bootstrap_is_close_to_exact_and_takes_nulls(spark):
    values = np.random.default_rng(2).normal(1, 1, 200)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)] + [("g", 200, None), ("g", 201, float("nan")), ("none", 0, None), (None, 0, 1.0)], "g string, i int, value double")
    got = {r.g: r for r in geometry.bootstrap_ci(df, ["g"], F.lit(5)).collect()}
    mean, lo, hi = geometry.bootstrap_mean_ci(values, seed=1)
    assert got["g"].mean == pytest.approx(mean) and abs(got["g"].lo - lo) < 0.03 and abs(got["g"].hi - hi) < 0.03 and got["g"].n == 202
    assert got["none"].mean is None and got["none"].lo is None and got[None].lo == got[None].hi == 1.0


def test_last_continuation_of_the_first_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text('side,subtask,source_row_id,response\nJA,q,7,zz\nJA,q,7,"a, ""b"""\nKO,q,08,k\n')
    got = files.read_continuations(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {(r.side, r.subtask, r.source_row_id, r.continuation) for r in got} == {("JA", "q", "7", 'a, "b"'), ("KO", "q", "08", "k")}
    assert files.read_continuations(spark, [str(tmp_path / "a.csv")]) is None


PIECES = {0: "a", 1: "ab", 2: " a", 3: "<0xC3>", 4: "<0xA9>", 5: "ab", 6: "", 7: "abc d", 8: "가", 9: "b", 10: " ", 11: "c", 12: "d", 13: "<0x0A>"}


@pytest.mark.parametrize("t, want", [("abc", [1, 11]), ("abc d", [7]), ("é a", [3, 4, 2]), ("", []), ("가\n", [8, 13]), ("Z", [-1])])
def test_longest_piece_first(t, want):
    k = tokenizer.PieceTokenizer(PIECES)
    assert k.encode(t) == want and (-1 in want or k.decode(want) == t)


def test_tokens_join_to_the_text(spark, sf_dir):
    vocabulary = spark.read.parquet(f"{sf_dir}/token_vocab.parquet")
    k = tokenizer.piece_tokenizer(vocabulary)
    rows = spark.read.parquet(f"{sf_dir}/corpus_rows.parquet").where("text is not null").groupBy("row_id").agg(F.max(F.struct("loaded_at", "text")).alias("m")).select("row_id", "m.text").collect()
    got = {}
    for r in catalogue_of_queries.queries()["token_pieces"](spark, sf_dir).orderBy("row_id", "token_idx").collect():
        got.setdefault(r.row_id, []).append(r.token_id)
    assert len(got) > 50 and all(k.decode(got.get(r.row_id, [])) == r.text for r in rows)
    with pytest.raises(ValueError):
        tokenizer.piece_tokenizer(vocabulary, 10)
    df = spark.createDataFrame([(None,), ("",)], "t string").select(tokenizer.token_ids(F.col("t"), vocabulary).alias("x"))
    assert [r.x for r in df.collect()] == [None, []]


def test_target_by_text(spark):
    rows = [([1, 2], [" Cat", None], 9, "CATS"), ([1, 2], ["", " "], 9, "x"), ([9], ["q"], 9, None), ([1], None, 9, "x"), ([1], ["scatter"], 9, "Cat"), (None, ["b"], 9, "a")]
    df = spark.createDataFrame(rows, "ids array<bigint>, tokens array<string>, id bigint, t string")
    assert [r.m for r in df.select(projection.target_in_top(F.col("ids"), F.col("tokens"), F.col("id"), F.col("t")).alias("m")).collect()] == [True, False, True, False, True, False]


def test_final_norm(spark):
    v = [3.0, -4.0]
    r = spark.createDataFrame([(v, [2.0, 1.0]), (None, None), ([0.0, 0.0], [1.0, 1.0])], "v array<float>, g array<float>").select(vectors.rms_norm(F.col("v"), F.col("g")).alias("n")).collect()
    assert r[0].n == pytest.approx([6 / np.sqrt(12.5), -4 / np.sqrt(12.5)]) and r[1].n is None and r[2].n == [0.0, 0.0]


def test_pairs_of_the_first_sentences(spark):
    s = spark.createDataFrame([(l, i, f"{l}{i}") for l in ("a", "b") for i in range(30) if (l, i) != ("b", 3)], "language string, idx int, text string")
    pairs = lambda first: corpus_ops.bidirectional_pairs(s, [("A-B", "a", "b")], {"a": "A", "b": "B"}, F.col("source_text"), first).collect()
    assert len(pairs(14)) == 26 and len(pairs(None)) == 58 and {int(r.source_row_id) for r in pairs(14)} == set(range(14)) - {3}
