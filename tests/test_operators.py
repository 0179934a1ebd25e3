import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probity.functions import expr
from probity.functions.ranks import group_rank
from probity.functions.session import plain_id, plain_image_id, plain_stem
from probity.operators import bootstrap as b
from probity.operators import metrics as m
from probity.operators import screening as sc
from probity.operators import splits as sp
from probity.plans import fixtures as fx
from tests.conftest import DATA


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1 / 3,), (0.4,), (0.4000001,), (0.6,), (1.0,)], "c double")
    assert [r["b"] for r in df.select(expr.bin15("c").alias("b")).collect()] == [4, 5, 6, 8, 14]


def test_brier_bounds(spark):
    p = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    df = spark.createDataFrame([(0,), (1,)], "y int")
    assert [r[0] for r in df.select(expr.brier(p(1, 0, 0), "y")).collect()] == [0.0, 2.0]
    assert one(spark, expr.brier(p(1 / 3, 1 / 3, 1 / 3), F.lit(0))) == pytest.approx(6 / 9)


def test_argmax_takes_the_first(spark):
    assert one(spark, expr.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))) == 0


@pytest.mark.parametrize("pid,strict,loose", [("MR024780B", "MR024780", "MR024780"), ("MR0247800B", "MR0247800B", "MR0247800"), ("MR024780BC", "MR024780BC", "MR024780"), ("MR024780b", "MR024780b", "MR024780"), ("ABC1234B", "ABC1234B", "ABC1234B")])
def test_stems(spark, pid, strict, loose):
    assert one(spark, expr.strict_stem(F.lit(pid))) == strict
    assert one(spark, expr.loose_stem(F.lit(pid))) == loose


def test_plain_ids(spark):
    df = spark.createDataFrame([(" mr-000 1b ",), ("0012",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(plain_id("x")).collect()] == ["MR0001B", "12", None, None]
    ids = spark.createDataFrame([("7",), (" 7",), ("7.0",), ("batch_01/7.mat",), ("x7",), (None,), ("",)], "x string")
    assert [r[0] for r in ids.select(plain_image_id("x")).collect()] == [7, 7, 7, 7, None, None, None]
    s = spark.createDataFrame([(None, "mr000123c"), ("MR000999K", "1"), ("5 5", "1")], "s string, p string")
    assert [r[0] for r in s.select(plain_stem(F.col("s"), F.col("p"))).collect()] == ["MR000123", "MR000999", "55"]


def test_guarded_division_and_softmax(spark):
    assert one(spark, expr.safe_div(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, expr.div(F.lit(1.0), F.lit(0.0))) is None
    p = one(spark, expr.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))))
    assert p == pytest.approx([0.5, 0.5, 0.0])


def test_display_pixels(spark):
    assert one(spark, expr.display_pixels(F.array(F.lit(2), F.lit(2)))) == [0, 0]
    assert one(spark, expr.display_pixels(F.array(F.lit(0), F.lit(1), F.lit(3)))) == [0, 85, 255]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=40))
def test_group_rank(spark, rows):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g int, v bigint, i int")
    got = {(r["i"]): r["k"] for r in group_rank(df, ["g"], "v", ["i"], 7, "k").collect()}
    for g in {g for g, _ in rows}:
        order = sorted((v, i) for i, (h, v) in enumerate(rows) if h == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def frame(spark, rows):
    return spark.createDataFrame([("m", "A", i, i // 2, str(i // 2), y, 1, p, int(np.argmax(p)), max(p)) for i, (y, p) in enumerate(rows)],
                                 "model string, arm string, unit_id bigint, cluster_id bigint, pid string, true_class int, fold_a int, probs array<double>, pred_class int, confidence double")


def test_calibration_error_knowns(spark):
    for y, ece in ((0, 0.1), (1, 0.9)):
        s = m.summary(frame(spark, [(y, [0.9, 0.05, 0.05])] * 10), ["model", "arm"]).first()
        assert s["ece"] == pytest.approx(ece)


def test_absent_class_counts_zero(spark):
    s = m.summary(frame(spark, [(0, [0.9, 0.05, 0.05]), (1, [0.1, 0.8, 0.1])]), ["model", "arm"]).first()
    assert s["accuracy"] == 1.0 and s["balanced_accuracy"] == pytest.approx(2 / 3)


def test_empty_frames(spark):
    empty = frame(spark, [(0, [1.0, 0.0, 0.0])]).where("false")
    for q in (m.summary, m.confusion_long, m.per_class, m.reliability, m.calibration):
        assert q(empty, ["model", "arm"]).count() == 0


def test_weighted_equals_replicated(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), [float(x) for x in rng.dirichlet([1, 1, 1])]) for _ in range(40)]
    pred = frame(spark, rows)
    w = spark.createDataFrame([(1, c, int(rng.integers(0, 4))) for c in range(20)], "rep int, cluster_id bigint, w bigint").where("w > 0")
    by_sums = b.replicates(b.cluster_sums(pred, "cluster_id"), w, "cluster_id").first()
    copies = pred.join(w, "cluster_id").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).drop("x", "rep", "w")
    direct = m.summary(copies, ["model", "arm"]).first()
    for name in b.METRICS:
        assert by_sums[name] == pytest.approx(direct[name])


def test_draws_keep_strata(spark):
    units = spark.createDataFrame([(i, i % 3) for i in range(31)], "u bigint, c int")
    w = fx.draws(units, "u", "c", reps=5).join(units, "u").groupBy("rep", "c").agg(F.sum("w").alias("n"))
    sizes = {0: 11, 1: 10, 2: 10}
    got = values(w, "c", "n")
    assert len(got) == 15 and all(n == sizes[c] for c, n in got)


def test_row_folds_keep_margins_and_ignore_order(spark):
    u = fx.units(spark, str(DATA))
    split = fx.row_folds(u)
    count = lambda f: sorted(values(split.groupBy("true_class", f).count(), "true_class", f, "count"))
    assert count("fold_a") == count("fold_b")
    again = fx.row_folds(u.orderBy(F.desc("unit_id")).repartition(3))
    assert sorted(values(split, "unit_id", "fold_b")) == sorted(values(again, "unit_id", "fold_b"))


def test_exposure_literals(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 2), (4, "b", 1), (5, None, 1), (6, "b", None)], "i int, p string, f int")
    got = sorted(values(sp.exposure_table(df, "i", "p", "f"), "i", "n_other_total", "n_other_train", "frac_other_train", "single_slice_patient", "has_same_patient_train_slice"))
    assert got == [(1, 2, 2, 1.0, False, True), (2, 2, 1, 0.5, False, True), (3, 2, 1, 0.5, False, True), (4, 0, 0, None, True, False)]


def test_overlap_literals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "p string, f int")
    assert sorted(values(sp.overlap_stats(df, "p", "f"), "fold", "test_rows", "test_clusters", "also_in_train")) == [(1, 1, 1, 1), (2, 2, 2, 1)]


def test_stem_exposure_needs_another_id_in_another_fold(spark):
    rows = [(1, "MR000001A", "MR000001", 1), (2, "MR000001B", "MR000001", 2), (3, "MR000001B", "MR000001", 1), (4, "7", "7", 1), (5, "7", "7", 2), (6, None, None, 1)]
    df = spark.createDataFrame(rows, "i int, pid string, stem string, fold int")
    assert dict(values(sp.stem_exposed(df, "i", "pid", "stem", "fold"), "i", "exposed")) == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_rebalanced_moves_choose_own_folds(spark):
    ids = spark.createDataFrame([("a", "s", 6, 1, 1), ("b", "s", 4, 1, 2), ("c", "t", 3, 1, 2), ("d", "t", 2, 1, 3), ("e", "u", 9, 1, 4)], "patient_id string, stem string, n_images int, label int, fold_original int")
    assert dict(values(sp.rebalanced_moves(ids), "stem", "fold_after")) == {"s": 2, "t": 3}  # costs 9 - 49 beat 16 - 36, then 9 - 4 beat 64 - 9


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.5)], "fam string, h string, p double")
    got = {(r["fam"], r["h"]): r["p_holm"] for r in b.holm(df, "p", ["fam"], ["h"]).collect()}
    assert got[("f", "a")] == pytest.approx(0.03) and got[("f", "c")] == pytest.approx(0.06) and got[("f", "b")] == pytest.approx(0.06) and got[("g", "a")] == 0.5


def test_cluster_robust_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(int(i) // 5, float(v), float(2 + 3 * v + e)) for i, (v, e) in enumerate(zip(x, rng.normal(scale=0.1, size=300)))], "g int, x double, y double")
    got = {r["term"]: r["coef"] for r in b.cluster_robust_ols(df, "y", ["x"], "g").collect()}
    assert got["x"] == pytest.approx(3, abs=0.05) and got["intercept"] == pytest.approx(2, abs=0.05)


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-2**62, 2**62, 40)]
    hashes = base + [x ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for x in base]
    df = spark.createDataFrame(list(enumerate(hashes)), "i bigint, hash bigint")
    got = sorted(values(sc.hamming_join(df, "i", 3), "id_a", "id_b", "distance"))
    first = {}
    for i, x in enumerate(hashes):
        first.setdefault(x, i)
    ids = sorted(first.values())
    want = sorted((a, c, bin((hashes[a] ^ hashes[c]) & (2**64 - 1)).count("1")) for a in ids for c in ids if a < c and bin((hashes[a] ^ hashes[c]) & (2**64 - 1)).count("1") <= 3)
    assert got == want


def test_exact_groups(spark):
    df = spark.createDataFrame([(1, "k", "p", 1), (2, "k", "q", 1), (3, "z", "p", 1), (4, None, "p", 1), (5, None, "p", 1)], "i int, k string, p string, l int")
    assert values(sc.exact_groups(df, "i", ["k"], {"cross": "p", "labels": "l"}), "k", "first", "n", "cross", "labels") == [("k", 1, 2, True, False)]


def test_all_candidate_pairs_are_verified(spark):
    from probity.functions.session import table
    pairs = {(r["image_a"], r["image_b"]): r["ncc_full"] for r in sc.pairs(spark, str(DATA)).collect()}
    thumbs = table(spark, str(DATA), "image_manifest").where("readable and thumb is not null and image_id is not null").groupBy("image_id").agg(F.max("thumb").alias("t"))
    t = {r["image_id"]: np.array(r["t"], dtype=float) for r in thumbs.collect()}
    want = {k for k in pairs if k[0] in t and k[1] in t}
    assert any(pairs[k] is None or pairs[k] < 0.95 for k in want)
    got = {(r["image_a"], r["image_b"]): r for r in sc.q_verify_pairs(spark, str(DATA)).collect()}
    assert set(got) == want
    for (a, b), r in got.items():
        x, y = t[a], t[b]
        span = max(x.max(), y.max()) - min(x.min(), y.min())
        assert (r["ncc"] is None) == (x.std() == 0 or y.std() == 0) and (r["ncc"] is None or abs(r["ncc"] - np.corrcoef(x, y)[0, 1]) < 2e-6)
        assert abs(r["mad_norm"] - np.abs(x - y).mean() / max(span, 1)) < 2e-6 and abs(r["equal"] - (x == y).mean()) < 2e-6


def test_softmax_counts_logits_of_all_names_and_types(spark):
    import json

    from probity.functions.session import table
    from probity.operators import registry

    def number(v):
        v = v[0] if isinstance(v, list) and v else v.get("value") if isinstance(v, dict) else v
        try:
            return np.isfinite(float(str(v).replace(",", ".")))
        except ValueError:
            return False

    n, plain = 0, 0
    for r in table(spark, str(DATA), "retrain_files").dropDuplicates(["run_series", "file_seq", "row_no"]).collect():
        try:
            o = json.loads(r["record"])
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            n += all(any(number(o.get(x)) for x in (f"logit_{k}", f"z_{k}", f"Logit_{k}", f"logit{k}", f"logits_{k}")) for k in range(3))
            plain += all(type(o.get(f"logit_{k}")) in (int, float) for k in range(3))
    assert sum(r["n"] for r in registry.q_softmax(spark, str(DATA)).collect()) == n > plain
