"""Folds from the edges of their quotas, and replicates over whole columns in few tasks, against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import whole
from probity.functions.expr import P
from probity.operators import bootstrap as b
from probity.operators import metrics as m
from probity.plans import fixtures as fx
from tests.conftest import DATA


def h(x, salt):
    a = (x * 48271 + salt * 69621 + 1) % P
    b = (a * 16807 + salt) % P
    return (b * b + a) % P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_folds_shuffle_no_rows_and_equal_the_ranks(spark):
    assert "Exchange hashpartitioning" not in plan(m.folded(spark, str(DATA)))
    rng = random.Random(1)
    rows = [(i * 7, rng.randrange(3), rng.choice([1, 2, 4, 5])) for i in range(5000)] + [(90_001, 7, 3)]
    df = spark.createDataFrame(rows, "unit_id bigint, true_class int, fold_a int")
    got = {r["unit_id"]: r["fold_b"] for r in fx.row_folds(df, 13).collect()}
    want = {}
    for c in {r[1] for r in rows}:
        folds = sorted(f for _, k, f in rows if k == c)
        want |= dict(zip(sorted((u for u, k, _ in rows if k == c), key=lambda u: (h(u, 13), u)), folds))
    assert got == want
    assert set(fx.row_folds(df.where("false")).columns) == {*df.columns, "fold_b"} and fx.row_folds(df.where("false")).count() == 0


def test_hashes_in_numpy_equal_the_expression():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.arange(40_000), rng.integers(0, 1 << 42, 3000)])
    for y, salt in ((0, 11), (777, 5), (20_000 * 1_000_003, 777)):
        got = whole.hashed(whole.linear(x), y, salt)
        assert got.tolist() == [h(int(v) + y, salt) for v in x]
    assert (whole.remainder(got, 12_345) == got % 12_345).all()


def test_nulls_of_folds_equal_the_ranks_without_shuffling_a_replicate(spark):
    rng = random.Random(3)
    rows = [(i * 5 + rng.randrange(5), rng.randrange(60), 0, rng.choice([1, 2, 4, 5])) for i in range(1500)] + [(9_000, 77, 1, 2)]
    rows = [(u, c, c % 3, f) for u, c, _, f in rows]
    df = spark.createDataFrame(rows, "unit_id bigint, cluster_id bigint, true_class int, fold_a int").repartition(3)
    got = {r["seed"]: r["same"] for r in b.same_folds(df, 101, 9).collect()}
    for seed in range(101, 110):
        same = 0
        for k in {r[2] for r in rows}:
            mine = sorted((r for r in rows if r[2] == k), key=lambda r: (h(r[0], seed), r[0]))
            same += sum(r[3] == f for r, f in zip(mine, sorted(r[3] for r in mine)))
        assert got.pop(seed) == same
    assert not got
    got = {r["rep"]: r["n"] for r in b.torn_clusters(df, 1, 9).collect()}
    for rep in range(1, 10):
        folds = {}
        for r, f in zip(sorted(rows, key=lambda r: (h(r[0] * 4096 + rep, 5), r[0])), [r[3] for r in sorted(rows)]):
            folds.setdefault(r[1], set()).add(f)
        assert got.pop(rep) == sum(len(f) > 1 for f in folds.values())
    assert not got


def test_drawn_sums_equal_the_sums_over_a_table_of_draws(spark):
    rng = random.Random(4)
    units = spark.createDataFrame([(u * 3 + 1, u % 2, u % 4) for u in range(50)], "u bigint, c int, k int")
    levels, columns = {"model": ("x", "y"), "arm": ("A", "B", "C")}, ["a", "n"]
    row = lambda u: (u, rng.choice("xy"), rng.choice("AB"), rng.random(), 1.0)
    own = spark.createDataFrame([row(rng.randrange(60) * 3 + 1) for _ in range(70)], "u bigint, model string, arm string, a double, n double")
    kinds = spark.createDataFrame([row(k) for k in range(3) for _ in range(2)], "k bigint, model string, arm string, a double, n double")
    for frame, sums, of in ((units.select("u", "c"), own, "u"), (units, kinds, "k")):
        got = {tuple(r)[:4]: tuple(r)[4:] for r in b.drawn_sums(frame, sums, levels, columns, [(2026, 12), (777, 30)]).collect()}
        for i, (salt, reps) in enumerate(((2026, 12), (777, 30))):
            draws = fx.draws(units, "u", "c", reps, salt).join(units, "u")
            for r in draws.join(sums, of).groupBy("rep", "model", "arm").agg(F.sum(F.col("w") * F.col("a")), F.sum(F.col("w") * F.col("n"))).collect():
                assert got.pop((i, r[0], r[1], r[2])) == pytest.approx((r[3], r[4]))
        assert not got
    assert b.drawn_sums(units.where("false"), kinds, levels, columns, [(1, 2)]).count() == 0


def test_draws_are_made_without_a_row_for_each(spark, monkeypatch):
    def rows(*_, **__):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(fx, "draws", rows)
    for query in (b.q_unchanged_fold_difference, b.q_naive_width, b.q_fresh_draws):
        assert query(spark, str(DATA)).columns
