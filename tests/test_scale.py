"""Helpers for hot keys, large groups and many replicates, against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import ranks
from probity.functions.skew import lookup
from probity.operators import bootstrap as bs
from probity.operators import design as ds
from probity.operators import screening as sc
from probity.operators import splits as sp


def test_lookup_equals_a_join_with_hot_keys_and_missing_ones(spark):
    rows = [(i % 7 if i < 3000 else 100 + i, i) for i in range(4000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k bigint, v int")
    per = df.where("k is null or k != 3").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = sorted((r["k"], r["v"], r["m"]) for r in lookup(df, per, "k", "n", len(rows)).collect())
    most = {}
    for k, v in rows:
        most[k] = max(most.get(k, v), v)
    assert got == sorted((k, v, most[k]) for k, v in rows if k is not None and k != 3)


def test_quantiles_equal_numpy_with_ties_nulls_and_constant_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=500).round(2).tolist() + [None, None], "b": [4.0] * 9, "c": [1.0], "d": [None], "e": [0.0] * 300 + [1e9] + rng.random(50).tolist(), "f": [-1.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", ranges=20).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        assert got[g]["n"] == len(known)
        for q in ranks.GRID:
            want = np.quantile(known, q) if known else None
            assert got[g][ranks.quantile_name(q)] == (pytest.approx(want, rel=1e-12, abs=1e-12) if known else None)


def test_sums_before_and_first_of(spark):
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    for r in ranks.sum_before(df, ["g"], "o", 7, "v", "s").collect():
        assert r["s"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"])
    few = ranks.first_of(df, ["g"], [F.desc("v"), "o"], 4, "k").collect()
    assert len(few) == 8 and {r["o"] for r in few if r["g"] == "b"} == {o for g, o, v in sorted(rows, key=lambda x: (-x[2], x[1])) if g == "b"} & {r["o"] for r in few}


@pytest.mark.parametrize("rows,reps", [(50_000, 125), (20, 3)])
def test_weighted_sums_equal_a_join(spark, rows, reps):
    rng = random.Random(5)
    sums = spark.createDataFrame([(u, rng.choice("xy"), rng.choice([1, 2, None]), rng.random(), 1.0) for u in range(40) for _ in range(3)], "u bigint, g string, h int, a double, b double")
    draws = spark.createDataFrame([(rep, rng.randrange(45), rng.randrange(1, 4)) for rep in range(1, 11) for _ in range(12)], "rep int, u bigint, w bigint").groupBy("rep", "u").agg(F.sum("w").alias("w"))
    want = {(r["rep"], r["g"], r["h"]): (r["a"], r["b"]) for r in draws.join(sums, "u").groupBy("rep", "g", "h").agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b")).collect()}
    got = {(r["rep"], r["g"], r["h"]): (r["a"], r["b"]) for r in bs.weighted_sums(draws, sums, "u", ["g", "h"], ["a", "b"], rows, reps).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert bs.weighted_sums(draws.where("false"), sums, "u", ["g", "h"], ["a"]).count() == 0


def test_flipped_bands_find_all_and_few_others(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(150)]
    near = [b ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(1, 16))) for b in base[:40]]
    hashes = base + near + base[:5]
    df = spark.createDataFrame(list(enumerate(hashes)), "i bigint, hash bigint")
    first = {}
    for i, x in enumerate(hashes):
        first.setdefault(x, i)
    ids = sorted((i, x) for x, i in first.items())
    want = {(a, b, (x ^ y).bit_count()) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1:] if (x ^ y).bit_count() <= 15}
    assert {tuple(r) for r in sc.hamming_join(df, "i", 15).collect()} == want and len(want) >= 40
    assert sc.hamming_candidates(df, "i", 15).select("id_a", "id_b").distinct().count() < 0.3 * len(ids) * (len(ids) - 1) / 2


def test_similarity_of_structures():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 200, (4, 100)).astype(float)
    assert sc.ssim(a, a) == pytest.approx(np.ones(4)) and (sc.ssim(a, rng.permuted(a, axis=1)) < 0.6).all()
    flat = np.full((1, 100), 7.0)
    assert sc.ssim(flat, flat) == pytest.approx([1.0])
    one, other, span, out = a[0].reshape(10, 10), a[1].reshape(10, 10), max(a[0].max(), a[1].max()) - min(a[0].min(), a[1].min()), []
    for r in range(4):
        for c in range(4):
            x, y = one[r:r + 7, c:c + 7].ravel(), other[r:r + 7, c:c + 7].ravel()
            k = np.cov(x, y)
            out.append((2 * x.mean() * y.mean() + (0.01 * span) ** 2) * (2 * k[0, 1] + (0.03 * span) ** 2) / ((x.mean() ** 2 + y.mean() ** 2 + (0.01 * span) ** 2) * (k[0, 0] + k[1, 1] + (0.03 * span) ** 2)))
    assert sc.ssim(a[:1], a[1:2])[0] == pytest.approx(np.mean(out))


def test_controls_are_taken_like_one_after_the_other(spark):
    rng = random.Random(8)
    for trial in range(3):
        el = [(f"{'MR' if rng.random() < 0.5 else ''}{trial}{i:03d}", rng.randrange(1, 3), rng.randrange(2, 7)) for i in range(60)]
        rest = [(f"{'MR' if rng.random() < 0.3 else ''}9{i:03d}", rng.randrange(1, 3), rng.randrange(1, 9)) for i in range(80)]
        images = [(p, x) for p, x, n in rest for _ in range(n)]
        got = {r["patient_id"]: r for r in ds.controls(spark.createDataFrame(el, "patient_id string, label int, n_donor bigint"), spark.createDataFrame(images, "patient_id string, label int")).collect()}
        size, label = {p: n for p, _, n in rest}, {p: x for p, x, _ in rest}
        taken = [r["control_patient"] for r in got.values() if r["control_patient"]]
        assert len(got) == 60 and len(set(taken)) == len(taken)
        fmt = lambda p: p.startswith("MR")
        for p, x, d in el:
            c = got[p]["control_patient"]
            if c:
                assert label[c] == x and size[c] >= d and got[p]["same_format"] == (fmt(c) == fmt(p))
        # one after the other, larger needs first, the own format first: as many get a control, and one of the own format
        free, n_same, n_any = [(p, x, min(n, 6)) for p, x, n in rest], 0, 0
        for d in range(6, 1, -1):
            waiting = []
            for p, x, need in el:
                if need == d:
                    pool = sorted((c for c in free if c[1] == x and c[2] >= d and fmt(c[0]) == fmt(p)), key=lambda c: -c[2])
                    if pool:
                        free.remove(pool[0])
                        n_same, n_any = n_same + 1, n_any + 1
                    else:
                        waiting.append((p, x))
            for p, x in waiting:
                pool = sorted((c for c in free if c[1] == x and c[2] >= d and fmt(c[0]) != fmt(p)), key=lambda c: -c[2])
                if pool:
                    free.remove(pool[0])
                    n_any += 1
        assert sum(r["same_format"] is True for r in got.values()) == n_same and len(taken) == n_any


def test_exposed_stems_and_members_of_groups(spark):
    ids = [(0, 1), (4, 1), (1, 1), (5, 2), (1, 2), (2, 3), (6, 3), (3, 1), (3, 2), (None, 1)]
    df = spark.createDataFrame([(i, None if k is None else f"p{k}", None if k is None else f"s{k % 4}", f) for i, (k, f) in enumerate(ids)], "row bigint, pid string, stem string, fold int")
    got = {r["row"]: r["exposed"] for r in sp.stem_exposed(df, "row", "pid", "stem", "fold").collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    members = {(r["stem"], r["first"], r["n"], r["row"]) for r in sc.group_members(df, "row", ["stem"]).collect()}
    assert ("s0", 0, 2, 1) in members and len(members) == 9
