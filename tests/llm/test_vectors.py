import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.llm import neighbours as nb
from probity.llm import overlap as ov
from probity.llm import queries as q
from probity.llm.cells import fit_cells


def unit(x):
    x = np.asarray(x, dtype=float)
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, seed, spread=6):
    rng = np.random.default_rng(seed)
    base = rng.integers(40, 200, (max(2, n // 12), 30))
    return (base[rng.integers(0, len(base), n)] + rng.integers(-spread, spread + 1, (n, 30))).astype(int)


def payload(spark, ids, x):
    df = spark.createDataFrame([(int(i), [int(v) for v in r]) for i, r in zip(ids, x)], "id bigint, thumb array<smallint>")
    return ov.packed(df, "thumb", ["id"])


@pytest.mark.parametrize("at_least,block", [(0.97, 2048), (0.9, 16), (0.995, 7)])
def test_cosine_join_equals_brute_force(spark, at_least, block):
    a, b = clustered(120, 1), clustered(150, 1)
    got = {(r["id_l"], r["id_r"]) for r in ov.cosine_join(payload(spark, range(120), a), payload(spark, range(150), b), at_least, block=block).collect()}
    s = unit(a) @ unit(b).T
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= at_least))} and got


@pytest.mark.parametrize("terms", [1, 2, 5, 25])
def test_cosine_join_is_the_same_with_any_number_of_terms(spark, terms):
    a, b = clustered(90, 13), clustered(110, 13)
    got = {(r["id_l"], r["id_r"]) for r in ov.cosine_join(payload(spark, range(90), a), payload(spark, range(110), b), 0.95, terms=terms).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(unit(a) @ unit(b).T >= 0.95))} and got


def test_lists_that_cannot_reach_are_not_asked(spark):
    x = clustered(400, 14)
    p = payload(spark, range(400), x)
    basis, spread, n = ov.axes(p)
    terms = ov.indexed_terms(spread, 10**9, 0.245, 0.25)
    posted = ov.post(p, basis, terms, 0.25)
    lists = ov.directory(posted, basis, terms)
    asked = ov.ask(p, lists, basis, terms, 0.97).groupBy("list").count().collect()
    held = dict(zip(lists["list"], lists["n"]))
    assert n == 400 and sum(held.values()) == 400 and sum(r["count"] * held[r["list"]] for r in asked) < 0.2 * 400 * 400


def test_cosine_join_of_nothing(spark):
    one = payload(spark, [1], clustered(12, 2)[:1])
    assert ov.cosine_join(one, one.where("false"), 0.9).count() == 0
    assert ov.cosine_join(one.where("false"), one.where("false"), 0.9).count() == 0


PICTURE = "image_id bigint, raw_array_hash string, canonical_image_hash string, display_hash string, thumb array<smallint>, held boolean, trained boolean"


def test_cross_pairs_of_odd_pictures(spark):
    flat, t = [5, 5, 5], [1, 2, 9]
    rows = [(1, "h", None, None, t, True, False), (2, "h", None, None, None, False, True), (3, None, None, "d", flat, True, True), (4, None, None, "d", flat, False, True),
            (5, None, None, None, t, False, True), (6, None, None, None, [2, 4, 18], True, False), (7, None, None, None, [], True, True)]
    got = {tuple(r) for r in ov.cross_pairs(spark.createDataFrame(rows, PICTURE)).collect()}
    assert got == {(1, 2), (3, 3), (3, 4), (1, 5), (6, 5), (7, 7)}
    assert ov.cross_pairs(spark.createDataFrame([], PICTURE)).count() == 0


def brute(ids, x, k):
    s = np.round(unit(x) @ unit(x).T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[a] = [(ids[j], s[i, j]) for j in order]
    return out


def test_graph_recall():
    x = unit(clustered(1500, 3, 30)).astype(np.float32)
    g = nb.Graph(x)
    found, _ = g.search(x, g.starts, np.arange(len(x)))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(set(t) & set(f)) for t, f in zip(truth, found))
    assert hits / truth.size > 0.95
    assert (g.edges < len(x)).all() and (np.sort(g.edges, axis=1) >= -1).all()


@pytest.mark.parametrize("n", [1, 2, 5, 70])
def test_small_graphs_find_all(n):
    x = unit(np.random.default_rng(n).integers(0, 255, (n, 20))).astype(np.float32)
    g = nb.Graph(x)
    found, _ = g.search(x, g.starts)
    assert all(i in f for i, f in enumerate(found))


def manifest(spark, rows):
    return spark.createDataFrame(rows, "image_id bigint, thumb array<smallint>, other string, n int")


def test_similar_images_with_repeats_and_ties(spark):
    x = clustered(80, 5).tolist()
    rows = [(i, t, "clash", 1) for i, t in enumerate(x)] + [(100 + i, x[0], None, 1) for i in range(9)]
    ids, pics = [r[0] for r in rows], [r[1] for r in rows]
    again = rows + rows[:10] + [(200, None, "a", 1), (201, [7] * 30, "a", 1), (202, [], "a", 1), (None, x[1], "a", 1), (203, [None, *x[1][1:]], "a", 1)]
    got = {}
    for r in nb.similar_images(manifest(spark, again), 5).orderBy("image_id", "rank").collect():
        got.setdefault(r["image_id"], []).append((r["other"], r["similarity"]))
    want = brute(ids, pics, 5)
    assert set(got) == set(want)
    same = sum(len({o for o, _ in got[i]} & {o for o, _ in want[i]}) for i in want)
    assert same / (5 * len(want)) > 0.97
    assert got[105] == [(0, 1.0), (100, 1.0), (101, 1.0), (102, 1.0), (103, 1.0)] and got[0][0] == (100, 1.0)


def test_stated_queries_get_the_same_neighbours(spark):
    df = manifest(spark, [(i, t, "", 0) for i, t in enumerate(clustered(150, 6).tolist())])
    some = {tuple(r) for r in nb.similar_images(df, 5, every=10).collect()}
    assert some == {tuple(r) for r in nb.similar_images(df, 5).where("image_id % 10 = 0").collect()} and len(some) == 75


def test_similar_images_of_few(spark):
    assert nb.similar_images(manifest(spark, []), 5).count() == 0
    assert nb.similar_images(manifest(spark, [(1, [1, 2, 3], "", 0)]), 5).count() == 0
    assert nb.similar_images(manifest(spark, [(1, [1, 2, 3], "", 0), (2, [1, 2, 4], "", 0)]), 5).count() == 2


def test_each_image_gets_its_best_of_both_kinds(spark):
    x, rng = clustered(200, 9), np.random.default_rng(9)
    owner = np.where(np.arange(200) % 3 == 0, 500, rng.integers(0, 60, 200))  # one holds a third
    owner[::7] = 900  # and a group of near copies is one patient's
    x[::7] = x[0] + rng.integers(-1, 2, x[::7].shape)
    rows = [(i, t, str(p) if i != 50 else None) for i, (t, p) in enumerate(zip(x.tolist(), owner.tolist()))]
    got = {r["image_id"]: r for r in nb.nn_similarity(spark.createDataFrame(rows, "image_id bigint, thumb array<smallint>, patient_id string"), step=5).collect()}
    s = unit(x) @ unit(x).T
    assert set(got) == set(range(0, 200, 5)) and got[50][2:] == (None, None)
    for i in set(got) - {50}:
        for value, kind in ((got[i][2], owner == owner[i]), (got[i][3], owner != owner[i])):
            kind[[i, 50]] = False
            assert value == (pytest.approx(s[i, kind].max(), abs=2e-6) if kind.any() else None)


@pytest.mark.parametrize("same", [True, False])
def test_best_of_kind_in_blocks_equals_one_block(spark, same):
    x = clustered(90, 10)
    df = spark.createDataFrame([(i, str(i % 4), t) for i, t in enumerate(x.tolist())], "image_id bigint, patient_id string, thumb array<smallint>")
    every = ov.packed(df, "thumb", ["image_id", "patient_id"])
    one, many = (sorted(map(tuple, nb.best_of_kind(every.where("image_id % 2 = 0"), every, same, b, m).collect())) for b, m in ((1024, 8192), (7, 5)))
    assert one == many and len(one) == 45


def test_shards_keep_recall(spark):
    x = clustered(900, 8)
    near = nb.nearest(payload(spark, range(900), x).withColumn("ask", F.lit(True)), 5, rows=150, most=200).collect()
    best = {}
    for r in near:
        best.setdefault(r["id"], []).append((-r["similarity"], r["other"]))
    want, hit, n = brute(list(range(900)), x, 5), 0, 0
    for i, w in want.items():
        top = {o for _, o in sorted(set(best.get(i, [])))[:5]}
        w = {o for o, s in w if s >= 0.8}
        hit, n = hit + len(top & w), n + len(w)
    assert n > 2000 and hit / n >= 0.9


def test_cells_part_all_and_margins_only_add(spark):
    x = clustered(2000, 11, 30)
    cells = fit_cells(payload(spark, range(2000), x), 2000, 30)
    row, cell, own = cells.route(unit(x).astype(np.float32), 0.08)
    assert sorted(row[own]) == list(range(2000)) and len(cells) <= 36 and cell.max() < len(cells)
    narrow = cells.route(unit(x).astype(np.float32), -1.0)
    assert set(zip(narrow[0], narrow[1])) == set(zip(row[own], cell[own])) and narrow[2].all()
    assert len(fit_cells(payload(spark, range(3), x[:3]).where("false"), 0, 4)) == 1


def test_many_small_shards_keep_recall(spark):
    x = clustered(2400, 12)
    near = nb.nearest(payload(spark, range(2400), x), 5, rows=24, most=30, at_least=0.8).collect()
    best = {}
    for r in near:
        best.setdefault(r["id"], set()).add((-r["similarity"], r["other"]))
    want, hit, n = brute(list(range(2400)), x, 5), 0, 0
    for i, w in want.items():
        top = {o for _, o in sorted(best.get(i, ()))[:5]}
        w = {o for o, s in w if s >= 0.8}
        hit, n = hit + len(top & w), n + len(w)
    assert n > 5000 and hit / n >= 0.9


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p5_nn_similarity"])
def test_queries_equal_sql(agree, name):
    agree(q.queries()[name], q.oracle_sql()[name])


def test_other_queries_run(spark):
    from tests.conftest import DATA
    for name in ("p1_counts",):
        assert q.queries()[name](spark, str(DATA)).columns
