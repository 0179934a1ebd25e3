import random

import pytest
from pyspark.sql import functions as F

from probity.llm import groups as g
from probity.llm import queries as q


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent)


CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "reversed chain": [(i + 1, i) for i in range(40, 0, -1)],
    "star": [(1000, i) for i in range(60)],
    "two": [(1, 2), (2, 1), (1, 2), (7, 8)],
    "nulls and loops": [(None, 1), (2, None), (3, 3), (None, None)],
    "tree": [(i, i // 2) for i in range(1, 64)],
}
rng = random.Random(4)
for k in range(4):
    CASES[f"random {k}"] = [(rng.randrange(60), rng.randrange(60)) for _ in range(25 + 10 * k)]


@pytest.mark.parametrize("name", list(CASES))
def test_groups_equal_union_find(spark, name):
    df = spark.createDataFrame(CASES[name], "a bigint, b bigint").withColumns({"group_id": F.lit("clash"), "u": F.lit(1), "m": F.lit(None).cast("string")})
    got = sorted((r["group_id"], r["vertex"]) for r in g.connected_groups(df, "a", "b").collect())
    assert got == components(CASES[name])


@pytest.mark.parametrize("step", [1, -1])
def test_links_stay_few_on_ordered_chains(spark, step):
    n = 2000
    df = spark.range(n).select((F.col("id") * step).alias("a"), ((F.col("id") + 1) * step).alias("b"))
    graph = g.both_ways(df.select(g.shuffled_id("a").alias("u"), g.shuffled_id("b").alias("v")))
    links, most = graph.count(), 0
    first = links
    while links:
        _, graph = g.prune(graph, links)
        links = graph.count()
        most = max(most, links)
    assert first == 2 * n and most <= first


def test_shuffled_ids_come_back(spark):
    edge = [0, 1, -1, 2**63 - 1, -2**63, 2**32, -2**32, 2**31, 7]
    df = spark.createDataFrame([(x,) for x in edge], "a bigint").select("a", g.shuffled_id("a").alias("s")).withColumn("back", g.plain_again("s"))
    rows = df.collect()
    assert all(r["a"] == r["back"] for r in rows) and len({r["s"] for r in rows}) == len(edge)


def test_a_hot_vertex_keeps_its_group(spark):
    pairs = [(7, i) for i in range(1000, 4000)] + [(i, i + 1) for i in range(1000, 1500)] + [(5, 6)]
    got = {r["vertex"]: r["group_id"] for r in g.connected_groups(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got[3999] == 7 and got[1200] == 7 and got[6] == 5 and len(got) == 3003


def test_no_links(spark):
    assert g.connected_groups(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_matches_ignore_nan_null_and_low_scores(spark):
    rows = [("1", "2", 0.99), ("2.mat", " 3", 0.98999), ("3", "4", float("nan")), ("5", "5.0", 1.0), (None, "6", 1.0), ("7", "8", None)]
    df = spark.createDataFrame(rows, "image_a string, image_b string, ncc_full double")
    got = g.connected_groups(g.image_matches(df), "image_a", "image_b").collect()
    assert sorted((r["group_id"], r["vertex"]) for r in got) == [(1, 1), (1, 2)]


@pytest.mark.parametrize("name", ["chain", "star", "random 3"])
def test_labels_equal_union_find(spark, name):
    pairs = [(a, 10_000 + i) for i, (a, b) in enumerate(CASES[name])] + [(b, 10_000 + i) for i, (a, b) in enumerate(CASES[name])]
    got = sorted((r["label"], r["record"]) for r in g.entity_labels(spark.createDataFrame(pairs, "r bigint, e bigint"), "r", "e").collect())
    single = {(x, x) for p in CASES[name] for x in p}
    want = dict((b, a) for a, b in components(CASES[name]))
    assert got == sorted((want.get(x, x), x) for x, _ in single)


def test_splits_keep_entities_and_shares(spark):
    rows = [(f"p{i}", f"e{i // 3}", i // 3 % 3, 1 + i % 7) for i in range(3000)] + [(f"big{i}", "hot", 1, 5) for i in range(900)]
    df = spark.createDataFrame(rows, "pid string, entity string, label int, w int")
    got = g.assign_splits(df, "entity", "label", "w", block=200).collect()
    split = {r["entity"]: r["split"] for r in got}
    assert len(got) == len(split) == 1001
    total, by = {}, {}
    for _, e, x, w in rows:
        total[x] = total.get(x, 0) + w
        by[split[e], x] = by.get((split[e], x), 0) + w
    for (s, x), w in by.items():
        assert abs(w / total[x] - g.SPLITS[s]) < 0.03


@pytest.mark.parametrize("w", [None, 0])
def test_splits_without_weights_count_records(spark, w):
    rows = [(f"p{i}", f"e{i}", i % 3, w) for i in range(3000)]
    got = g.assign_splits(spark.createDataFrame(rows, "pid string, entity string, label int, w int"), "entity", "label", "w", block=500).collect()
    assert len(got) == 3000
    for s, share in g.SPLITS.items():
        assert abs(sum(r["split"] == s for r in got) / 3000 - share) < 0.03


def test_splits_of_odd_records(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, -5), (None, 1, 3)], "entity string, label int, w int")
    assert [r["entity"] for r in g.assign_splits(df, "entity", "label", "w").collect()] == ["a"]
    assert g.assign_splits(df.where("false"), "entity", "label", "w").count() == 0


def test_balance_is_near_the_proportions(spark):
    rows = [(f"p{i}", f"e{i // 3}", i // 3 % 3, 1 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "pid string, entity string, label int, w int")
    split = g.assign_splits(df, "entity", "label", "w", block=300)
    by = df.join(split, "entity").groupBy("split", "label").agg(F.sum("w").alias("w")).collect()
    whole = {x: sum(r["w"] for r in by if r["label"] == x) for x in range(3)}
    assert all(abs(r["w"] / whole[r["label"]] - g.SPLITS[r["split"]]) < 0.01 for r in by) and len(by) == 9


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p3_group_sizes"])
def test_queries_equal_sql(agree, name):
    agree(q.queries()[name], q.oracle_sql()[name])
