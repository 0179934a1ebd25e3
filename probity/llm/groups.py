"""Consolidating pairwise matches into groups, and splits that keep related records together.

`connected_groups` (problem 3) prunes vertices into a propagation forest: in each round every vertex
connects its neighbourhood to the neighbourhood's minimum, vertices that are nobody's minimum drop out and
hang below the smallest minimum they were given, and the rest go on as a smaller graph. When no edge is
left, the remaining vertices are seeds (the smallest of their group) and their identifiers flow down the
forest, from the round pruned last to the first.

`entity_labels` and `assign_splits` (problem 2) spread minimum labels over the bipartite record-entity graph
and then assign whole entities to splits.

Defined cases: null ends and loops are no links; repeated links count once; an empty table gives an empty
result; a vertex without a link to another is in no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut, plain_id, plain_image_id, plain_stem, table
from ..functions.skew import lookup


# --- problem 3 -------------------------------------------------------------------------------------------

_HALF = (1 << 32) - 1


def _turn(half: F.Column, k: int) -> F.Column:
    return F.xxhash64(half, F.lit(k)).bitwiseAND(F.lit(_HALF))


def shuffled_id(col: str) -> F.Column:
    """A BIGINT put one to one on another, by three turns of its halves; the order of the results is that of a hash."""
    left, right = F.shiftrightunsigned(col, 32), F.col(col).bitwiseAND(F.lit(_HALF))
    for k in range(3):
        left, right = right, left.bitwiseXOR(_turn(right, k))
    return F.shiftleft(left, 32).bitwiseOR(right)


def plain_again(col: str) -> F.Column:
    """The BIGINT that shuffled_id put on this one."""
    left, right = F.shiftrightunsigned(col, 32), F.col(col).bitwiseAND(F.lit(_HALF))
    for k in (2, 1, 0):
        left, right = right.bitwiseXOR(_turn(left, k)), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def prune(graph: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """One round on the n links (u, v) of a graph: the vertices that drop out as (child, parent), and the graph that is left."""
    nearest = graph.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    given = cut(lookup(graph, nearest, "u", "n", n).select(F.col("v").alias("x"), "m").unionByName(nearest.select(F.col("u").alias("x"), "m")).distinct())
    least = given.groupBy("x").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("x")).alias("stays"), F.count("*").alias("n"))
    pruned = least.where("not stays").select(F.col("x").alias("child"), F.col("top").alias("parent"))
    left = lookup(given, least.select("x", "top", "n"), "x", "n", n).where("m != top").select(F.col("m").alias("u"), F.col("top").alias("v"))
    return pruned, cut(both_ways(left))


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, vertex): every vertex of a link with the smallest vertex it is linked to, directly or not.

    Minima are taken in a hashed order of the vertices (`shuffled_id`), so that chains whose ids rise along them are pruned as
    fast as any; the smallest id of each seed's group is looked up at the end. Work per round is a few equi-joins
    and grouped minima on the links that are left, with partial aggregation before and hot vertices apart from
    the shuffle; the number of rounds grows as the logarithm of the graph.
    """
    links = pairs.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null and a != b").select(
        shuffled_id("a").alias("u"), shuffled_id("b").alias("v"))
    graph = cut(both_ways(links))
    vertices, n, forest = graph.select("u").distinct(), graph.count(), []
    while n:
        pruned, graph = prune(graph, n)
        forest.append(pruned)
        n = graph.count()
    known = vertices.select(F.col("u").alias("x"), F.col("u").alias("seed")).where("false")
    for depth, pruned in enumerate(reversed(forest)):
        below = pruned.join(known.withColumnRenamed("x", "parent"), "parent", "left").select(F.col("child").alias("x"), F.coalesce("seed", "parent").alias("seed"))
        known = known.unionByName(below)
        if depth % 3 == 2:
            known = cut(known)
    member = cut(vertices.join(known.withColumnRenamed("x", "u"), "u", "left").select(F.coalesce("seed", "u").alias("seed"), plain_again("u").alias("vertex")))
    groups = member.groupBy("seed").agg(F.min("vertex").alias("group_id"), F.count("*").alias("n"))
    return lookup(member, groups, "seed", "n", member.count()).select("group_id", "vertex")


def image_matches(candidates: DataFrame, at_least: float = 0.99) -> DataFrame:
    """The rows of a candidate table that are matches: two different given images, ncc_full >= at_least."""
    return candidates.where((F.col("ncc_full") >= at_least) & ~F.isnan("ncc_full")).select(
        plain_image_id("image_a").alias("image_a"), plain_image_id("image_b").alias("image_b"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    groups = connected_groups(image_matches(table(spark, sf_dir, "near_duplicate_candidates")), "image_a", "image_b")
    return groups.withColumnRenamed("vertex", "image_id")


def p3_group_sizes(spark, sf_dir: str) -> DataFrame:
    """How many groups have how many images."""
    sizes = p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_images"))
    return sizes.groupBy("n_images").agg(F.count("*").alias("n_groups"))


# --- problem 2 -------------------------------------------------------------------------------------------

def entity_labels(edges: DataFrame, record: str, entity: str) -> DataFrame:
    """(record, label): the smallest record that shares entities with it, directly or through others.

    Minimum labels pass from records to their entities and back until none changes. Each round also takes
    the label of the label, so that long chains close in a logarithmic number of rounds.
    """
    edges = cut(edges.select(F.col(record).alias("r"), F.col(entity).alias("e")).where("r is not null and e is not null").distinct())
    n = edges.count()
    labels = edges.groupBy("r").agg(F.count("*").alias("n")).select("r", F.col("r").alias("l"), "n")
    while True:
        of_entity = lookup(edges, labels, "r", "n", n).groupBy("e").agg(F.min("l").alias("l"), F.count("*").alias("n"))
        spread = lookup(edges, of_entity, "e", "n", n).groupBy("r").agg(F.min("l").alias("best"), F.count("*").alias("n"))
        now = cut(spread.join(labels.select("r", "l"), "r"))
        # the label of the label, once for each label
        far = now.groupBy("best").agg(F.count("*").alias("m")).join(labels.select(F.col("r").alias("best"), F.col("l").alias("far")), "best")
        moved = cut(lookup(now, far, "best", "m", n).select("r", F.least("best", "far").alias("l"), "n", (F.least("best", "far") != F.col("l")).alias("moved")))
        labels = moved.select("r", "l", "n")
        if moved.where("moved").isEmpty():
            return labels.select(F.col("r").alias("record"), F.col("l").alias("label"))


def _patients(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mapping, held = table(spark, sf_dir, "proposed_pid_to_stem_mapping"), table(spark, sf_dir, "fixed_test_fold4")
    mapping = mapping.withColumns({"pid": plain_id("patient_id"), "plain": plain_stem(F.col("stem"), F.col("patient_id"))})
    edges = mapping.select("pid", F.concat(F.lit("stem "), "plain").alias("entity")).unionByName(
        held.select(plain_id("patient_id").alias("pid"), F.concat(F.lit("image "), F.col("image_id").cast("string")).alias("entity")))
    return mapping, edges


def p2_found(spark, sf_dir: str) -> DataFrame:
    mapping, edges = _patients(spark, sf_dir)
    labels = entity_labels(edges, "pid", "entity").withColumnRenamed("record", "pid")
    folds = cut(mapping.where("fold_minmove is not null and pid is not null").select("pid", "fold_minmove").distinct().join(labels, "pid"))
    torn = folds.groupBy("label").agg(F.min("fold_minmove").alias("lo"), F.max("fold_minmove").alias("hi")).where("lo < hi").select("label")
    torn_folds = folds.join(torn, "label", "left_semi").select("pid", "fold_minmove", "label")
    left, right = torn_folds.toDF("patient_a", "fold_a", "label"), torn_folds.toDF("patient_b", "fold_b", "label")
    return left.join(right, "label").where("patient_a < patient_b and fold_a != fold_b").select("patient_a", "patient_b").distinct()


SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def assign_splits(records: DataFrame, entity: str, label: str, weight: str, shares: dict[str, float] = SPLITS, block: int = 2000, hot: float = 0.01) -> DataFrame:
    """(entity, split): whole entities assigned so that each label's weight is shared as given.

    Entities are reduced to one weight per label. Those that hold `hot` of all weight or more (at most
    1/hot of them) are placed first, largest first, each where the labels' deviation from the shares stays
    least. The others are placed in the same way within hashed blocks of about `block` entities, against
    the shares that the hot ones left; blocks are independent tasks of bounded size.
    Null labels count as a label of their own; weights that are null or below 0 count 0; where no weight is above 0, every record counts 1.
    """
    names = list(shares)
    per = cut(records.select(
        F.col(entity).cast("string").alias("entity"), F.coalesce(F.col(label).cast("string"), F.lit("-")).alias("label"),
        F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"),
    ).where("entity is not null").groupBy("entity", "label").agg(F.sum("w").alias("w"), F.count("*").cast("double").alias("records")))
    whole = per.agg(F.sum("w").alias("w"), F.sum("records").alias("records"), F.count("*").alias("n"), F.countDistinct("entity").alias("entities")).first()
    if not whole["w"]:
        per = per.withColumn("w", F.col("records"))
    all_w, blocks = whole["w"] or whole["records"] or 0.0, max(1, -(-whole["entities"] // block))
    goals = [f"goal_{i}" for i in range(len(names))]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="entity", columns="label", values="w", aggfunc="sum", fill_value=0.0)
        order = sorted(range(len(wide)), key=lambda i: (-wide.iloc[i].sum(), wide.index[i]))
        m = wide.to_numpy()
        scale = np.maximum(m.sum(axis=0), 1e-9)
        goal = pdf.groupby("label")[goals].first().loc[wide.columns].to_numpy().T * scale
        have, out = np.zeros_like(goal), []
        for i in order:
            after = (((have + m[i] - goal) / scale) ** 2 - ((have - goal) / scale) ** 2).sum(axis=1)
            k = int(np.argmin(after))
            have[k] += m[i]
            out.append((wide.index[i], names[k]))
        return pd.DataFrame(out, columns=["entity", "split"])

    def placed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block").applyInPandas(place, "entity string, split string")

    sized = cut(per.join(per.groupBy("entity").agg(F.sum("w").alias("size")), "entity"))
    big = sized.where(F.col("size") >= hot * all_w).withColumns({"block": F.lit(0), **{g: F.lit(shares[s]) for g, s in zip(goals, names)}})
    first = cut(placed(big))
    # what each label's hot entities left of the shares, one row a label
    taken = big.join(first, "entity").groupBy("label").agg(*(F.sum(F.when(F.col("split") == s, F.col("w")).otherwise(0.0)).alias(f"taken_{i}") for i, s in enumerate(names)))
    left = per.groupBy("label").agg(F.sum("w").alias("w"), F.count("*").alias("n")).join(taken, "label", "left")
    left = left.select("label", "n", *(F.greatest(F.lit(0.0), F.lit(shares[s]) * F.col("w") - F.coalesce(f"taken_{i}", F.lit(0.0))).alias(f"rest_{i}") for i, s in enumerate(names)))
    rest = sum((F.col(f"rest_{i}") for i in range(len(names))), F.lit(0.0))
    left = cut(left.select("label", "n", *(F.coalesce(F.try_divide(F.col(f"rest_{i}"), rest), F.lit(shares[s])).alias(g) for i, (g, s) in enumerate(zip(goals, names)))))
    small = sized.where(F.col("size") < hot * all_w).withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)))
    return first.unionByName(placed(lookup(small, left, "label", "n", whole["n"])))


def _split_records(spark, sf_dir: str) -> DataFrame:
    mapping, edges = _patients(spark, sf_dir)
    labels = cut(entity_labels(edges, "pid", "entity").toDF("pid", "entity"))
    held = table(spark, sf_dir, "fixed_test_fold4").select(plain_id("patient_id").alias("pid"), "image_id", "label")
    seen = mapping.select("pid", F.col("n_images").cast("bigint").alias("n"), "label").unionByName(
        held.groupBy("pid").agg(F.countDistinct("image_id").alias("n"), F.min("label").alias("label")))
    per_id = seen.where("pid is not null").groupBy("pid").agg(F.max("n").alias("n_images"), F.min("label").alias("label"))
    return per_id.join(labels, "pid", "left").withColumn("entity", F.coalesce("entity", "pid"))


def p2_splits(spark, sf_dir: str) -> DataFrame:
    """(patient_id, entity, label, n_images, split): the new splits; no entity is in two of them."""
    records = cut(_split_records(spark, sf_dir))
    return records.join(assign_splits(records, "entity", "label", "n_images"), "entity").select(
        F.col("pid").alias("patient_id"), "entity", "label", "n_images", "split")


def p2_balance(spark, sf_dir: str) -> DataFrame:
    """(split, label, n_patients, n_images, share, deviation): what each split holds of each label's images, and how far that is from its proportion."""
    by = p2_splits(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n_patients"), F.sum("n_images").alias("n_images"))
    whole = F.sum("n_images").over(Window.partitionBy("label"))
    goal = F.coalesce(*(F.when(F.col("split") == s, F.lit(x)) for s, x in SPLITS.items()))
    return by.withColumn("share", F.round(F.try_divide(F.col("n_images").cast("double"), whole), 6)).withColumn("deviation", F.round(F.col("share") - goal, 6))
