"""Splits and leakage: composition of folds, exposure of test rows to their own cluster, identity rules.

The frames come from image_manifest (one row an image after `images`), the id mapping and the stem table.
Counts over a cluster are made by aggregating and joining back, never by a window over a whole cluster, so a
cluster with a tenth of all rows is no burden to one task. Nulls: images without a patient or fold are in no
exposure table; a patient without a fold is in no fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_bin, div, id_format, loose_stem, share_bin, strict_stem
from ..functions.ranks import GRID, quantile_name, quantiles
from ..functions.session import plain_id, plain_stem, table
from ..plans import fixtures as fx
from .metrics import rounded

FOLDS, LABELS = (1, 2, 3, 4, 5), (1, 2, 3)


def images(spark, d) -> DataFrame:
    """One row a readable image: image_id, patient_id and label_name plainly written, label, fold, shape, dtype and hashes."""
    rows = table(spark, d, "image_manifest").where("readable and image_id is not null")
    return rows.groupBy("image_id").agg(
        F.min(plain_id("patient_id")).alias("patient_id"), F.min("label").alias("label"), F.min(F.lower(F.trim("label_name"))).alias("label_name"), F.min("fold").alias("fold"),
        *(F.min(c).alias(c) for c in ("shape", "dtype", "px_min", "px_max", "raw_array_hash", "canonical_image_hash", "display_hash")))


def fold_class_matrix(df: DataFrame, fold: str, label: str) -> DataFrame:
    """fold, label_1..3: counts over the fixed folds and labels, 0 where there are none."""
    counts = df.groupBy(F.col(fold).alias("fold")).pivot(label, list(LABELS)).agg(F.count(F.lit(1)))
    domain = df.sparkSession.createDataFrame([(f,) for f in FOLDS], "fold int")
    return domain.join(counts, "fold", "left").select("fold", *(F.coalesce(F.col(str(x)), F.lit(0)).alias(f"label_{x}") for x in LABELS))


def exposure_table(df: DataFrame, row: str, cluster: str, fold: str) -> DataFrame:
    """row, cluster, fold and how many other rows of the cluster there are, in all and in training (another fold)."""
    known = df.where(F.col(cluster).isNotNull() & F.col(fold).isNotNull()).select(row, cluster, fold)
    per_fold = known.groupBy(cluster, fold).agg(F.count("*").alias("n_here"))
    per = per_fold.groupBy(cluster).agg(F.sum("n_here").alias("n_all"))
    joined = known.join(per_fold.join(per, cluster), [cluster, fold])
    total, train = F.col("n_all") - 1, F.col("n_all") - F.col("n_here")
    return joined.select(row, cluster, fold, total.alias("n_other_total"), train.alias("n_other_train"), div(train, total).alias("frac_other_train"),
                         (total == 0).alias("single_slice_patient"), (train > 0).alias("has_same_patient_train_slice"))


def overlap_stats(df: DataFrame, cluster: str, fold: str) -> DataFrame:
    """fold, test_rows, test_clusters, also_in_train: clusters of a fold that other folds hold too."""
    per = df.where(F.col(cluster).isNotNull() & F.col(fold).isNotNull()).groupBy(cluster, F.col(fold).alias("fold")).agg(F.count("*").alias("n"))
    spans = per.groupBy(cluster).agg(F.count("*").alias("k"))
    return per.join(spans, cluster).groupBy("fold").agg(F.sum("n").alias("test_rows"), F.count("*").alias("test_clusters"), F.count_if(F.col("k") > 1).alias("also_in_train"))


def stem_exposed(df: DataFrame, row: str, pid: str, stem: str, fold: str) -> DataFrame:
    """row, exposed: another id of the same stem lies in another fold."""
    known = df.select(stem, pid, fold).where(F.col(stem).isNotNull() & F.col(pid).isNotNull() & F.col(fold).isNotNull()).distinct()
    # of a stem's different (id, fold), those with neither this id nor this fold
    every, of_id, of_fold = (known.groupBy(*k).agg(F.count("*").alias(n)) for k, n in (([stem], "_every"), ([stem, pid], "_id"), ([stem, fold], "_fold")))
    hit = known.join(every, stem).join(of_id, [stem, pid]).join(of_fold, [stem, fold]).where("_every - _id - _fold + 1 > 0").select(stem, pid, fold, F.lit(True).alias("exposed"))
    return df.join(hit, [stem, pid, fold], "left").select(row, pid, stem, fold, F.coalesce("exposed", F.lit(False)).alias("exposed"))


def mapping(spark, d) -> DataFrame:
    """One row a patient id of the mapping: patient_id, stem (smallest), n_images, label, both folds."""
    rows = table(spark, d, "proposed_pid_to_stem_mapping").withColumns({"pid": plain_id("patient_id"), "s": plain_stem(F.col("stem"), F.col("patient_id"))})
    return rows.where("pid is not null").groupBy(F.col("pid").alias("patient_id")).agg(
        F.min("s").alias("stem"), F.max("n_images").alias("n_images"), F.min("label").alias("label"), F.min("fold_original").alias("fold_original"), F.min("fold_minmove").alias("fold_minmove"),
        F.bool_or("merged_with_other_pid").alias("merged_flag"), F.bool_or("moved_by_minmove").alias("moved_flag"))


# --- queries ------------------------------------------------------------------------------------------------------

def q_inventory(spark, d):
    """What there is: images by label, shape, dtype, fold; long."""
    im = images(spark, d)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for k, c in (("label", "label_name"), ("shape", "shape"), ("dtype", "dtype"), ("fold", "fold")))))
    return im.select(kinds.alias("x"), "patient_id").groupBy("x.kind", "x.value").agg(F.count("*").alias("n_images"), F.countDistinct("patient_id").alias("n_patients"))


def q_patient_sizes(spark, d):
    """How many images a patient has: smallest, median, largest, mean, by label."""
    per = images(spark, d).where("patient_id is not null").groupBy("patient_id").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return rounded(per.groupBy("label").agg(F.count("*").alias("n_patients"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.avg("n").alias("mean")), "median", "mean")


def q_fold_class(spark, d):
    return fold_class_matrix(images(spark, d), "fold", "label")


def q_fold_violations(spark, d):
    """Patients in more than one fold or under more than one label."""
    per = images(spark, d).where("patient_id is not null").groupBy("patient_id").agg(
        F.array_join(F.array_sort(F.collect_set("fold").cast("array<string>")), "|").alias("folds"), F.array_join(F.array_sort(F.collect_set("label").cast("array<string>")), "|").alias("labels"),
        F.countDistinct("fold").alias("n_folds"), F.countDistinct("label").alias("n_labels"))
    return per.where("n_folds > 1 or n_labels > 1")


def q_exposure(spark, d):
    split = fx.row_folds(fx.units(spark, d))
    return rounded(exposure_table(split, "unit_id", "cluster_id", "fold_b").withColumnRenamed("fold_b", "fold"), "frac_other_train")


def q_exposure_levels(spark, d):
    """Images by how many and what share of their patient's other images are in training."""
    x = exposure_table(images(spark, d), "image_id", "patient_id", "fold")
    return x.groupBy(count_bin("n_other_train").alias("count_level"), share_bin("frac_other_train").alias("share_level")).agg(F.count("*").alias("n"), F.countDistinct("patient_id").alias("n_patients"))


def q_image_exposure(spark, d):
    return rounded(exposure_table(images(spark, d), "image_id", "patient_id", "fold"), "frac_other_train")


def q_overlap(spark, d):
    """Overlap of test and training clusters by fold, under both protocols."""
    split = fx.row_folds(fx.units(spark, d))
    return overlap_stats(split, "cluster_id", "fold_a").withColumn("arm", F.lit("A")).unionByName(overlap_stats(split, "cluster_id", "fold_b").withColumn("arm", F.lit("B")))


def q_exposure_distribution(spark, d):
    """Quantiles of the exposure columns by class."""
    ex = exposure_table(fx.row_folds(fx.units(spark, d)).select("unit_id", "cluster_id", "fold_b"), "unit_id", "cluster_id", "fold_b").join(fx.units(spark, d).select("unit_id", "true_class"), "unit_id")
    long = ex.select("true_class", F.explode(F.array(F.struct(F.lit("n_other_train").alias("measure"), F.col("n_other_train").cast("double").alias("v")), F.struct(F.lit("frac_other_train").alias("measure"), F.col("frac_other_train").alias("v")))).alias("x")).select("true_class", "x.*")
    return rounded(quantiles(long, ["true_class", "measure"], "v", GRID), "least", *(quantile_name(q) for q in GRID), "most")


def q_row_folds(spark, d):
    return fx.row_folds(fx.units(spark, d)).select("unit_id", "fold_a", "fold_b")


def q_expected_same_fold(spark, d):
    """The expected number of rows whose two folds agree: sum of t^2 / n_c; and the share."""
    t = fx.units(spark, d).groupBy("true_class", "fold_a").agg(F.count("*").alias("t"))
    of = t.groupBy("true_class").agg(F.sum("t").alias("n_c"))
    return rounded(t.join(of, "true_class").agg(F.sum(F.col("t") * F.col("t") / F.col("n_c")).alias("expected"), div(F.sum(F.col("t") * F.col("t") / F.col("n_c")), F.sum("t")).alias("share")), "expected", "share")


def q_split_checks(spark, d):
    """Named checks of both splits, each true or false."""
    split = fx.row_folds(fx.units(spark, d))
    one = split.agg(
        (F.count("*") == F.countDistinct("unit_id")).alias("ids_unique"), F.bool_and(F.col("fold_a").between(1, 5)).alias("folds_a_valid"), F.bool_and(F.col("fold_b").between(1, 5)).alias("folds_b_valid"),
        F.bool_and(F.col("fold_b").isNotNull()).alias("all_assigned"))
    a = split.groupBy("cluster_id").agg(F.countDistinct("fold_a").alias("ka"), F.countDistinct("fold_b").alias("kb")).agg(F.bool_and(F.col("ka") == 1).alias("a_keeps_clusters"), F.bool_or(F.col("kb") > 1).alias("b_parts_clusters"))
    ma = split.groupBy("true_class", F.col("fold_a").alias("fold")).agg(F.count("*").alias("na"))
    mb = split.groupBy("true_class", F.col("fold_b").alias("fold")).agg(F.count("*").alias("nb"))
    margins = ma.join(mb, ["true_class", "fold"], "full").agg(F.bool_and(F.coalesce(F.col("na") == F.col("nb"), F.lit(False))).alias("margins_equal"))
    wide = one.join(F.broadcast(a)).join(F.broadcast(margins))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.when(F.col(c), "PASS").otherwise("FAIL").alias("status")) for c in wide.columns))).alias("x")).select("x.*")


def q_stem_groups(spark, d):
    """Stems with more than one id: members, images, folds, whether they span folds."""
    return mapping(spark, d).groupBy("stem").agg(
        F.count("*").alias("n_ids"), F.sum("n_images").alias("n_images"), F.array_join(F.array_sort(F.collect_set("patient_id")), "|").alias("raw_pids"),
        F.array_join(F.array_sort(F.collect_set("fold_original").cast("array<string>")), "|").alias("folds"), (F.countDistinct("fold_original") > 1).alias("spans_folds")).where("n_ids > 1 and stem is not null")


def q_stem_exposure(spark, d):
    units = fx.row_folds(fx.units(spark, d)).withColumn("stem", strict_stem("pid"))
    a = stem_exposed(units.withColumnRenamed("fold_a", "fold").select("unit_id", "pid", "stem", "fold"), "unit_id", "pid", "stem", "fold")
    return a.groupBy("stem").agg(F.count("*").alias("n"), F.count_if("exposed").alias("n_exposed"))


def q_identity_comparison(spark, d):
    """Raw ids and stems as identities: how many, sharing, spanning, rows in spanning groups."""
    units = fx.units(spark, d)
    out = None
    for name, ident in (("raw", F.col("pid")), ("strict stem", strict_stem("pid")), ("loose stem", loose_stem("pid"))):
        per = units.groupBy(ident.alias("g")).agg(F.count("*").alias("n"), F.countDistinct("pid").alias("ids"), F.countDistinct("fold_a").alias("folds"))
        one = per.agg(F.count("*").alias("n_groups"), F.count_if(F.col("ids") > 1).alias("n_shared"), F.count_if(F.col("folds") > 1).alias("n_spanning"), F.coalesce(F.sum(F.when(F.col("folds") > 1, F.col("n"))), F.lit(0)).alias("rows_spanning")).withColumn("identity", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def q_id_formats(spark, d):
    ids = images(spark, d).where("patient_id is not null").select("patient_id").distinct()
    return ids.groupBy(id_format("patient_id").alias("format")).agg(F.count("*").alias("n_ids"), F.countDistinct(strict_stem("patient_id")).alias("n_strict"), F.countDistinct(loose_stem("patient_id")).alias("n_loose"))


def q_mapping_flags(spark, d):
    """Ids whose flags in the mapping disagree with what the mapping itself says."""
    mp = mapping(spark, d)
    size = mp.where("stem is not null").groupBy("stem").agg((F.count("*") > 1).alias("merged"))
    x = mp.join(size, "stem").withColumn("moved", F.col("fold_original") != F.col("fold_minmove"))
    return x.where("merged_flag != merged or moved_flag != moved").select("patient_id", "stem", "merged_flag", "merged", "moved_flag", "moved")


def q_group_integrity(spark, d):
    """Entities in more than one fold under either fold column of the mapping."""
    mp, out = mapping(spark, d), None
    for key in ("patient_id", "stem"):
        for fold in ("fold_original", "fold_minmove"):
            one = mp.where(f"{key} is not null").groupBy(key).agg(F.countDistinct(fold).alias("k")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_spanning")).select(F.lit(key).alias("group"), F.lit(fold).alias("fold_column"), "n_groups", "n_spanning")
            out = one if out is None else out.unionByName(one)
    return out


def q_stem_table_check(spark, d):
    """Rows of stem_table whose counts or spans_folds are not what the images say."""
    im = images(spark, d).withColumn("stem", strict_stem("patient_id")).where("stem is not null")
    now = im.groupBy("stem").agg(F.count("*").alias("n_now"), F.countDistinct("patient_id").alias("ids_now"), (F.countDistinct("fold") > 1).alias("spans_now"))
    was = table(spark, d, "stem_table").withColumn("stem", plain_id("stem")).where("stem is not null").groupBy("stem").agg(F.max("n_images").alias("n_images"), F.max("n_raw_pids").alias("n_raw_pids"), F.max("spans_folds").alias("spans_folds"))
    x = was.join(now, "stem", "left")
    return x.select("stem", "n_images", "n_now", "n_raw_pids", "ids_now", "spans_folds", "spans_now", F.coalesce((F.col("n_images") == F.col("n_now")) & (F.col("n_raw_pids") == F.col("ids_now")) & (F.col("spans_folds") == F.col("spans_now")), F.lit(False)).alias("ok"))


def q_split_field_count(spark, d):
    """Lists joined by | as arrays: ids and folds counted in the string against the recorded numbers."""
    s = table(spark, d, "stem_table")
    n = lambda c: F.size(F.split(F.col(c), r"[|]"))
    return s.select(plain_id("stem").alias("stem"), n("raw_pids").alias("ids_listed"), n("folds").alias("folds_listed"), F.col("n_raw_pids").cast("int").alias("n_raw_pids"), F.contains("raw_pids", F.lit("MR")).alias("has_mr")).where("stem is not null and raw_pids is not null").groupBy("ids_listed", "folds_listed", "has_mr").agg(F.count("*").alias("n"), F.count_if(F.col("ids_listed") != F.col("n_raw_pids")).alias("n_wrong"))


def q_min_move(spark, d):
    """(patient_id, stem, fold_before, fold_after): stems that span folds go whole to one of their own folds.

    A stem takes the fold, among those it has, in which it has most images (then the lowest): the fewest rows
    move. Fold and class margins are reported by min_move_margins, not forced, so no stem waits for another.
    """
    mp = mapping(spark, d).where("stem is not null and fold_original is not null")
    per = mp.groupBy("stem", "fold_original").agg(F.sum(F.coalesce("n_images", F.lit(0))).alias("n"))
    best = per.groupBy("stem").agg(F.max_by("fold_original", F.struct("n", -F.col("fold_original"))).alias("fold_after"))
    return mp.join(best, "stem").select("patient_id", "stem", F.col("fold_original").alias("fold_before"), "fold_after")


def q_min_move_margins(spark, d):
    """fold, label, images before and after the move."""
    moved = q_min_move(spark, d).join(mapping(spark, d).select("patient_id", "n_images", "label"), "patient_id")
    long = moved.select("label", "n_images", F.explode(F.array(F.struct(F.lit("before").alias("when"), F.col("fold_before").alias("fold")), F.struct(F.lit("after").alias("when"), F.col("fold_after").alias("fold")))).alias("x")).select("label", "n_images", "x.*")
    return long.groupBy("fold", "label").agg(F.coalesce(F.sum(F.when(F.col("when") == "before", F.col("n_images"))), F.lit(0)).alias("n_before"), F.coalesce(F.sum(F.when(F.col("when") == "after", F.col("n_images"))), F.lit(0)).alias("n_after"))


def rebalanced_moves(ids: DataFrame, block: int = 5000) -> DataFrame:
    """(stem, fold_after): stems that span folds, largest first, each to the one of its folds that keeps the
    fold's images of the stem's label nearest to what they were (then the lowest fold).

    Only the stem's own label counts in that choice, so labels are independent; the spanning stems of a label
    are parted into hashed blocks of about `block`, each with its share of the targets.
    """
    per = ids.where("stem is not null and fold_original is not null and label is not null").groupBy("stem", "label", F.col("fold_original").alias("fold")).agg(F.sum(F.coalesce("n_images", F.lit(0))).alias("n"))
    spans = per.groupBy("stem").agg((F.count("*") > 1).alias("spans"), F.min("label").alias("label"))
    x = per.drop("label").join(spans, "stem")
    n = x.where("spans").agg(F.countDistinct("stem")).first()[0]
    blocks = max(1, -(-n // block))
    moving = x.where("spans").withColumn("block", F.pmod(F.xxhash64("stem"), F.lit(blocks)))

    def place(pdf):
        # what leaves a fold is what it must get back: targets minus the stems that stay
        room = pdf.groupby("fold")["n"].sum().to_dict()
        stems = sorted(pdf.groupby("stem"), key=lambda g: (-g[1]["n"].sum(), g[0]))
        have, out = dict.fromkeys(room, 0), []
        for stem, rows in stems:
            size = rows["n"].sum()
            best = min(sorted(rows["fold"]), key=lambda f: ((have[f] + size - room[f]) ** 2 - (have[f] - room[f]) ** 2, f))
            have[best] += size
            out.append((stem, int(best)))
        return pd.DataFrame(out, columns=["stem", "fold_after"])

    return moving.groupBy("label", "block").applyInPandas(place, "stem string, fold_after int")


def q_rebalanced_moves(spark, d):
    return rebalanced_moves(mapping(spark, d))


def queries() -> dict:
    return {
        "rebalanced_moves": q_rebalanced_moves,
        "inventory": q_inventory, "patient_sizes": q_patient_sizes, "fold_class": q_fold_class, "fold_violations": q_fold_violations, "exposure": q_exposure, "exposure_levels": q_exposure_levels, "image_exposure": q_image_exposure,
        "overlap": q_overlap, "exposure_distribution": q_exposure_distribution, "row_folds": q_row_folds, "expected_same_fold": q_expected_same_fold, "split_checks": q_split_checks,
        "stem_groups": q_stem_groups, "stem_exposure": q_stem_exposure, "identity_comparison": q_identity_comparison, "id_formats": q_id_formats, "mapping_flags": q_mapping_flags,
        "group_integrity": q_group_integrity, "stem_table_check": q_stem_table_check, "split_field_count": q_split_field_count, "min_move": q_min_move, "min_move_margins": q_min_move_margins,
    }


# --- the same in SQL ------------------------------------------------------------------------------------------------

def pid_sql(c: str) -> str:
    bare = rf"upper(regexp_replace({c}, '[\s\-]', '', 'g'))"
    return rf"nullif(CASE WHEN regexp_full_match({bare}, '[0-9]+') THEN regexp_replace({bare}, '^0+([0-9])', '\1') ELSE {bare} END, '')"


def strict_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^(MR[0-9]{{6}})[A-Z]$', '\1')"


def loose_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'MR%' THEN regexp_replace({c}, '[A-Za-z]+$', '') ELSE {c} END"


IMAGES_SQL = f"""im AS (SELECT image_id, min({pid_sql('patient_id')}) AS patient_id, min(label) AS label, min(lower(trim(label_name))) AS label_name, min(fold) AS fold, min(shape) AS shape, min(dtype) AS dtype,
  min(px_min) AS px_min, min(px_max) AS px_max, min(raw_array_hash) AS raw_array_hash, min(canonical_image_hash) AS canonical_image_hash, min(display_hash) AS display_hash
  FROM image_manifest WHERE readable AND image_id IS NOT NULL GROUP BY image_id)"""
MAPPING_SQL = f"""mp AS (SELECT {pid_sql('patient_id')} AS patient_id, min({strict_sql(f"coalesce({pid_sql('stem')}, {pid_sql('patient_id')})")}) AS stem, max(n_images) AS n_images, min(label) AS label, min(fold_original) AS fold_original,
  min(fold_minmove) AS fold_minmove, bool_or(merged_with_other_pid) AS merged_flag, bool_or(moved_by_minmove) AS moved_flag FROM proposed_pid_to_stem_mapping GROUP BY 1 HAVING {pid_sql('patient_id')} IS NOT NULL)""".replace(f" HAVING {pid_sql('patient_id')} IS NOT NULL", "")
_MP = f"WITH {MAPPING_SQL.replace('mp AS', 'mp0 AS', 1)}, mp AS (SELECT * FROM mp0 WHERE patient_id IS NOT NULL)"
_SPLIT = f"WITH {fx.UNIT_SQL}, {fx.FOLD_B_SQL}"
_IM = f"WITH {IMAGES_SQL}"


def exposure_sql(source, row, cluster, fold):
    return f"""SELECT {row}, {cluster}, {fold} AS fold, count(*) OVER (PARTITION BY {cluster}) - 1 AS n_other_total, count(*) OVER (PARTITION BY {cluster}) - count(*) OVER (PARTITION BY {cluster}, {fold}) AS n_other_train
  FROM {source} WHERE {cluster} IS NOT NULL AND {fold} IS NOT NULL"""


_EXPO_COLS = "round(n_other_train::DOUBLE / nullif(n_other_total, 0), 6) + 0.0::DOUBLE AS frac_other_train, n_other_total = 0 AS single_slice_patient, n_other_train > 0 AS has_same_patient_train_slice"


def _overlap(fold, arm):
    return f"SELECT fold, sum(n)::BIGINT AS test_rows, count(*) AS test_clusters, count(*) FILTER (k > 1) AS also_in_train, '{arm}' AS arm FROM (SELECT cluster_id, {fold} AS fold, count(*) AS n, count(*) OVER (PARTITION BY cluster_id) AS k FROM split GROUP BY 1, 2) GROUP BY fold"


def _sets(c):
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}::VARCHAR) FILTER ({c} IS NOT NULL)), '|'), '')"


def oracle_sql() -> dict[str, str]:
    def ident(name, x):
        return f"SELECT '{name}' AS identity, count(*) AS n_groups, count(*) FILTER (ids > 1) AS n_shared, count(*) FILTER (folds > 1) AS n_spanning, coalesce(sum(n) FILTER (folds > 1), 0)::BIGINT AS rows_spanning FROM (SELECT {x} AS g, count(*) AS n, count(DISTINCT pid) AS ids, count(DISTINCT fold_a) AS folds FROM unit GROUP BY 1)"

    quant = ", ".join(f"round(quantile_cont(v, {q}), 6) + 0.0::DOUBLE AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    integrity = " UNION ALL ".join(f"SELECT '{k}' AS \"group\", '{f}' AS fold_column, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_spanning FROM (SELECT count(DISTINCT {f}) AS k FROM mp WHERE {k} IS NOT NULL GROUP BY {k})" for k in ("patient_id", "stem") for f in ("fold_original", "fold_minmove"))
    move = f"""{_MP}, t AS (SELECT * FROM mp WHERE stem IS NOT NULL AND fold_original IS NOT NULL), p AS (SELECT stem, fold_original AS f, sum(coalesce(n_images, 0)) AS n FROM t GROUP BY ALL),
b AS (SELECT stem, f AS fold_after FROM p QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, f) = 1), mv AS (SELECT patient_id, stem, fold_original AS fold_before, fold_after FROM t JOIN b USING (stem))"""
    return {
        "inventory": f"""{_IM}, l AS (SELECT 'label' AS kind, coalesce(label_name, '-') AS value, patient_id FROM im UNION ALL SELECT 'shape', coalesce(shape, '-'), patient_id FROM im UNION ALL SELECT 'dtype', coalesce(dtype, '-'), patient_id FROM im UNION ALL SELECT 'fold', coalesce(fold::VARCHAR, '-'), patient_id FROM im)
SELECT kind, value, count(*) AS n_images, count(DISTINCT patient_id) AS n_patients FROM l GROUP BY ALL""",
        "patient_sizes": f"{_IM}, p AS (SELECT patient_id, count(*) AS n, min(label) AS label FROM im WHERE patient_id IS NOT NULL GROUP BY 1) SELECT label, count(*) AS n_patients, min(n) AS least, round(quantile_cont(n, 0.5), 6) + 0.0::DOUBLE AS median, max(n) AS most, round(avg(n), 6) + 0.0::DOUBLE AS mean FROM p GROUP BY label",
        "fold_class": f"{_IM} SELECT f.f::INT AS fold, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2, count(*) FILTER (label = 3) AS label_3 FROM range(1, 6) f(f) LEFT JOIN im ON im.fold = f.f GROUP BY 1",
        "fold_violations": f"{_IM} SELECT patient_id, {_sets('fold')} AS folds, {_sets('label')} AS labels, count(DISTINCT fold) AS n_folds, count(DISTINCT label) AS n_labels FROM im WHERE patient_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fold) > 1 OR count(DISTINCT label) > 1",
        "exposure": f"{_SPLIT} SELECT *, {_EXPO_COLS} FROM ({exposure_sql('split', 'unit_id', 'cluster_id', 'fold_b')})",
        "exposure_levels": f"""{_IM}, x AS (SELECT *, n_other_train::DOUBLE / nullif(n_other_total, 0) AS f FROM ({exposure_sql('im', 'image_id', 'patient_id', 'fold')})) SELECT CASE WHEN n_other_train = 0 THEN '0' WHEN n_other_train <= 9 THEN '1-9' WHEN n_other_train <= 13 THEN '10-13' WHEN n_other_train <= 17 THEN '14-17' ELSE '18+' END AS count_level,
  CASE WHEN f IS NULL THEN 'NA' WHEN f = 0 THEN '0' WHEN f <= 0.65 THEN '(0,0.65]' WHEN f <= 0.8 THEN '(0.65,0.8]' WHEN f <= 0.9 THEN '(0.8,0.9]' ELSE '(0.9,1]' END AS share_level, count(*) AS n, count(DISTINCT patient_id) AS n_patients FROM x GROUP BY ALL""",
        "image_exposure": f"{_IM} SELECT *, {_EXPO_COLS} FROM ({exposure_sql('im', 'image_id', 'patient_id', 'fold')})",
        "overlap": f"{_SPLIT} {_overlap('fold_a', 'A')} UNION ALL {_overlap('fold_b', 'B')}",
        "exposure_distribution": f"""{_SPLIT}, e AS (SELECT x.*, u.true_class FROM ({exposure_sql('split', 'unit_id', 'cluster_id', 'fold_b')}) x JOIN unit u USING (unit_id)),
l AS (SELECT true_class, 'n_other_train' AS measure, n_other_train::DOUBLE AS v FROM e UNION ALL SELECT true_class, 'frac_other_train', n_other_train::DOUBLE / nullif(n_other_total, 0) FROM e)
SELECT true_class, measure, count(v) AS n, round(min(v), 6) + 0.0::DOUBLE AS least, {quant}, round(max(v), 6) + 0.0::DOUBLE AS most FROM l GROUP BY ALL""",
        "row_folds": f"{_SPLIT} SELECT unit_id, fold_a, fold_b FROM split",
        "expected_same_fold": f"WITH {fx.UNIT_SQL}, t AS (SELECT true_class, fold_a, count(*)::DOUBLE AS t FROM unit GROUP BY ALL), c AS (SELECT t, sum(t) OVER (PARTITION BY true_class) AS n_c FROM t) SELECT round(sum(t * t / n_c), 6) + 0.0::DOUBLE AS expected, round(sum(t * t / n_c) / sum(t), 6) + 0.0::DOUBLE AS share FROM c",
        "split_checks": f"""{_SPLIT}, k AS (SELECT count(DISTINCT fold_a) AS ka, count(DISTINCT fold_b) AS kb FROM split GROUP BY cluster_id), ma AS (SELECT true_class, fold_a AS fold, count(*) AS n FROM split GROUP BY ALL), mb AS (SELECT true_class, fold_b AS fold, count(*) AS n FROM split GROUP BY ALL),
c AS (SELECT 'ids_unique' AS "check", count(*) = count(DISTINCT unit_id) AS ok FROM split UNION ALL SELECT 'folds_a_valid', bool_and(fold_a BETWEEN 1 AND 5) FROM split UNION ALL SELECT 'folds_b_valid', bool_and(fold_b BETWEEN 1 AND 5) FROM split UNION ALL SELECT 'all_assigned', bool_and(fold_b IS NOT NULL) FROM split
UNION ALL SELECT 'a_keeps_clusters', bool_and(ka = 1) FROM k UNION ALL SELECT 'b_parts_clusters', bool_or(kb > 1) FROM k UNION ALL SELECT 'margins_equal', NOT EXISTS ((SELECT * FROM ma EXCEPT SELECT * FROM mb) UNION ALL (SELECT * FROM mb EXCEPT SELECT * FROM ma)))
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
        "stem_groups": f"{_MP} SELECT stem, count(*) AS n_ids, sum(n_images)::BIGINT AS n_images, {_sets('patient_id')} AS raw_pids, {_sets('fold_original')} AS folds, count(DISTINCT fold_original) > 1 AS spans_folds FROM mp WHERE stem IS NOT NULL GROUP BY stem HAVING count(*) > 1",
        "stem_exposure": f"WITH {fx.UNIT_SQL}, s AS (SELECT *, {strict_sql('pid')} AS stem FROM unit), p AS (SELECT DISTINCT stem, pid, fold_a FROM s) SELECT stem, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.stem = s.stem AND p.pid <> s.pid AND p.fold_a <> s.fold_a)) AS n_exposed FROM s GROUP BY stem",
        "identity_comparison": f"WITH {fx.UNIT_SQL} {ident('raw', 'pid')} UNION ALL {ident('strict stem', strict_sql('pid'))} UNION ALL {ident('loose stem', loose_sql('pid'))}",
        "id_formats": f"{_IM}, i AS (SELECT DISTINCT patient_id AS p FROM im WHERE patient_id IS NOT NULL) SELECT CASE WHEN regexp_full_match(p, 'MR[0-9]{{6}}[A-Z]') THEN 'MR_suffix' WHEN regexp_full_match(p, 'MR[0-9]{{6}}') THEN 'MR_plain' WHEN regexp_full_match(p, '[0-9]+') THEN 'numeric' ELSE 'other' END AS format, count(*) AS n_ids, count(DISTINCT {strict_sql('p')}) AS n_strict, count(DISTINCT {loose_sql('p')}) AS n_loose FROM i GROUP BY 1",
        "mapping_flags": f"{_MP}, z AS (SELECT stem, count(*) > 1 AS merged FROM mp WHERE stem IS NOT NULL GROUP BY 1), x AS (SELECT *, fold_original <> fold_minmove AS moved FROM mp JOIN z USING (stem)) SELECT patient_id, stem, merged_flag, merged, moved_flag, moved FROM x WHERE merged_flag <> merged OR moved_flag <> moved",
        "group_integrity": f"{_MP} {integrity}",
        "stem_table_check": f"""{_IM}, s AS (SELECT *, {strict_sql('patient_id')} AS stem FROM im), n AS (SELECT stem, count(*) AS n_now, count(DISTINCT patient_id) AS ids_now, count(DISTINCT fold) > 1 AS spans_now FROM s WHERE stem IS NOT NULL GROUP BY 1),
w AS (SELECT {pid_sql('stem')} AS stem, max(n_images) AS n_images, max(n_raw_pids) AS n_raw_pids, bool_or(spans_folds) AS spans_folds FROM stem_table GROUP BY 1)
SELECT w.stem, n_images, n_now, n_raw_pids, ids_now, spans_folds, spans_now, coalesce(n_images = n_now AND n_raw_pids = ids_now AND spans_folds = spans_now, false) AS ok FROM w LEFT JOIN n USING (stem) WHERE w.stem IS NOT NULL""",
        "split_field_count": f"""WITH x AS (SELECT {pid_sql('stem')} AS stem, len(string_split(raw_pids, '|'))::INT AS ids_listed, len(string_split(folds, '|'))::INT AS folds_listed, n_raw_pids, contains(raw_pids, 'MR') AS has_mr, raw_pids FROM stem_table)
SELECT ids_listed, folds_listed, has_mr, count(*) AS n, count(*) FILTER (ids_listed <> n_raw_pids) AS n_wrong FROM x WHERE stem IS NOT NULL AND raw_pids IS NOT NULL GROUP BY ALL""",
        "min_move": f"{move} SELECT * FROM mv",
        "min_move_margins": f"""{move}, l AS (SELECT label, n_images, fold_before AS fold, true AS b FROM mv JOIN mp USING (patient_id) UNION ALL SELECT label, n_images, fold_after, false FROM mv JOIN mp USING (patient_id))
SELECT fold, label, coalesce(sum(n_images) FILTER (b), 0)::BIGINT AS n_before, coalesce(sum(n_images) FILTER (NOT b), 0)::BIGINT AS n_after FROM l GROUP BY ALL""",
    }
