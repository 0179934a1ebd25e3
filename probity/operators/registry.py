"""Run registry, prediction files and the checks on them, from the raw record files.

A record that is no JSON object is not readable; it counts as such and takes part in nothing else. Fields that
drift (see sources.drift) are read there; the ones used here keep their names and kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import argmax, close, div, finite, softmax, strict_stem
from ..functions.session import cut, plain_image_id, table
from . import bootstrap as bs
from . import metrics as m
from . import screening
from .splits import images, stem_exposed
from ..plans import fixtures as fx
from ..sources import drift

NAMES = ("meningioma", "glioma", "pituitary")
KEYS = {"model": "string", "arm": "string", "image_id": "bigint", "patient_id": "string", "true_class": "int", "true_class_name": "string", "pred_class": "int", "pred_class_name": "string",
        "prob_0": "double", "prob_1": "double", "prob_2": "double"}


def records(spark, d) -> DataFrame:
    """One row a different record: series, file, whether it is readable, and its steady fields."""
    raw = table(spark, d, "retrain_files").select("run_series", "file_seq", "run_file", "written_at", "row_no", "record").dropDuplicates(["run_series", "file_seq", "row_no"])
    v = F.try_parse_json("record")
    fields = [F.try_variant_get("v", f"$.{k}", t).alias(k) for k, t in KEYS.items()]
    return raw.withColumn("v", v).withColumn("readable", F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))).select(
        "run_series", "file_seq", "run_file", "written_at", "row_no", "record", "readable", *fields)


def series_parts(series: Column | str = "run_series") -> dict[str, Column]:
    """Model, arm and number of a series; models may hold underscores."""
    rule = r"^(.*)_([A-Z][0-9]+)_s([0-9]+)$"
    return {"model": F.regexp_extract(series, rule, 1), "arm": F.regexp_extract(series, rule, 2), "series_no": F.regexp_extract(series, rule, 3).try_cast("int")}


def files(r: DataFrame) -> DataFrame:
    """One row a file: its fold and version from the name, records, readable ones, when written."""
    rule = r"_fold([0-9]+)_v([0-9]+)_predictions"
    return r.groupBy("run_series", "file_seq").agg(
        F.min("run_file").alias("run_file"), F.min("written_at").alias("written_at"), F.count("*").alias("n_records"), F.count_if("readable").alias("n_readable")).withColumns(
        {"fold": F.regexp_extract("run_file", rule, 1).try_cast("int"), "version": F.regexp_extract("run_file", rule, 2).try_cast("int")})


def file_errors(r: DataFrame) -> DataFrame:
    """run_series, file_seq, errors: the names of the rules that a file breaks, sorted, joined by |."""
    part = series_parts()
    probs = F.array("prob_0", "prob_1", "prob_2")
    inside = finite("prob_0") & finite("prob_1") & finite("prob_2") & (F.array_min(probs) >= 0) & (F.array_max(probs) <= 1)
    name = lambda c: F.get(F.array(*map(F.lit, NAMES)), F.col(c))
    rules = {
        "model": F.col("model") != part["model"], "arm": F.col("arm") != part["arm"], "probabilities": ~(inside & (F.abs(F.col("prob_0") + F.col("prob_1") + F.col("prob_2") - 1) <= F.lit(1e-3))),
        "argmax": argmax(probs) != F.col("pred_class"), "class_names": (name("true_class") != F.col("true_class_name")) | (name("pred_class") != F.col("pred_class_name")),
    }
    flags = r.where("readable").groupBy("run_series", "file_seq").agg(*(F.bool_or(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()), (F.count("*") > F.countDistinct("image_id")).alias("repeated_images"))
    every = files(r).join(flags, ["run_series", "file_seq"], "left").withColumn("unreadable_records", F.col("n_readable") < F.col("n_records"))
    names = sorted([*rules, "repeated_images", "unreadable_records"])
    return every.select("run_series", "file_seq", F.array_join(F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull()), "|").alias("errors"))


def latest(r: DataFrame) -> DataFrame:
    """The last file's row of each (run_series, image_id)."""
    last = F.max_by(F.struct("model", "arm", "patient_id", "true_class", "pred_class", "prob_0", "prob_1", "prob_2", "file_seq"), F.struct("file_seq", -F.col("row_no")))
    return r.where("readable and image_id is not null").groupBy("run_series", "image_id").agg(last.alias("x")).select("run_series", "image_id", "x.*")


# --- queries -----------------------------------------------------------------------------------------------------------

def q_run_registry(spark, d):
    f = files(records(spark, d))
    per = f.groupBy("run_series").agg(F.count("*").alias("n_files"), F.sum("n_records").alias("n_records"), F.sum("n_readable").alias("n_readable"), F.max("file_seq").alias("last_seq"), F.countDistinct("fold").alias("n_folds"))
    return per.withColumns(series_parts())


def q_run_queue(spark, d):
    """Every model, arm and fold in order of priority, with the state of its runs."""
    f = cut(files(records(spark, d)).withColumns(series_parts()))
    done = f.groupBy("model", "arm", "fold").agg(F.count("*").alias("n_files"), F.bool_and(F.col("n_readable") == F.col("n_records")).alias("whole"))
    grid = f.select("model", "arm").distinct().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))  # a few models and arms
    x = grid.join(done, ["model", "arm", "fold"], "left")
    state = F.when(F.col("n_files").isNull(), "NOT_STARTED").when(F.col("whole"), "COMPLETED").otherwise("PARTIAL")
    return x.select(F.concat("model", F.lit("_"), "arm", F.lit("_fold"), F.col("fold").cast("string")).alias("run_id"), "model", "arm", "fold", F.coalesce("n_files", F.lit(0)).alias("n_files"), state.alias("status"),
                    F.row_number().over(Window.orderBy("arm", "model", "fold")).alias("ord"))


def q_run_status(spark, d):
    """Status by arm, one column a status, 0 where there is none."""
    return q_run_queue(spark, d).groupBy("arm").pivot("status", ["COMPLETED", "NOT_STARTED", "PARTIAL"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"COMPLETED": "completed", "NOT_STARTED": "not_started", "PARTIAL": "partial"})


def q_file_errors(spark, d):
    return file_errors(records(spark, d))


def q_late_files(spark, d):
    """Files written before a file that precedes them in their series was."""
    f = files(records(spark, d))
    prev = Window.partitionBy("run_series").orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)
    x = f.withColumn("latest_before", F.max("written_at").over(prev)).where(F.col("written_at") < F.col("latest_before"))
    return x.select("run_series", "file_seq", "fold", "version")


def q_run_totals(spark, d):
    """Series, files, records and images by model and arm."""
    r = records(spark, d).where("readable")
    return r.groupBy("model", "arm").agg(F.countDistinct("run_series").alias("n_series"), F.countDistinct("run_series", "file_seq").alias("n_files"), F.count("*").alias("n_records"), F.countDistinct("image_id").alias("n_images"))


def q_file_hashes(spark, d):
    """One hash a file, over its records in the order of their own hashes."""
    r = records(spark, d).select("run_series", "file_seq", F.sha2("record", 256).alias("x"))
    return r.groupBy("run_series", "file_seq").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256).alias("sha256"))


def q_run_metrics(spark, d):
    """Metrics of the latest predictions by model and arm."""
    pred = latest(records(spark, d)).where("true_class is not null and pred_class is not null")
    s = m.from_cells(m.cells(pred, ["model", "arm"]))
    return m.rounded(s.select("model", "arm", "balanced_accuracy", "macro_f1", "accuracy"), "balanced_accuracy", "macro_f1", "accuracy")


def q_run_ensemble(spark, d):
    """Accuracy of mean probabilities over all files of a series against that of single files."""
    r = records(spark, d).where("readable and image_id is not null and prob_0 is not null and prob_1 is not null and prob_2 is not null and true_class is not null")
    single = r.groupBy("model", "arm").agg(F.avg((argmax(F.array("prob_0", "prob_1", "prob_2")) == F.col("true_class")).cast("double")).alias("single"))
    mean = r.groupBy("model", "arm", "run_series", "image_id", "true_class").agg(*(F.round(F.avg(f"prob_{k}"), 9).alias(f"p{k}") for k in range(3)))
    ens = mean.groupBy("model", "arm").agg(F.avg((argmax(F.array("p0", "p1", "p2")) == F.col("true_class")).cast("double")).alias("ensemble"))
    return m.rounded(single.join(ens, ["model", "arm"]), "single", "ensemble")


def q_run_bootstrap(spark, d):
    """Metrics of the latest predictions by model and arm with intervals over stems drawn within classes."""
    pred = _latest_stems(spark, d)
    sums, stems = cut(bs.cluster_sums(pred, "code")), pred.groupBy("code").agg(F.min("true_class").alias("true_class"))
    reps = bs.replicates(sums, fx.draws(stems, "code", "true_class", fx.REPS), "code")
    names = ["balanced_accuracy", "macro_f1", "accuracy"]
    long = bs.long_metrics(reps, ["rep", *bs.BY], names).groupBy(*bs.BY, "metric").agg(*bs.interval("value"))
    return m.rounded(long.join(bs.long_metrics(bs.point(sums), bs.BY, names).withColumnRenamed("value", "estimate"), [*bs.BY, "metric"]), "estimate", "ci_lo", "ci_hi")


def _latest_stems(spark, d) -> DataFrame:
    """The latest predictions of images whose patient is known, with probs, confidence, the stem's number as code and whether the stem has another id in another fold."""
    im = images(spark, d).select("image_id", "patient_id", "fold").withColumn("stem", strict_stem("patient_id"))
    exposed = stem_exposed(im, "image_id", "patient_id", "stem", "fold").select("image_id", "stem", "exposed").where("stem is not null")
    code = F.when(F.col("stem").startswith("MR"), F.regexp_extract("stem", "([0-9]{6})", 1).try_cast("bigint") + 10_000_000).otherwise(F.col("stem").try_cast("bigint"))
    pred = latest(records(spark, d)).where("true_class is not null and pred_class is not null and prob_0 is not null and prob_1 is not null and prob_2 is not null")
    x = pred.drop("patient_id").join(exposed, "image_id").withColumn("code", code).where("code is not null").withColumn("probs", F.array("prob_0", "prob_1", "prob_2"))
    return cut(x.withColumn("confidence", F.array_max("probs")))


def q_run_stem_difference(spark, d):
    """Accuracy of the latest predictions on images whose stem has another id in another fold minus that on the others, by model: stems drawn without strata."""
    x = _latest_stems(spark, d)
    sums = x.groupBy("code", "model", "exposed").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("true_class") == F.col("pred_class")).cast("double")).alias("s"))
    return bs.free_difference(cut(sums), "code", ["model"], "exposed", fx.REPS)


def q_file_agreement(spark, d):
    """Each file against the one before it in its series: common images, largest change of a probability."""
    r = records(spark, d).where("readable and image_id is not null").groupBy("run_series", "file_seq", "image_id").agg(*(F.max(f"prob_{k}").alias(f"p{k}") for k in range(3)))
    before = r.select("run_series", (F.col("file_seq") + 1).alias("file_seq"), "image_id", *(F.col(f"p{k}").alias(f"q{k}") for k in range(3)))
    x = r.join(before, ["run_series", "file_seq", "image_id"])
    return m.rounded(x.groupBy("run_series", "file_seq").agg(F.count("*").alias("n_common"), F.max(F.greatest(*(F.abs(F.col(f"p{k}") - F.col(f"q{k}")) for k in range(3)))).alias("max_change")), "max_change")


def q_softmax(spark, d):
    """Probabilities made from logits, under all their names and types: rows, and how often the largest is the same class."""
    x = cut(drift.unified(table(spark, d, "retrain_files")).select("model", "pred_class", *(F.col(f"logit_{k}").alias(f"l{k}") for k in range(3))))
    x = x.where(" and ".join(f"l{k} > double('-Infinity') and l{k} < double('Infinity')" for k in range(3)))
    p = softmax(F.array("l0", "l1", "l2"))
    return m.rounded(x.withColumn("p", p).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.array_max("p")).alias("mean_top"), F.avg((argmax(F.col("p")) == F.col("pred_class")).cast("double")).alias("agreement")), "mean_top", "agreement")


# checks

def q_oof_contract(spark, d):
    """Both arms of each model: ids unique, the same ids, the same classes."""
    pred = fx.predictions(spark, d).select("model", "arm", "unit_id", "true_class")
    uniq = pred.groupBy("model", "arm").agg((F.count("*") == F.countDistinct("unit_id")).alias("u")).groupBy("model").agg(F.bool_and("u").alias("ids_unique"))
    a, b = (pred.where(F.col("arm") == x).select("model", "unit_id", F.col("true_class").alias(x)) for x in "AB")
    both = a.join(b, ["model", "unit_id"], "full").groupBy("model").agg(F.bool_and(F.col("A").isNotNull() & F.col("B").isNotNull()).alias("ids_equal"), F.bool_and(F.coalesce(F.col("A") == F.col("B"), F.lit(False))).alias("classes_equal"))
    return uniq.join(both, "model")


def q_row_invariants(spark, d):
    """How many prediction rows break each rule."""
    pred = fx.predictions(spark, d)
    s = F.aggregate("probs", F.lit(0.0), lambda acc, x: acc + x)
    return pred.groupBy("model", "arm").agg(
        F.count("*").alias("n"), F.count_if(F.exists("probs", lambda x: ~finite(x) | (x < 0) | (x > 1))).alias("bad_probability"), F.count_if(~close(s, F.lit(1.0), 1e-6)).alias("bad_sum"),
        F.count_if(argmax(F.col("probs")) != F.col("pred_class")).alias("bad_argmax"), F.count_if(~close(F.array_max("probs"), F.col("confidence"))).alias("bad_confidence"))


def q_id_contiguity(spark, d):
    """Whether the ids of images, vectors and documents run from the smallest to the largest without gaps or repeats."""
    out = None
    for name, c in (("image_manifest", "image_id"), ("embeddings", "vec_id"), ("documents", "doc_id")):
        one = table(spark, d, name).agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count(c).alias("n"), F.countDistinct(c).alias("n_distinct")).select(
            F.lit(name).alias("table_name"), "least", "most", "n", "n_distinct", (F.col("n") == F.col("n_distinct")).alias("unique"), (F.col("most") - F.col("least") + 1 == F.col("n_distinct")).alias("contiguous"))
        out = one if out is None else out.unionByName(one)
    return out


def q_nn_recheck(spark, d):
    """The earlier screening (nn_similarity) against the pair table: rows that agree, differ, or have no partner there."""
    value = lambda c: F.when(F.col(c).between(-1.0, 1.0), F.col(c))
    was = table(spark, d, "nn_similarity").where("image_id is not null").groupBy("image_id").agg(F.max(value("best_same_patient_thumb_ncc")).alias("was_same"), F.max(value("best_other_patient_thumb_ncc")).alias("was_other"))
    now = screening.q_best_partner(spark, d)
    x = was.join(now, "image_id", "left")
    state = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), "none").when(F.col(b).isNull(), "only before").when(F.col(a).isNull(), "only now").when(F.abs(F.col(a) - F.col(b)) <= F.lit(0.0005), "equal").when(F.col(a) > F.col(b), "higher before").otherwise("higher now")
    long = x.select(F.explode(F.array(F.struct(F.lit("same patient").alias("kind"), state("was_same", "best_same_patient").alias("state")), F.struct(F.lit("other patient").alias("kind"), state("was_other", "best_other_patient").alias("state")))).alias("z"))
    return long.groupBy("z.kind", "z.state").agg(F.count("*").alias("n"))


def _table(spark, d) -> DataFrame:
    """The columns of the unified records that the checks against the split need."""
    return cut(drift.unified(table(spark, d, "retrain_files")).select("run_series", "file_seq", "row_no", "image_id", "patient_id", "stem", "true_class", *(f"prob_{k}" for k in range(3)), *(f"logit_{k}" for k in range(3)), "split_sha256"))


def q_split_errors(spark, d):
    """run_series, file_seq, n, errors: what each file's records, under all names, break against the manifest and their series."""
    from ..functions.session import plain_id
    t = _table(spark, d).join(images(spark, d).select("image_id", F.col("patient_id").alias("owner"), "label"), "image_id", "left")
    wrong = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    ok = F.lit(True)
    for k in range(3):
        ok = ok & finite(f"logit_{k}")
    per = t.groupBy("run_series", "file_seq").agg(
        F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"), wrong(F.col("image_id").isNull() | (F.col("owner").isNull() & F.col("label").isNull())).alias("unknown_image"),
        wrong(plain_id("patient_id") != F.col("owner")).alias("other_patient"), wrong(F.col("label") - 1 != F.col("true_class")).alias("other_class"), wrong(~ok).alias("logits_missing"),
        (F.countDistinct("split_sha256") > 1).alias("split_hash_not_constant"))
    every = t.groupBy("run_series").agg(F.countDistinct("image_id").alias("n_all"))
    x = per.join(every, "run_series").withColumn("image_set", F.col("n_images") != F.col("n_all"))
    names = ["image_set", "logits_missing", "other_class", "other_patient", "split_hash_not_constant", "unknown_image"]
    return x.select("run_series", "file_seq", "n", F.array_join(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in names))), "|").alias("errors"))


def q_consolidated_check(spark, d):
    """Each file's probabilities against the consolidated rows (the last file's of each image): rows, rows apart by more than 1e-12, largest difference."""
    r = records(spark, d).where("readable and image_id is not null")
    one = latest(records(spark, d)).select("run_series", "image_id", *(F.col(f"prob_{k}").alias(f"q{k}") for k in range(3)))
    apart = F.greatest(*(F.abs(F.col(f"prob_{k}") - F.col(f"q{k}")) for k in range(3)))
    x = r.join(one, ["run_series", "image_id"]).withColumn("apart", apart)
    return m.rounded(x.groupBy("run_series", "file_seq").agg(F.count("*").alias("n"), F.count_if(F.col("apart") > F.lit(1e-12)).alias("n_apart"), F.max("apart").alias("largest")), "largest")


def q_recorded_hash(spark, d):
    """Each file's recorded split hash, under all names, against the one its series recorded first: equal, other, several or none."""
    t = _table(spark, d)
    per = t.groupBy("run_series", "file_seq").agg(F.min("split_sha256").alias("lo"), F.max("split_sha256").alias("hi"))
    first = per.where("lo is not null").groupBy("run_series").agg(F.min_by("lo", "file_seq").alias("recorded"))
    x = per.join(first, "run_series", "left")
    return x.select("run_series", "file_seq", F.when(F.col("lo").isNull(), "none").when(F.col("lo") != F.col("hi"), "several").when(F.col("lo") == F.col("recorded"), "equal").otherwise("other").alias("state"))


def q_check_log(spark, d):
    """One table of named checks with PASS or FAIL and a detail."""
    inv = q_row_invariants(spark, d).agg(F.sum(F.col("bad_probability") + F.col("bad_sum") + F.col("bad_argmax") + F.col("bad_confidence")).alias("bad"))
    oof = q_oof_contract(spark, d).agg(F.count_if(~(F.col("ids_unique") & F.col("ids_equal") & F.col("classes_equal"))).alias("bad"))
    err = file_errors(records(spark, d)).agg(F.count_if(~F.col("errors").isin("", "unreadable_records")).alias("bad"))
    row = lambda df, name: df.select(F.lit(name).alias("check"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("bad").cast("string"), F.lit(" broken")).alias("detail"))
    return row(inv, "prediction rows").unionByName(row(oof, "arm contract")).unionByName(row(err, "record files"))


def q_pair_recheck(spark, d):
    """Ids of the pair table that are no readable image, and rows whose patients are not the manifest's."""
    im = images(spark, d).select("image_id", "patient_id")
    p = screening.pairs(spark, d).select("image_a", "image_b", "patient_a", "patient_b")
    ends = p.select(F.col("image_a").alias("image_id"), F.col("patient_a").alias("said")).unionByName(p.select(F.col("image_b").alias("image_id"), F.col("patient_b").alias("said")))
    x = ends.join(im.withColumn("known", F.lit(True)), "image_id", "left")
    return x.agg(F.count("*").alias("n_ends"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.count_if(F.col("said") != F.col("patient_id")).alias("n_other_patient"), m.F.round(div(F.count_if(F.col("known")), F.count("*")), 6).alias("share_known"))


def q_image_ids(spark, d):
    """How image ids are written in the pair table: how many of each kind, how many different images."""
    t = table(spark, d, "near_duplicate_candidates").select(F.explode(F.array("image_a", "image_b")).alias("x"))
    kind = F.when(F.col("x").isNull(), "null").when(F.col("x").contains("/"), "path").when(F.col("x").endswith(".mat"), "file").when(F.col("x").contains("."), "decimal").when(F.col("x").rlike(r"\s"), "blanks").otherwise("plain")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(plain_image_id("x")).alias("n_images"))


def queries() -> dict:
    return {
        "run_registry": q_run_registry, "run_queue": q_run_queue, "run_status": q_run_status, "file_errors": q_file_errors, "late_files": q_late_files, "run_totals": q_run_totals, "file_hashes": q_file_hashes,
        "run_metrics": q_run_metrics, "run_ensemble": q_run_ensemble, "run_bootstrap": q_run_bootstrap, "run_stem_difference": q_run_stem_difference, "file_agreement": q_file_agreement, "softmax": q_softmax, "oof_contract": q_oof_contract, "row_invariants": q_row_invariants,
        "id_contiguity": q_id_contiguity, "nn_recheck": q_nn_recheck, "split_errors": q_split_errors, "consolidated_check": q_consolidated_check, "recorded_hash": q_recorded_hash, "check_log": q_check_log, "pair_recheck": q_pair_recheck, "image_ids": q_image_ids,
    }


# --- the same in SQL -----------------------------------------------------------------------------------------------------

_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE"}
REC_SQL = f"""rr AS (SELECT run_series, file_seq, row_no, any_value(run_file) AS run_file, any_value(written_at) AS written_at, any_value(record) AS record FROM retrain_files GROUP BY 1, 2, 3),
rj AS (SELECT *, coalesce(json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record ELSE '0' END) = 'OBJECT', false) AS readable, CASE WHEN json_valid(record) THEN record ELSE '{{}}' END AS j FROM rr),
rec AS MATERIALIZED (SELECT run_series, file_seq, run_file, written_at, row_no, record, readable, {', '.join(f"try_cast(json_extract_string(j, '$.{k}') AS {_KINDS[t]}) AS {k}" for k, t in KEYS.items())} FROM rj),
fi AS (SELECT run_series, file_seq, min(run_file) AS run_file, min(written_at) AS written_at, count(*) AS n_records, count(*) FILTER (readable) AS n_readable,
  try_cast(regexp_extract(min(run_file), '_fold([0-9]+)_v([0-9]+)_predictions', 1) AS INT) AS fold, try_cast(regexp_extract(min(run_file), '_fold([0-9]+)_v([0-9]+)_predictions', 2) AS INT) AS version FROM rec GROUP BY 1, 2)"""
_R = f"WITH {REC_SQL}"
_part = lambda i: f"regexp_extract(run_series, '^(.*)_([A-Z][0-9]+)_s([0-9]+)$', {i})"
_am = lambda a, b, c: f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"
_nm = lambda c: f"CASE {c} WHEN 0 THEN 'meningioma' WHEN 1 THEN 'glioma' WHEN 2 THEN 'pituitary' END"
_ERR = f"""ef AS (SELECT run_series, file_seq, bool_or(coalesce(model <> {_part(1)}, true)) AS model, bool_or(coalesce(arm <> {_part(2)}, true)) AS arm,
  bool_or(coalesce(NOT (least(prob_0, prob_1, prob_2) >= 0 AND greatest(prob_0, prob_1, prob_2) <= 1 AND abs(prob_0 + prob_1 + prob_2 - 1) <= 1e-3), true)) AS probabilities, bool_or(coalesce({_am('prob_0', 'prob_1', 'prob_2')} <> pred_class, true)) AS argmax,
  bool_or(coalesce({_nm('true_class')} <> true_class_name OR {_nm('pred_class')} <> pred_class_name, true)) AS class_names, count(*) > count(DISTINCT image_id) AS repeated_images FROM rec WHERE readable GROUP BY 1, 2),
er AS (SELECT fi.run_series, fi.file_seq, concat_ws('|', CASE WHEN argmax THEN 'argmax' END, CASE WHEN arm THEN 'arm' END, CASE WHEN class_names THEN 'class_names' END, CASE WHEN model THEN 'model' END, CASE WHEN probabilities THEN 'probabilities' END,
  CASE WHEN repeated_images THEN 'repeated_images' END, CASE WHEN n_readable < n_records THEN 'unreadable_records' END) AS errors FROM fi LEFT JOIN ef USING (run_series, file_seq))"""
_QUEUE = f"""fm AS (SELECT *, {_part(1)} AS model, {_part(2)} AS arm FROM fi), dn AS (SELECT model, arm, fold, count(*) AS n_files, bool_and(n_readable = n_records) AS whole FROM fm GROUP BY ALL),
gr AS (SELECT DISTINCT model, arm, f.f::INT AS fold FROM fm, range(1, 6) f(f)),
qu AS (SELECT model || '_' || arm || '_fold' || fold AS run_id, model, arm, fold, coalesce(n_files, 0) AS n_files, CASE WHEN n_files IS NULL THEN 'NOT_STARTED' WHEN whole THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, row_number() OVER (ORDER BY arm, model, fold)::INT AS ord FROM gr LEFT JOIN dn USING (model, arm, fold))"""


def oracle_sql() -> dict[str, str]:
    r = m._rd
    inv = """SELECT model, arm, count(*) AS n, count(*) FILTER (NOT (least(p0, p1, p2) >= 0 AND greatest(p0, p1, p2) <= 1)) AS bad_probability, count(*) FILTER (abs(p0 + p1 + p2 - 1) > 1e-6) AS bad_sum,
count(*) FILTER (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END <> pred_class) AS bad_argmax, count(*) FILTER (abs(greatest(p0, p1, p2) - confidence) > 1e-12) AS bad_confidence FROM pred GROUP BY ALL"""
    oof = """SELECT model, bool_and(u) AS ids_unique, bool_and(e) AS ids_equal, bool_and(c) AS classes_equal FROM (SELECT model, unit_id, count(*) FILTER (arm = 'A') <= 1 AND count(*) FILTER (arm = 'B') <= 1 AS u,
count(*) FILTER (arm = 'A') = 1 AND count(*) FILTER (arm = 'B') = 1 AS e, count(DISTINCT true_class) = 1 AS c FROM pred GROUP BY ALL) GROUP BY ALL"""
    state = lambda a, b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'none' WHEN {b} IS NULL THEN 'only before' WHEN {a} IS NULL THEN 'only now' WHEN abs({a} - {b}) <= 0.0005::DOUBLE THEN 'equal' WHEN {a} > {b} THEN 'higher before' ELSE 'higher now' END"
    best = screening.oracle_sql()["best_partner"]
    ids = " UNION ALL ".join(f"SELECT '{t}' AS table_name, min({c}) AS least, max({c}) AS most, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, count({c}) = count(DISTINCT {c}) AS \"unique\", max({c}) - min({c}) + 1 = count(DISTINCT {c}) AS contiguous FROM {t}" for t, c in (("image_manifest", "image_id"), ("embeddings", "vec_id"), ("documents", "doc_id")))
    row = lambda name, src: f"SELECT '{name}' AS \"check\", CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, bad || ' broken' AS detail FROM ({src})"
    flag = lambda c: f"bool_or(coalesce({c}, false))"
    err2 = {"image_set": "n_images <> n_all", "logits_missing": "lm", "other_class": "oc", "other_patient": "op", "split_hash_not_constant": "sh", "unknown_image": "ui"}
    stem = "regexp_replace(patient_id, '^(MR[0-9]{6})[A-Z]$', '\\1')"
    ls = f"""{_R}, {screening.IMAGES_SQL}, ik AS (SELECT image_id, patient_id AS pid, {stem} AS stem, fold FROM im WHERE patient_id IS NOT NULL),
ie AS (SELECT a.*, EXISTS (SELECT 1 FROM ik b WHERE b.stem = a.stem AND b.pid <> a.pid AND b.fold <> a.fold) AS exposed FROM ik a),
la AS (SELECT * FROM rec WHERE readable AND image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_series, image_id ORDER BY file_seq DESC, row_no) = 1),
lx AS (SELECT la.model, la.arm, true_class, pred_class, exposed, CASE WHEN stem LIKE 'MR%' THEN try_cast(regexp_extract(stem, '([0-9]{{6}})', 1) AS BIGINT) + 10000000 ELSE try_cast(stem AS BIGINT) END AS code FROM la JOIN ie USING (image_id)
  WHERE true_class IS NOT NULL AND pred_class IS NOT NULL AND prob_0 IS NOT NULL AND prob_1 IS NOT NULL AND prob_2 IS NOT NULL), ly AS (SELECT * FROM lx WHERE code IS NOT NULL)"""
    sides = "sum(w * s) FILTER (exposed) / nullif(sum(w * n) FILTER (exposed), 0) AS x, sum(w * s) FILTER (NOT exposed) / nullif(sum(w * n) FILTER (NOT exposed), 0) AS y"
    ci = lambda e: f"{r(f'quantile_cont({e}, 0.025)', 'ci_lo')}, {r(f'quantile_cont({e}, 0.975)', 'ci_hi')}"
    three = lambda src, key: " UNION ALL ".join(f"SELECT {key}, '{n}' AS metric, {e} AS value FROM {src}" for n, e in (("balanced_accuracy", m.BA_SQL), ("macro_f1", m.F1_SQL), ("accuracy", m.ACC_SQL)))
    full = "rd LEFT JOIN wide USING (run_series, file_seq, row_no)"
    return {
        "split_errors": f"""{drift.table_sql()}, {screening.IMAGES_SQL}, t AS (SELECT run_series, file_seq, w.image_id, {screening.pid_sql('w.patient_id')} AS pid, true_class, logit_0, logit_1, logit_2, split_sha256, im.patient_id AS owner, label FROM (SELECT * FROM {full}) w LEFT JOIN im ON im.image_id = w.image_id),
p AS (SELECT run_series, file_seq, count(*) AS n, count(DISTINCT image_id) AS n_images, {flag('image_id IS NULL OR (owner IS NULL AND label IS NULL)')} AS ui, {flag('pid <> owner')} AS op, {flag('label - 1 <> true_class')} AS oc,
  {flag('NOT (coalesce(isfinite(logit_0), false) AND coalesce(isfinite(logit_1), false) AND coalesce(isfinite(logit_2), false))')} AS lm, count(DISTINCT split_sha256) > 1 AS sh FROM t GROUP BY 1, 2), e AS (SELECT run_series, count(DISTINCT image_id) AS n_all FROM t GROUP BY 1)
SELECT run_series, file_seq, n, concat_ws('|', {', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in err2.items())}) AS errors FROM p JOIN e USING (run_series)""",
        "consolidated_check": f"""{_R}, la AS (SELECT run_series, image_id, prob_0 AS q0, prob_1 AS q1, prob_2 AS q2 FROM rec WHERE readable AND image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_series, image_id ORDER BY file_seq DESC, row_no) = 1),
x AS (SELECT run_series, file_seq, greatest(abs(prob_0 - q0), abs(prob_1 - q1), abs(prob_2 - q2)) AS apart FROM rec JOIN la USING (run_series, image_id) WHERE readable) SELECT run_series, file_seq, count(*) AS n, count(*) FILTER (apart > 1e-12) AS n_apart, {r('max(apart)', 'largest')} FROM x GROUP BY 1, 2""",
        "recorded_hash": f"""{drift.table_sql()}, p AS (SELECT run_series, file_seq, min(split_sha256) AS lo, max(split_sha256) AS hi FROM {full} GROUP BY 1, 2), f AS (SELECT run_series, arg_min(lo, file_seq) AS recorded FROM p WHERE lo IS NOT NULL GROUP BY 1)
SELECT run_series, file_seq, CASE WHEN lo IS NULL THEN 'none' WHEN lo <> hi THEN 'several' WHEN lo = recorded THEN 'equal' ELSE 'other' END AS state FROM p LEFT JOIN f USING (run_series)""",
        "run_bootstrap": f"""{ls}, st2 AS (SELECT code, min(true_class) AS true_class FROM ly GROUP BY 1), {fx.draws_sql('st2', 'code', 'true_class')}, cl AS ({m.cells_sql('ly', 'model, arm, code')}), wr AS (SELECT rep, model, arm, {bs._SUMC} FROM draws JOIN cl USING (code) GROUP BY ALL), wp AS ({m.cells_sql('ly', 'model, arm')}), vr AS ({three('wr', 'rep, model, arm')}), vp AS ({three('wp', 'model, arm')})
SELECT model, arm, metric, {r('any_value(vp.value)', 'estimate')}, {ci('vr.value')} FROM vr JOIN vp USING (model, arm, metric) GROUP BY ALL""",
        "run_stem_difference": f"""{ls}, st AS (SELECT DISTINCT code, 0 AS one FROM ly), {fx.draws_sql('st', 'code', 'one', salt=7)}, t AS (SELECT code, model, exposed, count(*)::DOUBLE AS n, sum((true_class = pred_class)::INT)::DOUBLE AS s FROM ly GROUP BY ALL),
w AS (SELECT rep, model, {sides} FROM draws JOIN t USING (code) GROUP BY ALL), p AS (SELECT model, {sides.replace('w * ', '')} FROM t GROUP BY ALL)
SELECT model, count(*) AS n_reps, {ci('w.x - w.y')}, {r('any_value(p.x)', 'with_side')}, {r('any_value(p.y)', 'without_side')}, {r('any_value(p.x - p.y)', 'difference')} FROM w JOIN p USING (model) WHERE w.x - w.y IS NOT NULL GROUP BY ALL""",
        "run_registry": f"{_R} SELECT run_series, count(*) AS n_files, sum(n_records)::BIGINT AS n_records, sum(n_readable)::BIGINT AS n_readable, max(file_seq) AS last_seq, count(DISTINCT fold) AS n_folds, {_part(1)} AS model, {_part(2)} AS arm, {_part(3)}::INT AS series_no FROM fi GROUP BY run_series",
        "run_queue": f"{_R}, {_QUEUE} SELECT * FROM qu",
        "run_status": f"{_R}, {_QUEUE} SELECT arm, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'NOT_STARTED') AS not_started, count(*) FILTER (status = 'PARTIAL') AS partial FROM qu GROUP BY arm",
        "file_errors": f"{_R}, {_ERR} SELECT * FROM er",
        "late_files": f"{_R} SELECT run_series, file_seq, fold, version FROM (SELECT *, max(written_at) OVER (PARTITION BY run_series ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM fi) WHERE written_at < lb",
        "run_totals": f"{_R} SELECT model, arm, count(DISTINCT run_series) AS n_series, count(DISTINCT (run_series, file_seq)) AS n_files, count(*) AS n_records, count(DISTINCT image_id) AS n_images FROM rec WHERE readable GROUP BY ALL",
        "file_hashes": f"{_R} SELECT run_series, file_seq, sha256(string_agg(sha256(record), '' ORDER BY sha256(record))) AS sha256 FROM rec GROUP BY 1, 2",
        "run_metrics": f"{_R}, la AS (SELECT * FROM rec WHERE readable AND image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_series, image_id ORDER BY file_seq DESC, row_no) = 1), x AS (SELECT * FROM la WHERE true_class IS NOT NULL AND pred_class IS NOT NULL), c AS ({m.cells_sql('x', 'model, arm')}) SELECT model, arm, {r(m.BA_SQL, 'balanced_accuracy')}, {r(m.F1_SQL, 'macro_f1')}, {r(m.ACC_SQL, 'accuracy')} FROM c",
        "run_ensemble": f"""{_R}, x AS (SELECT * FROM rec WHERE readable AND image_id IS NOT NULL AND prob_0 IS NOT NULL AND prob_1 IS NOT NULL AND prob_2 IS NOT NULL AND true_class IS NOT NULL), s AS (SELECT model, arm, avg(({_am('prob_0', 'prob_1', 'prob_2')} = true_class)::INT) AS single FROM x GROUP BY ALL),
me AS (SELECT model, arm, run_series, image_id, true_class, round(avg(prob_0), 9) AS p0, round(avg(prob_1), 9) AS p1, round(avg(prob_2), 9) AS p2 FROM x GROUP BY ALL), e AS (SELECT model, arm, avg(({_am('p0', 'p1', 'p2')} = true_class)::INT) AS ensemble FROM me GROUP BY ALL)
SELECT model, arm, {r('single', 'single')}, {r('ensemble', 'ensemble')} FROM s JOIN e USING (model, arm)""",
        "file_agreement": f"""{_R}, x AS (SELECT run_series, file_seq, image_id, max(prob_0) AS p0, max(prob_1) AS p1, max(prob_2) AS p2 FROM rec WHERE readable AND image_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT b.run_series, b.file_seq, count(*) AS n_common, {r('max(greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2)))', 'max_change')} FROM x a JOIN x b ON a.run_series = b.run_series AND a.image_id = b.image_id AND a.file_seq + 1 = b.file_seq GROUP BY 1, 2""",
        "softmax": f"""{drift.table_sql()}, x AS (SELECT model, pred_class, logit_0 AS l0, logit_1 AS l1, logit_2 AS l2 FROM wide), y AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM x WHERE isfinite(l0) AND isfinite(l1) AND isfinite(l2))
SELECT model, count(*) AS n, {r('avg(greatest(e0, e1, e2) / (e0 + e1 + e2))', 'mean_top')}, {r(f"avg(({_am('e0', 'e1', 'e2')} = pred_class)::INT)", 'agreement')} FROM y GROUP BY model""",
        "oof_contract": f"{m.W} {oof}", "row_invariants": f"{m.W} {inv}", "id_contiguity": ids,
        "nn_recheck": f"""WITH bp AS ({best}), wa AS (SELECT image_id, max(best_same_patient_thumb_ncc) FILTER (best_same_patient_thumb_ncc BETWEEN -1 AND 1) AS ws, max(best_other_patient_thumb_ncc) FILTER (best_other_patient_thumb_ncc BETWEEN -1 AND 1) AS wo FROM nn_similarity WHERE image_id IS NOT NULL GROUP BY 1),
x AS (SELECT * FROM wa LEFT JOIN bp USING (image_id)), l AS (SELECT 'same patient' AS kind, {state('ws', 'best_same_patient')} AS state FROM x UNION ALL SELECT 'other patient', {state('wo', 'best_other_patient')} FROM x) SELECT kind, state, count(*) AS n FROM l GROUP BY ALL""",
        "check_log": f"""{_R}, {_ERR}, {fx.PRED_SQL}, iv AS ({inv}), oc AS ({oof})
{row('prediction rows', 'SELECT sum(bad_probability + bad_sum + bad_argmax + bad_confidence)::BIGINT AS bad FROM iv')} UNION ALL {row('arm contract', 'SELECT count(*) FILTER (NOT (ids_unique AND ids_equal AND classes_equal)) AS bad FROM oc')} UNION ALL {row('record files', "SELECT count(*) FILTER (errors NOT IN ('', 'unreadable_records')) AS bad FROM er")}""",
        "pair_recheck": f"WITH {screening.PAIRS_SQL}, {screening.IMAGES_SQL}, e AS (SELECT image_a AS image_id, patient_a AS said FROM pr UNION ALL SELECT image_b, patient_b FROM pr), x AS (SELECT e.*, im.image_id AS known, im.patient_id FROM e LEFT JOIN im ON im.image_id = e.image_id) SELECT count(*) AS n_ends, count(*) FILTER (known IS NULL) AS n_unknown, count(*) FILTER (said <> patient_id) AS n_other_patient, round(count(known)::DOUBLE / count(*), 6) AS share_known FROM x",
        "image_ids": f"WITH t AS (SELECT unnest([image_a, image_b]) AS x FROM near_duplicate_candidates) SELECT CASE WHEN x IS NULL THEN 'null' WHEN contains(x, '/') THEN 'path' WHEN ends_with(x, '.mat') THEN 'file' WHEN contains(x, '.') THEN 'decimal' WHEN regexp_matches(x, '\\s') THEN 'blanks' ELSE 'plain' END AS kind, count(*) AS n, count(DISTINCT {screening._img('x')}) AS n_images FROM t GROUP BY 1",
    }
