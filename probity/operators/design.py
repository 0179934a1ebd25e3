"""A controlled exposure design on the image manifest: donors, fixed test, nested levels, controls, arms.

Patients of the test fold with at least MIN_ROWS images are eligible. A part of their images are donors; the
rest of the fold is the fixed test. At each level a nested, label-stratified prefix of the eligible patients
gets its donors into training (SIB), or as many images of a control patient instead (CTRL). All draws are
deterministic hashes. Labels are few; ranks within a label or patient are made range by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import h
from ..functions.ranks import first_of, group_rank
from ..functions.session import cut
from ..plans.fixtures import h_sql
from .splits import IMAGES_SQL, images

FOLD, MIN_ROWS, MOST, LEVELS = 4, 4, 6, (25, 50, 75, 100)


def base_frames(im: DataFrame, fold: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """The images of the fold and the others; images without patient, label or fold are in neither."""
    known = im.where("patient_id is not null and label is not null and fold is not null").select("image_id", "patient_id", "label", "fold")
    return known.where(F.col("fold") == fold), known.where(F.col("fold") != fold)


def eligible(test: DataFrame) -> DataFrame:
    """patient_id, label, n, n_donor: patients with enough images; n_donor = min(n div 2, MOST)."""
    per = test.groupBy("patient_id").agg(F.min("label").alias("label"), F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    return per.withColumn("n_donor", F.least(F.expr("n div 2"), F.lit(MOST).cast("bigint")))


def donors(test: DataFrame, el: DataFrame, salt: int = 7004) -> DataFrame:
    """image_id, patient_id, label: the first n_donor images of each eligible patient in hashed order."""
    few = first_of(test.drop("label").withColumn("_h", h("image_id", salt)), ["patient_id"], ["_h", "image_id"], MOST, "k")
    return few.join(el, "patient_id").where("k <= n_donor").select("image_id", "patient_id", "label")


def levels(el: DataFrame) -> DataFrame:
    """patient_id, label, n_donor, selected_L25..L100: prefixes of a hashed order, their length rounded half to even."""
    coded = el.withColumn("_h", F.conv(F.substring(F.sha2("patient_id", 256), 1, 8), 16, 10).cast("bigint"))
    ranked = group_rank(coded, ["label"], "_h", ["patient_id"], 1 << 24, "k")
    of = el.groupBy("label").agg(F.count("*").alias("n_label"))  # one row a label
    x = ranked.join(F.broadcast(of), "label")
    return x.select("patient_id", "label", "n_donor", *((F.col("k") <= F.bround(F.lit(float(L)) / F.lit(100.0) * F.col("n_label"))).alias(f"selected_L{L}") for L in LEVELS))


def control_plan(need: dict[tuple, int], have: dict[tuple, int]) -> list[tuple]:
    """(label, mr, n_donor, n_same, first_same, n_cross, first_cross): how many patients of each kind get a control of their own
    and of the other id format, and from which place in those controls' order (largest first).

    need and have count patients by (label, mr, n_donor) and controls by (label, mr, size). Larger needs go first,
    the own format before the other; a control must have at least as many images as it is to give.
    """
    used: dict[tuple, int] = {}
    out = []
    for d in range(MOST, 0, -1):
        enough = lambda x, mr: sum(n for (y, m, size), n in have.items() if (y, m) == (x, mr) and size >= d)
        for x in sorted({k[0] for k in need}):
            own, first = {}, {}
            for mr in (False, True):
                first[mr] = used.get((x, mr), 0)
                own[mr] = max(0, min(need.get((x, mr, d), 0), enough(x, mr) - first[mr]))
                used[x, mr] = first[mr] + own[mr]
            for mr in (False, True):
                at = used[x, not mr]
                cross = max(0, min(need.get((x, mr, d), 0) - own[mr], enough(x, not mr) - at))
                used[x, not mr] = at + cross
                out.append((x, mr, d, own[mr], first[mr], cross, at))
    return out


def controls(el: DataFrame, rest: DataFrame) -> DataFrame:
    """patient_id, control_patient, same_format: one control each, none twice, of the same label, with at least as many images as there are donors.

    Patients with more donors choose first, and a control with the same id format is taken before another; who finds none
    is left with nulls. The choice is laid out on the counts by label, format and size (a few rows); patients and
    controls, in hashed order, are then matched by their ranks.
    """
    mr = F.col("patient_id").startswith("MR")
    code = F.conv(F.substring(F.sha2("patient_id", 256), 9, 8), 16, 10).cast("bigint")
    left = cut(el.select("patient_id", "label", mr.alias("mr"), F.col("n_donor").alias("size"), code.alias("_h")))
    have = rest.groupBy("patient_id").agg(F.min("label").alias("label"), F.count("*").alias("n")).withColumn("size", F.least("n", F.lit(MOST).cast("bigint")))
    right = cut(have.select("patient_id", "label", mr.alias("mr"), "size", ((MOST - F.col("size")) * (1 << 32) + code).alias("_h")))
    counts = lambda df: {(r["label"], r["mr"], r["size"]): r["count"] for r in df.groupBy("label", "mr", "size").count().collect()}
    plan = el.sparkSession.createDataFrame(control_plan(counts(left), counts(right)), "label int, mr boolean, size bigint, n_same bigint, first_same bigint, n_cross bigint, first_cross bigint")
    left = group_rank(left, ["label", "mr", "size"], "_h", ["patient_id"], 1 << 24, "k").join(F.broadcast(plan), ["label", "mr", "size"], "left")
    same, cross = F.col("k") <= F.col("n_same"), F.col("k") <= F.col("n_same") + F.col("n_cross")
    left = left.select("patient_id", "label", F.when(same, F.col("mr")).otherwise(~F.col("mr")).alias("mr"), F.when(same, F.lit(True)).when(cross, F.lit(False)).alias("same_format"),
                       F.when(same, F.col("first_same") + F.col("k")).when(cross, F.col("first_cross") + F.col("k") - F.col("n_same")).alias("place"))
    right = group_rank(right, ["label", "mr"], "_h", ["patient_id"], 1 << 24, "place").select("label", "mr", "place", F.col("patient_id").alias("control_patient"))
    return left.join(right, ["label", "mr", "place"], "left").select("patient_id", "control_patient", "same_format")


def arms(im: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixed test, training rows as (kind, level, image_id, patient_id, label))."""
    test, rest = base_frames(im)
    test, rest = cut(test), cut(rest)
    el = cut(eligible(test))
    don = cut(donors(test, el))
    lv = cut(levels(el))
    ctrl = cut(controls(el, rest).where("control_patient is not null"))
    fixed = test.join(don.select("image_id"), "image_id", "left_anti")
    base = rest.join(ctrl.select(F.col("control_patient").alias("patient_id")), "patient_id", "left_anti").select("image_id", "patient_id", "label")
    matched = lv.join(ctrl, "patient_id")
    picked = matched.select("patient_id", "control_patient", "n_donor", F.explode(F.array(*(F.when(F.col(f"selected_L{L}"), F.lit(L)) for L in LEVELS))).alias("level")).where("level is not null")
    sib = don.join(picked, "patient_id").select(F.lit("SIB").alias("kind"), "level", "image_id", "patient_id", "label")
    of_ctrl = rest.withColumnRenamed("patient_id", "control_patient").join(ctrl.select("control_patient", "patient_id"), "control_patient").withColumn("_h", h("image_id", 7104))
    ranked = first_of(of_ctrl, ["control_patient"], ["_h", "image_id"], MOST, "k")
    con = ranked.drop("patient_id").join(picked.select("control_patient", "level", "n_donor"), "control_patient").where("k <= n_donor").select(
        F.lit("CTRL").alias("kind"), "level", "image_id", F.col("control_patient").alias("patient_id"), "label")
    grid = F.explode(F.array(F.struct(F.lit("CLEAN").alias("kind"), F.lit(0).alias("level")), *(F.struct(F.lit(k).alias("kind"), F.lit(L).alias("level")) for k in ("CTRL", "SIB") for L in LEVELS)))
    every = base.select(grid.alias("g"), "image_id", "patient_id", "label").select("g.*", "image_id", "patient_id", "label")
    return fixed, every.unionByName(sib).unionByName(con)


def conditions(fixed: DataFrame, train: DataFrame, fold: int = FOLD) -> DataFrame:
    """condition, kind, level, n_train, class_counts (JSON), train_test_patient_overlap, batch_remainder."""
    by = ["kind", "level"]
    counts = train.groupBy(*by, "label").agg(F.count("*").alias("n"))
    per = counts.groupBy(*by).agg(F.sum("n").alias("n_train"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("c"))  # one entry a label
    shared = train.select(*by, "patient_id").distinct().join(fixed.select("patient_id").distinct(), "patient_id", "left_semi").groupBy(*by).agg(F.count("*").alias("overlap"))
    as_json = F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: F.concat(F.lit('"'), x["label"].cast("string"), F.lit('": '), x["n"].cast("string"))), ", "), F.lit("}"))
    return per.join(shared, by, "left").select(F.concat(F.lit(f"fold{fold}_"), "kind", F.lit("_L"), F.col("level").cast("string")).alias("condition"), *by, "n_train", as_json.alias("class_counts"),
                                               F.coalesce("overlap", F.lit(0)).alias("train_test_patient_overlap"), (F.col("n_train") % 32).alias("batch_remainder"))


# --- queries -----------------------------------------------------------------------------------------------------------

def q_eligible(spark, d):
    return eligible(base_frames(images(spark, d))[0])


def q_donors(spark, d):
    test, _ = base_frames(images(spark, d))
    return donors(test, eligible(test))


def q_fixed_test(spark, d):
    """The fixed test with its flag, and how it compares with the given list: listed there or not."""
    from ..functions.session import table
    test, _ = base_frames(images(spark, d))
    el = eligible(test)
    fixed = test.join(donors(test, el).select("image_id"), "image_id", "left_anti")
    given = table(spark, d, "fixed_test_fold4").where("image_id is not null").select("image_id", F.lit(True).alias("listed")).distinct()
    flagged = fixed.join(el.select("patient_id", F.lit(True).alias("eligible")), "patient_id", "left").join(given, "image_id", "left")
    return flagged.select("image_id", "patient_id", "label", F.coalesce("eligible", F.lit(False)).alias("exposure_eligible"), F.coalesce("listed", F.lit(False)).alias("listed"))


def q_levels(spark, d):
    return levels(eligible(base_frames(images(spark, d))[0]))


def q_controls(spark, d):
    test, rest = base_frames(images(spark, d))
    return controls(eligible(test), rest)


def q_design_table(spark, d):
    """One row an eligible patient: label, donors, levels, control."""
    test, rest = base_frames(images(spark, d))
    el = cut(eligible(test))
    return levels(el).join(controls(el, rest), "patient_id").join(el.select("patient_id", "n"), "patient_id")


def q_conditions(spark, d):
    return conditions(*arms(images(spark, d)))


def q_design_checks(spark, d):
    """Named checks: arms of a level equal in size and labels, clean arm without test patients, no test image in training."""
    fixed, train = arms(images(spark, d))
    fixed, train = cut(fixed), cut(train)
    c = cut(conditions(fixed, train))
    pair = c.where("kind = 'SIB'").select("level", F.col("n_train").alias("a"), F.col("class_counts").alias("ca")).join(c.where("kind = 'CTRL'").select("level", F.col("n_train").alias("b"), F.col("class_counts").alias("cb")), "level")
    one = lambda df, name: df.select(F.lit(name).alias("check"), F.when(F.coalesce("ok", F.lit(True)), "PASS").otherwise("FAIL").alias("status"))
    return (one(pair.agg(F.bool_and((F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))).alias("ok")), "arms_matched")
            .unionByName(one(c.where("kind = 'CLEAN'").agg(F.bool_and(F.col("train_test_patient_overlap") == 0).alias("ok")), "clean_has_no_test_patient"))
            .unionByName(one(train.join(fixed, "image_id", "left_semi").agg((F.count("*") == 0).alias("ok")), "no_test_image_in_training"))
            .unionByName(one(train.groupBy("kind", "level", "image_id").agg(F.count("*").alias("n")).agg(F.bool_and(F.col("n") == 1).alias("ok")), "images_once")))


def q_train_lists(spark, d):
    """The given training lists: images, patients, labels, overlap with the given test list, unknown ids."""
    from ..functions.session import table
    lists = table(spark, d, "train_fold4").where("image_id is not null").distinct()
    im = images(spark, d).select("image_id", "patient_id", "label")
    held = table(spark, d, "fixed_test_fold4").where("image_id is not null").select("image_id", F.lit(True).alias("held")).distinct()
    x = lists.join(im, "image_id", "left").join(held, "image_id", "left")
    return x.groupBy("train_list").agg(F.count("*").alias("n"), F.countDistinct("patient_id").alias("n_patients"), *(F.count_if(F.col("label") == k).alias(f"label_{k}") for k in (1, 2, 3)),
                                       F.count_if(F.col("held")).alias("n_held"), F.count_if(F.col("label").isNull() & F.col("patient_id").isNull()).alias("n_unknown"), (F.count("*") % 32).alias("batch_remainder"))


def queries() -> dict:
    return {"design_eligible": q_eligible, "design_donors": q_donors, "design_fixed_test": q_fixed_test, "design_levels": q_levels, "design_controls": q_controls, "design_table": q_design_table, "design_conditions": q_conditions,
            "design_checks": q_design_checks, "train_lists": q_train_lists}


def oracle_sql() -> dict[str, str]:
    code = lambda at: f"('0x' || substr(sha256(patient_id), {at}, 8))::BIGINT"
    base = f"""WITH RECURSIVE {IMAGES_SQL}, kn AS (SELECT image_id, patient_id, label, fold FROM im WHERE patient_id IS NOT NULL AND label IS NOT NULL AND fold IS NOT NULL), te AS (SELECT * FROM kn WHERE fold = {FOLD}), re AS (SELECT * FROM kn WHERE fold <> {FOLD}),
el AS (SELECT patient_id, min(label) AS label, count(*) AS n, least(count(*) // 2, {MOST}) AS n_donor FROM te GROUP BY 1 HAVING count(*) >= {MIN_ROWS}),
dn AS (SELECT image_id, patient_id, label FROM (SELECT te.image_id, el.*, row_number() OVER (PARTITION BY te.patient_id ORDER BY {h_sql('te.image_id', 7004)}, te.image_id) AS k FROM te JOIN el ON el.patient_id = te.patient_id) WHERE k <= n_donor),
lv AS (SELECT patient_id, label, n_donor, {', '.join(f'k <= round_even({float(L)}::DOUBLE / 100.0::DOUBLE * nl, 0) AS selected_L{L}' for L in LEVELS)} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {code(1)}, patient_id) AS k, count(*) OVER (PARTITION BY label) AS nl FROM el)),
le AS (SELECT patient_id, label, n_donor AS size, patient_id LIKE 'MR%' AS mr, row_number() OVER (PARTITION BY label, n_donor, patient_id LIKE 'MR%' ORDER BY {code(9)}, patient_id) AS k FROM el),
rh AS (SELECT patient_id, min(label) AS label, least(count(*), {MOST}) AS size, patient_id LIKE 'MR%' AS mr FROM re GROUP BY patient_id),
ri AS (SELECT patient_id AS control_patient, label, size, mr, row_number() OVER (PARTITION BY label, mr ORDER BY size DESC, {code(9)}, patient_id) AS place FROM rh),
lb AS (SELECT DISTINCT label FROM el),
cn0 AS (SELECT label, d.d AS d, (SELECT count(*) FROM le WHERE le.label = lb.label AND mr AND size = d.d) AS need_m, (SELECT count(*) FROM le WHERE le.label = lb.label AND NOT mr AND size = d.d) AS need_o,
  (SELECT count(*) FROM ri WHERE ri.label = lb.label AND mr AND size >= d.d) AS have_m, (SELECT count(*) FROM ri WHERE ri.label = lb.label AND NOT mr AND size >= d.d) AS have_o FROM lb, range(1, {MOST + 1}) d(d)),
st AS (SELECT label, {MOST + 1}::BIGINT AS d, 0::BIGINT AS own_m, 0::BIGINT AS own_o, 0::BIGINT AS cross_m, 0::BIGINT AS cross_o, 0::BIGINT AS was_m, 0::BIGINT AS was_o, 0::BIGINT AS used_m, 0::BIGINT AS used_o FROM lb
  UNION ALL SELECT label, d, own_m, own_o, least(need_m - own_m, have_o - was_o - own_o), least(need_o - own_o, have_m - was_m - own_m), was_m, was_o,
    was_m + own_m + least(need_o - own_o, have_m - was_m - own_m), was_o + own_o + least(need_m - own_m, have_o - was_o - own_o)
  FROM (SELECT c.*, s.used_m AS was_m, s.used_o AS was_o, least(need_m, have_m - s.used_m) AS own_m, least(need_o, have_o - s.used_o) AS own_o FROM st s JOIN cn0 c ON c.label = s.label AND c.d = s.d - 1)),
pl AS (SELECT label, true AS mr, d AS size, own_m AS n_same, was_m AS first_same, cross_m AS n_cross, was_o + own_o AS first_cross FROM st UNION ALL SELECT label, false, d, own_o, was_o, cross_o, was_m + own_m FROM st),
lp AS (SELECT patient_id, label, CASE WHEN k <= n_same THEN mr ELSE NOT mr END AS mr, CASE WHEN k <= n_same THEN true WHEN k <= n_same + n_cross THEN false END AS same_format,
  CASE WHEN k <= n_same THEN first_same + k WHEN k <= n_same + n_cross THEN first_cross + k - n_same END AS place FROM le JOIN pl USING (label, mr, size)),
co AS (SELECT patient_id, control_patient, same_format FROM lp LEFT JOIN ri USING (label, mr, place)),
cm AS (SELECT * FROM co WHERE control_patient IS NOT NULL), ft AS (SELECT * FROM te WHERE image_id NOT IN (SELECT image_id FROM dn)), ba AS (SELECT * FROM re WHERE patient_id NOT IN (SELECT control_patient FROM cm)),
lx AS (SELECT patient_id, n_donor, unnest([{', '.join(f'CASE WHEN selected_L{L} THEN {L} END' for L in LEVELS)}]) AS level FROM lv), pk AS (SELECT lx.*, control_patient FROM lx JOIN cm USING (patient_id) WHERE level IS NOT NULL),
cr AS (SELECT re.image_id, cm.control_patient, label, row_number() OVER (PARTITION BY cm.control_patient ORDER BY {h_sql('re.image_id', 7104)}, re.image_id) AS k FROM re JOIN cm ON cm.control_patient = re.patient_id),
tr AS (SELECT kind, level, image_id, patient_id, label FROM ba, (SELECT 'CLEAN' AS kind, 0 AS level UNION ALL SELECT k.kind, l.level FROM (VALUES ('CTRL'), ('SIB')) k(kind), (VALUES {', '.join(f'({L})' for L in LEVELS)}) l(level)) g
  UNION ALL SELECT 'SIB', level, image_id, dn.patient_id, dn.label FROM dn JOIN pk ON pk.patient_id = dn.patient_id UNION ALL SELECT 'CTRL', level, image_id, cr.control_patient, cr.label FROM cr JOIN pk ON pk.control_patient = cr.control_patient AND cr.k <= pk.n_donor),
cn AS (SELECT kind, level, sum(n)::BIGINT AS n_train, '{{' || string_agg('"' || label || '": ' || n, ', ' ORDER BY label) || '}}' AS class_counts FROM (SELECT kind, level, label, count(*) AS n FROM tr GROUP BY ALL) GROUP BY ALL),
ov AS (SELECT kind, level, count(DISTINCT patient_id) AS overlap FROM tr WHERE patient_id IN (SELECT patient_id FROM ft) GROUP BY ALL),
cd AS (SELECT 'fold{FOLD}_' || kind || '_L' || level AS condition, kind, level, n_train, class_counts, coalesce(overlap, 0) AS train_test_patient_overlap, n_train % 32 AS batch_remainder FROM cn LEFT JOIN ov USING (kind, level))"""
    st = lambda name, x: f"SELECT '{name}' AS \"check\", CASE WHEN coalesce(({x}), true) THEN 'PASS' ELSE 'FAIL' END AS status"
    return {
        "design_eligible": f"{base} SELECT * FROM el",
        "design_donors": f"{base} SELECT * FROM dn",
        "design_fixed_test": f"{base} SELECT image_id, patient_id, label, patient_id IN (SELECT patient_id FROM el) AS exposure_eligible, image_id IN (SELECT image_id FROM fixed_test_fold4 WHERE image_id IS NOT NULL) AS listed FROM ft",
        "design_levels": f"{base} SELECT * FROM lv",
        "design_controls": f"{base} SELECT * FROM co",
        "design_table": f"{base} SELECT lv.*, control_patient, same_format, el.n FROM lv JOIN co USING (patient_id) JOIN el USING (patient_id)",
        "design_conditions": f"{base} SELECT * FROM cd",
        "design_checks": f"{base} {st('arms_matched', 'SELECT bool_and(a.n_train = b.n_train AND a.class_counts = b.class_counts) FROM cd a JOIN cd b USING (level) WHERE a.kind = ' + chr(39) + 'SIB' + chr(39) + ' AND b.kind = ' + chr(39) + 'CTRL' + chr(39))} UNION ALL {st('clean_has_no_test_patient', 'SELECT bool_and(train_test_patient_overlap = 0) FROM cd WHERE level = 0')} UNION ALL {st('no_test_image_in_training', 'SELECT count(*) = 0 FROM tr WHERE image_id IN (SELECT image_id FROM ft)')} UNION ALL {st('images_once', 'SELECT bool_and(n = 1) FROM (SELECT count(*) AS n FROM tr GROUP BY kind, level, image_id)')}",
        "train_lists": f"""WITH {IMAGES_SQL}, l AS (SELECT DISTINCT image_id, train_list FROM train_fold4 WHERE image_id IS NOT NULL), he AS (SELECT DISTINCT image_id, true AS held FROM fixed_test_fold4 WHERE image_id IS NOT NULL)
SELECT train_list, count(*) AS n, count(DISTINCT patient_id) AS n_patients, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2, count(*) FILTER (label = 3) AS label_3, count(*) FILTER (held) AS n_held, count(*) FILTER (label IS NULL AND patient_id IS NULL) AS n_unknown, count(*) % 32 AS batch_remainder
FROM l LEFT JOIN im USING (image_id) LEFT JOIN he USING (image_id) GROUP BY train_list""",
    }
