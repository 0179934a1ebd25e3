import json

from probity.sources import drift

SCHEMA = "run_series string, file_seq int, run_file string, row_no int, record string"


def files(spark, spec):
    rows = []
    for seq, records in spec.items():
        rows += [("s", seq, f"f{seq}", i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted(tuple(r) for r in drift.changes(df).select("file_seq", "change_kind", "old_field", "new_field").collect())


def test_all_kinds_of_change(spark):
    base = [{"image_id": i, "x": i * 1.5, "Name": f"n{i}", "k": i} for i in range(8)]
    second = [{"image_id": i, "x": i * 1.5 + 0.003, "Name": f"n{i}", "k": str(i)} for i in range(8)]
    third = [{"image_id": i, "renamed": i * 1.5, "name": f"n{i}", "k": str(i), "extra": "e"} for i in range(8)]
    assert found(files(spark, {1: base, 3: second, 4: third})) == [(3, "type_changed", "k", "k"), (4, "added", "", "extra"), (4, "renamed", "Name", "name"), (4, "renamed", "x", "renamed")]


def test_other_content_is_added_and_removed(spark):
    a = [{"image_id": i, "x": i} for i in range(6)]
    b = [{"image_id": i, "y": 100 - i * i} for i in range(6)]
    assert found(files(spark, {1: a, 2: b})) == [(2, "added", "", "y"), (2, "removed", "x", "")]


def test_nulls_broken_and_empty(spark):
    a = [{"image_id": 1, "x": None}, "{broken", None, "[1]", "3", {"image_id": 2}]
    b = [{"image_id": 1, "x": 4}, {"image_id": 1, "x": 4}]
    assert found(files(spark, {1: a, 2: b, 3: ["{"], 4: b})) == []
    assert found(files(spark, {1: a}).where("false")) == []


def test_every_repeated_series_is_apart(spark):
    a = files(spark, {1: [{"image_id": 1, "x": 1}], 2: [{"image_id": 1}]})
    both = a.unionByName(a.withColumn("run_series", a["file_seq"].cast("string")))
    assert len(found(both)) == 1


def test_unified_table_casts_and_follows_renames(spark):
    a = [{"image_id": i, "logit_0": 0.5 * i, "model": "m", "split_sha256": "abc", "single_slice_patient": True} for i in range(6)]
    b = [{"image_id": str(i), "z_0": f"{0.5 * i:.1f}".replace(".", ","), "model": "m", "split_sha256": {"alg": "sha256", "hex": "abc"}, "single_slice_patient": "False"} for i in range(6)]
    c = [{"image_id": i, "z_0": [0.5 * i], "model": "m", "split_sha256": ["abc"], "single_slice_patient": 1, "n_other_train": {"value": 3}} for i in range(6)]
    rows = drift.unified(files(spark, {1: a, 2: b, 3: c})).orderBy("file_seq", "image_id").collect()
    assert len(rows) == 18
    assert [r["logit_0"] for r in rows] == [0.5 * i for i in range(6)] * 3
    assert {r["split_sha256"] for r in rows} == {"abc"}
    assert [rows[k]["single_slice_patient"] for k in (0, 6, 12)] == [True, False, True]
    assert rows[12]["n_other_train"] == 3 and rows[0]["n_other_train"] is None
    assert [f"{n}" for n in drift.FIELDS] == [c for c in drift.unified(files(spark, {1: a})).columns if c in drift.FIELDS]


def test_a_chain_of_renames_reaches_its_field(spark):
    names = ["sha_a", "sha_b", "sha_c", "sha_d", "sha_e", "split_sha256"]
    spec = {k + 1: [{"image_id": i, n: f"x{i % 3}"} for i in range(6)] for k, n in enumerate(names)}
    rows = drift.unified(files(spark, spec)).collect()
    assert len(rows) == 36 and all(r["split_sha256"] == f"x{r['image_id'] % 3}" and r["others"] is None for r in rows)


def test_other_spellings_need_no_rename(spark):
    rows = drift.unified(files(spark, {1: [{"imageId": 4, "SPLIT_SHA256": "x", "splitSha256": None}]})).collect()
    assert [(r["image_id"], r["split_sha256"]) for r in rows] == [(4, "x")]


def test_fields_beside_the_stated_ones_get_the_highest_type_seen(spark):
    a = [{"image_id": 1, "batch": 3, "ok": True, "note": "n", "t": 1, "true_class": "two", "test_fold": 2.5}]
    b = [{"image_id": 1, "batch": 4.5, "ok": None, "note": 7, "t": [2], "true_class": 2, "test_fold": "3"}]
    df = drift.unified(files(spark, {1: a, 2: b}))
    assert {f: t for f, t in df.dtypes if f in ("batch", "ok", "note", "t")} == {"batch": "double", "ok": "boolean", "note": "string", "t": "string"}
    one, two = df.orderBy("file_seq").collect()
    assert (one["batch"], two["batch"], one["ok"], two["note"], two["t"]) == (3.0, 4.5, True, "7", "2")
    assert one["true_class"] is None and one["test_fold"] is None and (two["true_class"], two["test_fold"]) == (2, 3)
    assert one["others"] == "batch=3; note=n; ok=true; t=1; test_fold=2.5; true_class=two"


def test_names_that_clash_or_are_odd_become_columns(spark):
    df = drift.unified(files(spark, {1: [{"image_id": 1, "others": 5, "Row_No": 6, "a'b": 7, "sp ace": 8, 'q"t': 9, "back\\": 10, "d.ot": 11}]}))
    row = df.collect()[0].asDict()
    assert (row["others_"], row["Row_No_"], row["a'b"], row["sp ace"], row["back\\"], row["d.ot"], row["row_no"]) == (5, 6, 7, 8, 10, 11, 0)
    assert drift.unified(files(spark, {1: ["{", None]})).count() == 0


def test_the_stronger_chain_of_renames_wins():
    assert drift.standing_for(["z", "y", "Logit_0"], [("logit_0", "z", 5), ("z", "stem", 2), ("y", "z", 1)]) == {"z": "logit_0", "y": "logit_0", "Logit_0": "logit_0"}
