"""Schemas that drift between files (problem 4).

The input is a table of raw records, one JSON object a row, each belonging to a file of a series. Every
file's header (its top-level names and the kinds of their values) is read in parallel; headers of
consecutive files are compared, and all headers are folded through a type-promotion lattice into one schema.

The union schema has the fields stated in FIELDS, with their types, and every other field in the highest type of
the lattice that occurs. A name stands for the field with the same letters (case and underscores apart) or else for the
field that it is linked to by renames, over any number of them. Every record is cast to that schema; what stands for
no stated field, and values that don't fit their type, are kept as text beside it and counted.

Defined cases: a record that is no JSON object is not readable and is left out; a name whose values are all
null has no kind, so it can be added, removed or renamed but never type_changed; a file without a readable
record is passed over; repeated rows count once; an empty table gives no rows. Names are compared with their
case; their number is not limited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut, table

#: The lattice: a field's type is the highest of the kinds seen.
LATTICE = {"boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}

#: The kinds as bits, in the order in which several are named; both kinds of numbers are called number.
BITS = {"array": 1, "boolean": 2, "number": 4 | 8, "object": 16, "string": 32}
_INTEGER, _DOUBLE = 4, 8

#: The table's fields and types, in order.
FIELDS = {
    "model": "string", "arm": "string", "image_id": "bigint", "patient_id": "string", "protocol": "string",
    "test_fold": "int", "true_class": "int", "true_class_name": "string", "prob_0": "double", "prob_1": "double",
    "prob_2": "double", "pred_class": "int", "pred_class_name": "string", "confidence": "double",
    "experiment_input_commit": "string", "logit_0": "double", "logit_1": "double", "logit_2": "double",
    "n_other_total": "int", "n_other_train": "int", "frac_other_train": "double", "single_slice_patient": "boolean",
    "has_same_patient_train_slice": "boolean", "stem": "string", "split_sha256": "string",
}

_SERIES, _SEQ = "run_series", "file_seq"


def _plain(value: str) -> F.Column:
    """A variant column as plain text."""
    inner = F.expr(f"""CASE WHEN {value} IS NULL THEN NULL WHEN schema_of_variant({value}) LIKE 'OBJECT%' THEN coalesce(try_variant_get({value}, '$.value', 'string'), try_variant_get({value}, '$.hex', 'string'), to_json({value}))
        WHEN schema_of_variant({value}) LIKE 'ARRAY%' THEN coalesce(try_variant_get({value}, '$[0]', 'string'), to_json({value})) ELSE try_variant_get({value}, '$', 'string') END""")
    return F.when(inner.rlike("^(?i:true|false)$"), F.lower(inner)).when(inner.rlike("^-?[0-9]+,[0-9]+$"), F.replace(inner, F.lit(","), F.lit("."))).otherwise(inner)


def _exploded(files: DataFrame, key: str) -> DataFrame:
    """One row a field of a readable record: field, value (a variant) and bit, its kind (0 for null).

    Where files has a column names, an array, only those fields are taken.
    """
    wanted = "names" in files.columns
    # what is no object has no fields, so it needs no filter, which would parse every record once more
    records = files.select(_SERIES, _SEQ, "row_no", *(["names"] if wanted else []), F.try_parse_json("record").alias("v"))
    flat = files.sparkSession.sql(
        f"""SELECT r.{_SERIES}, r.{_SEQ}, r.row_no, coalesce(try_variant_get(r.v, '$.{key}', 'string'), concat('#', r.row_no)) AS row_key,
               f.key AS field, schema_of_variant(f.value) AS shape, f.value AS value
            FROM {{r}} r, LATERAL variant_explode(r.v) f WHERE f.key IS NOT NULL {"AND array_contains(r.names, f.key)" if wanted else ""}""", r=records)
    shape = F.col("shape")
    bit = (F.when(shape == "VOID", 0).when(shape == "STRING", BITS["string"]).when(shape == "BOOLEAN", BITS["boolean"]).when(shape == "BIGINT", _INTEGER)
           .when(shape.startswith("ARRAY"), BITS["array"]).when(shape.startswith("OBJECT"), BITS["object"]).when(shape.endswith(",0)"), _INTEGER).otherwise(_DOUBLE))
    return flat.withColumn("bit", bit).drop("shape")


def _kinds(bits: F.Column) -> F.Column:
    """The kinds among the bits, joined by |; null without any."""
    return F.nullif(F.concat_ws("|", *(F.when(bits.bitwiseAND(F.lit(b)) != 0, kind) for kind, b in BITS.items())), F.lit(""))


def read_fields(files: DataFrame, key: str = "image_id") -> DataFrame:
    """(run_series, file_seq, row_key, field, kind, content): one row a field of a readable record.

    content is the value written plainly: the one value of a list, an object's "value" or "hex", a decimal
    comma as a point, booleans in lower case. row_key is the record's key, or its row number without one.
    """
    return _exploded(files, key).select(_SERIES, _SEQ, "row_no", "row_key", "field", _kinds(F.col("bit")).alias("kind"), _plain("value").alias("content"))


def headers(files: DataFrame) -> DataFrame:
    """(run_series, file_seq, field, kind, bits): each file's names and kinds."""
    return _exploded(files, "image_id").groupBy(_SERIES, _SEQ, "field").agg(F.bit_or("bit").alias("bits")).withColumn("kind", _kinds(F.col("bits")))


def renames(fields: DataFrame, gone: DataFrame, come: DataFrame, least: float = 0.8, noise: float = 0.1) -> DataFrame:
    """(run_series, file_seq, old_field, new_field): a removed and an added name with the same content.

    Contents are compared on the rows that both files have. They are the same if at least `least` of the
    values are equal, or, for fractional numbers, which a new run moves a little, if they differ on average
    by no more than `noise` of the field's own mean deviation. Each name takes part in one rename at most:
    the pair must be the best of both, by content, then by closeness of the names.
    """
    pairs = gone.join(come, [_SERIES, _SEQ])
    values = fields.where("content is not null").groupBy(_SERIES, _SEQ, "field", "row_key").agg(F.min("content").alias("content"))
    old = values.select(_SERIES, F.col(_SEQ).alias("prev_seq"), F.col("field").alias("old_field"), "row_key", F.col("content").alias("x"))
    new = values.select(_SERIES, _SEQ, F.col("field").alias("new_field"), "row_key", F.col("content").alias("y"))
    both = pairs.join(old, [_SERIES, "prev_seq", "old_field"]).join(new, [_SERIES, _SEQ, "new_field", "row_key"])
    nx, ny = F.col("x").try_cast("double"), F.col("y").try_cast("double")
    group = [_SERIES, _SEQ, "old_field", "new_field"]
    both = both.withColumns({"nx": nx, "ny": ny, "same": F.coalesce(F.abs(nx - ny) < 1e-9, F.col("x") == F.col("y"))})
    stats = both.groupBy(*group).agg(
        F.avg(F.col("same").cast("double")).alias("equal"), F.avg(F.abs(F.col("nx") - F.col("ny"))).alias("apart"),
        F.stddev_pop("nx").alias("spread"), F.bool_and(F.coalesce(F.col("nx").isNotNull() & F.col("ny").isNotNull(), F.lit(False))).alias("numeric"),
        F.bool_or(F.coalesce(F.col("nx") != F.floor("nx"), F.lit(False))).alias("fractional"))
    near = F.when(F.col("numeric") & F.col("fractional") & (F.col("spread") > 0), 1 - F.col("apart") / F.col("spread")).otherwise(F.lit(0.0))
    plain = lambda c: F.regexp_replace(F.lower(c), "_", "")
    scored = stats.withColumns({
        "score": F.round(F.greatest("equal", near), 3),
        "close": 1 - F.levenshtein(plain("old_field"), plain("new_field")) / F.greatest(F.length("old_field"), F.length("new_field")),
    }).where((F.col("equal") >= least) | (near >= 1 - noise))
    by_old = Window.partitionBy(_SERIES, _SEQ, "old_field").orderBy(F.desc("score"), F.desc("close"), "new_field")
    by_new = Window.partitionBy(_SERIES, _SEQ, "new_field").orderBy(F.desc("score"), F.desc("close"), "old_field")
    ranked = scored.withColumns({"ro": F.row_number().over(by_old), "rn": F.row_number().over(by_new)})
    return ranked.where("ro = 1 and rn = 1").select(*group)


def compare(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Headers of the files, what differs between consecutive ones, the names that came, and the renames.

    Headers need names and kinds only. Contents are read in a second pass, of the files alone in which one
    name went and another came, and of the files before them.
    """
    here = cut(headers(files))
    after = here.select(_SERIES, _SEQ).distinct().withColumn("prev_seq", F.lag(_SEQ).over(Window.partitionBy(_SERIES).orderBy(_SEQ))).where("prev_seq is not null")
    then = here.select(_SERIES, F.col(_SEQ).alias("prev_seq"), "field", F.col("kind").alias("old_kind"), F.lit(True).alias("in_old")).join(after, [_SERIES, "prev_seq"])
    now = here.join(after.select(_SERIES, _SEQ), [_SERIES, _SEQ]).select(_SERIES, _SEQ, "field", "kind", F.lit(True).alias("in_new"))
    differ = cut(now.join(then, [_SERIES, _SEQ, "field"], "full").where("in_old is null or in_new is null or kind != old_kind"))
    come = differ.where("in_old is null").select(_SERIES, _SEQ, F.col("field").alias("new_field"))
    gone = differ.where("in_new is null").select(_SERIES, _SEQ, "prev_seq", F.col("field").alias("old_field"))
    touched = gone.join(come, [_SERIES, _SEQ], "left_semi")
    near = touched.select(_SERIES, F.col("prev_seq").alias(_SEQ), F.col("old_field").alias("field")).unionByName(
        come.join(touched, [_SERIES, _SEQ], "left_semi").select(_SERIES, _SEQ, F.col("new_field").alias("field"))).groupBy(_SERIES, _SEQ).agg(F.collect_set("field").alias("names"))  # the names of one file
    contents = read_fields(files.drop("names").join(near, [_SERIES, _SEQ]))
    return here, differ, come, cut(renames(cut(contents), touched, come))


def changes(files: DataFrame) -> DataFrame:
    """(run_series, file_seq, change_kind, old_field, new_field): each file against the one before it."""
    _, differ, come, moved = compare(files)
    gone = differ.where("in_new is null").select(_SERIES, _SEQ, F.col("field").alias("old_field"))
    as_row = lambda df, kind, old, new: df.select(_SERIES, _SEQ, F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    none = F.lit("")
    return (
        as_row(moved, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(as_row(come.join(moved, [_SERIES, _SEQ, "new_field"], "left_anti"), "added", none, F.col("new_field")))
        .unionByName(as_row(gone.join(moved, [_SERIES, _SEQ, "old_field"], "left_anti"), "removed", F.col("old_field"), none))
        .unionByName(as_row(differ.where("kind != old_kind"), "type_changed", F.col("field"), F.col("field")))
    )


def p4_found(spark, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "retrain_files"))


def p4_schema(spark, sf_dir: str) -> DataFrame:
    """(field, kinds, type, n_uses): all headers folded through the lattice; n_uses counts files once a kind."""
    rank = F.lit(0)
    for kind, level in LATTICE.items():
        rank = F.when(F.col("kind") == kind, F.lit(level)).otherwise(rank)
    seen = read_fields(table(spark, sf_dir, "retrain_files")).groupBy("field", "kind").agg(F.countDistinct(_SERIES, _SEQ).alias("n"))
    top = {v: k for k, v in LATTICE.items()}
    folded = seen.withColumn("level", rank).groupBy("field").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.max("level").alias("level"), F.sum("n").alias("n_uses"))
    name = F.lit("null")
    for level, kind in top.items():
        name = F.when(F.col("level") == level, F.lit(kind)).otherwise(name)
    return folded.select("field", "kinds", name.alias("type"), "n_uses")


def standing_for(names: list[str], links: list[tuple[str, str, int]]) -> dict[str, str]:
    """The field each name stands for: by its letters, else over the strongest chain of renames, ties by field; else its own letters.

    A chain is as strong as its rarest rename. names and links are those of the schemas, not of the data.
    """
    letters = lambda n: n.lower().replace("_", "")
    spelled = {letters(f): f for f in FIELDS}
    reached = {n: {spelled[letters(n)]: 1 << 60} for n in {*names, *FIELDS} if letters(n) in spelled}
    fixed, todo = set(reached), list(reached)
    while todo:
        old = todo.pop()
        for new, n in [(b, n) for a, b, n in links if a == old] + [(a, n) for a, b, n in links if b == old]:
            for field, strength in list(reached[old].items()):
                if new not in fixed and min(n, strength) > reached.setdefault(new, {}).get(field, 0):
                    reached[new][field] = min(n, strength)
                    todo.append(new)
    own = {letters(n): n for n in sorted(names, reverse=True)}
    return {n: min(reached[n], key=lambda f: (-reached[n][f], f)) if n in reached else own[letters(n)] for n in names}


def union_schema(files: DataFrame) -> tuple[dict[str, list[str]], dict[str, str]]:
    """The names of each field, its own first, and its type: all headers folded through the lattice.

    The driver gets one row a name and one a pair of names that were renamed into each other.
    """
    here, _, _, moved = compare(files)
    bits = {r["field"]: r["bits"] for r in here.groupBy("field").agg(F.bit_or("bits").alias("bits")).collect()}
    links = [tuple(r) for r in moved.groupBy("old_field", "new_field").count().collect()]
    names: dict[str, list[str]] = {f: [f] for f in FIELDS}
    folded: dict[str, int] = {}
    for name, field in sorted(standing_for(list(bits), links).items()):
        if name != field or field not in FIELDS:
            names.setdefault(field, []).append(name)
        folded[field] = folded.get(field, 0) | bits[name]
    highest = lambda b: "string" if b & (BITS["array"] | BITS["object"] | BITS["string"]) or not b else "double" if b & _DOUBLE else "bigint" if b & _INTEGER else "boolean"
    return names, {f: FIELDS.get(f) or highest(folded.get(f, 0)) for f in names}


def _cast(text: F.Column, to: str) -> F.Column:
    """Text as a type; null where it does not fit."""
    if to == "boolean":
        return F.when(text.isin("1", "1.0"), F.lit(True)).when(text.isin("0", "0.0"), F.lit(False)).otherwise(text.try_cast("boolean"))
    if to in ("int", "bigint"):
        number = text.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number.try_cast(to))
    return text.try_cast(to)


def unified(files: DataFrame) -> DataFrame:
    """Every readable record once in the union schema: FIELDS, the other fields, and `others`, what is in no column of FIELDS.

    others lists, as name=value by name, the values of fields that are not stated and the values that do not
    fit their field's type, which are null in their columns.
    """
    names, types = union_schema(files)
    records = files.where("record is not null").groupBy(_SERIES, _SEQ, "row_no").agg(F.max("record").alias("record"))
    records = records.select(_SERIES, _SEQ, "row_no", F.try_parse_json("record").alias("v")).where(F.expr("v is not null and schema_of_variant(v) like 'OBJECT%'"))
    quoted = lambda n: n.replace("\\", "\\\\").replace("'", "\\'")
    # a path cannot hold a name with a quote
    one = lambda n: f"""try_variant_get(v, '$["{quoted(n)}"]', 'variant')""" if '"' not in n else f"try_element_at(try_variant_get(v, '$', 'map<string,variant>'), '{quoted(n)}')"
    first = lambda ns: F.expr(one(ns[0]) if len(ns) == 1 else "coalesce(" + ", ".join(f"if(is_variant_null({one(n)}), null, {one(n)})" for n in ns) + ")")
    wide = records.select(_SERIES, _SEQ, "row_no", *(first(ns).alias(f"v{i}") for i, ns in enumerate(names.values())))
    wide = wide.select(_SERIES, _SEQ, "row_no", *(_plain(f"v{i}").alias(f"t{i}") for i in range(len(names))))
    wide = wide.select("*", *(_cast(F.col(f"t{i}"), types[f]).alias(f"c{i}") for i, f in enumerate(names)))
    rest = [F.when(F.col(f"c{i}").isNull() if f in FIELDS else F.lit(True), F.concat(F.lit(f"{f}="), f"t{i}")) for i, f in enumerate(names)]
    others = F.nullif(F.array_join(F.array_sort(F.array_compact(F.array(*rest))), "; "), F.lit(""))
    taken = {_SERIES, _SEQ, "row_no", "others"}
    as_column = [f"{f}_" if f.lower() in taken else f for f in names]
    return wide.select(_SERIES, _SEQ, "row_no", *(F.col(f"c{i}").alias(c) for i, c in enumerate(as_column)), others.alias("others"))


def p4_table(spark, sf_dir: str) -> DataFrame:
    """The fields of FIELDS with their types, and in `others` all that is in none of them."""
    return unified(table(spark, sf_dir, "retrain_files")).select(_SERIES, _SEQ, "row_no", *FIELDS, "others")


def p4_others(spark, sf_dir: str) -> DataFrame:
    """(name, n_records, n_values): the values that no column of FIELDS holds, by name: fields that are not stated, values that do not fit."""
    rest = cut(unified(table(spark, sf_dir, "retrain_files")).select("others")).where("others is not null").select(F.explode(F.split("others", "; ")).alias("z"))
    return rest.groupBy(F.split_part("z", F.lit("="), F.lit(1)).alias("name")).agg(F.count("*").alias("n_records"), F.countDistinct("z").alias("n_values"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_schema": p4_schema, "p4_table": p4_table, "p4_others": p4_others}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_FIELDS_SQL = """rj AS (SELECT run_series, file_seq, row_no, record AS j FROM retrain_files WHERE json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record ELSE '0' END) = 'OBJECT'),
fk AS (SELECT *, coalesce(json_extract_string(j, '$.image_id'), '#' || row_no) AS row_key, unnest(json_keys(j)) AS field FROM rj),
fv AS (SELECT run_series, file_seq, row_key, field, json_extract(j, '$."' || field || '"') AS v FROM fk),
ft AS (SELECT *, json_type(v) AS t, CASE json_type(v) WHEN 'OBJECT' THEN coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.hex'), v::VARCHAR) WHEN 'ARRAY' THEN coalesce(json_extract_string(v, '$[0]'), v::VARCHAR) ELSE json_extract_string(v, '$') END AS c FROM fv),
fields AS MATERIALIZED (SELECT run_series, file_seq, row_key, field, CASE t WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
  CASE WHEN regexp_full_match(c, '(?i:true|false)') THEN lower(c) WHEN regexp_full_match(c, '-?[0-9]+,[0-9]+') THEN replace(c, ',', '.') ELSE c END AS content FROM ft)"""

_MOVED_SQL = f"""{_FIELDS_SQL},
nm AS (SELECT run_series, file_seq, field, nullif(coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), '|'), ''), '') AS kind FROM fields GROUP BY 1, 2, 3),
bf AS (SELECT *, lag(file_seq) OVER (PARTITION BY run_series ORDER BY file_seq) AS prev_seq FROM (SELECT DISTINCT run_series, file_seq FROM nm)),
hr AS (SELECT nm.*, prev_seq FROM nm JOIN bf USING (run_series, file_seq)),
cm AS (SELECT run_series, file_seq, field AS new_field FROM hr h WHERE prev_seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nm p WHERE p.run_series = h.run_series AND p.file_seq = h.prev_seq AND p.field = h.field)),
gn AS (SELECT b.run_series, b.file_seq, b.prev_seq, p.field AS old_field FROM bf b JOIN nm p ON p.run_series = b.run_series AND p.file_seq = b.prev_seq WHERE NOT EXISTS (SELECT 1 FROM nm h WHERE h.run_series = b.run_series AND h.file_seq = b.file_seq AND h.field = p.field)),
vl AS (SELECT run_series, file_seq, field, row_key, min(content) AS content FROM fields WHERE content IS NOT NULL GROUP BY 1, 2, 3, 4),
bo AS (SELECT g.run_series, g.file_seq, old_field, new_field, x.content AS x, y.content AS y, try_cast(x.content AS DOUBLE) AS nx, try_cast(y.content AS DOUBLE) AS ny FROM gn g JOIN cm c ON c.run_series = g.run_series AND c.file_seq = g.file_seq
  JOIN vl x ON x.run_series = g.run_series AND x.file_seq = g.prev_seq AND x.field = old_field JOIN vl y ON y.run_series = g.run_series AND y.file_seq = g.file_seq AND y.field = new_field AND y.row_key = x.row_key),
st AS (SELECT run_series, file_seq, old_field, new_field, avg(coalesce(abs(nx - ny) < 1e-9, x = y)::INT) AS equal, avg(abs(nx - ny)) AS apart, stddev_pop(nx) AS spread, bool_and(nx IS NOT NULL AND ny IS NOT NULL) AS num, bool_or(coalesce(nx <> floor(nx), false)) AS frac FROM bo GROUP BY 1, 2, 3, 4),
sc AS (SELECT *, CASE WHEN num AND frac AND spread > 0 THEN 1 - apart / spread ELSE 0 END AS near, 1 - levenshtein(replace(lower(old_field), '_', ''), replace(lower(new_field), '_', ''))::DOUBLE / greatest(length(old_field), length(new_field)) AS close FROM st),
ok AS (SELECT *, round(greatest(equal, near), 3) AS score FROM sc WHERE equal >= 0.8 OR near >= 0.9),
mv AS (SELECT run_series, file_seq, old_field, new_field FROM ok QUALIFY row_number() OVER (PARTITION BY run_series, file_seq, old_field ORDER BY score DESC, close DESC, new_field) = 1
  AND row_number() OVER (PARTITION BY run_series, file_seq, new_field ORDER BY score DESC, close DESC, old_field) = 1)"""

FOUND_SQL = f"""WITH RECURSIVE {_MOVED_SQL}
SELECT run_series, file_seq, 'renamed' AS change_kind, old_field, new_field FROM mv
UNION ALL SELECT run_series, file_seq, 'added', '', new_field FROM cm ANTI JOIN mv USING (run_series, file_seq, new_field)
UNION ALL SELECT run_series, file_seq, 'removed', old_field, '' FROM gn ANTI JOIN mv USING (run_series, file_seq, old_field)
UNION ALL SELECT h.run_series, h.file_seq, 'type_changed', h.field, h.field FROM hr h JOIN nm p ON p.run_series = h.run_series AND p.file_seq = h.prev_seq AND p.field = h.field WHERE h.kind <> p.kind"""

SCHEMA_SQL = f"""WITH {_FIELDS_SQL}, s AS (SELECT field, kind, count(DISTINCT (run_series, file_seq)) AS n, CASE kind WHEN 'boolean' THEN 1 WHEN 'number' THEN 2 WHEN 'string' THEN 3 WHEN 'array' THEN 4 WHEN 'object' THEN 5 ELSE 0 END AS level FROM fields GROUP BY ALL)
SELECT field, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), '|'), '') AS kinds, (['null', 'boolean', 'number', 'string', 'array', 'object'])[max(level) + 1] AS type, sum(n)::BIGINT AS n_uses FROM s GROUP BY field"""


_COLUMN = {"boolean": "CASE WHEN c IN ('1', '1.0') THEN true WHEN c IN ('0', '0.0') THEN false ELSE try_cast(c AS BOOLEAN) END", "double": "try_cast(c AS DOUBLE)", "string": "c"}
_WHOLE = "CASE WHEN try_cast(c AS DECIMAL(38, 6)) = floor(try_cast(c AS DECIMAL(38, 6))) THEN try_cast(try_cast(c AS DECIMAL(38, 6)) AS {0}) END"


def table_sql() -> str:
    """CTEs ending in wide, the table of p4_table without the records that have no field."""
    column = lambda t: _COLUMN.get(t) or _WHOLE.format({"int": "INTEGER", "bigint": "BIGINT"}[t])
    values = ", ".join(f"max({column(t)}) FILTER (field = '{f}') AS {f}" for f, t in FIELDS.items())
    unfit = " ".join(f"WHEN '{f}' THEN ({column(t)}) IS NULL" for f, t in FIELDS.items())
    return f"""WITH RECURSIVE {_MOVED_SQL},
stated AS (SELECT unnest([{', '.join(f"'{f}'" for f in FIELDS)}]) AS field),
names AS (SELECT DISTINCT field AS name FROM fields),
spelled AS (SELECT name, field FROM names JOIN stated ON replace(lower(name), '_', '') = replace(lower(field), '_', '')),
lk AS (SELECT a, b, sum(n) AS n FROM (SELECT old_field AS a, new_field AS b, count(*) AS n FROM mv GROUP BY ALL UNION ALL SELECT new_field, old_field, count(*) FROM mv GROUP BY ALL) GROUP BY ALL),
reach AS (SELECT name, field, 1000000000::BIGINT AS s FROM spelled UNION SELECT l.b, r.field, least(r.s, l.n)::BIGINT FROM reach r JOIN lk l ON l.a = r.name WHERE l.b NOT IN (SELECT name FROM spelled)),
alias AS (SELECT name, field FROM reach QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, field) = 1),
one AS (SELECT run_series, file_seq, row_no, max(record) AS j FROM retrain_files WHERE record IS NOT NULL GROUP BY ALL),
rd AS (SELECT * FROM one WHERE json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j ELSE '0' END) = 'OBJECT'),
kv AS (SELECT *, unnest(json_keys(j)) AS name FROM rd),
vv AS (SELECT run_series, file_seq, row_no, name, json_extract(j, '$."' || name || '"') AS v FROM kv),
tt AS (SELECT run_series, file_seq, row_no, name, CASE json_type(v) WHEN 'OBJECT' THEN coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.hex'), v::VARCHAR) WHEN 'ARRAY' THEN coalesce(json_extract_string(v, '$[0]'), v::VARCHAR) ELSE json_extract_string(v, '$') END AS c FROM vv WHERE json_type(v) <> 'NULL'),
cc AS (SELECT tt.* EXCLUDE (c), coalesce(field, min(CASE WHEN field IS NULL THEN name END) OVER (PARTITION BY replace(lower(name), '_', ''))) AS field, CASE WHEN regexp_full_match(c, '(?i:true|false)') THEN lower(c) WHEN regexp_full_match(c, '-?[0-9]+,[0-9]+') THEN replace(c, ',', '.') ELSE c END AS c FROM tt LEFT JOIN alias USING (name)),
pk AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY run_series, file_seq, row_no, field ORDER BY name <> field, name) = 1),
wide AS (SELECT run_series, file_seq, row_no, {values}, string_agg(field || '=' || c, '; ' ORDER BY field || '=' || c) FILTER (CASE field {unfit} ELSE true END) AS others FROM pk GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": FOUND_SQL, "p4_schema": SCHEMA_SQL, "p4_table": f"{table_sql()} SELECT rd.run_series, rd.file_seq, rd.row_no, wide.* EXCLUDE (run_series, file_seq, row_no) FROM rd LEFT JOIN wide USING (run_series, file_seq, row_no)",
        "p4_others": f"{table_sql()}, z AS (SELECT unnest(string_split(others, '; ')) AS z FROM wide WHERE others IS NOT NULL) SELECT split_part(z, '=', 1) AS name, count(*) AS n_records, count(DISTINCT z) AS n_values FROM z GROUP BY 1",
    }
