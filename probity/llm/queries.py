"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import encode, groups, mixing, neighbours, overlap, truncated

_PLAIN_IMAGE = r"try_cast(nullif(regexp_extract(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '^(?:.*/)?0*([0-9]{{1,18}})(?:\.mat|\.0+)?$', 1), '') AS BIGINT)"
_BARE = r"upper(regexp_replace({0}, '[\s\-]', '', 'g'))"
_PLAIN_ID = rf"nullif(CASE WHEN regexp_full_match({_BARE}, '[0-9]+') THEN regexp_replace({_BARE}, '^0+([0-9])', '\1') ELSE {_BARE} END, '')"
_IDS = _PLAIN_ID.format("patient_id")
_STEMS = r"regexp_replace(coalesce(" + _PLAIN_ID.format("stem") + ", " + _IDS + r"), '^(MR[0-9]{6})[A-Z]$', '\1')"

P3_SQL = f"""
WITH RECURSIVE m AS (
  SELECT {_PLAIN_IMAGE.format('image_a')} AS a, {_PLAIN_IMAGE.format('image_b')} AS b
  FROM near_duplicate_candidates WHERE ncc_full >= 0.99 AND NOT isnan(ncc_full)),
e AS (SELECT a AS u, b AS v FROM m WHERE a <> b UNION SELECT b, a FROM m WHERE a <> b),
walk AS (SELECT u AS vertex, u AS far FROM e UNION SELECT w.vertex, e.v FROM walk w JOIN e ON w.far = e.u)
SELECT min(far) AS group_id, vertex AS image_id FROM walk GROUP BY vertex"""

P2_SQL = f"""
WITH RECURSIVE mp AS (SELECT {_IDS} AS pid, {_STEMS} AS plain, fold_minmove FROM proposed_pid_to_stem_mapping),
t AS (SELECT pid, 'stem ' || plain AS entity FROM mp WHERE pid IS NOT NULL AND plain IS NOT NULL
  UNION SELECT {_IDS}, 'image ' || image_id FROM fixed_test_fold4 WHERE patient_id IS NOT NULL AND image_id IS NOT NULL),
e AS (SELECT DISTINCT x.pid AS u, y.pid AS v FROM t x JOIN t y USING (entity) WHERE x.pid IS NOT NULL AND y.pid IS NOT NULL),
walk AS (SELECT u AS pid, u AS far FROM e UNION SELECT w.pid, e.v FROM walk w JOIN e ON w.far = e.u),
f AS (SELECT DISTINCT pid, fold_minmove FROM mp WHERE fold_minmove IS NOT NULL AND pid IS NOT NULL)
SELECT DISTINCT x.pid AS patient_a, y.pid AS patient_b
FROM walk w JOIN f x ON x.pid = w.pid JOIN f y ON y.pid = w.far
WHERE x.pid < y.pid AND x.fold_minmove <> y.fold_minmove"""


_P1_PAIRS = """
WITH seen AS (SELECT image_id, max(raw_array_hash) AS h1, max(canonical_image_hash) AS h2, max(display_hash) AS h3, max(thumb) AS thumb
  FROM image_manifest WHERE readable GROUP BY image_id),
x AS (SELECT image_id, unnest(thumb)::DOUBLE AS v, generate_subscripts(thumb, 1) AS k FROM seen WHERE thumb IS NOT NULL),
m AS (SELECT image_id, avg(v) AS mean, sqrt(var_pop(v) * count(*)) AS norm FROM x GROUP BY image_id),
u AS MATERIALIZED (SELECT x.image_id, list((v - mean) / norm ORDER BY k) AS u FROM x JOIN m USING (image_id) WHERE norm > 1e-9 GROUP BY x.image_id),
h AS (SELECT * FROM seen WHERE image_id IN (SELECT image_id FROM fixed_test_fold4)),
t AS (SELECT * FROM seen WHERE image_id IN (SELECT image_id FROM train_fold4)),
p AS (
  SELECT image_id AS a, image_id AS b FROM h WHERE image_id IN (SELECT image_id FROM t)
  UNION SELECT h.image_id, t.image_id FROM h JOIN t ON h.h1 = t.h1
  UNION SELECT h.image_id, t.image_id FROM h JOIN t ON h.h2 = t.h2
  UNION SELECT h.image_id, t.image_id FROM h JOIN t ON h.h3 = t.h3
  UNION SELECT x.image_id, y.image_id FROM u x JOIN u y ON list_inner_product(x.u, y.u) >= 0.97
  WHERE x.image_id IN (SELECT image_id FROM h) AND y.image_id IN (SELECT image_id FROM t))"""
P1_SQL = f"{_P1_PAIRS} SELECT DISTINCT least(a, b) AS image_a, greatest(a, b) AS image_b FROM p"


P1_COUNTS_SQL = f"""{_P1_PAIRS}, pr AS (SELECT DISTINCT a AS held, b FROM p),
st AS (SELECT {_IDS} AS pid, min({_STEMS}) AS stem FROM proposed_pid_to_stem_mapping GROUP BY 1),
sf AS (SELECT {_PLAIN_ID.format('stem')} AS stem, bool_or(spans_folds) AS spans_folds FROM stem_table GROUP BY 1),
h0 AS (SELECT DISTINCT image_id AS held, eval_set, {_IDS} AS pid FROM fixed_test_fold4),
h1 AS (SELECT DISTINCT held, eval_set, stem, spans_folds FROM h0 LEFT JOIN st USING (pid) LEFT JOIN sf USING (stem))
SELECT eval_set, stem, spans_folds, count(*) AS n_pairs, count(DISTINCT held) AS n_images FROM pr JOIN h1 USING (held) GROUP BY ALL"""

P5_SQL = """
WITH seen AS (SELECT image_id, max(thumb) AS thumb FROM image_manifest WHERE thumb IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id),
x AS (SELECT image_id, unnest(thumb)::DOUBLE AS v, generate_subscripts(thumb, 1) AS k FROM seen),
m AS (SELECT image_id, avg(v) AS mean, sqrt(var_pop(v) * count(*)) AS norm FROM x GROUP BY image_id),
u AS MATERIALIZED (SELECT x.image_id, list((v - mean) / norm ORDER BY k) AS u FROM x JOIN m USING (image_id) WHERE norm > 1e-9 GROUP BY x.image_id),
s AS (SELECT a.image_id AS a, b.image_id AS b, round(list_inner_product(a.u, b.u), 6) AS sim FROM u a JOIN u b ON a.image_id <> b.image_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM s WHERE sim >= 0.8)
SELECT DISTINCT least(a, b) AS image_a, greatest(a, b) AS image_b FROM r WHERE n <= 5"""

P5_NN_SQL = f"""
WITH seen AS (SELECT image_id, max(thumb) AS thumb FROM image_manifest WHERE thumb IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id),
x AS (SELECT image_id, unnest(thumb)::DOUBLE AS v, generate_subscripts(thumb, 1) AS k FROM seen),
m AS (SELECT image_id, avg(v) AS mean, sqrt(var_pop(v) * count(*)) AS norm FROM x GROUP BY image_id),
u AS MATERIALIZED (SELECT x.image_id, list((v - mean) / norm ORDER BY k) AS u FROM x JOIN m USING (image_id) WHERE norm > 1e-9 GROUP BY x.image_id),
w AS (SELECT image_id, min({_IDS}) AS patient_id FROM image_manifest GROUP BY 1),
o AS MATERIALIZED (SELECT u.*, patient_id FROM u JOIN w USING (image_id)),
s AS (SELECT a.image_id, a.patient_id = b.patient_id AS same, round(list_inner_product(a.u, b.u), 6) AS sim FROM o a JOIN o b ON a.image_id <> b.image_id WHERE a.image_id % 50 = 0),
t AS (SELECT image_id, max(sim) FILTER (same) AS best_same_patient_thumb_ncc, max(sim) FILTER (NOT same) AS best_other_patient_thumb_ncc FROM s GROUP BY 1)
SELECT image_id, patient_id, best_same_patient_thumb_ncc, best_other_patient_thumb_ncc FROM o LEFT JOIN t USING (image_id) WHERE image_id % 50 = 0"""


def queries() -> dict:
    return {
        "p1_found": overlap.p1_found,
        "p1_counts": overlap.p1_counts,
        "p2_found": groups.p2_found,
        "p2_splits": groups.p2_splits,
        "p2_balance": groups.p2_balance,
        "p3_found": groups.p3_found,
        "p3_group_sizes": groups.p3_group_sizes,
        "p5_found": neighbours.p5_found,
        "p5_nn_similarity": neighbours.p5_nn_similarity,
        "p6_ids": encode.p6_ids,
        "p6_fertility": encode.p6_fertility,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p7_deviation": mixing.p7_deviation,
        "p7_filled_shares": mixing.p7_filled_shares,
        "p8_found": truncated.p8_found,
        "p8_rates": truncated.p8_rates,
        "p8_rules": truncated.p8_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p1_counts": P1_COUNTS_SQL,
        "p2_found": P2_SQL,
        "p3_found": P3_SQL,
        "p5_found": P5_SQL,
        "p5_nn_similarity": P5_NN_SQL,
        "p3_group_sizes": f"SELECT n_images, count(*) AS n_groups FROM (SELECT group_id, count(*) AS n_images FROM ({P3_SQL}) GROUP BY group_id) GROUP BY n_images",
    }
