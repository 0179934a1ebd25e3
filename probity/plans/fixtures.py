"""Evaluation frames derived from the `events` table: units, folds, predictions and cluster draws.

A unit is an event, its cluster the user; one class a cluster. Predictions come from four models under two
protocols, A (folds by cluster) and B (folds by row, with A's fold and class margins). Every draw is a
deterministic hash. The SQL texts say the same in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import P, argmax, h
from ..functions.ranks import group_rank
from ..functions.session import cut, table

MODELS, ARMS = ("m0", "m1", "m2", "m3"), ("A", "B")
REPS = 1000  # replicates of the registered queries; 5,000 of `draws` and of a final report


def units(spark, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    suffix = F.when(F.expr("(user_id div 3) % 2 = 0"), "").otherwise("B")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("unit_id"), user.alias("cluster_id"), (user % 3).cast("int").alias("true_class"),
        (F.expr("user_id div 3") % 5 + 1).cast("int").alias("fold_a"),
        F.when(user % 3 == 1, F.concat(F.lit("MR"), F.lpad(F.expr("user_id div 6").cast("string"), 6, "0"), suffix)).otherwise((user + 100000).cast("string")).alias("pid"))


def predictions(spark, sf_dir: str) -> DataFrame:
    """(model, arm, unit_id, cluster_id, pid, true_class, fold_a, probs, pred_class, confidence)."""
    return predicted(units(spark, sf_dir))


def predicted(split: DataFrame, *keep: str) -> DataFrame:
    """The predictions for rows of units, with columns to keep."""
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("arm"), F.lit(mi).cast("bigint").alias("mi"), F.lit(ai).cast("bigint").alias("ai"))
                               for mi, m in enumerate(MODELS) for ai, a in enumerate(ARMS))))
    rows = split.withColumn("g", grid).select("*", "g.*").drop("g")
    rows = rows.withColumns({f"w{k}": x for k, x in enumerate(_weights(F.col("mi"), F.col("ai")))})
    return rows.select("model", "arm", "unit_id", "cluster_id", "pid", "true_class", "fold_a", *keep, _probs("w0", "w1", "w2").alias("probs")).withColumns(
        {"pred_class": argmax(F.col("probs")), "confidence": F.array_max("probs")})


def _weights(mi: Column, ai: Column) -> list[Column]:
    s = mi * 10 + ai * 100
    hit = h("unit_id", s + 7) % 100 < 70 + 3 * mi + 8 * ai - h("cluster_id", s + 9) % 30
    return [1 + h("unit_id", s + 1 + k) % 97 + F.when((F.col("true_class") == k) & hit, 300).otherwise(0) for k in range(3)]


def _probs(*w: str) -> Column:
    total = F.col(w[0]) + F.col(w[1]) + F.col(w[2])
    return F.array(*(F.col(x).cast("double") / total for x in w))


def predicted_classes(split: DataFrame, frames: list[tuple[str, str]]) -> DataFrame:
    """split with p0, p1, ...: the class predicted by each of the (model, arm) frames, without a row for each of them."""
    for i, (model, arm) in enumerate(frames):
        w = {f"_w{k}": x for k, x in enumerate(_weights(F.lit(MODELS.index(model)).cast("bigint"), F.lit(ARMS.index(arm)).cast("bigint")))}
        split = split.withColumns(w).withColumn("_p", _probs(*w)).withColumn(f"p{i}", argmax(F.col("_p"))).drop(*w, "_p")
    return split


def row_folds(split: DataFrame, salt: int = 11) -> DataFrame:
    """split (unit_id, true_class, fold_a, ...) with fold_b: rows in hashed order fill A's quota of each fold and class.

    Only the last row of each quota is looked for, by counted ranges of hashes; a row's fold follows from its own
    hash and id, so that no row is shuffled.
    """
    hashed = split.withColumn("_h", h("unit_id", salt)).withColumn("_range", F.expr(f"_h div {hash_width(split.count())}L"))
    counts = cut(hashed.groupBy("true_class", "fold_a", "_range").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("true_class").orderBy("fold_a")
    quota = counts.groupBy("true_class", "fold_a").agg(F.sum("n").alias("n")).select("true_class", F.col("fold_a").alias("fold_b"), F.sum("n").over(upto).alias("upto"))  # one row a class and fold
    before = Window.partitionBy("true_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.groupBy("true_class", "_range").agg(F.sum("n").alias("n")).withColumn("_before", F.sum("n").over(before) - F.col("n"))
    ends = cut(ranges.join(F.broadcast(quota), "true_class").where("upto > _before and upto <= _before + n").select("true_class", "_range", "_before", "fold_b", "upto"))
    within = Window.partitionBy("true_class", "_range").orderBy("_h", "unit_id")
    inside = hashed.join(F.broadcast(ends.select("true_class", "_range").distinct()), ["true_class", "_range"]).select("true_class", "_range", "_h", "unit_id", F.row_number().over(within).alias("_in"))
    last = inside.join(F.broadcast(ends), ["true_class", "_range"]).where("_before + _in = upto")
    edges = cut(last.groupBy("true_class").agg(F.array_sort(F.collect_list(F.struct("_h", "unit_id", "fold_b"))).alias("_edges")))  # one entry a fold
    mine = F.struct(h("unit_id", salt).alias("_h"), F.col("unit_id"))
    fold = None
    for i in range(edges.agg(F.max(F.size("_edges"))).first()[0] or 0):
        edge = F.get(F.col("_edges"), F.lit(i))
        here = mine <= F.struct(edge["_h"].alias("_h"), edge["unit_id"].alias("unit_id"))
        fold = F.when(here, edge["fold_b"]) if fold is None else fold.when(here, edge["fold_b"])
    return split.join(F.broadcast(edges), "true_class").withColumn("fold_b", F.lit(None).cast("int") if fold is None else fold).drop("_edges")


def hash_width(n: int) -> int:
    """The width of ranges of hashes that hold about 1,000 of n rows."""
    return P // max(1, n // 1000)


def ranked_folds(ranked: DataFrame, split: DataFrame) -> DataFrame:
    """ranked (true_class, _rank, ...) with fold_b for _rank: by rank within the class, split's quota of each fold and class is filled."""
    quota = split.groupBy("true_class", "fold_a").agg(F.count("*").alias("n"))
    upto = quota.alias("q").join(quota.alias("p"), (F.col("q.true_class") == F.col("p.true_class")) & (F.col("p.fold_a") <= F.col("q.fold_a"))).groupBy(
        F.col("q.true_class").alias("true_class"), F.col("q.fold_a").alias("fold_b"), F.col("q.n").alias("n")).agg(F.sum("p.n").alias("upto"))
    wide = upto.groupBy("true_class").agg(F.array_sort(F.collect_list(F.struct("fold_b", "upto"))).alias("quotas"))  # one entry a fold
    return ranked.join(F.broadcast(wide), "true_class").withColumn(
        "fold_b", F.filter("quotas", lambda q: q["upto"] >= F.col("_rank"))[0]["fold_b"]).drop("_rank", "quotas")


def draws(clusters: DataFrame, unit: str, stratum: str, reps: int = 5000, salt: int = 2026, width: int = 1000) -> DataFrame:
    """(rep, unit, w): how often each unit is drawn, with replacement among the units of its stratum.

    clusters has one row a unit, with a BIGINT unit and a small INT stratum.
    """
    numbered = group_rank(clusters.select(unit, stratum), [stratum], unit, [], width, "ord").withColumn("ord", F.col("ord") - 1)
    sizes = numbered.groupBy(stratum).agg(F.count("*").alias("n"))  # one row a stratum
    slots = numbered.join(F.broadcast(sizes), stratum).select(stratum, "n", F.col("ord").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    hits = slots.select("rep", stratum, (h(F.col("rep").cast("bigint") * 1000003 + 3 * F.col("slot") + F.col(stratum), salt) % F.col("n")).alias("ord"))
    return hits.groupBy("rep", stratum, "ord").agg(F.count("*").alias("w")).join(numbered, [stratum, "ord"]).select("rep", unit, "w")


# the same frames in SQL

def h_sql(x: str, salt) -> str:
    a = f"((({x})::BIGINT * 48271 + ({salt})::BIGINT * 69621 + 1) % {P})"
    b = f"(({a} * 16807 + ({salt})) % {P})"
    return f"(({b} * {b} + {a}) % {P})"


UNIT_SQL = """unit AS (SELECT event_id AS unit_id, user_id AS cluster_id, (user_id % 3)::INT AS true_class, ((user_id // 3) % 5 + 1)::INT AS fold_a,
  CASE WHEN user_id % 3 = 1 THEN 'MR' || lpad((user_id // 6)::VARCHAR, 6, '0') || CASE WHEN (user_id // 3) % 2 = 0 THEN '' ELSE 'B' END
       ELSE (user_id + 100000)::VARCHAR END AS pid FROM events)"""
FOLD_B_SQL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY true_class ORDER BY {h_sql('unit_id', 11)}, unit_id) AS rnk FROM unit),
quota AS (SELECT true_class, fold_a, sum(n) OVER (PARTITION BY true_class ORDER BY fold_a) AS upto FROM (SELECT true_class, fold_a, count(*) AS n FROM unit GROUP BY 1, 2)),
split AS (SELECT r.*, (SELECT min(q.fold_a) FROM quota q WHERE q.true_class = r.true_class AND q.upto >= r.rnk) AS fold_b FROM ranked r)"""
_W = ", ".join(f"1 + {h_sql('unit_id', f's + {1 + k}')} % 97 + CASE WHEN true_class = {k} AND hit THEN 300 ELSE 0 END AS w{k}" for k in range(3))
PRED_SQL = f"""{UNIT_SQL}, grid AS (SELECT 'm' || mi AS model, CASE ai WHEN 0 THEN 'A' ELSE 'B' END AS arm, mi, ai, 10 * mi + 100 * ai AS s FROM range(4) a(mi), range(2) b(ai)),
hits AS (SELECT u.*, g.*, {h_sql('unit_id', 's + 7')} % 100 < 70 + 3 * mi + 8 * ai - {h_sql('cluster_id', 's + 9')} % 30 AS hit FROM unit u, grid g),
weights AS (SELECT *, {_W} FROM hits),
probs AS (SELECT *, w0::DOUBLE / (w0 + w1 + w2) AS p0, w1::DOUBLE / (w0 + w1 + w2) AS p1, w2::DOUBLE / (w0 + w1 + w2) AS p2 FROM weights),
pred AS MATERIALIZED (SELECT model, arm, unit_id, cluster_id, pid, true_class, fold_a, p0, p1, p2, greatest(p0, p1, p2) AS confidence,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred_class FROM probs)"""


def draws_sql(source: str, unit: str, stratum: str, name: str = "draws", reps: int = REPS, salt: int = 2026) -> str:
    return f"""{name}_n AS (SELECT {unit}, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY {unit}) - 1 AS ord, count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}),
{name} AS (SELECT d.rep, c.{unit}, count(*) AS w FROM (
  SELECT rep, {stratum}, {h_sql(f'rep * 1000003 + 3 * ord + {stratum}', salt)} % n AS ord FROM {name}_n, range(1, {reps + 1}) r(rep)) d
  JOIN {name}_n c ON c.{stratum} = d.{stratum} AND c.ord = d.ord GROUP BY ALL)"""
