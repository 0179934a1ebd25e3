"""How reliable a ranking of models is: ranks, Kendall's tau, how often each model is top.

Two policies for ties at the top: `top_frequency` splits the credit, `winners` takes the first model by name.
The number of models is small by design, so a replicate's models fit in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div
from . import bootstrap as b
from . import metrics as m

TWO = ["balanced_accuracy", "macro_f1"]


def ranks(values: DataFrame, key: list[str]) -> DataFrame:
    """key, model, rank: by value from the top, ties by name."""
    return values.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "model"))).select(*key, "model", "rank")


def kendall(x: str, y: str) -> Column:
    """Tau-b from the signs of pair differences; null where one side is constant."""
    sx, sy = F.signum(x), F.signum(y)
    return div(F.sum(sx * sy), F.sqrt(F.sum(sx * sx) * F.sum(sy * sy)))


def tau(values: DataFrame, key: list[str]) -> DataFrame:
    """key, tau: between the models' values under A and under B."""
    pairs = b.model_pairs(values, [*key, "arm"]).withColumn("difference", F.round("difference", 12)).withColumnRenamed("difference", "value")
    return b.paired(pairs, [*key, "left", "right"]).groupBy(*key).agg(kendall("a", "b").alias("tau"))


def top_frequency(values: DataFrame, key: list[str], tolerance: float = 1e-12) -> DataFrame:
    """key without rep, model, frequency: how often a model is top, ties sharing."""
    over = Window.partitionBy("rep", *key)
    best = values.withColumn("top", F.max("value").over(over)).withColumn("is_top", (F.abs(F.col("value") - F.col("top")) <= F.lit(tolerance)).cast("double"))
    shared = best.withColumn("credit", F.col("is_top") / F.sum("is_top").over(over))
    return shared.groupBy(*key, "model").agg(F.avg("credit").alias("frequency"))


def orders(values: DataFrame, key: list[str]) -> DataFrame:
    """key, first, models: the models from best to worst, as one string."""
    ordered = values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.round("value", 12)).alias("v"), "model"))).alias("ms"))
    return ordered.select(*key, F.col("ms")[0]["model"].alias("first"), F.array_join(F.transform("ms", lambda s: s["model"]), ">").alias("models"))


def _point(spark, d, sums=None):
    return b.long_metrics(b.point(b._sums(spark, d) if sums is None else sums), b.BY, TWO)


def _values(spark, d, sums=None):
    return b.long_metrics(b._reps(spark, d, sums=sums), ["rep", *b.BY], TWO)


def q_rank_table(spark, d):
    return ranks(_point(spark, d), ["arm", "metric"])


def q_kendall(spark, d):
    """Tau between protocols: of the points, and its distribution over replicates."""
    sums = b._sums(spark, d)
    reps = tau(_values(spark, d, sums), ["rep", "metric"])
    s = reps.groupBy("metric").agg(F.avg("tau").alias("mean_tau"), *b.interval("tau"), F.avg((F.col("tau") > 0).cast("double")).alias("share_positive"), F.avg((F.col("tau") > F.lit(1 - 1e-9)).cast("double")).alias("share_one"))
    return m.rounded(s.join(tau(_point(spark, d, sums), ["metric"]), "metric"), "mean_tau", "ci_lo", "ci_hi", "share_positive", "share_one", "tau")


def q_top_frequency(spark, d):
    return m.rounded(top_frequency(_values(spark, d), ["arm", "metric"]), "frequency")


def q_winners(spark, d):
    """How often each pair of winners (under A, under B) occurs."""
    o = orders(_values(spark, d), ["rep", "arm", "metric"])
    wide = o.groupBy("rep", "metric").agg(F.max(F.when(F.col("arm") == "A", F.col("first"))).alias("top_a"), F.max(F.when(F.col("arm") == "B", F.col("first"))).alias("top_b"))
    return wide.groupBy("metric", "top_a", "top_b").agg(F.count("*").alias("n"))


def q_same_order(spark, d):
    """How often the top model differs and the whole order is the same under both protocols."""
    o = orders(_values(spark, d), ["rep", "arm", "metric"])
    side = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    wide = o.groupBy("rep", "metric").agg((side("A", "first") != side("B", "first")).alias("differs"), (side("A", "models") == side("B", "models")).alias("same"))
    return m.rounded(wide.groupBy("metric").agg(F.avg(F.col("differs").cast("double")).alias("share_top_differs"), F.avg(F.col("same").cast("double")).alias("share_same_order")), "share_top_differs", "share_same_order")


def q_exact_ties(spark, d):
    """Replicates in which two models agree in a metric to 12 places."""
    v = _values(spark, d).groupBy("rep", "arm", "metric").agg(F.count("*").alias("n"), F.countDistinct(F.round("value", 12)).alias("k"))
    return v.groupBy("arm", "metric").agg(F.count_if(F.col("k") < F.col("n")).alias("n_tied"))


def queries() -> dict:
    return {"rank_table": q_rank_table, "kendall": q_kendall, "top_frequency": q_top_frequency, "winners": q_winners, "same_order": q_same_order, "exact_ties": q_exact_ties}


_RV = f"rv AS (SELECT * FROM vals WHERE metric IN ('balanced_accuracy', 'macro_f1')), pw AS (SELECT * FROM pv WHERE metric IN ('balanced_accuracy', 'macro_f1'))"
_ALL = f"{b._BASE}, {b._POINT}, {_RV}"


def _tau(source, key, name):
    return f"""{name}p AS (SELECT {key}, a.arm, a.model AS l, c.model AS r, round(a.value - c.value, 12) AS value FROM {source} a JOIN {source} c USING ({key}) WHERE a.arm = c.arm AND a.model < c.model),
{name}w AS (SELECT {key}, l, r, sign(max(value) FILTER (arm = 'A')) AS x, sign(max(value) FILTER (arm = 'B')) AS y FROM {name}p GROUP BY ALL), {name} AS (SELECT {key}, sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0) AS tau FROM {name}w GROUP BY ALL)"""


_ORD = "o AS (SELECT rep, arm, metric, first(model ORDER BY round(value, 12) DESC, model) AS first, string_agg(model, '>' ORDER BY round(value, 12) DESC, model) AS models FROM rv GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    r = m._rd
    return {
        "rank_table": f"{_ALL} SELECT arm, metric, model, row_number() OVER (PARTITION BY arm, metric ORDER BY value DESC, model)::INT AS rank FROM pw",
        "kendall": f"""{_ALL}, {_tau('pw', 'metric', 'tp')}, {_tau('rv', 'rep, metric', 'tr')}
SELECT metric, {r('avg(tr.tau)', 'mean_tau')}, {b._CI('tr.tau')}, {r('avg((tr.tau > 0)::INT)', 'share_positive')}, {r('avg((tr.tau > 1 - 1e-9)::INT)', 'share_one')}, {r('any_value(tp.tau)', 'tau')} FROM tr JOIN tp USING (metric) GROUP BY ALL""",
        "top_frequency": f"""{_ALL}, t AS (SELECT *, (abs(value - max(value) OVER (PARTITION BY rep, arm, metric)) <= 1e-12)::INT::DOUBLE AS is_top FROM rv),
c AS (SELECT *, is_top / sum(is_top) OVER (PARTITION BY rep, arm, metric) AS credit FROM t) SELECT arm, metric, model, {r('avg(credit)', 'frequency')} FROM c GROUP BY ALL""",
        "winners": f"{_ALL}, {_ORD} SELECT metric, top_a, top_b, count(*) AS n FROM (SELECT rep, metric, max(first) FILTER (arm = 'A') AS top_a, max(first) FILTER (arm = 'B') AS top_b FROM o GROUP BY ALL) GROUP BY ALL",
        "same_order": f"""{_ALL}, {_ORD}, w AS (SELECT rep, metric, max(first) FILTER (arm = 'A') <> max(first) FILTER (arm = 'B') AS differs, max(models) FILTER (arm = 'A') = max(models) FILTER (arm = 'B') AS same FROM o GROUP BY ALL)
SELECT metric, {r('avg(differs::INT)', 'share_top_differs')}, {r('avg(same::INT)', 'share_same_order')} FROM w GROUP BY ALL""",
        "exact_ties": f"{_ALL} SELECT arm, metric, count(*) FILTER (k < n) AS n_tied FROM (SELECT rep, arm, metric, count(*) AS n, count(DISTINCT round(value, 12)) AS k FROM rv GROUP BY ALL) GROUP BY ALL",
    }
