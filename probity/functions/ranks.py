"""Ranks over groups of any size: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


def group_rank(df: DataFrame, group: list[str], value: str, tie: list[str], width: int, name: str) -> DataFrame:
    """df with name: the row's number from 1 within its group by (value, tie), for a BIGINT value.

    Rows are ranked within value ranges of `width`; the ranges' sizes are summed up to offsets. Width should
    leave a bounded number of rows in a range; a group's ranges, of which there are at most as many as its rows, meet in one task.
    """
    cut_ = df.withColumn("_range", F.expr(f"`{value}` div {width}L"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_range").orderBy(value, *tie)
    ranked = cut_.withColumn("_in", F.row_number().over(within)).join(offsets, [*group, "_range"])
    return ranked.withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_before", "_in")


def first_of(df: DataFrame, group: list[str], order: list, most: int, name: str) -> DataFrame:
    """The first `most` rows of each group with name, their number from 1; only they are shuffled."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)


def sum_before(df: DataFrame, group: list[str], order: str, width: int, value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the group with a smaller `order`, a BIGINT that no two rows of a group share.

    Sums run within ranges of `width` orders and over the ranges, so no task sees a whole group.
    """
    parted = df.withColumn("_range", F.expr(f"`{order}` div {width}L"))
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*group, "_range").agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(offsets, [*group, "_range"])
    return summed.withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_before", "_in")


GRID = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def quantile_name(q: float) -> str:
    return f"q{int(q * 100):02d}"


def quantiles(df: DataFrame, group: list[str], value: str, grid=GRID, ranges: int = 10_000) -> DataFrame:
    """group, n, least, a column for each q of grid, most: exact quantiles, linear between neighbours; nulls do not count.

    The values of a group are counted in equal ranges between its extremes; only the ranges that hold a
    wanted place are looked into, by different values and how often they occur. No buffer holds a group.
    """
    x = cut(df.select(*group, F.col(value).cast("double").alias("_v")).groupBy(*group, "_v").agg(F.count("*").alias("_c")))
    per = x.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))  # one row a group
    place = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("least"), F.col("most") - F.col("least")) * ranges).cast("int"), F.lit(0))
    parted = x.where("_v is not null").join(F.broadcast(per), group).withColumn("_r", place)
    counts = parted.groupBy(*group, "_r").agg(F.sum("_c").alias("_c"))
    upto = lambda *keys: Window.partitionBy(*keys)
    counts = counts.withColumn("_below", F.sum("_c").over(upto(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    wanted = per.where("n > 0").select(*group, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(grid)))).alias("w")).select(*group, "w.i", "w.at")
    ends = wanted.select(*group, "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()  # a few rows a group
    holds = counts.join(F.broadcast(ends), group).where((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("_c"))).select(*group, "_r", "_below", "i", "at", "rank")
    inside = parted.join(F.broadcast(holds.select(*group, "_r", "_below").distinct()), [*group, "_r"]).withColumn(
        "_first", F.col("_below") + F.sum("_c").over(upto(*group, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    hit = inside.select(*group, "_r", "_v", "_c", "_first").join(F.broadcast(holds.drop("_below")), [*group, "_r"]).where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_c")))
    pair = hit.groupBy(*group, "i", "at").agg(F.min_by("_v", "rank").alias("_lo"), F.max_by("_v", "rank").alias("_hi"))
    value_ = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("at") - F.floor("at"))
    wide = pair.groupBy(*group).agg(*(F.max(F.when(F.col("i") == i, value_)).alias(quantile_name(q)) for i, q in enumerate(grid)))
    return per.join(wide, group, "left").select(*group, "n", "least", *(quantile_name(q) for q in grid), "most")
