"""Joins with a table of one row a key, where some keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 1000  # a key with a thousandth of the rows is hot, so there are at most a thousand hot keys


def lookup(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the columns of per_key, which has one row a key and in n how many of the `total` rows have it.

    Rows of hot keys meet their at most SHARES partners by broadcast and are not shuffled; the others are
    shuffled by key, where no key has more than a thousandth of the rows. Keys without a partner are left out.
    """
    is_hot = F.col(n) * SHARES >= F.lit(total)
    hot, cold = per_key.where(is_hot).drop(n), per_key.where(~is_hot).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
