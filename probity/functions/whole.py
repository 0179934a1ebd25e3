"""Small columns of a whole table in each of a few tasks, for work that goes over all its rows hundreds of times.

A replicate that ranks or draws over all rows would shuffle them once a replicate. Here the rows are packed into compressed
arrays (one or two bytes a row for dense ids), sent to as many tasks as there are cores, and each task takes a share
of the replicates. A task holds the packed columns and some 20 bytes of work space a row.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import P

BLOCK = 1 << 14  # elements that stay in a core's cache
_P = np.uint32(P)


def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What h(x + y, salt) needs of x: its two linear parts, below P."""
    a = x.astype(np.int64) % P * 48271 % P
    return a.astype(np.uint32), (a * 16807 % P).astype(np.uint32)


def hashed(parts: tuple[np.ndarray, np.ndarray], y: int, salt: int) -> np.ndarray:
    """expr.h(x + y, salt) of all x, from their linear parts."""
    k = (y * 48271 + salt * 69621 + 1) % P
    k, kb = np.uint32(k), np.uint32((k * 16807 + salt) % P)
    out = np.empty(len(parts[0]), dtype=np.uint32)
    for s in range(0, len(out), BLOCK):
        a, b = parts[0][s:s + BLOCK] + k, parts[1][s:s + BLOCK] + kb
        np.minimum(a, a - _P, out=a)  # what is below P wraps to the top
        np.minimum(b, b - _P, out=b)
        t = b.astype(np.uint64)
        t *= t
        t += a
        r = ((t >> np.uint64(31)) + (t & np.uint64(P))).astype(np.uint32)
        np.minimum(r, r - _P, out=out[s:s + BLOCK])
    return out


def remainder(x: np.ndarray, n: int) -> np.ndarray:
    """x % n, by Numpy's division by a constant."""
    n = np.uint32(n)
    out = x // n
    out *= n
    return np.subtract(x, out, out=out)


def packed(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """(payload): the columns of df, numbers without nulls, as compressed arrays sorted by the first, which is a BIGINT."""
    columns = df.columns

    def dump(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts).sort_values(columns[0], kind="stable")
        arrays = {c: pdf[c].to_numpy() for c in columns}
        arrays[columns[0]] = np.diff(arrays[columns[0]], prepend=0)
        return pd.DataFrame({"payload": [zlib.compress(pickle.dumps(arrays, protocol=5), 1)]})

    def pack(batches):
        parts, n = [], 0
        for pdf in batches:
            if len(pdf):
                parts.append(pdf)
                n += len(pdf)
            if n >= rows:
                yield dump(parts)
                parts, n = [], 0
        if parts:
            yield dump(parts)

    return df.mapInPandas(pack, "payload binary")


def unpacked(payloads) -> dict[str, np.ndarray]:
    """The columns of packed rows."""
    blocks = []
    for p in payloads:
        block = pickle.loads(zlib.decompress(p))
        first = next(iter(block))
        block[first] = np.cumsum(block[first])
        blocks.append(block)
    return {c: np.concatenate([b[c] for b in blocks]) for c in blocks[0]}


def in_tasks(frames: dict[str, DataFrame], first: int, n: int, work: Callable[[dict[str, dict[str, np.ndarray]], range], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of work(columns of each frame, a share of the numbers from first on, n in all), a share for each core.

    An empty frame is missing from the columns; where all are empty there are no rows.
    """
    spark = next(iter(frames.values())).sparkSession
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
    # one key for each partition, so that every core gets one share
    keys = spark.range(64 * tasks).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("at")).agg(F.min("key").alias("key")).collect()
    share = {r["key"]: i for i, r in enumerate(keys)}
    every = None
    for name, df in frames.items():
        part = packed(df).withColumn("frame", F.lit(name))
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("task", F.explode(F.array(*(F.lit(k) for k in share)))).repartition(tasks, "task")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = share[int(pdf["task"].iloc[0])]
        return work({name: unpacked(p) for name, p in pdf.groupby("frame")["payload"]}, range(first + i, first + n, len(share)))

    return every.groupBy("task").applyInPandas(run, schema)
