"""Same or near-same records across splits (problem 1): a weighted cosine join between two sides.

A thumb, centred and scaled to length 1, is a vector of term weights: its coordinates on the principal axes
of all thumbs, strongest axis first. The rotation changes no dot product, but puts much of the length on the
leading terms. The join then works as an inverted index does:

* Terms are indexed in the order of their weights, as far as their weights are spread widely enough to tell vectors apart that
  are less alike than the threshold, and as long as lists stay filled; the other terms are the residual. An entry's list
  is that of its terms and their quantised weights together (thumbs are dense: a list of one term alone would hold half of all entries).
* Every list keeps the largest and smallest weight of each of its terms and of the residual norm. A vector of the
  other side asks the lists whose maximum-weight bound (the dot product with the best weights in the list plus the product of
  the residual norms) reaches the threshold and whose weights are not farther away than the threshold allows.
* Within a list, the dot product over a longer prefix of terms plus the product of the residual norms bounds
  the whole; pairs below the threshold are dropped. What is left gets its exact dot product.

No pair that reaches the threshold is lost, at any size. Lists are cut into blocks on both sides, so a hot
list becomes many bounded tasks. Equal vectors are joined once, as one class, and expanded at the end.

Defined cases: unreadable images, missing and constant thumbs and thumbs with a missing value have no vector; null hashes match nothing;
repeated rows count once; ids without a manifest row are in no pair; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, plain_id, plain_stem, table
from .cells import encoded, stacked, unit_rows

PREFIX = 24  # terms of the second, longer prefix


def packed(df: DataFrame, thumb: str, keep: list[str]) -> DataFrame:
    """keep, payload: the array of small integers as bytes, null for null."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def pack(batches):
        for pdf in batches:
            yield pdf[keep].assign(payload=[None if t is None else encoded(np.asarray(t, dtype=np.int16)) for t in pdf[thumb]])

    return df.mapInPandas(pack, f"{fields}, payload binary")


def axes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Principal axes of all vectors, strongest first, the mean square of the weights on each, and the number of vectors; the driver gets one number for each pair of terms."""

    def products(batches):
        total, n = None, 0
        for pdf in batches:
            x = unit_rows(stacked(pdf["payload"]))
            total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel(), "n": n})

    cells = vectors.mapInPandas(products, "i int, j int, v double, n bigint").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    if cells.empty:
        return np.eye(1), np.ones(1), 0
    d, n = int(cells["i"].max()) + 1, int(cells["n"].iloc[0])
    m = np.zeros((d, d))
    m[cells["i"], cells["j"]] = cells["v"]
    spread, basis = np.linalg.eigh((m + m.T) / 2)
    return basis[:, ::-1], np.maximum(spread[::-1], 0) / n, n


def indexed_terms(spread: np.ndarray, n: int, reach: float, width: float, filled: int = 500) -> int:
    """How many of the leading terms key a list: those with weights that deviate by half the reach or more, while lists hold `filled` entries on average."""
    lists, k = 1.0, 0
    for s in np.sqrt(spread):
        lists *= max(1.0, 4 * s / width)
        if k and (s < reach / 2 or lists * filled > n):
            break
        k += 1
    return max(1, k)


def post(df: DataFrame, basis: np.ndarray, terms: int, width: float) -> DataFrame:
    """(list, id, payload): each vector in the list of its leading weights."""
    radix = 2 * math.ceil(1 / width) + 3  # more than there are levels

    def assign(batches):
        for pdf in batches:
            level = np.floor(unit_rows(stacked(pdf["payload"])) @ basis[:, :terms] / width).astype(np.int64) + radix // 2
            key = pd.util.hash_array(np.array(["|".join(map(str, r)) for r in level], dtype=object)).astype(np.int64) if radix ** terms >= 1 << 62 else level @ (radix ** np.arange(terms, dtype=np.int64))
            yield pd.DataFrame({"list": key, "id": pdf["id"].to_numpy(), "payload": pdf["payload"].to_numpy()})

    return df.mapInPandas(assign, "list bigint, id bigint, payload binary")


def _weights(payload, basis: np.ndarray, terms: int) -> np.ndarray:
    """The leading weights and, last, the residual norm."""
    w = unit_rows(stacked(payload)) @ basis[:, :terms]
    return np.hstack([w, np.sqrt(np.maximum(1 - (w * w).sum(axis=1, keepdims=True), 0))])


def directory(posted: DataFrame, basis: np.ndarray, terms: int) -> pd.DataFrame:
    """One row a list: its number of entries, and the smallest (lo) and largest (hi) of each weight and of the residual norm."""
    names = [f"{e}{k}" for e in ("lo", "hi") for k in range(terms + 1)]

    def ends(batches):
        for pdf in batches:
            w = pd.DataFrame(_weights(pdf["payload"], basis, terms))
            by = w.groupby(pdf["list"].to_numpy())
            out = pd.concat([by.min(), by.max()], axis=1).set_axis(names, axis=1)
            yield out.assign(n=by.size()).rename_axis("list").reset_index()

    partial = posted.mapInPandas(ends, ", ".join(["list bigint", *(f"{c} double" for c in names), "n bigint"]))
    return partial.groupBy("list").agg(*(F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in names), F.sum("n").alias("n")).toPandas().sort_values("list")


def ask(df: DataFrame, lists: pd.DataFrame, basis: np.ndarray, terms: int, at_least: float, count: bool = False) -> DataFrame:
    """(list, id, payload): each vector with every list that may hold a partner; or (list, n), how many vectors ask a list, in parts."""
    key = lists["list"].to_numpy()
    lo, hi = (lists[[f"{e}{k}" for k in range(terms + 1)]].to_numpy() for e in ("lo", "hi"))
    chunk = max(1, 2_000_000 // max(1, len(key) * (terms + 1)))
    apart = 2 - 2 * at_least + 1e-6

    def assign(batches):
        for pdf in batches:
            w = _weights(pdf["payload"], basis, terms)
            for at in range(0, len(pdf), chunk):
                part = w[at:at + chunk, None]
                bound = np.maximum(part * lo, part * hi).sum(axis=2)
                gap = np.maximum(np.maximum(lo - part, part - hi), 0.0)
                row, k = np.nonzero((bound >= at_least - 1e-9) & ((gap * gap).sum(axis=2) <= apart))
                if count:
                    k, times = np.unique(k, return_counts=True)
                    yield pd.DataFrame({"list": key[k], "n": times})
                else:
                    yield pd.DataFrame({"list": key[k], "id": pdf["id"].to_numpy()[at + row], "payload": pdf["payload"].to_numpy()[at + row]})

    return df.mapInPandas(assign, "list bigint, n bigint" if count else "list bigint, id bigint, payload binary")


def cosine_join(left: DataFrame, right: DataFrame, at_least: float, width: float = 0.25, block: int = 8192, terms: int | None = None) -> DataFrame:
    """(id_l, id_r, similarity): all pairs of (id, payload) rows whose cosine is at_least or more. The result is the same with any width, block and number of terms."""
    basis, spread, n = axes(left.select("payload").unionByName(right.select("payload")))
    terms = min(terms or indexed_terms(spread, n, math.sqrt(max(0.0, 2 - 2 * at_least)), width), len(basis))
    prefix = basis[:, :max(PREFIX, terms)]
    # both are made twice rather than written: an entry for every list that a vector asks is the most that there is
    posted = post(right, basis, terms, width)
    lists = directory(posted, basis, terms)
    asked = ask(left, lists, basis, terms, at_least)
    # one row a list, of which there are at most as many as entries divided by `filled`
    have = left.sparkSession.createDataFrame([(int(k), -(-int(c) // block)) for k, c in zip(lists["list"], lists["n"])], "list bigint, n_r int")
    sizes = F.broadcast(cut(ask(left, lists, basis, terms, at_least, count=True).groupBy("list").agg(F.ceil(F.sum("n") / block).cast("int").alias("n_l")).join(F.broadcast(have), "list")))
    piece = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l_rows = asked.join(sizes, "list").withColumn("l", piece(F.col("n_l"))).withColumn("r", every(F.col("n_r"))).select("list", "l", "r", "id", "payload")
    r_rows = posted.join(sizes, "list").withColumn("r", piece(F.col("n_r"))).withColumn("l", every(F.col("n_l"))).select("list", "l", "r", "id", "payload")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"id_l": np.zeros(0, dtype=np.int64), "id_r": np.zeros(0, dtype=np.int64), "similarity": np.zeros(0)}
        if len(a) and len(b):
            y = unit_rows(stacked(b["payload"]))
            wy = y @ prefix
            ry = np.sqrt(np.maximum(1 - (wy * wy).sum(axis=1), 0))
            found = []
            for at in range(0, len(a), 512):
                x = unit_rows(stacked(a["payload"].iloc[at:at + 512]))
                wx = x @ prefix
                rx = np.sqrt(np.maximum(1 - (wx * wx).sum(axis=1), 0))
                i, j = np.nonzero(wx @ wy.T + np.outer(rx, ry) >= at_least - 1e-9)
                for s in range(0, len(i), 100_000):
                    p, q = i[s:s + 100_000], j[s:s + 100_000]
                    dot = np.einsum("ij,ij->i", x[p], y[q])
                    ok = dot >= at_least - 1e-12
                    found.append((a["id"].to_numpy()[at + p[ok]], b["id"].to_numpy()[q[ok]], dot[ok]))
            if found:
                out = dict(zip(out, map(np.concatenate, zip(*found))))
        return pd.DataFrame(out)

    keys = ["list", "l", "r"]
    return l_rows.groupBy(*keys).cogroup(r_rows.groupBy(*keys)).applyInPandas(match, "id_l bigint, id_r bigint, similarity double")


def _pictures(spark, sf_dir: str) -> DataFrame:
    """(image_id, thumb and the three hashes) of readable images of either side, one row an image."""
    held = table(spark, sf_dir, "fixed_test_fold4").select("image_id", F.lit(True).alias("held"), F.lit(False).alias("trained"))
    lists = table(spark, sf_dir, "train_fold4").select("image_id", F.lit(False).alias("held"), F.lit(True).alias("trained"))
    sides = held.unionByName(lists).where("image_id is not null").groupBy("image_id").agg(F.max("held").alias("held"), F.max("trained").alias("trained"))
    seen = table(spark, sf_dir, "image_manifest").where("readable").groupBy("image_id").agg(
        *(F.max(c).alias(c) for c in ("raw_array_hash", "canonical_image_hash", "display_hash", "thumb")))
    return seen.join(sides, "image_id")


def cross_pairs(pictures: DataFrame, at_least: float = 0.97) -> DataFrame:
    """(held, trained): image pairs across the sides that are the same or nearly the same."""
    usable = "thumb is not null and array_min(thumb) < array_max(thumb) and forall(thumb, v -> v is not null)"
    hashed = ["raw_array_hash", "canonical_image_hash", "display_hash"]
    pictures = cut(packed(pictures.withColumn("thumb", F.when(F.expr(usable), F.col("thumb"))), "thumb", ["image_id", "held", "trained", *hashed]))
    same = pictures.where("held and trained").select(F.col("image_id").alias("held"), F.col("image_id").alias("trained"))
    hashes = pictures.select("image_id", "held", "trained", F.posexplode(F.array(*hashed)).alias("kind", "hash")).where("hash is not null")
    by_hash = hashes.where("held").select("kind", "hash", F.col("image_id").alias("a")).join(
        hashes.where("trained").select("kind", "hash", F.col("image_id").alias("b")), ["kind", "hash"]).select(F.col("a").alias("held"), F.col("b").alias("trained"))
    pictures = pictures.where("payload is not null")
    payload = cut(pictures.groupBy("payload").agg(F.min("image_id").alias("id"), F.max("held").alias("any_held"), F.max("trained").alias("any_trained")))
    near = cosine_join(payload.where("any_held").select("id", "payload"), payload.where("any_trained").select("id", "payload"), at_least)
    members = pictures.join(payload.select("payload", "id"), "payload").select("id", "image_id", "held", "trained")
    by_thumb = near.join(members.where("held").select(F.col("id").alias("id_l"), F.col("image_id").alias("held")), "id_l").join(
        members.where("trained").select(F.col("id").alias("id_r"), F.col("image_id").alias("trained")), "id_r").select("held", "trained")
    return same.unionByName(by_hash).unionByName(by_thumb).distinct()


def p1_found(spark, sf_dir: str) -> DataFrame:
    pairs = cross_pairs(_pictures(spark, sf_dir))
    return pairs.select(F.least("held", "trained").alias("image_a"), F.greatest("held", "trained").alias("image_b")).distinct()


def p1_counts(spark, sf_dir: str) -> DataFrame:
    """(eval_set, stem, spans_folds, n_pairs, n_images): the overlaps by evaluation list and stem.

    An image listed under two ids counts for each; without an id or stem it counts under a null stem.
    """
    pairs = cross_pairs(_pictures(spark, sf_dir))
    stems = table(spark, sf_dir, "proposed_pid_to_stem_mapping").select(plain_id("patient_id").alias("pid"), plain_stem(F.col("stem"), F.col("patient_id")).alias("stem"))
    stems = stems.where("pid is not null").groupBy("pid").agg(F.min("stem").alias("stem"))
    spans = table(spark, sf_dir, "stem_table").select(plain_id("stem").alias("stem"), "spans_folds").where("stem is not null").groupBy("stem").agg(F.max("spans_folds").alias("spans_folds"))
    held = table(spark, sf_dir, "fixed_test_fold4").select(F.col("image_id").alias("held"), "eval_set", plain_id("patient_id").alias("pid")).distinct()
    held = held.join(stems, "pid", "left").join(spans, "stem", "left").select("held", "eval_set", "stem", "spans_folds").distinct()
    return pairs.join(held, "held").groupBy("eval_set", "stem", "spans_folds").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("held").alias("n_images"))
