"""Exact and near duplicates: hashes, groups, pair tables, perceptual hashes, stated-query searches.

Pairs inside a group are never emitted: groups are reported as groups, and candidate pairs come from a table
or from equal keys. A search takes the rows whose id is divisible by 50 as its queries and puts them against
all rows, block by block: the queries are cut into blocks of bounded size, which are joined to the rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import display_pixels, pair_category
from ..functions.ranks import GRID, quantile_name, quantiles
from ..functions.session import cut, plain_id, plain_image_id, table
from ..functions.skew import lookup
from .metrics import rounded
from .splits import IMAGES_SQL, images, pid_sql

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
SIDE = 8
TURNED = 0.35  # unrelated vectors of 64 values are rarely more alike than that


# --- hashes and groups ---------------------------------------------------------------------------------------------

def pixel_hashes(df: DataFrame, row: str, pixels: str, shape: str) -> DataFrame:
    """row and three SHA-256 of an array of integers: with type and shape, of the values alone, of the display form."""
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return df.where(F.col(pixels).isNotNull()).select(
        row, F.sha2(F.concat(F.lit(f"raw|i2|{shape}|"), text(F.col(pixels))), 256).alias("raw"), F.sha2(F.concat(F.lit(f"canon|{shape}|"), text(F.col(pixels))), 256).alias("canonical"),
        F.sha2(F.concat(F.lit(f"disp|{shape}|"), text(display_pixels(pixels))), 256).alias("display"))


def exact_groups(df: DataFrame, row: str, key: list[str], flags: dict[str, str]) -> DataFrame:
    """key, first, n, and for each flag whether the group has several values: groups of two and more.

    The first member names the group. Members are not collected, so a group may be of any size.
    """
    return df.dropna(subset=key).groupBy(*key).agg(
        F.min(row).alias("first"), F.count("*").alias("n"), *((F.countDistinct(c) > 1).alias(name) for name, c in flags.items())).where("n > 1")


# --- pair tables -----------------------------------------------------------------------------------------------------

def pairs(spark, d) -> DataFrame:
    """The candidate table, one row a pair of different images (smaller first): its best scores."""
    c = table(spark, d, "near_duplicate_candidates").withColumns({"a": plain_image_id("image_a"), "b": plain_image_id("image_b")}).where("a is not null and b is not null and a != b")
    swap = F.col("a") > F.col("b")
    side = lambda x: (F.when(swap, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")), F.when(swap, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")))
    (pa, pb), (fa, fb), (la, lb) = side("patient"), side("fold"), side("label")
    return c.select(F.least("a", "b").alias("image_a"), F.greatest("a", "b").alias("image_b"), plain_id(pa).alias("patient_a"), plain_id(pb).alias("patient_b"), fa.alias("fold_a"), fb.alias("fold_b"), la.alias("label_a"), lb.alias("label_b"),
                    "same_class", "ncc_full", "ssim_full", "mad_norm", "thumb_ncc", "phash_hamming").groupBy("image_a", "image_b").agg(
        *(F.min(x).alias(x) for x in ("patient_a", "patient_b", "fold_a", "fold_b", "label_a", "label_b")), F.bool_and("same_class").alias("same_class"),
        *(F.max(x).alias(x) for x in ("ncc_full", "ssim_full", "thumb_ncc")), F.min("mad_norm").alias("mad_norm"), F.min("phash_hamming").alias("phash_hamming"),
    ).withColumn("category", pair_category("patient_a", "patient_b", "fold_a", "fold_b"))


def threshold_counts(p: DataFrame, metrics: tuple[str, ...], thresholds=THRESHOLDS) -> DataFrame:
    """metric, threshold, category, n_pairs, n_cross_class: pairs at or above each threshold, from one pass."""
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(t).alias("threshold"), F.col(m).alias("v")) for m in metrics for t in thresholds)))
    x = p.select("category", "same_class", grid.alias("g")).where(F.col("g.v") >= F.col("g.threshold"))
    return x.groupBy("g.metric", "g.threshold", F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("same_class")).alias("n_cross_class"))


# --- perceptual hashes and searches --------------------------------------------------------------------------------

def dct_basis(side: int = SIDE) -> list[list[float]]:
    """The orthonormal DCT-II: row u, column x."""
    return [[(math.sqrt(1 / side) if u == 0 else math.sqrt(2 / side)) * math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(side)]


def dct_coefficients(df: DataFrame, row: str, vector: str, side: int = SIDE) -> DataFrame:
    """row, k, c: the 2-D transform of a side x side picture, k = u * side + v."""
    basis = F.array(*(F.array(*(F.lit(x) for x in r)) for r in dct_basis(side)))
    cells = df.select(row, F.posexplode(vector).alias("p", "x")).withColumns({"i": F.expr(f"p div {side}").cast("int"), "j": (F.col("p") % side).cast("int"), "x": F.col("x").cast("double")})
    rows = cells.select(row, "i", "j", "x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("v")).groupBy(row, "i", "v").agg(F.sum(F.col("x") * F.get(F.get(basis, F.col("v")), F.col("j"))).alias("x"))
    both = rows.select(row, "i", "v", "x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("u")).groupBy(row, "u", "v").agg(F.sum(F.col("x") * F.get(F.get(basis, F.col("u")), F.col("i"))).alias("c"))
    return both.select(row, (F.col("u") * side + F.col("v")).alias("k"), F.round("c", 9).alias("c"))


def phash(df: DataFrame, row: str, vector: str) -> DataFrame:
    """row, hash (64 bits as a BIGINT): bit k is set where coefficient k is above the median of all but the first."""
    c = dct_coefficients(df, row, vector)
    median = c.where("k > 0").groupBy(row).agg(F.percentile("c", F.lit(0.5)).alias("med"))
    bits = c.join(median, row).where("c > med").select(row, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k").cast("int")).alias("bit"))
    return c.select(row).distinct().join(bits.groupBy(row).agg(F.bit_or("bit").alias("hash")), row, "left").select(row, F.coalesce("hash", F.lit(0).cast("bigint")).alias("hash"))


def flips(width: int, most: int) -> list[int]:
    """All words of `width` bits with at most `most` bits set."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(width), n)]


def hamming_candidates(hashes: DataFrame, row: str, most: int, bands: int = 4, bits: int = 64) -> DataFrame:
    """(id_a, hash_a, id_b, hash_b), id_a < id_b: different hashes with a band in which at most most div bands bits differ; pairs may repeat.

    Of two hashes at most `most` bits apart, one of the bands is at most most div bands bits apart. Each hash is listed under
    the words of its bands with up to half of so many bits flipped, and asks for those with up to the other half flipped.
    """
    width, radius = bits // bands, most // bands
    classes = hashes.groupBy("hash").agg(F.min(row).alias("id"))
    banded = classes.select("id", "hash", F.posexplode(F.array(*(F.shiftrightunsigned("hash", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) for i in range(bands)))).alias("band", "value"))
    flipped = lambda df, n: df.withColumn("flip", F.explode(F.lit(flips(width, n)).cast("array<bigint>"))).select("id", "hash", "band", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    left, right = flipped(banded, radius // 2).toDF("id_a", "hash_a", "band", "value"), flipped(banded, radius - radius // 2).toDF("id_b", "hash_b", "band", "value")
    both = left.join(right, ["band", "value"]).where("id_a != id_b")
    swap = F.col("id_a") > F.col("id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.when(swap, F.col("hash_b")).otherwise(F.col("hash_a")).alias("hash_a"), F.greatest("id_a", "id_b").alias("id_b"), F.when(swap, F.col("hash_a")).otherwise(F.col("hash_b")).alias("hash_b"))


def hamming_join(hashes: DataFrame, row: str, most: int) -> DataFrame:
    """id_a < id_b, distance: all pairs at most `most` bits apart. Equal hashes are one class and are not paired."""
    near = hamming_candidates(hashes, row, most).withColumn("distance", F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))))
    return near.where(F.col("distance") <= most).select("id_a", "id_b", "distance").distinct()


def block_search(rows: DataFrame, row: str, vector: str, score, k: int, every: int = 50, block: int = 4096) -> DataFrame:
    """(query, other, turn, ncc): each query's k best other rows; queries are the rows whose id is divisible by `every`.

    Both sides are cut into hashed blocks of about `block` rows and each pair of blocks is one task's group;
    score(q, x) gives a list of score matrices, one a turn. A block's k best are kept, then the k best of all;
    ties go to the first turn, then the smaller id.
    """
    pieces = max(1, -(-rows.count() // block))
    q_pieces = max(1, -(-rows.where(F.col(row) % every == 0).count() // block))
    packed = rows.select(F.col(row).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.where(F.col("id") % every == 0).withColumn("a", at(q_pieces)).withColumn("b", upto(pieces))
    right = packed.withColumn("b", at(pieces)).withColumn("a", upto(q_pieces))

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(x):
            ids, scores = x["id"].to_numpy(), score(units(q["v"]), units(x["v"]))
            for turn, ncc in enumerate(scores):
                ncc = np.where(np.isnan(ncc) | (q["id"].to_numpy()[:, None] == ids), -np.inf, np.round(ncc, 6))
                # all that reach the k-th best, so that ties at it are decided by id
                least = np.partition(ncc, -min(k, ncc.shape[1]), axis=1)[:, -min(k, ncc.shape[1])]
                i, j = np.nonzero((ncc >= least[:, None]) & (ncc > -np.inf))
                by = np.lexsort((ids[j], -ncc[i, j], i))
                i, j = i[by], j[by]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                parts.append(pd.DataFrame({"query": q["id"].to_numpy()[i[top]], "other": ids[j[top]], "turn": turn, "ncc": ncc[i[top], j[top]]}))
        return pd.concat(parts) if parts else pd.DataFrame()

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, "query bigint, other bigint, turn int, ncc double")
    order = Window.partitionBy("query").orderBy(F.desc("ncc"), "turn", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def units(vectors) -> np.ndarray:
    """Rows centred and scaled to length 1; constant rows become NaN."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x -= x.mean(axis=1, keepdims=True)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 1e-12)


def dihedral(side: int) -> dict[str, list[int]]:
    """The seven ways but one to lay a picture on itself, as index permutations."""
    at = lambda f: [f(i, j) for i in range(side) for j in range(side)]
    n, s = side - 1, side
    return {"flipud": at(lambda i, j: (n - i) * s + j), "fliplr": at(lambda i, j: i * s + n - j), "rot90": at(lambda i, j: j * s + n - i), "rot180": at(lambda i, j: (n - i) * s + n - j),
            "rot270": at(lambda i, j: (n - j) * s + i), "transpose": at(lambda i, j: j * s + i), "antitranspose": at(lambda i, j: (n - j) * s + n - i)}


# --- queries -----------------------------------------------------------------------------------------------------------

def q_thumb_hashes(spark, d):
    one = table(spark, d, "image_manifest").where("thumb is not null and image_id is not null").groupBy("image_id").agg(F.max("thumb").alias("thumb"))
    return pixel_hashes(one, "image_id", "thumb", "10x10")


def q_exact_groups(spark, d):
    """Groups of equal images by each hash, from one pass."""
    kinds = ("raw_array_hash", "canonical_image_hash", "display_hash")
    long = images(spark, d).select("image_id", "patient_id", "label", "fold", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("hash")) for k in kinds))).alias("x")).select("*", "x.*").where("hash is not null")
    return exact_groups(long, "image_id", ["kind", "hash"], {"cross_patient": "patient_id", "cross_class": "label", "cross_fold": "fold"})


def group_members(df: DataFrame, row: str, key: list[str]) -> DataFrame:
    """key, first, n, row: every member of a group of two and more, one row each; the first member names the group."""
    groups = df.dropna(subset=key).groupBy(*key).agg(F.min(row).alias("first"), F.count("*").alias("n"))
    return lookup(df.dropna(subset=key).select(F.concat_ws("|", *key).alias("_k"), *key, row), groups.select(F.concat_ws("|", *key).alias("_k"), "first", "n", F.col("n").alias("_n")), "_k", "_n", df.count()).where("n > 1").select(*key, "first", "n", row)


def q_group_members(spark, d):
    """The members of the groups of equal display pictures."""
    return group_members(images(spark, d).select("image_id", "display_hash"), "image_id", ["display_hash"])


def q_hash_comparison(spark, d):
    """Whether the three hashes group alike: groups, surplus images, display groups that are no raw group.

    A group is compared by its size and the sum and exclusive-or of its members' hashes, not member by member.
    """
    im = cut(images(spark, d))
    sig = lambda kind: im.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n"), F.min("image_id").alias("first"), F.max("image_id").alias("last"), F.sum(F.col("image_id").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("image_id")).alias("x")).where("n > 1").drop(kind)
    raw, canon, disp = sig("raw_array_hash"), sig("canonical_image_hash"), sig("display_hash")
    count = lambda g, name: g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus")).withColumn("measure", F.lit(name))
    only = lambda a, b, name: a.join(b, ["n", "first", "last", "total", "x"], "left_anti").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus")).withColumn("measure", F.lit(name))
    return count(raw, "raw").unionByName(count(canon, "canonical")).unionByName(count(disp, "display")).unionByName(only(canon, raw, "canonical not raw")).unionByName(only(disp, raw, "display not raw"))


def q_document_groups(spark, d):
    """Groups of equal documents: as they are, trimmed, and without case and surplus blanks; by size."""
    t = table(spark, d, "documents").where("text is not null")
    forms = F.explode(F.array(F.struct(F.lit("raw").alias("form"), F.sha2("text", 256).alias("k")), F.struct(F.lit("canonical").alias("form"), F.sha2(F.trim("text"), 256).alias("k")),
                              F.struct(F.lit("display").alias("form"), F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r]+", " ")), 256).alias("k"))))
    return t.select(forms.alias("f")).groupBy("f.form", "f.k").agg(F.count("*").alias("n")).where("n > 1").groupBy("form", "n").agg(F.count("*").alias("n_groups"))


def q_pair_categories(spark, d):
    return pairs(spark, d).groupBy("category").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("same_class")).alias("n_cross_class"))


def q_threshold_counts(spark, d):
    return threshold_counts(pairs(spark, d), ("ncc_full", "ssim_full"))


def q_similarity_quantiles(spark, d):
    """Quantiles of four scores over all, same-patient, cross-patient and cross-patient cross-fold pairs."""
    p = pairs(spark, d)
    pops = F.filter(F.array(F.lit("all"), F.when(F.col("patient_a") == F.col("patient_b"), "same_patient"), F.when(F.col("patient_a") != F.col("patient_b"), "cross_patient"),
                            F.when(F.col("category") == "cross-patient/cross-fold", "cross_patient_cross_fold")), lambda x: x.isNotNull())
    long = p.select(F.explode(pops).alias("population"), F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("thumb_ncc", "ncc_full", "ssim_full", "mad_norm"))).alias("ms")).select("population", F.explode("ms").alias("x")).select("population", "x.*")
    s = quantiles(long, ["population", "metric"], "v", GRID)
    return rounded(s, "least", *(quantile_name(q) for q in GRID), "most")


def q_top_pairs(spark, d):
    """The 200 most similar pairs, ties by the ids."""
    return pairs(spark, d).orderBy(F.desc_nulls_last("ncc_full"), F.desc_nulls_last("ssim_full"), "image_a", "image_b").limit(200).select("image_a", "image_b", "category", "ncc_full", "ssim_full")


def q_cross_patient_high(spark, d):
    return pairs(spark, d).where("patient_a != patient_b and ncc_full >= 0.90").select("image_a", "image_b", "patient_a", "patient_b", "label_a", "label_b", "fold_a", "fold_b", "same_class", "category", "ncc_full", "ssim_full", "mad_norm", "thumb_ncc", "phash_hamming")


def q_stage_a(spark, d):
    """Retrieval counts: thumbs at 0.90 or more, hashes within 10 bits, either; the first two may overlap."""
    thumb, bits = F.col("thumb_ncc") >= F.lit(0.9), F.col("phash_hamming") <= 10
    yes = lambda c: F.coalesce(c, F.lit(False))
    return pairs(spark, d).agg(F.count("*").alias("n_pairs"), F.count_if(yes(thumb) | yes(bits)).alias("n_candidates"), F.count_if(yes(thumb)).alias("by_thumb"), F.count_if(yes(bits)).alias("by_hash"))


def q_best_partner(spark, d):
    """Each image's best thumb score with the same and with another patient, from the pair table; null without one."""
    p = pairs(spark, d).select("image_a", "image_b", "thumb_ncc", (F.col("patient_a") == F.col("patient_b")).alias("same"))
    both = p.select(F.col("image_a").alias("image_id"), "thumb_ncc", "same").unionByName(p.select(F.col("image_b").alias("image_id"), "thumb_ncc", "same"))
    return both.groupBy("image_id").agg(F.max(F.when(F.col("same"), F.col("thumb_ncc"))).alias("best_same_patient"), F.max(F.when(~F.col("same"), F.col("thumb_ncc"))).alias("best_other_patient"))


def q_identity_evidence(spark, d):
    """What the pair table says of id rules: pairs within an id, across ids of one stem, across stems."""
    from ..functions.expr import strict_stem
    p = pairs(spark, d).withColumn("relation", F.when(F.col("patient_a") == F.col("patient_b"), "same id").when(strict_stem("patient_a") == strict_stem("patient_b"), "same stem").otherwise("other"))
    return p.groupBy("relation").agg(F.count("*").alias("n"), F.max("ncc_full").alias("most_similar"), F.count_if(F.col("ncc_full") >= F.lit(0.99)).alias("n_99"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null")


def q_phash(spark, d):
    return phash(_vectors(spark, d), "vec_id", "embedding")


def q_phash_pairs(spark, d):
    """Pairs of perceptual hashes at most 15 bits apart."""
    return hamming_join(phash(_vectors(spark, d), "vec_id", "embedding"), "vec_id", 15)


def q_vector_search(spark, d):
    """The five nearest vectors of each query by correlation; ties by id."""
    v = _vectors(spark, d)
    near = block_search(v, "vec_id", "embedding", lambda q, x: [q @ x.T], 5)
    label = v.select(F.col("vec_id").alias("other"), F.col("label").alias("l_other"))
    return near.join(v.select(F.col("vec_id").alias("query"), "label"), "query").join(label, "other").select("query", "other", (F.col("label") == F.col("l_other")).alias("same_class"), "ncc", "rank")


def q_dihedral(spark, d):
    """For each query, the vector and turn that fit best: correlation with seven turned copies; ties by turn, then id."""
    names, orders = list(dihedral(SIDE)), [np.array(o) for o in dihedral(SIDE).values()]
    best = block_search(_vectors(spark, d), "vec_id", "embedding", lambda q, x: [q @ x[:, o].T for o in orders], 1)
    return best.select("query", "other", F.get(F.array(*map(F.lit, names)), F.col("turn")).alias("turn"), "ncc")


def q_turned_only(spark, d):
    """Queries and vectors that look alike only after a turn: the best turn at TURNED or more, as they are below that."""
    orders = [np.arange(SIDE * SIDE), *(np.array(o) for o in dihedral(SIDE).values())]
    names = ["identity", *dihedral(SIDE)]
    v = _vectors(spark, d)
    best = block_search(v, "vec_id", "embedding", lambda q, x: [np.max([q @ x[:, o].T for o in orders[1:]], axis=0)], 3)
    both = best.select("query", "other", F.col("ncc").alias("turned")).where(F.col("turned") >= F.lit(TURNED))
    pair = both.join(v.select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("a")), "query").join(v.select(F.col("vec_id").alias("other"), F.col("embedding").cast("array<double>").alias("b")), "other")

    def turn(batches):
        for pdf in batches:
            a, b = units(pdf["a"]), units(pdf["b"])
            s = np.round(np.stack([np.einsum("nd,nd->n", a, b[:, o]) for o in orders], axis=1), 6)
            yield pdf[["query", "other", "turned"]].assign(identity=s[:, 0], turn=[names[1 + k] for k in s[:, 1:].argmax(axis=1)])

    return pair.mapInPandas(turn, "query bigint, other bigint, turned double, identity double, turn string").where(F.col("identity") < F.lit(TURNED))


SSIM_SIDE, SSIM_WINDOW = 10, 7


def ssim(a: np.ndarray, b: np.ndarray, side: int = SSIM_SIDE, window: int = SSIM_WINDOW) -> np.ndarray:
    """The structural similarity of pictures by rows: uniform window, sample covariances, constants 0.01 and 0.03 of the joint range, mean over the whole windows."""
    span = np.maximum(a.max(axis=1), b.max(axis=1)) - np.minimum(a.min(axis=1), b.min(axis=1))
    span = np.where(span > 0, span, 1.0)[:, None, None]
    view = lambda v: np.lib.stride_tricks.sliding_window_view(v.reshape(-1, side, side), (window, window), axis=(1, 2))
    x, y, n = view(a), view(b), window * window
    mean = lambda v: v.mean(axis=(3, 4))
    mx, my = mean(x), mean(y)
    vx, vy, vxy = ((mean(p * q) - m * k) * n / (n - 1) for p, q, m, k in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return ((2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean(axis=(1, 2))


def q_ssim_pairs(spark, d):
    """Structural similarity of the thumbs of all candidate pairs that have 10 x 10 values on both sides."""
    thumbs = table(spark, d, "image_manifest").where(F.col("readable") & (F.size("thumb") == SSIM_SIDE * SSIM_SIDE) & F.col("image_id").isNotNull() & F.expr("forall(thumb, v -> v is not null)")).groupBy("image_id").agg(F.max("thumb").alias("t"))
    x = pairs(spark, d).select("image_a", "image_b").join(thumbs.toDF("image_a", "ta"), "image_a").join(thumbs.toDF("image_b", "tb"), "image_b")

    def compare(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["image_a", "image_b"]].assign(ssim=ssim(np.stack(pdf["ta"]).astype(float), np.stack(pdf["tb"]).astype(float)))

    return rounded(x.mapInPandas(compare, "image_a bigint, image_b bigint, ssim double"), "ssim")


def q_verify_pairs(spark, d):
    """Stage B on the thumbs of all candidate pairs, whatever their score before: correlation, mean absolute difference over the range, equal pixels; null for thumbs of different or no size."""
    thumbs = table(spark, d, "image_manifest").where("readable and thumb is not null and image_id is not null").groupBy("image_id").agg(F.max("thumb").alias("t"))
    p = pairs(spark, d).select("image_a", "image_b")
    x = p.join(thumbs.toDF("image_a", "ta"), "image_a").join(thumbs.toDF("image_b", "tb"), "image_b")
    both = x.where("size(ta) = size(tb) and size(ta) > 0").select("image_a", "image_b", "ta", "tb")
    odd = x.where("size(ta) != size(tb) or size(ta) = 0").select("image_a", "image_b", *(F.lit(None).cast("double").alias(c) for c in ("ncc", "mad_norm", "equal")))

    def sixth(v: np.ndarray) -> np.ndarray:
        """To 6 decimals, halves away from 0."""
        return np.sign(v) * np.floor(np.abs(v) * 1e6 + 0.5) / 1e6

    def verify(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["ta"].map(len)):
                a, b = np.stack(part["ta"]).astype(float), np.stack(part["tb"]).astype(float)  # sums of integers: exact
                n, sa, sb = a.shape[1], a.sum(axis=1), b.sum(axis=1)
                spread = (n * (a * a).sum(axis=1) - sa * sa) * (n * (b * b).sum(axis=1) - sb * sb)
                ncc = np.divide(n * (a * b).sum(axis=1) - sa * sb, np.sqrt(spread), out=np.full(len(a), np.nan), where=spread > 0)
                span = np.maximum(a.max(axis=1), b.max(axis=1)) - np.minimum(a.min(axis=1), b.min(axis=1))
                yield part[["image_a", "image_b"]].assign(ncc=sixth(ncc), mad_norm=sixth(np.abs(a - b).mean(axis=1) / np.maximum(span, 1)), equal=sixth((a == b).mean(axis=1)))

    done = both.mapInPandas(verify, "image_a bigint, image_b bigint, ncc double, mad_norm double, equal double")
    return rounded(done.unionByName(odd), "ncc", "mad_norm", "equal")


def queries() -> dict:
    return {
        "thumb_hashes": q_thumb_hashes, "exact_groups": q_exact_groups, "group_members": q_group_members, "hash_comparison": q_hash_comparison, "document_groups": q_document_groups, "pair_categories": q_pair_categories,
        "threshold_counts": q_threshold_counts, "similarity_quantiles": q_similarity_quantiles, "top_pairs": q_top_pairs, "cross_patient_high": q_cross_patient_high, "stage_a": q_stage_a,
        "best_partner": q_best_partner, "identity_evidence": q_identity_evidence, "phash": q_phash, "phash_pairs": q_phash_pairs, "vector_search": q_vector_search, "dihedral": q_dihedral, "turned_only": q_turned_only, "ssim_pairs": q_ssim_pairs, "verify_pairs": q_verify_pairs,
    }


# --- the same in SQL -----------------------------------------------------------------------------------------------------

def _img(c):
    return rf"try_cast(nullif(regexp_extract(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '^(?:.*/)?0*([0-9]{{1,18}})(?:\.mat|\.0+)?$', 1), '') AS BIGINT)"


_X = lambda n, s: f"CASE WHEN a > b THEN {n}_{'b' if s == 'a' else 'a'} ELSE {n}_{s} END"
PAIRS_SQL = f"""c0 AS (SELECT *, {_img('image_a')} AS a, {_img('image_b')} AS b FROM near_duplicate_candidates),
pr0 AS (SELECT least(a, b) AS image_a, greatest(a, b) AS image_b, {pid_sql(_X('patient', 'a'))} AS patient_a, {pid_sql(_X('patient', 'b'))} AS patient_b, {_X('fold', 'a')} AS fold_a, {_X('fold', 'b')} AS fold_b,
  {_X('label', 'a')} AS label_a, {_X('label', 'b')} AS label_b, same_class, ncc_full, ssim_full, mad_norm, thumb_ncc, phash_hamming FROM c0 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
pr1 AS (SELECT image_a, image_b, min(patient_a) AS patient_a, min(patient_b) AS patient_b, min(fold_a) AS fold_a, min(fold_b) AS fold_b, min(label_a) AS label_a, min(label_b) AS label_b, bool_and(same_class) AS same_class,
  max(ncc_full) AS ncc_full, max(ssim_full) AS ssim_full, max(thumb_ncc) AS thumb_ncc, min(mad_norm) AS mad_norm, min(phash_hamming) AS phash_hamming FROM pr0 GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN patient_a = patient_b THEN 'within' ELSE 'cross' END || '-patient/' || CASE WHEN fold_a = fold_b THEN 'within' ELSE 'cross' END || '-fold' AS category FROM pr1)"""
_P = f"WITH {PAIRS_SQL}"
UNITV_SQL = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), mo AS (SELECT vec_id, avg(v) AS mean, sqrt(var_pop(v) * count(*)) AS norm FROM x GROUP BY 1),
u AS MATERIALIZED (SELECT x.vec_id, list((v - mean) / norm ORDER BY k) AS u FROM x JOIN mo USING (vec_id) WHERE norm > 1e-12 GROUP BY x.vec_id)"""


def oracle_sql() -> dict[str, str]:
    groups = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS hash, min(image_id) AS first, count(*) AS n, count(DISTINCT patient_id) > 1 AS cross_patient, count(DISTINCT label) > 1 AS cross_class, count(DISTINCT fold) > 1 AS cross_fold FROM im WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1" for k in ("raw_array_hash", "canonical_image_hash", "display_hash"))
    sets = lambda k, n: f"{n} AS (SELECT list(image_id ORDER BY image_id) AS g FROM im WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1)"
    cnt = lambda src, name: f"SELECT '{name}' AS measure, count(*) AS n_groups, coalesce(sum(len(g) - 1), 0)::BIGINT AS n_surplus FROM {src}"
    quant = ", ".join(f"round(quantile_cont(v, {q}), 6) + 0.0::DOUBLE AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    basis = "(CASE WHEN {u} = 0 THEN sqrt(1 / 8::DOUBLE) ELSE sqrt(2 / 8::DOUBLE) END * cos(pi() * (2 * {x} + 1) * {u} / 16::DOUBLE))"
    ph = f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
co AS (SELECT vec_id, u.u * 8 + w.w AS k, round(sum(v * {basis.format(u='u.u', x='(p // 8)')} * {basis.format(u='w.w', x='(p % 8)')}), 9) AS c FROM e, range(8) u(u), range(8) w(w) GROUP BY ALL),
md AS (SELECT vec_id, quantile_cont(c, 0.5) AS med FROM co WHERE k > 0 GROUP BY 1),
ph AS (SELECT vec_id, coalesce(sum(CASE WHEN c > med THEN CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << k::INT) END ELSE 0 END), 0)::BIGINT AS hash FROM co JOIN md USING (vec_id) GROUP BY 1)"""
    tables = {n: o for n, o in dihedral(SIDE).items()}
    turns = ", ".join(f"({i}, '{n}', {[x + 1 for x in o]})" for i, (n, o) in enumerate(tables.items()))
    long4 = " UNION ALL ".join(f"SELECT population, '{m}' AS metric, {m} AS v FROM po" for m in ("thumb_ncc", "ncc_full", "ssim_full", "mad_norm"))
    thr = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
    return {
        "thumb_hashes": """WITH o AS (SELECT image_id, max(thumb) AS t FROM image_manifest WHERE thumb IS NOT NULL AND image_id IS NOT NULL GROUP BY 1), z AS (SELECT image_id, t, list_min(t)::DOUBLE AS lo, list_max(t)::DOUBLE AS hi FROM o)
SELECT image_id, sha256('raw|i2|10x10|' || array_to_string(t, ',')) AS raw, sha256('canon|10x10|' || array_to_string(t, ',')) AS canonical,
sha256('disp|10x10|' || array_to_string(list_transform(t, lambda x: CASE WHEN lo = hi THEN 0 ELSE floor(255.0::DOUBLE / (hi - lo) * (x::DOUBLE - lo))::INT END), ',')) AS display FROM z""",
        "exact_groups": f"WITH {IMAGES_SQL} {groups}",
        "group_members": f"WITH {IMAGES_SQL}, g AS (SELECT display_hash, image_id, min(image_id) OVER (PARTITION BY display_hash) AS first, count(*) OVER (PARTITION BY display_hash) AS n FROM im WHERE display_hash IS NOT NULL) SELECT * FROM g WHERE n > 1",
        "hash_comparison": f"WITH {IMAGES_SQL}, {sets('raw_array_hash', 'r')}, {sets('canonical_image_hash', 'c')}, {sets('display_hash', 'd')} {cnt('r', 'raw')} UNION ALL {cnt('c', 'canonical')} UNION ALL {cnt('d', 'display')} UNION ALL {cnt('(SELECT * FROM c WHERE g NOT IN (SELECT g FROM r))', 'canonical not raw')} UNION ALL {cnt('(SELECT * FROM d WHERE g NOT IN (SELECT g FROM r))', 'display not raw')}",
        "document_groups": r"""WITH f AS (SELECT 'raw' AS form, sha256(text) AS k FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'canonical', sha256(trim(text)) FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'display', sha256(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) FROM documents WHERE text IS NOT NULL)
SELECT form, n, count(*) AS n_groups FROM (SELECT form, k, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""",
        "pair_categories": f"{_P} SELECT category, count(*) AS n_pairs, count(*) FILTER (NOT same_class) AS n_cross_class FROM pr GROUP BY ALL",
        "threshold_counts": f"{_P}, l AS (SELECT 'ncc_full' AS metric, ncc_full AS v, category, same_class FROM pr UNION ALL SELECT 'ssim_full', ssim_full, category, same_class FROM pr) SELECT metric, t.t AS threshold, coalesce(category, 'unknown') AS category, count(*) AS n_pairs, count(*) FILTER (NOT same_class) AS n_cross_class FROM l, (VALUES {thr}) t(t) WHERE v >= t.t GROUP BY ALL",
        "similarity_quantiles": f"""{_P}, po AS (SELECT 'all' AS population, * FROM pr UNION ALL SELECT 'same_patient', * FROM pr WHERE patient_a = patient_b UNION ALL SELECT 'cross_patient', * FROM pr WHERE patient_a <> patient_b UNION ALL SELECT 'cross_patient_cross_fold', * FROM pr WHERE category = 'cross-patient/cross-fold'),
l AS ({long4}) SELECT population, metric, count(v) AS n, round(min(v), 6) + 0.0::DOUBLE AS least, {quant}, round(max(v), 6) + 0.0::DOUBLE AS most FROM l GROUP BY ALL""",
        "top_pairs": f"{_P} SELECT image_a, image_b, category, ncc_full, ssim_full FROM pr ORDER BY ncc_full DESC NULLS LAST, ssim_full DESC NULLS LAST, image_a, image_b LIMIT 200",
        "cross_patient_high": f"{_P} SELECT image_a, image_b, patient_a, patient_b, label_a, label_b, fold_a, fold_b, same_class, category, ncc_full, ssim_full, mad_norm, thumb_ncc, phash_hamming FROM pr WHERE patient_a <> patient_b AND ncc_full >= 0.90",
        "stage_a": f"{_P} SELECT count(*) AS n_pairs, count(*) FILTER (coalesce(thumb_ncc >= 0.9::DOUBLE, false) OR coalesce(phash_hamming <= 10, false)) AS n_candidates, count(*) FILTER (thumb_ncc >= 0.9::DOUBLE) AS by_thumb, count(*) FILTER (phash_hamming <= 10) AS by_hash FROM pr",
        "best_partner": f"{_P}, b AS (SELECT image_a AS image_id, thumb_ncc, patient_a = patient_b AS same FROM pr UNION ALL SELECT image_b, thumb_ncc, patient_a = patient_b FROM pr) SELECT image_id, max(thumb_ncc) FILTER (same) AS best_same_patient, max(thumb_ncc) FILTER (NOT same) AS best_other_patient FROM b GROUP BY 1",
        "identity_evidence": rf"{_P}, x AS (SELECT *, CASE WHEN patient_a = patient_b THEN 'same id' WHEN regexp_replace(patient_a, '^(MR[0-9]{{6}})[A-Z]$', '\1') = regexp_replace(patient_b, '^(MR[0-9]{{6}})[A-Z]$', '\1') THEN 'same stem' ELSE 'other' END AS relation FROM pr) SELECT relation, count(*) AS n, max(ncc_full) AS most_similar, count(*) FILTER (ncc_full >= 0.99::DOUBLE) AS n_99 FROM x GROUP BY 1",
        "phash": f"{ph} SELECT vec_id, hash FROM ph",
        "phash_pairs": f"{ph}, cl AS (SELECT hash, min(vec_id) AS id FROM ph GROUP BY 1) SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM cl a JOIN cl b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 15",
        "vector_search": f"""WITH {UNITV_SQL}, s AS (SELECT q.vec_id AS query, o.vec_id AS other, eq.label = eo.label AS same_class, round(list_inner_product(q.u, o.u), 6) AS ncc FROM u q JOIN u o ON q.vec_id <> o.vec_id AND q.vec_id % 50 = 0 JOIN embeddings eq ON eq.vec_id = q.vec_id JOIN embeddings eo ON eo.vec_id = o.vec_id)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY ncc DESC, other)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY ncc DESC, other) <= 5""",
        "dihedral": f"""WITH {UNITV_SQL}, tn(t, turn, o) AS (VALUES {turns}), tv AS MATERIALIZED (SELECT vec_id, t, turn, list_transform(o, lambda i: u[i]) AS w FROM u, tn),
s AS (SELECT q.vec_id AS query, v.vec_id AS other, t, turn, round(list_inner_product(q.u, v.w), 6) AS ncc FROM u q JOIN tv v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0)
SELECT query, other, turn, ncc FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY ncc DESC, t, other) = 1""",
        "turned_only": f"""WITH {UNITV_SQL}, tn(t, turn, o) AS (VALUES {turns}), tv AS MATERIALIZED (SELECT vec_id, t, turn, list_transform(o, lambda i: u[i]) AS w FROM u, tn),
s AS (SELECT q.vec_id AS query, v.vec_id AS other, t, turn, round(list_inner_product(q.u, v.w), 6) AS ncc, q.u AS qu FROM u q JOIN tv v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0),
m AS (SELECT query, other, max(ncc) AS turned, arg_max(turn, (ncc, -t)) AS turn, any_value(qu) AS qu FROM s GROUP BY 1, 2),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY turned DESC, other) <= 3)
SELECT query, other, turned, round(list_inner_product(qu, u), 6) AS identity, turn FROM k JOIN u ON u.vec_id = other WHERE turned >= {TURNED} AND round(list_inner_product(qu, u), 6) < {TURNED}""",
        "ssim_pairs": f"""{_P}, th AS (SELECT image_id, max(thumb) AS t FROM image_manifest WHERE readable AND len(thumb) = 100 AND image_id IS NOT NULL GROUP BY 1),
pp AS (SELECT image_a, image_b, a.t AS a, b.t AS b, greatest(list_max(a.t), list_max(b.t))::DOUBLE - least(list_min(a.t), list_min(b.t)) AS sp FROM pr JOIN th a ON a.image_id = image_a JOIN th b ON b.image_id = image_b),
w AS (SELECT image_a, image_b, any_value(CASE WHEN sp > 0 THEN sp ELSE 1.0::DOUBLE END) AS sp, r.r, c.c, avg(a[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE) AS mx, avg(b[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE) AS my,
  var_samp(a[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE) AS vx, var_samp(b[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE) AS vy, covar_samp(a[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE, b[10 * (r.r + i.i) + c.c + j.j + 1]::DOUBLE) AS vxy
  FROM pp, range(4) r(r), range(4) c(c), range(7) i(i), range(7) j(j) GROUP BY image_a, image_b, r.r, c.c)
SELECT image_a, image_b, round(avg((2 * mx * my + pow(0.01::DOUBLE * sp, 2)) * (2 * vxy + pow(0.03::DOUBLE * sp, 2)) / ((mx * mx + my * my + pow(0.01::DOUBLE * sp, 2)) * (vx + vy + pow(0.03::DOUBLE * sp, 2)))), 6) + 0.0::DOUBLE AS ssim FROM w GROUP BY 1, 2""",
        "verify_pairs": f"""{_P}, th AS (SELECT image_id, max(thumb) AS t FROM image_manifest WHERE readable AND thumb IS NOT NULL AND image_id IS NOT NULL GROUP BY 1),
x AS (SELECT image_a, image_b, unnest(a.t)::DOUBLE AS va, unnest(b.t)::DOUBLE AS vb FROM pr JOIN th a ON a.image_id = image_a JOIN th b ON b.image_id = image_b)
SELECT image_a, image_b, round(CASE WHEN var_pop(va) > 0 AND var_pop(vb) > 0 THEN covar_pop(va, vb) / sqrt(var_pop(va) * var_pop(vb)) END, 6) + 0.0::DOUBLE AS ncc, round(avg(abs(va - vb)) / greatest(greatest(max(va), max(vb)) - least(min(va), min(vb)), 1.0::DOUBLE), 6) + 0.0::DOUBLE AS mad_norm, round(avg((va = vb)::INT), 6) + 0.0::DOUBLE AS equal FROM x GROUP BY ALL""",
    }
