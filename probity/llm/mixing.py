"""Mixing sources to target weights (problem 7): proportional-fair block scheduling.

Each source is a task with a weight, its share of the mix. Its tokens come in blocks; block j may not start
before slot floor(j / w) and must be placed by slot ceil((j + 1) / w). Each slot goes to the released block
with the earliest deadline, so that after any number of slots every source is less than one block of tokens away from
its share. Weights are whole numbers in the proportion of the shares (rounded to millionths of the whole, but never to nothing, where the
shares have no common denominator up to a million), so the schedule repeats after their sum: that
one frame is worked out once (its size does not depend on the data) and joined to the sources' blocks.

The documents of a source are ordered by a hash and laid end to end, once more for each repetition, and cut into
pieces at the borders of blocks; running sums are made in two steps, within hashed buckets and over the buckets, so no task holds a whole source.

The mix is a number of slots of the schedule. Without a stated total it ends before the first slot whose source
has no whole block left, so that every share is held; with one, it fills that many tokens' slots, and the slots of a source
that is used up stay empty: its actual share falls short.

Defined cases: sources are compared without case, outer blanks, hyphens or inner blanks; a listed source
without tokens gets nothing, and its share goes to the others in proportion; documents without tokens or of a
source that is not listed are not taken; of a source listed twice the largest share counts; an empty table
gives an empty mix. The last document of a source is taken up to the end of its last block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import sum_before
from ..functions.session import cut, table
from .encode import VOCABULARY, token_count

FINEST = 1_000_000  # the largest sum of weights
BLOCK = 64  # tokens of a block


def weights_of(shares: dict[str, float]) -> dict[str, int]:
    """Whole weights in the proportion of the shares above 0."""
    exact = {s: Fraction(repr(x)) for s, x in shares.items() if x > 0}
    if not exact:
        return {}
    whole = lcm(*(x.denominator for x in exact.values()))
    if whole * sum(exact.values()) > FINEST:
        return {s: max(1, round(x / sum(exact.values()) * FINEST)) for s, x in exact.items()}
    weights = {s: int(x * whole) for s, x in exact.items()}
    return {s: w // gcd(*weights.values()) for s, w in weights.items()}


def frame(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period of sum(weights) slots: earliest deadline first among the released."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights) if weights[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[s]), s, j))
        if not ready:
            continue
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        heapq.heappush(waiting, ((j + 1) * period // weights[s], s, j + 1))
    return out


def plain_source(col: str) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s\-]+", "_")


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have tokens."""
    return documents.select("doc_id", plain_source("source").alias("source"), token_count("text", path).alias("tokens")).where("tokens > 0 and source is not null")


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK) -> tuple[list[dict], list[tuple[str, int, int]]]:
    """One dict a listed source, with what it has, its weight and the tokens it gives, and the frame; the driver gets one row a source."""
    listed = targets.select(plain_source("source").alias("source"), "target_share", "max_repeat").where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs"))
    rows = [r.asDict() for r in listed.join(have, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["available"], r["n_docs"] = r["available"] or 0, r["n_docs"] or 0
        r["most"] = r["available"] * max(r["max_repeat"] or 0, 0) // block  # whole blocks
    weights = weights_of({r["source"]: r["target_share"] or 0.0 for r in rows if r["available"] and (r["max_repeat"] or 0) > 0})
    slots = frame(weights)
    period, at = sum(weights.values()), {(s, j): slot for s, j, slot in slots}
    listed_rows = [r for r in rows if r["source"] in weights]
    if total is None:  # up to the first block that a source has not
        end = min((at[r["source"], r["most"] % weights[r["source"]]] + r["most"] // weights[r["source"]] * period for r in listed_rows), default=0)
    else:
        end = total // block
    for r in rows:
        w = r["weight"] = weights.get(r["source"], 0)
        turns, rest = divmod(end, period) if period else (0, 0)
        scheduled = w * turns + sum(at[r["source"], j] < rest for j in range(w))
        r["quota"] = min(scheduled, r["most"]) * block
    return rows, slots


def mix_pieces(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, per_bucket: int = 5000) -> DataFrame:
    """(slot, source, copy, doc_id, first, last, start, tokens): the mix, one row a piece of a document within a block.

    first and last are the piece's tokens in its document, from 0, start its place in its source's tokens and
    tokens the whole document's number. Slots in order, and pieces by start within a slot, are the interleaved mix; copy counts a document's repetitions from 0.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes)
    rows, slots = plan(sizes, targets, total, block)
    weights = {r["source"]: r["weight"] for r in rows if r["quota"]}
    quotas = spark.createDataFrame([(r["source"], r["available"], r["quota"], max(1, -(-r["n_docs"] // per_bucket)), r["weight"]) for r in rows if r["source"] in weights],
                                   "source string, available bigint, quota bigint, buckets int, weight bigint")
    frame_ = spark.createDataFrame([x for x in slots if x[0] in weights], "source string, j bigint, at bigint")
    docs = cut(sizes.join(F.broadcast(quotas), "source").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", "buckets")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("size")).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.join(offsets, ["source", "bucket"]).withColumn("place", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(quota - 1) div available")))).withColumn("begin", F.col("copy") * F.col("available") + F.col("place"))
    taken = copies.where("begin < quota").withColumn("end", F.least(F.col("begin") + F.col("tokens"), F.col("quota")))
    pieces = taken.withColumn("b", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}")))).withColumns({
        "start": F.greatest("begin", F.col("b") * block), "stop": F.least("end", (F.col("b") + 1) * block), "j": F.expr("b % weight"), "turn": F.expr("b div weight")})
    period = sum(r["weight"] for r in rows)
    return pieces.join(F.broadcast(frame_), ["source", "j"]).select(
        (F.col("at") + F.col("turn") * F.lit(period)).alias("slot"), "source", "copy", "doc_id", (F.col("start") - F.col("begin")).alias("first"),
        (F.col("stop") - F.col("begin") - 1).alias("last"), "start", "tokens")


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, per_bucket: int = 5000) -> DataFrame:
    """(slot, source, copy, doc_id, tokens, start): the mix by documents, each with the slot in which it begins."""
    return mix_pieces(sizes, targets, total, block, per_bucket).where("first = 0").select("slot", "source", "copy", "doc_id", "tokens", "start")


def shares(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, n_taken, most_copies, n_tokens, actual_share): the shares reached."""
    got = cut(pieces.groupBy("source").agg(F.count_if(F.col("first") == 0).alias("n_taken"), F.max(F.col("copy") + 1).alias("most_copies"), F.sum(F.col("last") - F.col("first") + 1).alias("n_tokens")))
    whole = got.agg(F.sum("n_tokens").alias("whole"))
    listed = targets.select(plain_source("source").alias("source"), "target_share", "max_repeat")
    return listed.join(got, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeat", F.coalesce("n_taken", F.lit(0)).alias("n_taken"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.round(F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), "whole"), F.lit(0.0)), 6).alias("actual_share"))


def deviation(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, n_tokens, share, worst): how far each source's tokens are from its share of all tokens so far, in blocks, at the worst point of the mix.

    It is measured before and after each of its slots, between which it only falls behind.
    """
    width = 10_000
    slots = cut(pieces.groupBy("slot", "source").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")))
    slots = sum_before(sum_before(slots, ["source"], "slot", width, "n", "mine"), [], "slot", width, "n", "every")
    per = slots.groupBy("source").agg(F.sum("n").alias("n_tokens"))  # one row a source
    whole = per.agg(F.sum("n_tokens").alias("whole"))
    x = slots.join(F.broadcast(per.join(F.broadcast(whole)).withColumn("share", F.col("n_tokens") / F.col("whole"))), "source")
    off = lambda mine, every: F.abs(mine - F.col("share") * every) / block
    return x.groupBy("source", "n_tokens", "share").agg(F.max(F.greatest(off(F.col("mine"), F.col("every")), off(F.col("mine") + F.col("n"), F.col("every") + F.col("n")))).alias("worst")).select(
        "source", "n_tokens", F.round("share", 6).alias("share"), F.round("worst", 6).alias("worst"))


def _pieces(spark, sf_dir: str, filled: bool = False) -> DataFrame:
    sizes, targets = sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    if not filled:
        return mix_pieces(sizes, targets)
    sizes = cut(sizes)
    return mix_pieces(sizes, targets, total=sizes.agg(F.sum("tokens")).first()[0] or 0)


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """The largest mix in which every source has its share."""
    return _pieces(spark, sf_dir).select("slot", "source", "copy", "doc_id", "first", "last", "start")


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return shares(_pieces(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_deviation(spark, sf_dir: str) -> DataFrame:
    return deviation(_pieces(spark, sf_dir))


def p7_filled_shares(spark, sf_dir: str) -> DataFrame:
    """The shares of a mix of as many tokens as all documents have: sources that are used up fall short of their target."""
    return shares(_pieces(spark, sf_dir, filled=True), table(spark, sf_dir, "mix_targets"))
