"""Column expressions of the evaluation audit: identifiers, bins, scores, guarded arithmetic, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h(x, salt) -> Column:
    """A deterministic hash of a non-negative BIGINT into [0, P), the same in any SQL engine; stands in for a generator."""
    x, salt = col(x).cast("bigint"), (F.lit(salt) if isinstance(salt, int) else salt).cast("bigint")
    a = (x * 48271 + salt * 69621 + 1) % P
    b = (a * 16807 + salt) % P
    return (b * b + a) % P


# identifiers

def strict_stem(pid) -> Column:
    """MR, six digits and one capital letter lose the letter; anything else stays."""
    return F.regexp_replace(col(pid), r"^(MR[0-9]{6})[A-Z]$", "$1")


def loose_stem(pid) -> Column:
    """Any trailing letters of an id that starts with MR go."""
    return F.when(col(pid).startswith("MR"), F.regexp_replace(col(pid), "[A-Za-z]+$", "")).otherwise(col(pid))


def id_format(pid) -> Column:
    c = col(pid)
    return (F.when(c.rlike(r"^MR[0-9]{6}[A-Z]$"), "MR_suffix").when(c.rlike(r"^MR[0-9]{6}$"), "MR_plain")
            .when(c.rlike(r"^[0-9]+$"), "numeric").otherwise("other"))


def pair_category(patient_a, patient_b, fold_a, fold_b) -> Column:
    return F.concat(F.when(col(patient_a) == col(patient_b), "within").otherwise("cross"), F.lit("-patient/"),
                    F.when(col(fold_a) == col(fold_b), "within").otherwise("cross"), F.lit("-fold"))


# scores of one row

def argmax(probs) -> Column:
    """The first position of the largest value, from 0."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def bin15(confidence) -> Column:
    """Right-closed bins of width 1/15: 0..14."""
    return F.greatest(F.lit(0), F.least(F.lit(14), F.ceil(col(confidence) * F.lit(15.0)).cast("int") - 1))


def brier(probs, truth) -> Column:
    """The sum of squared differences to the one-hot truth, 0..2."""
    parts = [F.pow(probs[k] - F.when(col(truth) == k, 1.0).otherwise(0.0), F.lit(2.0)) for k in range(3)]
    return parts[0] + parts[1] + parts[2]


def nll(probs, truth) -> Column:
    return -F.log(F.least(F.greatest(F.element_at(probs, col(truth) + 1), F.lit(1e-12)), F.lit(1.0)))


def softmax(logits) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def count_bin(n) -> Column:
    c = col(n)
    return F.when(c == 0, "0").when(c <= 9, "1-9").when(c <= 13, "10-13").when(c <= 17, "14-17").otherwise("18+")


def share_bin(x) -> Column:
    c = col(x)
    return (F.when(c.isNull(), "NA").when(c == 0, "0").when(c <= F.lit(0.65), "(0,0.65]").when(c <= F.lit(0.8), "(0.65,0.8]")
            .when(c <= F.lit(0.9), "(0.8,0.9]").otherwise("(0.9,1]"))


# guarded arithmetic

def safe_div(a, b) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def div(a, b) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def close(a, b, tolerance: float = 1e-12) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(tolerance)


def finite(x) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf")))


# pictures as arrays

def centred(v) -> Column:
    v = F.transform(col(v), lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def display_pixels(v) -> Column:
    """0..255 by the picture's own range, cut off, a constant picture all 0."""
    v = col(v)
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    return F.transform(v, lambda x: F.when(lo == hi, 0).otherwise(F.floor(F.lit(255.0) / (hi - lo) * (x.cast("double") - lo)).cast("int")))
