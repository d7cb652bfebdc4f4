"""Phred scores and error probabilities, as Python functions for lookup tables built on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from molframe.functions.bind import let

LEAST, MOST, PRECISION = 2, 93, 0.001
TIE = 2.220446049250313e-16
BASES = "ACGT"


def ln_error(q: int) -> float:
    return -q * math.log(10) / 10


def ln_not(x: float) -> float:
    """ln(1 - e^x)."""
    if x >= 0:
        return -math.inf
    return math.log1p(-math.exp(x)) if x < -math.log(2) else math.log(-math.expm1(x))


def two_trials(x: float, y: float) -> float:
    """ln of the probability that of two trials with log error probabilities x and y one or both err to a wrong base: p + q - 4/3 pq; the larger alone where it is far larger."""
    a, b = max(x, y), min(x, y)
    if a - b >= 6:
        return a
    return math.log(math.exp(a) + math.exp(b) - 4 / 3 * math.exp(a + b))


def to_phred(ln_p: float) -> int:
    if ln_p < ln_error(MOST):
        return MOST
    return max(LEAST, min(MOST, math.floor(-10 * ln_p / math.log(10) + PRECISION)))


def right_and_wrong(post_umi: int) -> tuple[list[float], list[float]]:
    """By base quality: log-likelihood of a read's base if it is the true one, and if a given other one is."""
    adjusted = [two_trials(ln_error(post_umi), ln_error(q)) for q in range(MOST + 1)]
    return [ln_not(x) for x in adjusted], [x - math.log(3) for x in adjusted]


def single_read(pre_umi: int, post_umi: int) -> list[int]:
    """By base quality: the quality of a consensus of one read."""
    return [to_phred(two_trials(ln_error(q), ln_error(min(pre_umi, post_umi)))) for q in range(MOST + 1)]


def looked_up(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def called(scores: Column, pre_umi: int) -> Column:
    """struct<base, qual> of four log-likelihoods (A, C, G, T): the unique greatest and its posterior error, or N at the least quality where another comes within TIE of it."""
    pre = ln_error(pre_umi)
    none = F.struct(F.lit("N").alias("base"), F.lit(LEAST).alias("qual"))

    def best_of(s: Column) -> Column:
        return F.struct(s["scores"].alias("scores"), s["best"].alias("best"), (F.array_position(s["scores"], s["best"]).cast("int") - 1).alias("at"))

    def call(x: Column) -> Column:
        # a later lane that ties the greatest voids the call
        ties = F.exists(F.transform(x["scores"], lambda v, i: (i > x["at"]) & (F.abs(v - x["best"]) <= TIE)), lambda t: t)
        others = F.aggregate(F.transform(x["scores"], lambda v, i: F.when(i == x["at"], F.lit(0.0)).otherwise(F.exp(v - x["best"]))), F.lit(0.0), lambda s, v: s + v)
        base = F.substring(F.lit(BASES), x["at"] + 1, F.lit(1))
        return F.when(ties, none).otherwise(F.struct(base.alias("base"), let(others, quality).alias("qual")))

    def quality(others: Column) -> Column:
        return let(F.log(others) - F.log1p(others), lambda wrong: F.when(others == 0, to_qual(F.lit(pre))).otherwise(let(both_trials(wrong), to_qual)))

    def both_trials(wrong: Column) -> Column:
        high, low = F.greatest(wrong, F.lit(pre)), F.least(wrong, F.lit(pre))
        return F.when(high - low >= 6, high).otherwise(F.log(F.exp(high) + F.exp(low) - F.lit(4 / 3) * F.exp(high + low)))

    def to_qual(ln_p: Column) -> Column:
        whole = F.floor(ln_p * F.lit(-10 / math.log(10)) + F.lit(PRECISION)).cast("int")
        return F.when(ln_p < ln_error(MOST), MOST).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), whole))).cast("int")

    bound = let(F.struct(scores.alias("scores")), lambda s: F.struct(s["scores"].alias("scores"), F.array_max(s["scores"]).alias("best")))
    return let(let(bound, best_of), call)
