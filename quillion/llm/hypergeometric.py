"""Exact hypergeometric draws as Column expressions, in time that doesn't grow with the counts.

Where one of the four groups (drawn or not, marked or not) is small, its members are dealt one by one.
Otherwise a ratio-of-uniforms rejection (Stadlober's HRUA) proposes counts around the mean and
accepts them by the probability mass relative to the mode, from Stirling's series in a form whose
large terms cancel. Both give the same distribution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillion.llm.common import bind

SCALE = float(2**53)
FEW = 16
#: A proposal is accepted with a chance of over a half, so that all fail once in 2 ** 64 draws; then the mode is taken.
TRIES = 64
# Fixed values of the rejection's hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
HAT_WIDTH, HAT_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
SHIFT = 8


def uniform(*columns) -> Column:
    """A repeatable draw from [0, 1) for the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(SCALE)


def log_factorial_step(n: Column, k: Column) -> Column:
    """ln (n + k)! - ln n!, for n and n + k of 0 or more."""
    ratio = F.lit(1.0)
    for i in range(1, SHIFT + 1):
        ratio = ratio * (n + k + i) / (n + i)
    x, y = n + (1 + SHIFT), n + k + (1 + SHIFT)

    def rest(z: Column) -> Column:
        return 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)

    return (x - 0.5) * F.log1p(k / x) + k * F.log(y) - k + rest(y) - rest(x) - F.log(ratio)


def dealt_one_by_one(few: Column, others: Column, population: Column, keys: list) -> Column:
    """How many of `few` members are among `others` of a population, each placed in turn."""

    def place(state: Column, i: Column) -> Column:
        hit = uniform(*keys, i) * state["left"] < state["open"]
        return F.struct((state["left"] - 1).alias("left"), (state["open"] - hit.cast("long")).alias("open"))

    start = F.struct(population.alias("left"), others.alias("open"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), few), start, place, lambda s: others - s["open"])


def rejected(few: Column, others: Column, population: Column, keys: list) -> Column:
    """The same count for few and others of over FEW, neither over half of the population."""
    n = population.cast("double")
    a, b = few.cast("double"), others.cast("double")
    mean = a * b / n
    deviation = F.sqrt((n - b) * b * (a / n) * (1 - a / n) / (n - 1) + 0.5)
    fixed = F.struct(
        (mean + 0.5).alias("centre"), (deviation * HAT_WIDTH + HAT_SHIFT).alias("width"),
        F.floor((b + 1) * (a + 1) / (n + 2)).cast("double").alias("mode"), F.least(a, b).alias("most"),
    )

    def drawn(c: Column) -> Column:
        def propose(found: Column, i: Column) -> Column:
            def judge(p: Column) -> Column:
                step = p["z"] - c["mode"]
                mass = -(
                    log_factorial_step(c["mode"], step) + log_factorial_step(a - c["mode"], -step)
                    + log_factorial_step(b - c["mode"], -step) + log_factorial_step(n - a - b + c["mode"], step)
                )
                inside = (p["z"] >= 0) & (p["z"] <= c["most"])
                return F.when(inside & (2 * F.log(p["u"]) <= F.when(inside, mass)), p["z"].cast("long"))

            u = F.greatest(uniform(*keys, i, F.lit(1)), F.lit(1 / SCALE))
            z = F.floor(c["centre"] + c["width"] * (uniform(*keys, i, F.lit(2)) - 0.5) / u).cast("double")
            return F.when(found.isNotNull(), found).otherwise(bind(F.struct(u.alias("u"), z.alias("z")), judge))

        tries = F.sequence(F.lit(1), F.lit(TRIES))
        return F.coalesce(F.aggregate(tries, F.lit(None).cast("long"), propose), c["mode"].cast("long"))

    return bind(fixed, drawn)


def hypergeometric(marked: Column, population: Column, drawn: Column, *keys) -> Column:
    """How many of `marked` members of a population are among `drawn` ones; whole numbers (long), repeatable for the keys.

    marked and drawn are 0 to population. The count is symmetric in both, and each can be
    replaced by the population's rest, so halves of the population at most are looked at.
    """
    keys = list(keys)

    def of(p: Column) -> Column:
        a, b, n = p["a"], p["b"], p["n"]  # a <= b <= n / 2
        x = F.when(a <= 0, F.lit(0).cast("long")).when(a <= FEW, dealt_one_by_one(a, b, n, keys)).otherwise(rejected(a, b, n, keys))

        def back(x: Column) -> Column:
            rest = F.when(p["other_drawn"], p["low_marked"] - x).otherwise(x)  # among the drawn ones
            return F.when(p["other_marked"], drawn - rest).otherwise(rest)

        return bind(x, back)

    low_marked, low_drawn = F.least(marked, population - marked), F.least(drawn, population - drawn)
    parts = F.struct(
        F.least(low_marked, low_drawn).alias("a"), F.greatest(low_marked, low_drawn).alias("b"), population.alias("n"), low_marked.alias("low_marked"),
        (low_marked != marked).alias("other_marked"), (low_drawn != drawn).alias("other_drawn"),
    )
    return bind(parts, of)
