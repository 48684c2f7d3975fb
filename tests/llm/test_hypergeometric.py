import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.llm.hypergeometric import FEW, hypergeometric, log_factorial_step


def draws(spark, marked, population, drawn, n=40_000):
    values = [F.lit(x).cast("long") for x in (marked, population, drawn)]
    return np.array([r.x for r in spark.range(n).select(hypergeometric(*values, F.lit(9), "id").alias("x")).collect()])


def mass(marked, population, drawn):
    """The probability mass by products of whole numbers."""
    low, high = max(0, drawn + marked - population), min(marked, drawn)
    return low, np.array([math.comb(marked, k) * math.comb(population - marked, drawn - k) / math.comb(population, drawn) for k in range(low, high + 1)])


@pytest.mark.parametrize(("marked", "population", "drawn"), [(FEW, 60, 30), (FEW + 1, 60, 30), (200, 1000, 300), (300, 1000, 700), (800, 1000, 450), (900, 1000, 950), (17, 34, 17), (40, 100_000, 50_000), (3, 10, 4), (7, 10, 8)])
def test_distribution_on_both_sides_of_the_bound(spark, marked, population, drawn):
    got = draws(spark, marked, population, drawn)
    low, p = mass(marked, population, drawn)
    counts = np.bincount(got - low, minlength=len(p))
    assert got.min() >= low and len(counts) == len(p)
    expected = p * len(got)
    big = expected >= 5
    chi = ((counts[big] - expected[big]) ** 2 / expected[big]).sum() + (abs(counts[~big].sum() - expected[~big].sum()) ** 2 / max(1.0, expected[~big].sum()))
    freedom = big.sum()
    assert chi < freedom + 5 * math.sqrt(2 * freedom) + 5


def test_huge_counts(spark):
    marked, population, drawn = 4_000_000_000, 30_000_000_000, 11_000_000_000
    got = draws(spark, marked, population, drawn, 20_000)
    mean = marked * drawn / population
    deviation = math.sqrt(mean * (1 - marked / population) * (population - drawn) / (population - 1))
    z = (got - mean) / deviation
    assert abs(z.mean()) < 4 / math.sqrt(len(z)) and abs(z.std() - 1) < 0.02
    normal = np.sort(np.random.default_rng(1).normal(size=200_000))
    assert abs(np.quantile(z, [0.01, 0.1, 0.5, 0.9, 0.99]) - np.quantile(normal, [0.01, 0.1, 0.5, 0.9, 0.99])).max() < 0.08


def test_edges(spark):
    for marked, population, drawn, want in ((0, 10, 5, 0), (10, 10, 5, 5), (5, 10, 0, 0), (5, 10, 10, 5), (0, 0, 0, 0), (10**12, 10**12, 10**11, 10**11)):
        assert set(draws(spark, marked, population, drawn, 20)) == {want}
    assert (draws(spark, 50, 100, 50, 200) == draws(spark, 50, 100, 50, 200)).all()


def test_factorial_steps(spark):
    cases = [(n, k) for n in (0, 1, 5, 40, 1000, 10**6) for k in (-min(n, 7), 0, 1, 12, 300) if n + k >= 0]
    rows = spark.createDataFrame([(float(n), float(k)) for n, k in cases], "n double, k double").select(log_factorial_step(F.col("n"), F.col("k"))).collect()
    for (n, k), row in zip(cases, rows, strict=True):
        assert row[0] == pytest.approx(math.lgamma(n + k + 1) - math.lgamma(n + 1), abs=2e-8, rel=1e-9)
