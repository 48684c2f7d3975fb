"""Worked values of the scoring formulas."""

import math

import pytest
from pyspark.sql import functions as F

from quillion.functions import scoring, text, vector


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: scoring.bm25_idf(lit(1), lit(10)), math.log(9.5 / 1.5 + 1)),
        (lambda: scoring.bm25_idf(lit(0), lit(10)), 0.0),
        (lambda: scoring.bm25_idf(lit(1), lit(0)), 0.0),
        (lambda: scoring.bm25_tf(lit(1), lit(10.0), lit(10.0)), 1.0),
        (lambda: scoring.beta_confidence(lit(1.0), lit(1.0)), 0.5),
        (lambda: scoring.beta_confidence(lit(0.0), lit(0.0)), 0.5),
        (lambda: scoring.effective_strength(lit(1.0), lit(30.0)), math.exp(-0.693)),
        (lambda: scoring.recency_weight(lit(7.0)), math.exp(-1)),
        (lambda: scoring.compounded(0.7, lit(3)), 0.973),
        (lambda: scoring.linear_decay(lit(1.0), lit(91.0)), 0.1),
        (lambda: scoring.linear_decay(lit(1.0), lit(20.0)), 0.9),
        (lambda: F.levenshtein(lit("kitten"), lit("sitting")).cast("double"), 3.0),
        (lambda: scoring.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0)), math.pi * 6371),
        (lambda: vector.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0))), 1 / math.sqrt(2)),
        (lambda: vector.euclidean(F.array(lit(0.0), lit(3.0)), F.array(lit(4.0), lit(0.0))), 5.0),
        (lambda: text.edit_ratio(lit("kitten"), lit("sitting")), 3 / 7),
        (lambda: text.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c"))), 1 / 3),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == pytest.approx(want, abs=1e-9)


def test_spaced_repetition(spark):
    state = lambda ef, interval, reps: F.struct(lit(ef).alias("ef"), lit(interval).cast("long").alias("interval"), lit(reps).cast("long").alias("reps"))
    up = value(spark, scoring.sm2_step(state(2.5, 6, 2), lit(5)))
    assert (up.ef, up.interval, up.reps) == (pytest.approx(2.6), 15, 3)
    down = value(spark, scoring.sm2_step(state(2.5, 15, 3), lit(1)))
    assert (down.ef, down.interval, down.reps) == (pytest.approx(1.96), 1, 0)


@pytest.mark.parametrize(("confidence", "evidence", "tier"), [(0.95, 10, "CERTAIN"), (0.95, 9, "HIGH"), (0.7, 3, "MEDIUM"), (0.7, 2, "LOW"), (0.1, 50, "SPECULATIVE")])
def test_veracity_tier(spark, confidence, evidence, tier):
    assert value(spark, scoring.veracity_tier(lit(confidence), lit(evidence))) == tier
