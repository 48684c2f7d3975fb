"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose labels say so; all texts that may be learned from are the
unlabelled ones, whatever their labels; no negative label is read. With f = w.x and squared
losses, (1 - f)^2 for a positive and (1 + f)^2 for a negative, the risk is

    prior * E_p[(1 - f)^2] + max(0, E_u[(1 + f)^2] - prior * E_p[(1 + f)^2])

(the second part estimates the negatives' risk, which can't be below zero). Both expectations
are quadratic in w, so second moments of the features are all that the fit needs: one pass over
every text, in which each task sums a matrix of fixed size. The class prior is estimated from
the same classes: over score thresholds, the least ratio of the unlabelled share above to the
positives' share above, each half of the texts scored by a fit of the other.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm.common import shared_dir, unused

PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Each byte's class: lower and upper case, digit, space, line break, beyond ASCII, or the mark itself.
SHAPES = np.array([97 if 97 <= b < 123 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 32 if b == 32 else 10 if 9 <= b < 14 else 128 if b >= 128 else b for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
CLASSES = [97, 65, 48, 32, 10, 128, *PUNCTUATION]
SHAPE_BUCKETS, PAIR_BUCKETS = 64, 128
PIECE = 1 << 20
THRESHOLDS = np.linspace(-1.5, 1.5, 601)


def buckets(n: int, salt: int) -> np.ndarray:
    """A bucket of n for each pair of bytes."""
    return ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(salt)) % np.uint64(1 << 32) >> np.uint64(15)).astype(np.int64) % n


SHAPE_BUCKET, PAIR_BUCKET = buckets(SHAPE_BUCKETS, 17), buckets(PAIR_BUCKETS, 40503)


def pair_counts(data: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n)
    for at in range(0, max(0, len(data) - 1), PIECE):
        some = data[at : at + PIECE + 1].astype(np.uint16)
        total += np.bincount(bucket[(some[:-1] << 8) | some[1:]], minlength=n)
    return total


def features(text: str | None) -> np.ndarray:
    """Numbers between 0 and 1 or so of a whole text: lengths, repetition, shares of byte classes and of hashed pairs of bytes; the last is 1."""
    raw = (text or "").encode()
    n, words = len(raw), raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    data = np.frombuffer(raw, np.uint8)
    shapes = SHAPES[data]
    some, counts = max(1, len(words)), {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    shares = np.bincount(shapes, minlength=129)[CLASSES] / max(1, n)
    head = [np.log1p(len(words)) / 10, float(not words), len(counts) / some, len(set(lines)) / max(1, len(lines)), min(4.0, (n - len(words)) / (12 * some)), len(lines) / some, max(counts.values(), default=0) / some, len(zlib.compress(raw, 1)) / max(32, n)]
    pairs = max(1, n - 1)
    return np.concatenate((head, np.sqrt(shares), np.sqrt(pair_counts(shapes, SHAPE_BUCKET, SHAPE_BUCKETS) / pairs), np.sqrt(pair_counts(LOWER[data], PAIR_BUCKET, PAIR_BUCKETS) / pairs), [1.0])).astype("<f2")


SIZE = len(features(""))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f2").reshape(-1, SIZE).astype(np.float64)


@dataclass
class Model:
    """Weights and the estimated class prior; without trusted positives every score is 0.5."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    prior: float = 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.round(np.clip((1 + rows @ self.weights) / 2, 0, 1), 9)


def featurise(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, held_out, fold, features) of each row, written once to the shared folder."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/features-{uuid.uuid4()}"
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"), F.col(text_col).cast("string").alias("text"))

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    rows.select("doc_id", "held_out", "fold", F.pandas_udf(of, "binary")("text").alias("features")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def trusted(labels: DataFrame, most_positives: int) -> DataFrame:
    """Ids of about most_positives rows at most, by a hash, whose labels all say 1 and which aren't held out."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = good.where("least = 1 and most = 1").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id")
    slots = 1 << 30
    share = min(1.0, most_positives / max(1, good.count()))
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(slots)) < int(slots * share))


def add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x x' of a task's rows: unlabelled ones (parts 0 and 1, by fold) and positives (2 and 3)."""
    sums = np.zeros((4, SIZE, SIZE))
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            some = batch.slice(at, 2_000)
            x, fold, positive = matrix(some.column("features")), some.column("fold").to_numpy(), some.column("positive").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                for part, rows in ((k, x[fold == k]), (2 + k, x[(fold == k) & positive])):
                    sums[part] += rows.T @ rows
    part, row = np.divmod(np.arange(4 * SIZE), SIZE)
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(row, pa.int32()), pa.array([r.tobytes() for r in sums.reshape(-1, SIZE)], pa.binary())], names=["part", "row", "sums"])


def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each (part, row) of a task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[part, row] = sums.get((part, row), 0) + np.frombuffer(raw)
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)] + [pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "row", "sums"])


def moments(rows: DataFrame) -> np.ndarray:
    """Sums of x x' over all rows, of shape (4, SIZE, SIZE); what comes to the driver has this size whatever the input."""
    schema = "part int, row int, sums binary"
    partial = rows.select("fold", "positive", "features").mapInArrow(add_moments, schema)
    total = np.zeros((4, SIZE, SIZE))
    for r in partial.repartition("part", "row").mapInArrow(add_rows, schema).collect():
        total[r["part"], r["row"]] += np.frombuffer(bytes(r["sums"]))
    return total


def solve(quadratic: np.ndarray, linear: np.ndarray, ridge: float) -> np.ndarray:
    """The w that minimises w'Qw - 2w'l + ridge |w|^2, the constant's weight left out."""
    penalty = np.full(SIZE, ridge)
    penalty[-1] = 1e-9
    return np.linalg.solve(quadratic + np.diag(penalty), linear)


def fit(unlabelled: np.ndarray, positive: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of the least non-negative risk, from E[x x'] of both kinds (their last rows are E[x]).

    Where the unconstrained fit makes the negatives' part negative, the optimum lies where that
    part is zero: its weight (1 where nothing is wrong) is found by bisection.
    """

    def at(share: float) -> np.ndarray:
        return solve(prior * (1 - share) * positive + share * unlabelled, prior * positive[-1] - share * (unlabelled[-1] - prior * positive[-1]), ridge)

    def negative_part(w: np.ndarray) -> float:
        return float(w @ unlabelled @ w + 2 * unlabelled[-1] @ w + 1 - prior * (w @ positive @ w + 2 * positive[-1] @ w + 1))

    if negative_part(w := at(1.0)) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if negative_part(at(middle)) > 0 else (low, middle)
    return at(high)


def estimate_prior(rows: DataFrame, sums: np.ndarray, ridge: float) -> float:
    """Least ratio of shares above a threshold, among those that leave half of the positives above."""
    means = [m / max(1.0, m[-1, -1]) for m in sums]
    against = np.array([solve(means[2 + k] + means[k], means[2 + k][-1] - means[k][-1], 2 * ridge) for k in (1, 0)])  # fold 0 is scored by the fit of fold 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, len(THRESHOLDS) + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                score = np.einsum("ij,ij->i", matrix(some.column("features")), against[some.column("fold").to_numpy()])
                bins, positive = np.searchsorted(THRESHOLDS, score, side="right"), some.column("positive").to_numpy(zero_copy_only=False)
                found += [np.bincount(b, minlength=len(THRESHOLDS) + 1) for b in (bins, bins[positive])]
        kind, at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(found[kind, at], pa.int64())], names=["kind", "bin", "n"])

    above = np.zeros((2, len(THRESHOLDS) + 1))
    for r in rows.select("fold", "positive", "features").mapInArrow(count, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():  # 1,204 rows at most
        above[r["kind"], r["bin"]] = r["n"]
    above = np.cumsum(above[:, ::-1], axis=1)[:, ::-1] / np.maximum(1, above.sum(axis=1, keepdims=True))
    ratio = above[0, 1:] / np.maximum(above[1, 1:], 1e-12)
    return float(np.clip(ratio[above[1, 1:] >= 0.5].min(initial=1.0), 0.01, 1.0))


def train(rows: DataFrame, labels: DataFrame, most_positives: int, prior: float | None) -> Model:
    """The model of featurised rows; held-out rows give neither labels nor texts."""
    positives = trusted(labels, most_positives).select("doc_id", F.lit(True).alias("positive"))
    known = rows.where(~F.col("held_out")).join(F.broadcast(positives), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    sums = moments(known)
    n_unlabelled, n_positive = sums[0, -1, -1] + sums[1, -1, -1], sums[2, -1, -1] + sums[3, -1, -1]
    if not n_positive:
        return Model()
    ridge = 1e-3 + 1 / n_positive
    if prior is None:
        prior = estimate_prior(known, sums, 1e-3 + 2 / n_positive)
    return Model(fit((sums[0] + sums[1]) / n_unlabelled, (sums[2] + sums[3]) / n_positive, prior, ridge), prior)


def model_of(docs: DataFrame, labels: DataFrame, text_col: str = "text", most_positives: int = 50_000, prior: float | None = None) -> Model:
    """A model to score other tables with."""
    return train(featurise(docs, text_col), labels, most_positives, prior)


def score_column(spark: SparkSession, text: Column, model: Model) -> Column:
    """The score of a text column."""
    shared = spark.sparkContext.broadcast(model)  # SIZE numbers

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.array([features(t) for t in texts]).reshape(-1, SIZE).astype(np.float64)))

    return F.pandas_udf(score, "double")(text)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score 0.5 or more, with their own columns."""
    score = unused("_score", docs)
    return docs.withColumn(score, score_column(docs.sparkSession, F.col(text_col), model)).where(F.col(score) >= 0.5).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", most_positives: int = 50_000, prior: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    held_out: crc32 of the id as text leaves 1 when divided by 3; such rows are only scored.
    Moments and the prior cover every other row; positives are about most_positives at most, by
    a hash of the id, so that their ids can be broadcast. Null and empty texts have features
    too and get a score. Labels with nulls, and ids whose labels disagree, aren't trusted;
    without trusted positives every score is 0.5. Rows without an id are unlabelled texts.
    Repeated rows are each scored; other columns are ignored; an empty table gives no rows.
    """
    rows = featurise(docs, text_col)
    model = train(rows, labels, most_positives, prior)

    def score(found: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.frombuffer(b"".join(found), "<f2").reshape(-1, SIZE).astype(np.float64)))

    scored = rows.select("doc_id", "held_out", F.pandas_udf(score, "double")("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
