"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The
model is fitted on the driver from a bounded sample of labelled rows (`per_class` of each
class, by a hash of the id) and scores every document in the scan, without a shuffle. Labels
that only tell toxic from clean are graded first: toxic documents of the sample are cut into
terciles by their log-odds in a first fit of toxic against clean.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import unused

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4
PREFIXES = (4, 5, 6, 7)


def terms(text: str | None) -> Counter:
    """Counts of the lower-cased runs of letters, and of their beginnings (as "begin~")."""
    words = Counter(WORD.findall((text or "").lower()))
    found = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                found[word[:size] + "~"] += n
    return found


@dataclass
class OrdinalModel:
    """Vocabulary, shared weights and ordered thresholds."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def probabilities(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of one text."""
        if not self.vocabulary:
            return np.zeros(len(self.thresholds))
        counts, score = terms(text), 0.0
        for term in counts.keys() & self.vocabulary.keys():
            score += self.weights[self.vocabulary[term]] * (1 + np.log(counts[term]))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -700, 700)))


def root_ratio(b: int, g: int, nb: int, ng: int) -> float:
    """Square root of the likelihood ratio statistic for a term in b of nb and g of ng texts; it holds for rare terms too."""
    n, total = nb + ng, 0.0
    for seen, row, col in ((b, nb, b + g), (g, ng, b + g), (nb - b, nb, n - b - g), (ng - g, ng, n - b - g)):
        if seen:
            total += seen * np.log(seen * n / (row * col))
    return float(np.sqrt(max(0.0, 2 * total)))


def choose_terms(texts: list[str | None], toxic: np.ndarray, most: int, least_df: int = 4, least_root: float = 4.0) -> list[str]:
    """Terms whose document frequencies differ between the classes, by likelihood ratio.

    A table of hashed counts tells the terms that fewer than least_df texts hold, so that only
    the others are kept in memory.
    """
    slots = np.zeros(1 << 22, np.int32)
    for text in texts:
        slots[np.unique(np.fromiter((hash(t) & 0x3FFFFF for t in terms(text)), np.int64))] += 1
    bad, good = Counter(), Counter()
    for text, t in zip(texts, toxic.tolist(), strict=True):
        (bad if t else good).update(x for x in terms(text) if slots[hash(x) & 0x3FFFFF] >= least_df)
    nb, ng = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    scored = []
    for term in bad.keys() | good.keys():
        b, g = bad[term], good[term]
        if b + g < least_df:
            continue
        if (z := root_ratio(b, g, nb, ng)) >= least_root:
            scored.append((-z, term, (term[: PREFIXES[0]], b, g)))
    kept, seen = [], set()
    for _, term, same in sorted(scored):  # a word and its beginnings with the same counts are one feature
        if same not in seen:
            seen.add(same)
            kept.append(term)
    return kept[:most]


def descend(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, share: np.ndarray, levels: int, w: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by gradient steps with momentum (Adam).

    Thresholds are the first one plus sums of exponentials, so they stay in order.
    """
    n, m = len(grade), len(w)
    above = (grade[:, None] > np.arange(levels)[None, :]).astype(float)
    p = np.concatenate((w, [1.0], np.zeros(levels - 1)))
    first, second = np.zeros_like(p), np.zeros_like(p)
    cut = np.zeros(levels)
    for step in range(1, rounds + 1):
        cut = p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1 :]))))
        score = np.bincount(row, weights=p[:m][col] * value, minlength=n)
        chance = 1 / (1 + np.exp(np.clip(cut[None, :] - score[:, None], -50, 50)))
        error = share[:, None] * (chance - above)
        by_row, by_cut = error.sum(axis=1), error.sum(axis=0)
        grad = np.empty_like(p)
        grad[:m] = np.bincount(col, weights=by_row[row] * value, minlength=m) + ridge * p[:m]
        grad[m] = -by_cut.sum()
        grad[m + 1 :] = -np.exp(p[m + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p[:m].copy(), p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1 :]))))


def fit(texts: list[str | None], toxic: list[int], weights: list[float], most_terms: int = 4096, rounds: int = 1500, ridge: float = 1e-5) -> OrdinalModel:
    """Grade the sample by a first fit of toxic against clean, then fit all thresholds.

    A sample of one class gives a model of zero severity.
    """
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return OrdinalModel()
    vocabulary = {t: k for k, t in enumerate(choose_terms(texts, y, most_terms))}
    entries = [(r, vocabulary[t], 1 + np.log(c[t])) for r, c in enumerate(map(terms, texts)) for t in sorted(c.keys() & vocabulary.keys())]
    row, col = np.array([e[0] for e in entries], int), np.array([e[1] for e in entries], int)
    value, share = np.array([e[2] for e in entries], float), np.array(weights, float) / np.sum(weights)
    w, _ = descend(row, col, value, y.astype(int), share, 1, np.zeros(len(vocabulary)), rounds, ridge)
    score = np.bincount(row, weights=w[col] * value, minlength=len(y))
    grade = np.zeros(len(y), int)
    ranks = np.argsort(np.argsort(score[y], kind="stable"), kind="stable")
    grade[y] = 1 + ranks * (GRADES - 1) // int(y.sum())
    w, cut = descend(row, col, value, grade, share, GRADES - 1, w, rounds, ridge)
    return OrdinalModel(vocabulary, w, cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> list:
    """Rows (text, toxic, weight): per_class of each class at most; weights restore the classes' sizes."""
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    size = dict(known.groupBy("toxic").count().collect())
    rows = []
    for label, n in sorted(size.items()):
        chosen = known.where(F.col("toxic") == label).sort(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class).select("doc_id").distinct()
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()  # per_class rows
        rows += [(r["text"], label, n / max(1, len(texts))) for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"] or ""))]
    return rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> OrdinalModel:
    """The model of a sample of labelled documents, per_class of each class at most."""
    rows = labelled_sample(docs, labels, per_class)
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) if rows else OrdinalModel()


def severity(spark, text: Column, model: OrdinalModel) -> Column:
    """struct<severity, p_toxic, grade> of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.DataFrame:
        above = np.array([shared.value.probabilities(t) for t in texts]).reshape(len(texts), -1)
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (above > 0.5).sum(axis=1).astype("int32")})

    return F.pandas_udf(score, "severity double, p_toxic double, grade int")(text)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, model: OrdinalModel | None = None) -> DataFrame:
    """docs with severity (expected grade, 0 to 3), grade (the largest that is more likely than not) and toxic (grade >= 1).

    Columns of docs with these names are replaced. Null and empty texts have no features and
    get the severity of the thresholds alone; labels with nulls are left out; without labels of
    both classes every severity is 0; repeated rows are each scored; an empty table gives none.
    """
    model = model or train(docs, labels, per_class)
    scored = unused("_scored", docs)
    rows = docs.select("*", severity(docs.sparkSession, F.col("text"), model).alias(scored))
    kept = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    return rows.select(*kept, f"{scored}.severity", f"{scored}.grade", (F.col(f"{scored}.grade") >= 1).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 3000, model: OrdinalModel | None = None) -> DataFrame:
    """docs without those found toxic; same columns, with their own values."""
    model = model or train(docs, labels, per_class)
    return docs.where(severity(docs.sparkSession, F.col("text"), model)["grade"] < 1)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")
