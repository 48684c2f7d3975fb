"""Likeness of strings by matching blocks, fuzzy lookup, combined similarity, and MinHash signatures in bands."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import relations
from quillion.sources.shared import saved


class Automaton:
    """The suffix automaton of a string: its states are its distinct blocks' classes, each with the place where its blocks first end."""

    def __init__(self, s: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(s):
            new = self._state({}, -1, self.length[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.end[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, following: dict[str, int], link: int, length: int, end: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.length) - 1

    def longest_block(self, other: str) -> tuple[int, int, int]:
        """(length, start here, start in other) of the longest common block; the first here, then the first in other, of equal ones."""
        best, state, n = (0, 0, 0), 0, 0
        for at, c in enumerate(other):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n >= best[0] and n:
                here = self.end[state] - n + 1
                if n > best[0] or here < best[1]:
                    best = (n, here, at - n + 1)
        return best


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common block, and so on to its left and to its right."""
    total, open_parts = 0, [(a, b)]
    while open_parts:
        x, y = open_parts.pop()
        if not x or not y:
            continue
        n, i, j = Automaton(x).longest_block(y)
        if n:
            total += n
            open_parts += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def block_ratio(a: str, b: str) -> float:
    """Twice the matched characters over both lengths; 1 for two empty strings."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def block_ratios(a: Column, b: Column) -> Column:
    """block_ratio of two columns; null where one is null."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else block_ratio(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def fuzzy_get(df: DataFrame, name: str, field: str = "content", least: float = 0.5, k: int = 1) -> DataFrame:
    """(id, score): the k rows whose field is most like the name by matching blocks, ties by id; every row counts.

    A row whose length alone keeps it below the bound isn't compared.
    """
    value, size = F.lower(field), F.length(F.lower(field))
    possible = 2 * F.least(size, F.lit(len(name))) >= least * (size + len(name))
    rows = df.where(size > 0).where(possible).select("id", block_ratios(F.lit(name.lower()), value).alias("score"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def combined_pairs(df: DataFrame, least: float = 0.75, text_col: str = "content", words_share: float = 0.4) -> DataFrame:
    """(a, b, similarity): pairs of rows, a < b, by .4 of the words' Jaccard and .6 of the block ratio of their normalised texts.

    As the ratio is 1 at most, the words' Jaccard of a pair must reach (least - .6) / .4: candidates
    come from an exact set join on that. Rows of one normalised text are a class: its other rows
    are linked to the smallest id, and classes are compared.
    """
    plain = F.trim(F.regexp_replace(F.lower(text_col), r"\s+", " "))
    rows = saved(df.select("id", plain.alias("text")).where("text <> ''"))
    classes = saved(rows.groupBy("text").agg(F.min("id").alias("id")))
    copies = rows.withColumnRenamed("id", "b").join(classes.withColumnRenamed("id", "a"), "text").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    bound = (least - (1 - words_share)) / words_share
    if bound <= 0:
        raise ValueError("the bound must be over the ratio's share")
    # Texts of the same words stand behind one set.
    sets = saved(classes.select("id", "text", F.array_sort(F.array_distinct(F.split("text", " "))).alias("w")))
    named = saved(sets.groupBy("w").agg(F.min("id").alias("of")))
    member = saved(sets.join(named, "w").select("id", "text", "w", "of"))
    met = relations.jaccard_pairs(named.select(F.col("of").alias("id"), F.concat_ws(" ", "w").alias("content")), bound, tokens=F.split("content", " "))
    met = met.select("a", "b").unionByName(named.select(F.col("of").alias("a"), F.col("of").alias("b")))
    side = lambda x: member.select(F.col("of").alias(x), F.col("id").alias(f"{x}_id"), F.col("text").alias(f"{x}_text"), F.col("w").alias(f"{x}_w"))
    both = met.join(side("a"), "a").join(side("b"), "b").where("a <> b or a_id < b_id")
    like = words_share * text.jaccard(F.col("a_w"), F.col("b_w")) + (1 - words_share) * block_ratios(F.col("a_text"), F.col("b_text"))
    found = both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), like.alias("similarity"))
    return found.where(F.col("similarity") >= least - 1e-12).unionByName(copies)


# Fixed value: what a permutation's number is hashed with.
SEED_NAME = "minhash_perm_{}"


def seeds(hashes: int) -> list[int]:
    """The permutations' seeds as signed longs: eight bytes, the lowest first, of a digest."""
    return [int.from_bytes(hashlib.sha256(SEED_NAME.format(i).encode()).digest()[:8], "little", signed=True) for i in range(hashes)]


def signature(body: Column, hashes: int = 128, n: int = 3) -> Column:
    """MinHash minima, as unsigned 64-bit numbers in longs, over character n-grams: digests XORed with each permutation's seed.

    Texts are lower-cased and trimmed, short ones padded with spaces; an empty text has zeros.
    """
    wanted = np.array(seeds(hashes), np.int64).view(np.uint64)

    def minima(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), hashes), np.uint64)
        for k in range(0, len(texts), 500):
            grams = [{t[i : i + n] for i in range(len(t) - n + 1)} or {t.ljust(n)} for t in texts.iloc[k : k + 500]]
            digest = {g: hashlib.sha256(g.encode()).digest()[:8] for g in set().union(*grams)}
            values = np.frombuffer(b"".join(digest[g] for own in grams for g in own), "<u8")
            size = np.array([len(own) for own in grams])
            begin = np.cumsum(size) - size
            for j, seed in enumerate(wanted):
                out[k : k + 500, j] = np.minimum.reduceat(values ^ seed, begin)
        out[(texts == "").to_numpy()] = 0
        return pd.Series(list(out.view(np.int64)))

    return F.pandas_udf(minima, "array<long>")(F.trim(F.lower(F.coalesce(body, F.lit("")))))


def signature_likeness(a: Column, b: Column) -> Column:
    """The share of equal minima, an estimate of Jaccard likeness."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def gram_likeness(a: Column, b: Column, n: int = 3) -> Column:
    """The Jaccard likeness of the n-grams of two texts, short ones padded with spaces."""

    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        @functools.lru_cache(10_000)
        def grams(t: str) -> frozenset[str]:
            return frozenset(t[i : i + n] for i in range(len(t) - n + 1)) or frozenset([t.ljust(n)])

        shared = [(len(s & t), len(s) + len(t)) for s, t in zip(map(grams, x), map(grams, y), strict=True)]
        return pd.Series([k / (total - k) for k, total in shared], dtype="float64")

    return F.pandas_udf(likeness, "double")(a, b)


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that isn't broadcast: signatures are far larger than Spark takes them to be, and would go through the driver."""
    return side.hint("merge")


def banded_pairs(df: DataFrame, least: float = 0.85, text_col: str = "name", hashes: int = 128, band: int = 8, most_bucket: int = 200) -> DataFrame:
    """(a, b, likeness): pairs of rows, a < b, that share a band of minima and whose n-grams overlap by `least` or more.

    Rows of equal signatures are a class: its other rows are linked to the smallest id; rows of one
    text have one signature, which is made once. A bucket
    of more than most_bucket classes is split by the band after it, so a hot band makes no square
    of pairs; pairs that only such buckets hold are missed with the chance that the bands tell.
    entities.duplicate_pairs is the exact way.
    """
    rows = df.select("id", F.trim(F.lower(F.coalesce(text_col, F.lit("")))).alias("text")).where("text <> ''")
    texts = saved(rows.groupBy("text").agg(F.min("id").alias("id")).withColumn("s", signature(F.col("text"), hashes)))
    classes = saved(texts.groupBy("s").agg(F.min(F.struct("id", "text")).alias("r")).select("s", "r.id", "r.text"))
    named = texts.select("text", "s").join(by_shuffle(classes.select(F.col("id").alias("a"), "s")), "s").select("text", "a")
    copies = rows.select(F.col("id").alias("b"), "text").join(by_shuffle(named), "text").where("a <> b").select("a", "b", F.lit(1.0).alias("likeness"))
    n = hashes // band
    part = lambda k: F.xxhash64(k, F.slice("s", k * band + 1, band))
    keyed = classes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(part(k).alias("key"), part((k + 1) % n).alias("next")))).alias("k")).select("id", "k.*")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = saved(keyed.join(by_shuffle(sizes), "key").withColumn("next", F.when(F.col("size") > most_bucket, F.col("next")).otherwise(F.lit(0).cast("long"))))
    x, y = sized.alias("x"), by_shuffle(sized).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.next") == F.col("y.next"))).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda c: by_shuffle(classes.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text")))
    both = met.join(side("a"), "a").join(side("b"), "b")
    like = both.select("a", "b", gram_likeness(F.col("a_text"), F.col("b_text")).alias("likeness"))
    return like.where(F.col("likeness") >= least).unionByName(copies)
