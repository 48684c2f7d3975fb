"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An occurrence of a passage of m characters with at most e edits shares at least
m + 1 - q - e * q of its q-grams with the text, all on diagonals (text offset less passage
offset) that lie within e of each other. Shared q-grams are counted in diagonal bands of
2 (e + 1) with a stride of e + 1, so some band holds a whole occurrence; bands that reach the
bound are verified by an alignment that stays within the band. q is 8, or 4 for passages too
short for their edit budget at 8. A q-gram that both sides repeat is counted once for each of
its places in the passage and band, so that repetitive texts take linear memory.

The benchmark is a stated query set: it is read in blocks of a bounded size, each sent to the
tasks, and all documents are scanned against one block after the other without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import materialize

Q, SHORT_Q = 8, 4
SLICE = 1 << 20
BITS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
HIT = "array<struct<item_id:long,start:int,end:int,distance:int>>"


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points, one for each of the text's, white space and controls as a space."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points <= 32, np.uint32(32), points)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A key for each q-gram: equal q-grams have equal keys (the low byte of each code point)."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = np.zeros(len(points) + 8, np.uint8)
    low[: len(points)] = points.astype(np.uint8)
    keys = np.ndarray((n,), "<u8", low, strides=(1,)).copy()
    return keys & np.uint64((1 << 8 * q) - 1) if q < 8 else keys


def budget(size, edit_rate: float):
    """The edits that a passage of so many characters may have."""
    return (edit_rate * np.asarray(size) + 1e-9).astype(np.int64)


class PassageIndex:
    """The q-grams of one block of passages: where each occurs, and each passage's bounds."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = 0.1, q: int = Q):
        self.q = q
        kept = [(i, p) for i, t in items if len(p := code_points((t or "").strip()))]
        self.ids = [i for i, _ in kept]
        self.passages = [p for _, p in kept]
        size = np.array([len(p) for p in self.passages], np.int64)
        self.edits = np.maximum(0, np.minimum(budget(size, edit_rate), (size - q) // q))
        self.least = size + 1 - q - self.edits * q
        self.short = [k for k, p in enumerate(self.passages) if len(p) < q]
        keys = [grams(p, q) for p in self.passages]
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        offset = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.item, self.offset = first, item[order], offset[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)

    def regions(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(passage, first diagonal of the band) of each band that reaches its passage's bound."""
        keys = grams(points, self.q)
        if not len(keys) or not len(self.keys):
            return []
        at = np.flatnonzero(self.seen[self._slot(keys)])
        where = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[where] == keys[at]
        at, where = at[same], where[same]
        if not len(at):
            return []
        parts = self._shared(at, where)
        codes, counts = np.unique(next(parts), return_counts=True)
        for more in parts:
            new, times = np.unique(more, return_counts=True)
            codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, times])).astype(np.int64)
        bands, back = np.unique(np.concatenate([codes, codes - 1]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([counts, counts]))
        found = bands[count >= self.least[bands >> 32]]
        item = found >> 32
        start = ((found & 0xFFFFFFFF) - (1 << 31)) * (self.edits[item] + 1)
        return list(zip(item.tolist(), start.tolist(), strict=True))

    def _shared(self, at: np.ndarray, where: np.ndarray) -> Iterator[np.ndarray]:
        """Codes (passage, band) of shared q-grams, in slices of bounded size.

        at: text offsets whose gram is the index's gram `where`. A gram with many places on
        both sides gives a code for each band that has a place in it, found by binary search.
        """
        times = self.count[where]
        heavy = np.zeros(0, bool)
        light = np.ones(len(at), bool)
        if int(times.sum()) > SLICE:
            heavy = np.bincount(where, minlength=len(self.keys)) * self.count > SLICE // 16
            light = ~heavy[where]
        some, its, n = at[light], where[light], times[light]
        ends = np.cumsum(n)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, side="right")))
            part, each = slice(low, high), n[low:high]
            step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            entry = np.repeat(self.first[its[part]], each) + step
            item = self.item[entry]
            yield item * (1 << 32) + (np.repeat(some[part], each) - self.offset[entry]) // (self.edits[item] + 1) + (1 << 31)
            low = high
        for gram in np.flatnonzero(heavy).tolist():
            spots = at[where == gram]
            entries = np.arange(self.first[gram], self.first[gram] + self.count[gram])
            for width in np.unique(self.edits[self.item[entries]] + 1).tolist():
                own = entries[self.edits[self.item[entries]] + 1 == width]
                n_bands = (int(spots[-1]) - int(spots[0])) // width + 3
                for k in range(0, len(own), max(1, SLICE // n_bands)):
                    part = own[k : k + max(1, SLICE // n_bands)]
                    item, offset = self.item[part], self.offset[part]
                    band = (spots[0] - offset)[:, None] // width + np.arange(n_bands)[None, :]
                    edge = np.searchsorted(spots, (band * width + offset[:, None]).ravel()).reshape(band.shape)
                    row, col = np.nonzero(np.diff(edge, axis=1))
                    yield item[row] * (1 << 32) + band[row, col] + (1 << 31)

    def hits(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, start, end, edits) of the best occurrence in each run of overlapping bands."""
        spans: list[dict[int, list[tuple[int, int, int]]]] = []
        waiting: list[tuple[int, int, int, np.ndarray, int]] = []
        for number, text in enumerate(texts):
            points = code_points(text)
            spans.append({})
            for k, diagonal in self.regions(points):
                size, e = len(self.passages[k]), int(self.edits[k])
                low, high = max(0, diagonal - e), min(len(points), diagonal + 2 * (e + 1) + size + e)
                waiting.append((number, k, low, points[low:high].copy(), low - (diagonal - e)))
            for k in self.short:
                for at in places(points, self.passages[k]):
                    spans[-1].setdefault(k, []).append((at, at + len(self.passages[k]), 0))
            if len(waiting) >= 1024:
                self._verify(waiting, spans)
                waiting = []
        self._verify(waiting, spans)
        return [self._best(found) for found in spans]

    def _verify(self, waiting: list[tuple[int, int, int, np.ndarray, int]], spans: list[dict]) -> None:
        unsure = []
        for number, k, low, region, skip in waiting:
            if at := places(region, self.passages[k])[:1]:
                spans[number].setdefault(k, []).append((low + at[0], low + at[0] + len(self.passages[k]), 0))
            elif self.edits[k]:
                unsure.append((number, k, low, region, skip))
        unsure.sort(key=lambda x: -len(self.passages[x[1]]))
        for i in range(0, len(unsure), 128):
            part = unsure[i : i + 128]
            found = align([self.passages[x[1]] for x in part], [x[3] for x in part], [x[4] for x in part], [int(self.edits[x[1]]) for x in part])
            for (number, k, low, _, _), best in zip(part, found, strict=True):
                if best:
                    spans[number].setdefault(k, []).append((low + best[0], low + best[1], best[2]))

    def _best(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int]]:
        result = []
        for k, spans in found.items():
            last: tuple[int, int, int] | None = None
            for span in sorted(set(spans)):
                if last and span[0] < last[1]:
                    last = min(last, span, key=lambda s: (s[2], s[0]))
                    continue
                if last:
                    result.append((self.ids[k], *last))
                last = span
            result.append((self.ids[k], *last))
        return sorted(result, key=lambda x: (x[1], x[0]))


def places(points: np.ndarray, passage: np.ndarray) -> list[int]:
    """Offsets at which the passage occurs without edits, overlapping ones included."""
    body, one, found = points.astype("<u4").tobytes(), passage.astype("<u4").tobytes(), []
    at = body.find(one)
    while at >= 0:
        if at % 4 == 0:
            found.append(at // 4)
        at = body.find(one, at + 1)
    return found


def align(passages: list[np.ndarray], regions: list[np.ndarray], skips: list[int], edits: list[int]) -> list[tuple[int, int, int] | None]:
    """(start, end, edits) of each passage's best match in its region within a band, or None.

    Cell k of row i stands for the passage's first i characters ending at region offset
    i + k - skip; a band has 4 e + 3 cells. Starts are free. All pairs advance together, a row
    at a time, and one whose band is over its edit budget is dropped. Longest passages come
    first. A cell holds edits * 2**32 + start.
    """
    unit, none = 1 << 32, 1 << 60
    sizes, budget = np.array([len(p) for p in passages]), np.array(edits)
    width, most = 4 * int(budget.max()) + 3, int(sizes.max())
    text = np.full((len(passages), most + width), -1, np.int64)
    words = np.full((len(passages), most), -2, np.int64)
    for c, (passage, region, skip) in enumerate(zip(passages, regions, skips, strict=True)):
        room = region[: text.shape[1] - skip]
        text[c, skip : skip + len(room)] = room
        words[c, : len(passage)] = passage
    cells, skip, inside = np.arange(width), np.array(skips)[:, None], np.array([len(r) for r in regions])[:, None]
    outside = (cells - skip < 0) | (cells - skip > inside) | (cells >= 4 * budget[:, None] + 3)
    row = np.where(outside, none, np.maximum(cells - skip, 0))
    gain = cells * unit
    alive = np.arange(len(passages))
    result: list[tuple[int, int, int] | None] = [None] * len(passages)
    for i in range(1, most + 1):
        dropped = np.full_like(row, none)
        dropped[:, :-1] = row[:, 1:] + unit
        row = np.minimum(row + np.where(text[:, i - 1 : i - 1 + width] == words[:, i - 1 : i], 0, unit), dropped)
        row = np.minimum.accumulate(row - gain, axis=1) + gain
        row[(cells + i - skip < 0) | (cells + i - skip > inside) | (cells >= 4 * budget[:, None] + 3)] = none
        if i % 8 and i != most and not (sizes == i).any():
            continue
        best = row.min(axis=1)
        for c in np.flatnonzero((sizes == i) & (best < (budget + 1) * unit)).tolist():
            k = int(np.argmin(row[c]))
            result[alive[c]] = (int(best[c] % unit), i + k - int(skip[c, 0]), int(best[c] // unit))
        stay = (sizes > i) & (best < (budget + 1) * unit)
        if not stay.any():
            break
        if not stay.all():
            row, text, words, sizes, budget, skip, inside, alive = (x[stay] for x in (row, text, words, sizes, budget, skip, inside, alive))
    return result


class Block:
    """One block of passages: those whose edit budget fits q-grams of 8, and the others."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = 0.1):
        sizes = np.array([len((t or "").strip()) for _, t in items], np.int64)
        fits = budget(sizes, edit_rate) <= np.maximum(0, (sizes - Q) // Q)
        self.parts = [PassageIndex([x for x, f in zip(items, fits.tolist(), strict=True) if f == long], edit_rate, q) for long, q in ((True, Q), (False, SHORT_Q))]

    def hits(self, texts: pd.Series) -> list[list[tuple[int, int, int, int]]]:
        both = [part.hits(texts) for part in self.parts if part.ids]
        return [sorted(sum(found, []), key=lambda h: (h[1], h[0])) for found in zip(*both, strict=True)] if both else [[] for _ in texts]


def passage_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000) -> list[DataFrame]:
    """The benchmark in blocks of about block_chars characters, by a hash of id and text."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    return [rows.where(F.pmod(F.xxhash64("i", "t", F.lit(5)), F.lit(n)) == k) for k in range(n)]


def scanned(spark, text: Column, passages: DataFrame, edit_rate: float = 0.1) -> Column:
    """A Column of hits array<struct<item_id, start, end, distance>> of one block's passages in each text."""
    index = spark.sparkContext.broadcast(Block([tuple(r) for r in passages.sort("i", "t").collect()], edit_rate))  # block_chars bounds it

    def scan(texts: pd.Series) -> pd.Series:
        names = ("item_id", "start", "end", "distance")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in found] for found in index.value.hits(texts)], dtype=object)

    return F.pandas_udf(scan, HIT)(text)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_rate: float = 0.1, **blocks) -> DataFrame:
    """One row for each benchmark passage found: (doc_id, item_id, start, end, distance).

    Offsets are code points of the text, end exclusive; distance counts edits after
    lower-casing and with each white-space character read as a space, up to edit_rate (0.1)
    of the passage's length. Null and empty texts and passages match nothing; repeated rows
    are each reported; an empty table of either kind gives no rows; other columns aren't read.
    A benchmark of several blocks is scanned block by block, and each block's hits are written
    to the shared folder.
    """
    found, parts = None, passage_blocks(benchmark, **blocks)
    for passages in parts:
        hits = scanned(docs.sparkSession, F.col(text_col), passages, edit_rate)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(hits).alias("h")).select("doc_id", "h.item_id", "h.start", "h.end", "h.distance")
        rows = rows if len(parts) == 1 else materialize(rows)
        found = rows if found is None else found.union(rows)
    none = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array().cast(HIT)).alias("h")).select("doc_id", "h.item_id", "h.start", "h.end", "h.distance")
    return none if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edit_rate: float = 0.1, **blocks) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage; same columns."""
    parts = passage_blocks(benchmark, **blocks)
    for passages in parts:
        docs = docs.where(F.size(scanned(docs.sparkSession, F.col(text_col), passages, edit_rate)) == 0)
        docs = docs if len(parts) == 1 else materialize(docs)
    return docs


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
