"""SimHash near-deduplication by tiled exact comparison.

Fingerprints are majority votes over the XXH64 values of word shingles. Distinct fingerprints
are dealt into tiles by the population counts of their low and high halves, in cells of two by
two counts; a fingerprint meets a tile only if the cell has counts that differ from its own by no
more than the radius, over both halves, since fingerprints that differ in r bits differ in these
counts by r at most. A tile pair
is one Spark group of bounded size, and within it numpy compares blocks by exclusive-or and bit
counts. A tile pair returns a spanning forest of its links instead of the links, so that large
groups of near copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import connected_components, materialize, unused

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)
TILE = 32768
#: Cells of population counts of the halves (0 to 32): WIDE counts each way, CELLS cells.
WIDE, CELLS = 2, 17


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for null and for a text without words.

    A-Z are lower-cased, words are runs other than ASCII white space, shingles are joined by
    one space; a text of fewer words is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = len(parts)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes: byte lanes are added in runs of 255 rows."""
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    result = 0
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte, count in enumerate(counts.tolist()):
            if 2 * count > n:
                result |= 1 << (8 * byte + bit)
    return result


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row (id, fingerprint as signed long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of a spanning forest of the links within a (b None) or between a and b.

    Rows are grouped by the population count of their low halves, and blocks are compared
    only where both halves' counts leave the radius reachable.
    """
    sides = [a] if b is None else [a, b]
    nodes = np.concatenate(sides)
    label = np.arange(len(nodes))
    blocks: list[dict[tuple[int, int], np.ndarray]] = []
    base = 0
    for side in sides:
        low = np.bitwise_count(side & np.uint64(0xFFFFFFFF)).astype(int)
        high = np.bitwise_count(side).astype(int) - low
        code = low * 64 + high
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        blocks.append({(int(low[part[0]]), int(high[part[0]])): part + base for part in np.split(order, cuts) if len(part)})
        base += len(side)
    first, second = blocks[0], blocks[-1]
    for (l1, h1), rows in first.items():
        for (l2, h2), cols in second.items():
            if abs(l1 - l2) + abs(h1 - h2) > radius or b is None and (l2, h2) < (l1, h1):
                continue
            for i in range(0, len(rows), 256):
                left = nodes[rows[i : i + 256]]
                for j in range(0, len(cols), 4096):
                    near = np.bitwise_count(left[:, None] ^ nodes[cols[j : j + 4096]][None, :]) <= radius
                    x, y = np.nonzero(near)
                    if len(x):
                        label = unite(label, rows[i + x], cols[j + y])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return nodes[linked], nodes[label[linked]]


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with i and j joined; labels point at roots before and after."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def tiles_of(counts: dict[int, int], tile: int) -> tuple[list[int], list[int]]:
    """(first tile, number of tiles) of each cell: one tile, or as many as keep it at about `tile` rows."""
    parts = [max(1, -(-counts.get(cell, 0) // tile)) for cell in range(CELLS * CELLS)]
    return [sum(parts[:cell]) for cell in range(CELLS * CELLS)], parts


def reach_of(low: int, high: int, first: list[int], parts: list[int], radius: int) -> list[tuple[int, int]]:
    """The ranges of tiles (first, last) that fingerprints of these counts have to meet: cells with counts within the radius."""
    ranges: list[tuple[int, int]] = []
    for row in range(CELLS):
        rest = radius - max(0, WIDE * row - low, low - WIDE * row - WIDE + 1)
        if rest < 0:
            continue
        start, end = row * CELLS + max(0, high - rest) // WIDE, row * CELLS + min(32, high + rest) // WIDE
        span = (first[start], first[end] + parts[end] - 1)
        if ranges and span[0] <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], span[1])
        else:
            ranges.append(span)
    return ranges


def links(values: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect whatever distinct fingerprints are linked by the radius.

    values: distinct fingerprints, in a column of that name. Each goes to the pairs of its own
    tile and each tile in its reach; a tile holds about `tile` rows however many there are.
    """
    low = F.bit_count(F.col("fingerprint").bitwiseAND(0xFFFFFFFF)).cast("int")
    high = F.bit_count("fingerprint").cast("int") - low
    cell = F.floor(low / WIDE).cast("int") * CELLS + F.floor(high / WIDE).cast("int")
    counts = dict(values.groupBy(cell.alias("c")).count().collect())  # 289 rows at most
    first, parts = tiles_of(counts, tile)
    table = []  # one row for each pair of counts
    for x in range(33):
        for y in range(33):
            own = x // WIDE * CELLS + y // WIDE
            table.append((x, y, first[own], parts[own], reach_of(x, y, first, parts, radius)))
    known = values.sparkSession.createDataFrame(table, "low int, high int, first int, parts int, reach array<struct<s:int,e:int>>")
    placed = values.select("fingerprint", low.alias("low"), high.alias("high")).join(F.broadcast(known), ["low", "high"])
    own = F.col("first") + F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    others = F.flatten(F.transform("reach", lambda r: F.sequence(r["s"], r["e"])))
    dealt = placed.select("fingerprint", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("fingerprint", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value, right = rows["fingerprint"].to_numpy().view(np.uint64), rows["right"].to_numpy()
        if key[0] == key[1]:
            a, b = forest(value, None, radius)
        elif right.all() or not right.any():
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        else:
            a, b = forest(value[~right], value[right], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # Work, not bytes, makes these tasks.
    tasks = min(4096, 32 + sum(p * p for p in parts) // 64)
    return dealt.repartition(tasks, "x", "y").groupBy("x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Each row's fingerprint (signed long) and component: (id, fingerprint, component_id).

    Two rows are linked when their fingerprints differ in `radius` bits or fewer;
    component_id is the smallest id reachable over links, the row's own included.
    A null text counts as empty (fingerprint 0, linked like any other); repeated rows are each
    returned; null ids get the component but never name it; an empty table gives no rows.
    Other columns of docs aren't read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("id").alias("least_id")))
    roots = connected_components(links(classes.select("fingerprint"), radius))
    placed = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; same columns.

    Rows that repeat the kept id all stay. Rows without an id stay only in components in which
    no row has one.
    """
    kept_id, print_of, alone_print = unused("_kept_id", docs), unused("_print", docs), unused("_alone", docs)
    found = near_duplicates(docs, id_col, text_col, words, radius)
    kept = found.where("id = component_id").select(F.col("id").alias(kept_id)).distinct()
    named = docs.join(kept, F.col(id_col).cast("long") == F.col(kept_id), "left_semi")

    @F.pandas_udf("long")
    def fingerprint_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    alone = found.where("id is null and component_id is null").select(F.col("fingerprint").alias(alone_print)).distinct()
    nameless = docs.where(F.col(id_col).isNull()).withColumn(print_of, fingerprint_of(F.col(text_col)))
    nameless = nameless.join(alone, F.col(print_of) == F.col(alone_print), "left_semi").drop(print_of)
    return named.unionByName(nameless)


def simhash_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
