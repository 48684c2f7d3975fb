"""A persisted full-text index: positional postings in blocks, each with a bound of its scores.

An index is a folder of segments. A segment numbers its documents and cuts the numbers into ranges
of `span`; a block is the postings of one term in one range, or in a part of one with very many words: numbers, frequencies, lengths and
positions as arrays, and what bounds their scores. Blocks lie in folders by a hash of the term,
sorted by (term, range) across files, so that a query opens its terms' folders only and Parquet
skips the row groups of other terms. Search reads the bounds first, scores the most promising
ranges, and then only those ranges whose bound reaches the score of the k-th hit so far: the
hits are those of a full scan.

New documents make a new segment; deleted ones are listed and left out when hits are scored.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.operators.search import top
from quillion.sources.shared import saved

K1, B = 1.2, 0.75
DOCS = "doc long, id string, length long"
BLOCKS = "bucket int, term string, range long, n long, most_tf long, least_length long, docs array<long>, tfs array<long>, lengths array<long>, places array<array<int>>"
#: What tasks write: blocks, and in rows without a term the ids and lengths of a range's documents.
STAGED = "term string, range long, n long, most_tf long, least_length long, docs array<int>, tfs array<int>, lengths array<int>, places array<array<int>>, ids array<string>"

_INTS = pa.list_(pa.int32())
_STAGED_TYPES = pa.schema([
    pa.field("term", pa.string()), pa.field("range", pa.int64()), pa.field("n", pa.int64()), pa.field("most_tf", pa.int64()), pa.field("least_length", pa.int64()),
    pa.field("docs", _INTS), pa.field("tfs", _INTS), pa.field("lengths", _INTS), pa.field("places", pa.list_(_INTS)), pa.field("ids", pa.list_(pa.string())),
])


class TextIndex:
    """An index in a folder that driver and executors share."""

    part = 2_000_000  # words from which a range's blocks are given in parts

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # Building

    @classmethod
    def build(cls, df: DataFrame, path: str, text_col: str = "content", stop: list[str] = text.STOP_WORDS, buckets: int = 16, span: int = 4096, files: int | None = None) -> TextIndex:
        """Index (id, text) rows. files: over how many files blocks are dealt (default: the shuffle partitions)."""
        index = cls(df.sparkSession, path)
        options = {"text_col": text_col, "stop": list(stop), "buckets": buckets, "span": span}
        index.begin(options)
        index.add(df, files)
        return index

    def begin(self, options: dict) -> None:
        self.spark.createDataFrame([(json.dumps(options),)], "options string").coalesce(1).write.text(f"{self.path}/options")
        self.spark.createDataFrame([], "id string").write.parquet(f"{self.path}/deleted")

    @cached_property
    def options(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/options").first()[0])

    def add(self, df: DataFrame, files: int | None = None) -> None:
        """A new segment of (id, text) rows; numbers follow the rows' order in their partitions.

        A range's documents lie in one partition, so that each task makes its blocks by itself from
        its texts, which are split once; only blocks are shuffled. Numbers are written with the blocks
        and read from there, so that a lost task can't number documents anew.
        """
        o, name = self.options, uuid.uuid4().hex
        parts = F.split(F.lower(F.coalesce(F.col(o["text_col"]), F.lit(""))), r"[^\p{L}\p{N}]+")
        numbered = df.select(F.monotonically_increasing_id().alias("doc"), F.col("id").cast("string").alias("id"), parts.alias("parts"))
        stop, span, most = o["stop"], o["span"], self.part
        staged = f"{self.path}/staged/{name}"
        numbered.mapInArrow(lambda batches: staged_blocks(batches, stop, span, most), STAGED).write.option("compression", "zstd").parquet(staged)
        rows = self.spark.read.schema(STAGED).parquet(staged)
        docs = rows.where("term is null").select("range", F.explode(F.arrays_zip("docs", "ids", "lengths")).alias("d"))
        docs.select((F.col("range") * span + F.col("d.docs")).alias("doc"), F.col("d.ids").alias("id"), F.col("d.lengths").cast("long").alias("length")).sortWithinPartitions("doc").write.parquet(f"{self.path}/docs/segment={name}")
        self.sum_lengths(name)
        blocks = rows.where("term is not null").drop("ids").select(F.pmod(F.xxhash64("term"), F.lit(o["buckets"])).cast("int").alias("bucket"), "*")
        order = ["bucket", "term", "range"]
        dealt = blocks.repartitionByRange(files, *order) if files else blocks.repartitionByRange(*order)
        longs = {c: F.col(c).cast("array<long>") for c in ("docs", "tfs", "lengths")}
        dealt.sortWithinPartitions(*order).withColumns(longs).write.option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{self.path}/blocks/segment={name}")

    def sum_lengths(self, name: str) -> None:
        docs = self.spark.read.schema(DOCS).parquet(f"{self.path}/docs/segment={name}").where("length > 0")
        docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).coalesce(1).write.parquet(f"{self.path}/sums/segment={name}")

    def delete(self, ids: DataFrame) -> None:
        """Documents of these ids are no longer hits; frequencies and lengths keep them until merged() drops them."""
        ids.select(F.col("id").cast("string").alias("id")).distinct().write.mode("append").parquet(f"{self.path}/deleted")

    # Reading

    def docs(self) -> DataFrame:
        """(segment, doc, id, length) of the documents that aren't deleted."""
        rows = self.spark.read.schema(f"{DOCS}, segment string").parquet(f"{self.path}/docs")
        return rows.join(self.spark.read.schema("id string").parquet(f"{self.path}/deleted"), "id", "left_anti")

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """Blocks of the terms, with their segment: only the terms' folders are listed and read."""
        rows = self.spark.read.schema(f"{BLOCKS}, segment string").parquet(f"{self.path}/blocks")
        if terms is None:
            return rows
        of = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.options["buckets"])).cast("int") for t in terms]  # constants, so folders are pruned
        return rows.where(F.col("bucket").isin(*of) & F.col("term").isin(terms))

    def terms(self) -> DataFrame:
        """(term, n, df): occurrences and documents of each term."""
        total = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        return self.blocks().groupBy("term").agg(F.sum(total).alias("n"), F.sum("n").alias("df"))

    def statistics(self) -> tuple[int, float]:
        """Documents with tokens, and their mean length."""
        r = self.spark.read.schema("n long, words long").parquet(f"{self.path}/sums").agg(F.sum("n"), F.sum("words")).first()
        return r[0] or 0, (r[1] or 0) / r[0] if r[0] else 1.0

    # Searching

    def bounds(self, terms: list[str]) -> DataFrame:
        """(segment, range, term, n, most_tf, least_length): what bounds a block's scores, without its postings."""
        return self.blocks(terms).select("segment", "range", "term", "n", "most_tf", "least_length")

    def scored(self, terms: list[str], idf: dict[str, float], mean: float, ranges: DataFrame | None = None) -> DataFrame:
        """(segment, doc, score) of the documents that hold a term, of the given (segment, range) only."""
        blocks = self.blocks(terms)
        if ranges is not None:
            blocks = blocks.join(ranges, ["segment", "range"], "left_semi")
        span = self.options["span"]
        each = blocks.select("segment", "term", F.col("range").alias("of"), F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p"))
        part = weight(F.col("term"), idf) * scoring.bm25_tf(F.col("p.tfs").cast("double"), F.col("p.lengths"), F.lit(mean), K1, B)
        return each.groupBy("segment", (F.col("of") * span + F.col("p.docs")).alias("doc")).agg(F.sum(part).alias("score"))

    def search(self, terms: list[str], k: int, first: int = 64) -> DataFrame:
        """(id, score) of the k best documents by BM25, ties by id: equal to scoring every posting.

        `first` ranges of the largest bounds are scored at once; what they leave is pruned.
        """
        terms = list(dict.fromkeys(terms))
        frequency = {r["term"]: r["df"] for r in self.bounds(terms).groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a query term
        if not frequency:
            return self.spark.createDataFrame([], "id string, score double")
        n, mean = self.statistics()
        idf = {t: max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1)) for t, df in frequency.items()}
        best = weight(F.col("term"), idf) * scoring.bm25_tf(F.col("most_tf").cast("double"), F.col("least_length"), F.lit(mean), K1, B)
        bounds = self.bounds(terms).groupBy("segment", "range").agg((F.sum(best) * (1 + 1e-9)).alias("bound"))
        place = "segment string, range long"
        promising = [(r["segment"], r["range"]) for r in bounds.orderBy(F.desc("bound"), "segment", "range").limit(first).collect()]
        tried = F.broadcast(self.spark.createDataFrame(promising, place))  # `first` rows
        hits = top(self.named(self.scored(terms, idf, mean, tried)), k)
        if len(promising) < first:
            return hits
        found = hits.collect()  # k rows
        hits, rest = self.spark.createDataFrame(found, hits.schema), bounds.join(tried, ["segment", "range"], "left_anti")
        if len(found) == k:
            rest = rest.where(F.col("bound") >= found[-1]["score"])
        if not rest.take(1):
            return hits
        return top(hits.unionByName(self.named(self.scored(terms, idf, mean, rest.select("segment", "range")))), k)

    def named(self, scored: DataFrame) -> DataFrame:
        """(id, score) of (segment, doc, score); deleted documents fall out."""
        return scored.join(self.docs().select("segment", "doc", "id"), ["segment", "doc"]).select("id", "score")

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, n): documents that hold the words one after the other, and how often. Words must be index terms."""
        if not words:
            return self.spark.createDataFrame([], "id string, n long")
        span = self.options["span"]
        wanted = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).alias("at")) for i, w in enumerate(words)]))
        at = F.broadcast(self.spark.range(1).select(wanted.alias("w")).select("w.*"))
        each = self.blocks(sorted(set(words))).select("segment", "range", "term", F.explode(F.arrays_zip("docs", "places")).alias("p"))
        last = lambda s: F.coalesce(F.get(s, F.size(s) - 1), F.lit(0))
        whole = F.aggregate("p.places", F.array().cast("array<int>"), lambda s, gap: F.concat(s, F.array(gap + last(s))))
        starts = each.join(at, "term").select("segment", (F.col("range") * span + F.col("p.docs")).alias("doc"), "at", F.explode(whole).alias("place"))
        runs = starts.groupBy("segment", "doc", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("matched")).where(F.col("matched") == len(words))
        found = runs.groupBy("segment", "doc").agg(F.count("*").alias("score"))
        return self.named(found).withColumnRenamed("score", "n")

    def merged(self, path: str, files: int | None = None) -> TextIndex:
        """The index without deleted documents and with all segments as one, in another folder."""
        o, name = self.options, uuid.uuid4().hex
        new = TextIndex(self.spark, path)
        new.begin(o)
        # Segments follow each other in the order of their names, each from the next multiple of the span.
        sizes = self.spark.read.schema(f"{DOCS}, segment string").parquet(f"{self.path}/docs").groupBy("segment").agg((F.floor(F.max("doc") / o["span"]) + 1).alias("ranges"))
        before = F.coalesce(F.sum("ranges").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a segment
        starts = F.broadcast(saved(sizes.select("segment", before.alias("shift"))))
        docs = self.docs().join(starts, "segment").select((F.col("doc") + F.col("shift") * o["span"]).alias("doc"), "id", "length")
        docs.write.parquet(f"{path}/docs/segment={name}")
        new.sum_lengths(name)
        live = self.docs().select("segment", "doc")
        each = self.blocks().select("segment", "bucket", "term", "range", F.explode(F.arrays_zip("docs", "tfs", "lengths", "places")).alias("p")).withColumn("doc", F.col("range") * o["span"] + F.col("p.docs"))
        kept = each.join(live, ["segment", "doc"], "left_semi").join(starts, "segment")
        posting = F.struct(F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"), F.col("p.places").alias("places"))
        blocks = kept.groupBy("bucket", "term", (F.col("range") + F.col("shift")).alias("range")).agg(F.array_sort(F.collect_list(posting)).alias("p"))
        field = lambda x: F.transform("p", lambda p: p[x])
        blocks = blocks.select("bucket", "term", "range", F.size("p").cast("long").alias("n"), F.array_max(field("tf")).alias("most_tf"), F.array_min(field("length")).alias("least_length"), field("doc").alias("docs"), field("tf").alias("tfs"), field("length").alias("lengths"), field("places").alias("places"))
        order = ["bucket", "term", "range"]
        dealt = blocks.repartitionByRange(files, *order) if files else blocks.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{path}/blocks/segment={name}")
        return new


def staged_blocks(batches: Iterator[pa.RecordBatch], stop: list[str], span: int, most: int) -> Iterator[pa.RecordBatch]:
    """STAGED rows of (doc, id, parts) in order of doc; a range of over `most` words is given in several parts."""
    held, words, of = [], 0, None  # slices of one range
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        ends = np.concatenate([[0], np.cumsum(batch.column("parts").value_lengths().to_numpy())])
        lo = 0
        while lo < len(docs):
            own = docs[lo] // span
            if held and (own != of or words >= most):
                yield from range_blocks(held, of, stop, span)
                held, words = [], 0
            of = own
            hi = min(int(np.searchsorted(docs, (own + 1) * span, "left")), max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1))
            held.append(batch.slice(lo, hi - lo))
            words += int(ends[hi] - ends[lo])
            lo = hi
    if held:
        yield from range_blocks(held, of, stop, span)


def range_blocks(held: list[pa.RecordBatch], number: int, stop: list[str], span: int) -> Iterator[pa.RecordBatch]:
    """STAGED rows of documents of one range."""
    docs = np.concatenate([b.column("doc").to_numpy() for b in held]) - number * span
    sizes = np.concatenate([b.column("parts").value_lengths().to_numpy() for b in held])
    terms = pa.chunked_array([b.column("parts").flatten() for b in held], pa.string()).combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.unify_dictionaries().combine_chunks()
    known, code = terms.dictionary, terms.indices.to_numpy()
    counts = pc.and_(pc.greater_equal(pc.binary_length(known), 2), pc.invert(pc.is_in(known, pa.array(stop, pa.string())))).to_numpy(zero_copy_only=False).astype(bool)
    kept = np.flatnonzero(counts[code])
    at = np.repeat(np.arange(len(docs)), sizes)  # each word's document, and its place there
    place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
    at, code = at[kept], code[kept]
    lengths = np.bincount(at, minlength=len(docs)).astype(np.int32)
    ids = pa.chunked_array([b.column("id") for b in held], pa.string()).to_pylist()
    yield pa.RecordBatch.from_pylist([{"range": int(number), "docs": docs, "lengths": lengths, "ids": ids}], _STAGED_TYPES)
    if not len(code):
        return
    order = np.argsort(code, kind="stable")  # by term, document and place
    code, at, place = code[order], at[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(at) != 0)]))  # of each posting
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    tf, doc = np.diff(np.append(first, len(code))), at[first]
    block = np.flatnonzero(np.diff(code[first], prepend=-1))
    offsets = pa.array(np.append(block, len(first)).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    postings = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(gaps.astype(np.int32)))
    n = len(block)
    columns = [
        known.take(pa.array(code[first][block])), pa.array(np.full(n, number, np.int64)), pa.array(np.diff(np.append(block, len(first))).astype(np.int64)),
        pa.array(np.maximum.reduceat(tf, block).astype(np.int64)), pa.array(np.minimum.reduceat(lengths[doc], block)), listed(pa.array(docs[doc].astype(np.int32))), listed(pa.array(tf.astype(np.int32))), listed(pa.array(lengths[doc])), listed(postings),
        pa.nulls(n, pa.list_(pa.string())),
    ]
    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _STAGED_TYPES.types, strict=True)], schema=_STAGED_TYPES)


def weight(term: Column, idf: dict[str, float]) -> Column:
    """A query term's idf: a chain as long as the query."""
    chain = F.lit(0.0)
    for t, value in idf.items():
        chain = F.when(term == t, value).otherwise(chain)
    return chain
