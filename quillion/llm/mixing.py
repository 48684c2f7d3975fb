"""Mixing sources to target weights, with DataFrame functions only.

Each source is a stream of its documents in a permuted order, epoch after epoch, cut into
blocks of equal words; a source's quota is the number of blocks that its target needs. A
splitting tree deals the quotas to the output shards: at every node the blocks are split among a
few children by drawing without replacement, so that their counts by source follow the
multivariate hypergeometric distribution and add up exactly. A count is one draw of the hypergeometric
distribution given the sources before it, whatever its size. A leaf's counts give a shard
disjoint ranges of each source's permuted blocks; rows of a shard are then ordered by a hash.

The tree works on counts alone, and its nodes are dealt anew to tasks every other level. Blocks and
shards are of one size whatever the input. Documents are only touched by a projection, a prefix
sum within narrow hash buckets, and a join with the table of blocks by source and block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.llm.common import bind, materialize, unused
from quillion.llm.hypergeometric import hypergeometric

WORD = r"[^\x20\x09-\x0D]+"
#: A prime over any number of blocks, so that multiplying by it permutes them.
PRIME = 4_294_967_291
#: Rows of a few numbers that are broadcast at most; they are counted first.
NARROW_ROWS = 200_000


def narrow(df: DataFrame) -> DataFrame:
    """df, which should be materialized, marked for broadcast if it has NARROW_ROWS at most."""
    return F.broadcast(df) if df.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS else df


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """One row for each source: (source, source_size, target).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the total; a
    target stops at most_epochs times its source's size and the excess goes to the others by
    weight. That is min(cap, level * weight) for one level, which is found by a running sum
    over sources in the order in which they reach their caps. There is one row a source here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / after)
    # The level that counts is that of the first source that it leaves at or below its cap.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_cap).alias("n"), "level"))
    rows = rows.withColumn("fits", fits).withColumn("level", F.min("fits").over(everything)["level"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def permuted(sizes: DataFrame, seed: int, bucket_rows: int) -> DataFrame:
    """sizes with `start`: the words before the row in its source's permuted order.

    The order is by bucket and then by hash. Sums by bucket come first, so that no window holds
    more than a bucket, of bucket_rows rows or so, or one source's buckets.
    """
    n = sizes.count()
    buckets = max(1, math.ceil(n / bucket_rows))
    rows = sizes.withColumn("place", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("place", F.lit(seed + 1)), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return joined.withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "_source", "_bucket")


def filled(rows: DataFrame, most_epochs: int) -> DataFrame:
    """rows (source, size, target, place, bucket, epochs, ...) with copies added until no document with an epoch left fits its source's gap.

    epochs: an array of (epoch, at), `at` being the middle of the copy in the source's words. In
    a round, the documents that fit take what is left in order: those with the fewest epochs
    first, then those of half the gap or less, then the permuted order; the first always fits.
    Where a document of half the gap or less crosses the target, the gap is halved; otherwise all of
    those are taken, and a larger one that fits halves it. So rounds grow with the logarithm of
    the gap. Windows hold a bucket, or a source's buckets.
    """
    same = lambda other: F.col("source").eqNullSafe(F.col(other))
    words = rows.groupBy(F.col("source").alias("_source")).agg((F.max("target") - F.sum(F.col("size") * F.size("epochs"))).alias("gap"))
    rows = rows.join(narrow(materialize(words)), same("_source")).drop("_source")
    fits = (F.col("size") > 0) & (F.size("epochs") < most_epochs) & (F.col("size") <= F.col("gap"))
    columns, done, open_rows = rows.columns, [rows.where(~fits)], rows.where(fits)
    while not open_rows.isEmpty():
        open_rows = open_rows.withColumn("used", F.size("epochs")).withColumn("large", F.col("size") * 2 > F.col("gap"))
        keys = ["source", "used", "large", "bucket"]
        sums = open_rows.groupBy(*keys).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source").orderBy("used", "large", "bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        based = open_rows.join(narrow(materialize(sums)), same("_source") & (F.col("used") == F.col("_used")) & (F.col("large") == F.col("_large")) & (F.col("bucket") == F.col("_bucket")))
        reached = F.col("base") < F.col("gap")
        within = Window.partitionBy(*keys).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        near = based.where(reached).withColumn("first", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        near = near.withColumn("added", F.when(F.col("first") + F.col("size") <= F.col("gap"), F.col("size")).otherwise(F.lit(0)))
        copy = F.struct(F.col("used").alias("epoch"), (F.col("target") - F.col("gap") + F.col("first") + F.col("size") / 2).alias("at"))
        near = near.withColumn("epochs", F.when(F.col("added") > 0, F.concat("epochs", F.array(copy))).otherwise(F.col("epochs")))
        far = based.where(~reached).withColumn("added", F.lit(0).cast("long"))
        moved = materialize(near.select(*columns, "added").unionByName(far.select(*columns, "added")))
        gained = materialize(moved.groupBy(F.col("source").alias("_source")).agg(F.sum("added").alias("gained")))
        moved = moved.join(narrow(gained), same("_source")).withColumn("gap", F.col("gap") - F.col("gained")).select(*columns)
        done.append(moved.where(~fits))
        open_rows = moved.where(fits)
    return functools.reduce(DataFrame.unionByName, done)


def drawn(counts: Column, want: Column, *keys) -> Column:
    """How many of each of `counts` are among `want` blocks drawn without replacement: each given those before it."""
    rest = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(rest.alias("rest"), want.cast("long").alias("want"), F.array().cast("array<long>").alias("taken"))

    def source(acc: Column, count: Column) -> Column:
        hit = hypergeometric(count, acc["rest"], acc["want"], *keys, F.size(acc["taken"]))
        return bind(hit, lambda x: F.struct((acc["rest"] - count).alias("rest"), (acc["want"] - x).alias("want"), F.concat(acc["taken"], F.array(x)).alias("taken")))

    return F.aggregate(counts, start, source, lambda acc: acc["taken"])


def child(seed: int, level: int, width: int, edge: Callable[[Column], Column]):
    """A fold over the first shards of a node's children that takes each child's blocks from those left."""

    def take(acc: Column, low: Column) -> Column:
        high = F.least(low + width, F.col("high"))
        taken = drawn(acc["rest"], edge(high) - edge(low), F.lit(seed), F.lit(level), low)
        part = lambda t: F.array(F.struct(low.alias("low"), high.alias("high"), t.alias("counts")))
        return bind(taken, lambda t: F.struct(F.zip_with(acc["rest"], t, lambda c, x: c - x).alias("rest"), F.concat(acc["parts"], part(t)).alias("parts")))

    return take


def split_quotas(quotas: DataFrame, shards: int, seed: int, fan: int = 16) -> DataFrame:
    """(source, shard, first, last): each shard's blocks of each source, as places in its permuted blocks.

    quotas: (source, blocks). A node is a row with its range of shards and an array of counts,
    one for each source. A level of the tree splits every node among `fan` children or fewer,
    one child's blocks drawn after the other from those left, each child getting its share of
    the blocks by its share of the shards. After two levels nodes go to other tasks.
    """
    one = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "blocks"))).alias("q"))  # bounded by the sources
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    nodes = one.select(F.transform("q", lambda x: x["source"]).alias("sources"), F.transform("q", lambda x: x["blocks"]).alias("counts"), F.lit(0).alias("low"), F.lit(shards).alias("high")).withColumn("all", total)
    edge = lambda x: F.floor(x.cast("decimal(20,0)") * F.col("all") / F.lit(shards)).cast("long")
    levels = 0
    while fan**levels < shards:
        levels += 1
    for level in range(levels):
        if level and level % 2 == 0:
            nodes = nodes.repartition(min(fan**level, 4096), "low")
        width = fan ** (levels - 1 - level)

        start = F.struct(F.col("counts").alias("rest"), F.array().cast("array<struct<low:int,high:int,counts:array<bigint>>>").alias("parts"))
        parts = F.aggregate(F.sequence(F.col("low"), F.col("high") - 1, F.lit(width)), start, child(seed, level, width, edge), lambda acc: acc["parts"])
        nodes = nodes.select("sources", "all", F.explode(parts).alias("n")).select("sources", "all", "n.*")
    leaves = nodes.select(F.col("low").alias("shard"), F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("shard", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    last = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return leaves.where("n > 0").select("source", "shard", (last - F.col("n")).alias("first"), last.alias("last"))


def dealt_blocks(quotas: DataFrame, ranges: DataFrame, seed: int) -> DataFrame:
    """(source, block, shard): the blocks at the places of each range, by a permutation of the source's blocks."""
    places = ranges.select(F.col("source").alias("_of"), "shard", F.explode(F.sequence("first", F.col("last") - 1)).alias("place"))
    block = F.pmod(F.col("place") * F.lit(PRIME) + F.shiftrightunsigned(F.xxhash64("source", F.lit(seed)), 33), F.col("blocks"))
    return places.join(quotas, F.col("source").eqNullSafe(F.col("_of"))).select("source", block.alias("block"), "shard")


def with_shards(rows: DataFrame, blocks: DataFrame, n_blocks: int, narrow: int) -> DataFrame:
    """rows (source, epochs, ...) with `shards`, the shard of each entry of epochs (its `block`).

    Up to `narrow` blocks are sent to all tasks; beyond, entries and blocks meet by source and block.
    """
    if n_blocks <= narrow:
        of = F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"])  # a source's blocks are numbered from 0 without gaps
        table = blocks.groupBy(F.col("source").alias("_source")).agg(of.alias("_shards"))  # n_blocks in all
        joined = rows.join(F.broadcast(materialize(table)), F.col("source").eqNullSafe(F.col("_source")), "left")
        found = F.transform("epochs", lambda e: F.coalesce(F.get("_shards", e["block"].cast("int")), F.lit(0)))
        return joined.withColumn("shards", found).drop("_source", "_shards")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    entries = rows.select("_row", F.col("source").alias("_source"), F.posexplode("epochs").alias("_at", "_e")).withColumn("_block", F.col("_e.block"))
    met = entries.join(blocks, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_block") == F.col("block")), "left")
    lists = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("shard", F.lit(0)).alias("shard")))).alias("_l"))
    shards = F.coalesce(F.transform("_l", lambda x: x["shard"]), F.array().cast("array<int>"))
    return rows.join(lists, "_row", "left").withColumn("shards", shards).drop("_row", "_l")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    shard_words: int = 1 << 20,
    block_words: int = 1 << 14,
    narrow_blocks: int = 1 << 16,
    bucket_rows: int = 20_000,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): what the mix takes of each document.

    size: the text's words, runs other than ASCII white space (null: 0). copies: an array of
    (epoch, shard, place), one for each time that the document is taken, empty if never; rows of
    a shard in the order of place are the shuffled shard. A source's words stop short of its
    target by less than its smallest document with an epoch left (and words) would add; no
    document is taken more than most_epochs times.

    A null source is one source, the last; null and empty texts have size 0 and are taken as
    often as their source's whole epochs, which adds no words; repeated rows are documents of
    their own that share a place; reruns over the same rows agree; an empty table gives none.
    """
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size")))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = block_words
    shards = max(1, math.ceil(total / max(shard_words, block)))
    targets = materialize(source_targets(sizes, weights, most_epochs))
    quotas = materialize(targets.select("source", F.ceil(F.col("target") / block).cast("long").alias("blocks")).where("blocks > 0"))
    n_blocks = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    blocks = dealt_blocks(quotas, split_quotas(quotas, shards, seed), seed)
    goal = targets.withColumnRenamed("source", "_source")

    rows = permuted(sizes, seed, bucket_rows).join(narrow(goal), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = lambda e: e * F.col("source_size") + F.col("start") + F.col("size") <= F.col("target")
    taken = lambda e: F.when(F.col("size") > 0, whole(e)).otherwise((e + 1) * F.col("source_size") <= F.col("target"))
    middle = lambda e: e * F.col("source_size") + F.col("start") + F.col("size") / 2
    epochs = F.filter(F.sequence(F.lit(0), F.lit(most_epochs - 1)), taken)
    rows = materialize(rows.withColumn("epochs", F.transform(epochs, lambda e: F.struct(e.alias("epoch"), middle(e).cast("double").alias("at")))))
    # A document that crosses the target leaves a gap before it, whatever its length; smaller ones fill it.
    last_block = F.greatest(F.ceil(F.col("target") / block).cast("long") - 1, F.lit(0).cast("long"))
    entry = lambda e: F.struct(e["epoch"].alias("epoch"), F.least(F.floor(e["at"] / block), last_block).cast("long").alias("block"))
    rows = filled(rows, most_epochs).withColumn("epochs", F.transform("epochs", entry))
    rows = with_shards(rows, blocks, n_blocks, narrow_blocks)
    copies = F.zip_with("epochs", "shards", lambda e, s: F.struct(e["epoch"].alias("epoch"), s.alias("shard"), F.xxhash64("doc_id", e["epoch"], F.lit(seed + 2)).alias("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def shards(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: docs with a row for each copy, and its shard, sorted by place within it."""
    rows = docs.drop("shard")
    mixed_id, place = unused("_id", rows), unused("_place", rows)
    placed = mixed.select(F.col("doc_id").alias(mixed_id), F.explode("copies").alias("c"))
    rows = rows.join(placed.select(mixed_id, F.col("c.shard").alias("shard"), F.col("c.place").alias(place)), F.col(id_col).eqNullSafe(F.col(mixed_id)))
    return rows.repartition("shard").sortWithinPartitions("shard", place).drop(mixed_id, place)


def dealt(copies: str = "copies") -> list[Column]:
    """taken, and each copy's shard and its place in the shard's shuffled order."""
    return [
        (F.col("size") * F.size(copies)).alias("taken"),
        F.transform(copies, lambda c: c["shard"]).alias("shards"),
        F.transform(copies, lambda c: c["place"]).alias("places"),
    ]


def mix_query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", *dealt())


def mixed_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken, shards and places (an entry for each copy); untaken ones too.

    Sorted by place, a shard's copies are in its shuffled order. Rows that repeat an id and a
    source all get the copies of the largest of them, and of equal sizes the greatest copies.
    """
    names = ("size", "source_size", "target", "taken", "shards", "places")
    rows = docs.drop(*[c for c in names if c not in (id_col, source_col)])
    mixed_id, mixed_source = unused("_id", rows), unused("_source", rows)
    one = mixed.groupBy(F.col("doc_id").alias(mixed_id), F.col("source").alias(mixed_source)).agg(F.max(F.struct("size", "source_size", "target", "copies")).alias("m"))
    added = one.select(mixed_id, mixed_source, "m.*").select(mixed_id, mixed_source, "size", "source_size", "target", *dealt())
    return rows.join(added, F.col(id_col).eqNullSafe(F.col(mixed_id)) & F.col(source_col).eqNullSafe(F.col(mixed_source))).drop(mixed_id, mixed_source)
