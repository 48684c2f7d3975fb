"""Best matches of incoming memories, storing without duplicates, index maintenance and checks of a workspace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import graph, maintenance, search
from quillion.sources.shared import saved


def best_matches(index: DataFrame, incoming: DataFrame, block: int = 1024) -> DataFrame:
    """(id, match, score): for each incoming (id, embedding) the row of the index, other than itself, of largest cosine; ties go to the smaller id.

    Incoming rows are a set of queries: they are sent to the index in blocks, and a task keeps
    one best row for each. Rows without an embedding, or with one of zeros, match nothing.
    """
    queries = saved(incoming.select("id", "embedding").where("embedding is not null").withColumn("_n", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-incoming.count() // block))))))
    schema = "id string, match string, score double"
    found = None
    for (n,) in sorted(queries.select("_n").distinct().collect()):  # one number a block
        part = queries.where(F.col("_n") == n).toPandas()  # a block
        ids = part["id"].astype(str).to_numpy()
        q = unit(part["embedding"])
        shared = index.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            top, of = np.full(len(ids), -2.0), np.full(len(ids), None, object)
            for rows in batches:
                own = rows["id"].astype(str).to_numpy()
                order = np.argsort(own)
                own, v = own[order], unit(rows["embedding"].iloc[order])
                like = np.round(q @ v.T, 12) if len(own) else np.empty((len(ids), 0))
                like[ids[:, None] == own[None, :]] = -2.0
                if not like.shape[1]:
                    continue
                at = like.argmax(axis=1)
                value, name = like[np.arange(len(ids)), at], own[at]
                better = (value > top) | (value == top) & np.array([b is not None and a < b for a, b in zip(name, of, strict=True)])
                top, of = np.where(better, value, top), np.where(better, name, of)
            kept = top > 0
            yield pd.DataFrame({"id": ids[kept], "match": of[kept], "score": top[kept]})

        rows = index.select("id", "embedding").where("embedding is not null").mapInPandas(best, schema)
        rows = saved(rows.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("match").alias("m"))).alias("b")).select("id", F.col("b.m").alias("match"), (-F.col("b.s")).alias("score")))
        shared.unpersist()
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else index.sparkSession.createDataFrame([], schema)


def unit(vectors: pd.Series) -> np.ndarray:
    v = np.array([np.asarray(e, float) for e in vectors]).reshape(len(vectors), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def near_duplicates_of(index: DataFrame, incoming: DataFrame, least: float = 0.92) -> DataFrame:
    """best_matches of `least` or more."""
    return best_matches(index, incoming).where(F.col("score") >= least)


def store(current: DataFrame, index: DataFrame, incoming: DataFrame, now: int, least: float = 0.95) -> DataFrame:
    """current after incoming memories (with embedding): those that match a memory by `least` or more reinforce it, the others are inserted."""
    hits = saved(near_duplicates_of(index, incoming, least))
    stronger = maintenance.reinforce(current, hits.select(F.col("match").alias("id"), F.lit(1).alias("n")), now)
    return maintenance.insert(stronger, incoming.drop("embedding").join(hits.select("id"), "id", "left_anti"), now)


def upsert_index(index: DataFrame, terms: DataFrame, changed: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(search rows, term rows) after memories (id, content, embedding) changed or came and ids were removed."""
    gone = changed.select("id").union(removed.select("id")).distinct()
    rows = index.join(gone, "id", "left_anti").unionByName(changed.select("id", "embedding"))
    return rows, terms.join(gone, "id", "left_anti").unionByName(search.postings(changed))


def cross_links(memories: DataFrame, edges: DataFrame, recent: int = 50, least_chars: int = 20, head_chars: int | None = 100) -> DataFrame:
    """(source_node_id, target_node_id, relation): the `recent` newest memories, and those that hold their first head_chars characters (None: all of them), without an edge yet.

    The newest memories are a bounded set of queries, which every memory is compared with.
    """
    heads = memories.where(F.length("content") >= least_chars).orderBy(F.desc("created_at"), "id").limit(recent)
    heads = heads.select(F.col("id").alias("source_node_id"), F.lower(F.substring("content", 1, head_chars) if head_chars else F.col("content")).alias("head"))
    hits = memories.join(F.broadcast(heads), F.contains(F.lower("content"), F.col("head")) & (F.col("id") != F.col("source_node_id")))  # `recent` rows
    both = hits.select("source_node_id", F.col("id").alias("target_node_id"), F.lit("semantic_link").alias("relation"))
    one = both.groupBy(F.least("source_node_id", "target_node_id").alias("x"), F.greatest("source_node_id", "target_node_id").alias("y")).agg(F.min(F.struct(*both.columns)).alias("e"))
    known = edges.select(F.least("source_node_id", "target_node_id").alias("x"), F.greatest("source_node_id", "target_node_id").alias("y")).distinct()
    return one.join(known, ["x", "y"], "left_anti").select("e.*")


def counted_pairs(x_lists: pd.Series, y_lists: pd.Series, same: bool, least: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, shared): the x and y that are together in `least` rows of the two columns of lists or more; with same, each pair once.

    Pairs are expanded for some x at a time, about `most` at once.
    """
    sizes = y_lists.str.len().to_numpy(np.int64)
    starts = np.cumsum(sizes) - sizes
    x, xs = pd.factorize(np.concatenate(x_lists.to_list()))
    y, ys = (x, xs) if same else pd.factorize(np.concatenate(y_lists.to_list()))
    row = np.repeat(np.arange(len(sizes)), x_lists.str.len().to_numpy(np.int64))
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    ends = np.cumsum(sizes[row])
    y_of = y if not same else pd.Index(xs).get_indexer(np.concatenate(y_lists.to_list()))
    found, at = [], 0
    while at < len(x):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        to = int(np.searchsorted(x, x[to - 1], "right"))  # all of the last x
        n = sizes[row[at:to]]
        each = np.repeat(starts[row[at:to]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        code = np.repeat(x[at:to].astype(np.int64) * len(ys), n) + y_of[each]
        if same:
            code = code[code // len(ys) < code % len(ys)]
        code.sort()
        edge = np.flatnonzero(np.diff(code, prepend=-1))
        shared = np.diff(edge, append=len(code))
        kept = shared >= least
        found.append(np.stack([code[edge][kept], shared[kept]]))
        at = to
    code, shared = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return xs[code // max(1, len(ys))], ys[code % max(1, len(ys))], shared


def pairs_by_tiles(links: DataFrame, least: int, tile_links: int = 2_000_000) -> DataFrame:
    """(x, y, shared): pairs x < y of links (a, b) with `least` b in common or more.

    Nodes a are dealt to tiles; a pair of tiles gets its nodes' lists by b and counts their pairs, so what is
    sent is each list once for a tile, not each pair.
    """
    kind = links.schema["a"].dataType.simpleString()
    tiles = max(6, -(-links.count() // tile_links))
    lists = saved(links.groupBy("b", F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int").alias("tile")).agg(F.sort_array(F.collect_list("a")).alias("m")))
    x, y = lists.select("b", F.col("tile").alias("i"), F.col("m").alias("xs")), lists.select("b", F.col("tile").alias("j"), F.col("m").alias("ys"))
    met = x.join(y, "b").where("i <= j").select("i", "j", "xs", "ys")

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y, shared = counted_pairs(part["xs"], part["ys"], key[0] == key[1], least)
        return pd.DataFrame({"x": x, "y": y, "shared": shared})

    tasks = max(tiles * (tiles + 1) // 2, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    found = met.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(count, f"x {kind}, y {kind}, shared long")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "shared")


def suggested_links(edges: DataFrame, least: int = 2, hub: int = 5_000, among: Column | None = None) -> DataFrame:
    """(a, b, shared): nodes that share `least` neighbours or more and have no edge; with `among`, a condition on a, only nodes that meet it.

    Where no node has over `hub` edges, pairs are counted by their shared neighbours. Else only
    rare neighbours bring pairs together: a pair that shares `least` neighbours shares one of each
    node's n - least + 1 rarest ones, so hubs, being the most frequent, make hardly any pair, and
    what a candidate pair shares is then counted over all neighbours. Both ways give the same.
    """
    links = graph.oriented(edges).where("a <> b").select("a", "b").distinct()
    links = saved(links if among is None else links.where(among))
    counts = saved(links.groupBy("b").agg(F.count("*").alias("df")))
    if (counts.agg(F.max("df")).first()[0] or 0) <= hub:
        pairs = pairs_by_tiles(links.join(counts.where("df > 1").select("b"), "b", "left_semi"), least)
        return pairs.join(links.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select(F.col("x").alias("a"), F.col("y").alias("b"), "shared")
    place = F.row_number().over(Window.partitionBy("a").orderBy("df", "b"))  # one node's neighbours
    sizes = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = saved(links.join(counts, "b").join(sizes, "a").withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1).select("a", "b"))
    x, y = kept.select(F.col("a").alias("x"), "b"), kept.select(F.col("a").alias("y"), "b")
    met = x.join(y, "b").where("x < y").select("x", "y").distinct()
    met = met.join(links.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    sets = links.join(sizes.select("a"), "a").groupBy("a").agg(F.collect_set("b").alias("s"))
    side = lambda c: sets.select(F.col("a").alias(c), F.col("s").alias(f"{c}_s"))
    both = met.join(side("x"), "x").join(side("y"), "y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.size(F.array_intersect("x_s", "y_s")).cast("long").alias("shared"))
    return both.where(F.col("shared") >= least)


def lint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total nodes and orphans."""
    return nodes.agg(F.count("*").alias("total")).crossJoin(graph.orphans(nodes, edges).agg(F.count("*").alias("orphans")))  # one row each


def document_search(documents: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, chunk, score): each document's best chunk of words by BM25, the best documents first."""

    def rows(df: DataFrame) -> DataFrame:
        chunks = df.select("id", F.posexplode(text.word_chunks(F.col("content"))).alias("chunk", "c"))
        return chunks.select(F.struct("id", "chunk").alias("id"), F.col("c").alias("content"))

    # No token has white space, so a chunk that holds one is of a text that does.
    likely = documents.where(F.exists(text.strings(terms), lambda x: F.contains(F.lower("content"), x)))
    scored = search.bm25(rows(documents), terms, likely=rows(likely)).select("id.id", "id.chunk", "score")
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk")).alias("b")).select("id", "b.chunk", (-F.col("b.s")).alias("score"))
    return search.top(best, limit)


def directory_contents(directories: DataFrame, memories: DataFrame, path: str, depth: int = 10) -> DataFrame:
    """Memories (parent_directory_id) in the directory of a path or below it, with `directory_depth`."""
    root = directories.where(F.col("path") == path).agg(F.min("id")).first()[0]
    if root is None:
        raise KeyError(f"no directory {path!r}")
    below = graph.directory_tree(directories, root, depth).select(F.col("id").alias("parent_directory_id"), F.col("depth").alias("directory_depth"))
    return memories.join(below, "parent_directory_id")


def citations(found: DataFrame, entity_id: str, entity_type: str, memories: DataFrame) -> DataFrame:
    """Citations of an entity with the text of the memory that they come from."""
    of = found.where((F.col("entity_id") == entity_id) & (F.col("entity_type") == entity_type))
    return of.join(memories.select(F.col("id").alias("source_memory_id"), F.col("content").alias("source")), "source_memory_id", "left")


def stale(nodes: DataFrame) -> DataFrame:
    """Nodes marked stale by a change upstream."""
    return nodes.where("stale_since > 0")
