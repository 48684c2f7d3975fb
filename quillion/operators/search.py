"""Retrieval legs, fusion and re-ranking. Rankings end in (score desc, id asc)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import scoring, text, vector
from quillion.operators.filters import readable

# Weights of the strategies in weighted fusion.
FUSION_WEIGHTS = {"semantic": 0.55, "keyword": 0.30, "binary": 0.05, "graph": 0.05, "temporal": 0.05}
RRF_K = 60


def top(df: DataFrame, k: int, score: str = "score", *by: str) -> DataFrame:
    """The k best rows, or the k best of each group; ties go to the smaller id."""
    if not by:
        return df.orderBy(F.desc(score), "id").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def postings(df: DataFrame, text_col: str = "content", stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """Term index: (term, id, tf, doc_length)."""
    rows = df.select("id", text.tokens(text_col, stop).alias("t")).select("id", F.size("t").cast("long").alias("doc_length"), F.explode("t").alias("term"))
    return rows.groupBy("term", "id", "doc_length").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, text_col: str = "content", stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """(term, n, df): occurrences and documents of each term.

    A row's tokens and its distinct ones are counted where they are, so that a task sends a row a
    term. Only where an id repeats are its rows put together first.
    """
    if not df.groupBy("id").count().where((F.col("count") > 1) & F.col("id").isNotNull()).isEmpty():
        each = df.select("id", F.explode(text.tokens(text_col, stop)).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))
        return each.groupBy("term").agg(F.sum("n").alias("n"), F.count("id").alias("df"))
    rows = df.select("id", text.tokens(text_col, stop).alias("t"))
    each = rows.select("id", F.posexplode(F.array("t", F.array_distinct("t"))).alias("distinct", "t")).select("id", "distinct", F.explode("t").alias("term"))
    return each.groupBy("term").agg(F.count_if(F.col("distinct") == 0).alias("n"), F.count_if((F.col("distinct") == 1) & F.col("id").isNotNull()).alias("df"))


def bm25(df: DataFrame, terms: list[str], text_col: str = "content", avgdl_mode: str = "doc", stop: list[str] = text.STOP_WORDS, k1: float = 1.2, b: float = 0.75, likely: DataFrame | None = None) -> DataFrame:
    """(id, score) of the documents that hold a query term.

    Statistics need the length of every document, so one pass splits all texts, once each, and
    keeps five or so numbers a row; texts without a query term in them are counted, not scored.
    likely: df without some rows that hold no query term, where these are known.
    avgdl_mode: mean length over documents, or ("posting") over the matched postings.
    """
    terms = list(dict.fromkeys(terms))
    hits = [F.col(f"tf{i}") for i in range(len(terms))]
    counted = lambda t: F.struct(F.size(t).cast("long").alias("doc_length"), (F.filter(t, lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")).alias("held"))
    each = [F.size(F.filter("held", _equals(x))).cast("long").alias(f"tf{i}") for i, x in enumerate(terms)]
    # A one-element array binds the tokens: otherwise each count would split the text again.
    rows = df.select("id", F.explode(F.transform(F.array(text.tokens(text_col, stop)), counted)).alias("c")).select("id", "c.*").select("id", "doc_length", *each)
    any_hit = sum((h for h in hits), F.lit(0)) > 0
    stats = rows.agg(
        F.count(F.when(F.col("doc_length") > 0, 1)).alias("n"),
        F.sum("doc_length").alias("words"),
        *[F.count_if(h > 0).alias(f"df{i}") for i, h in enumerate(hits)],
        *[F.sum(F.when(h > 0, F.col("doc_length"))).alias(f"len{i}") for i, h in enumerate(hits)],
    )
    if avgdl_mode == "posting":
        total = sum((F.coalesce(F.col(f"len{i}"), F.lit(0)) for i in range(len(terms))), F.lit(0))
        mean = F.try_divide(total, sum((F.col(f"df{i}") for i in range(len(terms))), F.lit(0)))
    else:
        mean = F.try_divide("words", "n")
    found = (df if likely is None else likely).where(F.exists(text.strings(terms), lambda x: F.contains(F.lower(F.col(text_col)), x)))
    found = found.select("id", F.explode(F.transform(F.array(text.tokens(text_col, stop)), counted)).alias("c")).select("id", "c.*").select("id", "doc_length", *each)
    scored = found.crossJoin(F.broadcast(stats.withColumn("mean", F.coalesce(mean, F.lit(1.0)))))  # one row
    score = sum((scoring.bm25_idf(F.col(f"df{i}"), F.col("n")) * scoring.bm25_tf(h.cast("double"), F.col("doc_length"), F.col("mean"), k1, b) for i, h in enumerate(hits)), F.lit(0.0))
    return scored.where(any_hit).select("id", score.alias("score"))


def _equals(term: str):
    return lambda x: x == term


def semantic(index: DataFrame, query: list[float], memories: DataFrame | None = None, now: int | None = None, least: float = 0.1) -> DataFrame:
    """(id, score): cosine of `least` or more, weighted by trust and effective strength of readable memories.

    index: (id, embedding). Rows without a memory count with .5 each; unreadable memories fall out.
    """
    hits = index.select("id", vector.cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("cosine")).where(F.col("cosine") >= least)
    if memories is None:
        return hits.select("id", F.col("cosine").alias("score"))
    found = memories.select("id", readable(now).alias("ok"), "trust_score", scoring.effective_strength(F.col("strength"), scoring.days_between(now, F.col("updated_at"))).alias("eff"))
    joined = hits.join(found, "id", "left").where(F.coalesce("ok", F.lit(True)))
    trust, eff = F.coalesce("trust_score", F.lit(0.5)), F.coalesce("eff", F.lit(0.5))
    return joined.select("id", (F.col("cosine") * (0.5 + 0.5 * trust) * (0.5 + 0.5 * eff)).alias("score"))


def keyword(df: DataFrame, query: str, limit: int, **options) -> DataFrame:
    """(id, score) of the best `limit` by BM25, cut to [0, 1]."""
    terms = [t for t in dict.fromkeys(query_tokens(query))]
    return top(bm25(df, terms, **options), limit).select("id", scoring.clamp(F.col("score")).alias("score"))


def query_tokens(query: str) -> list[str]:
    """A query's keyword tokens, on the driver."""
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return [w for w in words if len(w.encode()) >= 2 and w not in text.STOP_WORDS]


def graph_leg(nodes: DataFrame, edges: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): nodes whose label or summary holds a query word (.3) and their neighbours (half the edge weight)."""
    words = query_tokens(query)
    hay = F.lower(F.concat_ws(" ", "label", "summary"))
    matched = nodes.where(F.exists(text.strings(words), lambda w: F.contains(hay, w))).select("id")
    both = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"), "weight").unionAll(edges.select("target_node_id", "source_node_id", "weight"))
    around = both.join(matched, both["a"] == matched["id"], "left_semi").select(F.col("b").alias("id"), (F.col("weight") * 0.5).alias("score"))
    return top(around.unionAll(matched.select("id", F.lit(0.3))).groupBy("id").agg(F.max("score").alias("score")), limit)


def temporal_leg(memories: DataFrame, now: int, limit: int, memory_type: str | None = None, tier: str | None = None) -> DataFrame:
    """(id, score) of the newest readable memories: 1 falls to .5 over a day, times (.5 + .5 trust)."""
    df = memories.where(readable(now))
    if memory_type:
        df = df.where(F.col("memory_type") == memory_type)
    if tier:
        df = df.where(F.col("tier") == tier)
    days = scoring.days_between(now, F.col("created_at"))
    newest = df.orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.select("id", (F.greatest(1 - 0.5 * days, F.lit(0.5)) * (0.5 + 0.5 * F.col("trust_score"))).alias("score"))


def legs(**named: DataFrame) -> DataFrame:
    """(strategy, id, score) of named legs."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("strategy"), "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(strategies: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score): sum over strategies of 1 / (k + rank), ranks from 0."""
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("score"), "id")) - 1
    return strategies.withColumn("rank", rank).groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def normalised(strategies: DataFrame) -> DataFrame:
    """Scores of each strategy spread over [0, 1]; all 1 where they are equal."""
    w = Window.partitionBy("strategy")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return strategies.withColumn("score", F.when(high - low > 1e-10, (F.col("score") - low) / (high - low)).otherwise(1.0))


def weighted_fusion(strategies: DataFrame, weights: dict[str, float] = FUSION_WEIGHTS) -> DataFrame:
    """(id, score): each strategy's best normalised score of an id, by weight."""
    best = normalised(strategies).groupBy("strategy", "id").agg(F.max("score").alias("score"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("strategy")), F.lit(0.0))
    return best.groupBy("id").agg(F.sum(F.col("score") * weight).alias("score"))


def mmr(candidates: DataFrame, k: int, lam: float = 0.7, by: str | None = None, embedding_col: str = "embedding") -> DataFrame:
    """candidates with mmr_rank (from 1) of the k chosen for relevance against likeness to those chosen before.

    Candidates are a bounded set for each query (a top-k, not a corpus). Rows that aren't chosen
    have a null rank; all keep their scores.
    """
    schema = candidates.withColumn("mmr_rank", F.lit(None).cast("int")).schema

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array([np.asarray(x, float) for x in rows[embedding_col]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, like = rows["score"].to_numpy(float), np.zeros(len(rows))
        rank = np.zeros(len(rows), "int32")
        for r in range(1, min(k, len(rows)) + 1):
            value = np.where(rank == 0, lam * score - (1 - lam) * like, -np.inf)
            best = int(np.argmax(value))
            rank[best] = r
            like = np.maximum(like, np.clip(v @ v[best], 0, 1))
        rows["mmr_rank"] = pd.Series(rank).where(rank > 0).astype("Int32")
        return rows

    key = by or "_all"
    grouped = candidates if by else candidates.withColumn("_all", F.lit(1))
    return grouped.groupBy(key).applyInPandas(lambda rows: choose(rows.drop(columns=["_all"], errors="ignore")), schema)


def text_mmr(candidates: DataFrame, k: int, lam: float = 0.7, text_col: str = "content") -> DataFrame:
    """mmr with word Jaccard for likeness; lam of .99 or more just sorts."""
    if lam >= 0.99:
        return top(candidates, k)
    schema = candidates.withColumn("mmr_rank", F.lit(None).cast("int")).schema

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        words = [frozenset(str(t).lower().split()) for t in rows[text_col]]
        like, rank = np.zeros(len(rows)), np.zeros(len(rows), "int32")
        score = rows["score"].to_numpy(float)
        for r in range(1, min(k, len(rows)) + 1):
            best = int(np.argmax(np.where(rank == 0, lam * score - (1 - lam) * like, -np.inf)))
            rank[best] = r
            like = np.maximum(like, [len(w & words[best]) / len(w | words[best]) if w | words[best] else 0.0 for w in words])
        rows["mmr_rank"] = rank
        return rows[rows["mmr_rank"] > 0]

    return candidates.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda rows: choose(rows.drop(columns="_all")), schema)


def temporal_weighted(memories: DataFrame, index: DataFrame, query: list[float], now: int, weight: float, limit: int) -> DataFrame:
    """(id, score): .7 (1 - w + w exp(-age / 7 days)) + .3 cosine, over readable memories."""
    days = scoring.days_between(now, F.col("created_at"))
    like = vector.cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    rows = memories.where(readable(now)).join(index, "id")
    return top(rows.select("id", (0.7 * (1 - weight + weight * F.exp(-days / 7)) + 0.3 * like).alias("score")), limit)


def with_all_tags(memory_tags: DataFrame, names: list[str]) -> DataFrame:
    """(id) of memories that have every one of the tags."""
    wanted = memory_tags.where(F.col("name").isin(names)).groupBy("memory_id").agg(F.count_distinct("name").alias("n"))
    return wanted.where(F.col("n") == len(set(names))).select(F.col("memory_id").alias("id"))


def tag_search(memories: DataFrame, memory_tags: DataFrame, names: list[str], now: int, limit: int, index: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """(id, score) of readable memories with all tags: cosine of .1 or more, or .5 without a query vector."""
    rows = memories.where(readable(now)).join(with_all_tags(memory_tags, names), "id", "left_semi")
    if query is None or index is None:
        return top(rows.select("id", F.lit(0.5).alias("score")), limit)
    scored = rows.join(index, "id").select("id", vector.cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))
    return top(scored.where(F.col("score") >= 0.1), limit)


def best_by_workspace(hits: DataFrame, limit: int, least: float = 0.1) -> DataFrame:
    """(workspace_id, best_id, score, hits): the best match of each workspace, the best workspaces first."""
    rows = hits.where(F.col("score") >= least).groupBy("workspace_id").agg(F.max_by("id", F.struct("score", "id")).alias("best_id"), F.max("score").alias("score"), F.count("*").alias("hits"))
    return rows.orderBy(F.desc("score"), "workspace_id").limit(limit)


def entity_boost(results: DataFrame, entities: list[str], text_col: str = "content", factor: float = 0.4) -> DataFrame:
    """Scores raised by up to `factor` for the share of the query's entities that the text names."""
    if not entities:
        return results
    hits = F.size(F.filter(text.strings([e.lower() for e in entities]), lambda e: F.contains(F.lower(F.col(text_col)), e)))
    return results.withColumn("score", F.col("score") * (1 + factor * F.least(F.lit(1.0), hits / F.lit(float(len(entities))))))


def entity_injection(results: DataFrame, nodes: DataFrame, edges: DataFrame, memories: DataFrame, entities: list[str], per_entity: int = 5, most: int = 10, score: float = 0.3) -> DataFrame:
    """results with up to `most` memories that are linked to the query's entities and aren't there yet, at a fixed score."""
    named = nodes.where(F.lower("label").isin([e.lower() for e in entities])).select(F.col("id").alias("node"))
    both = edges.select(F.col("source_node_id").alias("node"), F.col("target_node_id").alias("id")).unionAll(edges.select("target_node_id", "source_node_id"))
    linked = both.join(named, "node").join(memories.select("id"), "id", "left_semi").distinct()
    near = linked.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("n") <= per_entity).select("id").distinct()
    fresh = near.join(results, "id", "left_anti").orderBy("id").limit(most).withColumn("score", F.lit(score))
    return results.unionByName(fresh, allowMissingColumns=True)


def keyword_fallback(memories: DataFrame, notes: DataFrame, query: str, limit: int) -> DataFrame:
    """Memories and notes that hold a query word, newest first, scored by position from 1 to 0."""
    words = text.query_words(query)
    rows = memories.select("id", F.lit("memory").alias("entity_type"), F.col("content").alias("text"), "created_at").unionByName(
        notes.select("id", F.lit("note").alias("entity_type"), F.concat_ws(" ", "title", "content").alias("text"), "created_at")
    )
    hit = F.exists(text.strings(words), lambda w: F.contains(F.lower(F.col("text")), w))
    newest = rows.where(hit).orderBy(F.desc("created_at"), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "id")) - 1  # `limit` rows
    return newest.withColumn("score", 1 - place / F.lit(float(limit)))


def hamming_then_cosine(index: DataFrame, query: list[float], first: int, k: int) -> DataFrame:
    """(id, score): cosine of the `first` rows that are nearest by sign bits."""
    bits = vector.packed_bits(F.col("embedding"))
    wanted = vector.packed_bits(F.array(*map(F.lit, query)))
    near = top(index.withColumn("score", vector.hamming_similarity(bits, wanted, len(query))), first)
    return top(near.withColumn("score", vector.cosine(F.col("embedding"), F.array(*map(F.lit, query)))).select("id", "score"), k)


def nearest(index: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): the k nearest by Euclidean distance, 1 / (1 + d)."""
    return top(index.select("id", vector.euclidean_similarity(F.col("embedding"), F.array(*map(F.lit, query))).alias("score")), k)


def hybrid(memories: DataFrame, index: DataFrame, query: str, query_vector: list[float], now: int, limit: int = 20, weights: dict[str, float] | None = None, graph: DataFrame | None = None, keyword_hits: DataFrame | None = None) -> DataFrame:
    """(id, score): keyword, semantic, recency and, if given, graph legs, fused by reciprocal rank or by weights.

    keyword_hits: the keyword leg, if a full-text index gave it; otherwise all texts are scanned.
    """
    named = {
        "keyword": keyword(memories, query, limit) if keyword_hits is None else keyword_hits,
        "semantic": top(semantic(index, query_vector, memories, now), limit),
        "temporal": temporal_leg(memories, now, limit),
    }
    if graph is not None:
        named["graph"] = graph
    strategies = legs(**named)
    return top(weighted_fusion(strategies, weights) if weights else rrf(strategies), limit)
