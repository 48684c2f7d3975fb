"""Search strategies over a session table (id, name, summary, metadata, created_at); all return (id, score)."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.functions.scoring import DAY
from quillion.operators.search import top


def _text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def scored(sessions: DataFrame, score: Column, limit: int, least: float = 0.0) -> DataFrame:
    return top(sessions.select("id", score.cast("double").alias("score")).where(F.col("score") > least), limit)


def keyword_ratio(query: str) -> Column:
    """Share of the query's words found."""
    terms = query.lower().split()
    hay = _text("name", "summary", "metadata")
    return sum((hay.contains(t).cast("int") for t in terms), F.lit(0)) / F.lit(float(max(len(terms), 1)))


def keyword(sessions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return scored(sessions, keyword_ratio(query), limit)


def temporal(sessions: DataFrame, start: int, end: int, limit: int = 10) -> DataFrame:
    """Sessions within the times, scored from 0 to 1 by recency among them."""
    rows = sessions.where(F.col("created_at").between(start, end))
    ends = rows.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"))
    joined = rows.crossJoin(F.broadcast(ends))  # one row
    return top(joined.select("id", ((F.col("created_at") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1))).alias("score")), limit)


def entity(sessions: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """2 for a hit in the name and 1 for one in the summary."""
    return scored(sessions, F.when(_text("name").contains(name.lower()), 2).otherwise(0) + F.when(_text("summary").contains(name.lower()), 1).otherwise(0), limit)


def recency(sessions: DataFrame, query: str, now: int, limit: int = 10) -> DataFrame:
    """Keyword score times .5 to 1 by age over 30 days."""
    age = F.greatest(F.lit(0.0), 1 - (now - F.col("created_at")) / F.lit(30.0 * DAY))
    return scored(sessions, keyword_ratio(query) * F.when(F.col("created_at") > 0, 0.5 + 0.5 * age).otherwise(1.0), limit)


def fuzzy(sessions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return scored(sessions, text.subsequence_score(query.lower(), _text("name")), limit, 0.3)


def phrase(sessions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return scored(sessions, _text("name", "summary").contains(query.lower().strip()).cast("int"), limit)


def boolean(sessions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Words after AND (or first) must all be there, after OR one of them, after NOT none."""
    groups: dict[str, list[str]] = {"AND": [], "OR": [], "NOT": []}
    current = "AND"
    for word in query.split():
        if word.upper() in groups:
            current = word.upper()
        else:
            groups[current].append(word.lower())
    hay = _text("name", "summary")
    test = functools.reduce(lambda a, t: a & hay.contains(t), groups["AND"], F.lit(True))
    test = functools.reduce(lambda a, t: a & ~hay.contains(t), groups["NOT"], test)
    if groups["OR"]:
        test &= functools.reduce(lambda a, t: a | hay.contains(t), groups["OR"], F.lit(False))
    return scored(sessions, test.cast("int"), limit)


def proximity(sessions: DataFrame, query: str, within: int = 5, limit: int = 10) -> DataFrame:
    """The query's other words within `within` words after its first one; 1 less the share of the distance used."""
    words, terms = F.split(_text("summary"), r"\s+"), query.lower().split()
    first, rest = terms[0], terms[1:]

    def reach(i: Column) -> Column:
        """The smallest distance that holds all other words, null if there is none."""
        at = [F.array_position(F.slice(words, i + 2, within), t) for t in rest]
        far = F.greatest(*at) if len(at) > 1 else at[0] if at else F.lit(1)
        near = functools.reduce(lambda a, b: a & (b > 0), at, F.lit(True))
        return F.when(near, far)

    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, reach(i))), lambda x: x.isNotNull())
    return scored(sessions, F.when(F.size(starts) > 0, 1 - F.array_min(starts) / F.lit(float(within))).otherwise(F.lit(-1.0)), limit, -0.5)


def structured(sessions: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """field:value pairs against the metadata JSON, all of them."""
    pairs = re.findall(r"(\w+):(\S+)", query)
    test = functools.reduce(lambda a, p: a & F.coalesce(F.lower(F.get_json_object("metadata", f"$.{p[0]}")) == p[1].lower(), F.lit(False)), pairs, F.lit(bool(pairs)))
    return scored(sessions, test.cast("int"), limit)


def by_volume(hits: DataFrame, related: DataFrame, limit: int = 10) -> DataFrame:
    """Hits times the number of related rows (session_id): messages for flow, memories for importance."""
    n = related.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    return top(hits.join(n, "id").select("id", (F.col("score") * F.col("n")).alias("score")), limit)


def by_topic(hits: DataFrame, topics: DataFrame, each: int = 3, limit: int = 10) -> DataFrame:
    """At most `each` hits of one topic; topics: (id, topic)."""
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "id"))
    return top(hits.join(topics, "id").withColumn("r", r).where(F.col("r") <= each).groupBy("id").agg(F.max("score").alias("score")), limit)


def first_of(*hits: DataFrame, limit: int = 10) -> DataFrame:
    """The union of strategies; a session takes the score of the first that has it."""
    rows = functools.reduce(lambda a, b: a.unionByName(b), [h.select("id", "score", F.lit(i).alias("n")) for i, h in enumerate(hits)])
    return top(rows.groupBy("id").agg(F.min_by("score", "n").alias("score")), limit)


def timeline(messages: DataFrame, steps: DataFrame, events: DataFrame) -> DataFrame:
    """(created_at, kind, text) of messages, steps and events in order of time."""
    part = lambda df, kind, column: df.select("created_at", F.lit(kind).alias("kind"), F.col(column).alias("text"))
    return part(messages, "message", "content").unionByName(part(steps, "step", "content")).unionByName(part(events, "event", "event")).orderBy("created_at", "kind", "text")


def distilled(messages: DataFrame) -> DataFrame:
    """(session_id, participants, messages, decisions, questions, summary) of (session_id, role, turn, text); summary: the first and last text's beginnings."""
    low = F.lower("text")
    decided = functools.reduce(lambda a, c: a | low.contains(c), ["decided", "agreed", "approved"], F.lit(False))
    return messages.groupBy("session_id").agg(
        F.array_sort(F.collect_set("role")).alias("participants"), F.count("*").alias("messages"), F.count_if(decided).alias("decisions"), F.count_if(F.col("text").contains("?")).alias("questions"),
        F.concat_ws(" ... ", F.substring(F.min_by("text", "turn"), 1, 80), F.substring(F.max_by("text", "turn"), 1, 80)).alias("summary"),
    )


# Cues of a query's intent, and the weight of each hit.
INTENTS = {
    "temporal": (0.4, "when|how long|recent|latest|earliest|before|after|yesterday|today|this week|this month|timeline|sequence|order|history|past"),
    "factual": (0.35, "what is|who is|where is|when did|what was|what are|who are|define|meaning|definition|tell me about|explain|describe|fact|details"),
    "procedural": (0.4, "how to|how do|steps|instructions|guide|tutorial|process|procedure|way to|method"),
    "comparison": (0.35, "compare|versus|vs|difference|better|worse|similarities|vs.|compared to|rather than"),
    "causal": (0.4, "why|how come|reason|cause|because|what caused|what led to|why did|explain why"),
    "social": (0.3, "person|people|who|relationship|opinion|feeling|said|thought|believes|thinks"),
    "summarization": (0.5, "summarize|summary|overview|recap|tl;dr|brief|in short|condense|key points"),
}


def intents(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with intent, confidence and secondary intents (over .2), by the cues that the text holds."""
    low = F.trim(F.lower(F.col(column)))
    scores = []
    for name, (weight, cues) in INTENTS.items():
        hits = sum((low.contains(c).cast("int") for c in cues.split("|")), F.lit(0))
        scores.append(F.struct((-F.least(F.lit(1.0), hits * weight)).alias("s"), F.lit(len(scores)).alias("n"), F.lit(name).alias("intent")))
    found = F.array_sort(F.filter(F.array(*scores), lambda x: x["s"] < 0))
    short = F.size(F.split(low, r"\s+")) <= 3
    rows = queries.withColumn("_f", found)
    best = F.get("_f", F.lit(0))
    return rows.select(
        *queries.columns,
        F.when(low == "", "unknown").when(F.size("_f") > 0, best["intent"]).otherwise("exploratory").alias("intent"),
        F.when(low == "", 0.0).when(F.size("_f") > 0, F.round(-best["s"], 4)).when(short, 0.6).otherwise(0.3).alias("confidence"),
        F.transform(F.filter(F.slice("_f", 2, 10), lambda x: x["s"] < -0.2), lambda x: x["intent"]).alias("secondary"),
    )


# The strategy and reranker that a query's intent names.
STRATEGY_OF = {
    "factual": "semantic", "temporal": "recency_boosted", "procedural": "hybrid", "exploratory": "diverse", "social": "entity_focused",
    "summarization": "keyword", "comparison": "exact_phrase", "causal": "semantic_graph",
}
RERANKER_OF = {"exploratory": "mmr"}


def routed(query: str, hits: DataFrame) -> DataFrame:
    """hits with the query's intent, and the strategy and reranker that it names."""
    one = intents(hits.sparkSession.createDataFrame([(query,)], "query string")).select("intent")
    named = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("intent")), F.lit(other))
    one = one.select("intent", named(STRATEGY_OF, "hybrid").alias("strategy"), named(RERANKER_OF, "").alias("reranker"))
    return hits.crossJoin(F.broadcast(one))  # one row
