"""Pattern detection: co-occurrence, topics, time clusters, sequences, spans of text."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.sources.shared import stored


def with_tokens(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(id, tokens, terms): all pattern tokens and the distinct ones."""
    tokens = text.pattern_tokens(text_col)
    return df.select("*", tokens.alias("tokens")).withColumn("terms", F.array_distinct("tokens"))


def term_df(df: DataFrame, text_col: str = "content", least: int = 2, k: int = 20) -> DataFrame:
    """(term, df) of the k terms that most rows hold."""
    rows = with_tokens(df, text_col).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return rows.where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(k)


def co_occurrence(df: DataFrame, items: Column, least: int = 2, k: int | None = None) -> DataFrame:
    """(a, b, n, strength): pairs of items that rows share, n rows each; strength is their share of all rows, 3 decimals.

    Pairs are formed within a row only, of its distinct items.
    """
    rows = df.select(F.array_sort(F.array_distinct(items)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.greatest(F.size("x"), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    total = df.agg(F.count("*").alias("total"))
    counted = rows.where(F.size("x") >= 2).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = counted.crossJoin(F.broadcast(total)).select("a", "b", "n", F.round(F.col("n") / F.col("total"), 3).alias("strength"))  # one row
    return out.orderBy(F.desc("n"), "a", "b").limit(k) if k is not None else out


def top_co_occurrence(df: DataFrame, items: Column, k: int) -> DataFrame:
    """co_occurrence's k best pairs, exactly, without forming the pairs of rare items.

    Pairs of the most common items give a count that k pairs reach; items that fewer rows
    hold can't be in a better pair.
    """
    rows = df.select(F.array_distinct(items).alias("x"))
    counts = rows.select(F.explode("x").alias("i")).groupBy("i").agg(F.count("*").alias("df"))
    common = [r["i"] for r in counts.orderBy(F.desc("df"), "i").limit(max(20, 2 * k)).collect()]
    among = co_occurrence(rows, F.array_intersect(F.col("x"), text.strings(common)), k=k).select("n").collect()
    bound = among[-1]["n"] if len(among) == k else 2
    frequent = counts.where(F.col("df") >= bound).select("i")
    spread = rows.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode("x").alias("i")).join(frequent, "i")
    return co_occurrence(spread.groupBy("r").agg(F.collect_list("i").alias("x")), F.col("x"), k=k).select("a", "b", "n")


def topics(df: DataFrame, text_col: str = "content", k: int = 15, least: int = 2, terms_each: int = 5) -> DataFrame:
    """(topic, n, mean_confidence, top_terms) of the k most common terms: what rows that hold one are about.

    One pass over the tokens has a sum a topic, so that a task sends a row a term. Rows under names
    that no token has count the documents and their confidence.
    """
    best = [r["term"] for r in term_df(df, text_col, least, k).collect()]  # k rows
    if not best:
        return df.sparkSession.createDataFrame([], "topic string, n long, mean_confidence double, top_terms array<string>")
    held = [F.col(f"h{i}") for i in range(len(best))]
    rows = df.select("confidence", text.pattern_tokens(text_col).alias("tokens")).select("*", *[F.array_contains("tokens", t).alias(f"h{i}") for i, t in enumerate(best)]).where(functools.reduce(operator.or_, held))
    each = rows.select("confidence", *held, F.explode(F.concat("tokens", text.strings(["-n", "-known", "-sum"]))).alias("term"))
    worth = F.when(F.col("term") == "-sum", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).when((F.col("term") == "-known") & F.col("confidence").isNull(), 0.0).otherwise(1.0)
    sums = each.withColumn("worth", worth).groupBy("term").agg(*[F.sum(F.when(h, F.col("worth")).otherwise(0.0)).alias(f"s{i}") for i, h in enumerate(held)])
    counts = sums.select("term", F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"s{i}").alias("tf")) for i, t in enumerate(best)])).alias("c")).select("term", "c.*").where(F.col("tf") > 0)
    counts = stored(counts.withColumn("told", F.col("term").startswith("-")).withColumn("r", F.row_number().over(Window.partitionBy("topic", "told").orderBy(F.desc("tf"), "term"))).where(F.col("r") <= max(terms_each, 3)))
    of = lambda name: F.max(F.when(F.col("term") == name, F.col("tf")))
    general = counts.where("told").groupBy("topic").agg(of("-n").cast("long").alias("n"), F.round(F.when(of("-known") > 0, F.coalesce(of("-sum"), F.lit(0.0)) / of("-known")), 3).alias("mean_confidence"))
    words = counts.where((~F.col("told")) & (F.col("r") <= terms_each)).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("x"))
    return general.join(words, "topic").select("topic", "n", "mean_confidence", F.transform("x", lambda s: s["term"]).alias("top_terms"))


def time_clusters(df: DataFrame, text_col: str = "content", minutes: int = 30, least: int = 2, terms_each: int = 5) -> DataFrame:
    """(bucket, n, first_id, top_terms): rows created in the same span of minutes, counted from the epoch."""
    bucket = F.floor(F.col("created_at") / F.lit(minutes * 60_000_000)).alias("bucket")
    rows = with_tokens(df, text_col).select(bucket, "id", "terms")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= least)
    counts = rows.join(sizes.select("bucket"), "bucket", "left_semi").select("bucket", F.explode("terms").alias("term")).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("df"), "term"))
    words = counts.withColumn("r", rank).where(F.col("r") <= terms_each).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("x"))
    return sizes.join(words, "bucket", "left").select("bucket", "n", "first_id", F.transform("x", lambda s: s["term"]).alias("top_terms"))


def shared_sequences(df: DataFrame, by: str, order: str, text_col: str = "content") -> DataFrame:
    """(by, order, shared): three rows in a row that share tokens."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, order, F.array_distinct(text.pattern_tokens(text_col)).alias("t"))
    rows = rows.withColumn("t2", F.lead("t", 1).over(w)).withColumn("t3", F.lead("t", 2).over(w))
    shared = F.array_sort(F.array_intersect(F.array_intersect("t", "t2"), F.col("t3")))
    return rows.select(by, order, shared.alias("shared")).where(F.size("shared") > 0)


def peak_hour(df: DataFrame) -> DataFrame:
    """One row: the hour (UTC) in which most rows were created, its part of the day, and its count."""
    hour = F.floor(F.col("created_at") / F.lit(3_600_000_000)) % 24
    best = df.groupBy(hour.alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(1)
    part = F.when(F.col("hour") < 6, "night").when(F.col("hour") < 12, "morning").when(F.col("hour") < 18, "afternoon").otherwise("evening")
    return best.select("hour", part.alias("part"), "n")


# Cues of events in messages, and their confidences.
DECISION_CUES = ["decided", "decision", "agreed", "consensus", "conclusion", "going with", "let's use", "we'll go with", "approved"]
ACTION_CUES = ["todo", "to do", "action item", "follow up", "need to", "will do", "going to", "create a", "set up", "schedule"]


def message_events(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with one row for each event found: decision (.7), action_item (.6), question (.9)."""
    low = F.lower(F.col(text_col))
    has = lambda cues: F.exists(text.strings(cues), lambda c: F.contains(low, c))
    event = lambda name, confidence: F.struct(F.lit(name).alias("event"), F.lit(confidence).alias("confidence"))
    found = F.array_compact(F.array(F.when(has(DECISION_CUES), event("decision", 0.7)), F.when(has(ACTION_CUES), event("action_item", 0.6)), F.when(F.col(text_col).contains("?"), event("question", 0.9))))
    return messages.select("*", F.explode(found).alias("e")).select(*messages.columns, "e.event", "e.confidence")


# Words that mark a sentence as important.
KEY_WORDS = """
important critical key remember vital essential prefer preferred always never must required rule fact decision decided
chosen favourite favorite goal objective identity background significant notable major primary main
""".split()


def sentence_scores(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(id, position, sentence, score): length, key words, place and density of numbers and names, within [0, 1]."""
    rows = df.select("id", text.sentences(F.col(text_col)).alias("s")).select("id", F.size("s").alias("total"), F.posexplode("s").alias("position", "sentence"))
    n = F.length("sentence")
    keys = F.aggregate(text.strings(KEY_WORDS), F.lit(0), lambda a, k: a + F.contains(F.lower(F.col("sentence")), k).cast("int"))
    marks = F.regexp_count("sentence", F.lit(r"\b\d+\b")) + F.regexp_count("sentence", F.lit(r"\b[A-Z][a-z]{2,}\b")) * 0.5
    score = (
        0.5
        + F.when(n < 10, -0.3).when(n > 500, -0.2).otherwise(0.0)
        + F.least(keys * 0.15, F.lit(0.6))
        + F.when(F.col("position") == 0, 0.1).otherwise(0.0)
        + F.when((F.col("position") == F.col("total") - 1) & (F.col("total") > 1), 0.1).otherwise(0.0)
        + F.least(marks / F.greatest(n, F.lit(1)) * 20, F.lit(0.2))
    )
    return rows.select("id", "position", "sentence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def extractive_summary(df: DataFrame, text_col: str = "content", most: int = 5, likeness: float = 0.8) -> DataFrame:
    """(id, summary): the best sentences in their order; one too like a better one is left out. Greedy within a text."""
    scored = sentence_scores(df, text_col)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "sentence", F.array_distinct(F.split(F.lower("sentence"), r"\s+")).alias("w"))))

    def take(acc: Column, x: Column) -> Column:
        alike = F.exists(acc, lambda y: text.jaccard(y["w"], x["w"]) >= likeness)
        return F.when((F.size(acc) >= most) | alike, acc).otherwise(F.concat(acc, F.array(x)))

    grouped = scored.groupBy("id").agg(ranked.alias("x"))
    empty = F.array().cast("array<struct<s:double,position:int,sentence:string,w:array<string>>>")
    chosen = F.transform(F.aggregate("x", empty, take), lambda x: F.struct(x["position"], x["sentence"]))
    return grouped.select("id", F.array_join(F.transform(F.array_sort(chosen), lambda x: x["sentence"]), " ").alias("summary"))


def tier_summary(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Summaries of 8, 5 and 3 sentences for tiers L0, L1 and L2: (id, tier, summary)."""
    parts = [extractive_summary(df, text_col, n).withColumn("tier", F.lit(t)) for t, n in (("L0", 8), ("L1", 5), ("L2", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
