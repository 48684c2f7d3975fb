"""Filter interaction audit: what each filter removes at each place of every order of the filters.

A document's failures are a mask of bits. Masks are counted into cells (part, mask) once; the
orders and their steps are laid out against the cells in long form, a running bit-or window
tells what failed earlier, and conditional sums and a total over each filter's rows give the
metrics. After the cells the work depends on the parts only, not on the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = bytes(range(ord("A"), ord("Z") + 1))

#: Letter and failure condition of each filter that looks at one text, given the text, its UTF-8 and its words.
FILTERS: list[tuple[str, Callable[[str, bytes, list[bytes]], bool]]] = [
    ("A", lambda text, raw, words: len(words) < 200),
    ("B", lambda text, raw, words: 100 * len(set(words)) < 50 * len(words)),
    ("C", lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(text)),
    ("D", lambda text, raw, words: re.search(b"[#$%&*|]", raw) is not None),
]

#: The filter that looks at the whole table: the text equals that of a smaller doc_id.
REPEATED = "E"


def text_mask(text: Column, filters=FILTERS) -> Column:
    """Bits of the filters that a text fails, the first filter's lowest; null counts as empty. Words are runs of bytes that are no ASCII white space."""

    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            raw = (value or "").encode()
            words = raw.split()
            out.append(sum(1 << k for k, (_, fails) in enumerate(filters) if fails(value or "", raw, words)))
        return pd.Series(out, dtype="int32")

    return F.pandas_udf(mask, "int")(text)


def mask_cells(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each part by the filters that they fail.

    Texts travel as digests. Copies are counted by (digest, part, labels) before they meet their
    smallest doc_id, so that a group of any size is a few rows there. Rows without a doc_id are
    no smaller than any other row and have no label. Of repeated rows of a doc_id none fails by
    the other. A label counts if any row of its doc_id has it.
    """
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), text_mask(F.col("text"), filters).alias("mask"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0).alias("salt"),
    )
    rows = rows.join(flags.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").select("id", "salt", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    same = rows.groupBy("id", "salt", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("c"))
    named = F.col("id").isNotNull()
    groups = same.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("c").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("c"))).alias("n_null"), F.min(F.when(named, F.struct("id", "c"))).alias("least"),
    )
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("n_first", F.col("n_null") + F.when(first, F.col("least.c")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("n_first").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"), (F.col("n") - F.col("n_first")).alias("n"))))
    return groups.select("part", "good", "toxic", split.alias("x")).where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("n_good"), F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic"))


def audit_cells(cells: DataFrame, letters: str) -> DataFrame:
    """The metrics of each (part, filter_order, step) from cells; letters name the mask's bits, lowest first."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(letters)])
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    rows = rows.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = rows.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.col("letter")) - 1)).withColumn("fail", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.bit_or("fail").over(before), F.lit(0)))
    fails, passed = F.col("fail") != 0, F.col("earlier") == 0

    def total(condition: Column, n: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(n)).otherwise(0)).cast("long")

    sums = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(~passed & fails).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(passed & fails, "n_good").alias("good_lost"), total(passed & fails, "n_toxic").alias("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """One row per part (source; null: empty string), filter_order and step, zeros included.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley count documents of
    the part: kept after this step, removed at it, failing its filter but removed earlier, failing
    its filter only, removed here with quality 1 or toxic 1, and the filter's removals summed over
    all orders. The last filter is REPEATED. Null texts are empty texts; other columns of docs
    are ignored; rows without a doc_id are no copy of any other and have no labels; repeated
    rows each count; an empty table gives no rows.
    """
    return audit_cells(mask_cells(docs, labels, filters), "".join(x for x, _ in filters) + REPEATED)


def audit_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


AUDIT_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
      FROM f p JOIN f q ON p.x <> q.x JOIN f r ON r.x NOT IN (p.x, q.x) JOIN f s ON s.x NOT IN (p.x, q.x, r.x) JOIN f t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit FROM o),
e AS (SELECT filter_order, step, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM s),
z AS (SELECT part, filter_order, step::INT AS step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
      FROM c CROSS JOIN e GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM z
"""
