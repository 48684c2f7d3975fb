"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import bind

SPACE = r"[\x20\x09-\x0D]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is that for it with as was on are by this be from or an at
der die das und ist von mit den dem ein eine zu im auf für nicht sich des als auch
le la les de des et est un une que qui dans pour pas sur avec au du
el los las y en por con para del se su al lo como
""".split()

#: (feature, least, most): a text is kept if each feature is within its bounds; None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("mark_ratio", None, 0.3),
    ("upper_ratio", None, 0.5),
    ("stop_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more, the first included.

    Windows are sorted by hash so that equal ones are neighbours; covered words are counted
    from the gaps between the repeated windows' starts.
    """

    def covered(starts: Column) -> Column:
        gaps = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")),
        )
        return gaps["n"]

    def repeats(rows: Column) -> Column:
        def kept(row: Column, i: Column) -> Column:
            return (F.get(rows, i - 1)["h"] == row["h"]) | (F.get(rows, i + 1)["h"] == row["h"])

        return F.array_sort(F.transform(F.filter(rows, lambda row, i: F.coalesce(kept(row, i), F.lit(False))), lambda row: row["i"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    some = bind(F.sort_array(windows(words)), lambda rows: bind(repeats(rows), covered))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(some)


def counts(text: Column) -> list[Column]:
    """The counted columns; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    def less(drop: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, drop, ""))).cast("long")

    return [
        bind(words, of_words).alias("_w"),
        bind(lines, of_lines).alias("_l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        less("#*$%&|<>").alias("n_symbols"),
        less("!?…").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ]


def verdict(rules=RULES) -> Column:
    """The threshold table as one condition over the counted columns."""
    n_words, n_lines = F.col("n_words"), F.col("n_lines")
    features = {
        "n_words": n_words,
        "mean_word_chars": F.try_divide("word_chars", n_words),
        "symbol_ratio": F.try_divide("n_symbols", n_words),
        "mark_ratio": F.try_divide("n_marks", n_words),
        "upper_ratio": F.try_divide("n_upper", F.col("word_chars")),
        "stop_ratio": F.try_divide("n_stop", n_words),
        "dup_line_ratio": F.try_divide("n_dup_lines", n_lines),
        "bullet_line_ratio": F.try_divide("n_bullet_lines", n_lines),
        "ellipsis_line_ratio": F.try_divide("n_ellipsis_lines", n_lines),
    }
    passed = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            passed &= features[name] >= least
        if most is not None:
            passed &= features[name] <= most
    return F.coalesce(passed, F.lit(False))


def quality(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Columns of docs with these names are replaced. base_failed: fewer than 50 words, or more
    than half of the words in repeated 3-word windows; kept: not base_failed and within all
    rules. Null and empty texts have zero counts and fail; repeated rows are each judged; an
    empty table gives no rows. No shuffle: one projection over the scan.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = docs.select(F.struct("*").alias("_row"), *counts(F.col(text_col))).select("*", "_w.*", "_l.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).drop("text")


QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY r),
c AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stop,
         len(regexp_extract_all(t, '[!?…]')) AS n_marks, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
         len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM d LEFT JOIN p ON d.r = p.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words >= 2.0 AND word_chars / n_words <= 12.0
         AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.3 AND n_upper / nullif(word_chars, 0) <= 0.5
         AND n_stop / n_words >= 0.04 AND n_dup_lines / nullif(n_lines, 0) <= 0.3
         AND n_bullet / nullif(n_lines, 0) <= 0.9 AND n_ellipsis / nullif(n_lines, 0) <= 0.3, false) AS kept
FROM f
"""
