"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines within one edit of each other become equal when one character is deleted from both
(substitution) or from the longer one (insertion). Each line emits these variants as hashed
keys; a key also names the place of the deletion, so that any two lines with an equal
substitution key, and the short and any long line of an insertion key, are within the bound.
The earliest line of a key is then a minimum that is summed before the shuffle: no pairs.

Emitting a variant for each character of all lines would be wasteful, so lines first meet on
halves: one edit leaves a half intact, hence only lines that share a half with another line
of a fitting length emit variants. This loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import join_by_size, materialize, unused

BLOCK = 64


def _part(text: str, start: str, length: str | None = None) -> Column:
    return F.expr(f"substring({text}, {start}{f', {length}' if length else ''})")


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, line) of each line with a character other than white space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64("line", F.lit(1))})


HALVES = ("own0", "own1", "probe0", "probe1")


def half_keys() -> dict[str, Column]:
    """Keys of a line's halves: as a line of its length, and of one more."""
    keys = {}
    for name, m in (("own", "length(line)"), ("probe", "length(line) + 1")):
        keys[f"{name}0"] = F.xxhash64(F.lit(0), F.expr(m), _part("line", "1", f"int(({m}) div 2)"))
        keys[f"{name}1"] = F.xxhash64(F.lit(1), F.expr(m), F.expr(f"right(line, int(({m}) - ({m}) div 2))"))
    return keys


def variants(lines: DataFrame) -> DataFrame:
    """(first, role, key) for each variant of each candidate line, in blocks of 64 characters.

    Roles: s, a deletion that stands for a substitution; x, a deletion from the longer line;
    y, the shorter line itself, once for each block in which the longer one may have more.
    """
    n, b = F.length("line"), F.col("b")
    base = lines.select("first", "line", "sub", "long", "short", n.cast("int").alias("n"))
    cut = base.where("sub or long").withColumn("b", F.explode(F.expr("sequence(0, int((n - 1) div 64))")))
    cut = cut.select("first", "sub", "long", "n", "b", F.xxhash64(_part("line", "1", "b * 64")).alias("pre"), _part("line", "b * 64 + 1", "64").alias("mid"), F.xxhash64(_part("line", "b * 64 + 65")).alias("suf"))
    cut = cut.withColumn("i", F.explode(F.expr("sequence(1, int(length(mid)))")))
    rest = F.concat(_part("mid", "1", "i - 1"), _part("mid", "i + 1"))
    sub = F.when(F.col("sub"), F.struct(F.lit("s").alias("role"), F.xxhash64(F.lit(2), "n", b, "i", "pre", "suf", rest).alias("key")))
    long = F.when(F.col("long"), F.struct(F.lit("x").alias("role"), F.xxhash64(F.lit(3), "n", b, "pre", "suf", rest).alias("key")))
    cut = cut.select("first", F.explode(F.array_compact(F.array(sub, long))).alias("v"))
    whole = base.where("short").withColumn("b", F.explode(F.expr("sequence(0, int(n div 64))"))).withColumn("size", F.expr("least(64, n + 1 - b * 64) - 1"))
    key = F.xxhash64(F.lit(3), F.expr("n + 1"), b, F.xxhash64(_part("line", "1", "b * 64")), F.xxhash64(_part("line", "b * 64 + size + 1")), _part("line", "b * 64 + 1", "size"))
    return cut.select("first", "v.role", "v.key").union(whole.select("first", F.lit("y"), key))


def near_lines(lines: DataFrame) -> DataFrame:
    """(first, earliest): candidate lines with the earliest line within one edit, if it is earlier."""
    emitted = variants(lines)
    deleted = F.when(F.col("role") != "y", F.col("first"))
    groups = emitted.groupBy("key").agg(F.min(deleted).alias("low"), F.max(deleted).alias("high"), F.min(F.when(F.col("role") == "y", F.col("first"))).alias("whole"))
    groups = materialize(groups.where("low < high and whole is null or low is not null and whole is not null"))
    other = F.when(F.col("role") == "x", F.col("whole")).otherwise(F.col("low"))
    met = join_by_size(emitted, groups, ["key"]).withColumn("other", other).where("other < first")
    found = met.groupBy("first").agg(F.min("other").alias("earliest"))
    texts = lines.select("first", "line")
    pairs = found.join(texts, "first").join(texts.select(F.col("first").alias("earliest"), F.col("line").alias("line2")), "earliest")
    return pairs.where(F.levenshtein("line", "line2", 1) >= 0).select("first", "earliest")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near_chars: int = 16) -> DataFrame:
    """(doc_id, pos) of the lines that stay: first of their class, and no earlier near line."""
    rows = line_rows(docs, id_col, text_col)
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    halves = {k: F.when(F.length("line") >= min_near_chars, v) for k, v in half_keys().items()}
    classes = rows.select("doc_id", "pos", "k1", "k2", *[v.alias(k) for k, v in halves.items()])
    classes = materialize(classes.groupBy("k1", "k2").agg(first, *[F.any_value(k).alias(k) for k in HALVES]))

    # Halves of distinct lines: a line that is repeated a million times is one row here.
    each = F.array(*[F.struct(F.col(k).alias("half"), F.lit(k.startswith("own")).alias("own")) for k in HALVES])
    halves = classes.where("own0 is not null").select("k1", "k2", "first", F.explode(each).alias("h")).select("k1", "first", "h.half", "h.own")
    own, probe = F.when(F.col("own"), F.col("k1")), F.when(~F.col("own"), F.col("k1"))
    groups = halves.groupBy("half").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min(probe).alias("probe"))
    groups = groups.select("half", (F.col("low") < F.col("high")).alias("sub"), (F.col("low").isNotNull() & F.col("probe").isNotNull()).alias("mixed"))
    groups = materialize(groups.where("sub or mixed"))
    shared = join_by_size(halves, groups, ["half"])
    roles = shared.groupBy("k1", "first").agg(F.max(F.expr("own and sub")).alias("sub"), F.max(F.expr("own and mixed")).alias("long"), F.max(F.expr("not own and mixed")).alias("short"))
    roles = materialize(roles.where("sub or long or short"))
    # By place: of each line only the first occurrence is joined, whatever the number of the others.
    lines = join_by_size(rows.select("k1", F.struct("doc_id", "pos").alias("first"), "line"), roles, ["k1", "first"])
    lines = lines.groupBy("first").agg(F.min(F.struct("line", "sub", "long", "short")).alias("x"))  # rows that repeat an id
    lines = materialize(lines.select("first", "x.*"))

    gone = near_lines(lines).select(F.col("first").alias("gone"))
    return classes.join(gone, F.col("first") == F.col("gone"), "left_anti").select("first.doc_id", "first.pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near_chars: int = 16) -> DataFrame:
    """docs with the text's repeated lines removed, and n_lines and n_removed (long) added.

    Lines are what \\n separates. A line goes if an earlier one, by (doc_id, position) over the
    whole table, is equal, or is within one edit and either has min_near_chars code points or
    more; whether the earlier line itself goes makes no difference. Lines of white space only
    always stay. A null text stays null; an empty one empty; a document whose lines all go
    has an empty text. Rows that repeat a doc_id count as one document and fare alike; a
    null doc_id sorts first. Columns of docs named n_lines or n_removed are replaced.
    """
    rows = docs.drop("n_lines", "n_removed")
    kept_id, kept_pos, lines, stay = (unused(name, rows) for name in ("_kept_id", "_kept", "_lines", "_stay"))
    kept = kept_lines(docs, id_col, text_col, min_near_chars).groupBy(F.col("doc_id").alias(kept_id)).agg(F.collect_list("pos").alias(kept_pos))
    joined = rows.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left")
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    stays = F.filter(F.col(lines), lambda x, i: blank(x) | F.coalesce(F.array_contains(kept_pos, i), F.lit(False)))
    joined = joined.withColumn(lines, F.explode(F.array(F.split(F.coalesce(text_col, F.lit("")), "\n")))).withColumn(stay, F.explode(F.array(stays)))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(stay, "\n")).alias(text_col)
    out = [text if c == text_col else F.col(c) for c in rows.columns]
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(stay)).cast("long").alias("n_removed"))


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
c AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
h AS (
  SELECT *, m // 2 AS a FROM (SELECT *, n AS m FROM c UNION ALL SELECT *, n + 1 FROM c) WHERE n >= 16),
k AS (SELECT *, 0 AS side, left(line, a) AS half FROM h UNION ALL SELECT *, 1, right(line, m - a) FROM h),
p AS (
  SELECT DISTINCT s.line AS x, t.line AS y, s.n AS nx, t.n AS ny, s.first AS fx, t.first AS fy
  FROM k s JOIN k t ON s.m = t.m AND s.side = t.side AND s.half = t.half AND s.n <= t.n AND s.line <> t.line
  WHERE t.n = t.m),
e AS (
  SELECT * FROM p WHERE CASE WHEN nx = ny
    THEN len(list_filter(range(1, nx + 1), lambda i: substring(x, i, 1) <> substring(y, i, 1))) <= 1
    ELSE len(list_filter(range(0, nx + 1), lambda i: left(x, i) = left(y, i) AND substring(x, i + 1) = substring(y, i + 2))) > 0 END),
gone AS (SELECT y AS line FROM e WHERE fx < fy UNION SELECT x FROM e WHERE fy < fx),
kept AS (SELECT first[1] AS doc_id, first[2] AS pos FROM c WHERE line NOT IN (SELECT line FROM gone)),
m AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.pos IS NULL AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE k.pos IS NOT NULL OR NOT regexp_matches(line, '[^\x20\x09-\x0D]')), '') AS text
  FROM l LEFT JOIN kept k ON l.doc_id = k.doc_id AND l.pos = k.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN m.text END AS text, n_lines, n_removed FROM documents d JOIN m ON d.doc_id = m.doc_id
"""
