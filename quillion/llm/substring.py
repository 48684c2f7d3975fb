"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of a text's last 16 bytes is taken at each word's end, and the text is cut where it
is smallest within some run of WINDOW words. Cuts move with the content, an insertion changes the
chunks around it only, and any two equal passages of `least` words have two equal chunks in a row.

1. Two neighbouring chunks make one digest; digests that occur twice nominate their places. The
   first text that holds a digest is what the others are compared with: pairs that follow one
   another there and here make up a run, and a run of `least` words or more is repeated for sure.
2. Around the runs' ends, as far as a passage can reach beyond the chunks that it shares, here
   and in the first text, digests of `least` words are compared. So passages that share less
   than a whole run with the first text are found, and all ends are exact to the word.

Only digests and places are dealt between tasks, never texts; those that occur often are summed
before they are, and joined in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.llm.common import materialize, unused

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: One 16-bit gear value for each byte, by rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([c]), 7) & 0xFFFF for c in range(256)], np.uint16)
MIX = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 9
#: A passage's first words at which cuts may depend on what is before it (the hash sees 8 words at
#: most, and runs of WINDOW words begin outside), and its last ones; between must be three cuts.
BEFORE, AFTER = 8 + WINDOW - 1, WINDOW - 1
SHORTEST = BEFORE + 3 * WINDOW + AFTER
#: A part of a text about which it asks, a run of a text that is later than the first, one of the
#: first itself, and a place about which another text asks.
PART, LATER, FIRST, ASKED = range(4)
#: Keys of rows without an id lie below this number.
NO_ID = -(1 << 62)


def words_of(text: str | None) -> tuple[bytes, np.ndarray]:
    """The text's bytes with A-Z lower-cased and white space single, and the offset at which each word ends."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not data:
        return data, np.empty(0, np.int64)
    return data, np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))


def cuts(data: bytes, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Word numbers at which chunks start or end: 0, the content-defined ones, and the number of words.

    The gear hash h = 2 h + gear[byte] in 16 bits depends on the last 16 bytes; it is built by
    doubling the window four times. Of equal hashes in a run of words the last one cuts.
    """
    n = len(ends)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width) if len(h) > width else h[:0]
        h = longer
    at_ends = h[ends - 1]
    if n <= window:
        inner = np.array([n - 1 - int(at_ends[::-1].argmin())]) if n else np.empty(0, np.int64)
    else:
        view = np.lib.stride_tricks.sliding_window_view(at_ends, window)[:, ::-1]
        inner = np.arange(len(view)) + window - 1 - view.argmin(axis=1)
    return np.unique(np.concatenate(([0], inner + 1, [n])))


def pairs(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of each two neighbouring chunks, word numbers of the cuts)."""
    at = cuts(data, ends)
    starts = np.concatenate(([0], ends[:-1] + 1))
    low, high = starts[at[:-1]].tolist(), ends[at[1:] - 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    each = np.array([digest(data[s:e]) for s, e in zip(low, high, strict=True)], np.uint64)
    both = (each[:-1] * MIX) ^ ((each[1:] << np.uint64(31)) | (each[1:] >> np.uint64(33)))
    return both.view(np.int64), at


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): rows without an id have one from their text, below NO_ID."""
    text = F.col(text_col)
    own = F.lit(NO_ID) - F.pmod(F.xxhash64(text), F.lit(1 << 61))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), own).alias("id"), text.alias("text"))


def chunk_pairs(rows: DataFrame, least: int) -> DataFrame:
    """(key, id, at) of each pair of neighbouring chunks of the texts of `least` words or more.

    at: the pair's number in the text in 23 bits, its first word's in 26, its number of words in
    5, and the words of the chunks before and after in 4 each (texts of up to 67 million words).
    """
    names = ["key", "id", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            n_rows = 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, ends = words_of(text.as_py())
                if len(ends) < least:
                    continue
                if len(ends) >> 26:
                    raise ValueError(f"the text of {number} has over 67 million words")
                key, at = pairs(data, ends)
                size = np.concatenate(([0], np.diff(at), [0]))
                i = np.arange(len(key))
                parts.append([key, np.full(len(key), number), i << 39 | at[:-2] << 13 | (at[2:] - at[:-2]) << 8 | size[i] << 4 | size[i + 3]])
                n_rows += len(key)
                if n_rows > 50_000:
                    yield pack(parts)
                    parts, n_rows = [], 0
            if parts:
                yield pack(parts)

    def pack(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=names)

    return rows.mapInArrow(run, "key long, id long, at long")


def unpacked(at: str, name: str) -> list[Column]:
    """number, start, end, low and high of a pair's place: low and high bound a passage that has no chunk pair beyond it."""
    bits = lambda shift, n: F.shiftright(at, shift).bitwiseAND((1 << n) - 1).cast("int")
    start, size = bits(13, 26), bits(8, 5)
    before, after = bits(4, 4), bits(0, 4)  # 0: the text's first or last pair
    low, high = start - before - F.when(before > 0, BEFORE).otherwise(0), start + size + after + F.when(after > 0, AFTER - 1).otherwise(0)
    return [F.shiftright(at, 39).cast("int").alias(f"{name}i"), start.alias(f"{name}start"), (start + size).alias(f"{name}end"), low.alias(f"{name}low"), high.alias(f"{name}high")]


def regions(rows: DataFrame, least: int, within: bool) -> DataFrame:
    """(id, kind, start, end, low, high, of, ask): where texts are repeated for sure, and where that is to be found out.

    A run's pairs follow one another, and so do their places in the first text (`of`) that holds
    them: LATER and FIRST runs of `least` words are repeated as a whole (if another text follows
    FIRST there), from word `start` to `end`. Passages around and across runs lie from `low` to
    `high` of a PART, or of the place in the first text about which a run ASKED. Not `within`:
    pairs that one text alone holds are left out.
    """
    emitted = chunk_pairs(rows, least)
    # Numbers alone, so that they are summed in place before the shuffle. Of several places in the first text any will do.
    seen = emitted.groupBy("key").agg(F.count("*").alias("n") if within else F.max("id").alias("last"), F.min("id").alias("of"), F.min_by("at", "id").alias("of_at"))
    seen = seen.where("n > 1" if within else "of < last").select("key", "of", "of_at")
    repeats = emitted.join(seen, "key").select("id", *unpacked("at", ""), "of", *unpacked("of_at", "of_"))
    repeats = repeats.withColumn("shift", F.col("of_i") - F.col("i"))
    order = Window.partitionBy("id").orderBy("i", "start", "of", "shift")
    near = F.coalesce(F.col("i") - F.lag("i").over(order) <= 1, F.lit(False))
    follows = near & (F.col("of") == F.lag("of").over(order)) & (F.col("shift") == F.lag("shift").over(order))
    numbered = repeats.withColumn("part", F.sum((~near).cast("int")).over(order)).withColumn("run", F.sum((~follows).cast("int")).over(order))
    least_of, most_of = ("start", "low", "of_start"), ("end", "high", "of_end", "of", "shift")
    runs = numbered.groupBy("id", "part", "run").agg(*[F.min(c).alias(c) for c in least_of], *[F.max(c).alias(c) for c in most_of])
    part = Window.partitionBy("id", "part")
    runs = runs.withColumns({"part_low": F.min("low").over(part), "part_high": F.max("high").over(part), "n": F.count("*").over(part)}).where(F.col("part_high") - F.col("part_low") >= least)
    later, long = F.col("of") != F.col("id"), F.col("end") - F.col("start") >= least
    sure = long & (later | (F.col("shift") == 0))
    # A part that is one run from end to end, such as a copy of a text, asks nothing.
    ask = ~((F.col("n") == 1) & sure & (F.col("part_low") == F.col("start")) & (F.col("part_high") == F.col("end")))
    runs = materialize(runs.withColumns({"later": later, "sure": sure, "ask": ask}))
    none = F.lit(0)
    parts = runs.where("ask").groupBy("id", "part").agg(F.min("part_low").alias("low"), F.max("part_high").alias("high"))
    parts = parts.select("id", F.lit(PART).alias("kind"), none.alias("start"), none.alias("end"), "low", "high", F.col("id").alias("of"), F.lit(True).alias("ask"))
    mine = runs.where("sure").select("id", F.when(F.col("later"), LATER).otherwise(FIRST).alias("kind"), "start", "end", F.col("start").alias("low"), F.col("end").alias("high"), "of", "ask")
    # What is near the ends of a run is compared in the first text, too: its own runs may say nothing of it.
    asked = runs.where(F.col("later") & (F.col("high") - F.col("low") >= least)).groupBy("of", "of_start", "of_end").agg(F.max(F.col("start") - F.col("low")).alias("b"), F.max(F.col("high") - F.col("end")).alias("a"))
    asked = asked.select(F.col("of").alias("id"), F.lit(ASKED).alias("kind"), F.col("of_start").alias("start"), F.col("of_end").alias("end"), (F.col("of_start") - F.col("b")).alias("low"), (F.col("of_end") + F.col("a")).alias("high"), "of")
    return parts.union(mine).union(asked.withColumn("ask", (F.col("high") - F.col("low") > F.col("end") - F.col("start")) | (F.col("end") - F.col("start") < least)))


def window_starts(n: int, runs: list[dict], least: int) -> np.ndarray:
    """Word numbers at which `least` words are to be compared: of parts, but not inside runs that are sure, and of places asked about."""
    ask = np.zeros(n + 1, bool)
    for r in runs:
        if r["kind"] == PART:
            ask[max(0, r["low"]) : max(0, min(n, r["high"]) - least + 1)] = True
    for r in runs:
        if r["kind"] in (LATER, FIRST):
            ask[r["start"] : max(r["start"], r["end"] - least + 1)] = False
    for r in runs:
        if r["kind"] == ASKED:
            low, high = max(0, r["low"]), max(0, min(n, r["high"]) - least + 1)
            ask[low : min(r["start"], high)] = True
            ask[max(low, r["end"] - least + 1) : high] = True
    return np.flatnonzero(ask)


def spans_of(rows: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """(a, b, id, word): two digests of the `least` words from each word that the runs ask about."""
    names = ["a", "b", "id", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, number, word = [], [], [], []
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, ends = words_of(text.as_py())
                if len(ends) < least:
                    continue
                chosen = window_starts(len(ends), found.as_py(), least)
                first = np.where(chosen > 0, ends[chosen - 1] + 1, 0).tolist()
                both = [xxhash.xxh3_128_intdigest(data[s:e]) for s, e in zip(first, ends[chosen + least - 1].tolist(), strict=True)]
                a += [x >> 64 for x in both]
                b += [x & 0xFFFFFFFFFFFFFFFF for x in both]
                number += [key] * len(both)
                word += chosen.tolist()
            columns = [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(number, pa.int64()), pa.array(word, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    of_text = runs.where("ask").groupBy("id").agg(F.collect_list(F.struct("kind", "start", "end", "low", "high")).alias("runs"))  # one text's runs
    of_text = materialize(of_text)
    size = of_text.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    narrow = size[0] <= 200_000 and size[1] <= 1_000_000
    return rows.join(F.broadcast(of_text) if narrow else of_text, "id").select("id", "text", "runs").mapInArrow(run, "a long, b long, id long, word int")


def repeats_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, within: bool) -> DataFrame:
    """(id, start, end, first_id, across, later): words that are repeated, in runs of more than min_words.

    across: another text holds them; later: this is not their first place. Not `within`: those
    across texts alone.
    """
    least = min_words + 1
    if least < SHORTEST:
        raise ValueError(f"passages of {SHORTEST} words or more can be found")
    rows = keyed(docs, id_col, text_col)
    runs = regions(rows, least, within)
    sure = runs.where(F.col("kind").isin(LATER, ASKED) & (F.col("end") - F.col("start") >= least))
    sure = sure.select("id", "start", "end", F.col("of").alias("first_id"), F.lit(True).alias("across"), (F.col("kind") == LATER).alias("later"))
    spans = spans_of(rows, runs, least)
    place = F.struct("id", "word")
    seen = spans.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    found = spans.join(seen, ["a", "b"]).select("id", F.col("word").alias("start"), (F.col("word") + least).alias("end"), F.col("first.id").alias("first_id"), (F.col("first.id") != F.col("last.id")).alias("across"), (place != F.col("first")).alias("later"))
    return sure.union(found)


def united(found: DataFrame, *kept: Column) -> DataFrame:
    """(id, start_word, end_word, ...): found's (id, start, end) united where they overlap or touch."""
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("new").over(order))
    return rows.groupBy("id", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), *kept)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, within: bool = False) -> DataFrame:
    """Passages of over min_words words that occur in two documents or more; with `within`, twice in one as well.

    One row for each document and passage: (doc_id, start_word, end_word, n_words,
    first_doc_id), where words are runs other than ASCII white space, compared with A-Z
    lower-cased, end_word is exclusive, and first_doc_id is the smallest doc_id that holds a
    part of the passage (the row's own where it is the first). Passages that overlap or touch
    are one row; ends are exact to the word.

    Null and empty texts have no passages. Rows that repeat a doc_id count as one document;
    rows with a null doc_id are documents of their own, equal texts among them one, and their
    ids are null in both columns. An empty table gives no rows; other columns aren't read.
    """
    found = repeats_of(docs, id_col, text_col, min_words, within)
    runs = united(found if within else found.where("across"), F.min("first_id").alias("first"))
    known = lambda c: F.when(F.col(c) > NO_ID, F.col(c))
    return runs.select(known("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), known("first").alias("first_doc_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with every repeated passage left only at its first place, by (doc_id, word); same columns.

    Words that go take the white space after them along. Each word that goes stands at an
    earlier place in a passage of over min_words equal words. Rows that repeat a doc_id fare
    alike (they are one document here); of rows without an id, which come first, copies fare
    alike too. Null texts stay null; a text that is a copy of an earlier one is empty.
    """
    later = repeats_of(docs, id_col, text_col, min_words, within=True).where("later")
    gone = united(later).groupBy("id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("gone"))  # one text's passages
    key, spans = unused("_key", docs), unused("_gone", docs)
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) - F.pmod(F.xxhash64(text_col), F.lit(1 << 61))))
    rows = rows.join(gone.select(F.col("id").alias(key), F.col("gone").alias(spans)), key, "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [] if s is None else [(r["start_word"], r["end_word"]) for r in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(spans)))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and the white space after each span."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    space = np.isin(np.frombuffer(data, np.uint8), (9, 10, 11, 12, 13, 32))
    starts = np.append(np.flatnonzero(~space & np.concatenate(([True], space[:-1]))), len(data))
    out, at = [], 0
    for first, last in sorted(spans):
        out.append(data[at : starts[first]])
        at = int(starts[last])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def substring_query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
