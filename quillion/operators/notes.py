"""Notes: Markdown blocks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK_WORDS = "TODO DONE LATER NOW WAITING CANCELLED DOING".split()


def split_blocks(body: Column) -> Column:
    """Blocks of a note: code fences whole; elsewhere cut at blank lines, and headings, rules, list items and quotes on their own."""
    fenced = F.regexp_extract_all(F.concat(body, F.lit("\n")), F.lit(r"(?ms)^(?:```|~~~).*?^(?:```|~~~)[^\n]*\n|^[^\n]*\n"), F.lit(0))

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        code = line.rlike(r"^(?:```|~~~)")
        alone = code | bare.rlike(r"^(?:#{1,6} |---|\*\*\*|___|[-*] |> |\d+\. )")
        closed = F.when(F.trim(acc["open"]) != "", F.concat(acc["out"], F.array(F.rtrim(acc["open"])))).otherwise(acc["out"])
        empty = F.struct(closed.alias("out"), F.lit("").alias("open"))
        own = F.struct(F.concat(closed, F.array(F.regexp_replace(line, r"\s+$", ""))).alias("out"), F.lit("").alias("open"))
        more = F.struct(acc["out"].alias("out"), F.concat(acc["open"], line).alias("open"))
        return F.when(bare == "", empty).when(alone, own).otherwise(more)

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))
    return F.aggregate(fenced, first, step, lambda acc: F.when(F.trim(acc["open"]) != "", F.concat(acc["out"], F.array(F.rtrim(acc["open"])))).otherwise(acc["out"]))


def classify(block: Column) -> Column:
    """struct<type, level, state, indent, content> of a block."""
    bare = F.trim(block)
    tasks = "|".join(TASK_WORDS)
    indent = F.length(F.regexp_extract(block, r"^([ \t]*)", 1))
    make = lambda kind, content, level=F.lit(0), state=F.lit("none"): F.struct(F.lit(kind).alias("type"), level.alias("level"), state.alias("state"), indent.alias("indent"), F.trim(content).alias("content"))  # noqa: E731, B008
    heading, box, word = r"^(#{1,6}) (.*)$", r"^[-*] \[([ xX])\]\s*(.*)$", rf"(?s)^({tasks}) (.*)$"
    code = F.regexp_replace(F.regexp_replace(bare, r"^(?:```|~~~)[^\n]*\n?", ""), r"\n?(?:```|~~~)[^\n]*$", "")
    return (
        F.when(bare.rlike(heading), make("heading", F.regexp_extract(bare, heading, 2), F.length(F.regexp_extract(bare, heading, 1))))
        .when(bare.rlike(box), make("todo", F.regexp_extract(bare, box, 2), state=F.when(F.regexp_extract(bare, box, 1) == " ", "todo").otherwise("done")))
        .when(bare.rlike(word), make("todo", F.regexp_extract(bare, word, 2), state=F.lower(F.regexp_extract(bare, word, 1))))
        .when(bare.rlike(r"^[-*] "), make("list_item", F.substring(bare, F.lit(3), F.length(bare))))
        .when(bare.rlike(r"^\d+\. "), make("list_item", F.regexp_extract(bare, r"(?s)^\d+\. (.*)$", 1)))
        .when(bare.startswith("> "), make("quote", F.regexp_replace(bare, r"(?m)^> ?", "")))
        .when(bare.rlike("^(?:```|~~~)"), make("code_block", code))
        .when(bare.isin("---", "***", "___"), make("hr", F.lit("")))
        .otherwise(make("paragraph", bare))
    )


def note_blocks(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """(note_id, block_index, type, level, state, indent, content)."""
    rows = notes.select(F.col("id").alias("note_id"), F.posexplode(split_blocks(F.coalesce(text_col, F.lit("")))).alias("block_index", "b"))
    return rows.select("note_id", "block_index", classify(F.col("b")).alias("c")).select("note_id", "block_index", "c.*")
