"""Exports, imports, backups and connectors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.schemas import SCHEMAS
from quillion.sources.catalog import matching


def export_memories(df: DataFrame, path: str, kind: str = "json", filters: dict | None = None) -> None:
    """Write memories as json, csv (nested values as JSON text) or markdown, with equality filters."""
    df = df.where(matching(df, filters or {}))
    if kind == "json":
        df.write.json(path)
    elif kind == "csv":
        flat_csv(df).write.csv(path, header=True, escape='"')
    elif kind == "markdown":
        title = F.concat(F.lit("## "), F.coalesce("memory_type", F.lit("memory")), F.lit(" "), F.col("id"))
        df.select(F.concat_ws("\n\n", title, F.coalesce("content", F.lit("")), F.lit("")).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def flat_csv(df: DataFrame) -> DataFrame:
    """Columns of nested types as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def import_memories(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Read memories that export_memories wrote, with the declared schema where the kind keeps columns."""
    schema = SCHEMAS["memory"]
    if kind == "json":
        return spark.read.schema(schema).json(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, escape='"', multiLine=True)
    if kind == "markdown":
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^## ")).alias("part")).where("trim(part) <> ''")
        head = F.regexp_extract("part", r"^(\S+) (\S+)\n", 0)
        return whole.select(F.regexp_extract("part", r"^(\S+) (\S+)", 2).alias("id"), F.regexp_extract("part", r"^(\S+)", 1).alias("memory_type"), F.trim(F.expr("substring(part, length(regexp_extract(part, '^[^\\n]*', 0)) + 1)")).alias("content")).where(head != "")
    raise ValueError(f"unknown kind {kind!r}")


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A workspace bundle: one Parquet folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def merge_import(current: DataFrame, incoming: DataFrame, strategy: str = "merge", key: str = "id") -> DataFrame:
    """The table after an import: merge and skip add rows of new keys; replace also takes the incoming row for a known key."""
    incoming = incoming.dropDuplicates([key])
    if strategy in ("merge", "skip"):
        return current.unionByName(incoming.join(current, key, "left_anti"), allowMissingColumns=True)
    if strategy == "replace":
        return current.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)
    raise ValueError(f"unknown strategy {strategy!r}")


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """All tables and a manifest with their schemas."""
    export_bundle(tables, path)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, schema string").write.mode("overwrite").json(f"{path}/_manifest.json.d")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup, by its manifest."""
    names = [r["name"] for r in spark.read.schema("name string, schema string").json(f"{path}/_manifest.json.d").collect()]  # one row for each table
    return {n: spark.read.parquet(f"{path}/{n}") for n in sorted(names)}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of connector events dropped into a folder, as a stream."""
    return spark.readStream.schema(SCHEMAS["connector_event"]).json(path)


def poll_all(sources: dict[str, DataFrame]) -> DataFrame:
    """The events of all registered sources with their names."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def org_sections(files: DataFrame, text_col: str = "value", keep: list[str] = ()) -> DataFrame:
    """Sections of org-mode texts: (position, level, title, tags, body), after the columns to keep of each text."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=\*+ )")
    rows = files.select(*keep, F.posexplode(parts).alias("position", "part")).where(F.col("part").rlike(r"^\*+ "))
    head = F.regexp_extract("part", r"^(\*+) ([^\n]*)", 2)
    return rows.select(
        *keep,
        "position",
        F.length(F.regexp_extract("part", r"^(\*+) ", 1)).alias("level"),
        F.trim(F.regexp_replace(head, r"\s+(:[\w@:]+:)\s*$", "")).alias("title"),
        F.filter(F.split(F.regexp_extract(head, r"\s(:[\w@:]+:)\s*$", 1), ":"), lambda t: t != "").alias("tags"),
        F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"),
    )


def rss_items(pages: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Items of RSS texts: (title, link, body)."""
    item = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    rows = pages.select(F.explode(F.regexp_extract_all(xml_col, F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0))).alias("item"))
    return rows.select(item("title").alias("title"), item("link").alias("link"), item("description").alias("body"))


def triples(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Subject, predicate and object of N-Triples lines; other lines are left out."""
    form = r'^\s*<([^>]+)>\s+<([^>]+)>\s+(?:<([^>]+)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.'
    rows = lines.where(F.col(text_col).rlike(form))
    part = lambda g: F.regexp_extract(text_col, form, g)
    return rows.select(part(1).alias("subject"), part(2).alias("predicate"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("object"))
