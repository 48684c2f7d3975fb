"""Predicates and filters over memory tables."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions.scoring import DAY

# Spans of named times, in days.
NAMED_SPANS = {"recent": 1, "last_week": 7, "last_month": 30, "last_3_months": 90, "last_year": 365}
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
RELATIVE_DAYS = {"today": 1, "yesterday": 2, "last week": 7, "this week": 7, "last month": 30, "this month": 30, "last year": 365, "this year": 365}


def readable(now: int) -> Column:
    """Active and not expired; expires_at 0 is never."""
    return F.col("is_active") & ~((F.col("expires_at") > 0) & (F.col("expires_at") < now))


def all_of(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts, F.lit(True))


def relative_bound(text: str, now: int) -> int | None:
    """The earliest time that a relative expression ("3d", "2w", "last month") takes in, or None."""
    text = text.strip().lower()
    if m := re.fullmatch(r"(\d+)([dwmy])", text):
        return now - int(m[1]) * UNIT_DAYS[m[2]] * DAY
    return now - RELATIVE_DAYS[text] * DAY if text in RELATIVE_DAYS else None


def named_bound(name: str, now: int) -> int | None:
    return now - NAMED_SPANS[name] * DAY if name in NAMED_SPANS else None


def time_range(df: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Rows created strictly within the bounds; without a time they fall out."""
    if after is not None:
        df = df.where(F.col("created_at") > after)
    return df.where(F.col("created_at") < before) if before is not None else df


def property_test(json: Column, name: str, op: str, value) -> Column:
    """A test of a JSON property; ordering compares numbers."""
    found = F.get_json_object(json, f"$.{name}")
    number = found.try_cast("double")
    tests = {"eq": lambda: found == str(value), "neq": lambda: found != str(value), "gt": lambda: number > value, "gte": lambda: number >= value, "lt": lambda: number < value, "lte": lambda: number <= value, "in": lambda: found.isin([str(v) for v in value])}
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(tests[op](), F.lit(False))


def all_properties(json: Column, wanted: dict) -> Column:
    """Whether a JSON object has all of the properties with these values; malformed text has none."""
    return functools.reduce(operator.and_, [property_test(json, k, "eq", v) for k, v in wanted.items()], F.lit(True))


def structured(df: DataFrame, labels: list[str] = (), edge_types: list[str] = (), after: int | None = None, before: int | None = None, properties: list[tuple[str, str, object]] = (), memory_types: list[str] = (), ids: list[str] = ()) -> Column:
    """The filter DSL as one condition; parts for columns that df lacks are ignored."""
    parts: list[Column] = []
    for values, names in ((labels, ("label", "node_type")), (edge_types, ("relation",)), (memory_types, ("memory_type",)), (ids, ("id",))):
        present = [F.col(n).isin(list(values)) for n in names if n in df.columns]
        if values and present:
            parts.append(functools.reduce(operator.or_, present))
    times = [F.col(n) for n in ("created_at", "updated_at") if n in df.columns]
    if times and after is not None:
        parts.append(functools.reduce(operator.or_, [t >= after for t in times]))
    if times and before is not None:
        parts.append(functools.reduce(operator.or_, [t <= before for t in times]))
    if "metadata_json" in df.columns:
        parts += [property_test(F.col("metadata_json"), *p) for p in properties]
    return all_of(parts)


def parse_filter(text: str) -> dict:
    """Read "node_labels:[A,B] edge_types:[x] temporal:{after:1,before:2} property_filters:{age>=3} memory_types:[..] entity_ids:[..]".

    Parts that can't be read are ignored.
    """
    found: dict = {}
    names = {"node_labels": "labels", "edge_types": "edge_types", "memory_types": "memory_types", "entity_ids": "ids"}
    for name, key in names.items():
        if m := re.search(rf"{name}:\[([^\]]*)\]", text):
            found[key] = [v.strip().strip("\"'") for v in m[1].split(",") if v.strip()]
    if m := re.search(r"temporal:\{([^}]*)\}", text):
        for bound, value in re.findall(r"(after|before)\s*:\s*(\d+)", m[1]):
            found[bound] = int(value)
    if m := re.search(r"property_filters:\{([^}]*)\}", text):
        ops = {"=": "eq", "!=": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
        found["properties"] = []
        for name, op, value in re.findall(r"(\w+)\s*(!=|>=|<=|=|>|<)\s*([^,]+)", m[1]):
            value = value.strip().strip("\"'")
            if ops[op] not in ("eq", "neq"):
                try:
                    value = float(value)
                except ValueError:
                    continue
            found["properties"].append((name, ops[op], value))
    return found


def bitemporal(valid_from: int | None = None, valid_to: int | None = None, invalid_from: int | None = None, invalid_to: int | None = None) -> Column:
    """Bounds on when an edge became valid and invalid; one never invalidated ends later than any lower bound."""
    parts = []
    if valid_from is not None:
        parts.append(F.col("valid_at") >= valid_from)
    if valid_to is not None:
        parts.append(F.col("valid_at") <= valid_to)
    if invalid_from is not None:
        parts.append((F.col("invalid_at") == 0) | (F.col("invalid_at") >= invalid_from))
    if invalid_to is not None:
        parts.append((F.col("invalid_at") != 0) & (F.col("invalid_at") <= invalid_to))
    return all_of(parts)


def pipeline_filter(df: DataFrame, now: int, min_confidence: float | None = None, max_age_hours: float | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """A pipeline's filter stage; confidence falls back on score, then relevance, then 1."""
    measures = [F.col(c) for c in ("confidence", "score", "relevance") if c in df.columns]
    if min_confidence is not None:
        df = df.where(F.coalesce(*measures, F.lit(1.0)) >= min_confidence)
    if max_age_hours is not None:
        df = df.where(F.col("created_at") >= now - int(max_age_hours * DAY / 24))
    if include:
        df = df.where(F.col("memory_type").isin(list(include)))
    return df.where(~F.col("memory_type").isin(list(exclude))) if exclude else df


def path_contexts(contexts: DataFrame, path: str) -> DataFrame:
    """Contexts that hold for a path: global ones and those whose path is a segment-wise prefix; the most specific first."""
    path = path.strip("/")
    own = F.regexp_replace("path", "^/+|/+$", "")
    holds = F.col("is_global") | (own == "") | (own == path) | F.lit(path).startswith(F.concat(own, F.lit("/")))
    return contexts.where(holds).orderBy(F.length(own).desc(), F.col("priority").desc())


def substring_search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold the query in one of the columns, regardless of case."""
    return df.where(functools.reduce(operator.or_, [F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False)) for c in columns]))


def ontology_issues(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """(id, severity, issue) of nodes: an undeclared type is an error, an undeclared property a warning.

    nodes: id, node_type, properties map; types: name, properties array, parent. Types take
    their ancestors' properties.
    """
    spark = nodes.sparkSession
    types.createOrReplaceTempView("_ontology_types")
    declared = spark.sql("""
        WITH RECURSIVE up(name, ancestor) AS (
          SELECT name, name FROM _ontology_types
          UNION ALL SELECT up.name, t.parent FROM up JOIN _ontology_types t ON up.ancestor = t.name WHERE t.parent IS NOT NULL)
        SELECT up.name AS node_type, flatten(collect_list(t.properties)) AS allowed
        FROM up JOIN _ontology_types t ON up.ancestor = t.name GROUP BY up.name""")
    joined = nodes.join(declared, "node_type", "left")
    unknown = F.array_except(F.map_keys("properties"), "allowed")
    errors = joined.where("allowed IS NULL").select("id", F.lit("error").alias("severity"), F.concat(F.lit("unknown type "), "node_type").alias("issue"))
    warnings = joined.where("allowed IS NOT NULL").select("id", F.explode(unknown).alias("p")).select("id", F.lit("warning").alias("severity"), F.concat(F.lit("unknown property "), "p").alias("issue"))
    return errors.unionByName(warnings)
