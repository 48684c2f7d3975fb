"""Table registry: named tables, aliases, scans with typed filters, and views of the driver tables."""

from __future__ import annotations

import functools
import operator
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.schemas import SCHEMAS

# Other names of tables.
ALIASES = {"directory": "context_directory", "context_delta": "delta_pack"}
EPSILON = 2.220446049250313e-16


def equals(df: DataFrame, name: str, value) -> Column:
    """A typed equality: text for a boolean or number column is read as one; doubles match within epsilon.

    A column that df lacks, and text that can't be read, match nothing. The column is compared
    as it is, so that the comparison reaches the scan.
    """
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str):
            value = {"true": True, "false": False}.get(value.lower())
        return F.lit(False) if value is None else F.col(name) == F.lit(bool(value))
    if isinstance(kind, T.NumericType):
        try:
            number = Decimal(str(value))
        except (TypeError, InvalidOperation):
            return F.lit(False)
        if isinstance(kind, T.IntegralType):
            return F.col(name) == F.lit(int(number)) if number.is_finite() and number % 1 == 0 and abs(number) < 1 << 63 else F.lit(False)
        return F.col(name).between(float(number) - EPSILON, float(number) + EPSILON) if number.is_finite() else F.lit(False)
    return F.col(name) == F.lit(value)


def matching(df: DataFrame, filters: dict) -> Column:
    """All of the equalities."""
    return functools.reduce(operator.and_, [equals(df, k, v) for k, v in filters.items()], F.lit(True))


class Catalog:
    """Registered tables of one session; every registered table scans, whole, and lazily."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def load(self, name: str, path: str) -> DataFrame:
        """A table from Parquet with its declared schema; columns that files lack are null."""
        reader = self.spark.read.option("mergeSchema", "true")
        return self.register(name, (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(path))

    def table(self, name: str, workspace_id: str | None = None, filters: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        """Scan a registered table: workspace, typed equalities, projection. No row cap."""
        name = ALIASES.get(name, name)
        if name not in self.tables:
            raise KeyError(f"table {name!r} is not registered")
        df = self.tables[name]
        if workspace_id is not None and "workspace_id" in df.columns:
            df = df.where(F.col("workspace_id") == workspace_id)
        df = df.where(matching(df, filters or {}))
        return df.select(*columns) if columns else df

    def memories(self, workspace_id: str | None = None) -> DataFrame:
        """Active memories."""
        return self.table("memory", workspace_id).where("is_active")

    def messages(self, workspace_id: str) -> DataFrame:
        """Messages of a workspace's sessions; a message has no workspace of its own."""
        sessions = self.table("session", workspace_id, columns=["id"]).withColumnRenamed("id", "session_id")
        return self.table("message").join(sessions, "session_id", "left_semi")

    def edges(self, workspace_id: str | None = None, current: bool = False) -> DataFrame:
        """Edges with all their versions, or the open ones."""
        df = self.table("kg_edge", workspace_id)
        return df.where("invalid_at = 0") if current else df

    def permitted(self, df: DataFrame, account_id: str) -> DataFrame:
        """Rows of the workspaces that the account may use."""
        allowed = self.table("space_permission").where(F.col("account_id") == account_id).select("workspace_id").distinct()
        return df.join(allowed, "workspace_id", "left_semi")

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """SQL over the registered tables, with parameter markers."""
        return self.spark.sql(text, args=args)


#: The driver tables as memory tables. Each view is one SELECT that Spark and DuckDB both run.
MICROS_2024 = 1_704_067_200_000_000
VIEWS = {
    "memory": f"""
        SELECT CAST(doc_id AS VARCHAR(20)) AS id, lang AS workspace_id, source AS memory_type, text AS content, doc_id AS num,
          doc_id % 13 <> 0 AS is_active,
          CASE doc_id % 3 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' ELSE 'L2' END AS tier,
          {MICROS_2024} + (doc_id * 7919 % 2592000) * 1000000 AS created_at,
          {MICROS_2024} + (doc_id * 7919 % 2592000) * 1000000 + (doc_id % 11) * 86400000000 AS updated_at,
          CASE WHEN doc_id % 17 = 0 THEN {MICROS_2024} + (doc_id * 7919 % 2592000 + 432000) * 1000000 ELSE 0 END AS expires_at,
          doc_id * 31 % 60 AS access_count, CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS strength,
          CAST(doc_id * 53 % 100 AS DOUBLE) / 100 AS trust_score, CAST(doc_id * 71 % 100 AS DOUBLE) / 100 AS confidence,
          doc_id % 7 AS feedback_count, CASE WHEN doc_id % 5 = 0 THEN concat('u', CAST(doc_id % 3 AS VARCHAR(20))) ELSE '' END AS user_scope
        FROM documents""",
    "memory_tag": """
        SELECT CAST(doc_id AS VARCHAR(20)) AS memory_id, concat('t', CAST(doc_id % 4 AS VARCHAR(20))) AS name FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), concat('s', CAST(doc_id % 6 AS VARCHAR(20))) FROM documents""",
    "memory_feedback": """
        SELECT CAST(doc_id AS VARCHAR(20)) AS memory_id, concat('peer', CAST(doc_id % 9 AS VARCHAR(20))) AS peer_id, CASE WHEN quality = 1 THEN 5 ELSE 1 END AS score FROM labels
        UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), concat('peer', CAST(doc_id % 5 AS VARCHAR(20))), CASE WHEN toxic = 1 THEN 1 ELSE 4 END FROM labels""",
    "kg_node": """
        SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS id, 'customer' AS node_type, c_name AS label, c_mktsegment AS summary, c_custkey % 7 AS community_id FROM customer
        UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), 'nation', n_name, '', 0 FROM nation
        UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))), 'region', r_name, '', 1 FROM region
        UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), 'supplier', s_name, '', s_suppkey % 5 FROM supplier
        UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR(20))), 'part', p_name, p_type, 0 FROM part""",
    "kg_edge": """
        SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS source_node_id, concat('n', CAST(c_nationkey AS VARCHAR(20))) AS target_node_id, 'lives_in' AS relation, CAST(1 AS DOUBLE) AS weight FROM customer
        UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))), 'part_of', CAST(1 AS DOUBLE) FROM nation
        UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), concat('n', CAST(s_nationkey AS VARCHAR(20))), 'based_in', CAST(1 AS DOUBLE) FROM supplier""",
    "supply_edge": """
        SELECT concat('p', CAST(l_partkey AS VARCHAR(20))) AS source_node_id, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS target_node_id,
          CASE WHEN l_returnflag = 'R' THEN 'returned_to' ELSE 'supplied_by' END AS relation, CAST(count(*) AS DOUBLE) AS weight
        FROM lineitem GROUP BY 1, 2, 3""",
    "session_turn": "SELECT CAST(conv_id AS VARCHAR(20)) AS session_id, turn, role, text FROM conversations",
}


def driver_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the driver tables, or a driver table itself."""
    if name in VIEWS:
        for table in {w.strip(",()") for part in VIEWS[name].replace("\n", " ").split("FROM ")[1:] for w in part.split()[:1]}:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """DuckDB text of a query over views: WITH view AS (...), ... then the query, which may start with "WITH"."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{sql[14:]}"
    return f"WITH {views},\n{sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {views}\n{sql}"
