"""Queries against their SQL on odd texts."""

import duckdb
import pytest

from quillion.plans import registry

SENTENCES = [
    "0. 1 one. 2 two! 33 three?\n4 four.  5 five.\n 6 six \n7. 77. 8 x",
    "no end", "", None, "a. \x0bb! \x01c\x01d", "\n\n. ! ?", "e. f.  g", "1 a\n 1 b \n  2 c  ", "h.\x0bi",
]
NAMES = [
    "Lichteie Lichteie Lichteie\nZugeü and", "éAlpha Beta Gamma Delta", "Alpha Beta GammaX Delta Eta Theta Iota", "Alpha\x0bBeta Gamma Delta",
    '"Alpha Beta Gamma" and Alpha Beta Gamma', '"tag" #tag #Tag #größe #a', "", None, "Alpha Beta", " ".join(["Alpha"] * 20_000) + " Beta", "1Alpha Beta Gamma Delta_",
]


def same_as_sql(spark, folder, name, texts):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(folder)).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize(("name", "texts"), [("sentence_stats", SENTENCES), ("quick_entities", NAMES)])
def test_odd_texts(spark, tmp_path, name, texts):
    same_as_sql(spark, tmp_path, name, texts)


def test_a_group_over_its_budget_is_cut_before_one_task_has_it(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillion.operators import relations

    frame = spark.range(4000).repartition(8).select(F.col("id"), (F.col("id") % 2).alias("g"), F.when(F.col("id") == 3985, 999).otherwise(F.col("id") % 7).alias("size"))
    frame.write.parquet(str(tmp_path / "t"))
    got = relations.budget_pack(spark.read.parquet(str(tmp_path / "t")), 50, F.col("size"), [F.desc("id")], "g", least=0)
    want = []
    for g in (0, 1):
        used = 0
        for i in range(3998 + g, -1, -2):
            used += 999 if i == 3985 else i % 7  # the large one keeps those after it in other partitions out
            if used > 50:
                break
            want.append((i, used))
    assert sorted((r.id, r.used) for r in got.collect()) == sorted(want)
    # The last window's input: a few rows of each of the parts, not the group.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "_part" in plan
