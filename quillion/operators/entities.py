"""Entity extraction, resolution and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators.graph import components

ENTITY = "array<struct<type:string,name:string>>"
# Words that name technologies, company forms, and capitals that name nothing.
TECHNOLOGIES = """
python rust react node java docker linux swift kotlin scala elixir clojure haskell typescript javascript ruby php go c
postgresql mysql mongodb redis nginx apache tensorflow pytorch keras pandas numpy kubernetes terraform ansible jenkins
gitlab bitcoin ethereum solana polkadot cosmos openai anthropic meta google apple amazon microsoft slack discord notion
figma vercel netlify
""".split()
COMPANY_FORMS = "Inc Corp LLC Ltd GmbH Co Company Corporation Limited Technologies Labs Systems Group".split()
NOT_NAMES = """
The And For With This That From Have Been Was Are Has Had Not But Its His Her She They Will Would Could Should There Their
About Which When Where What Into Over New
""".split()
NOT_ACRONYMS = "THE AND FOR NOT BUT ITS OUT ARE HAS HAD CAN ALL ANY NEW OLD BIG TOP".split()


def heuristic_entities(body: Column) -> Column:
    """Entities by form: companies, people, acronyms and technologies; the first of a name wins."""
    def named(pattern: str, kind: str) -> Column:
        return text.matched_structs(body, pattern, kind)

    companies = named(rf"\b[A-Z][A-Za-z0-9]+ (?:{'|'.join(COMPANY_FORMS)})\b", "company")
    people = F.filter(named(r"\b[A-Z][a-z]{2,} [A-Z][a-z]+\b", "person"), lambda e: ~F.arrays_overlap(F.split(e["name"], " "), text.strings(NOT_NAMES + COMPANY_FORMS)))
    acronyms = F.filter(named(r"\b[A-Z][A-Z0-9]{1,5}\b", "acronym"), lambda e: ~e["name"].isin(NOT_ACRONYMS))
    technologies = F.filter(named(r"\b[A-Z][a-z]+\b", "technology"), lambda e: F.lower(e["name"]).isin(TECHNOLOGIES))
    return text.first_by_name(F.concat(companies, people, acronyms, technologies))


def mentions(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(id, type, name) of each row's entities."""
    found = F.concat(heuristic_entities(F.col(text_col)), text.quick_entities(F.col(text_col)))
    return df.select("id", F.explode(text.first_by_name(found)).alias("e")).select("id", "e.*")


def keys_of(entities: DataFrame) -> DataFrame:
    """(id, key): the normalised name and aliases of entities (id, name, aliases array)."""
    return entities.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n")).select("id", text.normalise_name(F.col("n")).alias("key")).where("key <> ''").distinct()


def resolve_exact(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id): the entity, the smallest id of several, whose name or alias a name equals when normalised."""
    known = keys_of(entities).groupBy("key").agg(F.min("id").alias("id"))
    return names.withColumn("key", text.normalise_name(F.col("name"))).join(known, "key", "left").drop("key")


def duplicate_pairs(entities: DataFrame, least: float = 0.85, n: int = 3) -> DataFrame:
    """(a, b, likeness): entities with equal normalised names (1), and names whose character n-grams overlap (Jaccard) by `least` or more.

    Names are compared, not entities: the smallest id stands for its normalised name, and the
    others of the name are linked to it. Prefix filtering: a pair that reaches the bound shares
    one of its rarest n-grams, so names meet on those only and no pair is missed.
    """
    keyed = entities.select("id", text.normalise_name(F.col("name")).alias("key")).where("key <> ''")
    names = keyed.groupBy("key").agg(F.min("id").alias("first"))
    copies = keyed.join(names, "key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness")).distinct()
    spread = names.select("first", F.explode(text.shingles(F.col("key"), n)).alias("gram"))
    counts = spread.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = spread.join(counts, "gram").groupBy("first").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("g"))
    size = F.size("g")
    # The margin covers rounding of the product; the likeness decides.
    met = ordered.select("first", "g", F.explode(F.slice("g", F.lit(1), size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1)).alias("gram"))
    x, y = met.alias("x"), met.alias("y")
    close = F.least(F.size("x.g"), F.size("y.g")) >= F.lit(least) * F.greatest(F.size("x.g"), F.size("y.g")) - 1e-9
    pairs = x.join(y, F.col("x.gram") == F.col("y.gram")).where((F.col("x.first") < F.col("y.first")) & close)
    pairs = pairs.select(F.col("x.first").alias("a"), F.col("y.first").alias("b"), text.jaccard(F.col("x.g"), F.col("y.g")).alias("likeness"))
    return pairs.where(F.col("likeness") >= least).distinct().unionByName(copies)


def canonical_ids(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, canonical_id): the smallest id that pairs connect."""
    edges = pairs.select(F.col("a").alias("source_node_id"), F.col("b").alias("target_node_id"))
    return entities.select("id").join(components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("canonical_id"))


def merge_entities(entities: DataFrame, edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after merging: aliases united, counts summed, first and last times widened, the longest description, edges turned to the kept ids."""
    joined = entities.join(canonical, "id")
    merged = joined.groupBy(F.col("canonical_id").alias("id")).agg(
        F.min_by("name", "id").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("aliases"),
        F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("description", F.struct(F.length("description"), "id")).alias("description"),
    )
    end = lambda c: canonical.select(F.col("id").alias(c), F.col("canonical_id").alias(f"_{c}"))
    turned = edges.join(end("source_node_id"), "source_node_id", "left").join(end("target_node_id"), "target_node_id", "left")
    turned = turned.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("source_node_id", "target_node_id") else F.col(c) for c in edges.columns]).where("source_node_id <> target_node_id")
    return merged, turned
