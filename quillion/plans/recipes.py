"""Named search plans: a strategy, a re-ranker and a limit, applied as transforms in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.operators import search
from quillion.operators.graph import distance_scores

Reranker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Recipe:
    name: str
    strategy: str = "hybrid"
    reranker: str | None = None
    top_k: int = 10
    options: dict = field(default_factory=dict)


def _named(strategy: str, rerankers: list[str | None], k: int) -> list[Recipe]:
    return [Recipe("-".join([strategy, r] if r else [strategy]), strategy, r, k) for r in rerankers]


RECIPES: dict[str, Recipe] = {
    r.name: r
    for r in [
        *_named("hybrid", [None, "mmr", "cross-encoder", "node-distance", "fusion"], 10),
        *_named("semantic", [None, "mmr", "cross-encoder"], 10),
        *_named("keyword", [None, "cross-encoder"], 10),
        *_named("graph", [None, "node-distance"], 20),
        *_named("temporal", [None, "mmr"], 20),
        Recipe("broad", "hybrid", "mmr", 50),
        Recipe("precise", "hybrid", "cross-encoder", 5),
        Recipe("recent", "temporal", None, 10),
        Recipe("diverse", "semantic", "mmr", 20, {"lam": 0.5}),
    ]
}
RECIPE_ALIASES = {"default": "hybrid", "vector": "semantic", "bm25": "keyword", "text": "keyword", "kg": "graph", "time": "temporal", "wide": "broad", "exact": "precise", "latest": "recent"}


def resolve(name: str) -> Recipe | None:
    return RECIPES.get(RECIPE_ALIASES.get(name, name))


def mmr_reranker(k: int, lam: float = 0.7) -> Reranker:
    """Chosen rows first, in the order chosen."""
    return lambda df: search.mmr(df, k, lam).where("mmr_rank is not null").withColumn("score", 1 / F.col("mmr_rank")).drop("mmr_rank")


def node_distance_reranker(edges: DataFrame, sources: DataFrame, depth: int = 3, most: float = 5.0) -> Reranker:
    """Rows nearer to one of the query's nodes of the graph first."""
    return lambda df: distance_scores(df, edges, sources, depth, most)


def cross_encoder_reranker(scorer: Callable[[DataFrame], DataFrame]) -> Reranker:
    """An injected model: takes the rows, returns (id, score)."""
    return lambda df: df.drop("score").join(scorer(df), "id")


def fusion_reranker(parts: list[tuple[Reranker, float]]) -> Reranker:
    """Re-rankings blended by id: sum of weight / (1 + place)."""

    def run(df: DataFrame) -> DataFrame:
        ranked = [search.rrf(search.legs(one=r(df)), k=1).select("id", (F.col("score") * w).alias("score")) for r, w in parts]
        out = ranked[0]
        for other in ranked[1:]:
            out = out.unionByName(other)
        return df.drop("score").join(out.groupBy("id").agg(F.sum("score").alias("score")), "id")

    return run


def run(recipe: Recipe, strategies: dict[str, Callable[[int], DataFrame]], rerankers: dict[str, Reranker] | None = None) -> DataFrame:
    """The recipe's rows: its strategy with room to spare, its re-ranker if one is given, its limit."""
    rows = strategies[recipe.strategy](recipe.top_k * (4 if recipe.reranker else 1))
    if recipe.reranker and rerankers and recipe.reranker in rerankers:
        rows = rerankers[recipe.reranker](rows)
    return search.top(rows, recipe.top_k)
