"""A boolean text query language, compiled to one Column.

Grammar: OR, then AND or adjacency, then NOT, then parentheses, "phrases", field:term, and
term~N. Operators are upper case.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions.vector import cosine

LEXER = re.compile(r'\s*(?:(\()|(\))|(AND\b)|(OR\b)|(NOT\b)|"([^"]*)"|~(\d+)|(\w+):|([^\s()"~]+))')
NAMES = (None, "(", ")", "AND", "OR", "NOT", "PHRASE", "NEAR", "FIELD", "TERM")


class QuerySyntaxError(ValueError):
    """A query text that the grammar doesn't take."""


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    near: int | None = None


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Many:
    op: str
    children: tuple


def lex(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXER.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at:]!r}")
        kind = next(i for i in range(1, 10) if m[i] is not None)
        found.append((NAMES[kind], m[kind]))
        at = m.end()
    return found


def parse(text: str, strict: bool = False):
    """The query's tree, None for an empty text. strict allows one adjacency at each level only."""
    items = lex(text)
    at = 0

    def peek() -> str | None:
        return items[at][0] if at < len(items) else None

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return items[at - 1]

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Many("OR", tuple(parts))

    def both():
        parts, adjacent = [negated()], 0
        while peek() in ("AND", "NOT", "(", "PHRASE", "FIELD", "TERM"):
            if peek() == "AND":
                take()
            else:
                adjacent += 1
                if strict and adjacent > 1:
                    raise QuerySyntaxError("more than two adjacent terms")
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Many("AND", tuple(parts))

    def negated():
        if peek() == "NOT":
            take()
            return Not(negated())
        return leaf()

    def leaf():
        kind = peek()
        if kind is None:
            raise QuerySyntaxError("the query ends too early")
        kind, value = take()
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise QuerySyntaxError("a parenthesis isn't closed")
            take()
            return inner
        if kind == "FIELD":
            if peek() not in ("TERM", "PHRASE"):
                raise QuerySyntaxError(f"field {value!r} has no term")
            return Term(take()[1], field=value)
        if kind in ("TERM", "PHRASE"):
            if peek() == "NEAR":
                return Term(value, near=int(take()[1]))
            return Term(value)
        raise QuerySyntaxError(f"unexpected {value!r}")

    if not items:
        return None
    tree = either()
    if at < len(items):
        raise QuerySyntaxError(f"unexpected {items[at][1]!r}")
    return tree


def body(columns: list[str]) -> Column:
    """The searched text: content, or the summary where that is empty, lower-cased."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("content", "summary") if c in columns]
    return F.lower(F.coalesce(*parts, F.lit("")))


def compile_tree(tree, columns: list[str], proximity: str = "occurs") -> Column:
    """One Column for the tree. proximity "words" asks for all of a near-term's words within N words of the first."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Not):
        return ~compile_tree(tree.child, columns, proximity)
    if isinstance(tree, Many):
        return functools.reduce(operator.and_ if tree.op == "AND" else operator.or_, [compile_tree(c, columns, proximity) for c in tree.children])
    text = F.lower(F.coalesce(F.col(tree.field).cast("string"), F.lit(""))) if tree.field in columns else body(columns)
    if tree.near is not None and proximity == "words":
        words, wanted = F.split(text, r"\s+"), tree.text.lower().split()
        return F.exists(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["w"] == wanted[0]) & F.lit(True) & functools.reduce(operator.and_, [F.array_contains(F.slice(words, x["i"] + 1, tree.near + 1), w) for w in wanted]))
    return text.contains(tree.text.lower())


def search(df: DataFrame, query: str, strict: bool = False, proximity: str = "occurs") -> DataFrame:
    """Rows that satisfy the query."""
    return df.where(compile_tree(parse(query, strict), df.columns, proximity))


def positive_terms(tree) -> list[str]:
    """Texts of the terms outside NOT, in order."""
    if isinstance(tree, Term):
        return [tree.text]
    if isinstance(tree, Many):
        return [t for c in tree.children for t in positive_terms(c)]
    return []


def ranked_search(df: DataFrame, query: str, vector: list[float], embedding_col: str = "embedding", limit: int | None = None) -> DataFrame:
    """Matching rows by cosine to the vector of the query's positive terms; other lengths score 0."""
    score = cosine(F.col(embedding_col), F.array(*map(F.lit, vector)))
    out = search(df, query).withColumn("score", score).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit is not None else out


def synonym_variants(query: str, synonyms: dict[str, list[str]]) -> list[str]:
    """The query with each word in turn of its synonyms: all combinations up to five words, else one word at a time."""
    words = query.split()
    choices = [[w, *[s for s in synonyms.get(w.lower(), []) if s != w]] for w in words]
    if len(words) <= 5:
        return list(dict.fromkeys(" ".join(c) for c in itertools.product(*choices)))
    single = [" ".join([*words[:i], s, *words[i + 1 :]]) for i, c in enumerate(choices) for s in c[1:]]
    return list(dict.fromkeys([query, *single]))


def lexical_score(text: Column, query: str) -> Column:
    """3 for each quoted phrase and 1 for each word found; a word after a minus gives 0 altogether."""
    low = F.lower(text)
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"', " ", query).split()
    score = F.lit(0)
    for p in phrases:
        score = score + F.when(low.contains(p.lower()), 3).otherwise(0)
    for w in (w for w in rest if not w.startswith("-")):
        score = score + F.when(low.contains(w.lower()), 1).otherwise(0)
    banned = [low.contains(w[1:].lower()) for w in rest if w.startswith("-") and len(w) > 1]
    return F.when(functools.reduce(operator.or_, banned), 0).otherwise(score) if banned else score


def retrieval_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Macro precision, recall and F1, four decimals; a query with nothing expected counts its results as false.

    results and expected: (query, id), distinct.
    """
    hits = results.join(expected, ["query", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("tp"))
    each = results.groupBy("query").agg(F.count("*").alias("n")).join(expected.groupBy("query").agg(F.count("*").alias("m")), "query", "full").join(hits, "query", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "m"), F.lit(0.0))
    each = each.select(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))
    return each.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
