"""Personal data: patterns and information-theoretic sanitisation, with DataFrame functions only.

Patterns find protected entities (e-mail and IP addresses, card and phone numbers). Terms near
them can give them away as well: how much a term t tells of an entity e is its pointwise
mutual information, estimated from the corpus, against the information content of e,

    PMI(e; t) = log2(P(t | e) / P(t)),    IC(e) = log2(N / n_e),

where P(t | e) is the share of e's distinct contexts that hold t and P(t) the share of all
documents that hold t. Contexts are windows of words; copies of a document give one context,
so that they are no evidence. Terms with PMI of a share alpha of IC or more, in at least
min_support contexts, are spans of their own wherever they occur: a name that tells an address
tells it in a document without the address, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.common import bind, join_by_size, materialize

#: Kinds in listed order with their patterns. Quantifiers are possessive wherever that matches
#: the same text, and runs start at their first character, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
KINDS = [*PATTERNS, "term"]
SPAN_TYPE = "struct<start:int,kind:int,end:int,value:string>"
SPAN = f"array<{SPAN_TYPE}>"
RUN, PIECE = 256, 4096
TERM = r"\p{L}+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array<kind> that step(state, item) -> struct<state, out> gives item by item; a null out gives nothing.

    Items are folded in blocks of RUN, whose arrays are joined at the end: adding to one array
    would copy it for each item.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        more = lambda x: F.struct(x["state"].alias("state"), F.when(x["out"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(x["out"]))).alias("out"))
        return bind(step(acc["state"], item), more)

    def block(acc: Column, number: Column) -> Column:
        inner = F.aggregate(F.slice(items, number * RUN + 1, F.lit(RUN)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["outs"], F.array(x["out"])).alias("outs")))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    return F.aggregate(blocks, first, block, lambda acc: F.flatten(acc["outs"]))


def found_spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's matches: places come from the lengths of what lies between them."""

    def place(parts: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            start = at + F.length(x["p"])
            end = start + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
            return F.struct(end.alias("state"), F.when(x["m"].isNotNull(), span).alias("out"))

        return folded(F.arrays_zip(parts["p"], parts["m"]), F.lit(0), SPAN_TYPE, step)

    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return bind(parts, place)


def checked(kind: str):
    return lambda s: valid(kind, s["value"])


def of_kind(number: int):
    return lambda s: s["kind"] == number


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start, then kind, then end."""
    each = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        maybe = text.rlike(pattern)
        if kind in NEEDED:
            maybe = text.contains(NEEDED[kind]) & maybe
        spans = F.filter(found_spans(text, pattern, number), checked(kind))
        each.append(F.when(maybe, spans).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*each))


def nearest_words(side: Callable[[int | None], Column], reached: Callable[[int], Column], window: int, left: bool) -> Column:
    """The `window` words next to a place. side(r) is its text of r characters (None: all), reached(r) whether that is all.

    A reach is enough if it holds more words than the window (the farthest may be cut), so the
    longer ones are read only where words or white space are that long.
    """

    def words(r: int | None) -> Column:
        return F.split(F.trim(F.regexp_replace(side(r), r"\s+", " ")), " ")

    def taken(all_words: Column) -> Column:
        return F.slice(F.reverse(all_words), 1, window) if left else F.slice(all_words, 1, window)

    out = taken(words(None))
    for r in (PIECE, 160):
        out = F.when(reached(r) | (F.size(words(r)) > window), taken(words(r))).otherwise(out)
    return out


def context(text: Column, pieces: Column, s: Column, window: int) -> Column:
    """struct<entity, terms> of one span; pieces: the text in pieces of PIECE characters, of which it reads the nearest."""
    start, end = s["start"], s["end"]

    def before(r: int | None) -> Column:
        if r is None:
            return text.substr(F.lit(1), start)
        k = F.floor(start / PIECE).cast("int")
        near = F.concat(F.coalesce(F.get(pieces, k - 1), F.lit("")), F.coalesce(F.get(pieces, k), F.lit("")))
        at = start - F.greatest(k - 1, F.lit(0)) * PIECE
        low = F.greatest(at - r, F.lit(0))
        return near.substr(low + 1, at - low)

    def after(r: int | None) -> Column:
        if r is None:
            return text.substr(end + 1, F.length(text))
        k = F.floor(end / PIECE).cast("int")
        near = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
        return near.substr(end - k * PIECE + 1, F.lit(r))

    left = nearest_words(before, lambda r: start <= r, window, left=True)
    right = nearest_words(after, lambda r: F.length(text) - end <= r, window, left=False)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", left, right)), F.lit(TERM), F.lit(0))))
    return F.struct(F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"])).alias("entity"), terms.alias("terms"))


def in_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, entity, terms) of each pattern span: the terms among the `window` words on either side."""
    text = F.col("text")
    found = bind(in_pieces(text), lambda pieces: F.transform(base_spans(text), lambda s: context(text, pieces, s, window)))
    return docs.where(sign_of_data(text)).select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def sign_of_data(text: Column) -> Column:
    """Whether a text may hold a pattern's match: an at sign, a plus sign or a digit."""
    return text.rlike("[@+0-9]")


def term_places(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, term) for each row of docs and each term of pairs that it holds."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    wanted = materialize(pairs.select("term").distinct())
    return join_by_size(words, wanted, ["term"], "left_semi")


def disclosing_terms(docs: DataFrame, found: DataFrame, alpha: float, min_support: int) -> tuple[DataFrame, DataFrame]:
    """(entity, term, pmi, ic) of the terms whose PMI with a protected entity is alpha * IC or more; (doc_id, term) of the rows that hold one.

    docs: (doc_id, text); found: contexts(). Statistics are over all documents.
    """
    n = docs.count()
    distinct = found.select("entity", "terms").distinct()
    of_entity = distinct.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support)
    pairs = distinct.select("entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= min_support).join(of_entity, "entity")
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))

    def pmi(n_t: str) -> Column:
        return F.log2((F.col("n_te") / F.col("n_e")) / (F.greatest(n_t, F.lit(1)) / F.lit(float(n))))

    # A term is in as many documents as have it in a context, at least: what that rules out isn't counted in the corpus.
    in_contexts = found.select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("doc_id").alias("n_low"))
    pairs = materialize(pairs.join(in_contexts, "term").where(pmi("n_low") >= alpha * ic).drop("n_low"))
    # So it is with the documents of any kind; those with a sign of an address or number are few.
    few = term_places(docs.where(F.col("text").contains("@") | F.col("text").contains("+")), pairs).groupBy("term").agg(F.count("*").alias("n_low"))
    pairs = materialize(pairs.join(few, "term", "left").where(pmi("n_low") >= alpha * ic).drop("n_low"))
    places = materialize(term_places(docs, pairs))
    in_corpus = places.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(in_corpus, "term").select("entity", "term", pmi("n_t").alias("pmi"), ic.alias("ic"))
    scored = materialize(scored.where(F.col("pmi") >= alpha * F.col("ic")))
    return scored, join_by_size(places, materialize(scored.select("term").distinct()), ["term"], "left_semi")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.8, min_support: int = 2, window: int = 5) -> DataFrame:
    """(doc_id, text, spans): every row's spans, array<struct<start, kind, end, value>>, by start, then kind.

    kind numbers KINDS: email, ip, card, phone, term; offsets are code points, end exclusive.
    Null texts count as empty; empty ones have no spans. Repeated rows count as documents in
    the statistics, and each has its spans. An empty table gives no rows; other columns aren't
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = materialize(contexts(rows, window))
    _, places = disclosing_terms(rows, found, alpha, min_support)
    told = materialize(places.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("term").alias("_terms")))  # a document's terms
    size = told.agg(F.count("*"), F.coalesce(F.sum(F.size("_terms")), F.lit(0))).first()
    narrow = size[0] <= 200_000 and size[1] <= 1_000_000
    joined = rows.join(F.broadcast(told) if narrow else told, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    extra = F.filter(found_spans(F.col("text"), TERM, len(PATTERNS)), lambda s: F.array_contains("_terms", F.lower(s["value"])))
    extra = F.when(F.col("_terms").isNotNull() & F.col("text").rlike(TERM), extra).otherwise(F.array().cast(SPAN))
    return joined.select("doc_id", "text", F.sort_array(F.concat(base_spans(F.col("text")), extra)).alias("spans"))


def standing(spans: Column) -> Column:
    """The spans without those that start before the end of an earlier one that stands."""

    def step(at: Column, s: Column) -> Column:
        free = s["start"] >= at
        return F.struct(F.greatest(at, F.when(free, s["end"]).otherwise(at)).alias("state"), F.when(free, s).alias("out"))

    return folded(spans, F.lit(0), SPAN_TYPE, step)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands.

    The text is worked on in pieces of PIECE characters, since finding a place in a text takes
    time in proportion to its length.
    """
    name = lambda s: F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])

    def piece(spans: Column):
        def run(body: Column, number: Column) -> Column:
            low = number * PIECE
            high = low + F.length(body)
            mine = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < high))

            def parts(own: Column) -> Column:
                ends = F.concat(F.array(low), F.transform(own, lambda s: F.least(s["end"], high)))
                between = F.transform(own, lambda s, i: bind(F.greatest(F.get(ends, i), low), lambda at: F.concat(body.substr(at - low + 1, F.greatest(s["start"] - at, F.lit(0))), F.when(s["start"] >= low, name(s)).otherwise(F.lit("")))))
                last = F.element_at(ends, -1)
                return F.concat(F.array_join(between, ""), body.substr(last - low + 1, high - last))

            return bind(mine, parts)

        return run

    return bind(standing(spans), lambda kept: F.array_join(F.transform(in_pieces(text), piece(kept)), ""))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with personal data and disclosing terms generalised to their kind."""
    found = personal_data(docs, **options)
    return found.select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"))


def listed(spans: Column) -> Column:
    """The digest form kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_query(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
