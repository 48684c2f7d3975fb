"""Turtle documents as triples, and ontologies as nodes and edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "document string, subject string, predicate string, object string, kind string, datatype string, lang string"
# Names of the RDF, XSD and OWL vocabularies.
RDF, XSD, OWL, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-·:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-·:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(s: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else PLAIN.get(m[3], m[3]), s)


class Reader:
    """One document's statements; one that can't be read is left out, up to its full stop."""

    def __init__(self, text: str, document: str):
        self.document, self.prefixes, self.base, self.fresh = document, {}, "", 0
        self.tokens = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                self.tokens.append(("bad", text[at]))
                at += 1
                continue
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.found = 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or values and token[1] not in values:
            raise ValueError(token)
        self.at += 1
        return token

    def triples(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            self.found = []
            try:
                self.statement()
                out += self.found
            except (ValueError, KeyError, OverflowError):
                while self.peek()[0] != "end" and self.take()[1] != ".":
                    pass
        return out

    def statement(self) -> None:
        kind, value = self.peek()
        if value in ("@prefix", "@base") or kind == "word" and value.lower() in ("prefix", "base"):
            self.take()
            if value.lower().endswith("prefix"):
                name = self.take()[1]
                self.prefixes[name.removesuffix(":")] = self.iri(self.take()[1])
            else:
                self.base = self.iri(self.take()[1])
            if value[0] == "@":
                self.take(".")
            return
        if value == "[":
            subject = self.properties()
            if self.peek()[1] != ".":
                self.predicates(subject)
        else:
            subject = self.term()[0]
            self.predicates(subject)
        self.take(".")

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            predicate = f"{RDF}type" if (kind, value) == ("word", "a") else self.resource(kind, value)
            self.emit(subject, predicate, self.term())
            while self.peek()[1] == ",":
                self.take()
                self.emit(subject, predicate, self.term())
            while self.peek()[1] == ";":
                self.take()
                more = self.peek()[1] not in (";", ".", "]")
                if more:
                    break
            else:
                return

    def emit(self, subject: str, predicate: str, value: tuple) -> None:
        self.found.append((self.document, subject, predicate, *value))

    def iri(self, token: str) -> str:
        inner = unescaped(token[1:-1])
        return inner if re.match(r"[A-Za-z][\w+.\-]*:", inner) else self.base + inner

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.document}.{self.fresh}"

    def resource(self, kind: str, value: str) -> str:
        if kind == "iri":
            return self.iri(value)
        if kind == "name":
            prefix, _, local = value.partition(":")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(value)

    def properties(self) -> str:
        """[ ... ]: a blank node with what is said of it."""
        self.take("[")
        node = self.blank()
        if self.peek()[1] != "]":
            self.predicates(node)
        self.take("]")
        return node

    def collection(self) -> str:
        """( ... ): a list of first and rest."""
        self.take("(")
        items = []
        while self.peek()[1] != ")":
            items.append(self.term())
        self.take(")")
        nodes = [self.blank() for _ in items]
        for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
            self.emit(node, f"{RDF}first", item)
            rest = (nodes[k + 1], "blank", None, None) if k + 1 < len(nodes) else (f"{RDF}nil", "iri", None, None)
            self.emit(node, f"{RDF}rest", rest)
        return nodes[0] if nodes else f"{RDF}nil"

    def term(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, lang)."""
        kind, value = self.peek()
        if value == "[":
            return self.properties(), "blank", None, None
        if value == "(":
            node = self.collection()
            return node, "iri" if node == f"{RDF}nil" else "blank", None, None
        self.take()
        if kind == "blank":
            return f"_:{self.document}:{value[2:]}", "blank", None, None
        if kind == "string":
            quotes = 3 if value[:3] in ('"""', "'''") else 1
            body = unescaped(value[quotes:-quotes])
            if self.peek()[0] == "lang":
                return body, "literal", None, self.take()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.take()
                return body, "literal", self.resource(*self.take()), None
            return body, "literal", None, None
        if kind == "number":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", f"{XSD}{name}", None
        if kind == "word" and value in ("true", "false"):
            return value, "literal", f"{XSD}boolean", None
        return self.resource(kind, value), "iri", None, None


def turtle(documents: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """SCHEMA rows of Turtle documents, each read whole: prefixes, bases, lists, blank nodes (of their document alone), typed and tagged literals.

    Null and empty documents give no rows; a statement that can't be read is left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for document, text in zip(part["document"], part["text"], strict=True):
                yield pd.DataFrame(Reader(text, document).triples(), columns=["document", "subject", "predicate", "object", "kind", "datatype", "lang"])

    rows = documents.select(F.col(id_col).cast("string").alias("document"), F.col(text_col).alias("text")).where("text is not null and document is not null")
    return rows.mapInPandas(read, SCHEMA)


def local(iri: Column) -> Column:
    """The part of a name after its last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)[#/]?$", 1)


def ontology(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of classes, properties and subclass relations: nodes (id, label, kind), edges (source_node_id, target_node_id, relation)."""
    kinds = {f"{OWL}Class": "class", f"{OWL}ObjectProperty": "property", f"{OWL}DatatypeProperty": "property"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("object"))
    typed = triples.where((F.col("predicate") == f"{RDF}type") & F.col("object").isin(list(kinds)))
    nodes = typed.groupBy(F.col("subject").alias("id")).agg(F.min(kind).alias("kind")).select("id", local(F.col("id")).alias("label"), "kind")
    below = triples.where((F.col("predicate") == f"{RDFS}subClassOf") & (F.col("kind") == "iri"))
    return nodes, below.select(F.col("subject").alias("source_node_id"), F.col("object").alias("target_node_id"), F.lit("subclass_of").alias("relation")).distinct()
