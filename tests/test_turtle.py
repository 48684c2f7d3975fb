"""Turtle documents against triples stated by hand."""

from quillion.sources import turtle
from quillion.sources.turtle import OWL, RDF, RDFS, XSD

EX = "http://ex.org/"
TEXT = r'''
@prefix ex: <http://ex.org/> . # a comment with "quotes" and a .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@base <http://ex.org/> .
ex:Cat a owl:Class ; rdfs:subClassOf ex:Animal, <Pet> ; ; rdfs:label "cat"@en, "Katze"@de-AT .
ex:eats a owl:ObjectProperty .
ex:tom ex:age 3 ; ex:weight 4.5 ; ex:big 1e3 ; ex:alive true ; ex:note """two "lines"
and a é \\ . end""" ; ex:typed "2020-01-01"^^ex:date ; ex:knows [ ex:name 'Jerry' ; ex:in ex:a.b ] .
ex:list ex:items ( 1 "two" ex:three ) ; ex:none () .
_:x ex:p _:y .
[ ex:only "blank" ] .
ex:a%20b\,c ex:p <#frag> .
ex:broken ex:p unknown:name . ex:after ex:p "ok" .
ex:cut ex:p "never closed
'''


def test_statements():
    got = turtle.Reader(TEXT, "d").triples()
    iri = lambda s, p, o: ("d", s, p, o, "iri", None, None)
    text = lambda s, p, o, kind=None, lang=None: ("d", s, p, o, "literal", kind, lang)
    ref = lambda s, p, o: ("d", s, p, o, "blank", None, None)
    e = lambda n: EX + n
    want = [
        iri(e("Cat"), f"{RDF}type", f"{OWL}Class"), iri(e("Cat"), f"{RDFS}subClassOf", e("Animal")), iri(e("Cat"), f"{RDFS}subClassOf", e("Pet")), text(e("Cat"), f"{RDFS}label", "cat", lang="en"), text(e("Cat"), f"{RDFS}label", "Katze", lang="de-at"),
        iri(e("eats"), f"{RDF}type", f"{OWL}ObjectProperty"), text(e("tom"), e("age"), "3", f"{XSD}integer"), text(e("tom"), e("weight"), "4.5", f"{XSD}decimal"), text(e("tom"), e("big"), "1e3", f"{XSD}double"),
        text(e("tom"), e("alive"), "true", f"{XSD}boolean"), text(e("tom"), e("note"), 'two "lines"\nand a é \\ . end'), text(e("tom"), e("typed"), "2020-01-01", e("date")), text("_:d.1", e("name"), "Jerry"), iri("_:d.1", e("in"), e("a.b")), ref(e("tom"), e("knows"), "_:d.1"),
        text("_:d.2", f"{RDF}first", "1", f"{XSD}integer"), ref("_:d.2", f"{RDF}rest", "_:d.3"), text("_:d.3", f"{RDF}first", "two"), ref("_:d.3", f"{RDF}rest", "_:d.4"), iri("_:d.4", f"{RDF}first", e("three")), iri("_:d.4", f"{RDF}rest", f"{RDF}nil"),
        ref(e("list"), e("items"), "_:d.2"), iri(e("list"), e("none"), f"{RDF}nil"), ref("_:d:x", e("p"), "_:d:y"), text("_:d.5", e("only"), "blank"), iri(e("a%20b,c"), e("p"), e("#frag")), text(e("after"), e("p"), "ok"),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tables_and_ontology(spark):
    docs = spark.createDataFrame([("d", TEXT, 1), ("e", "@prefix : <http://ex.org/> . :Dog a <http://www.w3.org/2002/07/owl#Class> . _:x :p _:x .", 1), ("none", None, 1), ("empty", "", 1), ("junk", "}{ ???", 1)], "id string, content string, subject int")
    rows = turtle.turtle(docs)
    assert {r.document for r in rows.select("document").distinct().collect()} == {"d", "e"}
    assert {r.subject for r in rows.where("subject like '\\_:%x'").collect()} == {"_:d:x", "_:e:x"}
    nodes, edges = turtle.ontology(rows)
    assert sorted((r.label, r.kind) for r in nodes.collect()) == [("Cat", "class"), ("Dog", "class"), ("eats", "property")]
    assert sorted((r.source_node_id, r.target_node_id) for r in edges.collect()) == [(EX + "Cat", EX + "Animal"), (EX + "Cat", EX + "Pet")]
    assert turtle.turtle(docs.limit(0)).count() == 0
