import pytest
from pyspark.sql import functions as F

from quadloom.functions.terms import Term, bnode, defragment, iri, literal, parse_id, skolemize, term_key, term_of_id, triple_term
from quadloom.functions.vocab import DEFAULT_PREFIXES, RDF, XSD, ClosedNamespace, Prefixes, split_iri

SOME = [
    iri("http://e/a"), bnode("x1"), literal("a"), literal('q"\\\n\t\r'), literal("hi", lang="EN"), literal("hi", lang="ar", dir="rtl"), literal(5), literal(True), literal(2.5),
    literal("05", XSD.integer), literal("x", XSD.integer), literal("1.50", XSD.decimal), literal("1e3", XSD.double), literal("1.5", XSD.double), literal("é😀"), literal(""),
    triple_term(iri("http://e/a"), iri("http://e/p"), triple_term(bnode("b"), iri("http://e/q"), literal('"@en'))),
]


@pytest.mark.parametrize("t", SOME, ids=str)
def test_id_round_trip(t):
    assert parse_id(t.id) == t
    assert parse_id(t.line) == t


def test_columns_agree_with_the_driver(spark):
    rows = spark.createDataFrame([(t.id,) for t in SOME], "id string").select("id", term_of_id(F.col("id")).alias("t")).collect()
    for r in rows:
        t = parse_id(r["id"])
        want = t.row()
        assert tuple(r["t"])[:6] == want[:6], r["id"]
    assert spark.createDataFrame([(None,)], "id string").select(term_of_id(F.col("id")).alias("t")).first()["t"] is None


def test_construction():
    assert literal("a", lang="bad tag!").lang is None and literal("a", lang="en", dir="up").dir is None
    assert literal("a", lang="en").dt == RDF.langString
    assert iri("b", "http://e/a").lex == "http://e/b"
    for bad in ("a b", "<x>", "a\n"):
        with pytest.raises(ValueError):
            iri(bad)
    assert skolemize(bnode("b"), "http://e/").lex == "http://e/.well-known/genid/b"
    assert defragment(iri("http://e/a#f")) == (Term(1, "http://e/a"), "f")


def test_order():
    ts = [literal("b"), literal(10), literal(9), iri("http://e/a"), bnode("z")]
    assert [t.lex for t in sorted(ts, key=term_key)] == ["z", "http://e/a", "9", "10", "b"]


def test_prefixes():
    p = Prefixes({"ex": "http://e/", "exx": "http://e/x/"})
    assert p.qname("http://e/x/a") == "exx:a" and p.qname("http://e/a b") is None and p.expand("ex:q") == "http://e/q"
    p.bind("ex", "http://other/", override=False)
    assert p.namespace("ex") == "http://e/" and p.prefix("http://e/x/") == "exx" and p.prefix("http://none/") is None
    with pytest.raises(KeyError):
        p.expand("no:x")
    assert split_iri("http://e/a#b1") == ("http://e/a#", "b1") and split_iri("http://e/12a") == ("http://e/12", "a")
    c = ClosedNamespace("http://e/", "a b")
    assert c.a == "http://e/a"
    with pytest.raises(AttributeError):
        c.z
    assert set(DEFAULT_PREFIXES) == {"rdf", "rdfs", "xsd", "owl"}
