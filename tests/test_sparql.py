import pytest

from quadloom.functions.library import UnsupportedFunction
from quadloom.functions.terms import iri, literal
from quadloom.plans.dataset import Dataset, Resource
from quadloom.plans.graphs import QuadGraph
from quadloom.sparql.ast import SparqlError
from quadloom.sparql.compiler import run_query
from quadloom.sparql.parser import parse_query, parse_update

PEOPLE = """ex:Alice a ex:Person ; ex:name "Alice" ; ex:age 30 ; ex:knows ex:Bob . ex:Bob a ex:Person ; ex:name "Bob" ; ex:age 25 ; ex:knows ex:Charlie .
ex:Charlie a ex:Person ; ex:name "Charlie" ; ex:age 35 ."""
P = "PREFIX ex: <http://example.org/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> "


@pytest.fixture(scope="module")
def people(graph):
    q = graph(PEOPLE).cache()
    return QuadGraph(q, is_set=True)


def solutions(g, text, **kw):
    r = run_query(g, P + text, **kw)
    if r.kind == "ASK":
        return r.truth()
    return sorted((tuple(row[v].lex.replace("http://example.org/", "") if v in row else None for v in r.vars) for row in r.rows()), key=repr)


CASES = [
    ("SELECT ?name { ?s ex:name ?name ; ex:age ?a FILTER(?a > 28) }", [("Alice",), ("Charlie",)]),
    ("SELECT ?name ?n { ?s ex:name ?name OPTIONAL { ?s ex:knows ?f . ?f ex:name ?n } }", [("Alice", "Bob"), ("Bob", "Charlie"), ("Charlie", None)]),
    ("SELECT ?s { { ?s ex:name 'Alice' } UNION { ?s ex:name 'Bob' } }", [("Alice",), ("Bob",)]),
    ("SELECT ?u { ?s ex:name ?n BIND(UCASE(?n) AS ?u) }", [("ALICE",), ("BOB",), ("CHARLIE",)]),
    ("SELECT ?n { ?s ex:name ?n FILTER(REGEX(?n, '^a', 'i')) }", [("Alice",)]),
    ("SELECT DISTINCT ?t { ?s a ?t }", [("Person",)]),
    ("SELECT ?n { ?s ex:name ?n } ORDER BY ?n OFFSET 1 LIMIT 1", [("Bob",)]),
    ("SELECT ?n { ?s ex:name ?n } LIMIT 0", []),
    ("SELECT ?s { ?s a ex:Person MINUS { ?s ex:knows ?z } }", [("Charlie",)]),
    ("SELECT ?s { ?s a ex:Person MINUS { ?q ex:knows ?z } }", [("Alice",), ("Bob",), ("Charlie",)]),
    ("SELECT ?s { ?s a ex:Person FILTER NOT EXISTS { ?s ex:knows ?z } }", [("Charlie",)]),
    ("SELECT ?s { ?s ex:age ?a FILTER EXISTS { ?s ex:knows ?o . ?o ex:age ?b FILTER(?b > ?a) } }", [("Bob",)]),
    ("SELECT ?s ?v { VALUES (?s ?v) { (ex:Alice 1) (UNDEF 2) } ?s ex:knows ?o }", [("Alice", "1"), ("Alice", "2"), ("Bob", "2")]),
    ("SELECT ?s { ?s ex:age ?a FILTER(?a / 0 > 1) }", []),
    ("SELECT ?s { ?s ex:age ?a FILTER(!(?zz = 1)) }", []),
    ("SELECT ?s { ?s ex:age ?a FILTER(?zz = 1 || ?a = 25) }", [("Bob",)]),
    ("SELECT ?s { ?s ex:age ?a FILTER(?a IN (25, 'x', 35.0)) }", [("Bob",), ("Charlie",)]),
    ("SELECT ?s { ?s ex:age ?a FILTER(?a NOT IN (25, 35)) }", [("Alice",)]),
    ("SELECT ?x { ?x ex:knows ?x }", []),
    ("SELECT ?s { ?s ex:knows _:b . _:b ex:age 35 }", [("Bob",)]),
    ("SELECT ?x { ex:Alice ex:knows+ ?x }", [("Bob",), ("Charlie",)]),
    ("SELECT ?x { ?x ex:knows+ ex:Charlie }", [("Alice",), ("Bob",)]),
    ("SELECT ?x { ex:Alice ex:knows* ?x }", [("Alice",), ("Bob",), ("Charlie",)]),
    ("SELECT ?x { ex:Alice ex:knows? ?x }", [("Alice",), ("Bob",)]),
    ("SELECT ?x ?y { ?x (ex:knows/ex:knows)|ex:nothing ?y }", [("Alice", "Charlie")]),
    ("SELECT ?x { ?x ^ex:knows ex:Bob }", [("Charlie",)]),
    ("SELECT ?o { ex:Alice !(ex:name|ex:age|rdf:type) ?o }", [("Bob",)]),
    ("SELECT ?o { ex:Bob !(^ex:nothing) ?o }", [("Alice",)]),
    ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?t) (AVG(?a) AS ?v) (MIN(?n0) AS ?lo) (MAX(?a) AS ?hi) (GROUP_CONCAT(?n0; SEPARATOR=',') AS ?g) { ?s ex:age ?a ; ex:name ?n0 }", [("3", "90", "30", "Alice", "35", "Alice,Bob,Charlie")]),
    ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?t) (AVG(?a) AS ?v) { ?s ex:none ?a }", [("0", "0", "0")]),
    ("SELECT (SUM(?o) AS ?t) { ex:Alice ?p ?o }", [(None,)]),
    ("SELECT ?b (COUNT(?s) AS ?n) { ?s ex:age ?a } GROUP BY (?a > 28 AS ?b) HAVING (COUNT(?s) > 1)", [("true", "2")]),
    ("SELECT (COUNT(DISTINCT ?t) AS ?n) { ?s a ?t }", [("1",)]),
    ("SELECT (STRLEN(GROUP_CONCAT(?n)) AS ?l) { ?s ex:name ?n }", [("17",)]),
    ("SELECT ?k (COUNT(*) AS ?n) { ?s ex:age ?k } GROUP BY ?k VALUES ?k { 25 }", [("25", "1")]),
    ("SELECT ?s ?k { ?s a ex:Person { SELECT ?s (COUNT(?o) AS ?k) { ?s ex:knows ?o } GROUP BY ?s } }", [("Alice", "1"), ("Bob", "1")]),
    ("SELECT ?a ?b { ?s ex:age ?a BIND(IF(?a > 28, 'old', 'young') AS ?b) FILTER(?b = 'young') }", [("25", "young")]),
    ("SELECT (1 AS ?x) {}", [("1",)]),
    ("SELECT ?x { { SELECT (2 AS ?x) {} } }", [("2",)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0] for c in CASES])
def test_query(people, text, want):
    assert solutions(people, text) == want


FUNCTIONS = [
    ("SUBSTR('hello', 2, 3)", "ell"), ("SUBSTR('hello', 0, 3)", "he"), ("SUBSTR('hello', 4)", "lo"), ("STRBEFORE('abc', 'b')", "a"), ("STRAFTER('abc', 'b')", "c"), ("STRAFTER('abc', 'z')", ""),
    ("CONCAT('a', 'b')", "ab"), ("ENCODE_FOR_URI('a b~*é')", "a%20b~%2A%C3%A9"), ("REPLACE('abc', '[bc]', 'x')", "axx"), ("STRLEN('a😀')", "2"), ("ABS(-3)", "3"), ("CEIL(1.2)", "2"),
    ("ROUND(-2.5)", "-3"), ("FLOOR(-1.5)", "-2"), ("1 + 2 * 3", "7"), ("7 / 2", "3.5"), ("1.0 + 1", "2"), ("-(-3)", "3"), ("STR(<http://x/>)", "http://x/"), ("LANG('a'@en)", "en"), ("LANG('a')", ""),
    ("DATATYPE(1.5)", "http://www.w3.org/2001/XMLSchema#decimal"), ("DATATYPE('a'@en)", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), ("LANGMATCHES('en-GB', 'en')", "true"),
    ("LANGMATCHES('', '*')", "false"), ("SAMETERM(1, 1.0)", "false"), ("1 = 1.0", "true"), ("'a' = 'a'@en", "false"), ("'b' > 'a'", "true"), ("YEAR('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "2011"),
    ("HOURS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "14"), ("SECONDS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "13.815"), ("TZ('2011-01-10T14:45:13-05:00'^^xsd:dateTime)", "-05:00"),
    ("TIMEZONE('2011-01-10T14:45:13-00:30'^^xsd:dateTime)", "-PT30M"), ("TIMEZONE('2011-01-10T14:45:13Z'^^xsd:dateTime)", "PT0S"), ("MD5('abc')", "900150983cd24fb0d6963f7d28e17f72"),
    ("xsd:integer('12')", "12"), ("xsd:integer('x')", None), ("xsd:integer(3.9)", "3"), ("xsd:double('1e2')", "100"), ("xsd:boolean('1')", "true"), ("xsd:boolean('yes')", None), ("xsd:string(5)", "5"), ("xsd:decimal('2.50')", "2.5"),
    ("xsd:double('1d')", None), ("IF(1 > 0, 'y', 'n')", "y"), ("COALESCE(1/0, 'z')", "z"), ("STRDT('5', xsd:integer)", "5"), ("STRLANG('a', 'EN')", "a"), ("STRLANG('a'@de, 'en')", None), ("ISNUMERIC('5'^^xsd:int)", "true"),
    ("ISNUMERIC('a')", "false"), ("ISIRI(<http://x/>)", "true"), ("BNODE('q')", "bnode_q"), ("IRI('http://y/')", "http://y/"), ("SUBJECT(<<( <http://a/> <http://b/> 5 )>>)", "http://a/"), ("OBJECT(<<( <http://a/> <http://b/> 5 )>>)", "5"),
    ("ISTRIPLE(TRIPLE(<http://a/>, <http://b/>, 1))", "true"), ("HASLANG('a'@en)", "true"), ("LANGDIR('a'@en--rtl)", "rtl"), ("'2012-01-01T00:00:00Z'^^xsd:dateTime < '2012-01-01T01:00:00-05:00'^^xsd:dateTime", "true"),
    ("CONTAINS('abc', 'b') && STRSTARTS('abc', 'a') && STRENDS('abc', 'c')", "true"), ("UCASE('a'@en)", "A"), ("BOUND(?zz)", "false"), ("2 IN ()", "false"),
]


def test_functions(people):
    text = "SELECT " + " ".join(f"({e} AS ?v{i})" for i, (e, _) in enumerate(FUNCTIONS)) + " {}"
    row = run_query(people, P + text).rows()[0]
    got = [(e, row[f"v{i}"].lex if f"v{i}" in row else None) for i, (e, _) in enumerate(FUNCTIONS)]
    assert got == FUNCTIONS


def test_ask_and_construct(people):
    assert solutions(people, "ASK { ?s ex:name 'Alice' }") is True and solutions(people, "ASK { ?s ex:name 'Nobody' }") is False
    r = run_query(people, P + "CONSTRUCT { ?s ex:label ?n ; ex:at [ ex:of ?s ] } WHERE { ?s ex:name ?n }").df.collect()
    assert len(r) == 9 and len({x.s.id for x in r if x.p.endswith("/of")}) == 3
    assert run_query(people, P + "CONSTRUCT WHERE { ?s ex:knows ?o }").df.count() == 2


def test_bindings(people):
    assert solutions(people, "SELECT ?n { ?s ex:name ?n }", bindings={"s": iri("http://example.org/Bob")}) == [("Bob",)]


@pytest.mark.parametrize("bad", [
    "SELECT ?x { ?s ?p ?o } GROUP BY ?s", "SELECT * { ?s ?p ?o } GROUP BY ?s", "SELECT (?o AS ?s) { ?s ?p ?o }", "SELECT * { SERVICE <x> {} }", "SELECT * { ?s ?p ?o BIND(1 AS ?s) }", "SELECT * { VALUES (?a ?b) { (1) } }",
    "SELECT * { VALUES (?a ?a) { (1 2) } }", "SELECT (SUM(COUNT(?x)) AS ?y) { ?s ?p ?x }", "DESCRIBE <x>", "SELECT * { ?s ?p '\\uD800' }", "SELECT ?x", "SELECT * { ?s no:p ?o }", "SELECT (NOSUCH(1) AS ?x) {}", "SELECT * { ?s ?p <<( 'lit' ?b ?c )>> }",
    "SELECT * { { ?s ?p ?o }", "ASK { ?s ?p }",
])
def test_rejected(bad):
    with pytest.raises(SparqlError):
        parse_query(bad)


@pytest.mark.parametrize("bad", ["INSERT DATA { ?s <p> <o> }", "DELETE DATA { _:b <p> <o> }", "DELETE { _:b <p> ?o } WHERE { ?s ?p ?o }", "INSERT DATA { _:b <p> 1 } ; INSERT DATA { _:b <p> 2 }", "WITH <g> CLEAR ALL"])
def test_rejected_updates(bad):
    with pytest.raises(SparqlError):
        parse_update(bad)


def test_bad_pattern_is_refused(people):
    with pytest.raises(UnsupportedFunction):
        run_query(people, P + "SELECT ?s { ?s ex:name ?n FILTER(REGEX(?n, '(')) }")


def test_triple_terms(graph):
    g = QuadGraph(graph("ex:s ex:p <<( ex:a ex:b 42 )>> . ex:x ex:y ex:z {| ex:source ex:web |} . ex:n ex:p <<( ex:a ex:b <<( ex:c ex:d 1 )>> )>> ."), is_set=True)
    assert solutions(g, "SELECT ?s ?v { ?s ex:p <<( ex:a ex:b ?v )>> FILTER(ISNUMERIC(?v)) }") == [("s", "42")]
    assert solutions(g, "SELECT ?s ?v { ?s ex:p <<( ?a ex:b <<( ex:c ex:d ?v )>> )>> }") == [("n", "1")]
    assert solutions(g, "SELECT ?src { ex:x ex:y ex:z {| ex:source ?src |} }") == [("web",)]
    assert solutions(g, "SELECT ?src { << ?s ?p ex:z >> ex:source ?src }") == [("web",)]


def test_cycles_and_lists(graph):
    g = QuadGraph(graph("ex:a ex:p ex:b . ex:b ex:p ex:a . ex:c ex:p ex:c . ex:d ex:p 'lit' . ex:l ex:list (1 ex:b) ."), is_set=True)
    assert solutions(g, "SELECT ?y { ex:a ex:p+ ?y }") == [("a",), ("b",)]
    assert solutions(g, "SELECT ?x ?y { ?x ex:p+ ?y }") == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c"), ("d", "lit")]
    assert solutions(g, "SELECT ?x { ?x ex:p+ 'lit' }") == [("d",)]
    assert solutions(g, "SELECT ?x { ?x ex:p ?x }") == [("c",)]
    assert solutions(g, "SELECT ?e { ex:l ex:list/rdf:rest*/rdf:first ?e }") == [("1",), ("b",)]
    assert solutions(g, "SELECT ?s { ?s ex:list (1 ex:b) }") == [("l",)]


@pytest.fixture(scope="module")
def named(graph):
    return graph("ex:a ex:p 1 . ex:g1 { ex:a ex:p 2 . ex:b ex:p 3 } ex:g2 { ex:a ex:q 4 . ex:a ex:p 2 }", "trig").cache()


def test_graphs(named):
    g = QuadGraph(named, is_set=True)
    assert solutions(g, "SELECT ?v { ex:a ex:p ?v }") == [("1",)]
    assert solutions(g, "SELECT ?g ?v { GRAPH ?g { ex:a ex:p ?v } }") == [("g1", "2"), ("g2", "2")]
    assert solutions(g, "SELECT ?v { GRAPH ex:g1 { ?s ex:p ?v } }") == [("2",), ("3",)]
    assert solutions(g, "SELECT ?g { GRAPH ?g {} }") == [("g1",), ("g2",)]
    assert solutions(g, "SELECT ?v FROM ex:g1 FROM ex:g2 { ?s ex:p ?v }") == [("2",), ("3",)]
    assert solutions(g, "SELECT ?g FROM NAMED ex:g2 { GRAPH ?g { ?s ?p ?o } }") == [("g2",), ("g2",)]
    assert solutions(QuadGraph(named, union_default=True), "SELECT ?v { ex:a ex:p ?v }") == [("1",), ("2",)]
    assert solutions(g, "SELECT ?g ?x { GRAPH ?g { ex:a (ex:p|ex:q)+ ?x } }") == [("g1", "2"), ("g2", "2"), ("g2", "4")]


def rows(ds, short):
    return sorted((short(f"<{r.g}>") if r.g else "", short(r.s.id), short(r.p), r.o.lex.replace("http://example.org/", "")) for r in ds.quads.collect())


def test_updates(spark, named, short):
    ds = Dataset(named)
    ds.prefixes.bind("ex", "http://example.org/")
    assert ("", "c", "p", "9") in rows(ds.update("INSERT DATA { ex:c ex:p 9 , 9 }"), short)
    assert len(rows(ds.update("DELETE DATA { GRAPH ex:g1 { ex:b ex:p 3 } }"), short)) == 4
    assert rows(ds.update("DELETE WHERE { GRAPH ?g { ?s ?p ?o } }"), short) == [("", "a", "p", "1")]
    swapped = rows(ds.update("WITH ex:g1 DELETE { ?s ex:p ?v } INSERT { ?s ex:r ?v } WHERE { ?s ex:p ?v }"), short)
    assert ("g1", "a", "r", "2") in swapped and ("g1", "a", "p", "2") not in swapped and ("", "a", "p", "1") in swapped
    assert ("", "b", "u", "3") in rows(ds.update("INSERT { ?s ex:u ?v } USING ex:g1 WHERE { ?s ex:p ?v }"), short)
    assert {r[0] for r in rows(ds.update("CLEAR NAMED"), short)} == {""} and rows(ds.update("DROP ALL"), short) == []
    moved = rows(ds.update("MOVE ex:g1 TO ex:g3"), short)
    assert {r[0] for r in moved} == {"", "g2", "g3"} and rows(ds.update("MOVE ex:g1 TO ex:g1"), short) == rows(ds, short)
    assert len([r for r in rows(ds.update("COPY ex:g1 TO ex:g2"), short) if r[0] == "g2"]) == 2
    assert len([r for r in rows(ds.update("ADD ex:g1 TO ex:g2"), short) if r[0] == "g2"]) == 3
    assert len(rows(ds.update("ADD DEFAULT TO ex:new"), short)) == 6
    with pytest.raises(SparqlError):
        ds.update("COPY ex:none TO ex:g1")
    with pytest.raises(SparqlError):
        ds.update("LOAD <http://x/>")
    ds.update("COPY SILENT ex:none TO ex:g1 ; LOAD SILENT <http://x/>")
    loaded = ds.update("LOAD <http://x/> INTO GRAPH ex:new", loader=lambda url: named.where("g IS NULL"))
    assert ("new", "a", "p", "1") in rows(loaded, short)
    assert rows(ds.update("DELETE { ?s ex:p ?v } INSERT { ?s ex:p ?w } WHERE { ?s ex:p ?v BIND(?v + 1 AS ?w) }"), short)[0] == ("", "a", "p", "2")


def test_dataset(spark, named, short, tmp_path):
    ds = Dataset(named)
    a, p = "<http://example.org/a>", "http://example.org/p"
    assert ds.count() == 5 and ds.count(s=a) == 4 and ds.exists(p=p) and not ds.exists(p="http://none/")
    assert ds.triples(s=a, limit=2).count() == 2 and ds.triples(s=a, limit=10, offset=3).count() == 1
    assert {r.g for r in ds.contexts(s=a).collect()} == {None, "http://example.org/g1", "http://example.org/g2"}
    assert ds.remove(s=a).count() == 1 and ds.remove(s=a, g="http://example.org/g1").count() == 4
    changed = ds.set_value((None, iri("http://example.org/a"), iri(p), literal(7)))
    assert ("", "a", "p", "7") in rows(changed, short) and changed.count() == 5 and ds.count() == 5
    assert ds.remove_graph("http://example.org/g2").count() == 3 and ds.add(named).count() == 5 and ds.remove_quads(named).count() == 0
    assert Resource(ds, iri("http://example.org/a")).objects(p).count() == 2
    ds.write(str(tmp_path / "store"))
    back = Dataset.read(spark, str(tmp_path / "store"))
    assert rows(back, short) == rows(ds, short) and back.prefixes.of == ds.prefixes.of
    with pytest.raises(ValueError):
        ds.remove_graph(None)
    assert Dataset.empty(spark).count() == 0 and Dataset.empty(spark).query("SELECT * { ?s ?p ?o }").df.count() == 0


def test_tags_and_directions_of_string_functions(graph):
    from quadloom.plans.graphs import QuadGraph
    from quadloom.sparql.compiler import run_query

    g = QuadGraph(graph("ex:a ex:p 1 ."))
    cases = {
        'CONCAT("a"@en, "b"@en)': '"ab"@en', 'CONCAT("a"@en, "b"@de)': '"ab"', 'CONCAT("a"@ar--rtl, "b"@ar--rtl)': '"ab"@ar--rtl', 'CONCAT("a"@ar--rtl, "b"@ar)': '"ab"', 'CONCAT("a"@ar--rtl, "b"@ar--ltl)'.replace("ltl", "ltr"): '"ab"',
        'STRBEFORE("abc"@en, "b"@en)': '"a"@en', 'STRBEFORE("abc"@en, "b"@de)': None, 'STRBEFORE("abc", "b"@en)': None, 'STRAFTER("abc"@en, "b")': '"c"@en', 'STRAFTER("abc"@en, "z"@de)': None, 'STRAFTER("abc", "z")': '""', 'STRAFTER("abc"@en, "z"@en)': '""',
    }
    row = run_query(g, "SELECT " + " ".join(f"({e} AS ?v{i})" for i, e in enumerate(cases)) + " { ?s ?p ?o }").ids().first()
    assert [(e, row[f"v{i}"]) for i, e in enumerate(cases)] == list(cases.items())
