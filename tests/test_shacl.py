import pytest

from conftest import HEAD
from quadloom.shacl.rules import RuleError, RuleSet
from quadloom.shacl.shapes import ShapeError
from quadloom.shacl.validate import validate
from quadloom.sources.turtle import parse_turtle


@pytest.fixture(scope="module")
def check(graph, short):
    def f(data, shapes):
        r = validate(graph(data), parse_turtle(HEAD + shapes))
        rows = [(short(x.focus), short(x.path), short(x.value), x.component.split("#")[-1].replace("ConstraintComponent", "").replace("http://example.org/", "")) for x in r.df.collect()]
        return sorted(rows, key=repr)

    return f


def test_products(check):
    assert check("""ex:W a ex:Product ; ex:name "W" ; ex:price 9.5 ; ex:status "active" ; ex:category ex:c . ex:Gadget a ex:Product ; ex:price -5.00 ; ex:status "unknown" . ex:Office a ex:Address ; ex:street "S" ; ex:country "US" .""",
        """ex:PS a sh:NodeShape ; sh:targetClass ex:Product ; sh:property [ sh:path ex:name ; sh:minCount 1 ; sh:datatype xsd:string ] , [ sh:path ex:price ; sh:minInclusive 0 ] , [ sh:path ex:status ; sh:in ("active") ] , [ sh:path ex:category ; sh:minCount 1 ] .
        ex:AS a sh:NodeShape ; sh:targetClass ex:Address ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path ex:street ] .""") == [
        ("Gadget", "category", None, "MinCount"), ("Gadget", "name", None, "MinCount"), ("Gadget", "price", "-5.00", "MinInclusive"), ("Gadget", "status", '"unknown"', "In"), ("Office", "country", '"US"', "Closed")]


VALUES = [
    ('ex:a ex:p "a", 5, ex:i, "x"@en', "sh:datatype xsd:string", ["\"x\"@en", "5", "i"]),
    ('ex:a ex:p "300"^^xsd:byte, "5"^^xsd:byte, "x"^^xsd:integer', "sh:datatype xsd:byte", ['"300"^^<http://www.w3.org/2001/XMLSchema#byte>', '"x"^^<http://www.w3.org/2001/XMLSchema#integer>']),
    ('ex:a ex:p "2020-02-30"^^xsd:date, "2020-02-29"^^xsd:date', "sh:datatype xsd:date", ['"2020-02-30"^^<http://www.w3.org/2001/XMLSchema#date>']),
    ("ex:a ex:p 5, ex:i, _:b", "sh:nodeKind sh:IRI", ["5", "_:b"]),
    ("ex:a ex:p 5, ex:i, _:b", "sh:nodeKind sh:BlankNodeOrLiteral", ["i"]),
    ('ex:a ex:p 5, 10, "s", ex:i', "sh:minExclusive 5", ['"s"', "5", "i"]),
    ('ex:a ex:p "2020-01-01T00:00:00Z"^^xsd:dateTime, "2020-01-01T00:00:00"^^xsd:dateTime', 'sh:maxInclusive "2021-01-01T00:00:00Z"^^xsd:dateTime', ['"2020-01-01T00:00:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>']),
    ('ex:a ex:p "abc", "a", _:b', "sh:minLength 2", ['"a"', "_:b"]),
    ('ex:a ex:p "Abc", "xyz"', 'sh:pattern "^a" ; sh:flags "i"', ['"xyz"']),
    ('ex:a ex:p "a"@en-gb, "b"@de, "c"', 'sh:languageIn ("en")', ['"b"@de', '"c"']),
    ('ex:a ex:p "a\\nb", "c"', "sh:singleLine true", ['"a\\nb"']),
    ("ex:a ex:p ex:i, ex:j . ex:i a ex:Sub . ex:Sub rdfs:subClassOf ex:C", "sh:class ex:C", ["j"]),
    ("ex:a ex:p ex:i, ex:j . ex:j a ex:D", "sh:class (ex:C ex:D)", ["i"]),
    ("ex:a ex:p 1, 2 ; ex:q 2, 3", "sh:equals ex:q", ["1", "3"]),
    ("ex:a ex:p 1, 2 ; ex:q 2, 3", "sh:disjoint ex:q", ["2"]),
    ("ex:a ex:p 1, 2 ; ex:q 2, 3", "sh:subsetOf ex:q", ["1"]),
    ('ex:a ex:p 1, 2 ; ex:q "a", "b"', "sh:lessThan ex:q", ["1", "1", "2", "2"]),
    ("ex:a ex:p 1, 2 ; ex:q 2", "sh:lessThanOrEquals ex:q", []),
    ("ex:a ex:p 1, 2", "sh:maxCount 1", [None]),
    ("ex:a ex:p 1", "sh:hasValue 2", [None]),
    ('ex:a ex:p "x"@en, "y"@en, "z"@de', "sh:uniqueLang true", [None]),
    ("ex:a ex:p 1, ex:i", "sh:not [ sh:nodeKind sh:IRI ]", ["i"]),
    ("ex:a ex:p 1, ex:i", "sh:and ( [ sh:nodeKind sh:IRI ] [ sh:nodeKind sh:IRIOrLiteral ] )", ["1"]),
    ("ex:a ex:p 1, ex:i, _:b", "sh:or ( [ sh:nodeKind sh:IRI ] [ sh:nodeKind sh:Literal ] )", ["_:b"]),
    ("ex:a ex:p 1, ex:i, _:b", "sh:xone ( [ sh:nodeKind sh:IRI ] [ sh:nodeKind sh:IRIOrLiteral ] )", ["_:b", "i"]),
    ("ex:a ex:p ex:i, ex:j . ex:i ex:name 1", "sh:node [ sh:property [ sh:path ex:name ; sh:minCount 1 ] ]", ["j"]),
    ("ex:a ex:p ex:i, ex:j", "sh:someValue [ sh:nodeKind sh:Literal ]", [None]),
    ("ex:a ex:p (1 2 2), (1 2)", "sh:uniqueMembers true", 1), ("ex:a ex:p (1 2 3), (1)", "sh:maxListLength 2", 1), ("ex:a ex:p (1), ()", "sh:minListLength 1", 1), ("ex:a ex:p (1 ex:i), (1)", "sh:memberShape [ sh:datatype xsd:integer ]", 1),
    ("ex:a ex:p 7", "sh:uniqueMembers true", 1),
    ("ex:a ex:p ex:i {| ex:conf 1 |} , ex:j {| ex:x 2 |}", "sh:reifierShape [ sh:property [ sh:path ex:conf ; sh:minCount 1 ] ]", ["j"]),
    ("ex:a ex:p ex:i", "sh:reifierShape [ sh:nodeKind sh:BlankNodeOrIRI ] ; sh:reificationRequired true", ["i"]),
]


@pytest.mark.parametrize("data,constraint,want", VALUES, ids=[v[1][:40] + str(i) for i, v in enumerate(VALUES)])
def test_property_constraint(check, data, constraint, want):
    got = check(data + " .", f"ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:p ; {constraint} ] .")
    if isinstance(want, int):
        assert len(got) == want
    else:
        assert sorted((g[2] for g in got), key=repr) == sorted((w if w is None or not w.startswith("_:") else w for w in want), key=repr)


def test_targets_and_paths(check):
    data = "ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:q 1 . ex:C a rdfs:Class . ex:i a ex:C . ex:z sh:shape ex:W ."
    assert check(data, "ex:S sh:targetSubjectsOf ex:q ; sh:nodeKind sh:Literal .") == [("c", None, "c", "NodeKind")]
    assert check(data, "ex:S sh:targetObjectsOf ex:q ; sh:nodeKind sh:IRI .") == [("1", None, "1", "NodeKind")]
    assert check(data, "ex:C a rdfs:Class, sh:NodeShape ; sh:nodeKind sh:Literal .") == [("i", None, "i", "NodeKind")]
    assert check(data, "ex:W a sh:NodeShape ; sh:nodeKind sh:Literal .") == [("z", None, "z", "NodeKind")]
    assert check(data, "ex:S sh:targetWhere [ sh:property [ sh:path ex:q ; sh:minCount 1 ] ] ; sh:nodeKind sh:Literal .") == [("c", None, "c", "NodeKind")]
    assert check(data, 'ex:S sh:target [ sh:select "SELECT ?this WHERE { ?this <http://example.org/q> 1 }" ] ; sh:nodeKind sh:Literal .') == [("c", None, "c", "NodeKind")]
    for path, n in (("( ex:p ex:p )", 1), ("[ sh:inversePath ex:p ]", 0), ("[ sh:oneOrMorePath ex:p ]", 2), ("[ sh:zeroOrMorePath ex:p ]", 3), ("[ sh:zeroOrOnePath ex:p ]", 2), ("[ sh:alternativePath ( ex:p ex:q ) ]", 1)):
        assert len(check(data, f"ex:S sh:targetNode ex:a ; sh:property [ sh:path {path} ; sh:nodeKind sh:Literal ] .")) == n, path
    assert check(data, "ex:S sh:targetNode ex:a ; sh:deactivated true ; sh:nodeKind sh:Literal .") == []
    cyclic = "ex:a ex:p ex:b . ex:b ex:p ex:a ."
    assert len(check(cyclic, "ex:S sh:targetNode ex:a ; sh:property [ sh:path [ sh:oneOrMorePath ex:p ] ; sh:nodeKind sh:Literal ] .")) == 2


def test_qualified(check):
    data = "ex:h ex:digit ex:f1, ex:f2, ex:t . ex:f1 a ex:F . ex:f2 a ex:F . ex:t a ex:T, ex:F ."
    shape = "ex:S sh:targetNode ex:h ; sh:property [ sh:path ex:digit ; sh:qualifiedValueShape [ sh:class ex:F ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 3 ] , [ sh:path ex:digit ; sh:qualifiedValueShape [ sh:class ex:T ] ; sh:qualifiedMaxCount 0 ] ."
    assert [g[3] for g in check(data, shape)] == ["QualifiedMaxCount", "QualifiedMinCount"]


def test_closed_by_types(check):
    data = "ex:i a ex:C ; ex:p 1 ; ex:q 2 ; ex:r 3 . ex:C rdfs:subClassOf ex:D ."
    shapes = "ex:D a sh:NodeShape ; sh:property [ sh:path ex:q ] . ex:C a sh:NodeShape ; sh:targetClass ex:C ; sh:closed sh:ByTypes ; sh:property [ sh:path ex:p ] ."
    assert check(data, shapes) == [("i", "r", "3", "Closed")]


def test_sparql(check):
    data = "ex:k ex:v 5 ; ex:w 7 . ex:l ex:v 9 ."
    assert check(data, 'ex:Q sh:targetSubjectsOf ex:v ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <http://example.org/v> ?value . FILTER NOT EXISTS { $this <http://example.org/w> ?w } }" ] .') == [("l", None, "9", "SPARQL")]
    assert check(data, 'ex:Q sh:targetNode ex:k ; sh:property [ sh:path ex:v ; sh:sparql [ sh:prefixes ex:O ; sh:select "SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value > 4) }" ] ] . ex:O sh:declare [ sh:prefix "e" ; sh:namespace "http://example.org/" ] .') == [("k", "v", "5", "SPARQL")]
    component = """ex:Comp a sh:ConstraintComponent ; sh:parameter [ sh:path ex:least ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:ask "ASK { FILTER(?value >= $least) }" ] .
        ex:S sh:targetSubjectsOf ex:v ; sh:property [ sh:path ex:v ; ex:least 6 ] ."""
    assert check(data, component) == [("k", "v", "5", "Comp")]


def test_severity_and_messages(graph):
    shapes = 'ex:S sh:targetNode ex:a ; sh:severity sh:Debug ; sh:message "no"@en ; sh:nodeKind sh:Literal .'
    r = validate(graph("ex:a ex:p 1 ."), parse_turtle(HEAD + shapes))
    row = r.df.first()
    assert r.conforms and row.severity.endswith("Debug") and row.messages == ['"no"@en']


EXPRESSIONS = [
    ("5", ["5"]), ("(1 2)", ["1", "2"]), ("[ shnex:var \"focusNode\" ]", ["a"]), ("[ shnex:pathValues ex:p ]", ["1", "3"]), ("[ shnex:count [ shnex:pathValues ex:p ] ]", ["2"]), ("[ shnex:sum [ shnex:pathValues ex:p ] ]", ["4"]),
    ("[ shnex:min [ shnex:pathValues ex:p ] ]", ["1"]), ("[ shnex:max [ shnex:pathValues ex:p ] ]", ["3"]), ("[ shnex:exists [ shnex:pathValues ex:none ] ]", ["false"]), ("[ shnex:distinct (1 1 2) ]", ["1", "2"]),
    ("[ shnex:concat ( 1 [ shnex:pathValues ex:p ] ) ]", ["1", "1", "3"]), ("[ shnex:intersection ( (1 2 3) (3 1) ) ]", ["1", "3"]), ("[ shnex:nodes (1 2 3) ; shnex:remove (2) ]", ["1", "3"]), ("[ shnex:nodes (1 2 3) ; shnex:limit 2 ]", ["1", "2"]),
    ("[ shnex:nodes (1 2 3) ; shnex:offset 1 ]", ["2", "3"]), ("[ shnex:if [ shnex:exists (1) ] ; shnex:then 7 ; shnex:else 8 ]", ["7"]), ("[ shnex:nodes (ex:a ex:b) ; shnex:flatMap [ shnex:pathValues ex:p ] ]", ["1", "3", "9"]),
    ("[ shnex:nodes (1 ex:b) ; shnex:filterShape [ sh:nodeKind sh:IRI ] ]", ["b"]), ("[ shnex:nodes (1 ex:b ex:a) ; shnex:findFirst [ sh:nodeKind sh:IRI ] ]", ["b"]), ("[ shnex:nodes (1 ex:b) ; shnex:matchAll [ sh:nodeKind sh:IRI ] ]", ["false"]),
    ("[ shnex:instancesOf ex:C ]", ["b"]), ("[ shnex:count [ shnex:instancesOf ex:C ] ]", ["1"]), ("[ shnex:exists [ shnex:instancesOf ex:None ] ]", ["false"]), ("[ shnex:exists [ shnex:nodesMatching [ sh:nodeKind sh:IRI ] ] ]", ["true"]), ("[ shnex:nodes (3 1 2) ; shnex:orderBy [ shnex:var \"focusNode\" ] ; shnex:desc true ]", ["3", "2", "1"]), ("[ shnex:nodesMatching [ sh:property [ sh:path ex:p ; sh:hasValue 9 ] ] ]", ["b"]),
]


@pytest.fixture(scope="module")
def expressions(spark, graph):
    from quadloom.shacl.nodeexpr import NodeExpressions
    from quadloom.shacl.validate import Validator

    triples = " ".join(f"ex:x ex:e{i} {e} ." for i, (e, _) in enumerate(EXPRESSIONS))
    v = Validator(graph("ex:a ex:p 1, 3 . ex:b ex:p 9 ; a ex:C ."), parse_turtle(HEAD + triples))
    return NodeExpressions(v), spark.createDataFrame([("<http://example.org/a>",)], "focus string")


@pytest.mark.parametrize("i", range(len(EXPRESSIONS)), ids=[e[0][:40] for e in EXPRESSIONS])
def test_node_expression(expressions, short, i):
    from quadloom.functions.terms import iri

    ev, focus = expressions
    node = ev.g.one(iri("http://example.org/x"), f"http://example.org/e{i}")
    assert [short(x) for x in ev.evaluate(node, focus).first()["values"]] == EXPRESSIONS[i][1]


def test_expression_constraints(check):
    data = "ex:a ex:p 1 . ex:b ex:p 1, 2 ; ex:type ex:T ."
    assert check(data, "ex:S sh:targetSubjectsOf ex:p ; sh:expression [ shnex:exists [ shnex:pathValues ex:type ] ] .") == [("a", None, "a", "Expression")]
    assert check(data, "ex:T a sh:NodeShape ; sh:property [ sh:path ex:p ; sh:maxCount 1 ] . ex:S sh:targetSubjectsOf ex:p ; sh:nodeByExpression [ shnex:pathValues ex:type ] .") == [("b", None, "b", "NodeByExpression")]
    assert check(data, "ex:S sh:targetNode ex:b ; sh:property [ sh:path ex:p ; sh:values [ shnex:count [ shnex:pathValues ex:p ] ] ; sh:in (1) ] .") == [("b", "p", "2", "In")]


def test_recursion_and_bad_patterns_are_refused(graph):
    with pytest.raises(ShapeError):
        validate(graph("ex:a ex:p ex:a ."), parse_turtle(HEAD + "ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:p ; sh:node ex:S ] ."))
    with pytest.raises(ShapeError):
        validate(graph("ex:a ex:p 1 ."), parse_turtle(HEAD + 'ex:S sh:targetNode ex:a ; sh:pattern "(" .'))


RULES = "PREFIX : <http://example.org/> "


def test_rules(graph, short):
    rs = RuleSet.parse(RULES + """DATA { :q :edge :r } RULE { ?x :reach ?y } WHERE { ?x :edge ?y } RULE { ?x :reach ?z } WHERE { ?x :reach ?y . ?y :edge ?z }
        RULE { ?x :alone true } WHERE { ?x :edge ?y NOT { ?x :reach :c } } RULE { ?x :more ?m } WHERE { ?x :n ?n FILTER(?n > 1) BIND(?n + 1 AS ?m) }""")
    assert [len(s) for s in rs.strata()] == [3, 1]
    got = {(short(r.s.id), short(f"<{r.p}>"), short(r.o.id)) for r in rs.infer(graph("ex:a ex:edge ex:b ; ex:n 5 . ex:b ex:edge ex:c ; ex:n 1 .")).collect()}
    assert got == {("q", "edge", "r"), ("q", "reach", "r"), ("a", "reach", "b"), ("a", "reach", "c"), ("b", "reach", "c"), ("q", "alone", "true"), ("a", "more", "6")}


@pytest.mark.parametrize("bad", ["RULE { ?x :p ?y } WHERE { ?x :q :a }", "RULE { ?x :p :a } WHERE { ?x :q :a NOT { ?x :p :a } }", "RULE { ?x :p :a } WHERE { ?x :q ?y BIND(1 AS ?y) }", "RULE { ?x :p :a } WHERE { FILTER(?x > 1) ?x :q :b }", "RULE { ?x :p }"])
def test_bad_rules(bad):
    with pytest.raises(RuleError):
        RuleSet.parse(RULES + bad).check().strata()
