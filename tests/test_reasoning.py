from pyspark.sql import functions as F

from quadloom.reasoning.rules import expand

SYMMETRIC = "<http://www.w3.org/2002/07/owl#SymmetricProperty>"


def added(graph, short, text, regimes=frozenset({"rdfs"}), **kw):
    closed, new, bad = expand(graph(text), regimes, **kw)
    got = {(short(r.s.id), r.p.replace("http://example.org/", "").split("#")[-1], short(r.o.id)) for r in new.collect()}
    return got, {r.rule for r in bad.collect()}, closed


def test_rdfs(graph, short):
    got, _, closed = added(graph, short, """ex:A rdfs:subClassOf ex:B . ex:B rdfs:subClassOf ex:C . ex:C rdfs:subClassOf ex:A . ex:x a ex:A . ex:p rdfs:domain ex:D ; rdfs:range ex:R ; rdfs:subPropertyOf ex:q .
        ex:x ex:p ex:y . ex:z ex:p "lit" .""")
    assert got == {("x", "type", "B"), ("x", "type", "C"), ("x", "type", "D"), ("y", "type", "R"), ("z", "type", "D"), ("x", "q", "y"), ("z", "q", '"lit"')}
    again = expand(closed.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))[1]
    assert again.count() == 0


def test_schema_triples_on_request(graph, short):
    text = "ex:A rdfs:subClassOf ex:B . ex:B rdfs:subClassOf ex:C ."
    assert added(graph, short, text)[0] == set()
    assert added(graph, short, text, materialize_schema=True)[0] == {("A", "subClassOf", "C")}


def test_owl_properties(graph, short):
    got, bad, _ = added(graph, short, """ex:s a owl:SymmetricProperty . ex:x ex:s ex:y . ex:t a owl:TransitiveProperty . ex:a ex:t ex:b . ex:b ex:t ex:c . ex:c ex:t ex:d .
        ex:i owl:inverseOf ex:j . ex:m ex:i ex:n . ex:e1 owl:equivalentProperty ex:e2 . ex:m ex:e1 ex:o . ex:uncle owl:propertyChainAxiom (ex:parent ex:brother) . ex:k ex:parent ex:l . ex:l ex:brother ex:h .""", {"owlrl"})
    assert got == {("y", "s", "x"), ("a", "t", "c"), ("a", "t", "d"), ("b", "t", "d"), ("n", "j", "m"), ("m", "e2", "o"), ("k", "uncle", "h")}
    assert bad == set()


def test_owl_equality(graph, short):
    got, _, _ = added(graph, short, """ex:f a owl:FunctionalProperty . ex:a ex:f ex:b, ex:c . ex:key a owl:Class ; owl:hasKey (ex:id ex:no) . ex:i1 a ex:key ; ex:id 5 ; ex:no "x" . ex:i2 a ex:key ; ex:id 5 ; ex:no "x" .
        ex:i3 a ex:key ; ex:id 5 ; ex:no "y" . ex:b ex:q 1 .""", {"owlrl"})
    assert {("b", "sameAs", "c"), ("c", "sameAs", "b"), ("c", "q", "1"), ("i1", "sameAs", "i2"), ("i2", "sameAs", "i1")} <= got
    assert not any("i3" in t for t in got)


def test_owl_classes(graph, short):
    got, _, _ = added(graph, short, """ex:HV owl:onProperty ex:p ; owl:hasValue ex:v . ex:x a ex:HV . ex:y ex:p ex:v . ex:SV owl:onProperty ex:q ; owl:someValuesFrom ex:C . ex:s ex:q ex:o . ex:o a ex:C .
        ex:AV owl:onProperty ex:r ; owl:allValuesFrom ex:D . ex:t a ex:AV ; ex:r ex:u . ex:MC owl:onProperty ex:m ; owl:maxCardinality 1 . ex:w a ex:MC ; ex:m ex:n1, ex:n2 .
        ex:I owl:intersectionOf (ex:J ex:K) . ex:b a ex:J, ex:K . ex:d a ex:I . ex:U owl:unionOf (ex:J ex:L) . ex:O owl:oneOf (ex:g ex:h) . ex:E owl:equivalentClass ex:J .
        ex:QC owl:onProperty ex:z ; owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger ; owl:onClass ex:C . ex:qq a ex:QC ; ex:z ex:o, ex:o2, ex:o3 . ex:o2 a ex:C .""", {"owlrl"})
    want = {("x", "p", "v"), ("y", "type", "HV"), ("s", "type", "SV"), ("u", "type", "D"), ("n1", "sameAs", "n2"), ("b", "type", "I"), ("d", "type", "J"), ("d", "type", "K"), ("b", "type", "U"), ("d", "type", "U"),
            ("g", "type", "O"), ("h", "type", "O"), ("b", "type", "E"), ("o", "sameAs", "o2")}
    assert want <= got and ("o", "sameAs", "o3") not in got


def test_inconsistencies(graph, short):
    _, bad, _ = added(graph, short, """ex:A owl:disjointWith ex:B . ex:x a ex:A, ex:B . ex:n a owl:Nothing . ex:i a owl:IrreflexiveProperty . ex:a ex:i ex:a . ex:as a owl:AsymmetricProperty . ex:a ex:as ex:b . ex:b ex:as ex:a .
        ex:p owl:propertyDisjointWith ex:q . ex:a ex:p ex:c ; ex:q ex:c . [] a owl:AllDisjointClasses ; owl:members (ex:D ex:E) . ex:y a ex:D, ex:E . ex:u owl:sameAs ex:v . ex:u owl:differentFrom ex:v .
        ex:F owl:complementOf ex:G . ex:z a ex:F, ex:G . ex:M owl:onProperty ex:m ; owl:maxCardinality 0 . ex:w a ex:M ; ex:m 1 .
        [] owl:sourceIndividual ex:a ; owl:assertionProperty ex:p ; owl:targetIndividual ex:c . [] owl:sourceIndividual ex:w ; owl:assertionProperty ex:m ; owl:targetValue 1 .
        [] a owl:AllDisjointProperties ; owl:members (ex:r1 ex:r2) . ex:a ex:r1 ex:c ; ex:r2 ex:c .""", {"owlrl"})
    assert bad == {"cax-dw", "cls-nothing2", "prp-irp", "prp-asyp", "prp-pdw", "cax-adc", "eq-diff1", "cls-com", "cls-maxc1", "prp-npa1", "prp-npa2", "prp-adp"}


def test_members_of_a_group_have_each_other_s_triples(graph, short):
    got, _, closed = added(graph, short, """ex:a owl:sameAs ex:b . ex:c owl:sameAs ex:b . ex:d owl:sameAs ex:c . ex:a ex:p ex:x . ex:y ex:p ex:d . ex:x owl:sameAs ex:x .""", {"owlrl"})
    group = "abcd"
    want = {(x, "sameAs", y) for x in group for y in group if x != y} | {(x, "p", "x") for x in group} | {("y", "p", x) for x in group}
    assert got == want - {("a", "sameAs", "b"), ("c", "sameAs", "b"), ("d", "sameAs", "c"), ("a", "p", "x"), ("y", "p", "d")}
    assert expand(closed.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"), {"owlrl"})[1].count() == 0


def test_equality_of_properties_and_classes(graph, short):
    got, _, _ = added(graph, short, "ex:p a owl:SymmetricProperty . ex:p owl:sameAs ex:q . ex:x ex:q ex:y . ex:C owl:sameAs ex:D . ex:E owl:equivalentClass ex:D . ex:i a ex:C .", {"owlrl"})
    assert {("y", "q", "x"), ("q", "type", SYMMETRIC), ("i", "type", "D"), ("i", "type", "E"), ("E", "equivalentClass", "C")} <= got and ("x", "p", "y") not in got


def test_equality_found_on_the_way(graph, short):
    """A merge that only a derived triple gives, and one that only the first merge gives."""
    got, _, _ = added(graph, short, "ex:f a owl:FunctionalProperty . ex:e owl:equivalentProperty ex:f . ex:a ex:f ex:b ; ex:e ex:c . ex:b ex:f ex:m . ex:c ex:f ex:n . ex:n ex:k ex:z .", {"owlrl"})
    assert {("b", "sameAs", "c"), ("m", "sameAs", "n"), ("m", "k", "z"), ("c", "f", "m")} <= got


def test_schema_derived_on_the_way(graph, short):
    got, _, _ = added(graph, short, "ex:K rdfs:subClassOf owl:SymmetricProperty . ex:s a ex:K . ex:x ex:s ex:y .", {"owlrl"})
    assert ("y", "s", "x") in got and ("s", "type", SYMMETRIC) in got
    got, _, _ = added(graph, short, "ex:isa rdfs:subPropertyOf rdf:type . rdf:type rdfs:domain ex:Typed . ex:x ex:isa ex:A . ex:A rdfs:subClassOf ex:B . ex:under rdfs:subPropertyOf rdfs:subClassOf . ex:B ex:under ex:C .")
    assert {("x", "type", "A"), ("x", "type", "B"), ("x", "type", "C"), ("x", "type", "Typed"), ("B", "subClassOf", "C")} <= got


def test_nothing_to_derive(graph, short):
    assert added(graph, short, "", {"owlrl"})[0] == added(graph, short, "ex:a ex:p ex:b .", {"owlrl"})[0] == added(graph, short, "ex:a ex:p ex:b .")[0] == set()


def test_keys_of_several_values(graph, short):
    got, _, _ = added(graph, short, """ex:K owl:hasKey (ex:a ex:b ex:c) . ex:i a ex:K ; ex:a 1, 2 ; ex:b 3, 4 ; ex:c 5 . ex:j a ex:K ; ex:a 2 ; ex:b 4, 9 ; ex:c 5, 6 . ex:k a ex:K ; ex:a 1 ; ex:b 3 . ex:l a ex:K ; ex:a 1 ; ex:b 10 ; ex:c 5 .
        ex:One owl:hasKey (ex:a) . ex:m a ex:One ; ex:a 7 . ex:n a ex:One ; ex:a 7 .""", {"owlrl"})
    assert {t for t in got if t[1] == "sameAs"} == {("i", "sameAs", "j"), ("j", "sameAs", "i"), ("m", "sameAs", "n"), ("n", "sameAs", "m")}
