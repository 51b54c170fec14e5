"""Entailment by each group of OWL rules over all quads, with the SQL that says the same."""

from __future__ import annotations

from quadloom.functions.vocab import OWL, RDF
from quadloom.queries.reference import _Q, QUERIES, S_, SQL, _added, _with_schema

TYPE = f"'{RDF.type}'"


def entail(name: str, turtle: str, sql: str, regimes: frozenset[str] = frozenset({"owlrl"})) -> None:
    """Register what a schema adds to all quads; ``sql`` selects s, p and o from t, all triples, and may repeat them."""
    QUERIES[name] = lambda spark, d: _added(spark, d, turtle, set(regimes))
    SQL[name] = f"WITH RECURSIVE t AS {_Q} {sql} EXCEPT SELECT s, p, o FROM t"


def same(pairs: str) -> str:
    """The rest of the SQL where ``pairs`` are the (a, b) that a rule makes the same, both ways round."""
    return f""", e AS (SELECT DISTINCT a, b FROM ({pairs}) pairs WHERE a <> b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  s1 AS (SELECT s, p, o FROM t UNION SELECT r.b, p, o FROM t JOIN r ON r.a = t.s), s2 AS (SELECT s, p, o FROM s1 UNION SELECT s, p, r.b FROM s1 JOIN r ON r.a = s1.o)
  SELECT a AS s, '{OWL.sameAs}' AS p, b AS o FROM r WHERE a <> b UNION SELECT s, p, o FROM s2"""


def of(p: str, alias: str) -> str:
    return f"(SELECT s, o FROM t WHERE p = '{S_}{p}') {alias}"


def typed(c: str, alias: str) -> str:
    return f"(SELECT s FROM t WHERE p = {TYPE} AND o = '<{S_}{c}>') {alias}"


RES = "(o LIKE '<%' OR o LIKE '\\_%' ESCAPE '\\')"
entail("owl_equivalents", "s:directed_by owl:equivalentProperty s:has_director . s:Film owl:equivalentClass s:Movie .",
       f"SELECT s, '{S_}has_director' AS p, o FROM t WHERE p = '{S_}directed_by' UNION SELECT s, {TYPE}, '<{S_}Movie>' FROM {typed('Film', 'x')}")
entail("owl_chain", "s:cast_member owl:propertyChainAxiom ( s:starring s:actor ) .",
       f"SELECT x.s AS s, '{S_}cast_member' AS p, y.o AS o FROM {of('starring', 'x')} JOIN {of('actor', 'y')} ON y.s = x.o")
entail("owl_functional", "s:country a owl:FunctionalProperty .",
       same(f"SELECT x.o AS a, y.o AS b FROM {of('country', 'x')} JOIN {of('country', 'y')} ON x.s = y.s WHERE {RES.replace('o LIKE', 'x.o LIKE')} AND {RES.replace('o LIKE', 'y.o LIKE')}"))
entail("owl_key", "s:Performance owl:hasKey ( s:actor s:film ) .",
       same(f"""SELECT a1.s AS a, a2.s AS b FROM {of('actor', 'a1')} JOIN {of('actor', 'a2')} ON a1.o = a2.o JOIN {of('film', 'f1')} ON f1.s = a1.s JOIN {of('film', 'f2')} ON f2.s = a2.s AND f1.o = f2.o
  WHERE a1.s IN (SELECT s FROM {typed('Performance', 'p1')}) AND a2.s IN (SELECT s FROM {typed('Performance', 'p2')})"""))
entail("owl_max_cardinality", "s:Archived owl:onProperty s:country ; owl:maxCardinality 1 .",
       same(f"SELECT x.o AS a, y.o AS b FROM {of('country', 'x')} JOIN {of('country', 'y')} ON x.s = y.s WHERE x.s IN (SELECT s FROM {typed('Archived', 'z')}) AND {RES.replace('o LIKE', 'x.o LIKE')} AND {RES.replace('o LIKE', 'y.o LIKE')}"))
entail("owl_max_qualified", 's:Archived owl:onProperty s:genre ; owl:maxQualifiedCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> ; owl:onClass s:Genre .',
       same(f"SELECT x.o AS a, y.o AS b FROM {of('genre', 'x')} JOIN {of('genre', 'y')} ON x.s = y.s WHERE x.s IN (SELECT s FROM {typed('Archived', 'z')}) AND x.o IN (SELECT s FROM {typed('Genre', 'g1')}) AND y.o IN (SELECT s FROM {typed('Genre', 'g2')})"))
entail("owl_has_value", 's:G0 owl:onProperty s:genre ; owl:hasValue <http://kb.example/genre/00> . s:Archived owl:onProperty s:status ; owl:hasValue "archived" .',
       f"SELECT s, {TYPE} AS p, '<{S_}G0>' AS o FROM {of('genre', 'x')} WHERE o = '<http://kb.example/genre/00>' UNION SELECT s, '{S_}status', '\"archived\"' FROM {typed('Archived', 'y')}")
entail("owl_some_values", "s:Cast owl:onProperty s:starring ; owl:someValuesFrom s:Performance . s:Voted owl:onProperty s:votes ; owl:someValuesFrom owl:Thing .",
       f"SELECT x.s AS s, {TYPE} AS p, '<{S_}Cast>' AS o FROM {of('starring', 'x')} WHERE o IN (SELECT s FROM {typed('Performance', 'y')}) UNION SELECT s, {TYPE}, '<{S_}Voted>' FROM {of('votes', 'z')}")
entail("owl_all_values", "s:Film owl:onProperty s:starring ; owl:allValuesFrom s:Role .",
       f"SELECT x.o AS s, {TYPE} AS p, '<{S_}Role>' AS o FROM {of('starring', 'x')} WHERE s IN (SELECT s FROM {typed('Film', 'y')}) AND {RES}")
entail("owl_intersection_union", "s:Stored owl:intersectionOf ( s:Film s:Archived ) . s:Catalogued owl:unionOf ( s:Stored s:Genre ) . s:Work owl:intersectionOf ( s:Made s:Kept ) .",
       f"""SELECT s, {TYPE} AS p, c AS o FROM (SELECT x.s, c FROM {typed('Film', 'x')} JOIN {typed('Archived', 'y')} ON x.s = y.s, (VALUES ('<{S_}Stored>'), ('<{S_}Catalogued>')) AS v(c)
  UNION SELECT s, '<{S_}Catalogued>' FROM {typed('Genre', 'z')} UNION SELECT s, c FROM {typed('Work', 'w')}, (VALUES ('<{S_}Made>'), ('<{S_}Kept>')) AS v2(c)) u""")
entail("owl_one_of", "s:Chosen owl:oneOf ( <http://kb.example/genre/00> <http://kb.example/genre/01> ) .",
       f"SELECT s, {TYPE} AS p, '<{S_}Chosen>' AS o FROM (VALUES ('<http://kb.example/genre/00>'), ('<http://kb.example/genre/01>')) AS v(s)")


def contradictions(spark, d):
    """What several kinds of schema forbid and the quads contain."""
    from quadloom.reasoning.rules import expand

    schema = """s:Film owl:disjointWith s:Archived . s:Work owl:complementOf s:Film . s:links_to a owl:IrreflexiveProperty , owl:AsymmetricProperty .
    s:Archived owl:onProperty s:votes ; owl:maxCardinality 0 . [] a owl:AllDisjointClasses ; owl:members ( s:Film s:Genre s:Archived ) . s:country owl:propertyDisjointWith s:made_in .
    [] owl:sourceIndividual <http://kb.example/film/0000001> ; owl:assertionProperty s:genre ; owl:targetIndividual <http://kb.example/genre/00> ."""
    return expand(_with_schema(spark, d, schema), {"owlrl"})[2]


QUERIES["owl_contradictions"] = contradictions
_BOTH = f"FROM {typed('Film', 'x')} JOIN {typed('Archived', 'y')} ON x.s = y.s"
SQL["owl_contradictions"] = f"""WITH t AS {_Q}
SELECT 'cax-dw' AS rule, x.s || ' <{S_}Film> <{S_}Archived>' AS message {_BOTH} UNION SELECT 'cax-adc', x.s || ' <{S_}Film> <{S_}Archived>' {_BOTH}
UNION SELECT 'cls-com', x.s || ' <{S_}Work> <{S_}Film>' FROM {typed('Work', 'x')} JOIN {typed('Film', 'y')} ON x.s = y.s
UNION SELECT 'prp-irp', s || ' {S_}links_to' FROM {of('links_to', 'x')} WHERE s = o
UNION SELECT 'prp-asyp', x.s || ' {S_}links_to ' || x.o FROM {of('links_to', 'x')} JOIN {of('links_to', 'y')} ON x.s = y.o AND x.o = y.s WHERE x.s <= x.o
UNION SELECT 'cls-maxc1', s || ' {S_}votes ' || o FROM {of('votes', 'x')} WHERE s IN (SELECT s FROM {typed('Archived', 'y')})
UNION SELECT 'prp-npa1', s || ' {S_}genre ' || o FROM {of('genre', 'x')} WHERE s = '<http://kb.example/film/0000001>' AND o = '<http://kb.example/genre/00>'"""


