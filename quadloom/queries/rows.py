"""Queries of what the other modules leave out: patterns and functions over quads and tables, graph operations, updates quad by
quad, stores and formats; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.functions.vocab import RDF, RDFS, XSD, Prefixes
from quadloom.operators import graph_ops
from quadloom.operators.frequency import percentiles, top_values
from quadloom.operators.isomorphism import isomorphic
from quadloom.operators.paths import link, none_of
from quadloom.plans.dataset import Dataset, Resource
from quadloom.plans.graphs import QuadGraph
from quadloom.plans.staging import Staging
from quadloom.queries.reference import FILMS, QUERIES, S_, SQL, _ALL, _G0, _Q, ask, films, over_quads, plan
from quadloom.queries.shapes import quads, with_lists, with_reifiers
from quadloom.queries.tables import BASE, NS, PREFIX, virtual_graph
from quadloom.shacl.rules import RuleSet
from quadloom.sources import io
from quadloom.sources.results import parse_json_results, parse_xml_results, same_solutions, write_json_results, write_xml_results
from quadloom.sparql.compiler import run_query
from quadloom.sparql.update import apply_update

FILM, GENRE, COUNTRY = "http://kb.example/film/0000001", S_ + "genre", S_ + "country"
WHOLE = "s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL"


def whole(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d).where(WHOLE)


def flat(q: DataFrame, *columns: str) -> DataFrame:
    named = {"graph": F.coalesce("g", F.lit("")).alias("graph"), "s": F.col("s.id").alias("s"), "p": F.col("p"), "o": F.col("o.id").alias("o")}
    return q.select(*[named[c] for c in columns or ("s", "p", "o")])


def over(name: str, data, sparql: str, sql: str, **kw) -> None:
    """Register a query over quads that ``data`` makes."""
    QUERIES[name] = lambda spark, d: run_query(QuadGraph(data(spark, d), union_default=True), FILMS + sparql, **kw).ids()
    SQL[name] = sql


def facts(spark: SparkSession, **found) -> DataFrame:
    """Results of operations that give single values: name, value as text."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(k, show(v)) for k, v in found.items()], "name string, value string")


def fact_sql(**wanted) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, {v} AS value" for k, v in wanted.items())


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# the general problems' other figures -----------------------------------------------------------------------------------------
@plan("p1_top_values", """SELECT p, o_id, n_rows, r AS "rank" FROM (SELECT p, o.id AS o_id, count(*) AS n_rows, CAST(row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, o.id) AS INTEGER) AS r
  FROM quads WHERE p IS NOT NULL AND o.id IS NOT NULL GROUP BY p, o.id) x WHERE r <= 3""")
def p1_top_values(spark, d):
    return top_values(quads(spark, d).select("p", F.col("o.id").alias("o_id")), "p", "o_id", 3)


@plan("p1_percentiles", """WITH w AS (SELECT p, batch_no, count(*) AS n FROM quads WHERE p IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT p, batch_no, sum(n) OVER (PARTITION BY p ORDER BY batch_no) AS upto, sum(n) OVER (PARTITION BY p) AS total FROM w)
  SELECT p, min(CASE WHEN upto >= ceil(0.5 * total) THEN batch_no END) AS p50, min(CASE WHEN upto >= ceil(0.9 * total) THEN batch_no END) AS p90, min(CASE WHEN upto >= total THEN batch_no END) AS p100 FROM r GROUP BY p""")
def p1_percentiles(spark, d):
    return percentiles(spark.read.parquet(f"{d}/quads.parquet").select("p", "batch_no"), "p", "batch_no", [0.5, 0.9, 1.0])


# patterns ----------------------------------------------------------------------------------------------------------------------
_REIFIED = f"FROM {_Q} q WHERE p = '{COUNTRY}' AND o <> '<http://kb.example/country/01>'"
over("triple_term_pattern", with_reifiers, "SELECT ?f ?c { ?r rdf:reifies <<( ?f s:country ?c )>> ; s:source ?x }", f"SELECT s AS f, o AS c {_REIFIED} AND o <> '<http://kb.example/country/00>'")
over("annotation_pattern", with_reifiers, "SELECT ?f ?c ?x { ?f s:country ?c {| s:source ?x |} }", f"SELECT s AS f, o AS c, '\"x\"' AS x {_REIFIED} AND o <> '<http://kb.example/country/00>'")
over("fn_triples", with_reifiers, "SELECT ?f (SUBJECT(?t) AS ?a) (PREDICATE(?t) AS ?b) (OBJECT(?t) AS ?c) (ISTRIPLE(?t) AS ?is) (ISTRIPLE(?f) AS ?not) (SAMETERM(?t, TRIPLE(?f, s:country, ?o)) AS ?same) { ?f s:country ?o . ?r rdf:reifies ?t FILTER(SUBJECT(?t) = ?f && OBJECT(?t) = ?o) }",
     f"SELECT s AS f, s AS a, '<{COUNTRY}>' AS b, o AS c, 'true' AS \"is\", 'false' AS \"not\", 'true' AS same {_REIFIED}")
over("collection_pattern", with_lists, "SELECT ?f ?a ?b { ?f s:genre_list ( ?a ?b ) }", f"SELECT s AS f, min(o) AS a, max(o) AS b FROM {_Q} q WHERE p = '{GENRE}' GROUP BY s HAVING count(*) = 2")
over_quads("bnode_property_list", "SELECT ?f ?a { ?f s:starring [ s:actor ?a ; s:character ?c ] }",
    f"WITH q AS {_Q} SELECT x.s AS f, y.o AS a FROM q x JOIN q y ON y.s = x.o AND y.p = '{S_}actor' JOIN q z ON z.s = x.o AND z.p = '{S_}character' WHERE x.p = '{S_}starring'")
ask("empty_pattern", "region", "SELECT (1 AS ?x) (BOUND(?y) AS ?b) {}", "SELECT CAST(1 AS BIGINT) AS x, false AS b")
over("init_bindings", quads, "SELECT ?f { ?f s:genre ?g }", f"SELECT DISTINCT s.id AS f FROM quads WHERE p = '{GENRE}' AND o.id = '<http://kb.example/genre/00>' AND s.id IS NOT NULL", bindings={"g": T.iri("http://kb.example/genre/00")})
over_quads("path_negated_inverse", "SELECT ?x ?y { ?x !(^s:links_to|^s:has_entry|^s:genre|^s:country|^rdf:type|^rdfs:label) ?y }",
    f"SELECT o AS x, s AS y FROM {_Q} q WHERE p NOT IN ('{S_}links_to', '{S_}has_entry', '{GENRE}', '{COUNTRY}', '{RDF.type}', '{RDFS.label}')")
over_quads("minus_inside_optional", "SELECT ?f ?c { ?f rdf:type s:Film OPTIONAL { ?f s:country ?c MINUS { ?f s:votes ?v } } }",
    f"WITH q AS {_Q} SELECT f.s AS f, c.o AS c FROM (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Film>') f LEFT JOIN (SELECT s, o FROM q WHERE p = '{COUNTRY}' AND s NOT IN (SELECT s FROM q WHERE p = '{S_}votes')) c ON c.s = f.s")
over_quads("exists_unbound", "SELECT ?f { ?f rdf:type s:Film OPTIONAL { ?f s:country ?c FILTER(?c = <http://kb.example/country/00>) } FILTER NOT EXISTS { ?x s:country ?c ; s:votes ?v ; rdf:type s:Archived FILTER(?x = ?f) } }",
    f"WITH q AS {_Q} SELECT f.s AS f FROM q f LEFT JOIN q c ON c.s = f.s AND c.p = '{COUNTRY}' AND c.o = '<http://kb.example/country/00>' WHERE f.p = '{RDF.type}' AND f.o = '<{S_}Film>' AND NOT EXISTS (SELECT 1 FROM q x WHERE x.s = f.s AND x.p = '{COUNTRY}' AND (c.o IS NULL OR x.o = c.o) AND x.s IN (SELECT s FROM q WHERE p = '{S_}votes') AND x.s IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Archived>'))")
over_quads("order_mixed_kinds", "SELECT DISTINCT ?g { ?f s:genre ?g } ORDER BY ?g LIMIT 15", f"SELECT o AS g FROM (SELECT DISTINCT s.id AS s, o.id AS o, o.kind AS k FROM quads WHERE p = '{GENRE}' AND s.id IS NOT NULL AND o.id IS NOT NULL) x GROUP BY o, k ORDER BY k, o LIMIT 15")


@plan("path_builder", f"WITH q AS {_Q} SELECT DISTINCT * FROM (SELECT x.s AS s, y.o AS o FROM q x JOIN q y ON y.s = x.o WHERE x.p = '{S_}starring' AND y.p = '{S_}actor' UNION ALL SELECT o, s FROM q WHERE p = '{S_}directed_by' UNION ALL SELECT s, o FROM q WHERE p NOT IN ('{S_}links_to', '{S_}has_entry')) z")
def path_builder(spark, d):
    p = lambda n: link(S_ + n)
    return (p("starring") / p("actor") | ~p("directed_by") | none_of(S_ + "links_to", S_ + "has_entry")).pairs(films(spark, d)).distinct()


# aggregates and forms ------------------------------------------------------------------------------------------------------------
ask("agg_distinct_values", "lineitem", "SELECT ?rf (SUM(DISTINCT ?q) AS ?total) (COUNT(DISTINCT *) AS ?n) (ROUND(AVG(DISTINCT ?q) * 1000) AS ?mean) WHERE { { SELECT ?rf ?q { ?l :l_returnflag ?rf ; :l_quantity ?q } } } GROUP BY ?rf",
    "SELECT l_returnflag AS rf, sum(DISTINCT l_quantity) AS total, count(DISTINCT l_quantity) AS n, round(avg(DISTINCT l_quantity) * 1000) AS mean FROM lineitem GROUP BY 1")
ask("select_star", "nation", "SELECT * WHERE { ?n :n_nationkey ?k ; :n_name ?name }", f"SELECT '{BASE}nation/' || n_nationkey AS n, CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
ask("select_reduced", "lineitem", "SELECT DISTINCT ?rf WHERE { { SELECT REDUCED ?rf { ?l :l_returnflag ?rf } } }", "SELECT DISTINCT l_returnflag AS rf FROM lineitem")
over_quads("agg_terms_numeric", "SELECT (COUNT(?v) AS ?n) (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (SUM(?v) AS ?t) { ?f s:runtime ?v FILTER(DATATYPE(?v) = <http://www.w3.org/2001/XMLSchema#integer> && REGEX(STR(?v), '^[1-9][0-9]*$')) }",
    f"SELECT CAST(count(*) AS VARCHAR) AS n, CAST(min(v) AS VARCHAR) AS lo, CAST(max(v) AS VARCHAR) AS hi, CAST(sum(v) AS VARCHAR) AS t FROM (SELECT DISTINCT s.id AS s, o.id AS o, try_cast(o.lex AS BIGINT) AS v FROM quads WHERE p = '{S_}runtime' AND s.id IS NOT NULL AND o.dt = '{XSD.integer}' AND regexp_matches(o.lex, '^[1-9][0-9]*$')) x")


@plan("construct_where", f"SELECT s, p, o FROM {_Q} q WHERE p = '{S_}directed_by'")
def construct_where(spark, d):
    return flat(run_query(films(spark, d), FILMS + "CONSTRUCT WHERE { ?f s:directed_by ?d }").df)


# functions -----------------------------------------------------------------------------------------------------------------------
ask("fn_logic", "nation", "SELECT ?k (!(?k > 10) AS ?no) (+?k AS ?plus) (?k NOT IN (1, 2) AS ?out) (IF(?k, 'y', 'n') AS ?ebv) (IF(?name, 'y', 'n') AS ?text) (IF('', 'y', 'n') AS ?empty) (?k > 10 || ?zz AS ?either) (?k > 10 && ?zz AS ?both) WHERE { ?n :n_nationkey ?k ; :n_name ?name }",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, NOT n_nationkey > 10 AS no, CAST(n_nationkey AS BIGINT) AS plus, n_nationkey NOT IN (1, 2) AS out, CASE WHEN n_nationkey <> 0 THEN 'y' ELSE 'n' END AS ebv, 'y' AS text, 'n' AS empty, CASE WHEN n_nationkey > 10 THEN true END AS either, CASE WHEN n_nationkey <= 10 THEN false END AS both FROM nation")
ask("fn_constructors", "nation", "SELECT ?k (LANG(STRLANG(?name, 'en')) AS ?lang) (LANGDIR(STRLANGDIR(?name, 'ar', 'rtl')) AS ?dir) (STR(DATATYPE(STRDT(?name, xsd:token))) AS ?dt) (STR(IRI(CONCAT('http://x/', ?name))) AS ?iri) (ISIRI(URI('http://y')) AS ?uri) (ISBLANK(BNODE()) AS ?blank) (HASLANG(STRLANG(?name, 'en')) AS ?has) (HASLANGDIR(STRLANG(?name, 'en')) AS ?hasdir) (LANGMATCHES('en-GB', 'en') AS ?lm) WHERE { ?n :n_nationkey ?k ; :n_name ?name }",
    f"SELECT CAST(n_nationkey AS BIGINT) AS k, 'en' AS lang, 'rtl' AS dir, '{XSD.token}' AS dt, 'http://x/' || n_name AS iri, true AS uri, true AS blank, true AS has, false AS hasdir, true AS lm FROM nation")
ask("fn_times", "nation", "SELECT ?k (HOURS(?t) AS ?h) (SECONDS(?t) AS ?s) (TZ(?t) AS ?tz) (STR(TIMEZONE(?t)) AS ?zone) (TZ('2020-01-01T00:00:00'^^xsd:dateTime) AS ?none) (DATATYPE(NOW()) = xsd:dateTime AS ?now) (NOW() = NOW() AS ?same) WHERE { ?n :n_nationkey ?k BIND('2020-03-04T10:20:30.5-05:30'^^xsd:dateTime AS ?t) }",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(10 AS BIGINT) AS h, CAST(30.5 AS DOUBLE) AS s, '-05:30' AS tz, '-PT5H30M' AS zone, '' AS \"none\", true AS now, true AS same FROM nation")
ask("fn_random", "nation", "SELECT ?k (RAND() >= 0 && RAND() < 1 AS ?r) (ISIRI(UUID()) AS ?u) (STRLEN(STRUUID()) AS ?n) (STRLEN(SHA512(?name)) AS ?long) (STRLEN(SHA384(?name)) AS ?mid) (SHA1(?name) AS ?sha) WHERE { ?x :n_nationkey ?k ; :n_name ?name }",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, true AS r, true AS u, CAST(36 AS BIGINT) AS n, CAST(128 AS BIGINT) AS long, CAST(96 AS BIGINT) AS mid, sha1(n_name) AS sha FROM nation")
over_quads("fn_kinds", "SELECT ?g (ISIRI(?g) AS ?i) (ISBLANK(?g) AS ?b) (ISLITERAL(?g) AS ?l) (ISTRIPLE(?g) AS ?t) { ?f s:genre ?g }",
    f"SELECT o AS g, CASE WHEN o LIKE '<%' THEN 'true' ELSE 'false' END AS i, CASE WHEN o LIKE '\\_:%' ESCAPE '\\' THEN 'true' ELSE 'false' END AS b, CASE WHEN o LIKE '<%' OR o LIKE '\\_:%' ESCAPE '\\' THEN 'false' ELSE 'true' END AS l, 'false' AS t FROM {_Q} q WHERE p = '{GENRE}'")


@plan("static_errors", " UNION ALL ".join(f"SELECT '{k}' AS name, 'true' AS value" for k in ("select_scope", "bind_scope", "unknown_function", "bad_syntax", "aggregate_scope", "service", "rule_head", "rule_negation")))
def static_errors(spark, d):
    """What is refused before anything runs."""
    g = virtual_graph(spark, d, ("nation",))

    def refused(f) -> bool:
        try:
            f()
        except ValueError:  # of the parser, the compiler or the rules
            return True
        return False

    q = lambda body: refused(lambda: run_query(g, PREFIX + body))
    rule = lambda body: refused(lambda: RuleSet.parse("PREFIX : <http://e/> " + body).check().strata())
    return facts(
        spark, select_scope=q("SELECT ?n (1 AS ?n) { ?n :n_name ?m }"), bind_scope=q("SELECT * { ?n :n_name ?m BIND(1 AS ?m) }"), unknown_function=q("SELECT * { ?n :n_name ?m FILTER(<http://e/f>(?m)) }"), bad_syntax=q("SELECT * { ?n :n_name }"),
        aggregate_scope=q("SELECT ?m (COUNT(*) AS ?c) { ?n :n_name ?m } GROUP BY ?n"), service=q("SELECT * { SERVICE <http://e/> { ?n :n_name ?m } }"), rule_head=rule("RULE { ?x :p ?y } WHERE { ?x :q :a }"), rule_negation=rule("RULE { ?x :p :a } WHERE { ?x :q :a NOT { ?x :p :a } }"),
    )


# graphs --------------------------------------------------------------------------------------------------------------------------
for _which, _name in (("s", "subjects"), ("o", "objects"), ("so", "subject_objects"), ("po", "predicate_objects")):
    QUERIES[f"graph_{_name}"] = lambda spark, d, which=_which: graph_ops.parts(quads(spark, d), which)
    SQL[f"graph_{_name}"] = f"SELECT DISTINCT {', '.join(_which)} FROM {_Q} q"


@plan("graph_values", fact_sql(
    least=f"(SELECT min(o.id) FROM quads WHERE s.id = '<{FILM}>' AND p = '{GENRE}')", subject=f"(SELECT min(s.id) FROM quads WHERE p = '{GENRE}' AND o.id = '<http://kb.example/genre/00>')",
    contains=f"(SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END FROM quads WHERE s.id = '<{FILM}>' AND p = '{RDF.type}' AND o.id = '<{S_}Film>')", absent="'false'",
    resource=f"(SELECT CAST(count(DISTINCT o.id) AS VARCHAR) FROM quads WHERE s.id = '<{FILM}>' AND p = '{GENRE}')", back=f"(SELECT CAST(count(DISTINCT s.id) AS VARCHAR) FROM quads WHERE o.id = '<http://kb.example/genre/00>' AND p = '{GENRE}')",
    count=f"(SELECT CAST(count(*) AS VARCHAR) FROM quads WHERE {WHOLE})", exists="'true'", missing="'false'", limited="'7'", offset=f"(SELECT CAST(count(*) - 5 AS VARCHAR) FROM quads WHERE {WHOLE} AND p = '{GENRE}')",
    graphs="(SELECT CAST(count(DISTINCT g) AS VARCHAR) FROM quads WHERE " + WHOLE + ")", without=f"(SELECT CAST(count(*) AS VARCHAR) FROM quads WHERE {WHOLE} AND (g IS NULL OR g <> '{_G0}'))", removed=f"(SELECT CAST(count(*) AS VARCHAR) FROM quads WHERE {WHOLE} AND p <> '{GENRE}')",
))
def graph_values(spark, d):
    q = whole(spark, d)
    ds, film, genre = Dataset(q), T.iri(FILM), "<http://kb.example/genre/00>"
    r = Resource(ds, film)
    return facts(
        spark, least=graph_ops.value(q, s=film.id, p=GENRE), subject=graph_ops.value(q, p=GENRE, o=genre), contains=graph_ops.contains(q, film.id, RDF.type, f"<{S_}Film>"), absent=graph_ops.contains(q, film.id, RDF.type, "<http://none/>"),
        resource=r.objects(GENRE).count(), back=Resource(ds, T.iri(genre[1:-1])).subjects(GENRE).count(), count=ds.count(), exists=ds.exists(p=GENRE), missing=ds.exists(p="http://none/"), limited=ds.triples(p=GENRE, limit=7).count(),
        offset=ds.triples(p=GENRE, offset=5).count(), graphs=ds.graphs().count(), without=ds.remove_graph(_G0).count(), removed=ds.remove(p=GENRE).count(),
    )


@plan("terms_and_names", fact_sql(
    iri="'<http://e/a>'", lang="'\"x\"@en'", typed=text(f'"5"^^<{XSD.byte}>'), short="'5'", parsed="'http://e/a#b'", qname="'ex:b'", unknown="'None'", expanded="'http://e/a#b'", skolem="'<http://e/.well-known/genid/b1>'", base="'http://e/a'", fragment="'b'",
    order="'_:b <http://e/a> \"a\" 2 10'", same="'true'", differ="'false'", detect="'turtle nquads jsonld rdfxml trig'",
))
def terms_and_names(spark, d):
    p = Prefixes({"ex": "http://e/a#"})
    a, b, c = T.iri("http://e/a"), T.bnode("b1"), T.bnode("c1")
    order = sorted([T.literal(10), T.literal("a"), a, T.literal(2), T.bnode("b")], key=lambda t: (t.kind, t.dt == XSD.integer, float(t.lex) if t.dt == XSD.integer else 0, t.id))
    base, fragment = T.defragment(T.iri("http://e/a#b"))
    link_ = T.iri("http://e/p")
    return facts(
        spark, iri=a.id, lang=T.literal("x", lang="en").id, typed=T.literal("5", XSD.byte).id, short=T.literal(5).id, parsed=T.parse_id("<http://e/a#b>").lex, qname=p.qname("http://e/a#b"), unknown=p.qname("http://other/x"), expanded=p.of["ex"] + "b",
        skolem=T.skolemize(b, "http://e/").id, base=base.lex, fragment=fragment, order=" ".join(t.id for t in order), same=isomorphic([(None, a, link_, b), (None, b, link_, a)], [(None, a, link_, c), (None, c, link_, a)]),
        differ=isomorphic([(None, a, link_, b)], [(None, b, link_, a)]), detect=" ".join(str(io.detect(x)) for x in ("a.ttl", "a.nq.gz", "a.jsonld", "a.owl", "a.trig")),
    )


# updates, quad by quad -------------------------------------------------------------------------------------------------------------
def update(name: str, request: str, sql: str, **kw) -> None:
    """``sql`` selects graph, s, p, o from q, all quads."""
    QUERIES[name] = lambda spark, d: flat(apply_update(whole(spark, d), FILMS + request, **{k: v(spark, d) for k, v in kw.items()}), "graph", "s", "p", "o").distinct()
    SQL[name] = f"WITH q AS ({_ALL}) {sql}"


NEW = "http://kb.example/graph/new"
update("update_insert_data", f'INSERT DATA {{ <{FILM}> s:note "n", 5 . GRAPH <{NEW}> {{ <{FILM}> s:note "n"@en }} }} ; CREATE GRAPH <http://kb.example/graph/empty>',
       f"SELECT * FROM q UNION SELECT * FROM (VALUES ('', '<{FILM}>', '{S_}note', '\"n\"'), ('', '<{FILM}>', '{S_}note', '5'), ('{NEW}', '<{FILM}>', '{S_}note', '\"n\"@en')) v")
update("update_delete_data", f"DELETE DATA {{ <{FILM}> rdf:type s:Film . GRAPH <{_G0}> {{ <{FILM}> rdf:type s:Film }} }}", f"SELECT * FROM q WHERE NOT (graph IN ('', '{_G0}') AND s = '<{FILM}>' AND p = '{RDF.type}' AND o = '<{S_}Film>')")
update("update_using", f"INSERT {{ GRAPH <{NEW}> {{ ?f s:seen ?g }} }} USING <{_G0}> WHERE {{ ?f s:genre ?g }} ; INSERT {{ GRAPH <{NEW}> {{ ?f s:named ?x }} }} USING NAMED <{_G0}> WHERE {{ GRAPH ?x {{ ?f s:directed_by ?d }} }}",
       f"SELECT * FROM q UNION SELECT '{NEW}', s, '{S_}seen', o FROM q WHERE graph = '{_G0}' AND p = '{GENRE}' UNION SELECT '{NEW}', s, '{S_}named', '<{_G0}>' FROM q WHERE graph = '{_G0}' AND p = '{S_}directed_by'")
update("update_add", f"ADD <{_G0}> TO <{NEW}> ; ADD SILENT <http://kb.example/none> TO DEFAULT ; CLEAR GRAPH <http://kb.example/graph/01> ; DROP SILENT GRAPH <http://kb.example/none>",
       f"SELECT * FROM q WHERE graph <> 'http://kb.example/graph/01' UNION SELECT '{NEW}', s, p, o FROM q WHERE graph = '{_G0}'")
update("update_clear_named", "CLEAR NAMED", "SELECT * FROM q WHERE graph = ''")
update("update_clear_default", "DROP DEFAULT", "SELECT * FROM q WHERE graph <> ''")
update("update_modify_rows", f"WITH <{_G0}> DELETE {{ ?f s:votes ?v }} INSERT {{ ?f s:ballots ?v }} WHERE {{ ?f s:votes ?v }}", f"SELECT DISTINCT graph, s, CASE WHEN graph = '{_G0}' AND p = '{S_}votes' THEN '{S_}ballots' ELSE p END AS p, o FROM q")
update("update_delete_where_rows", "DELETE WHERE { ?s s:links_to ?o . ?s s:votes ?v }", f"SELECT * FROM q WHERE NOT (graph = '' AND p IN ('{S_}links_to', '{S_}votes') AND s IN (SELECT a.s FROM q a JOIN q b ON a.s = b.s WHERE a.graph = '' AND b.graph = '' AND a.p = '{S_}links_to' AND b.p = '{S_}votes'))")
update("update_load", f"LOAD <http://any> INTO GRAPH <{NEW}>", f"SELECT * FROM q UNION SELECT '{NEW}', '<{BASE}region/' || r_regionkey || '>', '{NS}r_name', '\"' || r_name || '\"' FROM region",
       loader=lambda spark, d: lambda iri: run_query(virtual_graph(spark, d, ("region",)), PREFIX + "CONSTRUCT { ?r :r_name ?n } WHERE { ?r :r_name ?n }").df.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))


@plan("dataset_set_value", f"WITH q AS ({_ALL}) SELECT * FROM q WHERE NOT (graph = '' AND s = '<{FILM}>' AND p = '{S_}votes') UNION SELECT '', '<{FILM}>', '{S_}votes', '7'")
def dataset_set_value(spark, d):
    after = Dataset(whole(spark, d)).set_value((None, T.iri(FILM), T.iri(S_ + "votes"), T.literal(7)))
    return flat(after.quads, "graph", "s", "p", "o").distinct()


# rules -----------------------------------------------------------------------------------------------------------------------------
def rules(name: str, text_: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: flat(RuleSet.parse(f"PREFIX s: <{S_}> PREFIX rdf: <{RDF}> {text_}").infer(quads(spark, d)))
    SQL[name] = f"WITH RECURSIVE t AS {_Q} {sql} EXCEPT SELECT s, p, o FROM t"


rules("srl_filter_bind", 'DATA { s:one s:votes 7 } RULE { ?f s:long_label ?n } WHERE { ?f rdf:type s:Archived . ?f s:genre ?g FILTER(?g = <http://kb.example/genre/00> || ?g = <http://kb.example/genre/01>) BIND(STR(?g) AS ?n) }',
      f"SELECT DISTINCT g.s AS s, '{S_}long_label' AS p, '\"' || substr(g.o, 2, length(g.o) - 2) || '\"' AS o FROM t g JOIN t y ON y.s = g.s AND y.p = '{RDF.type}' AND y.o = '<{S_}Archived>' WHERE g.p = '{GENRE}' AND g.o IN ('<http://kb.example/genre/00>', '<http://kb.example/genre/01>') UNION SELECT '<{S_}one>', '{S_}votes', '7'")
rules("srl_recursive", "RULE { ?x s:reach ?y } WHERE { ?x s:starring ?y } RULE { ?x s:reach ?y } WHERE { ?x s:actor ?y } RULE { ?x s:reach ?z } WHERE { ?x s:reach ?y . ?y s:reach ?z } RULE { ?f s:apart true } WHERE { ?f rdf:type s:Film NOT { ?f s:reach ?z } }",
      f", e AS (SELECT s, o FROM t WHERE p IN ('{S_}starring', '{S_}actor')), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON e.s = r.o) SELECT s, '{S_}reach' AS p, o FROM r UNION SELECT s, '{S_}apart', 'true' FROM t WHERE p = '{RDF.type}' AND o = '<{S_}Film>' AND s NOT IN (SELECT s FROM r)")


# formats: the quads that a text gives back ---------------------------------------------------------------------------------------------
def _through(format: str):
    def run(spark, d):
        """Written in parts by Spark and read back."""
        path = Staging(spark, f"through-{format}").root
        q = whole(spark, d).where(~F.col("o.id").startswith("<<("))
        io.write(q, path, format)
        return flat(io.read(spark, path, format, parts=True), "graph", "s", "p", "o")  # a set already

    return run


for _format in ("turtle", "trig", "rdfxml", "jsonld", "ntriples", "nquads"):
    QUERIES[f"through_{_format}"] = _through(_format)
    # the ids of the table have tabs and line ends as they are, those of read terms have them escaped
    SQL[f"through_{_format}"] = f"""WITH q AS ({_ALL}) SELECT DISTINCT {'graph' if _format in ('trig', 'jsonld', 'nquads') else "'' AS graph"}, s, p, replace(replace(replace(o, chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS o FROM q"""


@plan("through_results", f"SELECT format, '<{BASE}nation/' || n_nationkey || '>' AS n, '\"' || n_name || '\"' AS name FROM nation, (VALUES ('json'), ('xml')) AS v(format)")
def through_results(spark, d):
    """Solutions written as XML and JSON results and read back."""
    solutions = [{"n": T.iri(r["n"]), "name": T.literal(r["name"])} for r in run_query(virtual_graph(spark, d, ("nation",)), PREFIX + "SELECT ?n ?name { ?n :n_name ?name }").df.collect()]  # 25 nations
    back = {"xml": parse_xml_results(write_xml_results(["n", "name"], solutions))[1], "json": parse_json_results(write_json_results(["n", "name"], solutions))[1]}
    assert all(same_solutions(solutions, x) for x in back.values())
    return spark.createDataFrame([(k, r["n"].id, r["name"].id) for k, rows in back.items() for r in rows], "format string, n string, name string")


@plan("dataset_layouts", f"WITH q AS {_Q} SELECT 'predicate' AS layout, s, o FROM q WHERE p = '{GENRE}' UNION ALL SELECT 'graph', s.id, o.id FROM quads WHERE g = '{_G0}' AND {WHOLE} AND p = '{GENRE}' GROUP BY s.id, o.id")
def dataset_layouts(spark, d):
    """The same patterns over quads stored by predicate and by graph; each reads its part of the folders alone."""
    root = Staging(spark, "layouts").root
    ds = Dataset(whole(spark, d))
    for by in ("predicate", "graph"):
        ds.write(f"{root}/{by}", by)
    at = lambda by: Dataset.read(spark, f"{root}/{by}")
    one = at("predicate")
    one.union_default, one.is_set = True, False
    a = one.query(FILMS + "SELECT ?s ?o { ?s s:genre ?o }").ids()
    b = at("graph").query(FILMS + f"SELECT DISTINCT ?s ?o {{ GRAPH <{_G0}> {{ ?s s:genre ?o }} }}").ids()
    return a.select(F.lit("predicate").alias("layout"), "s", "o").unionByName(b.select(F.lit("graph").alias("layout"), "s", "o"))


__all__ = ["QUERIES", "SQL"]
