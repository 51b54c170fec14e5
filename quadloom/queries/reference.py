"""One query or more per group of the engine's operators, over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import iri_term, literal_term, term_of_id
from quadloom.functions.vocab import OWL, RDF, RDFS, XSD
from quadloom.operators import graph_ops
from quadloom.plans.graphs import QuadGraph
from quadloom.queries.tables import BASE, NS, PREFIX, virtual_graph
from quadloom.shacl.rules import RuleSet
from quadloom.shacl.validate import validate
from quadloom.sources.turtle import parse_turtle
from quadloom.sparql.compiler import run_query
from quadloom.sparql.update import apply_update

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ask(name: str, tables: str, sparql: str, sql: str) -> None:
    """Register a query over the virtual graph of some tables."""
    QUERIES[name] = lambda spark, d: run_query(virtual_graph(spark, d, tuple(tables.split())), PREFIX + sparql).df
    SQL[name] = sql


def plan(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# graph patterns ----------------------------------------------------------------------------------------------------------
ask("bgp_star_agg", "lineitem",
    "SELECT ?rf ?ls (SUM(?q) AS ?sum_qty) (COUNT(*) AS ?n) WHERE { ?l a :Lineitem ; :l_returnflag ?rf ; :l_linestatus ?ls ; :l_quantity ?q ; :l_discount ?d . FILTER(?d <= 0.05) } GROUP BY ?rf ?ls",
    "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_discount <= 0.05 GROUP BY 1, 2")
ask("bgp_chain_join", "orders customer nation region",
    "SELECT ?r (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c . ?c :c_nation ?na . ?na :n_region ?re . ?re :r_name ?r } GROUP BY ?r",
    "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("bgp_constants", "nation region",
    "SELECT ?name WHERE { ?n :n_region <http://ex.org/region/1> ; :n_name ?name }",
    "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
ask("bgp_wild_predicate", "nation region",
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s a :Nation ; ?p ?o } GROUP BY ?p",
    f"SELECT p, count(*) AS n FROM nation, (VALUES ('{RDF.type}'), ('{NS}n_nationkey'), ('{NS}n_name'), ('{NS}n_regionkey'), ('{NS}n_region')) AS v(p) GROUP BY p")
ask("optional_filter", "customer orders",
    "SELECT ?c ?o WHERE { ?c a :Customer ; :c_acctbal ?b OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 250000 && ?b < 5000) } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, CASE WHEN o_orderkey IS NOT NULL THEN '{BASE}orders/' || o_orderkey END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 AND c_acctbal < 5000")
ask("union_types", "customer supplier",
    "SELECT ?name ?b WHERE { { ?x :c_name ?name ; :c_acctbal ?b } UNION { ?x :s_name ?name ; :s_acctbal ?b } }",
    "SELECT c_name AS name, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
ask("minus", "customer orders",
    "SELECT ?c WHERE { ?c a :Customer MINUS { ?o :o_customer ?c ; :o_orderstatus 'F' } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
ask("not_exists", "customer orders",
    "SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :o_customer ?c } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
ask("exists_or", "customer orders",
    "SELECT ?c WHERE { ?c a :Customer ; :c_mktsegment ?m FILTER(?m = 'BUILDING' || EXISTS { ?o :o_customer ?c ; :o_orderstatus 'P' }) }",
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
ask("exists_correlated", "customer orders",
    "SELECT ?c WHERE { ?c a :Customer ; :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > ?b * 40) } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
ask("values_undef", "nation",
    "SELECT ?name ?tag WHERE { VALUES (?k ?tag) { (1 'one') (2 'two') (UNDEF 'any') } ?n :n_nationkey ?k ; :n_name ?name }",
    "SELECT n_name AS name, tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (NULL, 'any')) AS v(k, tag) ON n_nationkey = k OR k IS NULL")
ask("bind_coalesce", "customer orders",
    "SELECT ?c ?v WHERE { ?c a :Customer OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 400000) } BIND(COALESCE(?t, 0.0e0) AS ?v) }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, coalesce(o_totalprice, 0.0) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
ask("if_case", "part",
    "SELECT ?size (COUNT(*) AS ?n) WHERE { ?p :p_size ?s BIND(IF(?s > 25, 'large', 'small') AS ?size) } GROUP BY ?size",
    "SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, count(*) AS n FROM part GROUP BY 1")
ask("optional_then_join", "customer orders nation",
    "SELECT ?c ?x ?name WHERE { ?c :c_nation ?n OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 420000) BIND(?n AS ?x0) } ?n :n_name ?name BIND(IF(BOUND(?o), 1, 0) AS ?x) }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, CAST(CASE WHEN o_orderkey IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS x, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 420000")
ask("join_unbound", "customer supplier nation",
    "SELECT ?name ?c ?s WHERE { { SELECT ?n ?name { ?n :n_name ?name } } OPTIONAL { ?c :c_nation ?n ; :c_acctbal ?b FILTER(?b > 9800) } OPTIONAL { ?s :s_nation ?n ; :s_acctbal ?d FILTER(?d < 0) } }",
    f"SELECT n_name AS name, CASE WHEN c_custkey IS NOT NULL THEN '{BASE}customer/' || c_custkey END AS c, CASE WHEN s_suppkey IS NOT NULL THEN '{BASE}supplier/' || s_suppkey END AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9800 LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0")
ask("subquery_topk", "customer nation",
    "SELECT ?name ?b WHERE { { SELECT ?c ?b { ?c :c_acctbal ?b ; :c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 10 } ?c :c_name ?name }",
    "SELECT c_name AS name, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")

# aggregation and modifiers -------------------------------------------------------------------------------------------------
ask("agg_distinct", "lineitem",
    "SELECT ?rf (COUNT(DISTINCT ?p) AS ?parts) (COUNT(DISTINCT ?s) AS ?supps) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) WHERE { ?l :l_returnflag ?rf ; :l_part ?p ; :l_supplier ?s ; :l_quantity ?q } GROUP BY ?rf",
    "SELECT l_returnflag AS rf, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
ask("agg_avg", "orders",
    "SELECT ?s (ROUND(AVG(?t) * 100) / 100 AS ?mean) WHERE { ?o :o_orderstatus ?s ; :o_totalprice ?t } GROUP BY ?s",
    "SELECT o_orderstatus AS s, round(avg(o_totalprice) * 100) / 100 AS mean FROM orders GROUP BY 1")
ask("group_concat", "nation region",
    "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x :n_name ?n ; :n_region ?y . ?y :r_name ?r } GROUP BY ?r",
    "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("sample_min", "part",
    "SELECT ?b (SAMPLE(?n) AS ?any) WHERE { ?p :p_brand ?b ; :p_name ?n } GROUP BY ?b",
    "SELECT p_brand AS b, min(p_name) AS any FROM part GROUP BY 1".replace("AS any", 'AS "any"'))
ask("having", "orders",
    "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :o_custkey ?c } GROUP BY ?c HAVING (COUNT(*) > 15)",
    "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
ask("empty_group", "region",
    "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?total) WHERE { ?r :r_regionkey ?k FILTER(?k > 100) }",
    "SELECT count(*) AS n, CAST(coalesce(sum(r_regionkey), 0) AS BIGINT) AS total FROM region WHERE r_regionkey > 100")
ask("order_offset_limit", "orders",
    "SELECT ?k ?t WHERE { ?o :o_orderkey ?k ; :o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20 OFFSET 5",
    "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
ask("distinct_pairs", "lineitem",
    "SELECT DISTINCT ?rf ?ls WHERE { ?l :l_returnflag ?rf ; :l_linestatus ?ls }",
    "SELECT DISTINCT l_returnflag AS rf, l_linestatus AS ls FROM lineitem")
ask("values_trailing", "nation",
    "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x :n_regionkey ?k } GROUP BY ?k VALUES ?k { 1 2 }",
    "SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2) GROUP BY 1")
ask("ask_true", "orders", "ASK { ?o :o_orderstatus 'F' }", "SELECT count(*) > 0 AS result FROM orders WHERE o_orderstatus = 'F'")
ask("ask_false", "orders", "ASK { ?o :o_orderstatus 'X' }", "SELECT count(*) > 0 AS result FROM orders WHERE o_orderstatus = 'X'")


@plan("construct_edges", f"SELECT DISTINCT '<{BASE}customer/' || o_custkey || '>' AS s, '{NS}ordered' AS p, '<{BASE}orders/' || o_orderkey || '>' AS o FROM orders WHERE o_orderstatus = 'P'")
def construct_edges(spark, d):
    r = run_query(virtual_graph(spark, d, ("orders", "customer")), PREFIX + "CONSTRUCT { ?c :ordered ?o } WHERE { ?o :o_customer ?c ; :o_orderstatus 'P' }")
    return r.df.select(F.col("s.id").alias("s"), "p", F.col("o.id").alias("o"))


# functions -----------------------------------------------------------------------------------------------------------------
ask("fn_string", "customer",
    "SELECT ?k (STRLEN(?n) AS ?len) (SUBSTR(?n, 3, 4) AS ?sub) (UCASE(?m) AS ?up) (LCASE(?m) AS ?low) (CONCAT(?n, '/', ?m) AS ?cat) (STRBEFORE(?n, '#') AS ?bef) (STRAFTER(?n, '#') AS ?aft) (CONTAINS(?n, '1') AS ?has) (STRSTARTS(?m, 'B') AS ?st) (STRENDS(?m, 'G') AS ?en) (ENCODE_FOR_URI(?m) AS ?enc) WHERE { ?c :c_custkey ?k ; :c_name ?n ; :c_mktsegment ?m }",
    "SELECT c_custkey AS k, CAST(length(c_name) AS BIGINT) AS len, substr(c_name, 3, 4) AS sub, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, c_name || '/' || c_mktsegment AS cat, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, 1, instr(c_name, '#') - 1) ELSE '' END AS bef, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS aft, contains(c_name, '1') AS has, starts_with(c_mktsegment, 'B') AS st, c_mktsegment LIKE '%G' AS en, c_mktsegment AS enc FROM customer")
ask("fn_numeric", "supplier",
    "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?k * 2 + 1 AS ?odd) (-?k AS ?neg) (ISNUMERIC(?b) AS ?num) (?b / 0 AS ?inf) WHERE { ?s :s_suppkey ?k ; :s_acctbal ?b }",
    "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r, s_suppkey * 2 + 1 AS odd, -s_suppkey AS neg, true AS num, CAST(NULL AS DOUBLE) AS inf FROM supplier")
ask("fn_datetime", "orders",
    "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d FILTER(?d >= '1995-01-01T00:00:00Z'^^xsd:dateTime && ?d < '1996-01-01T00:00:00Z'^^xsd:dateTime) }",
    "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
ask("fn_hash", "region",
    "SELECT ?n (MD5(?n) AS ?md) (SHA256(?n) AS ?sha) WHERE { ?r :r_name ?n }",
    "SELECT r_name AS n, md5(r_name) AS md, sha256(r_name) AS sha FROM region")
ask("fn_cast", "part",
    "SELECT ?k (xsd:string(?s) AS ?st) (xsd:integer(?p) AS ?i) (xsd:double(?s) AS ?d) (xsd:boolean(?s - 1) AS ?b) (xsd:integer(?n) AS ?bad) WHERE { ?x :p_partkey ?k ; :p_size ?s ; :p_retailprice ?p ; :p_name ?n }",
    "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS st, CAST(floor(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, p_size <> 1 AS b, CAST(NULL AS BIGINT) AS bad FROM part")
ask("fn_regex", "part",
    "SELECT ?k (REPLACE(?t, '[AEIOU]', '*') AS ?r) WHERE { ?x :p_partkey ?k ; :p_type ?t FILTER(REGEX(?t, '^[a-m]', 'i')) }",
    "SELECT p_partkey AS k, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS r FROM part WHERE regexp_matches(p_type, '^[A-Ma-m]')")
ask("fn_terms", "nation",
    "SELECT ?k (STR(?n) AS ?iri) (ISIRI(?n) AS ?is) (ISLITERAL(?name) AS ?lit) (DATATYPE(?name) AS ?dt) (LANG(?name) AS ?lang) (SAMETERM(?n, <http://ex.org/nation/3>) AS ?same) (BOUND(?zz) AS ?bd) (?k IN (1, 2) AS ?inn) WHERE { ?n :n_nationkey ?k ; :n_name ?name }",
    f"SELECT CAST(n_nationkey AS BIGINT) AS k, '{BASE}nation/' || n_nationkey AS iri, true AS is, true AS lit, '{XSD.string}' AS dt, '' AS lang, n_nationkey = 3 AS same, false AS bd, n_nationkey IN (1, 2) AS inn FROM nation".replace(" AS is,", ' AS "is",'))


# paths over the quads of the film graph --------------------------------------------------------------------------------------
S_ = "http://kb.example/schema#"
FILMS = f"PREFIX s: <{S_}>\nPREFIX rdf: <{RDF}>\nPREFIX rdfs: <{RDFS}>\n"
_Q = "(SELECT DISTINCT s.id AS s, p, o.id AS o FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL)"


def films(spark: SparkSession, d: str) -> QuadGraph:
    return QuadGraph(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"), union_default=True)


def over_quads(name: str, sparql: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: run_query(films(spark, d), FILMS + sparql).ids()
    SQL[name] = sql


over_quads("quads_star", "SELECT ?f ?d ?g WHERE { ?f s:directed_by ?d ; s:genre ?g ; rdf:type s:Film }",
    f"WITH q AS {_Q} SELECT a.s AS f, a.o AS d, b.o AS g FROM q a JOIN q b ON a.s = b.s AND b.p = '{S_}genre' JOIN q c ON c.s = a.s AND c.p = '{RDF.type}' AND c.o = '<{S_}Film>' WHERE a.p = '{S_}directed_by'")
over_quads("path_seq", "SELECT ?f ?a WHERE { ?f s:starring/s:actor ?a }",
    f"WITH q AS {_Q} SELECT x.s AS f, y.o AS a FROM q x JOIN q y ON x.o = y.s WHERE x.p = '{S_}starring' AND y.p = '{S_}actor'")
over_quads("path_alt", "SELECT ?s ?o WHERE { ?s s:directed_by|s:actor ?o }",
    f"WITH q AS {_Q} SELECT s, o FROM q WHERE p IN ('{S_}directed_by', '{S_}actor')")
over_quads("path_inverse", "SELECT ?p ?f WHERE { ?p ^s:starring ?f }",
    f"WITH q AS {_Q} SELECT o AS p, s AS f FROM q WHERE p = '{S_}starring'")
over_quads("path_negated", "SELECT ?o (COUNT(*) AS ?n) WHERE { ?s !(s:links_to|s:has_entry|rdf:type|rdfs:label) ?o } GROUP BY ?o",
    f"WITH q AS {_Q} SELECT o, CAST(count(*) AS VARCHAR) AS n FROM q WHERE p NOT IN ('{S_}links_to', '{S_}has_entry', '{RDF.type}', '{RDFS.label}') GROUP BY o")
over_quads("path_plus", "SELECT ?x WHERE { <http://kb.example/film/0000050> s:links_to+ ?x }",
    f"WITH RECURSIVE q AS (SELECT DISTINCT s.id AS s, o.id AS o FROM quads WHERE p = '{S_}links_to' AND s.id IS NOT NULL AND o.id IS NOT NULL), r AS (SELECT o AS x FROM q WHERE s = '<http://kb.example/film/0000050>' UNION SELECT q.o FROM r JOIN q ON q.s = r.x) SELECT x FROM r")
over_quads("path_star", "SELECT ?x WHERE { <http://kb.example/film/0000050> s:links_to* ?x }",
    f"WITH RECURSIVE q AS (SELECT DISTINCT s.id AS s, o.id AS o FROM quads WHERE p = '{S_}links_to' AND s.id IS NOT NULL AND o.id IS NOT NULL), r AS (SELECT '<http://kb.example/film/0000050>' AS x UNION SELECT q.o FROM r JOIN q ON q.s = r.x) SELECT x FROM r")
over_quads("path_opt", "SELECT ?x WHERE { <http://kb.example/film/0000050> s:links_to? ?x }",
    f"SELECT DISTINCT o.id AS x FROM quads WHERE p = '{S_}links_to' AND s.id = '<http://kb.example/film/0000050>' AND o.id IS NOT NULL UNION SELECT '<http://kb.example/film/0000050>'")
_NODES = f"SELECT s AS a, s AS b FROM {_Q} n UNION SELECT o, o FROM {_Q} n"
_CAST = f"e AS (SELECT DISTINCT s AS a, o AS b FROM {_Q} q WHERE p IN ('{S_}starring', '{S_}actor')), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)"
over_quads("path_opt_all", "SELECT ?s ?x WHERE { ?s s:links_to? ?x }", f"SELECT a AS s, b AS x FROM ({_NODES} UNION SELECT s, o FROM {_Q} q WHERE p = '{S_}links_to') z")
over_quads("path_plus_all", "SELECT ?s ?x WHERE { ?s (s:starring|s:actor)+ ?x }", f"WITH RECURSIVE {_CAST} SELECT a AS s, b AS x FROM r")
over_quads("path_star_all", "SELECT ?s ?x WHERE { ?s (s:starring|s:actor)* ?x }", f"WITH RECURSIVE {_CAST} SELECT a AS s, b AS x FROM (SELECT a, b FROM r UNION {_NODES}) z")
over_quads("quads_optional_minus", "SELECT ?f ?c WHERE { ?f rdf:type s:Film OPTIONAL { ?f s:in_colour ?c } MINUS { ?f s:votes ?v } }",
    f"WITH q AS {_Q} SELECT f.s AS f, c.o AS c FROM q f LEFT JOIN q c ON c.s = f.s AND c.p = '{S_}in_colour' WHERE f.p = '{RDF.type}' AND f.o = '<{S_}Film>' AND f.s NOT IN (SELECT s FROM q WHERE p = '{S_}votes')")
over_quads("quads_filter_lang", "SELECT ?s ?l WHERE { ?s rdfs:label ?l FILTER(LANGMATCHES(LANG(?l), 'en')) }",
    f"SELECT DISTINCT s.id AS s, o.id AS l FROM quads WHERE p = '{RDFS.label}' AND s.id IS NOT NULL AND o.kind = 2 AND (lower(o.lang) = 'en' OR lower(o.lang) LIKE 'en-%')")
QUERIES["quads_graph_var"] = lambda spark, d: run_query(QuadGraph(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o")), FILMS + "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s rdf:type s:Film } } GROUP BY ?g").df
SQL["quads_graph_var"] = f"SELECT g, count(*) AS n FROM (SELECT DISTINCT g, s.id AS s FROM quads WHERE g IS NOT NULL AND s.id IS NOT NULL AND p = '{RDF.type}' AND o.id = '<{S_}Film>') x GROUP BY g"


# graph operations ------------------------------------------------------------------------------------------------------------
def _two(spark, d):
    q = spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o")
    return q.where("g = 'http://kb.example/graph/00'"), q.where("g = 'http://kb.example/graph/01'")


def _flat(df):
    return df.select(F.col("s.id").alias("s"), "p", F.col("o.id").alias("o"))


_A = "SELECT s.id AS s, p, o.id AS o FROM quads WHERE g = 'http://kb.example/graph/00' AND s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL"
_B = _A.replace("graph/00", "graph/01")
for _name, _op, _f in (("union", "UNION", graph_ops.union), ("intersection", "INTERSECT", graph_ops.intersection), ("difference", "EXCEPT", graph_ops.difference)):
    QUERIES[f"graph_{_name}"] = lambda spark, d, f=_f: _flat(f(*_two(spark, d)))
    SQL[f"graph_{_name}"] = f"{_A} {_op} {_B}"


@plan("graph_all_nodes", f"WITH q AS {_Q} SELECT s AS node FROM q UNION SELECT o FROM q".replace(" AND p IS NOT NULL", ""))
def all_nodes(spark, d):
    return graph_ops.all_nodes(spark.read.parquet(f"{d}/quads.parquet"))


@plan("graph_predicates", f"WITH q AS {_Q} SELECT DISTINCT s, p FROM q")
def subject_predicates(spark, d):
    return graph_ops.parts(spark.read.parquet(f"{d}/quads.parquet"), "sp")


@plan("graph_connected", """WITH RECURSIVE e AS (SELECT s.id AS a, o.id AS b FROM quads WHERE s.id IS NOT NULL AND o.id IS NOT NULL UNION SELECT o.id, s.id FROM quads WHERE s.id IS NOT NULL AND o.id IS NOT NULL),
r AS (SELECT min(a) AS x FROM e UNION SELECT e.b FROM r JOIN e ON e.a = r.x) SELECT (SELECT count(*) FROM r) = (SELECT count(DISTINCT a) FROM e) AS connected""")
def graph_connected(spark, d):
    return graph_ops.connected(spark.read.parquet(f"{d}/quads.parquet"))


@plan("graph_pattern_count", f"SELECT count(*) AS n FROM quads WHERE p = '{S_}genre' AND o.id = '<http://kb.example/genre/00>'")
def pattern_count(spark, d):
    q = spark.read.parquet(f"{d}/quads.parquet")
    return graph_ops.match(q, p=S_ + "genre", o="<http://kb.example/genre/00>").agg(F.count(F.lit(1)).alias("n"))


# updates -----------------------------------------------------------------------------------------------------------------------
def _updated(spark, d, text):
    q = spark.read.parquet(f"{d}/quads.parquet").where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select("g", "s", "p", "o")
    after = apply_update(q, FILMS + text)
    return after.groupBy(F.coalesce("g", F.lit("")).alias("graph"), "p").agg(F.count_distinct(F.struct("s.id", "o.id")).alias("n"))


_ALL = "SELECT DISTINCT coalesce(g, '') AS graph, s.id AS s, p, o.id AS o FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL"
_G0 = "http://kb.example/graph/00"


@plan("update_insert_where", f"WITH q AS ({_ALL}) SELECT graph, p, count(*) AS n FROM (SELECT * FROM q UNION SELECT '', o, '{S_}genre_of', s FROM q WHERE p = '{S_}genre' AND graph = '{_G0}' AND o LIKE '<%') x GROUP BY 1, 2")
def update_insert_where(spark, d):
    return _updated(spark, d, f"INSERT {{ ?g s:genre_of ?f }} WHERE {{ GRAPH <{_G0}> {{ ?f s:genre ?g FILTER(ISIRI(?g)) }} }}")


@plan("update_delete_where", f"WITH q AS ({_ALL}) SELECT graph, p, count(*) AS n FROM q WHERE NOT (graph = '' AND p = '{S_}links_to') GROUP BY 1, 2")
def update_delete_where(spark, d):
    return _updated(spark, d, "DELETE WHERE { ?s s:links_to ?o }")


@plan("update_modify", f"WITH q AS ({_ALL}) SELECT graph, p, count(*) AS n FROM (SELECT graph, s, CASE WHEN graph = '{_G0}' AND p = '{S_}votes' THEN '{S_}ballots' ELSE p END AS p, o FROM q) x GROUP BY 1, 2")
def update_modify(spark, d):
    return _updated(spark, d, f"WITH <{_G0}> DELETE {{ ?f s:votes ?v }} INSERT {{ ?f s:ballots ?v }} WHERE {{ ?f s:votes ?v }}")


@plan("update_copy_move", f"WITH q AS ({_ALL}), c AS (SELECT * FROM q WHERE graph <> 'http://kb.example/graph/02' UNION SELECT 'http://kb.example/graph/02', s, p, o FROM q WHERE graph = '{_G0}'), m AS (SELECT CASE WHEN graph = 'http://kb.example/graph/01' THEN 'http://kb.example/new' ELSE graph END AS graph, s, p, o FROM c) SELECT graph, p, count(*) AS n FROM m WHERE graph <> 'http://kb.example/graph/03' GROUP BY 1, 2")
def update_copy_move(spark, d):
    return _updated(spark, d, f"COPY <{_G0}> TO <http://kb.example/graph/02> ; MOVE <http://kb.example/graph/01> TO <http://kb.example/new> ; DROP GRAPH <http://kb.example/graph/03>")


# reasoning -----------------------------------------------------------------------------------------------------------------------
def _with_schema(spark, d, turtle: str):
    """All quads and a schema."""
    from quadloom.plans.graphs import frame_of_terms

    head = f"@prefix s: <{S_}> . @prefix rdfs: <{RDFS}> . @prefix owl: <{OWL}> .\n"
    q = spark.read.parquet(f"{d}/quads.parquet").where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select("g", "s", "p", "o")
    return q.unionByName(frame_of_terms(spark, parse_turtle(head + turtle)))


def _added(spark, d, turtle, regimes):
    from quadloom.reasoning.rules import expand

    return _flat(expand(_with_schema(spark, d, turtle), regimes)[1])


_D = f"SELECT DISTINCT s.id AS s, p, o.id AS o, o.kind AS k FROM quads WHERE s.id IS NOT NULL AND o.id IS NOT NULL AND p IN ('{S_}directed_by', '{S_}actor')"


_WORKS = "s:directed_by rdfs:domain s:Work ; rdfs:range s:Person ; rdfs:subPropertyOf s:involves . s:actor rdfs:range s:Person ; rdfs:subPropertyOf s:involves . s:Work rdfs:subClassOf s:Thing . s:Person rdfs:subClassOf s:Thing ."


@plan("rdfs_closure", f"""WITH t AS {_Q}, q AS ({_D}), x AS (
  SELECT s, '{RDF.type}' AS p, '<{S_}Work>' AS o FROM q WHERE p = '{S_}directed_by' UNION SELECT s, '{RDF.type}', '<{S_}Thing>' FROM q WHERE p = '{S_}directed_by'
  UNION SELECT o, '{RDF.type}', '<{S_}Person>' FROM q WHERE k <> 2 UNION SELECT o, '{RDF.type}', '<{S_}Thing>' FROM q WHERE k <> 2 UNION SELECT s, '{S_}involves', o FROM q
  UNION SELECT s, '{RDF.type}', '<{S_}Thing>' FROM t WHERE p = '{RDF.type}' AND o IN ('<{S_}Work>', '<{S_}Person>')) SELECT s, p, o FROM x EXCEPT SELECT s, p, o FROM t""")
def rdfs_closure_query(spark, d):
    return _added(spark, d, _WORKS, {"rdfs"})


@plan("owl_inverse_symmetric", f"""WITH q AS (SELECT DISTINCT s.id AS s, p, o.id AS o FROM quads WHERE s.id IS NOT NULL AND o.id IS NOT NULL AND o.kind <> 2 AND p IN ('{S_}directed_by', '{S_}film'))
  SELECT o AS s, '{S_}directs' AS p, s AS o FROM q WHERE p = '{S_}directed_by' UNION SELECT o, '{S_}film', s FROM q x WHERE p = '{S_}film' AND NOT EXISTS (SELECT 1 FROM q y WHERE y.p = x.p AND y.s = x.o AND y.o = x.s)""")
def owl_inverse_symmetric(spark, d):
    return _added(spark, d, "s:directed_by owl:inverseOf s:directs . s:film a owl:SymmetricProperty .", {"owlrl"})


# shapes ---------------------------------------------------------------------------------------------------------------------------
_SHAPES = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <{XSD}> . @prefix s: <{S_}> . @prefix : <{S_}> . @prefix rdfs: <{RDFS}> .
:FilmShape a sh:NodeShape ; sh:targetClass s:Film ;
  sh:property [ sh:path s:directed_by ; sh:minCount 1 ; sh:maxCount 2 ; sh:nodeKind sh:IRI ] , [ sh:path s:runtime ; sh:datatype xsd:integer ; sh:maxInclusive 240 ] ,
    [ sh:path s:in_colour ; sh:in (true false "1"^^xsd:boolean "0"^^xsd:boolean) ] , [ sh:path rdfs:label ; sh:pattern "^The " ; sh:uniqueLang true ] .
"""
_F = f"films AS (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Film>')"
_QK = "(SELECT DISTINCT s.id AS s, p, o.id AS o, o.kind AS k, o.lex AS lex, o.dt AS dt, o.lang AS lang FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL)"


@plan("shacl_counts_by_component", f"""WITH q AS {_QK}, {_F}, v AS (SELECT q.* FROM q JOIN films ON films.s = q.s),
  n AS (SELECT films.s, count(v.o) AS n FROM films LEFT JOIN v ON v.s = films.s AND v.p = '{S_}directed_by' GROUP BY films.s)
SELECT component, count(*) AS n FROM (
  SELECT 'MinCount' AS component FROM n WHERE n < 1 UNION ALL SELECT 'MaxCount' FROM n WHERE n > 2 UNION ALL SELECT 'NodeKind' FROM v WHERE p = '{S_}directed_by' AND k <> 1
  UNION ALL SELECT 'Datatype' FROM v WHERE p = '{S_}runtime' AND NOT (k = 2 AND coalesce(dt, '{XSD.string}') = '{XSD.integer}' AND regexp_matches(lex, '^[+-]?[0-9]+$'))
  UNION ALL SELECT 'MaxInclusive' FROM v WHERE p = '{S_}runtime' AND NOT coalesce(k = 2 AND dt IN ('{XSD.integer}', '{XSD.int}', '{XSD.decimal}', '{XSD.double}', '{XSD.float}', '{XSD.long}') AND regexp_matches(lex, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') AND try_cast(lex AS DOUBLE) <= 240, false)
  UNION ALL SELECT 'In' FROM v WHERE p = '{S_}in_colour' AND NOT (dt = '{XSD.boolean}' AND lex IN ('true', 'false', '1', '0') AND k = 2)
  UNION ALL SELECT 'Pattern' FROM v WHERE p = '{RDFS.label}' AND NOT (k <> 0 AND lex LIKE 'The %')
  UNION ALL SELECT 'UniqueLang' FROM (SELECT s, lang_ FROM (SELECT s, regexp_extract(o, '@([A-Za-z0-9-]+)$', 1) AS lang_ FROM v WHERE p = '{RDFS.label}' AND lang IS NOT NULL) y GROUP BY s, lang_ HAVING count(*) > 1) z) w GROUP BY component""")
def shacl_counts(spark, d):
    r = validate(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"), parse_turtle(_SHAPES))
    return r.df.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


_LOGIC = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix s: <{S_}> . @prefix : <{S_}> . @prefix rdfs: <{RDFS}> .
:L sh:targetClass s:Film ; sh:or ( [ sh:property [ sh:path s:votes ; sh:minCount 1 ] ] [ sh:property [ sh:path s:rating ; sh:minCount 1 ] ] ) ; sh:not [ sh:property [ sh:path s:genre ; sh:minCount 3 ] ] ;
  sh:property [ sh:path s:starring ; sh:class s:Performance ; sh:qualifiedValueShape [ sh:property [ sh:path s:actor ; sh:minCount 1 ] ] ; sh:qualifiedMinCount 1 ] ; sh:property [ sh:path s:votes ; sh:disjoint s:runtime ] .
"""


@plan("shacl_logical", f"""WITH q AS {_QK}, {_F}, c AS (SELECT films.s, count(CASE WHEN p = '{S_}votes' THEN 1 END) AS votes, count(CASE WHEN p = '{S_}rating' THEN 1 END) AS rating, count(CASE WHEN p = '{S_}genre' THEN 1 END) AS genre FROM films JOIN q ON q.s = films.s GROUP BY films.s),
  st AS (SELECT films.s, q.o FROM films JOIN q ON q.s = films.s AND q.p = '{S_}starring'), ac AS (SELECT DISTINCT s FROM q WHERE p = '{S_}actor')
SELECT component, count(*) AS n FROM (SELECT 'Or' AS component FROM c WHERE votes = 0 AND rating = 0 UNION ALL SELECT 'Not' FROM c WHERE genre >= 3
  UNION ALL SELECT 'Class' FROM st WHERE o NOT IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Performance>')
  UNION ALL SELECT 'QualifiedMinCount' FROM films WHERE s NOT IN (SELECT st.s FROM st JOIN ac ON ac.s = st.o)
  UNION ALL SELECT 'Disjoint' FROM q a JOIN films ON films.s = a.s WHERE a.p = '{S_}votes' AND EXISTS (SELECT 1 FROM q b WHERE b.s = a.s AND b.p = '{S_}runtime' AND b.o = a.o)) w GROUP BY component""")
def shacl_logical(spark, d):
    r = validate(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"), parse_turtle(_LOGIC))
    return r.df.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


@plan("srl_stratified_not", f"""WITH q AS {_Q}, m AS (SELECT DISTINCT x.s AS f, y.o AS a FROM q x JOIN q y ON y.s = x.o WHERE x.p = '{S_}starring' AND y.p = '{S_}actor')
  SELECT f AS s, '{S_}cast_member' AS p, a AS o FROM m UNION SELECT s, '{S_}without_cast', 'true' FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Film>' AND s NOT IN (SELECT f FROM m)""")
def srl_stratified_not(spark, d):
    rules = RuleSet.parse(f"PREFIX s: <{S_}> PREFIX rdf: <{RDF}> RULE {{ ?f s:cast_member ?a }} WHERE {{ ?f s:starring ?p . ?p s:actor ?a }} RULE {{ ?f s:without_cast true }} WHERE {{ ?f rdf:type s:Film NOT {{ ?f s:cast_member ?x }} }}")
    return _flat(rules.infer(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o")))


# lines and terms -------------------------------------------------------------------------------------------------------------------
@plan("lines_round_trip", "SELECT coalesce(g, '') AS g, count(DISTINCT (s.id, p, o.id)) AS n FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL GROUP BY 1")
def lines_round_trip(spark, d):
    from quadloom.sources.lines import line_column, parse_lines

    q = spark.read.parquet(f"{d}/quads.parquet").where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL")
    back = parse_lines(q.select(line_column().alias("value")))
    return back.groupBy(F.coalesce("g", F.lit("")).alias("g")).agg(F.count_distinct(F.struct("s.id", "p", "o.id")).alias("n"))


@plan("terms_of_ids", "SELECT DISTINCT o.id AS id, o.kind AS kind, o.lex AS lex, regexp_extract(o.id, '\"@([A-Za-z0-9-]+)$', 1) AS lang FROM quads WHERE o.id IS NOT NULL")
def terms_of_ids(spark, d):
    ids = spark.read.parquet(f"{d}/quads.parquet").select(F.col("o.id").alias("id")).where("id IS NOT NULL").distinct()
    return ids.select(term_of_id(F.col("id")).alias("t")).select("t.id", "t.kind", "t.lex", F.coalesce("t.lang", F.lit("")).alias("lang"))


__all__ = ["QUERIES", "SQL", "iri_term", "literal_term"]
