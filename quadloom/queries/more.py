"""Further queries with SQL: generic terms, stores, entailment and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom.functions.terms import Term
from quadloom.functions.vocab import OWL, RDF, RDFS, XSD
from quadloom.operators import graph_ops
from quadloom.plans.dataset import Dataset
from quadloom.queries import reference
from quadloom.queries.reference import _Q, _QK, S_, _added, ask, over_quads, plan
from quadloom.shacl.validate import validate
from quadloom.sources.turtle import parse_turtle

ask("path_seq_tables", "customer nation region",
    "SELECT ?r (COUNT(?c) AS ?n) WHERE { ?c :c_nation/:n_region/:r_name ?r } GROUP BY ?r",
    "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("path_inverse_tables", "nation region",
    "SELECT ?r ?name WHERE { ?x :r_name ?r ; ^:n_region ?n . ?n :n_name ?name }",
    "SELECT r_name AS r, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
ask("fn_text", "documents",
    "SELECT ?d (STRLEN(?t) AS ?n) (CONTAINS(LCASE(?t), 'court') AS ?c) WHERE { ?x :doc_id ?d ; :text ?t }",
    "SELECT doc_id AS d, CAST(length(text) AS BIGINT) AS n, contains(lower(text), 'court') AS c FROM documents WHERE text IS NOT NULL")
ask("optional_columns", "documents",
    "SELECT ?d ?l ?k ?r WHERE { ?x :doc_id ?d OPTIONAL { ?x :lang ?l } OPTIONAL { ?x :docket ?k ; :ruling_id ?r } }",
    "SELECT doc_id AS d, lang AS l, CASE WHEN ruling_id IS NOT NULL THEN docket END AS k, CASE WHEN docket IS NOT NULL THEN ruling_id END AS r FROM documents")
ask("agg_events", "events",
    "SELECT ?t (COUNT(DISTINCT ?u) AS ?users) (MIN(?v) AS ?lo) (MAX(?ts) AS ?last) WHERE { ?e :event_type ?t ; :user_id ?u ; :value ?v ; :ts ?ts } GROUP BY ?t",
    "SELECT event_type AS t, count(DISTINCT user_id) AS users, min(value) AS lo, max(ts) AS last FROM events GROUP BY 1")
ask("join_three_stars", "lineitem orders part",
    "SELECT ?s (COUNT(*) AS ?n) WHERE { ?l :l_order ?o ; :l_part ?p ; :l_quantity ?q . ?o :o_orderstatus ?s . ?p :p_size ?z FILTER(?z < 10 && ?q > 45) } GROUP BY ?s",
    "SELECT o_orderstatus AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_quantity > 45 GROUP BY 1")
ask("union_of_classes", "customer supplier nation",
    "SELECT ?name (COUNT(*) AS ?n) WHERE { ?x :c_nation|:s_nation ?na . ?na :n_name ?name } GROUP BY ?name",
    "SELECT n_name AS name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x JOIN nation ON k = n_nationkey GROUP BY 1")

over_quads("agg_terms", "SELECT ?p (COUNT(DISTINCT ?o) AS ?n) (COUNT(*) AS ?m) WHERE { ?s ?p ?o } GROUP BY ?p",
    f"WITH q AS {_Q} SELECT '<' || p || '>' AS p, CAST(count(DISTINCT o) AS VARCHAR) AS n, CAST(count(*) AS VARCHAR) AS m FROM q GROUP BY p")
over_quads("agg_datatypes", "SELECT ?dt ?lang (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(ISLITERAL(?o)) BIND(DATATYPE(?o) AS ?dt) BIND(LANG(?o) AS ?lang) } GROUP BY ?dt ?lang",
    f"WITH q AS (SELECT s, p, o, min(dt) AS dt, min(lower(lang)) AS lang FROM {_QK} x WHERE k = 2 GROUP BY s, p, o) SELECT '<' || coalesce(dt, '{XSD.string}') || '>' AS dt, '\"' || coalesce(lang, '') || '\"' AS lang, CAST(count(*) AS VARCHAR) AS n FROM q GROUP BY 1, 2")
over_quads("filter_numeric_terms", "SELECT ?f ?v WHERE { ?f s:votes ?v FILTER(?v >= 100000) }",
    f"""WITH q AS (SELECT s, o, min(lex) AS lex, min(dt) AS dt FROM {_QK} x WHERE p = '{S_}votes' AND k = 2 GROUP BY s, o) SELECT s AS f, o AS v FROM q
    WHERE dt IN ('{XSD.integer}', '{XSD.int}', '{XSD.long}', '{XSD.decimal}', '{XSD.double}', '{XSD.float}') AND regexp_matches(lex, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') AND try_cast(lex AS DOUBLE) >= 100000""")
over_quads("subquery_max", "SELECT ?f ?v WHERE { ?f s:genre ?v { SELECT ?f (COUNT(*) AS ?n) WHERE { ?f s:genre ?g } GROUP BY ?f HAVING (COUNT(*) > 2) } }",
    f"WITH q AS (SELECT s, o FROM {_Q} x WHERE p = '{S_}genre') SELECT s AS f, o AS v FROM q WHERE s IN (SELECT s FROM q GROUP BY s HAVING count(*) > 2)")


@plan("graph_contexts", f"SELECT DISTINCT coalesce(g, '') AS g FROM quads WHERE p = '{S_}genre'")
def graph_contexts(spark, d):
    ds = Dataset(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"))
    return ds.contexts(p=S_ + "genre").select(F.coalesce("g", F.lit("")).alias("g"))


@plan("graph_set_value", f"""WITH q AS (SELECT DISTINCT coalesce(g, '') AS g, s.id AS s, p, o.id AS o FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL)
  SELECT p, count(*) AS n FROM (SELECT * FROM q WHERE NOT (g = '' AND s = '<http://kb.example/film/0000001>' AND p = '{S_}votes') UNION SELECT '', '<http://kb.example/film/0000001>', '{S_}votes', '7') x GROUP BY p""")
def graph_set_value(spark, d):
    q = spark.read.parquet(f"{d}/quads.parquet").where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select("g", "s", "p", "o")
    after = Dataset(q).set_value((None, Term(1, "http://kb.example/film/0000001"), Term(1, S_ + "votes"), Term(2, "7", XSD.integer))).quads
    return after.groupBy("p").agg(F.count_distinct(F.coalesce("g", F.lit("")), "s.id", "o.id").alias("n"))


@plan("graph_collections")
def graph_collections(spark, d):
    """Lists made of each film's genres in order, read back as arrays."""
    q = spark.read.parquet(f"{d}/quads.parquet").where((F.col("p") == S_ + "genre") & F.col("s.id").isNotNull() & F.col("o.id").isNotNull()).select(F.col("s.id").alias("s"), F.col("o.id").alias("o")).distinct()
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("s").orderBy("o"))
    cells = q.withColumn("i", n).withColumn("cell", F.concat(F.lit("_:"), F.md5(F.concat_ws(" ", "s", "i")))).withColumn("next", F.concat(F.lit("_:"), F.md5(F.concat_ws(" ", "s", F.col("i") + 1))))
    last = q.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(last, "s").withColumn("next", F.when(F.col("i") < F.col("m"), F.col("next")).otherwise(F.lit(f"<{RDF.nil}>")))
    link = lambda p, o: cells.select(F.struct(F.col("cell").alias("id")).alias("s"), F.lit(p).alias("p"), F.struct(F.col(o).alias("id")).alias("o"))
    lists = graph_ops.collections(link(RDF.first, "o").unionByName(link(RDF.rest, "next")))
    return lists.groupBy(F.size("items").alias("length")).agg(F.count(F.lit(1)).alias("n"))


reference.SQL["graph_collections"] = f"SELECT CAST(m AS INTEGER) AS length, count(*) AS n FROM (SELECT s.id AS s, count(DISTINCT o.id) AS m FROM quads WHERE p = '{S_}genre' AND s.id IS NOT NULL AND o.id IS NOT NULL GROUP BY 1) x GROUP BY 1"


@plan("owl_ifp_sameas", f"""WITH RECURSIVE t AS (SELECT DISTINCT s.id AS s, p, o.id AS o FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL),
  q AS (SELECT s, o FROM t WHERE p = '{S_}character'), e AS (SELECT DISTINCT x.s AS a, y.s AS b FROM q x JOIN q y ON x.o = y.o AND x.s <> y.s), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  s1 AS (SELECT s, p, o FROM t UNION SELECT r.b, p, o FROM t JOIN r ON r.a = t.s), s2 AS (SELECT s, p, o FROM s1 UNION SELECT s, p, r.b FROM s1 JOIN r ON r.a = s1.o)
  (SELECT a AS s, '{OWL.sameAs}' AS p, b AS o FROM r WHERE a <> b UNION SELECT s, p, o FROM s2) EXCEPT SELECT s, p, o FROM t""")
def owl_ifp_sameas(spark, d):
    return _added(spark, d, "s:character a owl:InverseFunctionalProperty .", {"owlrl"})


@plan("owl_transitive", f"""WITH RECURSIVE q AS (SELECT DISTINCT s.id AS s, o.id AS o FROM quads WHERE p = '{S_}directed_by' AND s.id IS NOT NULL AND o.kind <> 2),
  e AS (SELECT s AS a, o AS b FROM q UNION SELECT o, s FROM q), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT a AS s, '{S_}directed_by' AS p, b AS o FROM r WHERE a <> b EXCEPT SELECT s, '{S_}directed_by', o FROM q""")
def owl_transitive(spark, d):
    q = _added(spark, d, "s:directed_by a owl:TransitiveProperty, owl:SymmetricProperty .", {"owlrl"})
    return q.where("s <> o")


_PAIR = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix s: <{S_}> . @prefix : <{S_}> . @prefix rdfs: <{RDFS}> .
:P sh:targetClass s:Film ; sh:property [ sh:path s:runtime ; sh:lessThan s:votes ] ; sh:sparql [ sh:select "SELECT $this ?value WHERE {{ $this <{S_}starring> ?value . FILTER NOT EXISTS {{ ?value <{S_}character> ?l }} }}" ] .
"""
_NUM = f"(k = 2 AND dt IN ('{XSD.integer}', '{XSD.int}', '{XSD.long}', '{XSD.decimal}', '{XSD.double}', '{XSD.float}') AND regexp_matches(lex, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'))"


@plan("shacl_pair_sparql", f"""WITH q AS (SELECT s, p, o, min(k) AS k, min(lex) AS lex, min(coalesce(dt, '{XSD.string}')) AS dt FROM {_QK} x GROUP BY s, p, o), films AS (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Film>'),
  a AS (SELECT q.s, o, dt, k, lex, CASE WHEN {_NUM} THEN try_cast(lex AS DOUBLE) END AS n FROM q JOIN films ON films.s = q.s WHERE p = '{S_}runtime'),
  b AS (SELECT s, o, dt, k, lex, CASE WHEN {_NUM} THEN try_cast(lex AS DOUBLE) END AS n FROM q WHERE p = '{S_}votes')
  SELECT 'LessThan' AS component, count(*) AS n FROM a JOIN b ON a.s = b.s WHERE NOT coalesce(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.n < b.n WHEN a.k = 2 AND b.k = 2 AND a.dt = '{XSD.string}' AND b.dt = '{XSD.string}' THEN a.lex < b.lex WHEN a.k = 1 AND b.k = 1 THEN a.lex < b.lex END, false)
  UNION ALL SELECT 'SPARQL', count(*) FROM q JOIN films ON films.s = q.s WHERE p = '{S_}starring' AND o NOT IN (SELECT s FROM q WHERE p = '{S_}character') HAVING count(*) > 0""")
def shacl_pair_sparql(spark, d):
    r = validate(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"), parse_turtle(_PAIR))
    return r.df.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


_CLOSED = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix s: <{S_}> . @prefix : <{S_}> . @prefix rdf: <{RDF}> . @prefix rdfs: <{RDFS}> .
:C sh:targetClass s:Performance ; sh:closed true ; sh:ignoredProperties ( rdf:type s:film ) ; sh:property [ sh:path s:actor ; sh:node [ sh:property [ sh:path rdfs:label ; sh:minCount 1 ] ] ] , [ sh:path ( s:film s:directed_by ) ; sh:minCount 1 ] , [ sh:path s:character ; sh:minLength 8 ] .
"""


@plan("shacl_closed_node", f"""WITH q AS {_Q}, k AS {_QK}, t AS (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Performance>')
  SELECT component, count(*) AS n FROM (SELECT 'Closed' AS component FROM q JOIN t ON t.s = q.s WHERE p NOT IN ('{RDF.type}', '{S_}film', '{S_}actor', '{S_}character')
  UNION ALL SELECT 'Node' FROM q JOIN t ON t.s = q.s WHERE p = '{S_}actor' AND o NOT IN (SELECT s FROM q WHERE p = '{RDFS.label}')
  UNION ALL SELECT 'MinCount' FROM t WHERE s NOT IN (SELECT x.s FROM q x JOIN q y ON y.s = x.o WHERE x.p = '{S_}film' AND y.p = '{S_}directed_by')
  UNION ALL SELECT 'MinLength' FROM (SELECT DISTINCT k.s, k.o FROM k JOIN t ON t.s = k.s WHERE p = '{S_}character' AND (k.k = 0 OR length(lex) < 8)) z) w GROUP BY component""")
def shacl_closed_node(spark, d):
    r = validate(spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o"), parse_turtle(_CLOSED))
    return r.df.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))
