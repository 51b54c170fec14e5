"""Every kind of shape constraint and node expression over the film graph, compared result by result with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.vocab import RDF, RDFS, SH, SHNEX, XSD
from quadloom.queries.reference import QUERIES, S_, SQL
from quadloom.shacl.validate import validate
from quadloom.sources.turtle import parse_turtle

HEAD = f"@prefix sh: <{SH}> . @prefix shnex: <{SHNEX}> . @prefix xsd: <{XSD}> . @prefix s: <{S_}> . @prefix : <http://kb.example/shape#> . @prefix rdfs: <{RDFS}> . @prefix rdf: <{RDF}> .\n"
G0 = "http://kb.example/genre/00"
NUMBER = "'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
BASE = f"""WITH q AS (SELECT s.id AS s, p, o.id AS o, min(o.kind) AS k, min(o.lex) AS lex, min(coalesce(o.dt, '{XSD.string}')) AS dt, lower(regexp_extract(o.id, '"@([A-Za-z0-9-]+)$', 1)) AS tag
  FROM quads WHERE s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL GROUP BY s.id, p, o.id),
films AS (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Film>'), v AS (SELECT q.* FROM q JOIN films ON films.s = q.s),
n AS (SELECT s, p, o, k, lex, CASE WHEN tag = '' THEN dt END AS dt, CASE WHEN k = 2 AND dt IN ('{XSD.integer}', '{XSD.int}', '{XSD.long}', '{XSD.decimal}', '{XSD.double}', '{XSD.float}') AND regexp_matches(lex, {NUMBER}) THEN try_cast(lex AS DOUBLE) END AS x FROM q)"""


def quads(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/quads.parquet").select("g", "s", "p", "o")


def rows(data: DataFrame, turtle: str) -> DataFrame:
    """focus, path (of a single property), value and the component's name of every result."""
    r = validate(data, parse_turtle(HEAD + turtle)).df
    path = F.when(F.col("path").startswith("<"), F.expr("substring(path, 2, length(path) - 2)"))
    return r.select("focus", path.alias("path"), "value", F.regexp_extract("component", "#(.*?)(ConstraintComponent)?$", 1).alias("component"))


def shape(name: str, turtle: str, branches: list[str], more: str = "", data=quads) -> None:
    """Register the results of a shapes graph; each branch selects focus, path, value and component."""
    QUERIES[name] = lambda spark, d: rows(data(spark, d), turtle)
    SQL[name] = f"{BASE}{more} SELECT * FROM ({branches[0]}) b0" + "".join(f" UNION ALL SELECT * FROM ({b}) b{i}" for i, b in enumerate(branches[1:], 1))


def bad(component: str, path: str, where: str, value: str = "o", table: str = "v") -> str:
    return f"SELECT s AS focus, '{path}' AS path, {value} AS value, '{component}' AS component FROM {table} WHERE p = '{path}' AND ({where})"


def of(p: str, alias: str, table: str = "q") -> str:
    return f"(SELECT * FROM {table} WHERE p = '{S_}{p}') {alias}"


def has(p: str, node: str) -> str:
    return f"{node} IN (SELECT s FROM q WHERE p = '{S_}{p}')"


LABEL, GENRE, RUNTIME, COLOUR, VOTES, LINKS, STARRING = RDFS.label, S_ + "genre", S_ + "runtime", S_ + "in_colour", S_ + "votes", S_ + "links_to", S_ + "starring"
TURTLE = f""":V sh:targetClass s:Film ; sh:property [ sh:path s:genre ; sh:nodeKind sh:IRI ; sh:minCount 1 ; sh:maxCount 2 ; sh:hasValue <{G0}> ] ,
  [ sh:path rdfs:label ; sh:languageIn ( "en" "de" ) ; sh:minLength 14 ; sh:maxLength 20 ; sh:pattern "^The [a-m]" ; sh:flags "i" ; sh:singleLine true ; sh:uniqueLang true ] ,
  [ sh:path s:runtime ; sh:datatype xsd:integer ; sh:minExclusive 60 ; sh:minInclusive 62 ; sh:maxExclusive 200 ; sh:maxInclusive 198 ] , [ sh:path s:in_colour ; sh:in ( true false ) ] .
"""
AT = "n.s IN (SELECT s FROM films)"
shape("shacl_values", TURTLE, [
    bad("NodeKind", GENRE, "k <> 1"), f"SELECT s, '{GENRE}', NULL, 'MinCount' FROM films WHERE s NOT IN (SELECT s FROM v WHERE p = '{GENRE}')",
    f"SELECT s, '{GENRE}', NULL, 'MaxCount' FROM v WHERE p = '{GENRE}' GROUP BY s HAVING count(*) > 2", f"SELECT s, '{GENRE}', NULL, 'HasValue' FROM films WHERE s NOT IN (SELECT s FROM v WHERE p = '{GENRE}' AND o = '<{G0}>')",
    bad("LanguageIn", LABEL, "NOT (tag IN ('en', 'de') OR tag LIKE 'en-%' OR tag LIKE 'de-%')"), bad("MinLength", LABEL, "length(lex) < 14"), bad("MaxLength", LABEL, "length(lex) > 20"),
    bad("Pattern", LABEL, "NOT regexp_matches(lex, '^[tT][hH][eE] [a-mA-M]')"), bad("SingleLine", LABEL, "regexp_matches(lex, '[\\n\\r\\f\\x0B]')"),
    f"SELECT s, '{LABEL}', NULL, 'UniqueLang' FROM v WHERE p = '{LABEL}' AND tag <> '' GROUP BY s, tag HAVING count(*) > 1",
    bad("Datatype", RUNTIME, f"NOT (k = 2 AND dt = '{XSD.integer}' AND regexp_matches(lex, '^[+-]?[0-9]+$'))"),
    *[bad(c, RUNTIME, f"{AT} AND NOT coalesce(x {op}, false)", table="n") for c, op in (("MinExclusive", "> 60"), ("MinInclusive", ">= 62"), ("MaxExclusive", "< 200"), ("MaxInclusive", "<= 198"))],
    bad("In", COLOUR, "o NOT IN ('true', 'false')"),
])

LESS = f"coalesce(CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN a.x < b.x WHEN a.k = 2 AND b.k = 2 AND a.dt = '{XSD.string}' AND b.dt = '{XSD.string}' THEN a.lex < b.lex WHEN a.k = 1 AND b.k = 1 THEN a.lex < b.lex END, false)"
TWO = f"FROM n a JOIN films ON films.s = a.s JOIN n b ON b.s = a.s AND b.p = '{VOTES}' WHERE a.p = '{RUNTIME}'"
BACK = f"EXISTS (SELECT 1 FROM {of('links_to', 'w')} WHERE w.s = v.o AND w.o = v.s)"
shape("shacl_pairs", """:P sh:targetClass s:Film ; sh:property [ sh:path s:runtime ; sh:lessThan s:votes ; sh:lessThanOrEquals s:votes ; sh:equals s:votes ] , [ sh:path s:links_to ; sh:disjoint [ sh:inversePath s:links_to ] ; sh:subsetOf [ sh:inversePath s:links_to ] ] ,
  [ sh:path s:genre ; sh:disjoint s:country ; sh:minCount 0 ] . :Q sh:targetClass s:Archived ; sh:property [ sh:path [ sh:inversePath s:film ] ; sh:equals s:starring ; sh:disjoint s:starring ] .""", [
    f"SELECT a.s AS focus, '{RUNTIME}' AS path, a.o AS value, 'LessThan' AS component {TWO} AND NOT {LESS}", f"SELECT a.s, '{RUNTIME}', a.o, 'LessThanOrEquals' {TWO} AND NOT {LESS.replace(' < ', ' <= ')}",
    f"SELECT v.s, '{RUNTIME}', v.o, 'Equals' FROM v WHERE p IN ('{RUNTIME}', '{VOTES}') AND NOT EXISTS (SELECT 1 FROM v w WHERE w.s = v.s AND w.o = v.o AND w.p IN ('{RUNTIME}', '{VOTES}') AND w.p <> v.p)",
    f"SELECT s, '{LINKS}', o, 'Disjoint' FROM v WHERE p = '{LINKS}' AND {BACK}", f"SELECT s, '{LINKS}', o, 'SubsetOf' FROM v WHERE p = '{LINKS}' AND NOT {BACK}",
    f"SELECT s, NULL, o, 'Equals' FROM ((SELECT o AS s, s AS o FROM {of('film', 'f')} EXCEPT SELECT s, o FROM {of('starring', 'g')}) UNION ALL (SELECT s, o FROM {of('starring', 'g')} EXCEPT SELECT o, s FROM {of('film', 'f')})) x WHERE s IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Archived>')",
    f"SELECT f.o, NULL, f.s, 'Disjoint' FROM {of('film', 'f')} JOIN {of('starring', 'g')} ON g.s = f.o AND g.o = f.s WHERE f.o IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Archived>')",
])

ACTED = "o IN (SELECT s FROM q WHERE p = '" + S_ + "actor')"
NAMED = "o IN (SELECT s FROM q WHERE p = '" + S_ + "character')"
CAST = f"FROM v WHERE p = '{STARRING}'"
ROLE = f"o IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Performance>')"
shape("shacl_logic", """:L sh:targetClass s:Film ; sh:not [ sh:property [ sh:path s:genre ; sh:minCount 3 ] ] ; sh:xone ( [ sh:property [ sh:path s:votes ; sh:minCount 1 ] ] [ sh:property [ sh:path s:rating ; sh:minCount 1 ] ] ) ;
  sh:or ( [ sh:property [ sh:path s:votes ; sh:minCount 1 ] ] [ sh:property [ sh:path s:rating ; sh:minCount 1 ] ] ) ; sh:and ( [ sh:property [ sh:path s:votes ; sh:minCount 1 ] ] [ sh:property [ sh:path s:rating ; sh:minCount 1 ] ] ) ;
  sh:property [ sh:path s:starring ; sh:class s:Performance ; sh:node [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ; sh:someValue [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ;
    sh:property [ sh:path s:character ; sh:minLength 8 ] ] ,
  [ sh:path s:starring ; sh:qualifiedValueShape [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 1 ] .""", [
    f"SELECT s AS focus, NULL AS path, s AS value, 'Not' AS component FROM v WHERE p = '{GENRE}' GROUP BY s HAVING count(*) >= 3",
    f"SELECT s, NULL, s, 'Xone' FROM films WHERE ({has('votes', 's')}) = ({has('rating', 's')})", f"SELECT s, NULL, s, 'Or' FROM films WHERE NOT ({has('votes', 's')}) AND NOT ({has('rating', 's')})",
    f"SELECT s, NULL, s, 'And' FROM films WHERE NOT ({has('votes', 's')}) OR NOT ({has('rating', 's')})",
    f"SELECT s, '{STARRING}', o, 'Class' {CAST} AND NOT {ROLE}", f"SELECT s, '{STARRING}', o, 'Node' {CAST} AND NOT {NAMED}",
    f"SELECT s, '{STARRING}', NULL, 'SomeValue' FROM films WHERE s NOT IN (SELECT s {CAST} AND {NAMED})", f"SELECT s, '{STARRING}', NULL, 'QualifiedMinCount' FROM films WHERE s NOT IN (SELECT s {CAST} AND {NAMED})",
    f"SELECT s, '{STARRING}', NULL, 'QualifiedMaxCount' {CAST} AND {NAMED} GROUP BY s HAVING count(*) > 1",
    f"SELECT c.s, '{S_}character', c.o, 'MinLength' FROM {of('character', 'c')} WHERE c.s IN (SELECT o {CAST}) AND length(lex) < 8",
])

shape("shacl_closed", """:C sh:targetClass s:Performance ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path s:actor ] , [ sh:path s:film ] .
s:Film a sh:NodeShape ; sh:property [ sh:path s:genre ] , [ sh:path rdfs:label ] . s:Archived a sh:NodeShape ; sh:targetClass s:Archived ; sh:closed sh:ByTypes ; sh:property [ sh:path s:country ] .""", [
    f"SELECT s AS focus, p AS path, o AS value, 'Closed' AS component FROM q WHERE s IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Performance>') AND p NOT IN ('{RDF.type}', '{S_}actor', '{S_}film')",
    f"SELECT s, p, o, 'Closed' FROM q WHERE s IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Archived>') AND p NOT IN ('{RDF.type}', '{S_}country') AND NOT (p IN ('{GENRE}', '{LABEL}') AND s IN (SELECT s FROM films))",
])

FILM1 = "http://kb.example/film/0000001"
shape("shacl_targets", f""":T1 sh:targetNode <{FILM1}> ; sh:nodeKind sh:Literal . :T2 sh:targetSubjectsOf s:has_entry ; sh:nodeKind sh:Literal . :T3 sh:targetObjectsOf s:country ; sh:nodeKind sh:Literal .
:T4 sh:target [ sh:select "SELECT ?this WHERE {{ ?this <{S_}genre> <{G0}> ; <{S_}votes> ?v }}" ] ; sh:nodeKind sh:BlankNode . :T5 sh:targetWhere [ sh:property [ sh:path s:has_entry ; sh:minCount 2 ] ] ; sh:class s:Film .""", [
    f"SELECT '<{FILM1}>' AS focus, NULL AS path, '<{FILM1}>' AS value, 'NodeKind' AS component", f"SELECT DISTINCT s, NULL, s, 'NodeKind' FROM {of('has_entry', 'x')}", f"SELECT DISTINCT o, NULL, o, 'NodeKind' FROM {of('country', 'x')} WHERE k <> 2",
    f"SELECT DISTINCT s, NULL, s, 'NodeKind' FROM {of('genre', 'x')} WHERE o = '<{G0}>' AND {has('votes', 's')} AND s NOT LIKE '\\_%' ESCAPE '\\'", f"SELECT s, NULL, s, 'Class' FROM {of('has_entry', 'x')} WHERE s NOT IN (SELECT s FROM films) GROUP BY s HAVING count(*) > 1",
])

shape("shacl_paths", """:W sh:targetClass s:Archived ; sh:property [ sh:path ( s:starring s:actor ) ; sh:class s:Director ] , [ sh:path [ sh:alternativePath ( s:genre s:country ) ] ; sh:nodeKind sh:Literal ] , [ sh:path [ sh:zeroOrOnePath s:starring ] ; sh:class s:Performance ] ,
  [ sh:path [ sh:oneOrMorePath [ sh:alternativePath ( s:starring s:actor ) ] ] ; sh:class s:Film ] , [ sh:path [ sh:zeroOrMorePath [ sh:alternativePath ( s:starring s:actor ) ] ] ; sh:class s:Actor ] .""", [
    f"SELECT a.s AS focus, NULL AS path, y.o AS value, 'Class' AS component FROM (SELECT DISTINCT a.s, y.o FROM a JOIN {of('starring', 'x')} ON x.s = a.s JOIN {of('actor', 'y')} ON y.s = x.o) z(s, o), LATERAL (SELECT z.s) a, LATERAL (SELECT z.o) y",
    f"SELECT DISTINCT a.s, NULL, x.o, 'NodeKind' FROM a JOIN q x ON x.s = a.s WHERE p IN ('{GENRE}', '{S_}country') AND k <> 2",
    f"SELECT s, NULL, o, 'Class' FROM (SELECT s, s AS o FROM a UNION SELECT a.s, o FROM a JOIN {of('starring', 'x')} ON x.s = a.s) z WHERE NOT {ROLE}",
    "SELECT s, NULL, o, 'Class' FROM reach WHERE o NOT IN (SELECT s FROM films)",
    f"SELECT s, NULL, o, 'Class' FROM (SELECT s, o FROM reach UNION SELECT s, s FROM a) z WHERE o NOT IN (SELECT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Actor>')",
], more=f""", a AS (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Archived>'), st AS (SELECT s, o FROM q WHERE p IN ('{STARRING}', '{S_}actor')),
  one AS (SELECT a.s, st.o FROM a JOIN st ON st.s = a.s), two AS (SELECT s, o FROM one UNION SELECT one.s, st.o FROM one JOIN st ON st.s = one.o), reach AS (SELECT s, o FROM two UNION SELECT two.s, st.o FROM two JOIN st ON st.s = two.o)""")  # fmt: skip


def with_lists(spark, d: str) -> DataFrame:
    """The quads, and for each film lists of its genres, and of its genres twice, in the order of their ids."""
    q = quads(spark, d)
    genres = q.where((F.col("p") == GENRE) & F.col("s.id").isNotNull() & F.col("o.id").isNotNull()).groupBy("s.id").agg(F.sort_array(F.collect_set(F.col("o.id"))).alias("g"))
    both = genres.select("id", F.col("g").alias("items"), F.lit("genre_list").alias("name")).unionByName(genres.select("id", F.concat("g", "g"), F.lit("genre_twice")).toDF("id", "items", "name"))
    cell = lambda i: F.when(i <= F.size("items"), F.concat(F.lit("_:"), F.md5(F.concat_ws(" ", "id", "name", i)))).otherwise(F.lit(f"<{RDF.nil}>"))
    cells = both.select("*", F.posexplode("items").alias("i", "item")).select("id", "name", "i", "item", "items")
    first = cells.select(cell(F.col("i") + 1).alias("s"), F.lit(RDF.first).alias("p"), F.col("item").alias("o"))
    rest = cells.select(cell(F.col("i") + 1).alias("s"), F.lit(RDF.rest).alias("p"), cell(F.col("i") + 2).alias("o"))
    heads = both.select(F.col("id").alias("s"), F.concat(F.lit(S_), "name").alias("p"), cell(F.lit(1)).alias("o"))
    return _with_triples(q, first.unionByName(rest).unionByName(heads))


def _with_triples(q: DataFrame, triples: DataFrame) -> DataFrame:
    from quadloom.functions.terms import term_of_id

    return q.unionByName(triples.select(F.lit(None).cast("string").alias("g"), term_of_id(F.col("s")).alias("s"), "p", term_of_id(F.col("o")).alias("o")))


HEADS = "'_:' || md5(s || ' genre_list 1')"
shape("shacl_lists", """:U sh:targetSubjectsOf s:genre_list ; sh:property [ sh:path s:genre_list ; sh:minListLength 2 ; sh:maxListLength 3 ; sh:uniqueMembers true ; sh:memberShape [ sh:nodeKind sh:IRI ] ] , [ sh:path s:genre_twice ; sh:uniqueMembers true ] .""", [
    f"SELECT s AS focus, '{S_}genre_list' AS path, {HEADS} AS value, 'MinListLength' AS component FROM l WHERE n < 2", f"SELECT s, '{S_}genre_list', {HEADS}, 'MaxListLength' FROM l WHERE n > 3", f"SELECT s, '{S_}genre_list', {HEADS}, 'MemberShape' FROM l WHERE other > 0",
    f"SELECT s, '{S_}genre_twice', '_:' || md5(s || ' genre_twice 1'), 'UniqueMembers' FROM l",
], more=f", l AS (SELECT s, count(*) AS n, count(CASE WHEN k <> 1 THEN 1 END) AS other FROM q WHERE p = '{GENRE}' GROUP BY s)", data=with_lists)


def with_reifiers(spark, d: str) -> DataFrame:
    """The quads, and a reifier of each film's countries, which has a source if the country isn't country 00."""
    q = quads(spark, d)
    c = q.where((F.col("p") == S_ + "country") & F.col("s.id").isNotNull() & F.col("o.id").isNotNull() & (F.col("o.id") != "<http://kb.example/country/01>")).select(F.col("s.id").alias("a"), F.col("o.id").alias("b")).distinct()
    r = c.withColumn("r", F.concat(F.lit("_:"), F.md5(F.concat_ws(" ", "a", "b"))))
    reifies = r.select(F.col("r").alias("s"), F.lit(RDF.reifies).alias("p"), F.concat(F.lit("<<( "), "a", F.lit(f" <{S_}country> "), "b", F.lit(" )>>")).alias("o"))
    sources = r.where(F.col("b") != "<http://kb.example/country/00>").select(F.col("r").alias("s"), F.lit(S_ + "source").alias("p"), F.lit('"x"').alias("o"))
    return _with_triples(q, reifies.unionByName(sources))


shape("shacl_reifiers", """:R sh:targetClass s:Film ; sh:property [ sh:path s:country ; sh:reifierShape [ sh:property [ sh:path s:source ; sh:minCount 1 ] ] ; sh:reificationRequired true ] .""", [
    bad("ReifierShape", S_ + "country", "o IN ('<http://kb.example/country/00>', '<http://kb.example/country/01>')")], data=with_reifiers)

shape("shacl_expressions", """:X sh:targetClass s:Film ; sh:expression [ shnex:exists [ shnex:pathValues s:directed_by ] ] ; sh:nodeByExpression [ shnex:pathValues s:genre ] ;
  sh:property [ sh:path s:n_genres ; sh:values [ shnex:count [ shnex:pathValues s:genre ] ] ; sh:maxInclusive 2 ] . <http://kb.example/genre/00> a sh:NodeShape ; sh:property [ sh:path s:votes ; sh:minCount 1 ] .""", [
    f"SELECT s AS focus, NULL AS path, s AS value, 'Expression' AS component FROM films WHERE NOT ({has('directed_by', 's')})",
    f"SELECT s, NULL, s, 'NodeByExpression' FROM films WHERE s IN (SELECT s FROM v WHERE p = '{GENRE}' AND o = '<{G0}>') AND NOT ({has('votes', 's')})",
    f"SELECT s, '{S_}n_genres', CAST(count(*) AS VARCHAR), 'MaxInclusive' FROM v WHERE p = '{GENRE}' GROUP BY s HAVING count(*) > 2",
])

shape("shacl_sparql", f""":Least a sh:ConstraintComponent ; sh:parameter [ sh:path s:least ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:ask "ASK {{ FILTER(?value >= $least) }}" ] .
:M sh:targetClass s:Film ; sh:property [ sh:path s:runtime ; s:least 90 ] ; sh:sparql [ sh:select "SELECT $this ?value WHERE {{ $this <{STARRING}> ?value . FILTER NOT EXISTS {{ ?value <{S_}character> ?l }} }}" ] .""", [
    f"SELECT s AS focus, '{RUNTIME}' AS path, o AS value, 'Least' AS component FROM n WHERE p = '{RUNTIME}' AND {AT} AND NOT coalesce(x >= 90, false)", f"SELECT s, NULL, o, 'SPARQL' {CAST} AND NOT {NAMED}",
])


# node expressions ----------------------------------------------------------------------------------------------------------------
YES = '"yes"'
_C, _G = f"SELECT s, o FROM v WHERE p = '{S_}country'", f"SELECT s, o FROM v WHERE p = '{GENRE}'"
_P = f"FROM {of('starring', 'x', 'v')} JOIN {of('actor', 'y')} ON y.s = x.o"
EXPRESSIONS = {
    "var": ('[ shnex:var "focusNode" ]', "SELECT s, s AS o FROM films"),
    "constant": ('"c"', "SELECT s, '\"c\"' FROM films"),
    "path": ("[ shnex:pathValues s:genre ]", _G),
    "count": ("[ shnex:count [ shnex:pathValues s:genre ] ]", f"SELECT films.s, CAST(count(g.o) AS VARCHAR) FROM films LEFT JOIN ({_G}) g ON g.s = films.s GROUP BY films.s"),
    "sum": ("[ shnex:nodes [ shnex:pathValues s:starring ] ; shnex:sum [ shnex:pathValues s:starring ] ; shnex:flatMap [ shnex:count [ shnex:pathValues s:actor ] ] ]", f"SELECT films.s, CAST(count(z.o) AS VARCHAR) FROM films LEFT JOIN (SELECT x.s, y.o {_P}) z ON z.s = films.s GROUP BY films.s"),
    "min": ("[ shnex:min [ shnex:pathValues s:country ] ]", f"SELECT s, min(o) FROM ({_C}) c GROUP BY s"),
    "max": ("[ shnex:max [ shnex:pathValues s:country ] ]", f"SELECT s, max(o) FROM ({_C}) c GROUP BY s"),
    "exists": ("[ shnex:exists [ shnex:pathValues s:directed_by ] ]", f"SELECT s, CASE WHEN {has('directed_by', 's')} THEN 'true' ELSE 'false' END FROM films"),
    "concat": ("[ shnex:concat ( [ shnex:pathValues s:country ] [ shnex:pathValues s:country ] ) ]", f"{_C} UNION ALL {_C}"),
    "distinct": ("[ shnex:distinct [ shnex:concat ( [ shnex:pathValues s:country ] [ shnex:pathValues s:country ] ) ] ]", _C),
    "intersection": (f"[ shnex:intersection ( [ shnex:pathValues s:genre ] ( <{G0}> <http://kb.example/genre/01> ) ) ]", f"{_G} AND o IN ('<{G0}>', '<http://kb.example/genre/01>')"),
    "remove": (f"[ shnex:nodes [ shnex:pathValues s:genre ] ; shnex:remove ( <{G0}> ) ]", f"{_G} AND o <> '<{G0}>'"),
    "filter": ("[ shnex:nodes [ shnex:pathValues s:starring ] ; shnex:filterShape [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ]", f"SELECT s, o {CAST} AND {NAMED}"),
    "first": ("[ shnex:nodes [ shnex:pathValues s:starring ] ; shnex:findFirst [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ]", f"SELECT s, min(o) {CAST} AND {NAMED} GROUP BY s"),
    "all": ("[ shnex:nodes [ shnex:pathValues s:starring ] ; shnex:matchAll [ sh:property [ sh:path s:character ; sh:minCount 1 ] ] ]", f"SELECT s, CASE WHEN s IN (SELECT s {CAST} AND NOT {NAMED}) THEN 'false' ELSE 'true' END FROM films"),
    "limit": ("[ shnex:nodes [ shnex:pathValues s:country ] ; shnex:limit 1 ]", f"SELECT s, min(o) FROM ({_C}) c GROUP BY s"),
    "offset": ("[ shnex:nodes [ shnex:pathValues s:country ] ; shnex:offset 1 ]", f"SELECT s, o FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY o) AS i FROM ({_C}) c) r WHERE i > 1"),
    "order": ("[ shnex:nodes [ shnex:nodes [ shnex:pathValues s:country ] ; shnex:orderBy [ shnex:var \"focusNode\" ] ; shnex:desc true ] ; shnex:limit 1 ]", f"SELECT s, max(o) FROM ({_C}) c GROUP BY s"),
    "if": ("[ shnex:if [ shnex:exists [ shnex:pathValues s:votes ] ] ; shnex:then \"yes\" ; shnex:else [ shnex:pathValues s:country ] ]", f"SELECT s, '{YES}' FROM films WHERE {has('votes', 's')} UNION ALL {_C} AND NOT ({has('votes', 's')})"),
    "instances": ("[ shnex:instancesOf s:Register ]", f"SELECT films.s, r.s FROM films, (SELECT DISTINCT s FROM q WHERE p = '{RDF.type}' AND o = '<{S_}Register>') r"),
    "matching": ("[ shnex:nodesMatching [ sh:property [ sh:path s:has_entry ; sh:minCount 2 ] ] ]", f"SELECT films.s, r.s FROM films, (SELECT s FROM q WHERE p = '{S_}has_entry' GROUP BY s HAVING count(*) > 1) r"),
    "flat": ("[ shnex:nodes [ shnex:pathValues s:starring ] ; shnex:flatMap [ shnex:pathValues s:actor ] ]", f"SELECT x.s, y.o {_P}"),
}


def node_expressions(spark, d: str) -> DataFrame:
    """The bags of nodes that all kinds of expressions give for every film: name, focus, value."""
    from quadloom.functions.terms import iri
    from quadloom.shacl.nodeexpr import NodeExpressions
    from quadloom.shacl.validate import Validator

    v = Validator(quads(spark, d), parse_turtle(HEAD + " ".join(f":x :{name} {text} ." for name, (text, _) in EXPRESSIONS.items())))
    ev, focus = NodeExpressions(v), v.instances(f"<{S_}Film>").select(F.col("node").alias("focus"))
    x = iri("http://kb.example/shape#x")
    parts = [ev.evaluate(ev.g.one(x, f"http://kb.example/shape#{name}"), focus).select(F.lit(name).alias("name"), "focus", F.explode("values").alias("value")) for name in EXPRESSIONS]
    return reduce(DataFrame.unionByName, parts)


QUERIES["node_expressions"] = node_expressions
SQL["node_expressions"] = BASE + " " + " UNION ALL ".join(f"SELECT '{name}' AS name, e.* FROM ({sql}) e(focus, value)" for name, (_, sql) in EXPRESSIONS.items())
