"""The plans that queries compile to."""

import re

import pytest

from quadloom.plans.graphs import QuadGraph, VirtualGraph, map_table
from quadloom.sparql.compiler import run_query

P = "PREFIX : <http://t#> "


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.range(100).selectExpr("id AS k", "id % 7 AS a", "CAST(id AS STRING) AS b", "id * 1.5D AS c", "id % 10 AS f").write.parquet(f"{d}/one")
    spark.range(10).selectExpr("id AS j", "concat('n', id) AS name").write.parquet(f"{d}/two")
    one = map_table(spark.read.parquet(f"{d}/one"), "http://t#One", "http://x/one/", ["k"], "http://t#", {"to": ("f", "http://x/two/")})
    two = map_table(spark.read.parquet(f"{d}/two"), "http://t#Two", "http://x/two/", ["j"], "http://t#")
    return VirtualGraph([one, two])


def plan(graph, text):
    df = run_query(graph, P + text).df
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan_of_its_columns(tables):
    p = plan(tables, "SELECT ?a (SUM(?c) AS ?t) { ?s a :One ; :a ?a ; :c ?c FILTER(?c > 10) } GROUP BY ?a")
    assert p.count("FileScan") == 1 and "Join" not in p and "GreaterThan(c,10.0)" in p
    assert re.search(r"ReadSchema: struct<a:bigint,c:double>", p)


def test_constant_subjects_and_objects_reach_the_scan(tables):
    p = plan(tables, "SELECT ?b { <http://x/one/5> :b ?b }")
    assert "EqualTo(k,5)" in p and "Join" not in p
    p = plan(tables, "SELECT ?s { ?s :to <http://x/two/3> }")
    assert "EqualTo(f,3)" in p
    assert run_query(tables, P + "SELECT ?b { <http://x/one/nonsense> :b ?b }").df.count() == 0
    assert run_query(tables, P + "SELECT ?b { <http://elsewhere/5> :b ?b }").df.count() == 0


def test_links_join_on_native_keys(tables):
    p = plan(tables, "SELECT ?s ?n { ?s :to ?t . ?t :name ?n }")
    assert p.count("Join") == 1 and "NestedLoop" not in p and "Cartesian" not in p and re.search(r"HashJoin \[v_t#\d+L\]|SortMergeJoin \[v_t", p)


def test_exists_and_minus_are_semi_and_anti_joins(tables):
    assert "LeftSemi" in plan(tables, "SELECT ?s { ?s a :One FILTER EXISTS { ?s :to ?t . ?t :name 'n3' } }")
    assert "LeftAnti" in plan(tables, "SELECT ?s { ?s a :Two MINUS { ?o :to ?s ; :a 3 } }")


def test_joins_over_unbound_variables_are_no_nested_loops(tables):
    p = plan(tables, "SELECT * { ?s :a ?a OPTIONAL { ?s :to ?t . ?t :name 'n3' } ?t :name ?n }")
    assert "Cartesian" not in p and p.count("Union") >= 1
    got = run_query(tables, P + "SELECT * { ?s :a ?a OPTIONAL { ?s :to ?t . ?t :name 'n3' } ?t :name ?n }").df.count()
    assert got == 10 + 90 * 10


def test_quad_patterns_carry_ids_only(spark, graph, tmp_path):
    graph("ex:a ex:p ex:b . ex:b ex:p ex:c .").write.parquet(str(tmp_path / "q"))
    g = QuadGraph(spark.read.parquet(str(tmp_path / "q")))
    p = run_query(g, "PREFIX ex: <http://example.org/> SELECT (COUNT(*) AS ?n) { ?x ex:p ?y . ?y ex:p ?z }").df._jdf.queryExecution().executedPlan().toString()
    assert "lex" not in p and "EqualTo(p,http://example.org/p)" in p and "ReadSchema: struct<g:string,s:struct<id:string>,p:string,o:struct<id:string>>" in p


def test_optional_columns_are_part_of_the_scan(spark):
    rows = [(1, "a", 5, 0), (2, None, 6, 1), (3, "c", None, None)]
    g = VirtualGraph([map_table(spark.createDataFrame(rows, "k long, b string, c long, f long"), "http://t#One", "http://x/one/", ["k"], "http://t#", {"to": ("f", "http://x/two/")})])
    text = "SELECT * { ?s a :One ; :k ?k OPTIONAL { ?s :b ?b } OPTIONAL { ?s :c ?c ; :to ?t } }"
    assert "Join" not in plan(g, text)
    got = sorted(((r.k, r.b, r.c, r.t) for r in run_query(g, P + text).df.collect()), key=repr)
    assert got == [(1, "a", 5, "http://x/two/0"), (2, None, 6, "http://x/two/1"), (3, "c", None, None)]
    for other in ("OPTIONAL { ?s :b ?k2 . ?s :c 5 }", "OPTIONAL { ?s :b ?b FILTER(?k > 1) }", "OPTIONAL { ?z :b ?b }", "OPTIONAL { ?s :b ?s2 } OPTIONAL { ?s :b ?s2 }"):
        assert "Join" in plan(g, "SELECT * { ?s a :One ; :k ?k " + other + " }"), other
    assert run_query(g, P + "SELECT ?k ?b { ?s a :One ; :k ?k OPTIONAL { ?s :b ?b FILTER(?k > 1) } FILTER(BOUND(?b)) }").df.collect()[0].k == 3
    assert run_query(g, P + "SELECT ?k { ?s :k ?k OPTIONAL { ?s :b ?b } OPTIONAL { ?r :b ?b ; :k ?m } }").df.count() == 4


def test_a_constant_predicate_or_graph_reads_one_folder(spark, graph, tmp_path):
    from quadloom.plans.dataset import Dataset

    q = graph("ex:a ex:p ex:b ; ex:q 1 . ex:b ex:p ex:c ; ex:r 2 .")
    named = q.unionByName(q.selectExpr("'http://example.org/g' AS g", "s", "p", "o"))
    for by in ("predicate", "graph"):
        Dataset(named).write(str(tmp_path / by), by)
    by_p, by_g = (Dataset.read(spark, str(tmp_path / by)) for by in ("predicate", "graph"))
    folders = lambda df: re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    x = "PREFIX ex: <http://example.org/> "
    found = by_p.query(x + "SELECT ?s ?o { ?s ex:p ?o }").df
    assert all("_part" in f for f in folders(found)) and found.count() == 2 and "_part" in folders(by_p.triples(p="http://example.org/p"))[0]
    assert not any("_part" in f for f in folders(by_p.query(x + "SELECT ?s { ?s ?p ?o }").df))
    inside = by_g.query(x + "SELECT ?s ?o { GRAPH ex:g { ?s ?p ?o } }").df
    assert all("_part" in f for f in folders(inside)) and inside.count() == 4
    assert by_g.query(x + "SELECT ?s { ?s ex:p ?o }").df.count() == 2 and by_g.query(x + "SELECT ?g { GRAPH ?g { ?s ex:p ?o } }").df.count() == 2
    assert by_p.count() == by_g.count() == 8 and by_p.quads.columns == ["g", "s", "p", "o"]
    after = by_p.update(x + "DELETE WHERE { ?s ex:p ?o }")
    assert after.count() == 6 and by_p.query(x + "ASK { ex:a ex:q 1 }").df.first()[0]


ODD = """1 , 1.0 , 1e0 , "01"^^xsd:integer , 0.0 , "-0.0"^^xsd:double , "NaN"^^xsd:double , "abc"^^xsd:integer , "abc" , "x" , "x"@en , "x"@de , "2020-01-01"^^xsd:date , "2020-01-01" ,
"2020-01-01T00:00:00Z"^^xsd:dateTime , "2020-01-01T01:00:00+01:00"^^xsd:dateTime , "2020-01-01T00:00:00" , true , "true" , "1"^^xsd:boolean , ex:a , _:b , "http://example.org/a" , <<( ex:a ex:p 1 )>> , "9007199254740993"^^xsd:integer"""


@pytest.mark.parametrize(
    "body,condition",
    [
        ("?a ex:p ?x . ?b ex:q ?y", "?x = ?y"), ("?b ex:q ?y . { ?a ex:p ?x }", "?y = ?x"), ("?a ex:p ?x . ?b ex:q ?y", "STR(?x) = STR(?y) && ?a != ?y"), ("?a ex:p ?x . ?b ex:q ?y", "?x + 1 = ?y + 1"),
        ("?a ex:p ?x . ?b ex:q ?y BIND(STR(?y) AS ?t)", "?x = ?y && ?t = STR(?x)"), ("?a ex:p ?x . ?t ex:r ?z . ?b ex:q ?y", "SUBJECT(?x) = ?z && ?y = ?x"), ("?a ex:p ?x . ?b ex:q ?y . ?y ex:r ?x", "?x = ?y"),
    ],
)
def test_equalities_join_what_has_no_common_variable(spark, graph, body, condition):
    """An = that a filter demands makes an equi-join that finds what comparing all pairs finds."""
    g = QuadGraph(graph(f"ex:s ex:p {ODD} . ex:t ex:q {ODD} . ex:a ex:r ex:a . _:u ex:r 1 ."), is_set=True)
    text = f"PREFIX ex: <http://example.org/> SELECT * {{ {body} FILTER(%s) }}"
    shape = lambda df: re.findall(r"CartesianProduct|NestedLoopJoin", df._jdf.queryExecution().executedPlan().toString())
    found, all_pairs = (run_query(g, text % c) for c in (condition, f"IF({condition}, true, false)"))
    rows = lambda r: sorted(map(repr, r.ids().collect()))
    assert rows(found) == rows(all_pairs)
    assert not shape(found.ids())
    if body == "?a ex:p ?x . ?b ex:q ?y":
        assert shape(all_pairs.ids()) and rows(found)


def test_equalities_of_what_may_be_unbound_wait(graph):
    g = QuadGraph(graph("ex:a ex:p 1 ; ex:z 5 . ex:b ex:p 2 . ex:c ex:q 5 ; ex:z 7 . ex:d ex:q 6 ."), is_set=True)
    rows = lambda c: sorted(map(repr, run_query(g, f"PREFIX ex: <http://example.org/> SELECT ?a ?b {{ {{ ?a ex:p ?x OPTIONAL {{ ?a ex:z ?z }} }} {{ ?b ex:q ?y }} FILTER({c}) }}").ids().collect()))
    assert rows("?z = ?y") == rows("IF(?z = ?y, true, false)") and len(rows("?z = ?y")) == 1
    assert rows("?x = ?y || ?x = 1") == rows("IF(?x = 1, true, false)") and len(rows("RAND() + ?x = ?y")) == 0


def test_triple_terms_are_joined_by_their_parts(spark, tmp_path):
    from quadloom.queries import rows

    spark.createDataFrame([(None, (f"<http://f/{i}>",), rows.COUNTRY, (f"<http://kb.example/country/0{i % 4}>",)) for i in range(40)], "g string, s struct<id:string>, p string, o struct<id:string>").selectExpr(
        "g", "named_struct('id', s.id, 'kind', 1Y, 'lex', s.id, 'dt', CAST(NULL AS STRING), 'lang', CAST(NULL AS STRING), 'dir', CAST(NULL AS STRING), 'num', CAST(NULL AS DOUBLE), 'ts', CAST(NULL AS TIMESTAMP)) AS s", "p",
        "named_struct('id', o.id, 'kind', 1Y, 'lex', o.id, 'dt', CAST(NULL AS STRING), 'lang', CAST(NULL AS STRING), 'dir', CAST(NULL AS STRING), 'num', CAST(NULL AS DOUBLE), 'ts', CAST(NULL AS TIMESTAMP)) AS o").write.parquet(f"{tmp_path}/quads.parquet")
    df = rows.QUERIES["fn_triples"](spark, str(tmp_path))
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 30
