import quadloom
from quadloom.sources.turtle import parse_turtle


def test_public_names():
    assert all(getattr(quadloom, n) is not None for n in quadloom.__all__)


def test_isomorphic():
    same = quadloom.isomorphic
    a = parse_turtle("_:a <http://p> _:b . _:b <http://p> _:c . _:c <http://p> _:a . _:a <http://q> 1 .")
    b = parse_turtle("_:x <http://p> _:y . _:y <http://p> _:z . _:z <http://p> _:x . _:y <http://q> 1 .")
    assert same(a, b) and same(a, list(reversed(a))) and not same(a, a[:-1])
    two = parse_turtle("_:a <http://p> _:b . _:b <http://p> _:a . _:c <http://p> _:d . _:d <http://p> _:c .")
    four = parse_turtle("_:a <http://p> _:b . _:b <http://p> _:c . _:c <http://p> _:d . _:d <http://p> _:a .")
    assert not same(two, four) and same(two, two) and same(four, four)
    assert same([], []) and not same(a, [])


def test_registered_function(spark, graph):
    from quadloom.functions.values import integer
    from pyspark.sql import functions as F

    quadloom.register_function("http://f/len", lambda v: integer(F.char_length(v.lex())))
    g = quadloom.QuadGraph(graph('ex:a ex:p "four" .'), is_set=True)
    assert quadloom.run_query(g, "SELECT (<http://f/len>(?v) AS ?n) { ?s ?p ?v }").df.first()["n"] == 4
