import pytest

from quadloom.functions.terms import iri
from quadloom.operators import graph_ops
from quadloom.operators.paths import link, none_of
from quadloom.plans.graphs import QuadGraph


def ids(df):
    return sorted((r.s.id, r.p, r.o.id) for r in df.collect())


def test_sets(graph):
    a, b = graph("ex:a ex:p 1, 2 ."), graph("ex:a ex:p 2, 3 .")
    assert len(ids(graph_ops.union(a, b))) == 3 and len(ids(graph_ops.intersection(a, b))) == 1 and len(ids(graph_ops.difference(a, b))) == 1
    assert graph_ops.parts(a, "s").count() == 1 and graph_ops.parts(a, "so").count() == 2 and graph_ops.all_nodes(a).count() == 3
    s, p = "<http://example.org/a>", "http://example.org/p"
    assert graph_ops.contains(a, s, p, "1") and not graph_ops.contains(a, s, p, "3") and graph_ops.value(a, s=s, p=p) == "1" and graph_ops.value(a, s=s, p="http://none/") is None
    with pytest.raises(ValueError):
        graph_ops.value(a, s=s)


@pytest.mark.parametrize("text,want", [("", True), ("ex:s ex:p ex:o .", True), ("ex:s ex:p ex:o . ex:x ex:p ex:y .", False), ("ex:s ex:p ex:o . ex:x ex:p ex:o . ex:x ex:q ex:z .", True), ("ex:a ex:p ex:a .", True)])
def test_connected(graph, text, want):
    assert graph_ops.connected(graph(text)).first()["connected"] is want


def test_collections(graph):
    q = graph("ex:a ex:l (1 2 3 4 5 6 7) . ex:b ex:l (ex:x) . _:r rdf:first 1 ; rdf:rest _:s . _:s rdf:first 2 ; rdf:rest _:r . _:h rdf:first 9 ; rdf:rest _:r .")
    lists = sorted(r["items"] for r in graph_ops.collections(q).collect())
    assert lists == [["1", "2", "3", "4", "5", "6", "7"], ["9", "1", "2"], ["<http://example.org/x>"]]


def test_path_builder(graph):
    g = QuadGraph(graph("ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:p ex:d . ex:a ex:q ex:c ."), is_set=True)
    e = "http://example.org/"
    p, q, a = link(e + "p"), link(e + "q"), iri(e + "a")
    ends = lambda path, **kw: sorted(r.o.strip("<>").replace(e, "") for r in path.pairs(g, **(kw or {"s": a})).collect())
    assert ends(p) == ["b"] and ends(p / p) == ["c"] and ends(p / p / p) == ["d"] and ends(p.plus) == ["b", "c", "d"] and ends(p.star) == ["a", "b", "c", "d"]
    assert ends(p.maybe) == ["a", "b"] and ends(p | q) == ["b", "c"] and ends(none_of(e + "p")) == ["c"] and ends(~p, s=iri(e + "b")) == ["a"]
    assert ends((~p).plus, s=iri(e + "d")) == ["a", "b", "c"] and ends(p / q) == []
    assert p.star.pairs(g).count() == 10


def test_collection_of_a_dataset(graph, spark):
    from quadloom.functions.terms import bnode, literal
    from quadloom.plans.dataset import Collection, Dataset

    ds = Dataset(graph("_:h rdf:first 1 ; rdf:rest _:t . _:t rdf:first ex:x ; rdf:rest () ."))
    c = Collection(ds, bnode("h"))
    assert len(c) == 2 and c[0] == "1" and c.index(iri("http://example.org/x")) == 1 and list(Collection(ds, bnode("none"))) == []
    longer = c.append(literal(3), bnode("new"))
    assert Collection(longer, bnode("h")).items() == ["1", "<http://example.org/x>", "3"] and len(c) == 2
    assert c.clear().count() == 0 and longer.count() == 6
