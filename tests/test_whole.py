"""Queries that are to run over whole tables."""

import itertools

import pytest

import __spark_entry__

EX = "http://example.org/"
S = "http://kb.example/schema#"
DATA = f"""@prefix s: <{S}> .
ex:p1 s:character "A" ; s:actor ex:a ; s:note "x" . ex:p2 s:character "A" , "B" ; s:film ex:f . ex:p3 s:character "B" .
ex:f s:starring ex:p1 ; s:directed_by ex:d ; s:links_to ex:g . ex:g s:links_to ex:h . ex:w a s:Work . ex:k a s:Film , s:Actor .
"""


@pytest.fixture(scope="module")
def folder(graph, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    graph(DATA).write.parquet(f"{d}/quads.parquet")
    return str(d)


def triples(df):
    return {tuple(r) for r in df.collect()}


def test_sameas_carries_all_triples(spark, folder, short):
    got = {(short(s), p.split("#")[-1], short(o)) for s, p, o in triples(__spark_entry__.queries()["owl_ifp_sameas"](spark, folder))}
    ps = ("p1", "p2", "p3")
    given = {("p1", "character", '"A"'), ("p2", "character", '"A"'), ("p2", "character", '"B"'), ("p3", "character", '"B"'), ("p1", "actor", "a"), ("p1", "note", '"x"'), ("p2", "film", "f"), ("f", "starring", "p1")}
    holds = {(p, "sameAs", q) for p, q in itertools.permutations(ps, 2)} | {(q, p, o) for s, p, o in given if s in ps for q in ps} | {("f", "starring", q) for q in ps}
    assert got == holds - given


def test_rdfs_types_of_other_triples(spark, folder, short):
    got = triples(__spark_entry__.queries()["rdfs_closure"](spark, folder))
    assert (f"<{EX}w>", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", f"<{S}Thing>") in got and len(got) == 9


@pytest.mark.parametrize("name", ["rdfs_closure", "owl_ifp_sameas", "owl_transitive", "owl_inverse_symmetric", "owl_equivalents", "owl_key"])
def test_reasoning_reads_every_quad(spark, folder, monkeypatch, name):
    from quadloom.reasoning import rules

    seen = {}

    def spy(quads, regimes):
        seen["n"] = triples(quads.selectExpr("s.id", "p", "o.id"))
        raise StopIteration

    monkeypatch.setattr(rules, "expand", spy)
    with pytest.raises(StopIteration):
        __spark_entry__.queries()[name](spark, folder)
    assert triples(spark.read.parquet(f"{folder}/quads.parquet").selectExpr("s.id", "p", "o.id")) <= seen["n"]


def test_paths_from_every_start(spark, folder):
    run = lambda name: triples(__spark_entry__.queries()[name](spark, folder))
    quads = [(r[0], r[1].split("#")[-1], r[2]) for r in triples(spark.read.parquet(f"{folder}/quads.parquet").selectExpr("s.id", "p", "o.id"))]
    same = {(n, n) for s, _, o in quads for n in (s, o)}
    assert run("path_opt_all") == same | {(s, o) for s, p, o in quads if p == "links_to"}
    step = {(s, o) for s, p, o in quads if p in ("starring", "actor")}
    reach = step | {(a, d) for a, b in step for c, d in step if b == c}
    assert run("path_plus_all") == reach and run("path_star_all") == same | reach
