import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from conftest import HEAD
from quadloom.functions.terms import Term, iri, literal, triple_term
from quadloom.functions.vocab import RDF, Prefixes
from quadloom.sources import io
from quadloom.sources.lines import LineError, parse_line, parse_lines, read_lines
from quadloom.sources.results import parse_json_results, parse_xml_results, same_solutions, write_json_results, write_xml_results
from quadloom.sources.turtle import parse_trig, parse_turtle
from quadloom.sources.writers import to_trig, to_turtle

DOC = HEAD + """ex:a a ex:C ; ex:p 1, "x"@en, 2.5, true, -3, "q\\"\\n\\u00e9", 'it''s' . """.replace("'it''s'", "'it'") + """ex:a ex:q [ ex:r ( 1 ex:b "z" ) ] . ex:C a rdfs:Class .
<< ex:a ex:p 1 >> ex:src ex:web . ex:x ex:t <<( ex:a ex:b 42 )>> . ex:l ex:items () ."""


def shape(quads):
    """Triples with blank nodes as one: enough to tell graphs of these tests apart."""
    norm = lambda t: "_:" if t.kind == 0 else t.id
    return sorted((norm(s), p.lex, norm(o) if o.kind != 3 else "tt") for _, s, p, o in quads)


def test_turtle_round_trip():
    quads = parse_turtle(DOC)
    text = to_turtle([q[1:] for q in quads], Prefixes({"ex": "http://example.org/"}))
    assert shape(parse_turtle(text)) == shape(quads)
    assert "( 1 ex:b \"z\" )" in text and text.index("ex:C a rdfs:Class") < text.index("ex:a a ex:C") and "owl:" not in text
    ring = parse_turtle("_:a <http://p> _:b . _:b <http://p> _:a .")
    assert len(parse_turtle(to_turtle([q[1:] for q in ring]))) == 2


@pytest.mark.parametrize("format", ["rdfxml", "jsonld"])
def test_other_round_trips(format):
    quads = [q for q in parse_turtle(DOC) if q[3].kind != 3]
    text = io.SERIALIZERS[format](quads, Prefixes({"ex": "http://example.org/"}))
    assert shape(io.PARSERS[format](text)) == shape(quads)


def test_trig():
    quads = parse_trig("PREFIX : <http://e/> :a :b :c . :g { :a :b :d . } GRAPH :h { :x :y 1 } [] { :a :b 1 }")
    assert len(quads) == 4 and {q[0].lex if q[0] and q[0].kind else None for q in quads} == {None, "http://e/g", "http://e/h"}
    again = parse_trig(to_trig([q for q in quads if q[0] is None or q[0].kind], Prefixes({"e": "http://e/"})))
    assert len(again) == 3


@pytest.mark.parametrize("bad", ["ex:a ex:b .", "<a> 'x' <b> .", "'x' <http://p> <http://o> .", "<http://a> <http://b> <http://c>", "@prefix x <http://a> .", "<http://a> <http://b> \"\\z\" .", "<a b> <http://b> 1 .", "[ <http://p> 1"])
def test_bad_turtle(bad):
    with pytest.raises(ValueError):
        parse_turtle(bad)


def test_rdfxml_features():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://base/" xml:lang="en">
      <e:T rdf:about="#x" e:attr="v"><e:p rdf:parseType="Resource"><e:q rdf:datatype="http://dt">1</e:q></e:p><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://m"/></e:l>
      <rdf:li>one</rdf:li><rdf:li rdf:ID="r">two</rdf:li><e:xml rdf:parseType="Literal"><b>z</b></e:xml><e:n rdf:nodeID="k"/></e:T></rdf:RDF>"""
    quads = io.PARSERS["rdfxml"](text)
    got = {(p.lex.replace("http://e/", "").replace(RDF, "rdf:"), o.lex) for _, _, p, o in quads}
    assert {("rdf:type", "http://e/T"), ("attr", "v"), ("q", "1"), ("rdf:first", "http://m"), ("rdf:rest", RDF.nil), ("rdf:_1", "one"), ("rdf:_2", "two"), ("rdf:type", RDF.Statement), ("n", "k")} <= got
    assert any(o.lang == "en" for *_, o in quads)
    for bad in ("<a/>", "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:li/></rdf:RDF>", "<x"):
        with pytest.raises(ValueError):
            io.PARSERS["rdfxml"](bad)
    with pytest.raises(ValueError):
        io.SERIALIZERS["rdfxml"]([(None, iri("http://a"), iri("http://e/p"), triple_term(iri("http://a"), iri("http://b"), literal(1)))], None)


def test_jsonld_features():
    doc = {"@context": {"@vocab": "http://e/", "@base": "http://b/", "knows": {"@type": "@id"}, "tags": {"@container": "@list"}, "name": {"@language": "en"}, "ex": "http://x/", "born": {"@id": "ex:born", "@type": "ex:date"}},
           "@id": "me", "@type": "P", "name": "A", "knows": "you", "tags": [1, 2.5], "born": "2000", "ok": True, "@reverse": {"likes": {"@id": "z"}}, "ex:n": {"@value": "v", "@language": "de"}, "none": None, "set": {"@set": ["p", "q"]}}
    got = {(s.lex, p.lex, o.id) for _, s, p, o in io.PARSERS["jsonld"](json.dumps(doc)) if s.kind}
    assert {("http://b/me", RDF.type, "<http://e/P>"), ("http://b/me", "http://e/name", '"A"@en'), ("http://b/me", "http://e/knows", "<http://b/you>"), ("http://b/me", "http://x/born", '"2000"^^<http://x/date>'),
            ("http://b/z", "http://e/likes", "<http://b/me>"), ("http://b/me", "http://x/n", '"v"@de'), ("http://b/me", "http://e/set", '"q"'), ("http://b/me", "http://e/ok", "true")} <= got
    assert len(io.PARSERS["jsonld"]('{"@id": "http://g", "@graph": [{"@id": "http://a", "http://p": 1}]}')) == 1
    for bad in ('{"@context": "http://remote/"}', "{"):
        with pytest.raises(ValueError):
            io.PARSERS["jsonld"](bad)


LINES = [
    ('<http://a> <http://b> "c"@en .', True), ("<http://a> <http://b> _:x <http://g> . # note", True), ("", None), ("# only a note", None), ("<http://a> <http://b> 5 .", False), ("<a> <http://b> <http://c> .", False),
    ('"a" <http://b> <http://c> .', False), ("<http://a> _:b <http://c> .", False), ("<http://a> <http://b> <http://c>", False), ('<http://a> <http://b> "\\u00e9\\U0001F600\\t" .', True), ('<http://a> <http://b> "\\x" .', False),
    ("<http://a> <http://b> <<( <http://a> <http://b> \"c\" )>> .", True), ("<http://a> <http://b> <<( \"c\" <http://b> <http://a> )>> .", False),
]


@pytest.mark.parametrize("line,ok", LINES, ids=[x[0] for x in LINES])
def test_lines(line, ok):
    if ok is False:
        with pytest.raises(LineError):
            parse_line(line)
    else:
        assert (parse_line(line) is not None) == bool(ok)


def test_line_files(spark, graph, tmp_path):
    q = graph("ex:a ex:p 1, \"tab\\t\\u0001\\U0001F600\", true . ex:g { ex:a ex:p 1 }", "trig")
    for format in ("ntriples", "nquads"):
        io.write(q, str(tmp_path / format), format)
    back = io.read(spark, str(tmp_path / "nquads"), "nquads")
    ids = lambda df: sorted((r.g or "", r.s.id, r.p, r.o.id) for r in df.collect())
    assert ids(back) == ids(q) and io.read(spark, str(tmp_path / "ntriples"), "ntriples").count() == 3
    (tmp_path / "bad.nt").write_text('<http://a> <http://b> "c" .\nnonsense\n<http://a> <http://b> "c" .\n')
    with pytest.raises(Exception):
        read_lines(spark, str(tmp_path / "bad.nt")).count()
    assert read_lines(spark, str(tmp_path / "bad.nt"), on_error="skip").count() == 1
    assert read_lines(spark, str(tmp_path / "bad.nt"), fix=lambda line, error: '<http://a> <http://b> "fixed" .').count() == 2


def test_files_of_all_formats(spark, graph, tmp_path):
    q = graph("ex:a ex:p 1 ; ex:q [ ex:r \"x\"@en ] .")
    for format, ending in (("turtle", "ttl"), ("trig", "trig"), ("rdfxml", "rdf"), ("jsonld", "jsonld")):
        path = str(tmp_path / f"f.{ending}")
        io.write(q, path, format, Prefixes({"ex": "http://example.org/"}))
        assert io.read(spark, path).count() == 3, format
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.ttl").write_text("_:b <http://e/p> 1 .")
    assert io.read(spark, str(tmp_path / "many"), "turtle").count() == 3
    assert io.serialize(q, "ntriples").count("\n") == 3


def test_detection():
    assert [io.detect("x.ttl"), io.detect("a/b.nq.gz"), io.detect("x.owl"), io.detect("x.unknown")] == ["turtle", "nquads", "rdfxml", None]
    assert io.detect(media_type="text/turtle; charset=utf-8") == "turtle"
    assert [io.detect(head=h) for h in (DOC, '<http://a:b> <http://a:c> "d" .\n', '<http://a> <http://b> <http://c> <http://g> .\n', '{"@id": "x"}', "<?xml ?>", "PREFIX : <http://e/>\n:g { :a :b :c }", "hello")] == ["turtle", "ntriples", "nquads", "jsonld", "rdfxml", "trig", None]
    io.register_parser("mine", lambda text, base=None, scope="": [])
    assert io.PARSERS.pop("mine")("") == []


ROWS = [{"a": iri("http://x"), "b": literal("l", lang="en", dir="rtl")}, {"a": Term(0, "n")}, {"b": triple_term(iri("http://s"), iri("http://p"), literal(5))}, {"b": literal("<&>")}]


@pytest.mark.parametrize("write,parse", [(write_xml_results, parse_xml_results), (write_json_results, parse_json_results)])
def test_results(write, parse):
    assert parse(write(["a", "b"], ROWS)) == (["a", "b"], ROWS)
    assert parse(write([], True)) == ([], True)
    assert same_solutions([{"a": literal(1)}], [{"a": literal("01", literal(1).dt)}]) and not same_solutions(ROWS, ROWS[:2])


def test_endpoint(spark):
    from quadloom.sources.endpoint import SparqlEndpoint, select

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            body = write_json_results(["s", "p", "o"], [{"s": iri("http://s"), "p": iri("http://p"), "o": literal(5)}]).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/sparql-results+json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert select(url, "SELECT * { ?s ?p ?o }")[0] == ["s", "p", "o"]
        spark.dataSource.register(SparqlEndpoint)
        row = spark.read.format("sparql").option("url", url).load().first()
        assert (row.s.id, row.p, row.o.id) == ("<http://s>", "http://p", "5")
        assert spark.read.format("sparql").option("url", url).option("predicates", "http://p http://q").load().count() == 2
    finally:
        server.shutdown()


def test_endpoint_pages_and_bound_ends(spark):
    import re

    from quadloom.sources.endpoint import SparqlEndpoint

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            import urllib.parse

            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            asked.append(query)
            rows = [{"s": iri(f"http://s{i}"), "p": iri("http://p"), "o": literal(i)} for i in range(25)]
            if "<http://s3>" in query:
                rows = [{k: v for k, v in rows[3].items() if k == "o"}]
            page = re.search(r"LIMIT (\d+) OFFSET (\d+)", query)
            if page:
                rows = rows[int(page[2]) :][: int(page[1])]
            body = write_json_results(["n"], [{"n": literal(len(rows))}]) if "COUNT" in query else write_json_results(["s", "p", "o"], rows)
            self.send_response(200)
            self.send_header("Content-Type", "application/sparql-results+json")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(SparqlEndpoint)
    load = lambda **o: spark.read.format("sparql").options(url=f"http://127.0.0.1:{server.server_port}/", **o).load()
    name = "spark.sql.python.filterPushdown.enabled"
    try:
        df = load(page_size="10")
        assert sorted(int(r.o.id) for r in df.collect()) == list(range(25)) and df.rdd.getNumPartitions() == 3
        bound = load(subject="<http://s3>", predicates="http://p").collect()
        assert [(r.s.id, r.p, r.o.id) for r in bound] == [("<http://s3>", "http://p", "3")] and "<http://s3> <http://p> ?o" in asked[-1]
        spark.conf.set(name, "true")
        pushed = load(pushdown="true").where("p = 'http://p' AND g = 'http://g'").collect()
        assert len(pushed) == 25 and "GRAPH <http://g> { ?s <http://p> ?o }" in asked[-1]
        assert load(predicates="http://p http://q", pushdown="true").where("p = 'http://other'").count() == 0
        assert load(pushdown="true").where("s.id = '_:b'").count() == 0
    finally:
        spark.conf.set(name, "false")
        server.shutdown()


def test_stream(spark, tmp_path):
    from quadloom.streaming.quads import append_stream, read_stream_table, stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.nq").write_text('<http://a> <http://b> "c" .\n<http://a> <http://b> "c" .\nbroken\n')
    go = lambda: append_stream(stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    go()
    assert read_stream_table(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "in" / "2.nq").write_text('<http://a> <http://b> "c" .\n<http://a> <http://b> "d" <http://g> .\n')
    go()
    assert read_stream_table(spark, str(tmp_path / "out")).count() == 2
    assert parse_lines(spark.createDataFrame([], "value string")).count() == 0


@pytest.mark.parametrize("format", ["turtle", "trig", "rdfxml", "jsonld"])
def test_parts_share_their_blank_nodes(spark, graph, tmp_path, monkeypatch, format):
    """Documents of many parts and pieces, with blank nodes and lists that reach from one into another."""
    from quadloom.sources import io

    monkeypatch.setattr(io, "CHUNK", 3)
    text = " ".join(f"_:b{i} ex:next _:b{i + 1} ; ex:n {i} ; ex:l ( {i} _:b{i} ) ." for i in range(40)) + ' ex:a ex:t "x & <y>"@en , "1"^^xsd:boolean , true , "007"^^xsd:integer , "a\\tb\\n\\"c\\"" .'
    q = graph(text)
    key = lambda df: sorted((r.s.id, r.p, r.o.id) for r in df.collect())
    io.write(q, str(tmp_path / "out"), format)
    assert key(io.read(spark, str(tmp_path / "out"), format, parts=True)) == key(q)
    io.write(q.limit(0), str(tmp_path / "none"), format)
    assert io.read(spark, str(tmp_path / "none"), format, parts=True).count() == 0


def test_jsonld_is_read_by_elements():
    """An outer array is never held as a whole: the quads come in lists, while the rest of the text isn't read yet."""
    from quadloom.sources.jsonld import JsonLdError, iter_jsonld

    text = json.dumps([{"@id": f"http://a{i}", "http://p": [{"@id": "http://b"}, i], "http://q": [{"http://r": 1}]} for i in range(100)], indent=1)
    lists = list(iter_jsonld(text, most=10))
    assert max(map(len, lists)) < 20 and sum(map(len, lists)) == 400
    assert len({s.id for x in lists for _, s, _, _ in x}) == 200  # new blank nodes stay different
    begun = iter_jsonld(text[:-1] + " nonsense", most=10)
    assert len(next(begun)) >= 10
    with pytest.raises(JsonLdError):
        list(begun)
    for bad in ("[1,]", "[1 2]", "[1", "[", "[] []", "[1],", '[{"@id": "x"}}'):
        with pytest.raises(JsonLdError):
            list(iter_jsonld(bad))
    assert [list(iter_jsonld(x)) for x in (" [ ] ", "[[{\"http://p\": 1}]]", "[null, 1]")] == [[[]]] * 3


@pytest.mark.parametrize("format", ["turtle", "trig", "rdfxml", "jsonld"])
def test_files_are_short_documents(spark, graph, tmp_path, monkeypatch, format):
    """However few the tasks, a file has no more than PIECES pieces, and is a document; repeated quads are written once."""
    monkeypatch.setattr(io, "CHUNK", 3)
    monkeypatch.setattr(io, "PIECES", 4)
    q = graph(" ".join(f"ex:a{i} ex:n {i} ; ex:m ex:a{i + 1} ." for i in range(100))).coalesce(1)
    io.write(q.unionByName(q), str(tmp_path / "out"), format)
    files = [f for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    each = [len(io.PARSERS[format](f.read_text())) for f in files]
    assert sum(each) == 200 and max(each) <= 4 * 6 and len(files) > 8
    ids = lambda df: sorted((r.s.id, r.p, r.o.id) for r in df.collect())
    assert ids(io.read(spark, str(tmp_path / "out"), format)) == ids(q)
