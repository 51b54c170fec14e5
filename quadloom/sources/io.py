"""Reading and writing graphs by format, and the registry of formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, LITERAL, QUADS, TERM, Term, id_kind, parse_id
from quadloom.functions.vocab import Prefixes
from quadloom.sources.jsonld import iter_jsonld, jsonld_nodes, parse_jsonld, to_jsonld
from quadloom.sources.lines import line_column, parse_line, read_lines, write_lines
from quadloom.sources.rdfxml import RDFXML_HEAD, RDFXML_TAIL, parse_rdfxml, rdfxml_descriptions, to_rdfxml
from quadloom.sources.turtle import parse_trig, parse_turtle
from quadloom.sources.writers import to_trig, to_turtle
from quadloom.sparql.update import add_quads

WHOLE = "s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL"
# File extensions and media types of the formats.
EXTENSIONS = {".ttl": "turtle", ".turtle": "turtle", ".trig": "trig", ".nt": "ntriples", ".ntriples": "ntriples", ".nq": "nquads", ".nquads": "nquads", ".rdf": "rdfxml", ".rdfs": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml", ".jsonld": "jsonld", ".json": "jsonld"}
MEDIA_TYPES = {"text/turtle": "turtle", "application/x-turtle": "turtle", "application/trig": "trig", "application/n-triples": "ntriples", "text/plain": "ntriples", "application/n-quads": "nquads", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld", "application/json": "jsonld"}


def _lines(quads: bool) -> Callable:
    return lambda text, base=None, scope="": [q for line in text.splitlines() if (q := parse_line(line, quads))]


#: Parsers of texts by format: (text, base, scope) to (g, s, p, o); serializers of such quads to text.
PARSERS: dict[str, Callable] = {"turtle": parse_turtle, "trig": parse_trig, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld, "ntriples": _lines(False), "nquads": _lines(True)}
SERIALIZERS: dict[str, Callable] = {
    "turtle": lambda quads, prefixes: to_turtle([q[1:] for q in quads], prefixes),
    "trig": to_trig,
    "rdfxml": lambda quads, prefixes: to_rdfxml([q[1:] for q in quads], prefixes),
    "jsonld": to_jsonld,
}


def register_parser(format: str, parser: Callable) -> None:
    PARSERS[format] = parser


def register_serializer(format: str, serializer: Callable) -> None:
    SERIALIZERS[format] = serializer


def detect(path: str | None = None, media_type: str | None = None, head: str | None = None) -> str | None:
    """The format by media type, file extension or, from the first 500 characters, content; None if nothing tells."""
    if media_type and media_type.partition(";")[0].strip().lower() in MEDIA_TYPES:
        return MEDIA_TYPES[media_type.partition(";")[0].strip().lower()]
    if path:
        name = re.sub(r"\.(gz|bz2)$", "", path.lower())
        m = re.search(r"\.[a-z]+$", name)
        if m and m.group() in EXTENSIONS:
            return EXTENSIONS[m.group()]
    if head is None:
        return None
    h = head[:500].lstrip("﻿ \t\r\n")
    if h[:1] in ("{", "[") and re.search(r'"@(context|id|graph|type|value)"', h):
        return "jsonld"
    if h.startswith("<?xml") or "<rdf:RDF" in h or h.startswith("<!DOCTYPE"):
        return "rdfxml"
    if re.search(r"(?mi)^\s*(@prefix|@base|prefix|base)\s", h):
        return "trig" if re.search(r"(?m)^\s*(GRAPH\s+)?\S*\s*\{", h) else "turtle"
    try:
        found = [q for line in h.split("\n")[:-1] or [h] if (q := parse_line(line))]
        return None if not found else "nquads" if any(q[0] for q in found) else "ntriples"
    except ValueError:
        return "turtle" if re.search(r"\s[.;]\s*$", h, re.MULTILINE) else None


def parse_text(spark: SparkSession, text: str, format: str, base: str | None = None) -> DataFrame:
    """The set of quads of one text."""
    from quadloom.plans.graphs import frame_of_terms

    return add_quads(spark.createDataFrame([], QUADS), frame_of_terms(spark, [(g if g is None or g.kind == IRI else None, s, p, o) for g, s, p, o in PARSERS[format](text, base, "")]))


def read(spark: SparkSession, path: str, format: str | None = None, base: str | None = None, parts: bool = False) -> DataFrame:
    """The set of quads in the files of a path.

    N-Triples and N-Quads are parsed line by line wherever Spark reads them. Files of the other formats are each parsed
    whole, many at once; blank node labels are kept apart by file, or, with ``parts``, mean the same in all files, as in
    what ``write`` makes. Graphs named by blank nodes count as the default.
    """
    format = format or detect(path)
    if format is None:
        first = spark.read.text(path).limit(10).collect()
        format = detect(head="\n".join(r["value"] for r in first) + "\n")
    if format is None:
        raise ValueError(f"the format of {path} isn't known")
    if format in ("ntriples", "nquads"):
        return read_lines(spark, path, format == "nquads")
    parser, most = PARSERS[format], CHUNK
    pieces = iter_jsonld if parser is parse_jsonld else lambda *a: iter([parser(*a)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                scope = "" if parts else "f" + hashlib.sha256(name.encode()).hexdigest()[:12]
                text = str(content.as_buffer(), "utf-8-sig")
                for quads in pieces(text, base or name, scope) if text.strip() else ():
                    for at in range(0, len(quads), most):
                        yield _record_batch(quads[at : at + most])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "g string, s string, p string, o string, " + ", ".join(f"{x}_{c} string" for x in "so" for c in _LITERAL)).dropDuplicates(["g", "s", "p", "o"])
    return found.select("g", _term_column("s").alias("s"), "p", _term_column("o").alias("o"))


#: What the ids of literals don't show at once; of other terms, the ids tell all.
_LITERAL = ("lex", "dt", "lang", "dir")


def _record_batch(quads: list) -> pa.RecordBatch:
    g, s, p, o = zip(*quads)
    columns = {"g": [x.lex or None if x is not None and x.kind == IRI else None for x in g], "s": _ids(s), "p": [x.lex for x in p], "o": _ids(o)}
    for name, terms in (("s", s), ("o", o)):
        is_literal = [x.kind == LITERAL for x in terms]
        for c in _LITERAL:
            columns[f"{name}_{c}"] = [getattr(x, c) if is_one else None for x, is_one in zip(terms, is_literal)] if any(is_literal) else pa.nulls(len(terms), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns.values()], list(columns))


def _ids(terms: tuple[Term, ...]) -> list[str]:
    out, last, id = [], None, None
    for t in terms:
        if t is not last:  # the quads of a node share its term
            last, id = t, t.id
        out.append(id)
    return out


def _term_column(name: str) -> Column:
    """The term of an id and its literal's columns, each field by itself: what isn't used isn't made."""
    id, part = F.col(name), {c: F.col(f"{name}_{c}") for c in _LITERAL}
    lex = F.coalesce(part["lex"], F.when(id.startswith("<<("), id).when(id.startswith("<"), F.substring(id, 2, F.length(id) - 2)).otherwise(F.substr(id, F.lit(3))))
    fields = {"id": id, "kind": id_kind(id)} | part | {"lex": lex, "num": F.lit(None), "ts": F.lit(None)}
    return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in TERM.fields])


#: Quads that a writer or reader holds at once, as terms, and pieces of so many quads in a file, which is read by one task.
CHUNK, PIECES = 10_000, 10


def _documents(format: str, prefixes: Prefixes | None) -> Callable:
    """Batches of sorted (g, s, p, o) ids to pieces of documents, PIECES each; pieces break between subjects if these have no more than CHUNK quads."""
    most, pieces = CHUNK, PIECES
    opening, between, closing = {"jsonld": ("[", ",", "]"), "rdfxml": (RDFXML_HEAD, "", RDFXML_TAIL)}.get(format, ("", "", ""))

    def piece(rows: list[tuple]) -> str:
        if format == "jsonld":
            return jsonld_nodes(rows)
        terms: dict[str, Term] = {}
        of = lambda x: terms[x] if x in terms else terms.setdefault(x, parse_id(x))
        quads = [(Term(IRI, g) if g else None, of(s), Term(IRI, p), of(o)) for g, s, p, o in rows]
        if format == "turtle":
            return to_turtle([q[1:] for q in quads], prefixes, inline=False)
        if format == "trig":
            return to_trig(quads, prefixes, inline=False)
        if format == "rdfxml":
            return rdfxml_descriptions([q[1:] for q in quads])
        return SERIALIZERS[format](quads, prefixes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        done = 0

        def next_piece(last: bool) -> pd.DataFrame:
            nonlocal done
            first, done = done % pieces == 0, done + 1
            return pd.DataFrame({"value": [(opening if first else between) + piece(rows) + (closing if last or done % pieces == 0 else "")]})

        for b in batches:
            for r in zip(b["g"], b["s"], b["p"], b["o"]):
                if rows:
                    if r == rows[-1]:
                        continue
                    if len(rows) >= most and (r[:2] != rows[-1][:2] or len(rows) >= 2 * most):
                        yield next_piece(False)
                        rows = []
                rows.append(r)
        if rows:
            yield next_piece(True)

    return run


def write(quads: DataFrame, path: str, format: str, prefixes: Prefixes | None = None) -> None:
    """Write a graph as a folder of text files; formats without graphs drop them.

    N-Triples and N-Quads are sorted lines. Of the other formats every file is a document, which a task writes piece by
    piece from its range of the sorted quads, and another when it has PIECES: a subject stands together unless it has very
    many, and blank nodes keep their labels, which mean the same in all files (``read`` with ``parts``). ``serialize``
    makes a single text.
    """
    if format in ("ntriples", "nquads"):
        write_lines(quads, path, format == "nquads")
        return
    graph = F.col("g") if format in ("trig", "jsonld") or format not in PARSERS else F.lit(None).cast("string").alias("g")
    rows = quads.where(WHOLE).select(graph, F.col("s.id").alias("s"), "p", F.col("o.id").alias("o"))
    ranges = rows.repartitionByRange("g", "s", "p", "o").sortWithinPartitions("g", "s", "p", "o")  # repetitions meet there
    ranges.mapInPandas(_documents(format, prefixes), "value string").write.option("maxRecordsPerFile", PIECES).text(path)


def serialize(quads: DataFrame, format: str, prefixes: Prefixes | None = None) -> str:
    """The text of a graph that fits the driver."""
    if format in ("ntriples", "nquads"):
        return "".join(r["value"] + "\n" for r in quads.select(line_column(format == "nquads").alias("value")).distinct().orderBy("value").toLocalIterator())
    rows = quads.select("g", F.col("s.id").alias("s"), "p", F.col("o.id").alias("o")).distinct().orderBy("g", "s", "p", "o").toLocalIterator()
    return SERIALIZERS[format]([(Term(IRI, r["g"]) if r["g"] else None, parse_id(r["s"]), Term(IRI, r["p"]), parse_id(r["o"])) for r in rows], prefixes)
