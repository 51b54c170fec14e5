"""N-Triples and N-Quads: distributed reading and writing by lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import BNODE, IRI, LITERAL, QUADS, TRIPLE, Term, _BAD_IRI, _parse_at, literal_id
from quadloom.functions.vocab import RDF

_REST = re.compile(r"\s*\.\s*(#.*)?$")
_SPACE = re.compile(r"\s*")
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


class LineError(ValueError):
    pass


def _valid(t: Term, role: str) -> Term:
    if t.kind == IRI and (_BAD_IRI.search(t.lex) or not _ABSOLUTE.match(t.lex)):
        raise LineError(f"{t.lex!r} is no absolute IRI")
    if t.kind == TRIPLE:
        s, p, o = t.parts
        if s.kind not in (IRI, BNODE) or p.kind != IRI:
            raise LineError("a triple term's subject or predicate is none")
        for x, r in ((s, "s"), (p, "p"), (o, "o")):
            _valid(x, r)
    if role == "s" and t.kind not in (IRI, BNODE) or role in ("p",) and t.kind != IRI or role == "g" and t.kind not in (IRI, BNODE):
        raise LineError(f"{t.id} can't stand there")
    return t


def parse_line(line: str, quads: bool = True) -> tuple | None:
    """(graph, s, p, o) of a line; None for an empty line or a comment; LineError for any other."""
    text = line.strip(" \t\r\n")
    if not text or text.startswith("#") or text.upper().startswith("VERSION "):
        return None
    try:
        s, at = _parse_at(text, 0, False)
        p, at = _parse_at(text, at, False)
        o, at = _parse_at(text, at, False)
        g = None
        if quads and text[_SPACE.match(text, at).end() :][:1] in ("<", "_"):
            g, at = _parse_at(text, at, False)
        if not _REST.match(text, at):
            raise LineError("the line doesn't end with a point")
        return (None if g is None else _valid(g, "g"), _valid(s, "s"), _valid(p, "p"), _valid(o, "o"))
    except LineError:
        raise
    except ValueError as e:
        raise LineError(str(e)) from None


def _reader(quads: bool, on_error: str, fix: Callable[[str, str], str | None] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for line in b["value"]:
                try:
                    q = parse_line(line, quads)
                except LineError as e:
                    again = fix(line, str(e)) if fix else None
                    if again is not None:
                        q = parse_line(again, quads)
                    elif on_error == "skip":
                        continue
                    else:
                        raise LineError(f"{e}: {line[:200]!r}") from None
                if q is not None:
                    g, s, p, o = q
                    rows.append((g if g is None else g.lex if g.kind == IRI else None, s.row(), p.lex, o.row()))
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return run


def parse_lines(lines: DataFrame, quads: bool = True, on_error: str = "raise", fix: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """Quads of a DataFrame with a column ``value`` of lines, batch or streaming; not yet a set.

    ``on_error`` is ``raise`` or ``skip``. ``fix`` is given a bad line and the error and may return another line, which
    is tried once. Graphs named by blank nodes count as the default graph.
    """
    from quadloom.functions.terms import TERM_DDL

    return lines.select("value").mapInPandas(_reader(quads, on_error, fix), f"g string, s {TERM_DDL}, p string, o {TERM_DDL}")


def read_lines(spark: SparkSession, path: str, quads: bool = True, on_error: str = "raise", fix=None) -> DataFrame:
    """The set of quads in the files of a path; each line is parsed where it is read."""
    from quadloom.sparql.update import add_quads

    return add_quads(spark.createDataFrame([], QUADS), parse_lines(spark.read.text(path), quads, on_error, fix))


def _escaped_controls(c: Column) -> Column:
    for i in [*range(0x20), 0x7F]:
        if chr(i) not in "\t\n\r":
            c = F.replace(c, F.lit(chr(i)), F.lit(f"\\u{i:04X}"))
    return c


def line_column(quads: bool = True) -> Column:
    """The N-Quads (or N-Triples) line of a row of quads; NULL where s, p or o is missing."""
    plain = literal_id(F.col("o.lex"), F.col("o.dt"), F.col("o.lang"), F.col("o.dir"), short=False)
    parts = [F.col("s.id"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), F.when(F.col("o.kind") == LITERAL, plain).otherwise(F.col("o.id"))]
    if quads:
        parts.append(F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat(_escaped_controls(F.concat_ws(" ", *parts)), F.lit(" .")))


def write_lines(df: DataFrame, path: str, quads: bool = True) -> None:
    """Sorted lines, each once, as text files."""
    df.select(line_column(quads).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").write.text(path)


__all__ = ["LITERAL", "RDF", "LineError", "parse_line", "parse_lines", "read_lines", "write_lines", "line_column"]
