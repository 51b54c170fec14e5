"""SPARQL Update over immutable snapshots: an update request gives a new quads DataFrame, or fails as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import BNODE, Term
from quadloom.plans.graphs import QuadGraph, frame_of_terms
from quadloom.plans.staging import Staging
from quadloom.sparql.ast import SparqlError, Update
from quadloom.sparql.compiler import Compiler
from quadloom.sparql.parser import parse_update


def _keyed(q: DataFrame) -> DataFrame:
    return q.select("g", "s", "p", "o", F.coalesce("g", F.lit("")).alias("_g"), F.col("s.id").alias("_s"), F.col("o.id").alias("_o"))


def add_quads(quads: DataFrame, new: DataFrame) -> DataFrame:
    """The set union of quads."""
    return _keyed(quads).unionByName(_keyed(new)).dropDuplicates(["_g", "_s", "p", "_o"]).select("g", "s", "p", "o")


def remove_quads(quads: DataFrame, gone: DataFrame) -> DataFrame:
    keys = _keyed(gone).select(F.col("_g").alias("x_g"), F.col("_s").alias("x_s"), F.col("p").alias("x_p"), F.col("_o").alias("x_o"))
    on = (F.col("_g") == F.col("x_g")) & (F.col("_s") == F.col("x_s")) & (F.col("p") == F.col("x_p")) & (F.col("_o") == F.col("x_o"))
    return _keyed(quads).join(keys, on, "left_anti").select("g", "s", "p", "o")


def _of(quads: DataFrame, where) -> DataFrame:
    """The quads of a graph: an IRI term, or DEFAULT."""
    return quads.where("g IS NULL") if where == "DEFAULT" else quads.where(F.col("g") == where.lex)


def _to(quads: DataFrame, where) -> DataFrame:
    g = F.lit(None).cast("string") if where == "DEFAULT" else F.lit(where.lex)
    return quads.withColumn("g", g)


def apply_update(quads: DataFrame, text: str | list[Update], loader: Callable[[str], DataFrame] | None = None, names: set[str] | None = None, staging: Staging | None = None) -> DataFrame:
    """The quads after an update request.

    Its operations follow each other over snapshots; nothing is published when one fails. The solutions of a DELETE or
    INSERT with WHERE are staged once; all deletions come before all insertions. ``loader`` gives the quads of an IRI to
    LOAD. ``names`` are graphs that exist though they may be empty, for which COPY, MOVE and ADD don't fail.
    """
    staging = staging or Staging(quads.sparkSession, "update")
    names = set(names or ())
    for n, u in enumerate(parse_update(text) if isinstance(text, str) else text):
        quads = _apply(quads, u, loader, names, staging, n)
    return quads


def _apply(quads: DataFrame, u: Update, loader, names: set[str], staging: Staging, n: int) -> DataFrame:
    spark = quads.sparkSession
    if u.kind in ("INSERT DATA", "DELETE DATA"):
        rows = []
        for g, t in u.insert or u.delete:
            s, o = (Term(BNODE, f"u{n}{x.lex}") if isinstance(x, Term) and x.kind == BNODE else x for x in (t.s, t.o))
            rows.append((g, s, t.p, o))
        data = frame_of_terms(spark, rows)
        return add_quads(quads, data) if u.kind == "INSERT DATA" else remove_quads(quads, data)
    if u.kind == "MODIFY":
        default, named = None, None
        if u.using or u.using_named:
            default, named = list(u.using), list(u.using_named)
        elif u.with_graph:
            default = [u.with_graph]
        graph = QuadGraph(quads, default=default, named=named)
        c = Compiler(graph, u.prefixes, u.base)
        f = c.pattern(u.where)
        cut = staging.cut(f.df)
        f = type(f)(cut, f.info)
        home = F.lit(u.with_graph) if u.with_graph else None
        if u.delete:
            quads = remove_quads(quads, c.construct(f, u.delete, home))
        if u.insert:
            quads = add_quads(quads, c.construct(f, u.insert, home))
        return quads
    if u.kind in ("CLEAR", "DROP"):
        if isinstance(u.target, Term):
            names.discard(u.target.lex) if u.kind == "DROP" else None
            return quads.where(F.col("g").isNull() | (F.col("g") != u.target.lex))
        return {"DEFAULT": quads.where("g IS NOT NULL"), "NAMED": quads.where("g IS NULL"), "ALL": quads.limit(0)}[u.target]
    if u.kind == "CREATE":
        names.add(u.target.lex)
        return quads
    if u.kind == "LOAD":
        try:
            if loader is None:
                raise SparqlError(f"no loader for {u.source}")
            new = loader(u.source)
        except Exception:
            if u.silent:
                return quads
            raise
        return add_quads(quads, new.withColumn("g", F.lit(u.target).cast("string")) if u.target else new)
    # ADD, COPY, MOVE
    if u.source == u.target:
        return quads
    if isinstance(u.source, Term) and u.source.lex not in names and not _of(quads, u.source).head(1):
        if u.silent:
            return quads
        raise SparqlError(f"no graph {u.source.lex}")
    moved = _to(_of(quads, u.source), u.target)
    rest = quads
    drop = [u.target] if u.kind == "COPY" else [u.target, u.source] if u.kind == "MOVE" else []
    for where in drop:
        rest = rest.where("g IS NOT NULL") if where == "DEFAULT" else rest.where(F.col("g").isNull() | (F.col("g") != where.lex))
    return add_quads(rest, moved)
