"""SPARQL in shapes: compiled once, with the pre-bound variables as columns of a joined frame."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, Term, parse_id
from quadloom.functions.values import IdVal, Val
from quadloom.functions.vocab import SH
from quadloom.plans.frames import Frame, join
from quadloom.shacl.shapes import Constraint, Shape
from quadloom.sparql.ast import BGP, Alternative, Extend, Filter, Inverse, Join, LeftJoin, Link, Minus, Query, Repeat, Sequence, SubSelect, Union
from quadloom.sparql.compiler import Compiler
from quadloom.sparql.parser import Parser


class Preset:
    """A pattern whose solutions are a given frame."""

    def __init__(self, frame: Frame):
        self.frame = frame


class _Compiler(Compiler):
    def pattern(self, p, g=None, links=()):
        return p.frame if isinstance(p, Preset) else super().pattern(p, g, links)


def _seeded(p, preset: Preset):
    """The pattern with the preset joined where its first solutions come from, inside filters and optionals."""
    if isinstance(p, Filter):
        return Filter(p.condition, _seeded(p.inner, preset))
    if isinstance(p, Extend):
        return Extend(_seeded(p.inner, preset), p.var, p.expr)
    if isinstance(p, (LeftJoin, Minus, Join)):
        return replace(p, left=_seeded(p.left, preset))
    if isinstance(p, Union):
        return Union(_seeded(p.left, preset), _seeded(p.right, preset))
    if isinstance(p, BGP) and not p.triples:
        return preset
    if isinstance(p, SubSelect):
        return Join(preset, p)
    return Join(preset, p)


def path_text(p) -> str:
    if isinstance(p, Link):
        return f"<{p.iri}>"
    if isinstance(p, Inverse):
        return f"^({path_text(p.path)})" if not isinstance(p.path, Link) else f"^{path_text(p.path)}"
    if isinstance(p, Sequence):
        return "(" + "/".join(map(path_text, p.parts)) + ")"
    if isinstance(p, Alternative):
        return "(" + "|".join(map(path_text, p.parts)) + ")"
    if isinstance(p, Repeat):
        return f"({path_text(p.path)})" + ("?" if p.most == 1 else "*" if p.least == 0 else "+")
    raise ValueError("this path can't stand in a query")


def _run(v, owner: Term, text: str, frame: Frame, s: Shape | None) -> Frame:
    if s is not None and s.path is not None:
        text = re.sub(r"[$?]PATH\b", lambda m: path_text(s.path), text)
    p = Parser("".join(f"PREFIX {k}: <{n}>\n" for k, n in v.shapes.prefixes(owner).items()) + text)
    p.validate = lambda q: None  # pre-bound variables are no assignments
    q: Query = p.query()
    consts = {"currentShape": s.id, "shapesGraph": Term(IRI, "urn:x-shapes-graph")} if s is not None else {}
    for name, t in consts.items():
        frame = frame.extend(name, Val("iri", F.lit(t.lex)) if t.kind == IRI else IdVal(F.lit(t.id)), True)
    c = _Compiler(v.graph(), q.prefixes, q.base)
    q.where = _seeded(q.where, Preset(frame))
    if q.form == "ASK":
        return c.pattern(q.where)
    if q.select is not None:
        names = [n for n, _ in q.select]
        q.select = [(n, None) for n in frame.info if n not in names and q.group is None] + q.select
        if q.group is not None:
            from quadloom.sparql.ast import Var

            have = {n for n, _ in q.group}
            q.group = q.group + [(n, Var(n)) for n in frame.info if n not in have]
            q.select = [(n, None) for n in frame.info if n not in names] + q.select[0:] if not any(n in frame.info for n in names) else q.select
    return c.select(q)


def _focus_frame(focus: DataFrame, name: str = "this", column: str = "focus") -> Frame:
    return Frame.make(focus, {name: IdVal(F.col(column))})


def select_nodes(v, target: Term) -> DataFrame:
    """The focus nodes of a SPARQL target."""
    text = v.shapes.graph.one(target, SH.select).lex
    p = Parser("".join(f"PREFIX {k}: <{n}>\n" for k, n in v.shapes.prefixes(target).items()) + text)
    f = Compiler(v.graph()).select(p.query())
    return f.df.select(f.val("this").id().alias("focus")).distinct()


def _message(texts: list[Term], f: Frame):
    """The first message with {?name} and {$name} filled in."""
    if not texts:
        return None
    out, text = [], texts[0].lex
    for i, part in enumerate(re.split(r"\{[?$](\w+)\}", text)):
        if i % 2 == 0:
            out.append(F.lit(part))
        else:
            out.append(F.coalesce(f.val(part).lex(), F.lit("")) if part in f.info else F.lit("{?" + part + "}"))
    return F.concat(*out)


def _rows(v, s: Shape, c: Constraint, f: Frame, texts: list[Term], constraint: str) -> DataFrame:
    """Result rows of solutions: value and path from ?value and ?path."""
    value = f.val("value").id() if "value" in f.info else (f.val("this").id() if s.path is None else F.lit(None).cast("string"))
    path = F.coalesce(f.val("path").id(), F.lit(s.path_id).cast("string")) if "path" in f.info else F.lit(s.path_id).cast("string")
    message = _message(texts, f)
    df = f.df.select(f.val("this").id().alias("focus"), value.alias("value_"), path.alias("path_"), (F.lit(None).cast("string") if message is None else message).alias("message_"))
    return v.row(s, c, df, "value_", F.col("path_"), constraint, F.col("message_"))


def select_constraint(v, s: Shape, c: Constraint, focus: DataFrame) -> DataFrame:
    """sh:sparql: every solution for a focus node is a violation."""
    node: Term = c.value
    f = _run(v, node, v.shapes.graph.one(node, SH.select).lex, _focus_frame(focus), s)
    return _rows(v, s, c, f, v.shapes.graph.all(node, SH.message), node.id)


def component_constraint(v, s: Shape, c: Constraint, focus: DataFrame, value: DataFrame) -> list[DataFrame]:
    """A constraint component: an ASK per value, false is a violation; or a SELECT per focus node, a row is one."""
    spec = c.value
    validator = spec["property" if s.path is not None else "node"] or spec["validator"]
    if validator is None:
        return []
    g = v.shapes.graph
    ask, select = g.one(validator, SH.ask), g.one(validator, SH.select)
    texts = g.all(validator, SH.message)

    def with_arguments(f: Frame) -> Frame:
        for name, t in c.extra["arguments"].items():
            f = f.extend(name, IdVal(F.lit(t.id)), True)
        return f

    if select is not None:
        f = _run(v, validator, select.lex, with_arguments(_focus_frame(focus)), s)
        return [_rows(v, s, c, f, texts, spec["id"].id)]
    base = Frame.make(value, {"this": IdVal(F.col("focus")), "value": IdVal(F.col("value"))})
    f = _run(v, validator, ask.lex, with_arguments(base), s)
    good = f.df.select(f.val("this").id().alias("f2"), f.val("value").id().alias("v2"))
    bad = value.join(good, F.expr("focus = f2 AND value = v2"), "left_anti")
    return [v.row(s, c, bad, "value", constraint=spec["id"].id)]


__all__ = ["Preset", "component_constraint", "join", "parse_id", "select_constraint", "select_nodes"]
