"""Validation: one plan per shape and constraint over frames of focus and value nodes.

Nodes are N3 ids. Whatever the number of focus nodes, a constraint is a join, an aggregate or a filter over
(focus, value); nested shapes are validated over the distinct value nodes at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, LITERAL, Term, parse_id
from quadloom.functions.values import IdVal, Val
from quadloom.functions.vocab import INTEGER_TYPES, NUMERIC_TYPES, RDF, RDFS, SH, SHNEX, XSD
from quadloom.operators.closure import closure, reachable
from quadloom.operators.graph_ops import collections
from quadloom.plans.graphs import QuadGraph
from quadloom.plans.staging import Staging
from quadloom.shacl.shapes import Constraint, Shape, ShapeError, Shapes
from quadloom.sparql.ast import Alternative, Inverse, Link, Repeat, Sequence

REPORT = "focus string, path string, value string, source_shape string, component string, source_constraint string, severity string, messages array<string>"
#: Least and greatest values of the bounded integer types.
RANGES = {
    "byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "unsignedByte": (0, 2**8 - 1), "unsignedShort": (0, 2**16 - 1),
    "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}


@dataclass
class Report:
    """``df`` has a row per result: focus, path, value, source_shape, component, source_constraint, severity, messages."""

    df: DataFrame

    @property
    def conforms(self) -> bool:
        """Whether no result is worse than a trace or debug one."""
        return not self.df.where(~F.col("severity").isin(SH.Debug, SH.Trace)).head(1)


def val(c: str | Column) -> IdVal:
    return IdVal(F.col(c) if isinstance(c, str) else c)


class _PartsVal(IdVal):
    """A value whose parts are columns that ``with_parts`` added."""

    def __init__(self, c: str):
        super().__init__(F.col(c))
        self.parts, self.numbers = F.col(f"{c}__parts"), F.col(f"{c}__numbers")

    def kind(self) -> Column:
        return self.parts["kind"]

    def lex(self) -> Column:
        return self.parts["lex"]

    def dtype(self) -> Column:
        return self.parts["dt"]

    def lang(self) -> Column:
        return self.parts["lang"]

    def num(self) -> Column:
        return self.numbers["num"]

    def ts(self) -> Column:
        return self.numbers["ts"]


def with_parts(df: DataFrame, c: str) -> DataFrame:
    """Add the parts of an id column, each computed once: a generator keeps Catalyst from inlining them where they are used."""
    x = val(c)
    parts = F.struct(x.kind().alias("kind"), x.lex().alias("lex"), x.dtype().alias("dt"), x.lang().alias("lang"))
    df = df.select("*", F.explode(F.array(parts)).alias(f"{c}__parts"))
    y = _PartsVal(c)
    return df.select("*", F.explode(F.array(F.struct(IdVal.num(y).alias("num"), IdVal.ts(y).alias("ts")))).alias(f"{c}__numbers"))


class Validator:
    def __init__(self, data: DataFrame, shapes: Shapes | list, staging: Staging | None = None):
        self.spark = data.sparkSession
        self.shapes = shapes if isinstance(shapes, Shapes) else Shapes(shapes)
        self.staging = staging or Staging(self.spark, "shacl")
        self.quads = data
        ids = data.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select(F.col("s.id").alias("s"), "p", F.col("o.id").alias("o"))
        self.ids = self.staging.cut(ids.distinct())  # read by every constraint, each with its filter on p
        self._super: DataFrame | None = None
        self._lists: DataFrame | None = None
        self.linked: bool | None = None
        self.open: list[str] = []

    # data ------------------------------------------------------------------------------------------------------------
    def p(self, iri: str) -> DataFrame:
        return self.ids.where(F.col("p") == iri).select("s", "o")

    def nodes(self, ids: list[str], name: str = "focus") -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], f"{name} string")

    def superclasses(self) -> DataFrame:
        """(sub, sup) of rdfs:subClassOf*, without the reflexive part."""
        if self._super is None:
            self._super = closure(self.p(RDFS.subClassOf).select(F.col("s").alias("a"), F.col("o").alias("b")), self.staging).select(F.col("a").alias("sub"), F.col("b").alias("sup"))
        return self._super

    def instances(self, cls: str) -> DataFrame:
        """(node) of a class id or its subclasses."""
        classes = self.superclasses().where(F.col("sup") == cls).select("sub").unionByName(self.nodes([cls], "sub")).distinct()
        t = self.p(RDF.type)
        return t.join(classes, t.o == F.col("sub"), "left_semi").select(F.col("s").alias("node")).distinct()

    def lists(self) -> DataFrame:
        """(list, items, ok): list heads with their items; ok if every cell has one first and one rest and the end is rdf:nil."""
        if self._lists is None:
            cells = self.quads.where(F.col("p").isin(RDF.first, RDF.rest)).select("s", "p", "o")
            whole = collections(cells, self.staging).select("list", "items")
            n = self.p(RDF.rest).groupBy(F.col("s").alias("cell")).agg(F.count(F.lit(1)).alias("rests"), F.min("o").alias("next"))
            m = self.p(RDF.first).groupBy(F.col("s").alias("cell2")).agg(F.count(F.lit(1)).alias("firsts"))
            good = n.join(m, F.col("cell") == F.col("cell2")).where("rests = 1 AND firsts = 1").select("cell", "next")
            # as many good cells in a row as the list has items, the last of which ends in nil
            steps = reachable(good.where(F.col("next") != f"<{RDF.nil}>").select(F.col("cell").alias("a"), F.col("next").alias("b")), whole.select(F.col("list").alias("n")), staging=self.staging)
            chain = steps.select(F.col("a").alias("list"), F.col("b").alias("cell")).unionByName(whole.select("list", F.col("list").alias("cell"))).join(good, "cell")
            ends = chain.groupBy("list").agg(F.count(F.lit(1)).alias("cells"), F.max((F.col("next") == f"<{RDF.nil}>").cast("int")).alias("ended"))
            self._lists = whole.join(ends, "list", "left").select("list", "items", F.coalesce((F.col("cells") == F.size("items")) & (F.col("ended") == 1), F.lit(False)).alias("ok"))
        return self._lists

    def edges(self, path) -> DataFrame:
        """(a, b) pairs of a path."""
        if isinstance(path, Link):
            return self.p(path.iri).select(F.col("s").alias("a"), F.col("o").alias("b"))
        if isinstance(path, Inverse):
            e = self.edges(path.path)
            return e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if isinstance(path, Alternative):
            return reduce(DataFrame.unionByName, map(self.edges, path.parts)).distinct()
        if isinstance(path, Sequence):
            out = self.edges(path.parts[0])
            for x in path.parts[1:]:
                nxt = self.edges(x).select(F.col("a").alias("m"), F.col("b").alias("c"))
                out = out.join(nxt, F.col("b") == F.col("m")).select("a", F.col("c").alias("b")).distinct()
            return out
        e = self.edges(path.path)
        out = e if path.most == 1 else closure(e, self.staging)
        if path.least == 0:
            nodes = self.ids.select(F.explode(F.array("s", "o")).alias("a")).distinct()
            out = out.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
        return out

    def values(self, path, focus: DataFrame) -> DataFrame:
        """(focus, value), each pair once."""
        if isinstance(path, Inverse) and isinstance(path.path, Inverse):
            return self.values(path.path.path, focus)
        if isinstance(path, Sequence):
            out = focus.select("focus", F.col("focus").alias("value"))
            for x in path.parts:
                step = self.values(x, out.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("m"), F.col("value").alias("c"))
                out = out.join(step, F.col("value") == F.col("m")).select("focus", F.col("c").alias("value")).distinct()
            return out
        if isinstance(path, Repeat):
            e = self.edges(path.path)
            if path.most == 1:
                pairs = e.join(focus, e.a == F.col("focus"), "left_semi")
            else:
                pairs = reachable(e, focus.select(F.col("focus").alias("n")), staging=self.staging)
            out = pairs.select(F.col("a").alias("focus"), F.col("b").alias("value"))
            if path.least == 0:
                out = out.unionByName(focus.select("focus", F.col("focus").alias("value")))
            return out.distinct()
        e = self.edges(path)
        return e.join(focus.select("focus"), e.a == F.col("focus")).select("focus", F.col("b").alias("value")).distinct()

    # targets ---------------------------------------------------------------------------------------------------------
    def targets(self, s: Shape) -> DataFrame | None:
        parts = []
        fixed = [x.id for k, x in s.targets if k == "targetNode"]
        if fixed:
            parts.append(self.nodes(fixed))
        for k, x in s.targets:
            if k == "targetClass":
                parts.append(self.instances(x.id).select(F.col("node").alias("focus")))
            elif k == "targetSubjectsOf":
                parts.append(self.p(x.lex).select(F.col("s").alias("focus")))
            elif k == "targetObjectsOf":
                parts.append(self.p(x.lex).select(F.col("o").alias("focus")))
            elif k == "sparql":
                from quadloom.shacl.sparql import select_nodes

                parts.append(select_nodes(self, x))
            elif k == "targetWhere":
                everyone = self.ids.select(F.explode(F.array("s", "o")).alias("focus")).distinct()
                parts.append(self.conforming(self.shapes.shape(x), everyone))
        if self.linked is None:
            self.linked = bool(self.p(SH.shape).head(1))
        if self.linked:
            parts.append(self.p(SH.shape).where(F.col("o") == s.id.id).select(F.col("s").alias("focus")))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else None

    # evaluation ------------------------------------------------------------------------------------------------------
    def violators(self, s: Shape, nodes: DataFrame) -> DataFrame:
        """(focus) of the nodes (column focus) that have any result."""
        parts = [r.select("focus") for r in self.results(s, nodes)]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else nodes.select("focus").limit(0)

    def conforming(self, s: Shape, nodes: DataFrame) -> DataFrame:
        return nodes.select("focus").distinct().join(self.violators(s, nodes), "focus", "left_anti")

    def results(self, s: Shape, focus: DataFrame) -> list[DataFrame]:
        if s.deactivated:
            return []
        if s.id.id in self.open:
            raise ShapeError(f"the shape {s.id} refers to itself")
        self.open.append(s.id.id)
        try:
            focus = focus.select("focus").distinct()
            if s.values is not None:
                from quadloom.shacl.nodeexpr import NodeExpressions

                value = NodeExpressions(self).pairs(s.values, focus)
            elif s.path is not None:
                value = self.values(s.path, focus)
            else:
                value = focus.select("focus", F.col("focus").alias("value"))
            out = []
            for c in s.constraints:
                if "deactivated" in c.extra and c.extra["deactivated"].lex == "true":
                    continue
                out += self.constraint(s, c, focus, value)
            return out
        finally:
            self.open.pop()

    def row(self, s: Shape, c: Constraint, df: DataFrame, value: Column | str | None = None, path: Column | None = None, constraint: str | None = None, message: Column | None = None) -> DataFrame:
        v = F.lit(None).cast("string") if value is None else F.col(value) if isinstance(value, str) else value
        severity = c.extra["severity"].lex if "severity" in c.extra else s.severity
        texts = [c.extra["message"].id] if "message" in c.extra else [m.id for m in s.messages]
        messages = F.array(*[F.lit(t) for t in texts]).cast("array<string>")
        if message is not None and not texts:
            messages = F.array_compact(F.array(message))
        return df.select(
            "focus", (F.lit(s.path_id).cast("string") if path is None else path).alias("path"), v.alias("value"), F.lit(s.id.id).alias("source_shape"), F.lit(c.component).alias("component"),
            F.lit(constraint).cast("string").alias("source_constraint"), F.lit(severity).alias("severity"), messages.alias("messages"),
        )

    def constraint(self, s: Shape, c: Constraint, focus: DataFrame, value: DataFrame) -> list[DataFrame]:
        k, v = c.kind, c.value
        f = getattr(self, "_" + k, None)
        if f is not None:
            out = f(s, c, focus, value)
            return out if isinstance(out, list) else [out]
        if k not in ("in", "nodeKind"):
            value = with_parts(value, "value")
        test = self._test(k, v, c)  # a test of single values: true is a violation
        return [self.row(s, c, value.where(test), "value")]

    def _test(self, k: str, v, c: Constraint) -> Column:
        x = val("value") if k in ("in", "nodeKind") else _PartsVal("value")
        bad = lambda ok: ~F.coalesce(ok, F.lit(False))
        if k == "nodeKind":
            kinds = {t.lex.rsplit("#", 1)[-1] for t in (v if isinstance(v, list) else [v])}
            allowed = [i for i, n in enumerate(("BlankNode", "IRI", "Literal")) if any(n in kind for kind in kinds)]
            return bad(x.kind().isin(allowed))
        if k == "datatype":
            return bad(reduce(lambda a, b: a | b, [well_formed(x, t.lex) for t in (v if isinstance(v, list) else [v])]))
        if k in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"):
            op = {"minInclusive": lambda a, b: a >= b, "minExclusive": lambda a, b: a > b, "maxInclusive": lambda a, b: a <= b, "maxExclusive": lambda a, b: a < b}[k]
            return bad(ordered(x, val(F.lit(v.id)), op))
        if k in ("minLength", "maxLength"):
            n = F.char_length(F.when(x.kind() != 0, x.lex()))
            return bad(n >= int(v.lex) if k == "minLength" else n <= int(v.lex))
        if k == "pattern":
            flags = "".join(f for f in c.extra.get("flags", "") if f in "ismx")
            try:
                self.spark._jvm.java.util.regex.Pattern.compile(v.lex)
            except IllegalArgumentException:
                raise ShapeError(f"{v.lex!r} is no regular expression") from None
            return bad(F.when(x.kind() != 0, x.lex()).rlike((f"(?{flags})" if flags else "") + v.lex))
        if k == "languageIn":
            lang = x.lang()
            return bad(reduce(lambda a, b: a | b, [(lang == t.lex.lower()) | lang.startswith(t.lex.lower() + "-") for t in v], F.lit(False)))
        if k == "in":
            return bad(F.col("value").isin([t.id for t in v]))
        if k == "singleLine":
            return bad(~x.lex().rlike(r"[\n\r\f\x0B]"))
        raise ShapeError(f"unknown constraint {k}")

    # counts and single values
    def _minCount(self, s, c, focus, value):
        n = int(c.value.lex)
        if n <= 0:
            return []
        counts = value.groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
        return self.row(s, c, focus.join(counts, "focus", "left").where(F.coalesce("n", F.lit(0)) < n))

    def _maxCount(self, s, c, focus, value):
        counts = value.groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
        return self.row(s, c, counts.where(F.col("n") > int(c.value.lex)))

    def _hasValue(self, s, c, focus, value):
        return self.row(s, c, focus.join(value.where(F.col("value") == c.value.id), "focus", "left_anti"))

    def _class(self, s, c, focus, value):
        for t in c.value if isinstance(c.value, list) else [c.value]:
            inst = self.instances(t.id)
            value = value.join(inst, F.col("value") == F.col("node"), "left_anti")
        return self.row(s, c, value, "value")

    def _uniqueLang(self, s, c, focus, value):
        tagged = value.withColumn("lang", val("value").lang()).where("lang IS NOT NULL")
        return self.row(s, c, tagged.groupBy("focus", "lang").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    # pairs of properties
    def _other(self, t: Term, focus: DataFrame) -> DataFrame:
        path = Link(t.lex) if t.kind == IRI else self.shapes.graph.path(t)
        return self.values(path, focus).select(F.col("focus").alias("f2"), F.col("value").alias("v2"))

    def _equals(self, s, c, focus, value):
        other = self._other(c.value, focus)
        missing = value.join(other, F.expr("focus = f2 AND value = v2"), "left_anti").select("focus", "value")
        v = value.select(F.col("focus").alias("f1"), F.col("value").alias("v1"))
        extra = other.join(v, F.expr("f1 = f2 AND v1 = v2"), "left_anti").select(F.col("f2").alias("focus"), F.col("v2").alias("value"))
        return self.row(s, c, missing.unionByName(extra), "value")

    def _disjoint(self, s, c, focus, value):
        return self.row(s, c, value.join(self._other(c.value, focus), F.expr("focus = f2 AND value = v2"), "left_semi"), "value")

    def _subsetOf(self, s, c, focus, value):
        return self.row(s, c, value.join(self._other(c.value, focus), F.expr("focus = f2 AND value = v2"), "left_anti"), "value")

    def _lessThan(self, s, c, focus, value, op=lambda a, b: a < b):
        both = value.join(self._other(c.value, focus), F.col("focus") == F.col("f2"))
        both = with_parts(with_parts(both, "value"), "v2")
        a, b = _PartsVal("value"), _PartsVal("v2")
        iris = F.when((a.kind() == IRI) & (b.kind() == IRI), op(a.lex(), b.lex()))
        return self.row(s, c, both.where(~F.coalesce(ordered(a, b, op), iris, F.lit(False))), "value")

    def _lessThanOrEquals(self, s, c, focus, value):
        return self._lessThan(s, c, focus, value, lambda a, b: a <= b)

    # logic
    def _failing(self, shape: Term, value: DataFrame) -> DataFrame:
        """(bad) of the distinct value nodes that don't conform."""
        return self.violators(self.shapes.shape(shape), value.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("bad"))

    def _node(self, s, c, focus, value):
        return self.row(s, c, value.join(self._failing(c.value, value), F.col("value") == F.col("bad"), "left_semi"), "value")

    def _not(self, s, c, focus, value):
        return self.row(s, c, value.join(self._failing(c.value, value), F.col("value") == F.col("bad"), "left_anti"), "value")

    def _and(self, s, c, focus, value):
        bad = reduce(DataFrame.unionByName, [self._failing(t, value) for t in c.value]).distinct()
        return self.row(s, c, value.join(bad, F.col("value") == F.col("bad"), "left_semi"), "value")

    def _or(self, s, c, focus, value):
        for t in c.value:
            value = value.join(self._failing(t, value), F.col("value") == F.col("bad"), "left_semi")
        return self.row(s, c, value, "value")

    def _xone(self, s, c, focus, value):
        bad = reduce(DataFrame.unionByName, [self._failing(t, value) for t in c.value]).groupBy("bad").agg(F.count(F.lit(1)).alias("n"))
        counted = value.join(bad, F.col("value") == F.col("bad"), "left")
        return self.row(s, c, counted.where(F.coalesce("n", F.lit(0)) != len(c.value) - 1), "value")

    def _property(self, s, c, focus, value):
        return self.results(self.shapes.shape(c.value), value.select(F.col("value").alias("focus")))

    def _someValue(self, s, c, focus, value):
        good = value.join(self._failing(c.value, value), F.col("value") == F.col("bad"), "left_anti")
        return self.row(s, c, focus.join(good, "focus", "left_anti"))

    def _qualified(self, s, c, focus, value, wrong):
        good = value.join(self._failing(c.value, value), F.col("value") == F.col("bad"), "left_anti")
        if c.extra["disjoint"]:
            for t in self.shapes.siblings(s, c.value):
                good = good.join(self._failing(t, value), F.col("value") == F.col("bad"), "left_semi")
        counts = good.groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
        return self.row(s, c, focus.join(counts, "focus", "left").where(wrong(F.coalesce("n", F.lit(0)))))

    def _qualifiedMinCount(self, s, c, focus, value):
        return self._qualified(s, c, focus, value, lambda n: n < c.extra["count"])

    def _qualifiedMaxCount(self, s, c, focus, value):
        return self._qualified(s, c, focus, value, lambda n: n > c.extra["count"])

    # closed
    def _properties(self, shape: Shape, seen: set[str]) -> set[str]:
        if shape.id.id in seen:
            return set()
        seen.add(shape.id.id)
        out = set()
        for k in shape.constraints:
            if k.kind == "property":
                p = self.shapes.shape(k.value)
                if isinstance(p.path, Link):
                    out.add(p.path.iri)
            elif k.kind == "node":
                out |= self._properties(self.shapes.shape(k.value), seen)
        return out

    def _closed(self, s, c, focus, value):
        own = {p.path.iri for k in s.constraints if k.kind == "property" and isinstance((p := self.shapes.shape(k.value)).path, Link)}
        used = self.ids.join(value.select("focus", "value"), F.col("s") == F.col("value")).select("focus", "value", "p", "o")
        if c.value == "true":
            bad = used.where(~F.col("p").isin([*own, *c.extra["ignored"]] or [""]))
        else:  # by types: the properties of the shapes that are the node's classes or their superclasses
            rows = [(sh.id.id, p) for sh in list(self.shapes.by_id.values()) for p in self._properties(sh, set())]
            table = self.spark.createDataFrame(rows, "cls string, allowed string") if rows else self.spark.createDataFrame([], "cls string, allowed string")
            types = self.p(RDF.type).select(F.col("s").alias("n"), F.col("o").alias("sub"))
            wide = types.unionByName(types.join(self.superclasses(), "sub").select("n", F.col("sup").alias("sub")))
            allowed = wide.join(table, F.col("sub") == F.col("cls")).select(F.col("n"), "allowed").distinct()
            bad = used.where(~F.col("p").isin([*self._properties(s, set()), *c.extra["ignored"], RDF.type])).join(allowed, F.expr("value = n AND p = allowed"), "left_anti")
        return self.row(s, c, bad, "o", path=F.concat(F.lit("<"), "p", F.lit(">")))

    # lists
    def _with_lists(self, value: DataFrame) -> DataFrame:
        nil = F.col("value") == f"<{RDF.nil}>"
        joined = value.join(self.lists(), F.col("value") == F.col("list"), "left")
        return joined.select("focus", "value", F.when(nil, F.array().cast("array<string>")).otherwise(F.col("items")).alias("items"), F.when(nil, F.lit(True)).otherwise(F.coalesce("ok", F.lit(False))).alias("ok"))

    def _uniqueMembers(self, s, c, focus, value):
        bad = self._with_lists(value).where(~F.col("ok") | (F.size(F.array_distinct("items")) < F.size("items")))
        return self.row(s, c, bad, "value")

    def _minListLength(self, s, c, focus, value):
        return self.row(s, c, self._with_lists(value).where(~F.col("ok") | (F.size("items") < int(c.value.lex))), "value")

    def _maxListLength(self, s, c, focus, value):
        return self.row(s, c, self._with_lists(value).where(~F.col("ok") | (F.size("items") > int(c.value.lex))), "value")

    def _memberShape(self, s, c, focus, value):
        whole = self._with_lists(value)
        members = whole.where("ok").select("focus", F.col("value").alias("list"), F.explode("items").alias("value"))
        bad = members.join(self._failing(c.value, members), F.col("value") == F.col("bad"), "left_semi").select("focus", F.col("list").alias("value")).distinct()
        return self.row(s, c, bad.unionByName(whole.where("NOT ok").select("focus", "value")), "value")

    # reifiers, expressions and SPARQL
    def _reifierShape(self, s, c, focus, value):
        if not isinstance(s.path, Link):
            return []
        triples = value.withColumn("tt", F.concat(F.lit("<<( "), "focus", F.lit(f" <{s.path.iri}> "), "value", F.lit(" )>>")))
        reified = triples.join(self.p(RDF.reifies).select(F.col("s").alias("r"), F.col("o").alias("ro")), F.col("tt") == F.col("ro"))
        failing = self.violators(self.shapes.shape(c.value), reified.select(F.col("r").alias("focus"))).select(F.col("focus").alias("bad"))
        bad = reified.join(failing, F.col("r") == F.col("bad"), "left_semi").select("focus", "value").distinct()
        if c.extra["required"]:
            bad = bad.unionByName(triples.join(reified.select(F.col("tt").alias("t2")), F.col("tt") == F.col("t2"), "left_anti").select("focus", "value"))
        return self.row(s, c, bad, "value")

    def _expression(self, s, c, focus, value):
        from quadloom.shacl.nodeexpr import NodeExpressions

        nodes = value.select(F.col("value").alias("focus")).distinct()
        got = NodeExpressions(self).evaluate(c.value, nodes).select(F.col("focus").alias("n"), "values")
        true = Term(LITERAL, "true", XSD.boolean).id
        bad = value.join(got, F.col("value") == F.col("n"), "left").where(~F.coalesce((F.size("values") == 1) & (F.get("values", F.lit(0)) == true), F.lit(False)))
        return self.row(s, c, bad, "value", constraint=c.value.id)

    def _nodeByExpression(self, s, c, focus, value):
        """Each value conforms to every shape that the expression names for it."""
        from quadloom.shacl.nodeexpr import NodeExpressions

        nodes = value.select(F.col("value").alias("focus")).distinct()
        named = NodeExpressions(self).pairs(c.value, nodes).select(F.col("focus").alias("n"), F.col("value").alias("shape"))
        out = []
        for shape in list(self.shapes.by_id.values()):
            mine = value.join(named.where(F.col("shape") == shape.id.id), F.col("value") == F.col("n"), "left_semi")
            if shape.id.id not in self.open:
                out.append(self.row(s, c, mine.join(self._failing(shape.id, mine), F.col("value") == F.col("bad"), "left_semi"), "value"))
        return out

    def _sparql(self, s, c, focus, value):
        from quadloom.shacl.sparql import select_constraint

        return select_constraint(self, s, c, focus)

    def _component(self, s, c, focus, value):
        from quadloom.shacl.sparql import component_constraint

        return component_constraint(self, s, c, focus, value)

    def graph(self) -> QuadGraph:
        return QuadGraph(self.quads, union_default=True)


def ordered(a: Val, b: Val, op) -> Column:
    """Comparison of numbers, of instants with zones, of wall times without; NULL where they don't compare."""
    na, nb, ta, tb = a.num(), b.num(), a.ts(), b.ts()
    zoned = lambda x: x.lex().rlike(r"(Z|[+-]\d\d:\d\d)$") & (F.char_length(x.lex()) > 10)
    same_kind = a.dtype() == b.dtype()
    times = F.when(ta.isNotNull() & tb.isNotNull() & same_kind & (zoned(a) == zoned(b)), op(ta, tb))
    text = F.when((a.dtype() == XSD.string) & (b.dtype() == XSD.string), op(a.lex(), b.lex()))
    exact = op(a.lex().try_cast("decimal(38,18)"), b.lex().try_cast("decimal(38,18)"))
    numbers = F.when(na.isNotNull() & nb.isNotNull(), F.when(a.dtype().isin(XSD.double, XSD.float) | b.dtype().isin(XSD.double, XSD.float), op(na, nb)).otherwise(F.coalesce(exact, op(na, nb))))
    return F.coalesce(numbers, times, text)


def well_formed(x: Val, dt: str) -> Column:
    """Whether a value has a datatype and a lexical form that it allows."""
    lex, has = x.lex(), x.dtype() == dt
    name = dt[len(XSD) :] if dt.startswith(XSD) else None
    if dt in INTEGER_TYPES:
        form = lex.rlike(r"^[+-]?[0-9]+$")
        n = lex.try_cast("decimal(38,0)")
        low, high = RANGES.get(name, (None, None))
        for bound, ok in ((low, lambda n, b: n >= b), (high, lambda n, b: n <= b)):
            if bound is not None:
                form = form & F.coalesce(ok(n, F.lit(str(bound)).cast("decimal(38,0)")), F.lit(False))
        return has & form
    if dt == XSD.decimal:
        return has & lex.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    if dt in (XSD.double, XSD.float):
        return has & lex.rlike(r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$")
    if dt == XSD.boolean:
        return has & lex.isin("true", "false", "1", "0")
    if dt in (XSD.date, XSD.dateTime):
        clock = r"T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)" if dt == XSD.dateTime else ""
        return has & lex.rlike(rf"^-?[0-9]{{4,}}-[0-9]{{2}}-[0-9]{{2}}{clock}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?$") & F.regexp_extract(lex, r"^-?([0-9]{4,}-[0-9]{2}-[0-9]{2})", 1).try_cast("date").isNotNull()
    if dt == XSD.time:
        return has & lex.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    return has


def validate(data: DataFrame, shapes: list | Shapes, staging: Staging | None = None) -> Report:
    """Validate a graph (quads; its graphs count as one) against shapes (driver-side quads, or read shapes)."""
    v = Validator(data, shapes, staging)
    parts: list[DataFrame] = []
    for s in list(v.shapes.by_id.values()):
        focus = None if s.deactivated else v.targets(s)
        if focus is not None:
            parts += v.results(s, focus)
    df = reduce(DataFrame.unionByName, parts) if parts else v.spark.createDataFrame([], REPORT)
    return Report(df)


__all__ = ["NUMERIC_TYPES", "Report", "SHNEX", "Validator", "parse_id", "validate"]
