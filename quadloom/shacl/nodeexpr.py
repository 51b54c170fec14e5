"""Node expressions: for every focus node an ordered bag of nodes, held as an array of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, LITERAL, Term, literal_id
from quadloom.functions.values import IdVal, decimal_text, number_text
from quadloom.functions.vocab import RDF, SHNEX, XSD
from quadloom.shacl.shapes import ShapeError


def _boolean(c: Column) -> Column:
    return F.when(c, F.lit(Term(LITERAL, "true", XSD.boolean).id)).otherwise(F.lit(Term(LITERAL, "false", XSD.boolean).id))


class NodeExpressions:
    def __init__(self, validator):
        self.v = validator
        self.g = validator.shapes.graph

    def pairs(self, e: Term, focus: DataFrame) -> DataFrame:
        """(focus, value) of an expression, each pair once."""
        return self.evaluate(e, focus).select("focus", F.explode("values").alias("value")).distinct()

    def _bag(self, focus: DataFrame, rows: DataFrame) -> DataFrame:
        """Arrays of (focus, at, value); empty for focus nodes without rows."""
        got = rows.groupBy("focus").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
        return focus.join(got, "focus", "left").select("focus", F.coalesce("values", F.array().cast("array<string>")).alias("values"))

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select("focus", F.posexplode("values").alias("at", "value"))

    def _each(self, e: Term, focus: DataFrame, f) -> DataFrame:
        return self.evaluate(e, focus).select("focus", f(F.col("values")).alias("values"))

    def _integer(self, e: Term) -> int:
        if e.kind != LITERAL:
            raise ShapeError(f"{e} is no number")
        return int(e.lex)

    def evaluate(self, e: Term, focus: DataFrame) -> DataFrame:
        """(focus, values) for each of the distinct focus nodes."""
        focus = focus.select("focus").distinct()
        one = lambda name: self.g.one(e, SHNEX[name])
        if e.kind == LITERAL:
            return focus.select("focus", F.array(F.lit(e.id)).alias("values"))
        if e.lex == RDF.nil and e.kind == IRI:
            return focus.select("focus", F.array().cast("array<string>").alias("values"))
        if self.g.one(e, RDF.first) is not None:
            return self._concat(self.g.list(e), focus)
        if e.kind == IRI:
            return focus.select("focus", F.array(F.lit(e.id)).alias("values"))
        nodes = one("nodes")
        if one("var") is not None:
            if one("var").lex not in ("focusNode", "this"):
                raise ShapeError(f"no variable {one('var').lex}")
            return focus.select("focus", F.array("focus").alias("values"))
        if one("pathValues") is not None:
            path = self.g.path(one("pathValues"))
            start = one("focusNode")
            if start is None:
                pairs = self.v.values(path, focus)
            else:
                froms = self.pairs(start, focus).select(F.col("focus").alias("f0"), F.col("value").alias("start"))
                reach = self.v.values(path, froms.select(F.col("start").alias("focus")).distinct())
                pairs = froms.join(reach, F.col("start") == F.col("focus")).select(F.col("f0").alias("focus"), "value")
            return self._bag(focus, pairs.select("focus", F.lit(0).alias("at"), "value"))
        for name in ("count", "exists"):
            same = self._set_of(one(name)) if one(name) is not None else None
            if same is not None:  # of a set that is the same for all focus nodes: a number, no array
                n = same.agg(F.count(F.lit(1)).alias("n"))
                shown = literal_id(F.col("n").cast("string"), F.lit(XSD.integer)) if name == "count" else _boolean(F.col("n") > 0)
                return focus.join(F.broadcast(n.select(F.array(shown).alias("values"))))  # one row
        if one("count") is not None:
            return self._each(one("count"), focus, lambda a: F.array(literal_id(F.size(a).cast("string"), F.lit(XSD.integer))))
        if one("sum") is not None:
            inner = self._flat(one("flatMap"), nodes or one("sum"), focus) if one("flatMap") is not None else self.evaluate(nodes or one("sum"), focus)
            return self._sum(focus, inner)
        for name, best in (("min", F.min), ("max", F.max)):
            if one(name) is not None:
                rows = self._rows(self.evaluate(one(name), focus))
                x = IdVal(F.col("value"))
                top = rows.groupBy("focus").agg(best(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(x.order())], F.col("value"))).alias("b"))
                return self._bag(focus, top.select("focus", F.lit(0).alias("at"), F.col("b.value").alias("value")))
        if one("exists") is not None:
            return self._each(one("exists"), focus, lambda a: F.array(_boolean(F.size(a) > 0)))
        if one("distinct") is not None:
            return self._each(one("distinct"), focus, F.array_distinct)
        if one("concat") is not None:
            return self._concat(self.g.list(one("concat")), focus)
        if one("intersection") is not None:
            parts = [self.evaluate(x, focus) for x in self.g.list(one("intersection"))]
            return reduce(lambda a, b: self._zip(a, b, lambda x, y: F.filter(x, lambda i: F.array_contains(y, i))), parts)
        for name in ("filterShape", "findFirst", "matchAll"):
            if one(name) is not None:
                rows = self._rows(self.evaluate(nodes or Term(IRI, RDF.nil), focus))
                shape = self.v.shapes.shape(one(name))
                good = self.v.conforming(shape, rows.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("good"))
                kept = self._bag(focus, rows.join(good, F.col("value") == F.col("good"), "left_semi"))
                if name == "filterShape":
                    return kept
                if name == "findFirst":
                    return kept.select("focus", F.slice("values", 1, 1).alias("values"))
                every = self.evaluate(nodes or Term(IRI, RDF.nil), focus)
                return self._zip(every, kept, lambda x, y: F.array(_boolean(F.size(x) == F.size(y))))
        same = self._set_of(e)
        if same is not None:
            return self._same_for_all(focus, same)
        if one("instancesOf") is not None:
            c = one("instancesOf")
            classes = self.pairs(c, focus).select("focus", F.col("value").alias("cls"))
            types = self.v.p(RDF.type).select(F.col("s").alias("node"), F.col("o").alias("sub"))
            wide = types.unionByName(types.join(self.v.superclasses(), "sub").select("node", F.col("sup").alias("sub"))).distinct()
            return self._bag(focus, classes.join(wide, F.col("cls") == F.col("sub")).select("focus", F.lit(0).alias("at"), F.col("node").alias("value")).distinct())
        if one("if") is not None:
            true = Term(LITERAL, "true", XSD.boolean).id
            test = self._each(one("if"), focus, lambda a: F.array(_boolean((F.size(a) == 1) & (F.get(a, F.lit(0)) == true))))
            nothing = Term(IRI, RDF.nil)
            then, other = self.evaluate(one("then") or nothing, focus), self.evaluate(one("else") or nothing, focus)
            yes = self._zip(test, then, lambda c, x: F.when(F.get(c, F.lit(0)) == true, x))
            return self._zip(yes, other, lambda x, y: F.coalesce(x, y))
        if one("remove") is not None:
            return self._zip(self.evaluate(nodes or Term(IRI, RDF.nil), focus), self.evaluate(one("remove"), focus), lambda x, y: F.filter(x, lambda i: ~F.array_contains(y, i)))
        if one("flatMap") is not None:
            return self._flat(one("flatMap"), nodes, focus)
        if one("orderBy") is not None:
            rows = self._rows(self.evaluate(nodes, focus))
            keys = self.evaluate(one("orderBy"), rows.select(F.col("value").alias("focus"))).select(F.col("focus").alias("n"), F.get("values", F.lit(0)).alias("key"))
            keyed = rows.join(keys, F.col("value") == F.col("n"), "left")
            order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(IdVal(F.col("key")).order())], F.col("at"))
            down = one("desc") is not None and one("desc").lex == "true"
            got = keyed.groupBy("focus").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), "value")), not down), lambda x: x["value"]).alias("values"))
            return focus.join(got, "focus", "left").select("focus", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
        if one("limit") is not None or one("offset") is not None:
            off = self._integer(one("offset")) if one("offset") is not None else 0
            count = F.lit(self._integer(one("limit"))) if one("limit") is not None else None
            return self._each(nodes, focus, lambda a: F.slice(a, off + 1, F.size(a) if count is None else count))
        if nodes is not None:
            return self.evaluate(nodes, focus)
        return focus.select("focus", F.array().cast("array<string>").alias("values"))

    def _set_of(self, e: Term) -> DataFrame | None:
        """(value) of an expression whose nodes are the same for every focus node and come from the data; None of any other."""
        matching, c = self.g.one(e, SHNEX.nodesMatching), self.g.one(e, SHNEX.instancesOf)
        if matching is not None:
            everyone = self.v.ids.select(F.explode(F.array("s", "o")).alias("focus")).distinct()
            return self.v.conforming(self.v.shapes.shape(matching), everyone).select(F.col("focus").alias("value"))
        return self.v.instances(c.id).select(F.col("node").alias("value")) if c is not None and c.kind == IRI else None

    def _concat(self, parts: list[Term], focus: DataFrame) -> DataFrame:
        if not parts:
            return focus.select("focus", F.array().cast("array<string>").alias("values"))
        return reduce(lambda a, b: self._zip(a, b, F.concat), [self.evaluate(x, focus) for x in parts])

    def _zip(self, a: DataFrame, b: DataFrame, f) -> DataFrame:
        other = b.select(F.col("focus").alias("f2"), F.col("values").alias("values2"))
        return a.join(other, F.col("focus") == F.col("f2")).select("focus", f(F.col("values"), F.col("values2")).alias("values"))

    def _flat(self, inner: Term, nodes: Term, focus: DataFrame) -> DataFrame:
        rows = self._rows(self.evaluate(nodes, focus))
        mapped = self.evaluate(inner, rows.select(F.col("value").alias("focus"))).select(F.col("focus").alias("n"), "values")
        joined = rows.join(mapped, F.col("value") == F.col("n"))
        got = joined.groupBy("focus").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "values"))), lambda x: x["values"])).alias("values"))
        return focus.join(got, "focus", "left").select("focus", F.coalesce("values", F.array().cast("array<string>")).alias("values"))

    def _sum(self, focus: DataFrame, bag: DataFrame) -> DataFrame:
        rows = self._rows(bag)
        x = IdVal(F.col("value"))
        got = rows.groupBy("focus").agg(F.sum(x.num()).alias("t"), F.max(x.number_rank()).alias("r"), F.count(F.when(x.num().isNull(), F.lit(1))).alias("bad"))
        all_ = focus.join(got, "focus", "left").withColumns({"t": F.coalesce("t", F.lit(0.0)), "r": F.coalesce("r", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))})
        text = F.when(F.col("r") == 0, F.col("t").cast("bigint").cast("string")).when(F.col("r") == 1, decimal_text(F.col("t"))).otherwise(number_text(F.col("t")))
        dt = F.when(F.col("r") == 0, F.lit(XSD.integer)).when(F.col("r") == 1, F.lit(XSD.decimal)).otherwise(F.lit(XSD.double))
        return all_.select("focus", F.when(F.col("bad") == 0, F.array(literal_id(text, dt))).otherwise(F.array().cast("array<string>")).alias("values"))

    def _same_for_all(self, focus: DataFrame, values: DataFrame) -> DataFrame:
        """The same nodes for every focus node: one array, joined to each."""
        whole = values.agg(F.sort_array(F.collect_set("value")).alias("values"))
        return focus.join(whole)
