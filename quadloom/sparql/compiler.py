"""Algebra into one lazy DataFrame."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import library
from quadloom.functions.terms import BNODE, IRI, LITERAL, Term, make_term
from quadloom.functions.values import IdVal, Val, constant, equal, equal_keys, integer, string, val_of
from quadloom.functions.vocab import INTEGER_TYPES, NUMERIC_TYPES, RDF, XSD
from quadloom.operators.closure import closure, reachable
from quadloom.plans.frames import Frame, distinct, exists_join, join, key_columns, unite
from quadloom.plans.graphs import VirtualGraph
from quadloom.sparql.ast import (
    AGGREGATES, BGP, Alternative, Call, Const, Exists, Extend, Filter, GraphPattern, Inverse, Join, LeftJoin, Link, Minus, Negated, Query, Repeat, Sequence,
    SparqlError, SubSelect, Triple, Union, Values, Var, expr_vars, has_aggregate, node_vars, pattern_vars,
)


@dataclass
class Context:
    base: str | None
    now: str


@dataclass
class Result:
    """An answer. ``df`` has a column per variable (SELECT), one row with ``result`` (ASK), or s, p, o (CONSTRUCT)."""

    kind: str
    vars: list[str]
    df: DataFrame
    frame: Frame | None = None

    def ids(self) -> DataFrame:
        """The solutions of a SELECT as N3 strings."""
        return self.frame.df.select(*[self.frame.val(v).id().alias(v) if v in self.frame.info else F.lit(None).cast("string").alias(v) for v in self.vars])

    def terms(self) -> DataFrame:
        """The solutions of a SELECT as term structs."""
        return self.frame.df.select(*[self.frame.val(v).term().alias(v) for v in self.vars if v in self.frame.info])

    def rows(self) -> list[dict]:
        """The solutions on the driver, unbound variables left out; for small results."""
        from quadloom.functions.terms import parse_id

        return [{k: parse_id(v) for k, v in r.asDict().items() if v is not None} for r in self.ids().collect()]

    def truth(self) -> bool:
        return bool(self.df.first()["result"])


class Compiler:
    def __init__(self, graph, prefixes: dict | None = None, base: str | None = None, bindings: dict[str, Term] | None = None):
        self.graph, self.spark = graph, graph.spark
        self.context = Context(base, dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
        self.bindings = bindings or {}
        self.fresh = 0

    # patterns --------------------------------------------------------------------------------------------------------
    def pattern(self, p: object, g=None, links: tuple = ()) -> Frame:
        """The solutions of a pattern. ``links`` are equalities that a filter demands of them; those that joins have met are marked."""
        if isinstance(p, BGP):
            return self.bgp(p.triples, g, links)
        if isinstance(p, Join):
            return self.linked(self.pattern(p.left, g, links), self.pattern(p.right, g, links), links)
        if isinstance(p, LeftJoin) and has_exists(p.condition):
            return self.optional_exists(self.pattern(p.left, g), self.pattern(p.right, g), p.condition, g)
        if isinstance(p, LeftJoin) and isinstance(self.graph, VirtualGraph) and g is None:
            f = self.optional_columns(p)
            if f is not None:
                return f
        if isinstance(p, LeftJoin):
            condition = None if p.condition is None else (lambda f: self.expr(p.condition, f).ebv())
            return join(self.pattern(p.left, g), self.pattern(p.right, g), "left", condition)
        if isinstance(p, Union):
            return unite([self.pattern(p.left, g), self.pattern(p.right, g)])
        if isinstance(p, Minus):
            return exists_join(self.pattern(p.left, g), self.pattern(p.right, g), True, minus=True)
        if isinstance(p, Filter):
            own = equalities(p.condition)
            f = self.pattern(p.inner, g, (*links, *own))
            left = without(p.condition, [x.condition for x in own if x.done])
            return f if left is None else self.filter(f, left, g)
        if isinstance(p, Extend):
            f = self.pattern(p.inner, g, links)
            f, e = self.marked(f, p.expr, g)
            v = self.expr(e, f)
            return self.tidy(f.extend(p.var, v))
        if isinstance(p, Values):
            return self.values(p)
        if isinstance(p, GraphPattern):
            name = p.name.lex if isinstance(p.name, Term) else p.name
            if isinstance(name, Var) and isinstance(p.inner, BGP) and not p.inner.triples:
                return Frame.make(self.graph.graph_names(), {name.name: Val("iri", F.col("g"))})
            f = self.pattern(p.inner, name)
            if isinstance(name, Var) and (name.name not in f.info or not f.info[name.name].certain):
                f = join(f, Frame.make(self.graph.graph_names(), {name.name: Val("iri", F.col("g"))}))
            return f
        if isinstance(p, SubSelect):
            return self.select(p.query, g)
        raise SparqlError(f"unknown pattern {type(p).__name__}")

    def optional_columns(self, p: LeftJoin) -> Frame | None:
        """OPTIONALs of further columns of a star's own table: part of its scan instead of a join with itself."""
        groups: list[list[Triple]] = []
        while isinstance(p, LeftJoin) and isinstance(p.right, BGP) and p.right.triples and p.condition is None:
            groups.insert(0, p.right.triples)
            p = p.left
        if not groups or not isinstance(p, BGP) or not p.triples:
            return None
        subject, taken = groups[0][0].s, pattern_vars(p)
        for t in (t for group in groups for t in group):
            plain = isinstance(t.p, Term) and t.p.lex != RDF.type and isinstance(t.o, Var)
            if t.s != subject or not isinstance(t.s, Var) or not plain or t.o.name in taken:
                return None
            taken.add(t.o.name)
        star = [t for t in p.triples if t.s == subject]
        rest = [t for t in p.triples if t.s != subject]
        if not star or any(not isinstance(t.p, (Term, Var)) for t in star):
            return None
        f = self.graph.optional_star(subject, star, groups)
        return f if f is None or not rest else join(f, self.bgp(rest, None))

    def optional_exists(self, left: Frame, right: Frame, condition: object, g) -> Frame:
        """A left join whose condition has EXISTS: the filtered inner join, and the left solutions that it lacks."""
        names = list(left.info)
        copies = left
        for n in names:
            copies = copies.extend(f"_left_{n}", left.val(n), left.info[n].certain)
        kept = self.filter(join(copies, right), condition, g)
        had = kept.only([f"_left_{n}" for n in names])
        keys = [c.alias(f"h_{i}") for i, c in enumerate(key_columns(had, list(had.info)))] or [F.lit(1).alias("h_0")]
        on = F.lit(True)
        for i, c in enumerate(key_columns(left, names)):
            on = on & c.eqNullSafe(F.col(f"h_{i}"))
        rest = Frame(left.df.join(had.df.select(*keys).distinct(), on, "left_anti"), left.info)
        return unite([kept.only([n for n in kept.info if not n.startswith("_left_")]), rest])

    def values(self, p: Values) -> Frame:
        cols, vals, certain = [], {}, {}
        for i, n in enumerate(p.names):
            terms = [r[i] for r in p.rows]
            some = [t for t in terms if t is not None]
            certain[n] = len(some) == len(terms)
            if some and all(t.kind == IRI for t in some):
                cols.append((f"c{i} string", [t and t.lex for t in terms]))
                vals[n] = Val("iri", F.col(f"c{i}"))
            elif some and all(t.kind == LITERAL and t.dt == XSD.string for t in some):
                cols.append((f"c{i} string", [t and t.lex for t in terms]))
                vals[n] = string(F.col(f"c{i}"))
            elif some and all(t.kind == LITERAL and t.dt == XSD.integer and t.lex.lstrip("-").isdigit() for t in some):
                cols.append((f"c{i} bigint", [t and int(t.lex) for t in terms]))
                vals[n] = integer(F.col(f"c{i}"))
            else:
                cols.append((f"c{i} string", [t and t.id for t in terms]))
                vals[n] = IdVal(F.col(f"c{i}"))
        if not p.names:
            f = Frame.unit(self.spark)
            return Frame(f.df.select(F.explode(F.sequence(F.lit(1), F.lit(len(p.rows)))).alias("v")) if p.rows else f.df.limit(0), {})
        df = self.spark.createDataFrame(list(zip(*[c for _, c in cols])), ", ".join(d for d, _ in cols))
        return Frame.make(df, vals, certain)

    def linked(self, a: Frame, b: Frame, links: tuple) -> Frame:
        """The join of two frames; without a common variable, by keys of the equalities that a filter demands between them.

        A side of an equality counts if its variables are bound in every solution of a frame, so that further joins don't
        change it. Both sides are computed before the join, which then compares them exactly where their keys agree.
        """
        if set(a.info) & set(b.info):
            return join(a, b)
        kept, met = [*a.info, *b.info], []
        inside = lambda e, f: expr_vars(e) <= {n for n, i in f.info.items() if i.certain}
        for link in links:
            x, y = link.condition.args
            if not inside(x, a) or not inside(y, b):
                x, y = y, x
            if link.done or not inside(x, a) or not inside(y, b):
                continue
            vx, vy = self.expr(x, a), self.expr(y, b)
            keys = equal_keys(vx, vy)
            if keys is None:
                continue
            link.done = True
            self.fresh += 1
            key, names = f"_link{self.fresh}", (f"_left{self.fresh}", f"_right{self.fresh}")
            whole = lambda v: Val("term", v.term()) if v.t == "id" else v
            a, b = a.extend(names[0], whole(vx)).extend(key, string(keys[0]), True), b.extend(names[1], whole(vy)).extend(key, string(keys[1]), True)
            met.append(names)
        f = join(a, b)
        for x, y in met:
            f = f.where(equal(f.val(x), f.val(y)))
        return f.only(kept) if met else f

    def bgp(self, triples: list, g, links: tuple = ()) -> Frame:
        if not triples:
            return Frame.unit(self.spark)
        parts: list[tuple[set[str], object]] = []
        paths, plain = [], []
        for t in triples:
            for u in self.unfold(t):
                (paths if isinstance(u.p, (Repeat, Negated, Alternative)) else plain).append(u)
        if isinstance(self.graph, VirtualGraph) and g is None:
            stars: dict = {}
            for t in plain:
                stars.setdefault(t.s, []).append(t)
            for s, ts in stars.items():
                parts.append((node_vars(s).union(*(node_vars(t.p) | node_vars(t.o) for t in ts)), (s, ts)))
        else:
            gv = {g.name} if isinstance(g, Var) else set()
            parts += [(node_vars(t.s) | node_vars(t.p) | node_vars(t.o) | gv, t) for t in plain]
        out: Frame | None = None

        def distance(names: set[str]) -> int:
            """Of a part from those joined so far: 0 by variables, 1 by equalities, 2 neither."""
            if out is None or names & set(out.info):
                return 0
            return 1 if any(x <= set(out.info) and y <= names or y <= set(out.info) and x <= names for x, y in sides) else 2

        sides = [tuple(map(expr_vars, x.condition.args)) for x in links]
        while parts:  # connected parts first, those with the fewest new variables before others
            i = min(range(len(parts)), key=lambda i: (distance(parts[i][0]), len(parts[i][0] - set(out.info if out else ())) if out else 0, i))
            _, what = parts.pop(i)
            f = self.graph.star(*what) if isinstance(what, tuple) else self.graph.triple(what.s, what.p, what.o, g)
            out = f if out is None else self.linked(out, f, links)
        for t in paths:
            f = self.path(t, g, out)
            out = f if out is None else join(out, f)
        return out

    def hidden(self) -> Var:
        self.fresh += 1
        return Var(f"_path{self.fresh}")

    def unfold(self, t: Triple) -> list[Triple]:
        """Sequences and inverses into plain triples."""
        p = t.p
        if isinstance(p, Link):
            return [Triple(t.s, Term(IRI, p.iri), t.o)]
        if isinstance(p, Inverse):
            return self.unfold(Triple(t.o, p.path, t.s))
        if isinstance(p, Sequence):
            nodes = [t.s, *[self.hidden() for _ in p.parts[1:]], t.o]
            return [u for k, x in enumerate(p.parts) for u in self.unfold(Triple(nodes[k], x, nodes[k + 1]))]
        return [t]

    def path(self, t: Triple, g, so_far: Frame | None = None) -> Frame:
        p = t.p
        if isinstance(p, Alternative):
            return unite([self.bgp([Triple(t.s, x, t.o)], g) for x in p.parts])
        if isinstance(p, Negated):
            options = []
            if p.forward or not p.backward:
                v = self.hidden()
                f = self.bgp([Triple(t.s, v, t.o)], g)
                options.append(f.where(~f.val(v.name).lex().isin(list(p.forward))).without(v.name) if p.forward else f.without(v.name))
            if p.backward:
                v = self.hidden()
                f = self.bgp([Triple(t.o, v, t.s)], g)
                options.append(f.where(~f.val(v.name).lex().isin(list(p.backward))).without(v.name))
            return unite(options)
        return self.repeat(t, g, so_far)

    def repeat(self, t: Triple, g, so_far: Frame | None) -> Frame:
        """p?, p+ and p*: sets of pairs of ids."""
        p: Repeat = t.p
        a, b = self.hidden(), self.hidden()
        step = self.bgp([Triple(a, p.path, b)], g)
        grouped = isinstance(g, Var)
        keys = [step.val(g.name).lex().alias("g")] if grouped else []
        edges = step.df.select(*keys, step.val(a.name).id().alias("a"), step.val(b.name).id().alias("b"))
        names = ["g"] if grouped else []

        def seeds(node) -> DataFrame | None:
            if isinstance(node, Term):
                return self.spark.createDataFrame([(node.id,)], "n string")
            if so_far is not None and isinstance(node, Var) and node.name in so_far.info and so_far.info[node.name].certain:
                return so_far.df.select(so_far.val(node.name).id().alias("n")).distinct()
            return None

        start, end = seeds(t.s), seeds(t.o)
        forward = isinstance(t.s, Term) or (start is not None and not isinstance(t.o, Term))
        seed = start if forward else end
        if p.most == 1:
            pairs = edges.distinct()
        elif seed is not None and not grouped:
            pairs = reachable(edges, seed, forward)
        else:
            pairs = closure(edges, keys=names)
        if p.least == 0:
            nodes = self.graph.nodes(g)
            if seed is not None and not grouped:
                nodes = seed
            same = nodes.select(*names, F.col("n").alias("a"), F.col("n").alias("b"))
            pairs = pairs.select(*names, "a", "b").unionByName(same).distinct()
        df, vals = pairs, {}
        for node, c in ((t.s, "a"), (t.o, "b")):
            if isinstance(node, Term):
                df = df.where(F.col(c) == node.id)
            elif isinstance(node, Var):
                if node.name in vals:
                    df = df.where(F.col("a") == F.col("b"))
                else:
                    vals[node.name] = IdVal(F.col(c))
            else:
                raise SparqlError("a path's ends are terms or variables")
        if grouped:
            vals[g.name] = Val("iri", F.col("g"))
        return Frame.make(df, vals)

    # filters and expressions -----------------------------------------------------------------------------------------
    def filter(self, f: Frame, condition: object, g) -> Frame:
        if isinstance(condition, Call) and condition.name == "&&":
            return self.filter(self.filter(f, condition.args[0], g), condition.args[1], g)
        if isinstance(condition, Call) and condition.name == "!" and isinstance(condition.args[0], Exists):
            e = condition.args[0]
            condition = Exists(e.pattern, not e.negated)
        if isinstance(condition, Exists):
            return self.exists(f, condition, g)
        f, e = self.marked(f, condition, g)
        return self.tidy(f.where(self.expr(e, f).ebv()))

    def exists(self, f: Frame, e: Exists, g) -> Frame:
        inner, condition = e.pattern, None
        if isinstance(inner, Filter) and expr_vars(inner.condition) - pattern_vars(inner.inner):
            c = inner.condition
            inner, condition = inner.inner, (lambda both: self.expr(c, both).ebv())
        return exists_join(f, self.pattern(inner, g), e.negated, condition)

    def marked(self, f: Frame, e: object, g) -> tuple[Frame, object]:
        """Replace EXISTS within an expression by a marker column: a left join with the distinct keys of its pattern."""
        if isinstance(e, Exists):
            inner = self.pattern(e.pattern, g)
            shared = [n for n in inner.info if n in f.info]
            if any(not (inner.info[n].certain and f.info[n].certain) for n in shared):
                raise SparqlError("EXISTS within an expression over variables that may be unbound")
            self.fresh += 1
            name = f"_exists{self.fresh}"
            keys = distinct(inner.only(shared)).extend(name, library.boolean(F.lit(True)), True)
            f = join(f, keys, "left")
            mark = Call("BOUND", (Var(name),))
            return f, Call("!", (mark,)) if e.negated else mark
        if isinstance(e, Call):
            args = []
            for x in e.args:
                f, y = self.marked(f, x, g)
                args.append(y)
            return f, Call(e.name, tuple(args), e.distinct, e.separator)
        return f, e

    def tidy(self, f: Frame) -> Frame:
        return f.only([n for n in f.info if not n.startswith("_exists")]) if any(n.startswith("_exists") for n in f.info) else f

    def expr(self, e: object, f: Frame) -> Val:
        if isinstance(e, Var):
            return f.val(e.name) if e.name in f.info else string(F.lit(None).cast("string"))
        if isinstance(e, Const):
            return constant(e.term)
        if isinstance(e, Call):
            return library.call(e.name, [self.expr(a, f) for a in e.args], self.context)
        raise SparqlError("EXISTS can't stand here")

    # queries ---------------------------------------------------------------------------------------------------------
    def where(self, q: Query, g=None) -> Frame:
        f = self.pattern(q.where, g)
        if self.bindings:
            names = list(self.bindings)
            f = join(f, self.values(Values(names, [[self.bindings[n] for n in names]])))
        return f

    def select(self, q: Query, g=None, bound: bool = False) -> Frame:
        """The projected solutions of a SELECT."""
        f = self.where(q, g) if bound else self.pattern(q.where, g)
        grouped = q.group is not None or any(has_aggregate(e) for _, e in q.select or []) or any(map(has_aggregate, q.having)) or any(has_aggregate(e) for e, _ in q.order)
        order = q.order
        if grouped:
            f, select, having, order = self.aggregate(q, f)
            for h in having:
                f = self.filter(f, h, g)
        else:
            select = q.select
        for n, e in select or []:
            if e is not None:
                f, e = self.marked(f, e, g)
                f = self.tidy(f.extend(n, self.expr(e, f)))
        if q.values is not None:
            f = join(f, self.values(q.values))
        names = [n for n, _ in select] if select is not None else sorted(n for n in f.info if not n.startswith("_"))
        for n in names:
            if n not in f.info:
                f = f.extend(n, string(F.lit(None).cast("string")))
        if q.distinct:
            f = distinct(f.only(names))
        if order:
            keys = []
            for e, up in order:
                keys += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in self.expr(e, f).order()]
            f = Frame(f.df.orderBy(*keys), f.info)
        if q.offset:
            f = Frame(f.df.offset(q.offset), f.info)
        if q.limit is not None:
            f = Frame(f.df.limit(q.limit), f.info)
        return f.only(names)

    def aggregate(self, q: Query, f: Frame) -> tuple[Frame, list, list, list]:
        """Group, and replace every aggregate by the variable that has its value."""
        keys: list[tuple[str, object]] = []
        for i, (n, e) in enumerate(q.group or []):
            name = n or f"_group{i}"
            if not (isinstance(e, Var) and e.name == name):
                f = f.extend(name, self.expr(e, f))
            elif name not in f.info:
                f = f.extend(name, string(F.lit(None).cast("string")))
            keys.append((name, e))
        calls: dict[Call, str] = {}

        def lift(e: object) -> object:
            for name, k in keys:
                if e == k:
                    return Var(name)
            if isinstance(e, Call):
                if e.name in AGGREGATES:
                    return Var(calls.setdefault(e, f"_agg{len(calls)}"))
                return Call(e.name, tuple(map(lift, e.args)), e.distinct, e.separator)
            return e

        select = [(n, None if e is None else lift(e)) for n, e in q.select or []]
        having, order = [lift(h) for h in q.having], [(lift(e), up) for e, up in q.order]
        names = [n for n, _ in keys]
        firsts, by = [], []
        for i, (n, c) in enumerate(zip(names, key_columns(f, names))):
            by.append(c)
            v = f.val(n)
            if v.t in ("term", "num"):
                firsts.append((n, v))
        aggs, finish = [], {}
        for call_, name in calls.items():
            self._aggregate(call_, name, f, aggs, finish)
        for i, (n, v) in enumerate(firsts):
            aggs.append(F.first(v.term()).alias(f"first_{n}"))
        df = f.df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_any")])) if by else f.df.agg(*(aggs or [F.count(F.lit(1)).alias("_any")]))
        vals: dict[str, Val] = {}
        certain: dict[str, bool] = {}
        for i, n in enumerate(names):
            v, info = f.val(n), f.info[n]
            vals[n] = Val("term", F.col(f"first_{n}")) if v.t in ("term", "num") else val_of(v.t, F.col(f"k_{i}"), v.dt, v.prefix)
            certain[n] = info.certain
        for name, make in finish.items():
            vals[name] = make()
            certain[name] = name.startswith("_agg") and next(c.name for c, x in calls.items() if x == name) == "COUNT"
        return Frame.make(df, vals, certain), select, having, order

    def _aggregate(self, c: Call, name: str, f: Frame, aggs: list, finish: dict) -> None:
        col = lambda i: F.col(f"{name}_{i}")

        def add(*columns: Column) -> None:
            aggs.extend(x.alias(f"{name}_{i}") for i, x in enumerate(columns))

        if c.name == "COUNT":
            if not c.args:
                if c.distinct:
                    names = [n for n in f.info if not n.startswith("_")]
                    add(F.count_distinct(F.struct(*key_columns(f, names))) if names else F.least(F.count(F.lit(1)), F.lit(1)))
                else:
                    add(F.count(F.lit(1)))
            else:
                v = self.expr(c.args[0], f)
                x = v.id() if v.t in ("term", "num") else v.col
                add(F.count_distinct(x) if c.distinct else F.count(x))
            finish[name] = lambda: Val("native", col(0), XSD.integer)
            return
        v = self.expr(c.args[0], f)
        if c.name in ("SUM", "AVG"):
            if v.t == "native" and v.dt in NUMERIC_TYPES:
                x, whole = v.col, v.dt in INTEGER_TYPES
                if c.name == "SUM":
                    total = F.try_sum(x.cast("bigint") if whole else x)
                    add(F.sum_distinct(x) if c.distinct else total)
                    finish[name] = lambda: Val("native", F.coalesce(col(0), F.lit(0 if whole else 0.0)), XSD.integer if whole else v.dt)
                else:
                    add(F.sum_distinct(x) / F.count_distinct(x) if c.distinct else F.avg(x))
                    finish[name] = lambda: Val("native", F.coalesce(col(0), F.lit(0.0)), XSD.decimal if v.dt == XSD.decimal else XSD.double)
                return
            n, rank = v.num(), v.number_rank()
            if c.distinct:
                seen = F.collect_set(F.when(v.bound(), F.struct(v.id().alias("id"), n.alias("n"), rank.alias("r"))))
                add(seen)
                ok = lambda: F.forall(col(0), lambda x: x["n"].isNotNull())
                total = lambda: F.aggregate(col(0), F.lit(0.0), lambda acc, x: acc + x["n"])
                count, top = (lambda: F.size(col(0))), (lambda: F.array_max(F.transform(col(0), lambda x: x["r"])))
            else:
                add(F.count(F.when(v.bound(), F.lit(1))), F.count(n), F.sum(n), F.max(F.when(v.bound(), rank)))
                ok, total, count, top = (lambda: col(0) == col(1)), (lambda: F.coalesce(col(2), F.lit(0.0))), (lambda: col(1)), (lambda: F.coalesce(col(3), F.lit(0)))
            if c.name == "SUM":
                finish[name] = lambda: Val("num", F.when(ok(), total()), rank=F.coalesce(top(), F.lit(0)))
            else:
                finish[name] = lambda: Val("num", F.when(ok(), F.coalesce(F.try_divide(total(), count()), F.lit(0.0))), rank=F.when(count() == 0, F.lit(0)).when(top() == 1, F.lit(1)).otherwise(F.lit(2)))
            return
        if c.name in ("MIN", "MAX"):
            best = F.min if c.name == "MIN" else F.max
            if v.t in ("native", "iri"):
                add(best(v.col if v.t == "native" else v.lex()))
                finish[name] = lambda: Val(v.t, col(0), v.dt)
            else:
                keys = [k.alias(f"o{i}") for i, k in enumerate(v.order())]
                add(best(F.when(v.bound(), F.struct(*keys, v.id().alias("id")))))
                finish[name] = lambda: IdVal(col(0)["id"])
            return
        if c.name == "SAMPLE":
            if v.t in ("native", "iri"):
                add(F.min(v.col if v.t == "native" else v.lex()))
                finish[name] = lambda: Val(v.t, col(0), v.dt)
            else:
                add(F.min(v.id()))
                finish[name] = lambda: IdVal(col(0))
            return
        text = v.text() if v.is_term else v.lex()
        add(F.sort_array((F.collect_set if c.distinct else F.collect_list)(text)))
        finish[name] = lambda: string(F.array_join(col(0), c.separator if c.separator is not None else " "))

    def run(self, q: Query) -> Result:
        if q.form == "ASK":
            f = self.where(q)
            found = f.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
            return Result("ASK", [], found)
        if q.form == "SELECT":
            f = self.select(q, bound=True)
            names = [n for n, _ in q.select] if q.select is not None else sorted(n for n in f.info if not n.startswith("_"))
            return Result("SELECT", names, f.df.select(*[f.val(n).out().alias(n) for n in names]), f)
        f = self.where(Query("SELECT", q.where)) if not (q.order or q.limit is not None or q.offset) else self.select(Query("SELECT", q.where, None, order=q.order, limit=q.limit, offset=q.offset), bound=True)
        if q.values is not None:
            f = join(f, self.values(q.values))
        return Result("CONSTRUCT", ["s", "p", "o"], self.construct(f, [(None, t) for t in q.template]).select("s", "p", "o"))

    def construct(self, f: Frame, template: list, default_graph: Column | None = None) -> DataFrame:
        """Distinct quads (g, s, p, o) of a template; solutions that leave a part unbound give no quad of it.

        Blank nodes of the template are new for each solution: their labels are hashes of the solution and the label.
        """
        keys = [c.cast("string") for c in key_columns(f, sorted(f.info))]

        def part(node) -> Val:
            if isinstance(node, Term):
                if node.kind == BNODE:
                    label = F.concat(F.lit("c"), F.sha2(F.to_json(F.struct(F.lit(node.lex).alias("label"), *keys), {"ignoreNullFields": "false"}), 256))
                    return Val("term", make_term(F.concat(F.lit("_:"), label), BNODE, label))
                return constant(node)
            if isinstance(node, Var):
                if node.name.startswith("_b_") and node.name not in f.info:
                    return part(Term(BNODE, node.name[3:]))
                return f.val(node.name) if node.name in f.info else Val("term", make_term(F.lit(None).cast("string"), BNODE, F.lit(None)))
            return library.call("TRIPLE", [part(node.s), part(node.p), part(node.o)], self.context)

        cells = []
        for g, t in template:
            s, p, o = part(t.s), part(t.p), part(t.o)
            graph = default_graph if g is None else part(g).lex()
            graph = F.lit(None).cast("string") if graph is None else graph
            ok = s.bound() & p.bound() & o.bound() & (s.kind() != LITERAL) & (p.kind() == IRI)
            if g is not None:
                ok = ok & graph.isNotNull()
            cells.append(F.when(ok, F.struct(graph.alias("g"), s.term().alias("s"), p.lex().alias("p"), o.term().alias("o"))))
        if not cells:
            return self.spark.createDataFrame([], "g string").limit(0)
        quads = f.df.select(F.explode(F.array_compact(F.array(*cells))).alias("q")).select("q.*")
        keyed = quads.withColumns({"_s": F.col("s.id"), "_o": F.col("o.id")})
        return keyed.dropDuplicates(["g", "_s", "p", "_o"]).select("g", "s", "p", "o")


@dataclass
class Equality:
    """An equality that a filter demands, both sides with variables; ``done`` when a join has met it."""

    condition: Call
    done: bool = False


def equalities(e: object) -> list[Equality]:
    if isinstance(e, Call) and e.name == "&&":
        return [x for a in e.args for x in equalities(a)]
    return [Equality(e)] if isinstance(e, Call) and e.name == "=" and all(expr_vars(a) and repeatable(a) for a in e.args) else []


def without(e: object, met: list) -> object | None:
    """What remains to be demanded of a condition."""
    if any(e is x for x in met):
        return None
    if isinstance(e, Call) and e.name == "&&":
        rest = [y for a in e.args if (y := without(a, met)) is not None]
        return Call("&&", tuple(rest)) if len(rest) > 1 else rest[0] if rest else None
    return e


def repeatable(e: object) -> bool:
    """Whether an expression has the same value each time that it is computed, and no EXISTS."""
    if isinstance(e, Call):
        return e.name not in ("RAND", "UUID", "STRUUID", "BNODE") and e.name not in library.REGISTERED and all(map(repeatable, e.args))
    return not isinstance(e, Exists)


def has_exists(e: object) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(map(has_exists, e.args))


def run_query(graph, text: str | Query, bindings: dict[str, Term] | None = None) -> Result:
    """Answer a query over a QuadGraph or a VirtualGraph."""
    from quadloom.plans.graphs import QuadGraph
    from quadloom.sparql.parser import parse_query

    q = parse_query(text) if isinstance(text, str) else text
    if (q.default_graphs or q.named_graphs) and isinstance(graph, QuadGraph):
        graph = QuadGraph(graph.quads, graph.is_set, default=list(q.default_graphs), named=list(q.named_graphs))
    return Compiler(graph, q.prefixes, q.base, bindings).run(q)
