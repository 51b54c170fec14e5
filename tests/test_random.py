"""Random queries over small random graphs, against a plain evaluator of the algebra."""

import random
from collections import Counter

import pytest

from quadloom.functions.terms import Term, iri, literal
from quadloom.plans.graphs import QuadGraph, frame_of_terms
from quadloom.sparql.ast import BGP, Call, Const, Exists, Extend, Filter, Join, LeftJoin, Minus, Union, Values, Var
from quadloom.sparql.compiler import run_query
from quadloom.sparql.parser import parse_query

E = "http://e/"


class Error(Exception):
    pass


def value(e, mu):
    if isinstance(e, Var):
        if e.name not in mu:
            raise Error
        return mu[e.name]
    if isinstance(e, Const):
        return e.term
    if isinstance(e, Call):
        if e.name == "BOUND":
            return e.args[0].name in mu
        if e.name == "!":
            return not ebv(e.args[0], mu)
        if e.name in ("&&", "||"):
            got = []
            for a in e.args:
                try:
                    got.append(ebv(a, mu))
                except Error:
                    got.append(None)
            decided = e.name == "||"
            if decided in got:
                return decided
            if None in got:
                raise Error
            return not decided
        a, b = (value(x, mu) for x in e.args)
        na, nb = number(a), number(b)
        if e.name in ("=", "!="):
            same = na == nb if na is not None and nb is not None else (a.kind, a.lex, a.lang) == (b.kind, b.lex, b.lang) and (na is None) == (nb is None)
            return same == (e.name == "=")
        if na is None or nb is None:
            raise Error
        return na < nb if e.name == "<" else Term(2, str(int(na + nb)), "http://www.w3.org/2001/XMLSchema#integer")
    raise AssertionError(e)


def number(t):
    return float(t.lex) if isinstance(t, Term) and t.dt and t.dt.endswith("integer") else None


def ebv(e, mu):
    v = value(e, mu)
    if isinstance(v, bool):
        return v
    n = number(v)
    if n is not None:
        return n != 0
    if v.kind == 2:
        return v.lex != ""
    raise Error


def holds(e, mu, graph):
    if isinstance(e, Exists):
        return bool([nu for nu in solve(e.pattern, graph) if compatible(mu, nu)]) != e.negated
    if isinstance(e, Call) and e.name == "&&":
        return all(holds(a, mu, graph) for a in e.args)
    try:
        return ebv(e, mu)
    except Error:
        return False


def compatible(a, b):
    return all(b[k] == v for k, v in a.items() if k in b)


def solve(p, graph):
    if isinstance(p, BGP):
        out = [{}]
        for t in p.triples:
            new = []
            for mu in out:
                for triple in graph:
                    nu = dict(mu)
                    if all((nu.setdefault(n.name, x) == x) if isinstance(n, Var) else n == x for n, x in zip((t.s, t.p, t.o), triple)):
                        new.append(nu)
            out = new
        return out
    if isinstance(p, Join):
        return [{**a, **b} for a in solve(p.left, graph) for b in solve(p.right, graph) if compatible(a, b)]
    if isinstance(p, Union):
        return solve(p.left, graph) + solve(p.right, graph)
    if isinstance(p, Minus):
        right = solve(p.right, graph)
        return [a for a in solve(p.left, graph) if not any(compatible(a, b) and set(a) & set(b) for b in right)]
    if isinstance(p, LeftJoin):
        out, right = [], solve(p.right, graph)
        for a in solve(p.left, graph):
            hits = [{**a, **b} for b in right if compatible(a, b)]
            hits = [m for m in hits if p.condition is None or holds(p.condition, m, graph)]
            out += hits or [a]
        return out
    if isinstance(p, Filter):
        return [m for m in solve(p.inner, graph) if holds(p.condition, m, graph)]
    if isinstance(p, Extend):
        out = []
        for m in solve(p.inner, graph):
            try:
                v = value(p.expr, m)
                out.append({**m, p.var: Term(2, str(v).lower(), "http://www.w3.org/2001/XMLSchema#boolean") if isinstance(v, bool) else v})
            except Error:
                out.append(m)
        return out
    if isinstance(p, Values):
        return [{n: t for n, t in zip(p.names, r) if t is not None} for r in p.rows]
    raise AssertionError(p)


def random_graph(r):
    nodes = [iri(f"{E}n{i}") for i in range(6)]
    objects = nodes + [literal(i) for i in range(4)] + [literal("x"), literal("x", lang="en"), literal("y")]
    return list({(r.choice(nodes), iri(f"{E}p{r.randrange(4)}"), r.choice(objects)) for _ in range(45)})


class Maker:
    def __init__(self, r):
        self.r, self.binds = r, 0

    def var(self):
        return "?" + self.r.choice("abcd")

    def pattern(self):
        r = self.r
        s = self.var() if r.random() < 0.8 else f"<{E}n{r.randrange(6)}>"
        p = f"<{E}p{r.randrange(4)}>" if r.random() < 0.9 else self.var()
        o = self.var() if r.random() < 0.75 else r.choice([f"<{E}n{r.randrange(6)}>", "2", "'x'"])
        return f"{s} {p} {o} ."

    def condition(self):
        r = self.r
        c = r.choice([f"BOUND({self.var()})", f"{self.var()} = {self.var()}", f"{self.var()} < 3", f"{self.var()} != 'x'", f"{self.var()} = <{E}n1>"])
        k = r.random()
        return f"!({c})" if k < 0.2 else f"{c} || {self.var()} = 1" if k < 0.4 else f"{c} && BOUND({self.var()})" if k < 0.5 else c

    def group(self, depth):
        r = self.r
        parts = [self.pattern()] if r.random() < 0.9 else []
        for _ in range(r.randrange(1, 3)):
            k = r.choice(["bgp", "optional", "union", "minus", "filter", "values", "exists", "bind", "optional filter"]) if depth else "bgp"
            if k == "bgp":
                parts.append(self.pattern())
            elif k == "optional":
                parts.append(f"OPTIONAL {{ {self.group(depth - 1)} }}")
            elif k == "optional filter":
                parts.append(f"OPTIONAL {{ {self.pattern()} FILTER({self.condition()}) }}")
            elif k == "union":
                parts.append(f"{{ {self.group(depth - 1)} }} UNION {{ {self.group(depth - 1)} }}")
            elif k == "minus":
                parts.append(f"MINUS {{ {self.pattern()} }}")
            elif k == "filter":
                parts.append(f"FILTER({self.condition()})")
            elif k == "values":
                parts.append(f"VALUES (?a ?c) {{ (<{E}n1> UNDEF) (UNDEF 2) (<{E}n2> <{E}n3>) }}")
            elif k == "exists":
                parts.append(f"FILTER {r.choice(['', 'NOT '])}EXISTS {{ {self.pattern()} }}")
            else:
                self.binds += 1
                parts.append(f"BIND({self.var()} + 1 AS ?z{self.binds})")
        return " ".join(parts)


@pytest.mark.parametrize("seed", range(2))
def test_random_queries(spark, seed):
    r = random.Random(100 + seed)
    triples = random_graph(r)
    graph = QuadGraph(frame_of_terms(spark, [(None, *t) for t in triples]), is_set=True)
    done = 0
    while done < 5:
        text = f"SELECT * WHERE {{ {Maker(r).group(2)} }}"
        want = solve(parse_query(text).where, triples)
        if len(want) > 3000:
            continue
        names = sorted({k for m in want for k in m})
        key = lambda m: tuple(m[n].id if n in m else None for n in names)
        got = run_query(graph, text).rows()
        assert Counter(map(key, got)) == Counter(map(key, want)), text
        assert all(set(m) <= set(names) for m in got), text
        done += 1
