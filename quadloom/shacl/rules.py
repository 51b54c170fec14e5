"""Rule sets: DATA blocks and RULE { head } WHERE { body }, with stratified negation.

A body is a list of triple patterns, FILTER, BIND and NOT { }, compiled as a query pattern. Strata are evaluated one
after another. A stratum whose rules don't feed each other is a single pass; in another, rounds follow in which a rule runs
once for each of its patterns that the last round may have fed, with that pattern over what this round added.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, Term
from quadloom.plans.graphs import QuadGraph, frame_of_terms
from quadloom.plans.staging import Grown, Staging
from quadloom.sparql.ast import BGP, Call, Exists, Extend, Filter, GraphPattern, SparqlError, Triple, TripleTermPattern, Var, expr_vars, node_vars
from quadloom.sparql.compiler import Compiler
from quadloom.sparql.parser import Parser, join
from quadloom.sparql.update import add_quads, remove_quads

MOST_ROUNDS = 1000
#: The graph in which the triples of the last round lie besides the default graph, where all lie.
LAST = "urn:x-quadloom:last"


class RuleError(ValueError):
    pass


@dataclass
class Rule:
    head: list[Triple]
    body: list  # Triple, ("filter", e), ("bind", name, e), ("not", [items])


class _Parser(Parser):
    def rules(self) -> tuple[list[Rule], list[Triple]]:
        rules, data = [], []
        while self.kind != "end":
            before = self.i
            self.prologue()
            if self.take_word("DATA"):
                self.ground = True
                data += self.triples_block()
                self.ground = False
            elif self.take_word("RULE"):
                head = self.triples_block()
                self.need_word("WHERE")
                rules.append(Rule(head, self.body()))
            elif self.i == before:
                raise self.fail("RULE or DATA wanted, not")
        return rules, data

    def body(self) -> list:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take_word("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.take_word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                out.append(("bind", self.var(), e))
                self.need(")")
            elif self.take_word("NOT"):
                out.append(("not", self.body()))
            else:
                ts: list = []
                self.triples_same_subject(ts)
                out += ts
        return out


def _vars(t: Triple) -> set[str]:
    return node_vars(t.s) | node_vars(t.p) | node_vars(t.o)


def _atoms(body: list, negative: bool = False):
    """The triple patterns of a body, and whether they stand in a NOT."""
    for x in body:
        if isinstance(x, Triple):
            yield x, negative
        elif x[0] == "not":
            yield from _atoms(x[1], True)


def _pattern(body: list, last: int | None = None):
    """The query pattern of a body; its item ``last``, a triple pattern, matches the triples of the last round only."""
    g, triples = BGP([]), []
    for i, x in enumerate(body):
        if i == last:
            g = join(join(g, BGP(triples)) if triples else g, GraphPattern(Term(IRI, LAST), BGP([x])))
            triples = []
            continue
        if isinstance(x, Triple):
            triples.append(x)
            continue
        if triples:
            g, triples = join(g, BGP(triples)), []
        if x[0] == "filter":
            g = Filter(x[1], g)
        elif x[0] == "bind":
            g = Extend(g, x[1], x[2])
        else:
            g = Filter(Exists(_pattern(x[1]), True), g)
    return join(g, BGP(triples)) if triples else g


def _unifies(a, b) -> bool:
    if isinstance(a, TripleTermPattern) and isinstance(b, TripleTermPattern):
        return _unifies(a.s, b.s) and _unifies(a.p, b.p) and _unifies(a.o, b.o)
    return not (isinstance(a, Term) and isinstance(b, Term)) or a == b


def _may_make(head: Triple, atom: Triple) -> bool:
    return _unifies(head.s, atom.s) and _unifies(head.p, atom.p) and _unifies(head.o, atom.o)


@dataclass
class RuleSet:
    rules: list[Rule]
    data: list[Triple] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> RuleSet:
        try:
            return cls(*_Parser(text).rules())
        except SparqlError as e:
            raise RuleError(str(e)) from None

    def check(self) -> RuleSet:
        """Raise RuleError where a head has an unbound variable, a BIND a bound one, or a FILTER one that no earlier item binds."""
        for r in self.rules:
            bound = self._check_body(r.body, set())
            for t in r.head:
                if _vars(t) - bound:
                    raise RuleError(f"?{min(_vars(t) - bound)} in a head isn't bound")
        return self

    def _check_body(self, body: list, bound: set[str]) -> set[str]:
        bound = set(bound)
        for x in body:
            if isinstance(x, Triple):
                bound |= _vars(x)
            elif x[0] == "filter":
                if expr_vars(x[1]) - bound:
                    raise RuleError(f"?{min(expr_vars(x[1]) - bound)} in a FILTER isn't bound")
            elif x[0] == "bind":
                if x[1] in bound:
                    raise RuleError(f"BIND to ?{x[1]}, which is bound")
                if expr_vars(x[2]) - bound:
                    raise RuleError(f"?{min(expr_vars(x[2]) - bound)} in a BIND isn't bound")
                bound.add(x[1])
            else:
                self._check_body(x[1], bound)
        return bound

    def strata(self) -> list[list[Rule]]:
        """The rules by stratum; RuleError if a rule depends on its own negation."""

        n = len(self.rules)
        edges = [(i, j, neg) for i, r in enumerate(self.rules) for a, neg in _atoms(r.body) for j, other in enumerate(self.rules) if any(_may_make(h, a) for h in other.head)]
        level = [0] * n
        for _ in range(n * n + 1):
            changed = False
            for i, j, neg in edges:
                least = level[j] + neg
                if level[i] < least:
                    level[i], changed = least, True
            if not changed:
                break
            if max(level) > n:
                raise RuleError("a rule depends on its own negation")
        else:
            raise RuleError("a rule depends on its own negation")
        return [[r for r, lv in zip(self.rules, level) if lv == k] for k in range(max(level, default=0) + 1)]

    def infer(self, quads: DataFrame, staging: Staging | None = None) -> DataFrame:
        """The quads (in the default graph) that the rules and the DATA blocks add to a graph."""
        self.check()
        spark = quads.sparkSession
        staging = staging or Staging(spark, "rules")
        as_default = "CAST(NULL AS STRING) AS g", "s", "p", "o"
        known = Grown(staging.cut(add_quads(quads.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").selectExpr(*as_default), frame_of_terms(spark, []))))
        if self.data:
            given = add_quads(frame_of_terms(spark, []), frame_of_terms(spark, [(None, t.s, t.p, t.o) for t in self.data]))
            known.add(staging.cut(remove_quads(given, known.df)))
        for rules in self.strata():
            # (rule, place of the pattern that takes the last round's triples)
            fed = [(r, i) for r in rules for i, x in enumerate(r.body) if isinstance(x, Triple) and any(_may_make(h, x) for other in rules for h in other.head)]
            runs: list[tuple[Rule, int | None]] = [(r, None) for r in rules]
            last = None
            for _ in range(MOST_ROUNDS):
                if not runs:
                    break
                data = known.df if last is None else known.df.unionByName(last.withColumn("g", F.lit(LAST)))
                found = []
                for r, at in runs:
                    c = Compiler(QuadGraph(data, is_set=True))
                    found.append(c.construct(c.pattern(_pattern(r.body, at)), [(None, t) for t in r.head]))
                last = staging.cut(remove_quads(add_quads(reduce(DataFrame.unionByName, found), frame_of_terms(spark, [])), known.df))
                runs = fed
                if runs and not last.head(1):
                    break
                known.add(last)
            else:
                raise RuleError(f"no end after {MOST_ROUNDS} rounds")
        return known.added


__all__ = ["Call", "IRI", "Rule", "RuleError", "RuleSet", "Var"]
