"""Algebra and expressions of queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from quadloom.functions.terms import Term


class SparqlError(ValueError):
    """A text that is no query, or a query that can't be answered."""


@dataclass(frozen=True)
class Var:
    name: str


# paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    path: object
    least: int  # 0 or 1
    most: int | None  # 1 or None


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# patterns
@dataclass
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class TripleTermPattern:
    s: object
    p: object
    o: object


@dataclass
class BGP:
    triples: list


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    condition: object
    inner: object


@dataclass
class Extend:
    inner: object
    var: str
    expr: object


@dataclass
class Values:
    names: list
    rows: list


@dataclass
class GraphPattern:
    name: object
    inner: object


@dataclass
class SubSelect:
    query: Query


# expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    separator: str | None = None


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool

    def __hash__(self):
        return id(self)


@dataclass(frozen=True)
class Const:
    term: Term


AGGREGATES = frozenset(["COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "SAMPLE"])


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT
    where: object
    select: list | None = None  # (name, expr or None); None: *
    distinct: bool = False
    template: list = field(default_factory=list)
    group: list | None = None  # (name or None, expr)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expr, ascending)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)
    prefixes: dict = field(default_factory=dict)
    base: str | None = None


@dataclass
class Update:
    kind: str
    insert: list = field(default_factory=list)  # (graph or None, Triple)
    delete: list = field(default_factory=list)
    where: object = None
    with_graph: str | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    source: object = None
    target: object = None
    silent: bool = False
    prefixes: dict = field(default_factory=dict)
    base: str | None = None


def has_aggregate(e: object) -> bool:
    return isinstance(e, Call) and (e.name in AGGREGATES or any(map(has_aggregate, e.args)))


def expr_vars(e: object) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(expr_vars, e.args)) if e.args else set()
    if isinstance(e, Exists):
        return pattern_vars(e.pattern)
    return set()


def node_vars(n: object) -> set[str]:
    if isinstance(n, Var):
        return {n.name}
    if isinstance(n, TripleTermPattern):
        return node_vars(n.s) | node_vars(n.p) | node_vars(n.o)
    return set()


def pattern_vars(p: object) -> set[str]:
    """The variables that a pattern can bind."""
    if isinstance(p, BGP):
        return set().union(*(node_vars(t.s) | node_vars(t.p) | node_vars(t.o) for t in p.triples)) if p.triples else set()
    if isinstance(p, (Join, Union, LeftJoin)):
        return pattern_vars(p.left) | pattern_vars(p.right)
    if isinstance(p, Minus):
        return pattern_vars(p.left)
    if isinstance(p, Filter):
        return pattern_vars(p.inner)
    if isinstance(p, Extend):
        return pattern_vars(p.inner) | {p.var}
    if isinstance(p, Values):
        return set(p.names)
    if isinstance(p, GraphPattern):
        return pattern_vars(p.inner) | node_vars(p.name)
    if isinstance(p, SubSelect):
        q = p.query
        return {n for n, _ in q.select} if q.select is not None else visible(pattern_vars(q.where))
    return set()


def visible(names: set[str]) -> set[str]:
    return {n for n in names if not n.startswith("_")}
