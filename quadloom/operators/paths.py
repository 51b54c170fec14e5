"""Property paths built in Python: ``link(p) / link(q)``, ``|``, ``~`` (inverse), ``.plus``, ``.star``, ``.maybe``, ``none_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadloom.functions.terms import Term
from quadloom.sparql import ast
from quadloom.sparql.ast import Triple, Var
from quadloom.sparql.compiler import Compiler


class Path:
    def __init__(self, node):
        self.node = node

    def __truediv__(self, other: Path) -> Path:
        return Path(ast.Sequence((self.node, _path(other).node)))

    def __or__(self, other: Path) -> Path:
        return Path(ast.Alternative((self.node, _path(other).node)))

    def __invert__(self) -> Path:
        return Path(ast.Inverse(self.node))

    @property
    def plus(self) -> Path:
        return Path(ast.Repeat(self.node, 1, None))

    @property
    def star(self) -> Path:
        return Path(ast.Repeat(self.node, 0, None))

    @property
    def maybe(self) -> Path:
        return Path(ast.Repeat(self.node, 0, 1))

    def pairs(self, graph, s: Term | None = None, o: Term | None = None) -> DataFrame:
        """(s, o) ids that the path connects, between the given ends."""
        f = Compiler(graph).bgp([Triple(s or Var("s"), self.node, o or Var("o"))], None)
        from pyspark.sql import functions as F

        column = lambda n, t: F.lit(t.id) if t else f.val(n).id()
        return f.df.select(column("s", s).alias("s"), column("o", o).alias("o"))


def link(iri: str) -> Path:
    return Path(ast.Link(str(iri)))


def none_of(*forward: str, backward: tuple[str, ...] = ()) -> Path:
    return Path(ast.Negated(tuple(map(str, forward)), tuple(map(str, backward))))


def _path(x) -> Path:
    return x if isinstance(x, Path) else link(x)
