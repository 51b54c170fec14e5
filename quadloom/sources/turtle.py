"""Turtle and TriG texts into quads, on the grammar that queries share."""

from __future__ import annotations

from quadloom.functions.terms import BNODE, IRI, LITERAL, Term, iri, unescape
from quadloom.sparql.ast import SparqlError, Triple
from quadloom.sparql.parser import _TOKENS, Parser

Quad = tuple  # (graph Term or None, s, p, o)


class TurtleParser(Parser):
    def __init__(self, text: str, base: str | None = None, trig: bool = False, scope: str = ""):
        self.text, self.tokens, self.i = text, [], 0
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.prefixes, self.base, self.fresh, self.labels = {}, base, 0, {}
        self.ground, self.template, self.trig, self.scope = True, False, trig, scope

    def blank(self, what: str = "bnode") -> Term:
        self.fresh += 1
        return Term(BNODE, f"{self.scope}anon{self.fresh}")

    def bnode_label(self) -> Term:
        return Term(BNODE, self.scope + self.next()[2:])

    def iri_ref(self) -> str:
        if self.kind != "iri":
            raise self.fail("IRI wanted, not")
        try:
            return iri(unescape(self.next()[1:-1]), self.base).lex
        except ValueError as e:
            raise SparqlError(str(e)) from None

    def node(self, out: list) -> object:
        if self.at("+", "-") and self.tokens[self.i + 1][0] == "number":
            sign = self.next()
            t = self.literal()
            return Term(LITERAL, sign + t.lex, t.dt)
        return super().node(out)

    def directive(self) -> bool:
        if self.kind == "lang" and self.value in ("@prefix", "@base", "@version"):
            what = self.next()
            self._declare(what[1:])
            self.need(".")
            return True
        if self.word("PREFIX", "BASE", "VERSION"):
            self._declare(self.next().lower())
            return True
        return False

    def _declare(self, what: str) -> None:
        if what == "version":
            self.string()
        elif what == "base":
            self.base = self.iri_ref()
        else:
            if self.kind != "pname" or not self.value.endswith(":"):
                raise self.fail("prefix wanted, not")
            name = self.next()[:-1]
            self.prefixes[name] = self.iri_ref()

    def quads(self) -> list[Quad]:
        out: list[Quad] = []
        while self.kind != "end":
            if self.directive():
                continue
            if self.trig and self.at("{"):
                out += self._block(None)
                continue
            if self.trig and self.take_word("GRAPH"):
                out += self._block(self._graph_name())
                continue
            if self.trig and (self.kind in ("iri", "pname", "bnode") and self.tokens[self.i + 1][1] == "{" or self.at("[") and [t[1] for t in self.tokens[self.i + 1 : self.i + 3]] == ["]", "{"]):
                out += self._block(self._graph_name())
                continue
            ts: list[Triple] = []
            self.triples_same_subject(ts)
            self.need(".")
            out += [(None, t.s, t.p, t.o) for t in ts]
        return out

    def _graph_name(self) -> Term:
        if self.kind == "bnode":
            return self.bnode_label()
        if self.take("["):
            self.need("]")
            return self.blank()
        return Term(IRI, self.iri())

    def _block(self, graph: Term | None) -> list[Quad]:
        return [(graph, t.s, t.p, t.o) for t in self.triples_block()]


def parse_turtle(text: str, base: str | None = None, scope: str = "") -> list[Quad]:
    """The quads of a Turtle text; SparqlError if it is none. ``scope`` prefixes its blank node labels."""
    return TurtleParser(text, base, scope=scope).quads()


def parse_trig(text: str, base: str | None = None, scope: str = "") -> list[Quad]:
    return TurtleParser(text, base, trig=True, scope=scope).quads()
