"""Turtle and TriG texts of lists of triples: whole graphs that fit the driver, or pieces of larger ones."""

from __future__ import annotations

from quadloom.functions.terms import BNODE, IRI, LITERAL, TRIPLE, Term, escape
from quadloom.functions.vocab import RDF, RDFS, XSD, Prefixes


class _Writer:
    def __init__(self, triples: list, prefixes: Prefixes, inline: bool = True):
        self.prefixes, self.used, self.inline = prefixes, set(), inline
        self.parent: dict[str, Term] = {}
        self.of: dict[str, list] = {}
        self.refs: dict[str, int] = {}
        self.term: dict[str, Term] = {}
        for s, p, o in triples:
            self.of.setdefault(s.id, []).append((p, o))
            self.term[s.id] = s
            self.refs[o.id] = self.refs.get(o.id, 0) + 1
            self.parent[o.id] = s
        self.inlined: set[str] = set()

    def iri(self, t: Term) -> str:
        q = self.prefixes.qname(t.lex)
        if q is None:
            return t.id
        self.used.add(q.partition(":")[0])
        return q

    def show(self, t: Term, depth: int, path: tuple = ()) -> str:
        if t.kind == IRI:
            return self.iri(t)
        if t.kind == TRIPLE:
            return "<<( " + " ".join(self.show(x, depth) for x in t.parts) + " )>>"
        if t.kind == LITERAL:
            if t.dt == XSD.integer and t.lex.isascii() and t.lex.removeprefix("-").isdigit() or t.dt == XSD.boolean and t.lex in ("true", "false"):
                return t.lex
            if t.lang or t.dt in (None, XSD.string):
                return t.id
            return f'"{escape(t.lex)}"^^{self.iri(Term(IRI, t.dt))}'
        if self.inline and self.refs.get(t.id, 0) == 1 and t.id not in path and self.anchored(t):
            items = self.items(t)
            if items is not None:
                return "( " + " ".join(self.show(x, depth, (*path, t.id)) for x in items) + " )" if items else "()"
            self.inlined.add(t.id)
            rows = self.of.get(t.id, [])
            return "[ " + self.properties(rows, depth + 1, (*path, t.id)) + " ]" if rows else "[]"
        return t.id

    def anchored(self, t: Term) -> bool:
        """Whether following the only links to a blank node leads to a node that is written on its own."""
        seen = set()
        while t.kind == BNODE and self.refs.get(t.id, 0) == 1:
            if t.id in seen:
                return False
            seen.add(t.id)
            t = self.parent[t.id]
        return True

    def items(self, t: Term) -> list | None:
        """The members of a well-formed list whose cells nothing else uses."""
        out, cells = [], []
        while t.lex != RDF.nil:
            rows = self.of.get(t.id, [])
            firsts, rests = [o for p, o in rows if p.lex == RDF.first], [o for p, o in rows if p.lex == RDF.rest]
            if t.kind != BNODE or len(rows) != 2 or len(firsts) != 1 or len(rests) != 1 or t.id in cells or self.refs.get(t.id, 0) != 1:
                return None
            out.append(firsts[0])
            cells.append(t.id)
            t = rests[0]
        self.inlined.update(cells)
        return out

    def properties(self, rows: list, depth: int, path: tuple) -> str:
        by: dict[str, list] = {}
        for p, o in sorted(rows, key=lambda r: (r[0].lex != RDF.type, r[0].lex, r[1].id)):
            by.setdefault(p.id, [p]).append(o)
        pad = " ;\n" + "    " * depth
        return pad.join(("a" if p.lex == RDF.type else self.iri(p)) + " " + ", ".join(self.show(o, depth, path) for o in os) for p, *os in by.values())

    def body(self) -> str:
        def rank(s: str):
            t = self.term[s]
            is_class = any(p.lex == RDF.type and o.lex == RDFS.Class for p, o in self.of[s])
            return (not is_class, t.kind != IRI, self.refs.get(s, 0) == 1 and t.kind == BNODE, s)

        blocks = []
        for s in sorted(self.of, key=rank):
            t = self.term[s]
            if self.inline and (s in self.inlined or t.kind == BNODE and self.refs.get(s, 0) == 1 and self.anchored(t)):
                continue
            blocks.append(("[]" if self.inline and t.kind == BNODE and not self.refs.get(s) else self.show_subject(t)) + " " + self.properties(self.of[s], 1, (s,)) + " .")
        return "\n\n".join(blocks)

    def show_subject(self, t: Term) -> str:
        return self.iri(t) if t.kind == IRI else t.id


def _head(prefixes: Prefixes, used: set[str]) -> str:
    return "".join(f"@prefix {p}: <{prefixes.of[p]}> .\n" for p in sorted(used))


def to_turtle(triples: list, prefixes: Prefixes | None = None, inline: bool = True) -> str:
    """Turtle of (s, p, o): used prefixes only; classes first, then IRIs, then blank nodes; lists and blank nodes in place.

    Without ``inline`` blank nodes and lists have labels, so that other texts can refer to them."""
    w = _Writer(triples, prefixes or Prefixes(), inline)
    body = w.body()
    head = _head(w.prefixes, w.used)
    return head + ("\n" if head and body else "") + body + ("\n" if body else "")


def to_trig(quads: list, prefixes: Prefixes | None = None, inline: bool = True) -> str:
    """TriG of (g, s, p, o): the default graph first, then graphs by name."""
    prefixes = prefixes or Prefixes()
    graphs: dict[str | None, list] = {}
    names: dict[str, Term] = {}
    for g, s, p, o in quads:
        graphs.setdefault(g.id if g else None, []).append((s, p, o))
        if g:
            names[g.id] = g
    used, parts = set(), []
    for g in sorted(graphs, key=lambda x: (x is not None, x or "")):
        w = _Writer(graphs[g], prefixes, inline)
        body = w.body()
        if g is None:
            parts.append(body)
        else:
            name = w.iri(names[g]) if names[g].kind == IRI else g
            parts.append(f"{name} {{\n" + "\n".join("    " + x if x else x for x in body.split("\n")) + "\n}")
        used |= w.used
    head = _head(prefixes, used)
    return head + ("\n" if head else "") + "\n\n".join(parts) + "\n"
