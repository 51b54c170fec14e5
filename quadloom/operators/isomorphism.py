"""Whether two small graphs are the same up to the labels of their blank nodes."""

from __future__ import annotations

from collections import Counter

from quadloom.functions.terms import BNODE, TRIPLE, Term

Triple = tuple  # (g or None, s, p, o)


def _blanks(t: Term | None) -> set[str]:
    if t is None:
        return set()
    if t.kind == TRIPLE:
        return set().union(*map(_blanks, t.parts))
    return {t.lex} if t.kind == BNODE else set()


def _shown(t: Term | None, names: dict[str, str]) -> str:
    if t is None:
        return ""
    if t.kind == TRIPLE:
        return "<<( " + " ".join(_shown(x, names) for x in t.parts) + " )>>"
    return "_:" + names.get(t.lex, "") if t.kind == BNODE else t.id


def _colours(quads: list[Triple], start: dict[str, str]) -> dict[str, str]:
    """Refine the colours of blank nodes by what they are linked to until no more classes come apart."""
    colours = dict(start)
    while True:
        signs: dict[str, list[str]] = {b: [] for b in colours}
        for q in quads:
            line = " ".join(_shown(t, colours) for t in q)
            for i, t in enumerate(q):
                for b in _blanks(t):
                    signs[b].append(f"{i} {line}")
        new = {b: str(hash((colours[b], tuple(sorted(s))))) for b, s in signs.items()}
        if len(set(new.values())) == len(set(colours.values())):
            return new
        colours = new


def isomorphic(a: list[Triple], b: list[Triple]) -> bool:
    """Compare driver-side (g, s, p, o) lists as sets: colour refinement, then a search among nodes of one colour."""
    a, b = ([*{tuple(t and t.id for t in q): q for q in x}.values()] for x in (a, b))
    na, nb = ({n for q in x for t in q for n in _blanks(t)} for x in (a, b))
    return len(a) == len(b) and len(na) == len(nb) and _match(a, b, dict.fromkeys(na, ""), dict.fromkeys(nb, ""), 0)


def _match(a: list[Triple], b: list[Triple], ca: dict[str, str], cb: dict[str, str], depth: int) -> bool:
    ca, cb = _colours(a, ca), _colours(b, cb)
    if Counter(ca.values()) != Counter(cb.values()):
        return False
    classes = Counter(ca.values())
    shared = [n for n in sorted(ca) if classes[ca[n]] > 1]
    if not shared:
        return Counter(" ".join(_shown(t, ca) for t in q) for q in a) == Counter(" ".join(_shown(t, cb) for t in q) for q in b)
    n = shared[0]
    return any(_match(a, b, {**ca, n: f"fixed{depth}"}, {**cb, m: f"fixed{depth}"}, depth + 1) for m in sorted(cb) if cb[m] == ca[n])
