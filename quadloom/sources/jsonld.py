"""JSON-LD into quads, and expanded JSON-LD back. Contexts must be inline; remote ones are refused."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin

from quadloom.functions.terms import BNODE, IRI, LITERAL, TRIPLE, Term, literal, parse_id
from quadloom.functions.vocab import RDF, XSD, Prefixes


class JsonLdError(ValueError):
    pass


class _Context:
    def __init__(self, base: str | None = None):
        self.base, self.vocab, self.language, self.direction, self.terms, self.known = base, None, None, None, {}, None

    def extended(self, local) -> _Context:
        if local is None:
            return _Context(self.base)
        out = _Context(self.base)
        out.vocab, out.language, out.direction, out.terms = self.vocab, self.language, self.direction, dict(self.terms)
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                out = _Context(self.base)
                continue
            if isinstance(c, str):
                raise JsonLdError(f"the remote context {c} isn't loaded")
            if "@base" in c:
                out.base = c["@base"] and urljoin(out.base or "", c["@base"])
            if "@vocab" in c:
                out.vocab = c["@vocab"]
            if "@language" in c:
                out.language = c["@language"]
            if "@direction" in c:
                out.direction = c["@direction"]
            for k, v in c.items():
                if not k.startswith("@"):
                    out.define(k, v, c)
        return out

    def aliases(self) -> dict[str, str | None]:
        """The first term that stands for each of the keywords that nodes are read by."""
        if self.known is None:
            self.known = {k: next((a for a, d in self.terms.items() if d and d["iri"] == k), None) for k in ("@id", "@type", "@graph")}
        return self.known

    def define(self, term: str, value, local: dict) -> None:
        self.known = None
        if value is None:
            self.terms[term] = None
            return
        d = {"@id": value} if isinstance(value, str) else dict(value)
        name = d.get("@reverse", d.get("@id", term))
        prefix = name.partition(":")[0]
        if prefix != name and prefix in local and prefix not in self.terms and prefix != term:
            self.define(prefix, local[prefix], local)
        d["iri"] = name if name.startswith("@") else self.expand(name, vocab=True, skip=term if name == term else None)
        if isinstance(d.get("@type"), str) and not d["@type"].startswith("@"):
            d["@type"] = self.expand(d["@type"], vocab=True)
        self.terms[term] = d

    def expand(self, value: str, vocab: bool = False, skip: str | None = None) -> str:
        if value.startswith("@"):
            return value
        if vocab and value in self.terms and value != skip:
            return self.terms[value]["iri"] if self.terms[value] else value
        if ":" in value:
            prefix, _, rest = value.partition(":")
            if prefix == "_" or rest.startswith("//"):
                return value
            if self.terms.get(prefix):
                return self.terms[prefix]["iri"] + rest
            return value
        if vocab:
            return (self.vocab or "") + value if self.vocab is not None else value
        return urljoin(self.base, value) if self.base else value


class _ToRdf:
    def __init__(self, scope: str):
        self.out, self.fresh, self.scope, self.iris = [], 0, scope, {}

    def blank(self) -> Term:
        self.fresh += 1
        return Term(BNODE, f"{self.scope}j{self.fresh}")

    def term(self, iri: str) -> Term:
        return Term(BNODE, self.scope + iri[2:]) if iri.startswith("_:") else Term(IRI, iri)

    def emit(self, g, s: Term, p: str, o: Term) -> None:
        name = self.iris.get(p)
        if name is None and ":" in p and not p.startswith("_:"):
            name = self.iris[p] = Term(IRI, p)
        if name is not None:
            self.out.append((g, s, name, o))

    def taken(self) -> list:
        """The quads since the last call."""
        out, self.out, self.iris = self.out, [], {}
        return out

    def document(self, doc, ctx: _Context, g=None) -> None:
        for x in doc if isinstance(doc, list) else [doc]:
            if isinstance(x, dict):
                if "@context" in x and set(x) <= {"@context", "@graph"} or set(x) == {"@graph"}:
                    self.document(x.get("@graph", []), ctx.extended(x["@context"]) if "@context" in x else ctx, g)
                else:
                    self.node(x, ctx, g)

    def node(self, x: dict, ctx: _Context, g) -> Term:
        if len(x) == 1 and isinstance(x.get("@id"), str):  # a reference
            return self.term(ctx.expand(x["@id"]))
        if "@context" in x:
            ctx = ctx.extended(x["@context"])
        keyword = ctx.aliases()
        get = lambda k: x.get(k, x.get(keyword.get(k)) if keyword.get(k) else None)
        me = self.term(ctx.expand(get("@id"))) if isinstance(get("@id"), str) else self.blank()
        types = get("@type") or []
        for t in types if isinstance(types, list) else [types]:
            self.emit(g, me, RDF.type, self.term(ctx.expand(t, vocab=True)))
        for k, v in x.items():
            name = ctx.expand(k, vocab=True)
            d = ctx.terms.get(k) or {}
            if name == "@graph":
                self.document(v, ctx, me)
            elif name == "@reverse":
                for rk, rv in v.items():
                    for o in rv if isinstance(rv, list) else [rv]:
                        self.emit(g, self.value(o, ctx, {"@type": "@id"}, g), ctx.expand(rk, vocab=True), me)
            elif name == "@included":
                self.document(v, ctx, g)
            elif name.startswith("@") or v is None:
                continue
            elif "@reverse" in d:
                for o in v if isinstance(v, list) else [v]:
                    self.emit(g, self.value(o, ctx, {"@type": "@id"}, g), name, me)
            else:
                for o in self.values(v, ctx, d, g):
                    self.emit(g, me, name, o)
        return me

    def values(self, v, ctx: _Context, d: dict, g) -> list[Term]:
        box = d.get("@container", [])
        box = [box] if isinstance(box, str) else box
        if "@list" in box:
            return [self.list(v if isinstance(v, list) else [v], ctx, d, g)]
        if "@language" in box and isinstance(v, dict):
            return [literal(t, lang=None if lang == "@none" else lang) for lang, ts in v.items() for t in (ts if isinstance(ts, list) else [ts]) if t is not None]
        if ("@index" in box or "@id" in box or "@type" in box) and isinstance(v, dict):
            out = []
            for k, xs in v.items():
                for one in xs if isinstance(xs, list) else [xs]:
                    if "@id" in box and isinstance(one, dict) and k != "@none":
                        one = {"@id": k, **one}
                    out += self.values(one, ctx, {**d, "@container": []}, g)
            return out
        out = []
        for one in v if isinstance(v, list) else [v]:
            if isinstance(one, dict) and "@list" in one:
                xs = one["@list"]
                out.append(self.list(xs if isinstance(xs, list) else [xs], ctx, d, g))
            elif isinstance(one, dict) and "@set" in one:
                out += self.values(one["@set"], ctx, d, g)
            elif one is not None:
                t = self.value(one, ctx, d, g)
                if t is not None:
                    out.append(t)
        return out

    def list(self, xs: list, ctx: _Context, d: dict, g) -> Term:
        items = [t for x in xs for t in self.values(x, ctx, {**d, "@container": []}, g)]
        cells = [self.blank() for _ in items]
        for i, (c, item) in enumerate(zip(cells, items)):
            self.emit(g, c, RDF.first, item)
            self.emit(g, c, RDF.rest, cells[i + 1] if i + 1 < len(cells) else Term(IRI, RDF.nil))
        return cells[0] if cells else Term(IRI, RDF.nil)

    def value(self, x, ctx: _Context, d: dict, g) -> Term | None:
        kind = d.get("@type")
        if isinstance(x, dict):
            if "@value" not in x:
                return self.node(x, ctx, g)
            v, lang, kind = x["@value"], x.get("@language"), x.get("@type")
            if v is None:
                return None
            if kind == "@json":
                return literal(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF.JSON)
            return self.scalar(v, ctx.expand(kind, vocab=True) if kind else None, lang, x.get("@direction"))
        if kind in ("@id", "@vocab") and isinstance(x, str):
            return self.term(ctx.expand(x, vocab=kind == "@vocab"))
        if kind == "@json":
            return literal(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF.JSON)
        kind = kind if kind and not kind.startswith("@") else None
        lang = d["@language"] if "@language" in d else ctx.language
        return self.scalar(x, kind, lang if isinstance(x, str) and not kind else None, d.get("@direction", ctx.direction))

    def scalar(self, v, dt: str | None, lang: str | None, direction: str | None) -> Term:
        if isinstance(v, bool):
            return literal(str(v).lower(), dt or XSD.boolean)
        if isinstance(v, (int, float)):
            if isinstance(v, int) or v == int(v) and abs(v) < 1e21 and dt != XSD.double:
                return literal(str(int(v)), dt or XSD.integer)
            mantissa, _, power = f"{v:.15E}".partition("E")
            return literal(f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa.rstrip('0').rstrip('.') else mantissa.split('.')[0] + '.0'}E{int(power)}", dt or XSD.double)
        return literal(v, dt, lang, direction)


_BLANK = re.compile(r"[ \t\n\r]*")


def _elements(text: str) -> Iterator:
    """The elements of a JSON text that is an array, one by one; of any other text, the whole."""
    at = _BLANK.match(text).end()
    if text[at : at + 1] != "[":
        yield json.loads(text)
        return
    decode = json.JSONDecoder().raw_decode
    at = _BLANK.match(text, at + 1).end()
    if text[at : at + 1] != "]":
        while True:
            x, at = decode(text, at)
            yield x
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ",":
                break
            at = _BLANK.match(text, at + 1).end()
        if text[at : at + 1] != "]":
            raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
    at = _BLANK.match(text, at + 1).end()
    if at < len(text):
        raise json.JSONDecodeError("Extra data", text, at)


def iter_jsonld(text: str, base: str | None = None, scope: str = "", most: int = 10_000) -> Iterator[list]:
    """The quads of a JSON-LD text in lists, each closed after the element of the outer array with its ``most``-th quad."""
    r, ctx = _ToRdf(scope), _Context(base)
    try:
        for x in _elements(text):
            r.document([x], ctx)
            if len(r.out) >= most:
                yield r.taken()
    except json.JSONDecodeError as e:
        raise JsonLdError(str(e)) from None
    yield r.taken()


def parse_jsonld(text: str, base: str | None = None, scope: str = "") -> list:
    """The quads of a JSON-LD text; blank graph names are kept as terms."""
    return [q for quads in iter_jsonld(text, base, scope) for q in quads]


def _ref(t: Term, name: Callable[[str], str]) -> dict:
    if t.kind == TRIPLE:
        raise ValueError("JSON-LD can't say a triple term")
    if t.kind == LITERAL:
        out = {"@value": t.lex}
        if t.lang:
            out["@language"] = t.lang
            if t.dir:
                out["@direction"] = t.dir
        elif t.dt and t.dt != XSD.string:
            out["@type"] = name(t.dt)
        return out
    return {"@id": name(t.lex) if t.kind == IRI else "_:" + t.lex}


def _expanded(quads: Iterable[tuple], name: Callable[[str], str]) -> list[dict]:
    """The nodes of sorted quads of references: those of a graph stand in the node that names it."""
    graphs: dict[str | None, dict[str, dict]] = {}
    for g, s, p, o in quads:
        nodes = graphs.get(g)
        if nodes is None:
            nodes = graphs[g] = {}
        at = s["@id"]
        n = nodes.get(at)
        if n is None:
            n = nodes[at] = {"@id": at}
        key, value = ("@type", o["@id"]) if p == RDF.type and "@id" in o else (name(p), o)
        if key in n:
            n[key].append(value)
        else:
            n[key] = [value]
    top = graphs.pop(None, {})
    for g, nodes in graphs.items():
        top.setdefault(g, {"@id": g})["@graph"] = list(nodes.values())
    return list(top.values())


def jsonld_nodes(rows: Iterable[tuple]) -> str:
    """Expanded nodes of sorted (g, s, p, o), terms as ids, as the inside of an array."""
    refs: dict[str, dict] = {}
    of = lambda x: refs[x] if x in refs else refs.setdefault(x, _ref(parse_id(x), str))
    return json.dumps(_expanded(((g or None, of(s), p, of(o)) for g, s, p, o in rows), str), ensure_ascii=False, separators=(",", ":"))[1:-1]


def to_jsonld(quads: list, prefixes: Prefixes | None = None) -> str:
    """Expanded, flattened JSON-LD; compact names where ``prefixes`` are given."""
    name = (lambda i: prefixes.qname(i) or i) if prefixes else (lambda i: i)
    in_order = sorted(quads, key=lambda q: (q[0].id if q[0] else "", q[1].id, q[2].lex, q[3].id))
    top = _expanded(((_ref(g, name)["@id"] if g else None, _ref(s, name), p.lex, _ref(o, name)) for g, s, p, o in in_order), name)
    doc = top if not prefixes else {"@context": {p: n for p, n in prefixes.of.items() if p}, "@graph": top}
    return json.dumps(doc, indent=2, ensure_ascii=False)
