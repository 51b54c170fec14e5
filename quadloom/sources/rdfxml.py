"""RDF/XML texts into quads, and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from quadloom.functions.terms import BNODE, IRI, LITERAL, TRIPLE, Term, iri, literal, triple_term
from quadloom.functions.vocab import RDF, XSD, Prefixes, split_iri

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + str(RDF) + "}"
_ITS = "{http://www.w3.org/2005/11/its}"
_NOT_NODES = {_R + x for x in ("RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "li", "aboutEach", "aboutEachPrefix", "datatype")}
_NOT_ATTRIBUTES = {_R + x for x in ("ID", "about", "parseType", "resource", "nodeID", "datatype", "annotation", "annotationNodeID", "version")}


class RdfXmlError(ValueError):
    pass


class _Reader:
    def __init__(self, base: str | None, scope: str):
        self.out: list = []
        self.base, self.scope, self.fresh, self.ids = base, scope, 0, set()

    def blank(self) -> Term:
        self.fresh += 1
        return Term(BNODE, f"{self.scope}x{self.fresh}")

    def emit(self, s: Term, p: str, o: Term) -> None:
        self.out.append((None, s, Term(IRI, p), o))

    def resolve(self, value: str, base: str | None) -> Term:
        try:
            if value == "" and base:
                return iri(base.split("#")[0])
            return iri(value, base)
        except ValueError as e:
            raise RdfXmlError(str(e)) from None

    def name(self, tag: str) -> str:
        if not tag.startswith("{"):
            raise RdfXmlError(f"<{tag}> has no namespace")
        ns, _, local = tag[1:].partition("}")
        return ns + local

    def scopes(self, e, base, lang, direction):
        base = iri(e.get(_XML + "base"), base).lex if e.get(_XML + "base") is not None else base
        lang = e.get(_XML + "lang") if e.get(_XML + "lang") is not None else lang
        direction = e.get(_ITS + "dir") if e.get(_ITS + "dir") is not None else direction
        return base, lang or None, direction or None

    def document(self, root) -> None:
        base, lang, direction = self.scopes(root, self.base, None, None)
        if root.tag == _R + "RDF":
            for e in root:
                self.node(e, base, lang, direction)
        else:
            self.node(root, self.base, None, None)

    def identity(self, value: str, base: str | None) -> Term:
        if not value or not (value[0].isalpha() or value[0] == "_") or not all(c.isalnum() or c in "_-." for c in value):
            raise RdfXmlError(f"{value!r} is no rdf:ID")
        t = self.resolve("#" + value, base) if base else Term(IRI, "#" + value)
        if t.lex in self.ids:
            raise RdfXmlError(f"rdf:ID {value!r} twice")
        self.ids.add(t.lex)
        return t

    def node(self, e, base, lang, direction) -> Term:
        if e.tag in _NOT_NODES:
            raise RdfXmlError(f"{e.tag} is no node")
        base, lang, direction = self.scopes(e, base, lang, direction)
        given = [a for a in ("about", "ID", "nodeID") if e.get(_R + a) is not None]
        if len(given) > 1:
            raise RdfXmlError("a node with two names")
        if e.get(_R + "about") is not None:
            me = self.resolve(e.get(_R + "about"), base)
        elif e.get(_R + "ID") is not None:
            me = self.identity(e.get(_R + "ID"), base)
        elif e.get(_R + "nodeID") is not None:
            me = Term(BNODE, self.scope + e.get(_R + "nodeID"))
        else:
            me = self.blank()
        if e.tag != _R + "Description":
            self.emit(me, RDF.type, Term(IRI, self.name(e.tag)))
        self.attributes(me, e, base, lang, direction)
        n = 0
        for child in e:
            tag = child.tag
            if tag == _R + "li":
                n += 1
                tag = f"{_R}_{n}"
            self.property(me, child, tag, base, lang, direction)
        return me

    def attributes(self, me: Term, e, base, lang, direction) -> bool:
        found = False
        for k, v in e.attrib.items():
            if k.startswith(_XML) or k.startswith(_ITS) or k in _NOT_ATTRIBUTES or not k.startswith("{"):
                continue
            if k in _NOT_NODES:
                raise RdfXmlError(f"{k} is no property")
            found = True
            if k == _R + "type":
                self.emit(me, RDF.type, self.resolve(v, base))
            else:
                self.emit(me, self.name(k), literal(v, lang=lang, dir=direction))
        return found

    def property(self, me: Term, e, tag: str, base, lang, direction) -> None:
        if tag in _NOT_NODES or tag == _R + "Description":
            raise RdfXmlError(f"{tag} is no property")
        base, lang, direction = self.scopes(e, base, lang, direction)
        p = self.name(tag)
        kind = e.get(_R + "parseType")
        children = list(e)
        if kind == "Resource":
            o = self.blank()
            n = 0
            for child in children:
                t = child.tag
                if t == _R + "li":
                    n += 1
                    t = f"{_R}_{n}"
                self.property(o, child, t, base, lang, direction)
        elif kind == "Collection":
            items = [self.node(c, base, lang, direction) for c in children]
            cells = [self.blank() for _ in items]
            for i, (c, item) in enumerate(zip(cells, items)):
                self.emit(c, RDF.first, item)
                self.emit(c, RDF.rest, cells[i + 1] if i + 1 < len(cells) else Term(IRI, RDF.nil))
            o = cells[0] if cells else Term(IRI, RDF.nil)
        elif kind == "Triple":
            inner = _Reader(base, f"{self.scope}t{self.fresh}")
            inner.ids = self.ids
            for c in children:
                inner.node(c, base, lang, direction)
            if len(inner.out) != 1:
                raise RdfXmlError("parseType Triple holds one triple")
            o = triple_term(*inner.out[0][1:])
        elif kind is not None:
            text = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
            o = literal(text, RDF.XMLLiteral)
        elif children:
            if len(children) > 1 or (e.text or "").strip():
                raise RdfXmlError("a property with more than a node")
            o = self.node(children[0], base, lang, direction)
        elif e.get(_R + "resource") is not None or e.get(_R + "nodeID") is not None:
            o = self.resolve(e.get(_R + "resource"), base) if e.get(_R + "resource") is not None else Term(BNODE, self.scope + e.get(_R + "nodeID"))
            self.attributes(o, e, base, lang, direction)
        else:
            fresh = self.blank()
            if e.get(_R + "datatype") is None and not (e.text or "") and self.attributes(fresh, e, base, lang, direction):
                o = fresh
            else:
                dt = e.get(_R + "datatype")
                o = literal(e.text or "", self.resolve(dt, base).lex) if dt is not None else literal(e.text or "", lang=lang, dir=direction)
        self.emit(me, p, o)
        if e.get(_R + "ID") is not None:
            r = self.identity(e.get(_R + "ID"), base)
            for name, x in (("type", Term(IRI, RDF.Statement)), ("subject", me), ("predicate", Term(IRI, p)), ("object", o)):
                self.emit(r, RDF[name], x)
        for a in ("annotation", "annotationNodeID"):
            if e.get(_R + a) is not None:
                r = self.resolve(e.get(_R + a), base) if a == "annotation" else Term(BNODE, self.scope + e.get(_R + a))
                self.emit(r, RDF.reifies, triple_term(me, Term(IRI, p), o))


def parse_rdfxml(text: str, base: str | None = None, scope: str = "") -> list:
    """The quads of an RDF/XML text."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise RdfXmlError(str(e)) from None
    r = _Reader(base, scope)
    r.document(root)
    return r.out


def to_rdfxml(triples: list[tuple[Term, Term, Term]], prefixes: Prefixes | None = None) -> str:
    """The RDF/XML text of triples; ValueError for a triple term, which it can't say, or a predicate without a name."""
    prefixes = prefixes or Prefixes()
    names: dict[str, str] = {str(RDF): "rdf"}

    def tag(p: str) -> str:
        ns, local = split_iri(p)
        if not local:
            raise ValueError(f"<{p}> has no local name")
        known = prefixes.prefix(ns)
        names.setdefault(ns, known or f"ns{len(names)}")
        return f"{names[ns]}:{local}"

    subjects: dict[str, list] = {}
    for s, p, o in triples:
        subjects.setdefault(s.id, []).append((s, p, o))
    body = []
    for _, rows in sorted(subjects.items()):
        s = rows[0][0]
        if s.kind == TRIPLE or any(o.kind == TRIPLE for _, _, o in rows):
            raise ValueError("RDF/XML can't say this triple term")
        who = f"rdf:about={quoteattr(s.lex)}" if s.kind == IRI else f"rdf:nodeID={quoteattr(s.lex)}"
        body.append(f"  <rdf:Description {who}>")
        for _, p, o in sorted(rows, key=lambda r: (r[1].lex != RDF.type, r[1].lex, r[2].id)):
            t = tag(p.lex)
            if o.kind == IRI:
                body.append(f"    <{t} rdf:resource={quoteattr(o.lex)}/>")
            elif o.kind == BNODE:
                body.append(f"    <{t} rdf:nodeID={quoteattr(o.lex)}/>")
            else:
                extra = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.dt)}" if o.dt and o.dt != XSD.string else ""
                if o.dir:
                    extra += f' its:dir="{o.dir}" its:version="2.0"'
                    names.setdefault("http://www.w3.org/2005/11/its", "its")
                body.append(f"    <{t}{extra}>{escape(o.lex)}</{t}>")
        body.append("  </rdf:Description>")
    spaces = "".join(f"\n  xmlns:{p}={quoteattr(ns)}" for ns, p in sorted(names.items(), key=lambda x: x[1]))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{spaces}>\n' + "\n".join(body) + "\n</rdf:RDF>\n"


#: What stands around the descriptions of a document.
RDFXML_HEAD, RDFXML_TAIL = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n', "</rdf:RDF>"


def rdfxml_descriptions(triples: list[tuple[Term, Term, Term]]) -> str:
    """The descriptions of an RDF/XML document, each with the namespaces it needs."""
    whole = to_rdfxml(triples)
    head, _, body = whole.partition("\n<rdf:RDF")
    names, _, body = body.partition(">\n")
    return body.removesuffix("\n</rdf:RDF>\n").replace("  <rdf:Description ", f"  <rdf:Description{names} ")


__all__ = ["LITERAL", "RdfXmlError", "parse_rdfxml", "to_rdfxml"]
