"""SPARQL results as XML and JSON: reading into rows, writing from results."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from quadloom.functions.terms import BNODE, IRI, TRIPLE, Term, literal, triple_term

_NS = "{http://www.w3.org/2005/sparql-results#}"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_DIR = "{http://www.w3.org/2005/11/its}dir"


def _xml_term(e) -> Term:
    tag = e.tag.replace(_NS, "")
    if tag == "uri":
        return Term(IRI, e.text or "")
    if tag == "bnode":
        return Term(BNODE, e.text or "")
    if tag == "triple":
        return triple_term(*(_xml_term(e.find(_NS + k)[0]) for k in ("subject", "predicate", "object")))
    return literal(e.text or "", e.get("datatype"), e.get(_LANG), e.get(_DIR))


def parse_xml_results(text: str) -> tuple[list[str], list[dict[str, Term]] | bool]:
    """The variables and the solutions, or the truth value, of an XML results text."""
    root = ET.fromstring(text)
    truth = root.find(_NS + "boolean")
    if truth is not None:
        return [], (truth.text or "").strip() == "true"
    names = [v.get("name") for v in root.findall(f"{_NS}head/{_NS}variable")]
    rows = [{b.get("name"): _xml_term(b[0]) for b in r.findall(_NS + "binding")} for r in root.findall(f"{_NS}results/{_NS}result")]
    return names, rows


def _json_term(x: dict) -> Term:
    if x["type"] == "uri":
        return Term(IRI, x["value"])
    if x["type"] == "bnode":
        return Term(BNODE, x["value"])
    if x["type"] == "triple":
        return triple_term(*(_json_term(x["value"][k]) for k in ("subject", "predicate", "object")))
    return literal(x["value"], x.get("datatype"), x.get("xml:lang"), x.get("its:dir"))


def parse_json_results(text: str) -> tuple[list[str], list[dict[str, Term]] | bool]:
    doc = json.loads(text)
    if "boolean" in doc:
        return [], bool(doc["boolean"])
    return doc["head"].get("vars", []), [{k: _json_term(v) for k, v in b.items()} for b in doc["results"]["bindings"]]


def _to_xml(t: Term) -> str:
    if t.kind == IRI:
        return f"<uri>{escape(t.lex)}</uri>"
    if t.kind == BNODE:
        return f"<bnode>{escape(t.lex)}</bnode>"
    if t.kind == TRIPLE:
        return "<triple>" + "".join(f"<{k}>{_to_xml(x)}</{k}>" for k, x in zip(("subject", "predicate", "object"), t.parts)) + "</triple>"
    extra = (f" xml:lang={quoteattr(t.lang)}" + (f' xmlns:its="http://www.w3.org/2005/11/its" its:version="2.0" its:dir="{t.dir}"' if t.dir else "")) if t.lang else ""
    if not t.lang and t.dt and not t.dt.endswith("#string"):
        extra = f" datatype={quoteattr(t.dt)}"
    return f"<literal{extra}>{escape(t.lex)}</literal>"


def _to_json(t: Term) -> dict:
    if t.kind == IRI:
        return {"type": "uri", "value": t.lex}
    if t.kind == BNODE:
        return {"type": "bnode", "value": t.lex}
    if t.kind == TRIPLE:
        return {"type": "triple", "value": {k: _to_json(x) for k, x in zip(("subject", "predicate", "object"), t.parts)}}
    out = {"type": "literal", "value": t.lex}
    if t.lang:
        out |= {"xml:lang": t.lang} | ({"its:dir": t.dir} if t.dir else {})
    elif t.dt and not t.dt.endswith("#string"):
        out["datatype"] = t.dt
    return out


def write_xml_results(names: list[str], rows: list[dict[str, Term]] | bool) -> str:
    head = "".join(f"<variable name={quoteattr(n)}/>" for n in names)
    if isinstance(rows, bool):
        body = f"<boolean>{str(rows).lower()}</boolean>"
    else:
        body = "<results>" + "".join("<result>" + "".join(f"<binding name={quoteattr(n)}>{_to_xml(r[n])}</binding>" for n in names if n in r) + "</result>" for r in rows) + "</results>"
    return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head>{body}</sparql>\n'


def write_json_results(names: list[str], rows: list[dict[str, Term]] | bool) -> str:
    if isinstance(rows, bool):
        return json.dumps({"head": {}, "boolean": rows})
    return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: _to_json(r[n]) for n in names if n in r} for r in rows]}}, ensure_ascii=False)


def same_solutions(a: list[dict[str, Term]], b: list[dict[str, Term]]) -> bool:
    """Whether two lists of solutions agree as multisets, numbers by value and blank nodes as one."""
    from collections import Counter

    def norm(t: Term):
        if t.kind == BNODE:
            return "_:"
        try:
            if t.dt and t.dt.rsplit("#")[-1] in ("integer", "decimal", "double", "float", "int", "long"):
                return float(t.lex)
        except ValueError:
            pass
        return t.id

    key = lambda rows: Counter(frozenset((k, norm(v)) for k, v in r.items()) for r in rows)
    return key(a) == key(b)
