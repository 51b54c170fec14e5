"""RDF terms: as values of the driver, and as columns.

A term column is a struct<id, kind, lex, dt, lang, dir, num, ts> whose ``id``, the N3 form, is its identity. ``kind`` is
0 for blank nodes, 1 for IRIs, 2 for literals, 3 for triple terms. ``num`` and ``ts`` are caches and may be NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.vocab import RDF, XSD

BNODE, IRI, LITERAL, TRIPLE = 0, 1, 2, 3

TERM = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("ts", T.TimestampType()),
    ]
)
TERM_DDL = "struct<id:string,kind:tinyint,lex:string,dt:string,lang:string,dir:string,num:double,ts:timestamp>"
QUADS = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM)])

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_BAD_IRI = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
_LANG = re.compile(r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*")


def escape(s: str) -> str:
    return re.sub(r'[\\"\n\r\t]', lambda m: _ESCAPES[m.group()], s)


def unescape(s: str) -> str:
    """Undo string escapes; ValueError for an unknown one or a surrogate."""
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "uU" and len(x) > 1:
            n = int(x[1:], 16)
            if 0xD800 <= n <= 0xDFFF or n > 0x10FFFF:
                raise ValueError(f"\\{x} is no character")
            return chr(n)
        if x in _UNESCAPES:
            return _UNESCAPES[x]
        raise ValueError(f"unknown escape \\{x}")

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


_SHORT = {
    XSD.integer: re.compile(r"[+-]?[0-9]{1,18}"), XSD.boolean: re.compile(r"true|false"), XSD.decimal: re.compile(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+)"),
    XSD.double: re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]+"),
}


def _is_short(lex: str, dt: str | None) -> bool:
    """Whether N3 writes a literal without quotes and datatype."""
    form = _SHORT.get(dt)
    return bool(form and form.fullmatch(lex))


@dataclass(frozen=True)
class Term:
    """A term on the driver. For triple terms, ``parts`` has the three terms."""

    kind: int
    lex: str
    dt: str | None = None
    lang: str | None = None
    dir: str | None = None
    parts: tuple | None = None

    @property
    def id(self) -> str:
        if self.kind == IRI:
            return f"<{self.lex}>"
        if self.kind == BNODE:
            return f"_:{self.lex}"
        if self.kind == TRIPLE:
            return f"<<( {' '.join(p.id for p in self.parts)} )>>"
        if _is_short(self.lex, self.dt):
            return self.lex
        return self.line

    @property
    def line(self) -> str:
        """As ``id``, but as it stands in N-Triples: numbers and truth values are quoted, too."""
        if self.kind == TRIPLE:
            return f"<<( {' '.join(p.line for p in self.parts)} )>>"
        if self.kind != LITERAL:
            return self.id
        text = f'"{escape(self.lex)}"'
        if self.lang:
            return f"{text}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return text if self.dt in (None, XSD.string) else f"{text}^^<{self.dt}>"

    def row(self) -> tuple:
        return (self.id, self.kind, self.lex if self.kind != TRIPLE else self.id, self.dt, self.lang, self.dir, None, None)

    def __str__(self) -> str:
        return self.id


def iri(value: str, base: str | None = None) -> Term:
    value = str(value)
    if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
        from urllib.parse import urljoin

        value = urljoin(base, value)
    if _BAD_IRI.search(value):
        raise ValueError(f"{value!r} has characters that IRIs can't have")
    return Term(IRI, value)


def bnode(label: str) -> Term:
    return Term(BNODE, label)


def literal(value, dt: str | None = None, lang: str | None = None, dir: str | None = None) -> Term:
    """A literal of a Python value; language tags become lower case, malformed ones and unknown directions are dropped."""
    if lang is not None:
        lang = lang.lower() if _LANG.fullmatch(lang) else None
    dir = dir if dir in ("ltr", "rtl") and lang else None
    if dt is None and not lang:
        if isinstance(value, bool):
            value, dt = str(value).lower(), XSD.boolean
        elif isinstance(value, int):
            dt = XSD.integer
        elif isinstance(value, float):
            value, dt = repr(value), XSD.double
    dt = (RDF.dirLangString if dir else RDF.langString) if lang else dt or XSD.string
    return Term(LITERAL, str(value), dt, lang, dir)


def triple_term(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, "", parts=(s, p, o))


_TOKEN = re.compile(
    r'\s*(?:<<\(|\)>>|<([^<>]*)>|_:([^\s<>"()]+)|(?:"""((?:"{0,2}(?:[^"\\]|\\.))*"{0,2})"""|"((?:[^"\\]|\\.)*)")(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(ltr|rtl))?|\^\^<([^<>]*)>)?'
    r"|((?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|true|false)(?![^\s)])))", re.DOTALL
)


def parse_id(text: str) -> Term:
    """The term of an N3 form."""
    term, end = _parse_at(text, 0)
    if text[end:].strip():
        raise ValueError(f"more than a term: {text!r}")
    return term


def _parse_at(text: str, at: int, short: bool = True) -> tuple[Term, int]:
    m = _TOKEN.match(text, at)
    if not m:
        raise ValueError(f"no term at {at} of {text!r}")
    whole = m.group().strip()
    if whole == "<<(":
        parts, at = [], m.end()
        for _ in range(3):
            part, at = _parse_at(text, at, short)
            parts.append(part)
        close = re.compile(r"\s*\)>>").match(text, at)
        if not close:
            raise ValueError(f"triple term isn't closed: {text!r}")
        return triple_term(*parts), close.end()
    if m.group(1) is not None:
        return Term(IRI, unescape(m.group(1))), m.end()
    if m.group(2) is not None:
        return Term(BNODE, m.group(2)), m.end()
    if m.group(8) is not None and short:
        lex = m.group(8)
        return Term(LITERAL, lex, XSD.boolean if lex[0] in "tf" else XSD.double if "e" in lex.lower() else XSD.decimal if "." in lex else XSD.integer), m.end()
    quoted = m.group(4) if m.group(3) is None else m.group(3)
    if quoted is None:
        raise ValueError(f"no term at {at} of {text!r}")
    return literal(unescape(quoted), m.group(7), m.group(5), m.group(6)), m.end()


def skolemize(node: Term, base: str) -> Term:
    """The IRI that stands for a blank node."""
    return iri(f"{base.rstrip('/')}/.well-known/genid/{node.lex}") if node.kind == BNODE else node


def defragment(node: Term) -> tuple[Term, str]:
    """An IRI without its fragment, and the fragment."""
    base, _, fragment = node.lex.partition("#")
    return Term(IRI, base), fragment


def term_key(t: Term) -> tuple:
    """Order of terms: blank nodes, IRIs, literals, triple terms; numbers of the same datatype by value, else by N3."""
    n = None
    if t.kind == LITERAL:
        try:
            n = float(t.lex) if t.dt and t.dt.startswith(XSD) and t.dt.rsplit("#")[-1] in ("integer", "decimal", "double", "float", "int", "long") else None
        except ValueError:
            n = None
    return (t.kind, 0 if n is not None else 1, t.dt or "" if n is not None else "", n or 0.0, t.id)


# Columns -------------------------------------------------------------------------------------------------------------


def lit_term(t: Term) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(t.row(), TERM.fields)])


def escaped(c: Column) -> Column:
    for raw, shown in _ESCAPES.items():
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def literal_id(lex: Column, dt: Column | str | None, lang: Column | None = None, dir: Column | None = None, short: bool = True) -> Column:
    """The N3 form of a literal; with ``short``, numbers and truth values stand without quotes."""
    text = F.concat(F.lit('"'), escaped(lex), F.lit('"'))
    fixed, dt = (dt, F.lit(dt)) if isinstance(dt, str) else (None, dt)
    typed = text if dt is None else F.when(dt.isNull() | (dt == XSD.string), text).otherwise(F.concat(text, F.lit("^^<"), dt, F.lit(">")))
    if short and dt is not None:
        for name, form in _SHORT.items():
            if fixed is None or fixed == name:
                bare = lex.rlike(f"^({form.pattern})$")
                typed = F.when(bare if fixed else (dt == name) & bare, lex).otherwise(typed)
    if lang is None:
        return typed
    tagged = F.concat(text, F.lit("@"), lang)
    if dir is not None:
        tagged = F.when(dir.isNull(), tagged).otherwise(F.concat(tagged, F.lit("--"), dir))
    return F.when(lang.isNull(), typed).otherwise(tagged)


def make_term(id: Column, kind: Column | int, lex: Column, dt: Column | None = None, lang: Column | None = None, dir: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    values = [id, F.lit(kind) if isinstance(kind, int) else kind, lex, none if dt is None else dt, none if lang is None else lang, none if dir is None else dir, F.lit(None), F.lit(None)]
    built = F.struct(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, TERM.fields)])
    return F.when(id.isNotNull(), built)


def iri_term(value: Column) -> Column:
    return make_term(F.concat(F.lit("<"), value, F.lit(">")), IRI, value)


def literal_term(lex: Column, dt: str | Column | None = None, lang: Column | None = None) -> Column:
    fixed = dt if isinstance(dt, Column) else dt or XSD.string
    d = F.lit(fixed) if isinstance(fixed, str) else fixed
    return make_term(literal_id(lex, fixed, lang), LITERAL, lex, d if lang is None else F.when(lang.isNull(), d).otherwise(F.lit(RDF.langString)), lang)


def id_kind(id: Column) -> Column:
    c = F.left(id, F.lit(1))
    return F.when(id.startswith("<<("), F.lit(TRIPLE)).when(c == "<", F.lit(IRI)).when(c == "_", F.lit(BNODE)).when(id.isNotNull(), F.lit(LITERAL))


def _after_text(id: Column) -> Column:
    """What follows the closing quote of a quoted literal's id: no quote can stand there."""
    return F.substring_index(id, '"', -1)


def _quoted(id: Column) -> Column:
    return id.startswith('"')


def id_lex(id: Column) -> Column:
    """The lexical form, IRI or label of an id; of a triple term, the id itself."""
    n = F.length(id) - F.length(_after_text(id))
    raw = F.when(id.startswith('"""') & (n >= 6), F.substr(id, F.lit(4), n - 6)).otherwise(F.substr(id, F.lit(2), n - 2))
    text = F.replace(raw, F.lit("\\\\"), F.lit("\x01"))
    for raw_char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        text = F.replace(text, F.lit(shown), F.lit(raw_char))
    text = F.when(F.contains(raw, F.lit("\\")), F.replace(text, F.lit("\x01"), F.lit("\\"))).otherwise(raw)
    c = F.left(id, F.lit(1))
    return F.when(id.startswith("<<("), id).when(c == "<", F.substring(id, 2, F.length(id) - 2)).when(c == "_", F.substr(id, F.lit(3))).when(c == '"', text).otherwise(id)


def id_lang(id: Column) -> Column:
    rest = _after_text(id)
    return F.when(_quoted(id) & rest.startswith("@"), F.substring_index(F.substr(rest, F.lit(2)), "--", 1))


def id_dir(id: Column) -> Column:
    rest = _after_text(id)
    return F.when(_quoted(id) & rest.startswith("@") & F.contains(rest, F.lit("--")), F.substring_index(rest, "--", -1))


def id_dt(id: Column) -> Column:
    rest = _after_text(id)
    typed = F.when(rest == "", F.lit(XSD.string)).when(rest.startswith("^^<"), F.substring(rest, 4, F.length(rest) - 4))
    tagged = F.when(F.contains(rest, F.lit("--")), F.lit(RDF.dirLangString)).otherwise(F.lit(RDF.langString))
    short = F.when(id.isin("true", "false"), F.lit(XSD.boolean)).when(id.rlike("[eE]"), F.lit(XSD.double)).when(F.contains(id, F.lit(".")), F.lit(XSD.decimal)).otherwise(F.lit(XSD.integer))
    return F.when(_quoted(id), F.coalesce(typed, tagged)).when(~F.left(id, F.lit(1)).isin("<", "_"), short)


def term_of_id(id: Column) -> Column:
    """The term struct of an N3 form, on the JVM."""
    return make_term(id, id_kind(id), id_lex(id), id_dt(id), id_lang(id), id_dir(id))


def _parts(ids):
    import pandas as pd

    out = []
    for x in ids:
        try:
            t = parse_id(x) if x is not None and x.startswith("<<(") else None
        except ValueError:
            t = None
        out.append((None, None, None) if t is None else tuple(p.id for p in t.parts))
    return pd.DataFrame(out, columns=["s", "p", "o"])


def triple_parts(id: Column) -> Column:
    """The three parts of a triple term's id, as ids: nested terms make this a grammar, so it runs in Python over Arrow."""
    return F.pandas_udf(_parts, T.StructType([T.StructField(c, T.StringType()) for c in "spo"]))(id)
