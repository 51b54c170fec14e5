"""The functions and operators of query expressions as columns."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import BNODE, IRI, LITERAL, TRIPLE, Term, literal_id, make_term, triple_parts
from quadloom.functions.values import IdVal, Val, as_string, boolean, constant, decimal_text, equal, integer, less, null, number_text, same, string, val_of
from quadloom.functions.vocab import NUMERIC_TYPES, RDF, XSD

_STAMP = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?)?(Z|[+-]\d\d:\d\d)?$"


class UnsupportedFunction(ValueError):
    pass


def numeric(op: str, a: Val, b: Val) -> Val:
    """+ - * / : whole numbers stay whole, except under /; a decimal makes a decimal; else double. NULL on error."""
    if a.is_integer and b.is_integer and op != "/":
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        return Val("native", f(a.col.cast("bigint"), b.col.cast("bigint")), XSD.integer)
    x, y = a.num(), b.num()
    col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()
    if a.t == b.t == "native":
        return Val("native", col, XSD.decimal if XSD.decimal in (a.dt, b.dt) else XSD.double)
    ra, rb = a.number_rank(), b.number_rank()
    both_whole = (ra == 0) & (rb == 0)
    rank = F.when(both_whole, F.lit(2 if op == "/" else 0)).when((ra == 1) | (rb == 1), F.lit(1)).otherwise(F.lit(2))
    return Val("num", col, rank=rank)


def keep(v: Val, lex: Column) -> Val:
    """A text with the language (or datatype) of another."""
    if not v.is_term:
        return string(lex)
    lang, dir = v.lang(), v.dir()
    dt = F.when(lang.isNull(), F.lit(XSD.string)).otherwise(v.dtype())
    ok = F.when(v.kind() == LITERAL, lex)
    return Val("term", make_term(literal_id(ok, dt, lang, dir), LITERAL, ok, dt, lang, dir))


def _text(v: Val) -> Column:
    """String argument: literals and, as string form, IRIs and numbers."""
    return v.lex() if not v.is_term else v.text()


def _flags(v: Val | None) -> str:
    if v is None or v.const is None:
        return ""
    flags = v.const.lex
    if set(flags) - set("ismxq"):
        raise UnsupportedFunction(f"regex flags {flags!r}")
    return "".join(c for c in flags if c in "ismx")


def _pattern(v: Val, flags: Val | None) -> Column:
    if v.const is None:
        head = _flags(flags)
        return F.concat(F.lit(f"(?{head})"), v.lex()) if head else v.lex()
    text, head = v.const.lex, _flags(flags)
    if flags is not None and flags.const is not None and "q" in flags.const.lex:
        text = r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        raise UnsupportedFunction(f"{text!r} is no regular expression") from None
    return F.lit(f"(?{head}){text}" if head else text)


def _stamp(v: Val, i: int) -> Column:
    part = F.regexp_extract(F.when(v.dtype().isin(XSD.dateTime, XSD.date) if v.is_term else F.lit(v.dt in (XSD.dateTime, XSD.date)), v.lex()), _STAMP, i)
    return F.when(part != "", part)


def _clock(v: Val, native, i: int) -> Val:
    if v.t == "native" and v.dt in (XSD.dateTime, XSD.date):
        return integer(native(v.col))
    return integer(_stamp(v, i).try_cast("bigint"))


def _zone(v: Val) -> Column:
    lex = v.lex()
    part = F.regexp_extract(lex, _STAMP, 7)
    is_stamp = v.dtype().isin(XSD.dateTime, XSD.date) & lex.rlike(_STAMP)
    return F.when(is_stamp, part)


def _timezone(v: Val) -> Val:
    z = _zone(v)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    text = F.when(z == "Z", F.lit("PT0S")).when(z != "", F.when(parts == "", F.lit("PT0S")).otherwise(F.concat(F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), parts)))
    return Val("native", text, XSD.dayTimeDuration)


def _each_number(v: Val, f) -> Val:
    if v.is_integer:
        return v
    if v.t == "native" and v.is_number:
        return Val("native", f(v.col).cast("double"), v.dt)
    return Val("num", f(v.num()).cast("double"), rank=v.number_rank())


def cast(dt: str, v: Val) -> Val:
    """xsd constructors; NULL where the text is no such value."""
    lex, n = v.lex(), v.num()
    literal_only = lambda c: c if v.t in ("native", "num") else F.when(v.kind() == LITERAL, c) if v.is_term else null("string")
    if dt == XSD.string:
        return string(F.when(v.kind() != BNODE, lex))
    t = F.trim(literal_only(lex)) if v.t != "iri" else null("string")
    true = boolean(F.lit(True)).col
    if dt == XSD.boolean:
        if v.t == "native" and v.dt == XSD.boolean:
            return v
        return boolean(F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(t.isin("true", "1"), true).when(t.isin("false", "0"), F.lit(False)))
    is_bool = F.lit(v.dt == XSD.boolean) if v.t == "native" else v.dtype() == XSD.boolean
    number = F.coalesce(n, F.when(is_bool, F.when(t.isin("true", "1"), F.lit(1.0)).otherwise(F.lit(0.0))))
    if dt == XSD.integer:
        if v.is_integer:
            return v
        whole = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.3e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
        return integer(F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), whole.cast("bigint")))
    if dt == XSD.decimal:
        return Val("native", F.coalesce(number, F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), t.try_cast("double"))), XSD.decimal)
    if dt in (XSD.double, XSD.float):
        special = F.when(t == "INF", F.lit(float("inf"))).when(t == "-INF", F.lit(float("-inf"))).when(t == "NaN", F.lit(float("nan")))
        return Val("native", F.coalesce(number, F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")), special), dt)
    if dt in (XSD.dateTime, XSD.date):
        if v.t == "native" and v.dt == dt:
            return v
        form = r"^-?\d{4,}-\d\d-\d\d" + (r"T\d\d:\d\d:\d\d(\.\d+)?" if dt == XSD.dateTime else "") + r"(Z|[+-]\d\d:\d\d)?$"
        ok = F.when(t.rlike(form) & F.left(t, F.lit(10)).try_cast("date").isNotNull(), t)
        return Val("term", make_term(literal_id(ok, F.lit(dt)), LITERAL, ok, F.lit(dt)))
    raise UnsupportedFunction(dt)


#: Functions registered by their IRI: called with Vals, they return one.
REGISTERED: dict = {}


def register_function(iri: str, f) -> None:
    """Make a function of columns callable in queries: ``f`` takes and returns Vals."""
    REGISTERED[iri] = f


def call(name: str, args: list[Val], context) -> Val:
    """The value of a call. ``context`` has ``base`` and ``now``."""
    a = args[0] if args else None
    b = args[1] if len(args) > 1 else None
    if name in ("+", "-", "*", "/"):
        return numeric(name, a, b)
    if name == "=":
        return boolean(equal(a, b))
    if name == "!=":
        return boolean(~equal(a, b))
    if name in ("<", "<="):
        return boolean(less(a, b, name == "<"))
    if name in (">", ">="):
        return boolean(less(b, a, name == ">"))
    if name == "&&":
        return boolean(a.ebv() & b.ebv())
    if name == "||":
        return boolean(a.ebv() | b.ebv())
    if name == "!":
        return boolean(~a.ebv())
    if name == "neg":
        return Val("native", -a.col, a.dt) if a.t == "native" and a.is_number else Val("num", -a.num(), rank=a.number_rank())
    if name == "pos":
        return a if a.is_number else Val("num", a.num(), rank=a.number_rank())
    if name == "IN":
        out = F.lit(False)
        for x in args[1:]:
            out = out | equal(a, x)
        return boolean(out)
    if name == "BOUND":
        return boolean(a.bound())
    if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISTRIPLE"):
        k = {"ISBLANK": BNODE, "ISLITERAL": LITERAL, "ISTRIPLE": TRIPLE}.get(name, IRI)
        return boolean(F.when(a.bound(), a.kind() == k))
    if name == "ISNUMERIC":
        return boolean(F.when(a.bound(), a.num().isNotNull()))
    if name == "STR":
        return string(a.text() if a.is_term else a.lex())
    if name == "STRLEN":
        return integer(F.char_length(_text(a)))
    if name in ("UCASE", "LCASE"):
        return keep(a, (F.upper if name == "UCASE" else F.lower)(_text(a)))
    if name == "SUBSTR":
        text, start = _text(a), F.round(b.num()).cast("int")
        if len(args) == 2:
            return keep(a, F.substr(text, F.greatest(start, F.lit(1))))
        end = start + F.round(args[2].num()).cast("int")
        first = F.greatest(start, F.lit(1))
        return keep(a, F.substr(text, first, F.greatest(end - first, F.lit(0))))
    if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
        f = {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[name]
        return boolean(f(_text(a), _text(b)))
    if name in ("STRBEFORE", "STRAFTER"):
        text, cut = _text(a), _text(b)
        at = F.position(cut, text)
        found = F.left(text, at - 1) if name == "STRBEFORE" else F.substr(text, at + F.char_length(cut))
        # a tagged second argument needs a first one of the same tag
        fits = F.lit(True) if not b.is_term else b.lang().isNull() | F.coalesce(F.lower(a.lang()) == F.lower(b.lang()), F.lit(False))
        hit = keep(a, F.when(fits & (at > 0), found))
        missed = F.when(fits & (at == 0), F.lit(""))
        if hit.t == "native":
            return string(F.coalesce(hit.col, missed))
        return Val("term", F.coalesce(hit.col, F.when(missed.isNotNull(), string(missed).term())))
    if name == "CONCAT":
        parts = [_text(x) for x in args]
        text = F.concat(*parts) if parts else F.lit("")
        if not any(x.is_term for x in args):
            return string(text)
        lang, way = args[0].lang(), args[0].dir()
        alike = F.lit(True)
        for x in args[1:]:
            alike = alike & x.lang().eqNullSafe(lang) & x.dir().eqNullSafe(way)
        tag, way = F.when(alike, lang), F.when(alike, way)
        dt = F.when(tag.isNull(), F.lit(XSD.string)).when(way.isNull(), F.lit(RDF.langString)).otherwise(F.lit(RDF.dirLangString))
        return Val("term", make_term(literal_id(text, dt, tag, way), LITERAL, text, dt, tag, way))
    if name == "REGEX":
        return boolean(F.rlike(_text(a), _pattern(b, args[2] if len(args) > 2 else None)))
    if name == "REPLACE":
        to = args[2]
        put = to.lex() if to.const is None else F.lit(re.sub(r"\\(?![$\\])", r"\\\\", to.const.lex))
        return keep(a, F.regexp_replace(_text(a), _pattern(b, args[3] if len(args) > 3 else None), put))
    if name == "ENCODE_FOR_URI":
        text = F.url_encode(_text(a))
        for was, now in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
            text = F.replace(text, F.lit(was), F.lit(now))
        return string(text)
    if name == "LANG":
        return string(F.when(a.kind() == LITERAL, F.coalesce(a.lang(), F.lit(""))))
    if name == "LANGDIR":
        return string(F.when(a.kind() == LITERAL, F.coalesce(a.dir(), F.lit(""))))
    if name in ("HASLANG", "HASLANGDIR"):
        return boolean(F.when(a.bound(), (a.lang() if name == "HASLANG" else a.dir()).isNotNull()))
    if name == "DATATYPE":
        return Val("iri", F.when(a.kind() == LITERAL, a.dtype()))
    if name == "LANGMATCHES":
        tag, want = F.lower(_text(a)), F.lower(_text(b))
        return boolean(F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))
    if name == "SAMETERM":
        return boolean(same(a, b))
    if name == "STRDT":
        if b.const is not None and b.const.lex in (XSD.string,):
            return string(_plain(a))
        return Val("term", make_term(literal_id(_plain(a), b.lex()), LITERAL, _plain(a), b.lex()))
    if name in ("STRLANG", "STRLANGDIR"):
        tag = F.lower(_text(b))
        tag = F.when(tag != "", tag)
        text = F.when(tag.isNotNull(), _plain(a))
        dir = _text(args[2]) if name == "STRLANGDIR" else None
        if dir is not None:
            text = F.when(dir.isin("ltr", "rtl"), text)
        dt = F.lit(RDF.dirLangString if dir is not None else RDF.langString)
        return Val("term", make_term(literal_id(text, dt, tag, dir), LITERAL, text, dt, tag, dir))
    if name in ("IRI", "URI"):
        if a.t == "iri":
            return a
        text = F.when(a.kind() == IRI, a.lex()).when(a.dtype() == XSD.string, _resolved(a.lex(), context.base)) if a.is_term else _resolved(a.lex(), context.base)
        return Val("iri", text)
    if name == "BNODE":
        label = F.concat(F.lit("N"), F.replace(F.uuid(), F.lit("-"), F.lit(""))) if a is None else F.concat(F.lit("bnode_"), _text(a))
        return Val("term", make_term(F.concat(F.lit("_:"), label), BNODE, label))
    if name in ("ABS", "ROUND", "CEIL", "FLOOR"):
        if name == "ABS" and a.is_integer:
            return integer(F.abs(a.col))
        return _each_number(a, {"ABS": F.abs, "ROUND": F.round, "CEIL": F.ceil, "FLOOR": F.floor}[name])
    if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
        text = _text(a)
        return string(F.md5(text) if name == "MD5" else F.sha1(text) if name == "SHA1" else F.sha2(text, int(name[3:])))
    if name == "NOW":
        return constant(Term(LITERAL, context.now, XSD.dateTime))
    if name == "YEAR":
        return _clock(a, F.year, 1)
    if name == "MONTH":
        return _clock(a, F.month, 2)
    if name == "DAY":
        return _clock(a, F.day, 3)
    if name == "HOURS":
        return _clock(a, F.hour, 4)
    if name == "MINUTES":
        return _clock(a, F.minute, 5)
    if name == "SECONDS":
        if a.t == "native" and a.dt == XSD.dateTime:
            return Val("native", (F.unix_micros(a.col) % 60_000_000) / 1e6, XSD.decimal)
        return Val("native", _stamp(a, 6).try_cast("double"), XSD.decimal)
    if name == "TZ":
        return string(_zone(a))
    if name == "TIMEZONE":
        return _timezone(a)
    if name == "RAND":
        return Val("native", F.rand(), XSD.double)
    if name == "UUID":
        return Val("iri", F.uuid(), prefix="urn:uuid:")
    if name == "STRUUID":
        return string(F.uuid())
    if name == "IF":
        return _choose(lambda x, y: F.when(a.ebv(), x).when(~a.ebv(), y), args[1], args[2])
    if name == "COALESCE":
        if not args:
            return string(null("string"))
        out = args[0]
        for x in args[1:]:
            out = _choose(lambda p, q: F.coalesce(p, q), out, x)
        return out
    if name == "TRIPLE":
        ok = args[0].kind().isin(IRI, BNODE) & (args[1].kind() == IRI) & args[2].bound()
        id = F.when(ok, F.concat(F.lit("<<( "), args[0].id(), F.lit(" "), args[1].id(), F.lit(" "), args[2].id(), F.lit(" )>>")))
        return Val("term", make_term(id, TRIPLE, id))
    if name in ("SUBJECT", "PREDICATE", "OBJECT"):
        return IdVal(triple_parts(a.id())[{"SUBJECT": "s", "PREDICATE": "p", "OBJECT": "o"}[name]])
    if name in REGISTERED:
        return REGISTERED[name](*args)
    if name.startswith(XSD):
        return cast(name, a)
    raise UnsupportedFunction(f"unknown function {name}")


def _plain(a: Val) -> Column:
    """The text of a literal without language or with datatype string; NULL for others."""
    if a.t == "native":
        return a.lex() if as_string(a) else null("string")
    return F.when((a.kind() == LITERAL) & (a.dtype() == XSD.string), a.lex())


def _resolved(text: Column, base: str | None) -> Column:
    return F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(base), text)) if base else text


def _choose(f, x: Val, y: Val) -> Val:
    """f of two values in one representation."""
    if x.t == y.t and x.dt == y.dt and x.prefix == y.prefix and x.t != "num":
        return val_of(x.t, f(x.col, y.col), x.dt, x.prefix)
    if x.t == y.t == "iri":
        return Val("iri", f(x.lex(), y.lex()))
    return IdVal(f(x.id(), y.id()))


__all__ = ["NUMERIC_TYPES", "UnsupportedFunction", "call", "register_function", "decimal_text", "number_text"]
