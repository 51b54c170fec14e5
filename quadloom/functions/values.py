"""Values of variables and expressions as columns of the narrowest type that is known when a query is compiled.

A value is ``native`` (a column of a Spark type with a fixed datatype), ``iri`` (a key column behind a fixed prefix), ``num`` (a
double whose RDF datatype depends on the row), ``id`` (the N3 form of any term) or ``term`` (a term struct). NULL is an unbound
variable or an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.terms import BNODE, IRI, LITERAL, Term, escaped, id_dir, id_dt, id_kind, id_lang, id_lex, iri_term, lit_term, literal_id, literal_term, make_term, term_of_id
from quadloom.functions.vocab import INTEGER_TYPES, NUMERIC_TYPES, XSD

#: Spark types by the datatype of native values.
SPARK_TYPE = {XSD.integer: "bigint", XSD.double: "double", XSD.decimal: "double", XSD.float: "double", XSD.string: "string", XSD.boolean: "boolean", XSD.dateTime: "timestamp", XSD.date: "date"}


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def number_text(c: Column) -> Column:
    """The lexical form of a double: whole numbers without a fraction, else the shortest form."""
    whole = (F.abs(c) < 1e15) & (c == F.floor(c))
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), "E(-?)", "e$1")
    return F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("INF")).when(c == float("-inf"), F.lit("-INF")).when(whole, c.cast("bigint").cast("string")).otherwise(text)


def decimal_text(c: Column) -> Column:
    """The lexical form of a decimal: at most ten digits of fraction."""
    fixed = F.rtrim(F.rtrim(F.format_string("%.10f", c), F.lit("0")), F.lit("."))
    return F.when(F.abs(c) < 1e15, F.when(fixed == "-0", F.lit("0")).otherwise(fixed)).otherwise(number_text(c))


def _instant(lex: Column) -> Column:
    """The instant that a text states, whatever its datatype."""
    day = F.regexp_replace(lex, r"^(-?\d{4}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)?$", "$1T00:00:00$2")
    ok = lex.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:\d\d)?$")
    return F.when(ok, day.try_cast("timestamp"))


_NUMERIC_FORM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class Val:
    t: str
    col: Column
    dt: str | None = None
    prefix: str = ""
    rank: Column | None = None  # of num: 0 integer, 1 decimal, 2 double
    const: Term | None = None

    # what it is
    @property
    def is_term(self) -> bool:
        """Whether only its rows tell what kind of term it is."""
        return self.t in ("term", "id")

    def bound(self) -> Column:
        return self.col.isNotNull()

    @property
    def is_number(self) -> bool:
        return self.t == "num" or self.t == "native" and self.dt in NUMERIC_TYPES

    @property
    def is_integer(self) -> bool:
        return self.t == "native" and self.dt in INTEGER_TYPES

    def kind(self) -> Column:
        if self.t == "term":
            return self.col["kind"]
        return F.when(self.bound(), F.lit(IRI if self.t == "iri" else LITERAL))

    def lex(self) -> Column:
        if self.const is not None:
            return F.lit(self.const.lex)
        if self.t == "term":
            return self.col["lex"]
        if self.t == "iri":
            text = self.col.cast("string")
            return F.concat(F.lit(self.prefix), text) if self.prefix else text
        if self.t == "num":
            return F.when(self.rank == 0, self.col.cast("decimal(38,0)").cast("string")).when(self.rank == 1, decimal_text(self.col)).otherwise(number_text(self.col))
        if self.dt in (XSD.double, XSD.float):
            return number_text(self.col)
        if self.dt == XSD.decimal:
            return decimal_text(self.col)
        if self.dt == XSD.dateTime:
            return F.regexp_replace(F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        return self.col.cast("string")

    def dtype(self) -> Column:
        if self.t == "term":  # a literal that states no datatype is a string
            return F.coalesce(self.col["dt"], F.when((self.col["kind"] == LITERAL) & self.col["lang"].isNull(), F.lit(XSD.string)))
        if self.t == "num":
            return F.when(self.rank == 0, F.lit(XSD.integer)).when(self.rank == 1, F.lit(XSD.decimal)).when(self.rank == 2, F.lit(XSD.double))
        return F.when(self.bound(), F.lit(self.dt)) if self.t == "native" else null("string")

    def lang(self) -> Column:
        return self.col["lang"] if self.t == "term" else null("string")

    def dir(self) -> Column:
        return self.col["dir"] if self.t == "term" else null("string")

    def id(self) -> Column:
        if self.const is not None:
            return F.lit(self.const.id)
        if self.t == "term":
            return self.col["id"]
        if self.t == "iri":
            return F.concat(F.lit(f"<{self.prefix}"), self.col.cast("string"), F.lit(">"))
        return literal_id(self.lex(), self.dt if self.t == "native" else self.dtype())

    def term(self) -> Column:
        if self.const is not None:
            return lit_term(self.const)
        if self.t == "term":
            return self.col
        if self.t == "iri":
            return iri_term(self.lex())
        return literal_term(self.lex(), self.dt if self.t == "native" else self.dtype())

    # readings
    def num(self) -> Column:
        if self.is_number:
            return self.col.cast("double")
        if self.is_term:
            lex, dt = self.lex(), self.dtype()
            special = F.when(lex == "INF", F.lit(float("inf"))).when(lex == "-INF", F.lit(float("-inf"))).when(lex == "NaN", F.lit(float("nan")))
            return F.when(dt.isin(*NUMERIC_TYPES), F.when(lex.rlike(_NUMERIC_FORM), lex.try_cast("double")).otherwise(F.when(dt.isin(XSD.double, XSD.float), special)))
        return null("double")

    def number_rank(self) -> Column:
        if self.t == "num":
            return self.rank
        if self.t == "native":
            return F.lit(0 if self.is_integer else 1 if self.dt == XSD.decimal else 2)
        dt = self.dtype()
        return F.when(dt.isin(*INTEGER_TYPES), F.lit(0)).when(dt == XSD.decimal, F.lit(1)).otherwise(F.lit(2))

    def ts(self) -> Column:
        """The instant of a date or dateTime; without a zone it is UTC."""
        if self.t == "native":
            return self.col.cast("timestamp") if self.dt in (XSD.dateTime, XSD.date) else null("timestamp")
        if self.is_term:
            return F.when(self.dtype().isin(XSD.dateTime, XSD.date), _instant(self.lex()))
        return null("timestamp")

    def text(self) -> Column:
        """The string of a literal or an IRI."""
        return F.when(self.col["kind"] != BNODE, self.col["lex"]) if self.t == "term" else self.lex()

    def ebv(self) -> Column:
        """Effective boolean value; NULL where there is none."""
        if self.t == "native":
            if self.dt == XSD.boolean:
                return self.col
            if self.is_number:
                return (self.col != 0) & ~F.isnan(self.col.cast("double"))
            return self.col != "" if self.dt == XSD.string else null("boolean")
        if self.t == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.t == "iri":
            return null("boolean")
        dt, lex, n = self.dtype(), self.lex(), self.num()
        return F.when(dt == XSD.boolean, lex.isin("true", "1")).when(dt == XSD.string, lex != "").when(dt.isin(*NUMERIC_TYPES), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))

    def order(self) -> list[Column]:
        """Columns that sort values: unbound, blank nodes, IRIs, literals (numbers, instants, the rest), triple terms."""
        if self.t == "native":
            return [self.col]
        if self.t == "num":
            return [self.col]
        if self.t == "iri":
            return [self.lex()]
        n, ts = self.num(), self.ts()
        return [self.kind(), F.when(n.isNotNull(), F.lit(0)).when(ts.isNotNull(), F.lit(1)).otherwise(F.lit(2)), n, ts, self.id()]

    def out(self) -> Column:
        """The column of a result: native types, IRIs as strings, numbers as doubles, else term structs."""
        return self.lex() if self.t == "iri" else self.term() if self.t == "id" else self.col


class IdVal(Val):
    """A term by its id alone; each part is read from the id where it is needed."""

    def __init__(self, id: Column):
        super().__init__("id", id)

    def kind(self) -> Column:
        return id_kind(self.col)

    def lex(self) -> Column:
        return id_lex(self.col)

    def dtype(self) -> Column:
        return id_dt(self.col)

    def lang(self) -> Column:
        return id_lang(self.col)

    def dir(self) -> Column:
        return id_dir(self.col)

    def id(self) -> Column:
        return self.col

    def term(self) -> Column:
        return term_of_id(self.col)

    def text(self) -> Column:
        return F.when(self.kind() != BNODE, self.lex())


def val_of(t: str, col: Column, dt: str | None = None, prefix: str = "", rank: Column | None = None) -> Val:
    return IdVal(col) if t == "id" else Val(t, col, dt, prefix, rank=rank)


def constant(t: Term) -> Val:
    """A constant in its native type, if it has one."""
    if t.kind == IRI:
        return Val("iri", F.lit(t.lex), const=t)
    if t.kind == LITERAL and not t.lang:
        try:
            if t.dt in INTEGER_TYPES and -(2**63) <= int(t.lex) < 2**63:
                return Val("native", F.lit(int(t.lex)).cast("bigint"), t.dt, const=t)
            if t.dt in (XSD.double, XSD.float, XSD.decimal):
                return Val("native", F.lit(float(t.lex.replace("INF", "inf"))), t.dt, const=t)
        except ValueError:
            pass
        if t.dt == XSD.string:
            return Val("native", F.lit(t.lex), t.dt, const=t)
        if t.dt == XSD.boolean and t.lex in ("true", "false", "1", "0"):
            return Val("native", F.lit(t.lex in ("true", "1")), t.dt, const=t)
    return Val("term", lit_term(t), const=t)


def boolean(c: Column) -> Val:
    return Val("native", c, XSD.boolean)


def string(c: Column) -> Val:
    return Val("native", c, XSD.string)


def integer(c: Column) -> Val:
    return Val("native", c.cast("bigint"), XSD.integer)


def as_string(v: Val) -> bool:
    return v.t == "native" and v.dt == XSD.string


def equal(a: Val, b: Val) -> Column:
    """Value equality: numbers by value, instants by time, other literals by text and language, the rest by identity."""
    if a.is_number and b.is_number:
        return (a.col == b.col) & ~F.isnan(a.num())
    if a.t == b.t == "native" and a.dt == b.dt:
        return a.col == b.col
    if a.t == b.t == "iri":
        return same(a, b)
    if "iri" in (a.t, b.t) and "native" in (a.t, b.t) or "iri" in (a.t, b.t) and "num" in (a.t, b.t):
        return F.when(a.bound() & b.bound(), F.lit(False))
    if as_string(a) and a.const is not None and b.is_term or as_string(b) and b.const is not None and a.is_term:
        x, c = (b, a) if a.const is not None and as_string(a) else (a, b)
        return F.when(x.bound(), (x.kind() == LITERAL) & (x.lex() == c.lex()) & x.lang().isNull())
    na, nb, ta, tb = a.num(), b.num(), a.ts(), b.ts()
    plain = (a.kind() == b.kind()) & (a.lex() == b.lex()) & a.lang().eqNullSafe(b.lang()) & F.when(a.kind() == LITERAL, na.isNull() == nb.isNull()).otherwise(F.lit(True))
    return F.when(a.bound() & b.bound(), F.when(na.isNotNull() & nb.isNotNull(), (na == nb) & ~F.isnan(na)).when(ta.isNotNull() & tb.isNotNull(), ta == tb).otherwise(plain))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def equal_keys(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Texts that are the same wherever ``equal`` is true of two values, if not only there; None where no text is sure to be.

    Two numbers are equal by value and other literals by text or instant, so the key of a text that states an instant is the instant.
    """
    if {XSD.dateTime, XSD.date} & {a.dt, b.dt}:  # an instant's text depends on the zone
        return (a.col.cast("string"), b.col.cast("string")) if a.t == b.t == "native" and a.dt == b.dt else None

    def key(v: Val) -> Column:
        text = let(v.lex(), lambda lex: F.coalesce(F.concat(F.lit("t"), F.unix_micros(_instant(lex)).cast("string")), F.concat(F.lit("x"), lex)))
        return F.when(v.bound(), F.coalesce(F.concat(F.lit("n"), (v.num() + F.lit(0.0)).cast("string")), text))  # -0.0 + 0.0 is 0.0

    return tuple(let(v.term(), lambda t: key(Val("term", t))) if v.is_term else key(v) for v in (a, b))


def less(a: Val, b: Val, strict: bool = True) -> Column:
    """a < b (or <=) of numbers, instants, booleans and texts; NULL between values without an order."""
    op = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    if a.is_number and b.is_number or a.t == b.t == "native" and a.dt == b.dt:
        return op(a.col, b.col)
    if a.is_number or b.is_number:
        return op(a.num(), b.num())
    if {XSD.dateTime, XSD.date} & {a.dt, b.dt}:
        return op(a.ts(), b.ts())
    na, nb, ta, tb = a.num(), b.num(), a.ts(), b.ts()
    literals = (a.kind() == LITERAL) & (b.kind() == LITERAL) & na.isNull() & nb.isNull()
    return F.when(na.isNotNull() & nb.isNotNull(), op(na, nb)).when(ta.isNotNull() & tb.isNotNull(), op(ta, tb)).when(literals, op(a.lex(), b.lex()))


def same(a: Val, b: Val) -> Column:
    """Identity of terms, on native keys where that is possible."""
    if a.t == b.t == "iri":
        if a.prefix == b.prefix:
            return a.col == b.col
        for x, y in ((a, b), (b, a)):
            if not x.prefix and x.const is not None and y.prefix:
                lex = x.const.lex
                return y.col.cast("string") == F.lit(lex[len(y.prefix) :]) if lex.startswith(y.prefix) else F.when(y.bound(), F.lit(False))
            if not x.prefix and y.prefix:
                return F.when(x.col.startswith(y.prefix), F.substr(x.col, F.lit(len(y.prefix) + 1))) == y.col.cast("string")
        if not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix):
            return F.when(a.bound() & b.bound(), F.lit(False))
        return a.lex() == b.lex()
    if a.t == b.t == "native" and a.dt == b.dt:
        return a.col == b.col
    if a.t == "native" and b.t == "native" or {a.t, b.t} == {"iri", "native"}:
        return F.when(a.bound() & b.bound(), F.lit(False))
    return a.id() == b.id()


def merge(a: Val, b: Val) -> tuple[Val, Val]:
    """Two values in one representation, for the same column."""
    if a.t == b.t and a.dt == b.dt and a.prefix == b.prefix and a.t != "num":
        return a, b
    if a.t == b.t == "iri":
        return Val("iri", a.lex()), Val("iri", b.lex())
    return IdVal(a.id()), IdVal(b.id())


__all__ = ["Val", "constant", "equal", "equal_keys", "less", "same", "merge", "boolean", "string", "integer", "escaped", "make_term"]
