"""Solutions as DataFrames: one column per variable, in the representation that is known of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.values import Val, merge, same, val_of


@dataclass(frozen=True)
class Info:
    """What is known of a variable; ``certain`` if it is bound in every solution."""

    t: str
    dt: str | None = None
    prefix: str = ""
    certain: bool = True


def _rank(col: str) -> str:
    return col + "__rank"


class Frame:
    def __init__(self, df: DataFrame, info: dict[str, Info], side: str = "v_"):
        self.df, self.info, self.side = df, info, side

    def col(self, name: str) -> str:
        return self.side + name

    def val(self, name: str) -> Val:
        i = self.info[name]
        c = F.col(f"`{self.col(name)}`")
        return val_of(i.t, c, i.dt, i.prefix, rank=F.col(f"`{_rank(self.col(name))}`") if i.t == "num" else None)

    @staticmethod
    def make(df: DataFrame, vals: dict[str, Val], certain: dict[str, bool] | None = None, keep: list[str] | None = None) -> Frame:
        """The frame of named values over a DataFrame; ``keep`` has other columns to pass on."""
        cols, info = [F.col(k) for k in keep or []], {}
        for n, v in vals.items():
            cols += _columns(f"v_{n}", v)
            info[n] = Info(v.t, v.dt, v.prefix, (certain or {}).get(n, True))
        if not cols:
            cols = [F.lit(1).cast("tinyint").alias("v")]
        return Frame(df.select(*cols), info)

    @staticmethod
    def unit(spark) -> Frame:
        return Frame(spark.range(1).select(F.lit(1).cast("tinyint").alias("v")), {})

    def vals(self) -> dict[str, Val]:
        return {n: self.val(n) for n in self.info}

    def certain(self) -> dict[str, bool]:
        return {n: i.certain for n, i in self.info.items()}

    def where(self, c: Column) -> Frame:
        return Frame(self.df.where(c), self.info, self.side)

    def renamed(self, side: str) -> Frame:
        out = []
        for n, i in self.info.items():
            out.append(F.col(f"`{self.col(n)}`").alias(side + n))
            if i.t == "num":
                out.append(F.col(f"`{_rank(self.col(n))}`").alias(_rank(side + n)))
        return Frame(self.df.select(*(out or [F.lit(1).cast("tinyint").alias(side)])), self.info, side)

    def only(self, names: list[str]) -> Frame:
        return Frame.make(self.df, {n: self.val(n) for n in names if n in self.info}, self.certain())

    def without(self, name: str) -> Frame:
        return self.only([n for n in self.info if n != name])

    def extend(self, name: str, v: Val, certain: bool = False) -> Frame:
        df = self.df.select("*", *_columns(f"v_{name}", v))
        return Frame(df, {**self.info, name: Info(v.t, v.dt, v.prefix, certain)})

    def bound(self, name: str) -> Frame:
        """The solutions that bind a variable."""
        f = self.where(self.val(name).bound())
        return Frame(f.df, {**self.info, name: replace(self.info[name], certain=True)}, self.side)

    def distinct(self) -> Frame:
        return distinct(self)


def _columns(name: str, v: Val) -> list[Column]:
    return [v.col.alias(name)] + ([v.rank.alias(_rank(name))] if v.t == "num" else [])


def key_columns(f: Frame, names: list[str]) -> list[Column]:
    """What identifies the values: native columns, or ids."""
    return [(f.val(n).id() if f.info[n].t in ("term", "num") else f.val(n).col).alias(f"k_{i}") for i, n in enumerate(names)]


def distinct(f: Frame) -> Frame:
    names = list(f.info)
    if not names:
        return Frame(f.df.limit(1), f.info)
    if all(f.info[n].t not in ("term", "num") for n in names):
        return Frame(f.only(names).df.distinct(), f.info)
    keys = key_columns(f, names)
    cols = [c for n in names for c in ([f.col(n)] + ([_rank(f.col(n))] if f.info[n].t == "num" else []))]
    grouped = f.df.select(*keys, *[F.col(f"`{c}`") for c in cols]).groupBy(*[f"k_{i}" for i in range(len(names))])
    return Frame(grouped.agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in cols]).select(*[F.col(f"`{c}`") for c in cols]), f.info)


def unite(frames: list[Frame]) -> Frame:
    """All solutions of several frames; a variable that one of them lacks is unbound there."""
    frames = [f for f in frames if f is not None]
    if len(frames) == 1:
        return frames[0]
    out = frames[0]
    for other in frames[1:]:
        a, b, certain = {}, {}, {}
        for n in dict.fromkeys([*out.info, *other.info]):
            x, y = out.val(n) if n in out.info else None, other.val(n) if n in other.info else None
            if x is not None and y is not None:
                x, y = merge(x, y)
                certain[n] = out.info[n].certain and other.info[n].certain
            elif x is None:
                x, certain[n] = _nothing(y, other, n), False
            else:
                y, certain[n] = _nothing(x, out, n), False
            a[n], b[n] = x, y
        left, right = Frame.make(out.df, a, certain), Frame.make(other.df, b, certain)
        out = Frame(left.df.unionByName(right.df), left.info)
    return out


def _nothing(like: Val, f: Frame, n: str) -> Val:
    kind = f.df.schema[f.col(n)].dataType
    return val_of(like.t, F.lit(None).cast(kind), like.dt, like.prefix, rank=F.lit(None).cast("int") if like.t == "num" else None)


def _narrow(a: Val, b: Val) -> Val:
    order = {"native": 0, "iri": 1, "num": 2, "id": 3, "term": 4}
    if a.t == b.t == "iri":
        return a if len(a.prefix) >= len(b.prefix) else b
    return a if order[a.t] <= order[b.t] else b


def _split(f: Frame, name: str) -> tuple[Frame, Frame]:
    return f.bound(name), f.where(~f.val(name).bound()).without(name)


def join(a: Frame, b: Frame, how: str = "inner", condition: Callable[[Frame], Column] | None = None) -> Frame:
    """Compatible solutions of two frames.

    Variables that both certainly bind make an equi-join. A variable that a side may leave unbound splits that side into
    its bound and unbound solutions, each of which is an equi-join again; an OR in the condition, which Spark could only
    answer by nested loops, remains where the optional side of an outer join may leave a shared variable unbound.
    ``condition`` is given the frame of both sides.
    """
    shared = [n for n in a.info if n in b.info]
    for n in shared:
        if not a.info[n].certain:
            bound, unbound = _split(a, n)
            return unite([join(bound, b, how, condition), join(unbound, b, how, condition)])
        if not b.info[n].certain and how == "inner":
            bound, unbound = _split(b, n)
            return unite([join(a, bound, how, condition), join(a, unbound, how, condition)])
    r = b.renamed("r_")
    on, both = None, {}
    for n in a.info:
        both[n] = a.val(n)
    certain = dict(a.certain())
    for n in b.info:
        if n in shared:
            x, y = a.val(n), r.val(n)
            c = same(x, y)
            if not b.info[n].certain:
                c = c | ~y.bound()
            on = c if on is None else on & c
            both[n] = _narrow(x, y) if how == "inner" and b.info[n].certain else x
        else:
            both[n] = r.val(n)
            certain[n] = b.info[n].certain and how == "inner"
    if how == "left" and condition is not None:
        c = condition(_Both(a, r, both, certain))
        on = c if on is None else on & c
    if on is None:
        df = a.df.crossJoin(r.df) if how == "inner" else a.df.join(r.df, F.lit(True), how)
    else:
        df = a.df.join(r.df, on, how)
    out = Frame.make(df, both, certain)
    if how == "inner" and condition is not None:
        return out.where(condition(out))
    return out


class _Both(Frame):
    """The values of two sides inside a join condition."""

    def __init__(self, a: Frame, r: Frame, vals: dict[str, Val], certain: dict[str, bool]):
        super().__init__(a.df, {n: Info(v.t, v.dt, v.prefix, certain[n]) for n, v in vals.items()})
        self._vals = vals

    def val(self, name: str) -> Val:
        return self._vals[name]


def exists_join(a: Frame, b: Frame, negated: bool, condition: Callable[[Frame], Column] | None = None, minus: bool = False) -> Frame:
    """Solutions of ``a`` that have (or haven't) a compatible one in ``b``: a semi- or anti-join.

    With ``minus``, a compatible solution only counts if it shares a bound variable.
    """
    shared = [n for n in a.info if n in b.info]
    if minus and not shared:
        return a
    for n in shared:
        if not a.info[n].certain and not minus:
            bound, unbound = _split(a, n)
            kept = exists_join(unbound, b, negated, condition)
            kept = kept.extend(n, _nothing(a.val(n), a, n))
            return unite([exists_join(bound, b, negated, condition), kept])
    r = b.renamed("r_") if condition is not None else distinct(b.only(shared)).renamed("r_") if not shared else b.only(shared).renamed("r_")
    on, overlap = None, None
    for n in shared:
        x, y = a.val(n), r.val(n)
        c = same(x, y)
        if minus and not (a.info[n].certain and b.info[n].certain):
            overlap = c if overlap is None else overlap | F.coalesce(c, F.lit(False))
            c = c | ~x.bound() | ~y.bound()
        elif minus:
            overlap = F.lit(True)
        elif not b.info[n].certain:
            c = c | ~y.bound()
        on = c if on is None else on & c
    if minus and not any(a.info[n].certain and b.info[n].certain for n in shared):
        on = on & F.coalesce(overlap, F.lit(False))
    if condition is not None:
        vals = {**{n: r.val(n) for n in b.info}, **a.vals()}
        c = condition(_Both(a, r, vals, dict.fromkeys(vals, False)))
        on = c if on is None else on & c
    df = a.df.join(r.df, F.lit(True) if on is None else on, "left_anti" if negated else "left_semi")
    return Frame(df, a.info)
