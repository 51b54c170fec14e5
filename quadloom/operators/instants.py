"""Time literals in mixed notations and zones as UTC instants.

Each literal gets every reading that its form allows: the orders of day and month, the units that a bare number may count
in, a bare number as a year or month. How the sources write is estimated by expectation-maximisation over mixtures of
notations, one mixture per source: a literal spreads its weight over its readings by their posterior, and the weights
make the next mixture. A reading is as likely as its notation is common in the source and as its year is common among
the literals that have one year only; a notation under which the literal is an impossible date is a slip, and thus
unlikely; a declared order of day and month is a strong prior. Posteriors choose the reading, and a literal none of whose
instants is nearly certain is marked, with its rivals.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging

MICRO = 1_000_000
#: Posterior from which an instant counts as certain; likelihood of an impossible date; prior odds against the order that isn't declared.
CERTAIN, SLIP, CONTRARY = 0.99, 1e-3, 1e-9
_EPOCH = dt.datetime(1970, 1, 1)
_LEAST, _MOST = -62_135_596_800 * MICRO, 253_402_300_800 * MICRO - 1  # the years 1 to 9999
_MONTHS = {m: i % 12 + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
_MONTHS |= {m[:3]: i for m, i in _MONTHS.items()} | {"sept": 9}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_CLOCK = (
    r"(?:(?P<hour>[0-9]{1,2}):(?P<minute>[0-9][0-9])(?::(?P<second>[0-9][0-9])(?:[.,](?P<fraction>[0-9]+))?)?(?:\s?(?P<half>[apAP])\.?[mM]\.?(?![A-Za-z]))?)"
)
_ZONE = r"(?:\s*(?P<zone>[Zz]|(?P<sign>[+-])(?P<oh>[0-9][0-9])(?::?(?P<om>[0-9][0-9]))?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+|[A-Z]{2,5}))?(?:\s*\[(?P<region>[A-Za-z0-9_/+-]+)\])?"
_WEEKDAY = r"(?:(?P<weekday>[A-Za-z]{3,9})\.?,?\s+)?"
#: Notations by name; those of one list differ in what the order of two numbers means.
_NOTATIONS = [
    (("iso",), re.compile(rf"(?P<y>[0-9]{{4}})(?P<sep>[-/.])(?P<m>[0-9]{{1,2}})(?P=sep)(?P<d>[0-9]{{1,2}})(?:(?:[Tt]|,?\s+){_CLOCK})?{_ZONE}")),
    (("basic",), re.compile(rf"(?P<y>[0-9]{{4}})(?P<m>[0-9][0-9])(?P<d>[0-9][0-9])(?:(?:[Tt]|\s+)(?P<hour>[0-9][0-9]):?(?P<minute>[0-9][0-9])(?::?(?P<second>[0-9][0-9])(?:[.,](?P<fraction>[0-9]+))?)?)?(?P<half>(?!))?{_ZONE}")),
    (("dmy", "mdy"), re.compile(rf"(?P<a>[0-9]{{1,2}})(?P<sep>[-/.])(?P<b>[0-9]{{1,2}})(?P=sep)(?P<y>[0-9]{{4}})(?:(?:[Tt]|,?\s+){_CLOCK})?{_ZONE}")),
    (("day month",), re.compile(rf"{_WEEKDAY}(?P<d>[0-9]{{1,2}})[-\s]\s*(?P<name>[A-Za-z]{{3,9}})\.?[-\s,]\s*(?P<y>[0-9]{{4}})(?:(?:[Tt]|,?\s+){_CLOCK})?{_ZONE}")),
    (("month day",), re.compile(rf"{_WEEKDAY}(?P<name>[A-Za-z]{{3,9}})\.?\s+(?P<d>[0-9]{{1,2}}),?\s+(?P<y>[0-9]{{4}})(?:(?:[Tt]|,?\s+){_CLOCK})?{_ZONE}")),
]
_BLANKS = " \t\n\r\f\v\x85\xa0    　﻿" + "".join(map(chr, range(0x2000, 0x200C)))


@functools.lru_cache(4096)
def _region(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


@functools.lru_cache(4096)
def _abbreviations(name: str) -> dict[str, int]:
    """Seconds east of UTC that the zone's own abbreviations mean, the latest meaning first."""
    zone, found = _region(name), {}
    if zone:
        for year in range(2037, 1969, -1):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 2, 12, tzinfo=zone)
                found.setdefault((t.tzname() or "").upper(), int(t.utcoffset().total_seconds()))
    return found


def _micros(t: dt.datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * MICRO + d.microseconds


def _wall_offsets(t: dt.datetime, zone: zoneinfo.ZoneInfo) -> tuple[int, int]:
    return tuple(int(t.replace(tzinfo=zone, fold=f).utcoffset().total_seconds()) for f in (0, 1))


def _first_of_day(t: dt.datetime, zone: zoneinfo.ZoneInfo) -> int:
    """The first instant of the day that begins at t in its zone: midnight, the earlier one of two, or what follows it."""
    before, after = _wall_offsets(t, zone)
    if before >= after:
        return _micros(t) - before * MICRO
    lo, hi = _micros(t) - after * MICRO, _micros(t) - before * MICRO  # midnight is skipped: the change lies between these
    at = lambda us: int((_EPOCH + dt.timedelta(microseconds=us)).replace(tzinfo=dt.timezone.utc).astimezone(zone).utcoffset().total_seconds())
    lo, hi = lo // MICRO - 1, hi // MICRO
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if at(mid * MICRO) >= after else (mid, hi)
    return hi * MICRO


def _instant(year: int, month: int, day: int, m: dict, zone_name: str | None) -> int | None:
    hour, minute, second = m["hour"], int(m["minute"] or 0), int(m["second"] or 0)
    h = int(hour or 0)
    if m["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (m["half"] in "pP")
    end = hour is not None and h == 24 and minute == second == 0 and not (m["fraction"] or "").strip("0") and not m["half"]
    try:
        t = dt.datetime(year, month, day, 0 if end else h, minute, second, int(((m["fraction"] or "") + "000000")[:6]))
        t += dt.timedelta(days=end)
    except (ValueError, OverflowError):
        return None
    if m["weekday"]:
        w = m["weekday"].lower()
        if not any(w in (d, d[:3]) or len(w) > 3 and d.startswith(w) for d in _DAYS):
            return None
        if not _DAYS[dt.date(year, month, day).weekday()].startswith(w):
            return None
    zone, region = m["zone"], m["region"]
    if m["sign"]:
        offset = int(m["oh"]) * 60 + int(m["om"] or 0)
        if int(m["om"] or 0) > 59 or offset > 14 * 60 or (region and not _region(region)):
            return None
        return _micros(t) - (offset if m["sign"] == "+" else -offset) * 60 * MICRO
    if zone and (zone in "Zz" or zone.upper() in ("UTC", "GMT", "UT")):
        return _micros(t)
    if zone and "/" not in zone:
        here = _abbreviations(zone_name) if zone_name else {}
        if zone.upper() not in here:
            return None
        wall = t.replace(tzinfo=_region(zone_name))
        for fold in (0, 1):
            if wall.replace(fold=fold).tzname() == zone.upper():
                return _micros(t) - int(wall.replace(fold=fold).utcoffset().total_seconds()) * MICRO
        return _micros(t) - here[zone.upper()] * MICRO
    place = _region(region or zone or zone_name or "")
    if place is None:
        return None
    if hour is None:
        return _first_of_day(t, place)
    before, after = _wall_offsets(t, place)
    return _micros(t) - before * MICRO if before == after else None


def readings(lex: str | None, zone_name: str | None) -> dict[str, tuple[int | None, int]]:
    """(instant, year) of a literal by each notation it can be read in; instants in microseconds since 1970 UTC.

    ``zone_name`` is the zone of wall times without one. The instant is None under a notation that reads the literal as
    something else: a whole year or month, or, where another order of day and month gives an instant, an impossible
    date. Empty for NULL, for text that is no time, for days, clock times and offsets that don't
    exist, and for wall times without a single instant.
    """
    s = (lex or "").strip(_BLANKS)
    nothing = dict.fromkeys(("hour", "minute", "second", "fraction", "half", "weekday", "zone", "region", "sign", "oh", "om"))
    if s.isascii() and s.removeprefix("-").isdigit():
        if len(s) == 8 and s[0] != "-":
            return _only("date digits", int(s[:4]), _instant(int(s[:4]), int(s[4:6]), int(s[6:]), nothing, zone_name))
        if len(s) == 14 and s[0] != "-":
            clock = nothing | {"hour": s[8:10], "minute": s[10:12], "second": s[12:]}
            return _only("clock digits", int(s[:4]), _instant(int(s[:4]), int(s[4:6]), int(s[6:8]), clock, zone_name))
        return _counts(s)
    for names, form in _NOTATIONS:
        found = form.fullmatch(s)
        if not found:
            continue
        m, year = nothing | found.groupdict(), int(found["y"])
        out: dict[str, int | None] = {}
        for name in names:
            month = _MONTHS.get(m["name"].lower(), 0) if "name" in m else int(m["m"] if "m" in m else m["b" if name == "dmy" else "a"])
            day = int(m["d"] if "d" in m else m["a" if name == "dmy" else "b"])
            out[name] = _instant(year, month, day, m, zone_name)
        return {n: (us, year) for n, us in out.items()} if any(us is not None for us in out.values()) else {}
    return {}


def _only(name: str, year: int, at: int | None) -> dict[str, tuple[int | None, int]]:
    return {} if at is None else {name: (at, year)}


def _counts(s: str) -> dict[str, tuple[int | None, int]]:
    """A bare number as a count of each unit that stays within the years 1 to 9999, and as a year or a month of one."""
    out: dict[str, tuple[int | None, int]] = {}
    if len(s) in (4, 6) and s[0] != "-" and (len(s) == 4 or 1 <= int(s[4:]) <= 12):
        out["year digits" if len(s) == 4 else "month digits"] = (None, int(s[:4]))
    if len(s) <= 20:  # any longer count of microseconds lies beyond the year 9999
        for name, unit in (("seconds", MICRO), ("milliseconds", 1000), ("microseconds", 1)):
            us = int(s) * unit
            if _LEAST <= us <= _MOST:
                out[name] = (us, (_EPOCH + dt.timedelta(microseconds=us)).year)
    return out


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        memo: dict = {}
        found, kinds = [], []
        for at in zip(b.pop("_lex"), b.pop("_zone")):
            if at not in memo:
                r = sorted(readings(*at).items())
                same = [x[1][0] for x in r]
                kind = ";".join(f"{n},{year},{same.index(us)},{'slip' if us is None and n in ('dmy', 'mdy') else ''}" for n, (us, year) in r)
                memo[at] = [{"notation": n, "us": us} for n, (us, _) in r], kind
            found.append(memo[at][0])
            kinds.append(memo[at][1])
        b["_readings"], b["_kind"] = found, kinds
        yield b


def year_likelihoods(counts: dict[int, int]) -> np.ndarray:
    """How likely each year from 0 to 9999 is, given how many literals certainly have which: their smoothed histogram."""
    n = np.zeros(10_000)
    for year, count in counts.items():
        n[year] = count
    kernel = 1.0 / (1.0 + np.arange(-9_999, 10_000, dtype=float) ** 2) ** 2
    size = 1 << 15
    smooth = np.fft.irfft(np.fft.rfft(n, size) * np.fft.rfft(kernel, size), size)[9_999:19_999]
    floor = 1e-7
    return np.maximum(smooth, 0) / max(n.sum(), 1.0) + floor


def mixture_posteriors(pdf: pd.DataFrame, years: np.ndarray, rounds: int = 30, prior: float = 0.5) -> pd.DataFrame:
    """One source's posteriors by EM: rows (_g, _order, _kind, n) give (_g, _kind, _p), a posterior for each reading.

    ``_kind`` has each reading's notation, its year, the place of the first reading with the same instant, and whether it is
    a slip. Readings of the same instant share the sum of their posteriors. ``prior`` rows of each notation are assumed, so that no notation that can
    occur gets weight 0.
    """
    orders = set(pdf["_order"])
    unusual = {"mdy"} if orders == {"DMY"} else {"dmy"} if orders == {"MDY"} else set()
    kinds = []
    for kind in pdf["_kind"]:
        parts = [x.split(",") for x in kind.split(";")]
        likely = [years[int(year)] * (SLIP if slip else 1.0) * (CONTRARY if n in unusual else 1.0) for n, year, _, slip in parts]
        kinds.append(([n for n, *_ in parts], likely, [int(i) for _, _, i, _ in parts]))
    weight = {n: prior for names, _, _ in kinds for n in names}
    for _ in range(rounds):
        total = sum(weight.values())
        share = {n: w / total for n, w in weight.items()}
        weight = dict.fromkeys(weight, prior)
        for (names, likely, _), count in zip(kinds, pdf["n"]):
            mass = sum(share[n] * x for n, x in zip(names, likely))
            for n, x in zip(names, likely):
                weight[n] += count * share[n] * x / mass
    posterior = []
    for names, likely, same in kinds:
        mass = [weight[n] * x for n, x in zip(names, likely)]
        by: Counter = Counter()
        for i, x in zip(same, mass):
            by[i] += x / sum(mass)
        posterior.append([by[i] for i in same])
    return pd.DataFrame({"_g": pdf["_g"], "_kind": pdf["_kind"], "_p": posterior})


def normalise_instants(
    df: DataFrame, zones: DataFrame, key: str, source: str, lex: str, zone: str = "tz_name", order: str = "date_order", staging: Staging | None = None
) -> DataFrame:
    """One row per literal: ``key``, ``instant_us``, ``notation``, ``posterior``, ``n_instants``, ``resolved``, ``rivals``.

    ``zones`` has a zone name and an order of day and month (DMY or MDY) per source; several rows of a source count as
    the least. ``posterior`` is that of the likeliest reading's instant, and ``resolved`` whether this is at least CERTAIN
    and the reading an instant; else ``instant_us`` is NULL for what is likeliest no instant, and the likeliest one for what
    is ambiguous. ``n_instants`` is the number of different instants that the form allows: 0 for NULL, empty and unreadable
    literals and wall times that occur twice or never. ``rivals`` are the readings (notation, us, p) of other instants with
    at least 1 - CERTAIN. Repeated keys stay repeated. A NULL source is a source of its own without a zone.

    Literals are read once and staged. The EM sees one row per (source, kind of reading), to which partial counts reduce
    them before the shuffle: notations with their years, of which there are at most some thousands in a source. The years
    that are certain go to the driver, at most 9999 counts. The posteriors are joined back by Spark's own choice of join.
    """
    staging = staging or Staging(df.sparkSession, "instants")
    where = zones.groupBy(F.col(source).alias("_zg")).agg(F.min(F.struct(F.col(zone).alias("z"), F.col(order).alias("o"))).alias("_zo")).where("_zg IS NOT NULL")
    rows = df.select(F.col(key).alias("_key"), F.col(source).alias("_g"), F.col(lex).alias("_lex"))
    rows = rows.join(where, F.col("_g") == F.col("_zg"), "left").select("_key", "_g", "_lex", F.col("_zo.z").alias("_zone"), F.col("_zo.o").alias("_order"))
    key_type = dict(rows.dtypes)["_key"]
    read = staging.cut(rows.mapInPandas(_read_batches, f"_key {key_type}, _g string, _order string, _readings array<struct<notation:string, us:bigint>>, _kind string"))
    kinds = staging.cut(read.where("_kind <> ''").groupBy("_g", "_order", "_kind").agg(F.count(F.lit(1)).alias("n")))
    certain = kinds.where("_kind NOT LIKE '%;%'").groupBy(F.split("_kind", ",")[1].cast("int").alias("year")).agg(F.sum("n").alias("n"))
    years = year_likelihoods({r["year"]: r["n"] for r in certain.where("year BETWEEN 0 AND 9999").collect()})
    fitted = kinds.groupBy("_g").applyInPandas(lambda pdf: mixture_posteriors(pdf, years), "_g string, _kind string, _p array<double>")
    fitted = fitted.select(F.col("_g").alias("_fg"), F.col("_kind").alias("_fk"), "_p")
    joined = read.join(fitted, F.col("_g").eqNullSafe(F.col("_fg")) & (F.col("_kind") == F.col("_fk")), "left")
    scored = F.zip_with("_p", "_readings", lambda p, r: F.struct(p.alias("p"), r["notation"].alias("notation"), r["us"].alias("us")))
    joined = joined.select("_key", "_readings", scored.alias("_s")).withColumn("_b", F.array_max("_s"))
    n = F.size(F.array_distinct(F.filter(F.transform("_readings", lambda r: r["us"]), lambda us: us.isNotNull())))
    rivals = F.filter("_s", lambda x: (x["p"] >= 1 - CERTAIN) & ~x["us"].eqNullSafe(F.col("_b.us")))
    return joined.select(
        F.col("_key").alias(key), F.col("_b.us").alias("instant_us"), F.col("_b.notation").alias("notation"), F.col("_b.p").alias("posterior"),
        n.alias("n_instants"), F.coalesce((F.col("_b.p") >= CERTAIN) & F.col("_b.us").isNotNull(), F.lit(False)).alias("resolved"), rivals.alias("rivals"),
    )
