import collections
import datetime as dt
import random
import zoneinfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadloom.functions.terms import TERM_DDL
from quadloom.operators.frequency import compress, distinct_profile, modes, percentiles, top_values
from quadloom.operators.instants import mixture_posteriors, normalise_instants, readings, year_likelihoods
from quadloom.operators.wide import Attribute, attributes_to_wide, with_whole_number, xsd_boolean, xsd_calendar_date
from quadloom.plans.prefix import running_sum
from quadloom.plans.staging import Staging


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# value frequency compression
def test_profile(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}" if r.random() < 0.9 else None, r.choice(["a", "b", "c", None]), r.choice(["x", "y"]), 1) for _ in range(800)]
    df = frame(spark, rows, "p string, s string, o string, _n int")
    got = {x.p: tuple(x)[1:] for x in distinct_profile(df, "p", {"s": "ns", "o": "no"}).collect()}
    want = {}
    for k in {p for p, *_ in rows if p}:
        mine = [(s, o) for p, s, o, _ in rows if p == k and s is not None]
        want[k] = (len(mine), len(set(mine)), len({s for s, _ in mine}), len({o for _, o in mine}))
    assert got == want
    assert distinct_profile(df.limit(0), "p", {"s": "ns"}).count() == 0
    assert compress(df, "p", ["s"]).agg(F.sum("_n")).first()[0] == 800


def test_modes_percentiles_top(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("a", 2), ("a", 1), ("a", 9), ("b", None), (None, 3), ("c", 5)], "k string, v int")
    assert {x.k: (x["mode"], x.mode_rows) for x in modes(df, "k", "v").collect()} == {"a": (1, 2), "c": (5, 1)}
    assert {x.k: (x.p0, x.p50, x.p100) for x in percentiles(df, "k", "v", [0, 0.5, 1]).collect()} == {"a": (1, 2, 9), "c": (5, 5, 5)}
    assert sorted((x.k, x.v, x.rank) for x in top_values(df, "k", "v", 2).collect()) == [("a", 1, 1), ("a", 2, 2), ("c", 5, 1)]
    r = random.Random(2)
    many = [("h", r.randrange(40)) for _ in range(500)]
    vs = sorted(v for _, v in many)
    assert percentiles(frame(spark, many, "k string, v int"), "k", "v", [0.9]).first()["p90"] == vs[449]


def test_running_sum(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(10) if i % 7 else None) for i in range(300)]
    got = {x.i: x["sum"] for x in running_sum(frame(spark, rows, "k string, i int, w int"), ["k"], ["i"], "w", "sum", Staging(spark, "test")).collect()}
    total = collections.Counter()
    for k, i, w in rows:
        total[k] += w or 0
        assert got[i] == total[k]
    assert running_sum(frame(spark, [], "k string, i int, w int"), ["k"], ["i"], "w", "sum", Staging(spark, "test")).count() == 0


# wide tables
NUMERALS = [("12", 0, 12), ("+118", 0, 118), ("00084", 0, 84), ("29.00", 0, 29), ("29.5", 0, None), ("1.1589e4", 0, 11589), ("1.5e0", 0, None), ("870E-2", 2, 870), ("5.94", 2, 594), ("5.945", 2, None), ("-3", 0, -3), ("-0.0", 0, 0), (".5e1", 0, 5),
            ("5.", 0, 5), ("1e400", 0, None), ("0e999999999999", 0, 0), ("9223372036854775807", 0, 2**63 - 1), ("9223372036854775808", 0, None), ("1_000", 0, None), ("1,71", 0, None), ("0x10", 0, None), ("INF", 0, None), ("", 0, None), ("١", 0, None),
            ("1000000000000000000000000000000e-30", 0, 1), ("1e-5", 0, None), ("100e-2", 0, 1), (None, 0, None), ("1" + "0" * 3000 + "e-3000", 0, 1)]


def test_whole_numbers(spark):
    df = frame(spark, [(i, t, s) for i, (t, s, _) in enumerate(NUMERALS)], "i int, t string, s int")
    got = {r.i: r.v for r in with_whole_number(df, "t", F.col("s"), "v").collect()}
    assert [(t and t[:40], got[i]) for i, (t, _, _) in enumerate(NUMERALS)] == [(t and t[:40], v) for t, _, v in NUMERALS]


def test_dates_and_booleans(spark):
    rows = [("2020-02-29", "2020-02-29"), ("2021-02-29", None), ("2020-01-01Z", "2020-01-01"), ("2020-01-01+14:00", "2020-01-01"), ("2020-01-01+14:01", None), ("2020-01-01T23:59:59.5-08:00", "2020-01-01"), ("2020-01-01T24:00:00", "2020-01-01"),
            ("2020-01-01T25:00:00", None), ("2020-01-01T10:00", None), ("2020-01", None), ("0000-01-01", None), ("2020-1-1", None), (None, None), ("", None)]
    got = [r.d for r in frame(spark, [(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(xsd_calendar_date(F.col("t")).alias("d")).collect()]
    assert got == [w for _, w in rows]
    bools = [("true", 1), ("0", 0), ("TRUE", None), ("", None), (None, None)]
    assert [r.b for r in frame(spark, [(i, t) for i, (t, _) in enumerate(bools)], "i int, t string").orderBy("i").select(xsd_boolean(F.col("t")).alias("b")).collect()] == [w for _, w in bools]


def test_wide(spark):
    attrs = [Attribute("n", "bigint", "number", F.lit(True)), Attribute("name", "string", "text", F.col("kind") == 2), Attribute("kinds", "bigint", "text", F.lit(True), count=True)]
    rows = [("a", "n", " 7 ", 2), ("a", "n", "3", 2), ("a", "n", "x", 2), ("a", "name", "z", 1), ("a", "name", "y", 2), ("a", "kinds", "p", 1), ("a", "kinds", "p", 1), ("a", "kinds", "q", 1), ("c", "n", "1", 2), (None, "n", "1", 2), ("b", "n", None, 2), ("b", "name", "  ", 2)]
    df = frame(spark, rows, "e string, at string, lex string, kind int").withColumn("_pos", F.lit("clash"))
    entities = frame(spark, [("a",), ("a",), ("b",), (None,)], "e string")
    at = F.when(F.col("at") == "n", 0).when(F.col("at") == "name", 1).when(F.col("at") == "kinds", 2)
    got = {r.out: tuple(r)[1:] for r in attributes_to_wide(df, entities, "e", "lex", at, attrs, "out").collect()}
    assert got == {"a": (3, "y", 2), "b": (None, None, 0)}
    assert attributes_to_wide(df.limit(0), entities.limit(0), "e", "lex", at, attrs, "out").count() == 0
    assert attributes_to_wide(df.limit(0), entities, "e", "lex", at, attrs, "out").count() == 2


# instants
def us(*a, off=0):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds() - off * 3600) * 1_000_000


BERLIN, NY = "Europe/Berlin", "America/New_York"
TIMES = [
    ("2021-06-01T10:00:00Z", None, us(2021, 6, 1, 10)), (" 2021-06-01t10:00+02:00\n", None, us(2021, 6, 1, 8)), ("2021-06-01 10:00:00,5 -0330", None, us(2021, 6, 1, 13, 30) + 500_000), ("2021-06-01T10:00:00", BERLIN, us(2021, 6, 1, 8)),
    ("2021-06-01T10:00:00", None, None), ("2021-06-01T10:00:00.1234567", BERLIN, us(2021, 6, 1, 8) + 123_456), ("2021-06-01 10:00 CEST", BERLIN, us(2021, 6, 1, 8)), ("2021-06-01 10:00 CET", BERLIN, us(2021, 6, 1, 9)), ("2021-06-01 10:00 EST", BERLIN, None),
    ("2021-06-01 10:00 GMT", None, us(2021, 6, 1, 10)), ("2021-03-28T02:30:00", BERLIN, None), ("2021-10-31T02:30:00", BERLIN, None), ("2021-10-31T02:30:00 CET", BERLIN, us(2021, 10, 31, 1, 30)), ("2021-10-31T02:30:00+02:00", BERLIN, us(2021, 10, 31, 0, 30)),
    ("2021-10-31T02:30:00[Europe/Berlin]", None, None), ("2021-06-01T10:00:00-04:00[America/New_York]", None, us(2021, 6, 1, 14)), ("2021-06-01T10:00 Asia/Tokyo", BERLIN, us(2021, 6, 1, 1)), ("2021-06-01", BERLIN, us(2021, 5, 31, 22)), ("2021-06-01Z", BERLIN, us(2021, 6, 1)),
    ("2018-11-04", "America/Sao_Paulo", us(2018, 11, 4, 3)), ("20210601", "UTC", us(2021, 6, 1)), ("20210601100000", BERLIN, us(2021, 6, 1, 8)), ("20210601T1000Z", None, us(2021, 6, 1, 10)), 
    ("2021-06", "UTC", None), ("Tue, 01 Jun 2021 10:00:00 GMT", None, us(2021, 6, 1, 10)), ("Wed, 01 Jun 2021 10:00:00 GMT", None, None), ("01-JUN-2021 10:00", "UTC", us(2021, 6, 1, 10)),
    ("June 1, 2021 1:05:06 PM", "UTC", us(2021, 6, 1, 13, 5, 6)), ("1 June 2021 12:00 a.m.", "UTC", us(2021, 6, 1)), ("June 1, 2021 13:05 PM", "UTC", None), ("2021-02-30", "UTC", None), ("2021-06-01T25:00:00Z", None, None), ("2021-06-01T10:00:00+25:00", None, None),
    ("2021-06-01T10:00:00+14:00", None, us(2021, 5, 31, 20)), ("2021-06-01T10:00:00+14:30", None, None), ("T10:00:00Z", None, None), ("P1D", None, None), ("yesterday", BERLIN, None), ("", BERLIN, None), (None, BERLIN, None), ("2021-06-01 10:00 Mars/City", None, None),
    ("2021-03-14 02:30:00 EST", NY, us(2021, 3, 14, 7, 30)), ("x" * 100000, BERLIN, None), ("2021/6/1", "UTC", us(2021, 6, 1)),
]


@pytest.mark.parametrize("lex,zone,want", TIMES, ids=[str(t[0])[:40] + str(t[1]) for t in TIMES])
def test_reading(lex, zone, want):
    got = {at for at, _ in readings(lex, zone).values()}
    assert got == (set() if want is None else {want})


@pytest.mark.parametrize("zone", ["America/New_York", "America/St_Johns", "Pacific/Auckland", "Pacific/Apia", "Asia/Tokyo", "Europe/Paris"])
@pytest.mark.parametrize("date", ["2021-06-01", "2021/06/01", "20210601", "25.06.2021", "1 June 2021", "June 1, 2021", "Tue, 01 Jun 2021"])
def test_zone_names_in_every_notation(zone, date):
    day = 25 if date.startswith("25") else 1
    at = lambda *clock: int(dt.datetime(2021, 6, day, *clock, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp()) * 1_000_000
    for clock, want in (("10:05", at(10, 5)), ("10:05:06", at(10, 5, 6)), ("10:05:06.7", at(10, 5, 6) + 700_000), ("1:05 PM", at(13, 5)), ("11:05:06 a.m.", at(11, 5, 6))):
        if date == "20210601" and not clock.startswith("10"):
            continue
        for text in (f"{date} {clock} {zone}", f"{date} {clock}[{zone}]"):
            assert {u for u, _ in readings(text, "UTC").values() if u is not None} == {want}, text


def test_half_day_is_no_zone():
    assert {u for u, _ in readings("June 1, 2021 1:05 PM EST", NY).values()} == {us(2021, 6, 1, 18, 5)}
    assert {u for u, _ in readings("June 1, 2021 1:05am", "UTC").values()} == {us(2021, 6, 1, 1, 5)}


def test_long_fractions():
    assert readings("2020-01-02T03:04:05." + "1234567" * 20 + "Z", None) == {"iso": (us(2020, 1, 2, 3, 4, 5) + 123_456, 2020)}


def test_numeric_order():
    assert readings("02/03/2021", "UTC") == {"dmy": (us(2021, 3, 2), 2021), "mdy": (us(2021, 2, 3), 2021)}
    assert readings("13/12/2020 11:05", "UTC") == {"dmy": (us(2020, 12, 13, 11, 5), 2020), "mdy": (None, 2020)}
    assert readings("33/12/2020", "UTC") == readings("13/13/2020", "UTC") == {}


def test_bare_numbers():
    assert readings("1622541600", None) == {"seconds": (us(2021, 6, 1, 10), 2021), "milliseconds": (1622541600_000, 1970), "microseconds": (1622541600, 1970)}
    assert readings("2021", None)["year digits"] == (None, 2021) and readings("202106", None)["month digits"] == (None, 2021) and "month digits" not in readings("202113", None)
    assert readings("-86400", None)["seconds"] == (-86400_000_000, 1969) and readings("9" * 30, None) == readings("--5", None) == readings("-", None) == {}
    assert set(readings("1622541600123456789", None)) == set() and set(readings("1622541600123456", None)) == {"microseconds"}


def test_every_wall_time_of_a_year():
    zone = zoneinfo.ZoneInfo("America/St_Johns")
    t, seen = dt.datetime(2021, 1, 1), 0
    while t.year == 2021:
        instants = {u.timestamp() for f in (0, 1) if (u := t.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc)).astimezone(zone).replace(tzinfo=None) == t}
        got = readings(t.isoformat(), "America/St_Johns")
        assert {at for at, _ in got.values()} == ({int(i) * 1_000_000 for i in instants} if len(instants) == 1 else set())
        seen += len(instants) != 1
        t += dt.timedelta(minutes=45)
    assert seen > 0


def test_em():
    kinds = ["dmy,2021,0,;mdy,2021,1,slip", "dmy,2021,0,;mdy,2021,1,", "dmy,2020,0,;mdy,2020,0,"]
    pdf = pd.DataFrame({"_g": ["g"] * 3, "_order": [None] * 3, "_kind": kinds, "n": [30, 10, 2]})
    p = mixture_posteriors(pdf, year_likelihoods({2021: 5}))["_p"].tolist()
    assert p[0][0] > 0.999 and p[1][0] > 0.9 and abs(sum(p[1]) - 1) < 1e-9 and p[2] == [1.0, 1.0]
    p = mixture_posteriors(pdf.assign(_order="MDY"), year_likelihoods({2021: 5}))["_p"].tolist()
    assert p[0][1] > 0.999 and p[1][1] > 0.999


def test_years():
    y = year_likelihoods({2015: 70, 2020: 30})
    assert y[2015] > y[2020] > y[2017] > y[1990] > y[1970] > 0 and np.ptp(year_likelihoods({})) == 0


def test_posteriors_turn_readings(spark):
    """Rows that no rule of form decides: the same literals, read by how their source writes."""
    sure = [(f"{d:02}/0{m}/2021 10:00Z", f"0{m}/{d:02}/2021 10:00Z") for d in range(13, 29) for m in range(1, 10)]
    rows = [(i, "eu", a) for i, (a, _) in enumerate(sure)] + [(1000 + i, "us", b) for i, (_, b) in enumerate(sure)] + [(2000, "eu", "03/04/2021 10:00Z"), (2001, "us", "03/04/2021 10:00Z"), (2002, "new", "03/04/2021 10:00Z")]
    rows += [(3000, "eu", "1622541600"), (3001, "eu", "1622541600123"), (3002, "us", "1622541600123456"), (3003, "us", "2021"), (3004, "us", "202106"), (3005, "us", "12345"), (3006, "eu", "978307200"), (3007, "eu", "1E9")]
    df, zones = frame(spark, rows, "id long, g string, lex string"), frame(spark, [], "g string, tz_name string, date_order string")
    got = {r.id: r for r in normalise_instants(df, zones, "id", "g", "lex").collect()}
    assert got[2000].instant_us == us(2021, 4, 3, 10) and got[2001].instant_us == us(2021, 3, 4, 10) and got[2000].resolved and got[2001].resolved
    assert not got[2002].resolved and got[2002].n_instants == 2 and len(got[2002].rivals) == 1 and not got[2000].rivals
    assert all(got[i].resolved and got[i].instant_us == us(2021, 6, 1, 10) + extra for i, extra in ((3000, 0), (3001, 123_000), (3002, 123_456)))
    assert not any(got[i].resolved for i in (3003, 3004, 3005, 3007)) and got[3003].instant_us is None and got[3003].notation == "year digits" and len(got[3005].rivals) == 2
    assert got[3006].notation == "seconds" and not got[3006].resolved and got[3006].rivals[0].notation == "milliseconds"  # 20 years off the others
    # without the other literals nothing tells the years of numbers
    alone = normalise_instants(df.where("id = 3000"), zones, "id", "g", "lex").first()
    assert not alone.resolved and alone.n_instants == 3


def test_normalise(spark):
    rows = [(1, "d", "02/03/2021 10:00Z"), (2, "m", "02/03/2021 10:00Z"), (3, None, "02/03/2021 10:00Z"), (4, None, "13/12/2020 10:00Z"), (5, None, "03/03/2021 10:00Z"), (6, "d", "2021-06-01"), (7, "x", "2021-06-01"), (8, "d", None), (9, "d", "2021-06-01"), (9, "d", "2021-06-01")]
    zones = frame(spark, [("d", "UTC", "DMY", 1), ("d", "UTC", "DMY", 2), ("m", BERLIN, "MDY", 3), (None, "UTC", "DMY", 4)], "g string, tz_name string, date_order string, _key int")
    df = frame(spark, rows, "id long, g string, lex string").withColumn("_zone", F.lit("clash"))
    got = normalise_instants(df, zones, "id", "g", "lex").collect()
    found = sorted((r.id, r.instant_us) for r in got if r.resolved)
    assert found == [(1, us(2021, 3, 2, 10)), (2, us(2021, 2, 3, 10)), (4, us(2020, 12, 13, 10)), (5, us(2021, 3, 3, 10)), (6, us(2021, 6, 1)), (9, us(2021, 6, 1)), (9, us(2021, 6, 1))]
    by = {r.id: r for r in got}
    assert by[3].n_instants == 2 and not by[3].resolved and by[3].posterior < 1 and by[3].notation == "dmy"
    assert by[8].instant_us is None and by[7].n_instants == 0
    assert normalise_instants(df.limit(0), zones.limit(0), "id", "g", "lex").count() == 0


def test_queries_on_odd_quads(spark, tmp_path):
    from quadloom.queries import problems

    t = lambda id, kind=1, lang=None: None if id is None else (id, kind, id.strip('<>"'), None, lang, None, None, None)
    s = problems.SCHEMA
    rows = [("g", t("<f>"), problems.RDF_TYPE, t(f"<{s}Film>")), (None, t("<f>"), s + "votes", t('"7"', 2)), ("h", t("<f>"), s + "votes", t('"5"', 2)), ("h", t("<f>"), None, t('"5"', 2)), ("h", None, s + "votes", t('"5"', 2)), ("h", t("<f>"), s + "votes", None),
            ("h", t("<l>"), problems.RDF_TYPE, t(f'"{s}Film"', 2)), ("h", t("<f>"), problems.RDFS_LABEL, t('"b"', 2, "EN")), ("h", t("<f>"), problems.RDFS_LABEL, t('"a"', 2, "en-gb"))]
    frame(spark, rows, f"g string, s {TERM_DDL}, p string, o {TERM_DDL}").write.parquet(f"{tmp_path}/quads.parquet")
    assert [tuple(r) for r in problems.p2_found(spark, str(tmp_path)).collect()] == [("f", "b", None, 5, None, None, None, 0)]
    got = {r.p: tuple(r)[1:] for r in problems.p1_found(spark, str(tmp_path)).collect()}
    assert got[s + "votes"] == (2, 2, 1, 2) and got[problems.RDF_TYPE] == (2, 2, 2, 2) and None not in got
