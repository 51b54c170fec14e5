import random

import pytest

from fractions import Fraction

from quadloom.llm.mixing import exact_shares, mix_sources, parts_of, quotas_of, schedule

WEIGHTS = [{"a": 0.5, "b": 0.5}, {"a": 0.22, "b": 0.25, "c": 0.2, "d": 0.15, "e": 0.1, "f": 0.06}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 1.0}, {"a": 0.3, "b": 0.7, "c": 0.1234}, {"a": 0.99999, "b": 0.00001}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_keeps_within_a_block(weights):
    parts = parts_of(exact_shares(weights))
    period, done = sum(parts.values()), dict.fromkeys(parts, 0)
    slots = list(schedule(parts))
    assert [s for _, _, s in slots] == list(range(period))
    for s, k, slot in slots:
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - parts[x] * (slot + 1) / period) < 1 for x in parts)
    assert done == parts


def within_windows(parts, blocks):
    """Every block is placed after its release and by its deadline: no source is ever a block off its weight."""
    period, seen = sum(parts.values()), dict.fromkeys(parts, 0)
    for s, k, slot in schedule(parts, blocks):
        assert k == seen[s] and k * period // parts[s] <= slot < -(-(k + 1) * period // parts[s])
        seen[s] += 1
    assert seen == blocks


def test_weights_without_a_short_period():
    shares = exact_shares({"a": 1 / 3, "b": 1 / 7, "c": 0.1234567, "d": 1e-6, "e": 1 - 1 / 3 - 1 / 7 - 0.1234567})
    parts = parts_of(shares)
    assert sum(parts.values()) > 10**12 and sum(shares.values()) == 1
    within_windows(parts, {s: max(1, int(20_000 * x)) for s, x in shares.items()})


def test_many_sources():
    r = random.Random(4)
    shares = exact_shares({f"s{i:06}": r.choice([1e-6, 2e-6, 1e-5]) for i in range(99_999)} | {"big": 1.0})
    parts = parts_of(shares)
    within_windows(parts, {s: max(1, int(x * 300_000)) for s, x in shares.items()} | {"big": int(shares["big"] * 300_000)})


def test_shares_are_exact():
    assert exact_shares({"a": 0.02, "b": 0.98, "c": 0.0, "d": None, "e": -1.0, "f": float("nan")}) == {"a": Fraction(1, 50), "b": Fraction(49, 50)}
    assert exact_shares({}) == {} and parts_of(exact_shares({"a": 1e-6, "b": 3e-6})) == {"a": 1, "b": 3}
    weights = {f"s{i}": 1.0 + i / 1000 for i in range(42)}
    parts = parts_of(exact_shares(weights))
    assert all(parts[s] * 1000 == parts["s0"] * (1000 + i) for i, s in enumerate(weights))


def test_quotas():
    shares = exact_shares({"a": 0.5, "b": 0.3, "c": 0.2})
    assert quotas_of(shares, {"a": 1000, "b": 1000, "c": 100}) == {"a": 250, "b": 150, "c": 100}
    assert quotas_of(shares, {"a": 1000, "b": 1000, "c": 100}, 400) == {"a": 200, "b": 120, "c": 80}
    assert quotas_of(shares, {"a": 1000, "b": 1000, "c": 100}, 1300) == {"a": 750, "b": 450, "c": 100}
    assert quotas_of(shares, {"a": 600, "b": 1000, "c": 100}, 1300) == {"a": 600, "b": 600, "c": 100}
    assert quotas_of(shares, {"a": 1, "b": 2, "c": 3}, 1300) == {"a": 1, "b": 2, "c": 3} and quotas_of({}, {}, 10) == {}


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "id long, source string, n long")
    t = spark.createDataFrame(targets, "source string, share double, most int")
    return mix_sources(d, t, "id", "source", "n", "share", "most", **kw)


def test_mix(spark):
    r = random.Random(7)
    docs = [(i, "big" if i % 3 else r.choice(["mid", "small", "small2", None, "unlisted"]), r.randrange(1, 60)) for i in range(1500)]
    mix, report = mixed(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 5), ("absent", 0.1, 9), ("small2", 0.0, 2), ("big", 0.5, 1)], block_tokens=200)
    rows = mix.collect()
    uses = {}
    for x in rows:
        uses.setdefault((x.source, x.id), []).append(x.copy)
    most = {"big": 1, "mid": 3, "small": 5}
    assert {s for s, _ in uses} == set(most)
    for (s, _), copies in uses.items():
        assert sorted(copies) == list(range(1, len(copies) + 1)) and len(copies) <= most[s]
    rep = {x.source: x for x in report.collect()}
    assert set(rep) == {"big", "mid", "small", "absent", "small2"} and rep["absent"].remark == "no documents" and rep["small2"].remark == "not wanted" and rep["absent"].actual_share == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert rep[s].tokens == sum(x.n_tokens for x in rows if x.source == s) and abs(rep[s].actual_share - share) < 0.01
    at_cap = [s for s in most if rep[s].mean_repeats > most[s] - 0.02]
    assert at_cap  # the scarcest source is used up
    # interleaving: at every slot each source has its share of the tokens to within a block and a document
    done, total = dict.fromkeys(most, 0), 0
    for x in sorted(rows, key=lambda x: (x.slot, x.source, x.place)):
        done[x.source] += x.n_tokens
        total += x.n_tokens
        if total > 2000:
            assert all(abs(done[s] - total * w) < 2 * 200 + 60 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))


def test_degenerate(spark):
    mix, report = mixed(spark, [], [("a", 0.5, 1)])
    assert mix.count() == 0 and report.count() == 1
    mix, report = mixed(spark, [(1, "a", 10), (2, "a", None), (None, "a", 5), (3, None, 5), (4, "a", 0)], [("a", None, 1), (None, 0.5, 1)])
    assert mix.count() == 0 and report.count() == 1
    mix, report = mixed(spark, [(1, "a", 10), (1, "a", 10)], [("a", 1.0, 2)])
    assert mix.count() == 4 and report.first()["actual_share"] == 1.0


def test_mix_with_a_small_share(spark):
    docs = [(i, "a", 50) for i in range(40)] + [(100 + i, "b", 50) for i in range(40)]
    mix, shares = mixed(spark, docs, [("a", 1.0, 1), ("b", 1e-5, 1)])
    assert {r.source for r in shares.collect()} == {"a", "b"} and mix.where("source = 'a'").count() == 40


def test_mix_of_a_given_total(spark):
    docs = [(i, "a" if i < 300 else "b" if i < 400 else "c", 20) for i in range(402)]
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3)]
    mix, report = mixed(spark, docs, targets, total_tokens=6000, block_tokens=100)
    rep = {r.source: r for r in report.collect()}
    assert rep["c"].tokens == 120 and rep["c"].remark == "used up" and rep["c"].mean_repeats == 3.0
    assert rep["b"].tokens == 2000 and rep["b"].remark == "used up" and abs(rep["a"].tokens - (6000 - 120 - 2000)) <= 20 and rep["a"].remark is None
    mix, report = mixed(spark, docs, targets, total_tokens=500, block_tokens=100)
    assert {r.source: r.tokens for r in report.collect()} == {"a": 240, "b": 160, "c": 100} or sum(r.tokens for r in report.collect()) <= 560


@pytest.mark.parametrize("most_slots", [10, 100, 1_000_000])
def test_schedule_of_all_slots(spark, most_slots):
    """Weights without a short period: blocks grow with the bound of the schedule, the mix stays."""
    r = random.Random(8)
    docs = [(i, r.choice("abc"), r.randrange(1, 40)) for i in range(900)]
    targets = [("a", 1 / 3, 2), ("b", 1 / 7, 1), ("c", 0.123456789, 2)]
    mix, report = mixed(spark, docs, targets, block_tokens=50, most_slots=most_slots)
    rows, whole = mix.collect(), sum(x for _, x, _ in targets)
    assert len(rows) == sum(x.documents for x in report.collect()) and all(abs(x.actual_share - w / whole) < 0.01 for x in report.collect() for s, w, _ in targets if s == x.source)
    slots = sorted({x.slot for x in rows})
    block = max(50, -(-sum(x.n_tokens for x in rows) // most_slots))
    assert len(slots) <= most_slots + 6 and len(slots) >= sum(x.n_tokens for x in rows) / block / 3
    done, total = dict.fromkeys("abc", 0), 0
    for x in sorted(rows, key=lambda x: (x.slot, x.source, x.place)):
        done[x.source] += x.n_tokens
        total += x.n_tokens
        assert all(abs(done[s] - total * w / whole) < 2 * block + 80 for s, w, _ in targets)
