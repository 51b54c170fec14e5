import random

import pytest

from pyspark.sql import functions as F

from quadloom.llm.quality import STATISTICS, distributions, flag_tails, not_prose, read_texts, sketch_by_language, statistics_of, text_statistics
from quadloom.plans.staging import Staging

WORDS = "the a of to in and was that it is not for on as by with which but there no has been had have be at this".split()
COMMON = frozenset(WORDS)
SENTENCE = "The court held that the lease was void, and there is no ground on which it could have been saved."
PROSE = [
    SENTENCE, f"High Court\nK-2017/0000522\nSmith v. Jones\nDecided 2017-02-08\n(1) {SENTENCE} {SENTENCE}\nPage 1 of 2\n(2) {SENTENCE}", "The court held that the lease was void, and there is\nno ground on which it could have been saved by the party\nwhich had the better of it.",
    f"1\t{SENTENCE}\n2\t{SENTENCE}", f"¶ 1 {SENTENCE} <|endoftext|>", f"████ told the court that it was not there and had no part in the sale of the {'mill'}.",
]
JUNK = [
    "* Tenancies Code, 88.\n* Boundary Fences Ordinance, 126;\n* [1996] XSC 439;\n" * 5, "1. Arwid v. Ithsha - K-2013/254 - 14:00 - Room 4\n2. Vell v. Elr - K-2015/5567 - 14:45 - Room 10\n" * 4, "a\tb\t12\t3.5\nc\td\t14\t9.1\n" * 9,
    "kiln      812     90.1\nbarge     77      3.25\n" * 9, "Recipe irregular .......... 39\nCharter defective ......... 268\n" * 5, "a2ad 0a60 aa70 337f\nc16d 4b1f 045e 0548\n" * 8, "dzk wrvexac cximo btvg sdwcs.\nntjdhdt un aujgpcv zqd gt.\n" * 5,
    "it was that it was that it was that it was that it was that.\n" * 6, "Page 1 of 27\nPage 2 of 27\nPage 3 of 27\n" * 9, "– a ladder up to 65,761 crowns,\n– all of the permit, if there is one,\n" * 6, "Was it in writing? [ ] yes  [ ] no\nSigned by: ____________\n" * 7,
    "th#^,_i_ I,~#o^ !r.^ss d'e, 1o1|ass\n" * 5, "barge anchor had not roof to roof for they the that up the so.\nmill for one lease before the did of the was.\n" * 5, "...", "[1]\n[2]\n[3]",
]


NAMES = "mill barge kiln lease will fence deed bond shed ferry dock yard farm gate lock weir anchor boiler ledger orchard".split()


def decision(r):
    """Sentences of different lengths and words."""
    a = lambda: r.choice(NAMES)
    forms = [
        lambda: f"The court held that the {a()} was void, and there is no ground on which it could have been saved by the {a()} or the {a()}.",
        lambda: f"It was not for the {a()} to say, at {r.randrange(1900, 2020)}, which {a()} had been at the {a()} but no other.",
        lambda: f"The {a()} has no {a()} to be had, and it is on this {a()} that the {a()} of the {a()} rests as a matter of fact.",
        lambda: f"There was a {a()} by the {a()} for {r.randrange(10, 99)} days, and which of the two it was that had it is not at issue.",
    ]
    return " ".join(r.choice(forms)() for _ in range(r.randrange(2, 7)))


@pytest.fixture(scope="module")
def judged(spark):
    """For texts among many decisions: their rows of statistics, by number."""

    def run(texts, lang="en", decisions=300, staging=None):
        r = random.Random(5)
        rows = [(10_000 + i, decision(r), lang, "x") for i in range(decisions)] + [(i, t, lang, "x") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "id long, t string, lang string, n_words string")
        return {x.id: x for x in text_statistics(df, "id", "t", "lang", WORDS).collect()}

    return run


def test_prose(judged):
    got = judged(PROSE)
    assert [(t[:30], got[i].sentence_share > 0.5) for i, t in enumerate(PROSE)] == [(t[:30], True) for t in PROSE]
    assert all(x.other_chars <= x.prose_chars for i, x in got.items() if i >= 10_000)


def test_junk(judged):
    got = judged(JUNK)
    assert [(t[:30], got[i].sentence_share < 0.5) for i, t in enumerate(JUNK)] == [(t[:30], True) for t in JUNK]
    assert all(x.other_chars <= x.prose_chars for i, x in got.items() if i >= 10_000)


def test_distributions_decide(spark, judged):
    """The same texts, with and without the sketches of how sentences of the language look."""
    like_sentences = ["Dzk wrvexac cximo btvg sdwcs ntjdhdt un aujgpcv zqd gt qwlk hhgf ppzz vvrt lkjh.", "With on with on with on with on with on with on with on with on with on with on.", "Ax7! b%9 c$3 &d4 e*5 f#6 g@7 h+8 i=9 j~1 k^2 l|3 m<4 n>5 o/6.", "K12 44 901 3 77 1204 55 6 8 19 22 31 4 77 1 90."]
    got = judged(like_sentences)
    assert [got[i].prose_chars for i in range(4)] == [0] * 4
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(like_sentences)], "id long, t string, lang string")
    assert all(x["blocks"][0]["form"] == 1 for x in read_texts(df, "id", "t", "lang", WORDS).collect())


def test_figures():
    s = statistics_of("The lease was void. It\tis 12!", COMMON)
    assert s[0] == 7 and abs(s[1] - 23 / 7) < 1e-9 and s[5] == pytest.approx(4 / 7) and s[3] == pytest.approx(2 / 23) and s[4] == 1.0
    assert statistics_of(None, COMMON)[0] == statistics_of(" \n\t", COMMON)[0] == 0.0 and statistics_of("", COMMON)[1] is None
    assert statistics_of("\u200b\ufeff\n", COMMON)[0] == 0.0 and statistics_of("the " * 200000 + ".", COMMON)[0] == 200001
    assert statistics_of("x\ud800y z.", COMMON)[0] == 2.0
    blocks = statistics_of("Court\nThe mill was not\n- a\n- b", COMMON)[7]
    assert [b[0] for b in blocks] == [1, 4, 2, 2] and sum(b[1] for b in blocks) == 22


def test_captions(judged):
    heads = ["High Court\nK-2017/0000522\nSmith v. Jones"] * 2 + ["Court of Appeal, Western Circuit\nNo. 1\nA. v. B.\nDecided 2017-02-08"]
    got = judged([heads[0], f"{heads[1]}\n{SENTENCE}", f"{heads[2]}\n\n{JUNK[2]}"])
    assert (got[0].prose_chars, got[0].caption_chars, got[0].other_chars) == (0, 0, 35)
    assert got[1].caption_chars == 35 and got[1].other_chars == 0 and got[1].sentence_share == 1.0
    assert got[2].caption_chars == 0 and got[2].other_chars > 0 and got[2].sentence_share == 0.0


def test_found(spark):
    r = random.Random(9)
    rows = [(10_000 + i, decision(r), "en", "x") for i in range(300)] + [(1000 + i, t, "EN", "x") for i, t in enumerate(JUNK)] + [(2000, None, "en", "x"), (2001, "", None, "x"), (2002, "  \n", "de", "x"), (2003, SENTENCE, None, "x"), (2004, JUNK[0], "xx", "x")]
    rows += [(3000, f"{SENTENCE}\n\n{JUNK[2]}{JUNK[2]}", "en", "x"), (3001, f"{decision(r)} {decision(r)} {decision(r)}\n\n{JUNK[2]}", "en", "x"), (3002, SENTENCE, "en", "x"), (3002, SENTENCE, "en", "x")]
    df = spark.createDataFrame(rows, "id long, t string, lang string, n_words string")
    stats = text_statistics(df, "id", "t", "lang", WORDS).cache()
    assert {r.id for r in not_prose(stats, "id").collect()} == {1000 + i for i in range(len(JUNK))} | {2004, 3000}
    flagged = flag_tails(stats).cache()
    one = flagged.where("id = 10005").first()
    assert 0 <= one.n_words_pct <= 1 and abs(one.common_share_z) < 3.5 and one.tails == []
    assert "symbol_ratio" in flagged.where("id = 1011").first().tails
    assert flagged.where("id = 2000").first().n_words_z is None and flagged.count() == len(rows)
    sketches = {r.language: r.n for r in sketch_by_language(stats.where("n_words > 0"), STATISTICS).collect()}
    assert sketches["*"] == sum(n for k, n in sketches.items() if k != "*") == len(rows) - 3
    assert flag_tails(text_statistics(df.limit(0), "id", "t", "lang", WORDS)).count() == 0
    empty = df.where("id BETWEEN 2000 AND 2002")
    assert flag_tails(text_statistics(empty, "id", "t", "lang", WORDS)).count() == 3 and not_prose(text_statistics(empty, "id", "t", "lang", WORDS), "id").count() == 0


@pytest.mark.parametrize("n", [30, 150, 600])
def test_found_where_junk_prevails(spark, n):
    """Tables and lists don't have the form of sentences, so that they don't move what sentences are measured by."""
    r, tables = random.Random(n), [JUNK[i] for i in (0, 1, 2, 3, 4, 5, 8, 9, 10)]
    rows = [(i, decision(r) if i % 5 == 0 else f"{tables[i % len(tables)]}\n[{i}]", "en") for i in range(n)]
    stats = text_statistics(spark.createDataFrame(rows, "id long, t string, lang string"), "id", "t", "lang", WORDS)
    assert {r.id for r in not_prose(stats, "id").collect()} == {i for i in range(n) if i % 5}


def test_quantiles_lean_on_all_languages(spark):
    rows = [("a", float(i % 100)) for i in range(2000)] + [("b", 1000.0)] + [("c", float(i % 50)) for i in range(100)]
    got = {r["_language"]: r["_v"].mid for r in distributions(spark.createDataFrame(rows, "language string, v double"), {"v": 0.1}, Staging(spark, "test")).collect()}
    assert set(got) == {"*", "a", "b", "c"} and abs(got["a"] - got["*"]) < 3
    assert got["b"] == pytest.approx((1000 + 100 * got["*"]) / 101) and abs(got["c"] - (25 + got["*"]) / 2) < 3


def test_percentiles(spark):
    rows = spark.range(1001).select("id", F.lit("en").alias("language"), (F.col("id") + 1.0).alias("n_words"), *[F.lit(0.5).alias(s) for s in STATISTICS if s != "n_words"])
    got = {r.id: r.n_words_pct for r in flag_tails(rows).where("id IN (0, 2, 5, 500, 990, 1000)").collect()}
    assert got[0] <= 0.002 and got[2] <= 0.01 and abs(got[500] - 0.5) <= 0.1 and got[990] >= 0.98 and got[1000] == 1.0


def test_repetition_after_a_fresh_start(judged):
    r = random.Random(2)
    fresh = decision(r)
    got = judged([f"{fresh} {SENTENCE}", f"{fresh} {'With on ' * 400}."])
    assert got[0].sentence_share > 0.5 and got[1].sentence_share < 0.5


def test_very_long_text(judged):
    r = random.Random(3)
    long = " ".join(decision(r) for _ in range(3000))
    got = judged([long, long + "\n" + "a\tb\t12\t3.5\n" * 200_000])
    assert got[0].sentence_share == 1.0 and got[1].sentence_share < 0.5


