import unicodedata

import pytest

from quadloom.llm.lookalike import lookalike_classes, lookalike_pairs, same_form

SAME = [
    ("ａｂｃ１", "abc1"), ("ﬁn oﬃce", "fin office"), ("café", "café"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("mаsk", "mask"), ("Ⅰ", "I"), ("ｶﾞ", "ガ"), ("가", "가"), ("K", "K"), ("e‍́", "é"),
    ("ӧ", "ö"), ("ё", "ë"), ("­s⁠oft", "soft"), ("tab\there", "tab here"), ("ν", "v"), ("ύ", "ύ"), ("ệ", "ệ"), ("ſ", "s"),
]
DIFFERENT = [("A", "a"), ("cafe", "café"), ("ab", "a b"), ("a  b", "a b"), ("a-b", "a b"), ("O", "0"), ("l", "I"), ("ß", "ss"), ("a*", "a"), ("й", "и"), ("x", "y"), ("к", "k")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert same_form(a) == same_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert same_form(a) != same_form(b)


def test_splicing_equals_whole():
    """Normalizing segments gives what normalizing whole texts gives; forms are fixed points."""
    alphabet = "ab ẹ́​ оеaéｆﬁ가ᅡᆨガ゙ü̈ ."
    import random

    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(12)))
        f = same_form(t)
        assert same_form(f) == f
        assert unicodedata.is_normalized("NFC", f), ascii(t)
        assert same_form(unicodedata.normalize("NFD", t)) == f == same_form(unicodedata.normalize("NFC", t)), ascii(t)
    assert same_form(None) is None and same_form("") == "" and len(same_form("é" * 200000)) == 200000


def test_pairs(spark):
    rows = [(1, "café", "fr"), (2, "café", "FR"), (3, "café", "fr﻿"), (4, "café", "de"), (5, None, "fr"), (6, "", "fr"), (7, "x", None), (8, "ｘ", None), (9, "ｘ", ""), (10, "cafe", "fr"), (11, "same", "en"), (12, "same", "en")]
    df = spark.createDataFrame([(*x, "clash", 3) for x in rows], "id long, lex string, lang string, form string, k int")
    got = sorted((x.a, x.b) for x in lookalike_pairs(df, "id", "lex", "lang", "a", "b").collect())
    assert got == [(1, 2), (1, 3), (7, 8)]
    assert lookalike_pairs(df.limit(0), "id", "lex", "lang", "a", "b").count() == 0


def test_hot_text(spark):
    """A text that fills a third of the table meets its rarer spelling only."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot text' WHEN id = 1 THEN 'hot text' ELSE concat('t', id) END AS lex", "'en' AS lang")
    assert lookalike_pairs(df, "id", "lex", "lang", "a", "b").count() == 1000


def test_classes_say_what_pairs_say(spark):
    import collections
    import random

    r = random.Random(12)
    rows = [(i, r.choice(["caf\u00e9", "cafe\u0301", "caf\u00e9\u200b", "x", "\uff58", "same", "", None]), r.choice(["en", "EN", None])) for i in range(300)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "id long, lex string, lang string, form string, own int")
    pairs = [(x.a, x.b) for x in lookalike_pairs(df, "id", "lex", "lang", "a", "b").collect()]
    links = collections.Counter(k for p in pairs for k in p)
    got = {x.id: x for x in lookalike_classes(df, "id", "lex", "lang").collect()}
    assert set(got) == {i for i, t, _ in rows if t} and all(got[i].n_links == links[i] for i in got) and sum(links.values()) > 1000
    assert all(got[a].look_id == got[b].look_id for a, b in pairs) and all(got[i].look_id == min(j for j in got if got[j].look_id == got[i].look_id) for i in got)
    assert lookalike_classes(df.limit(0), "id", "lex", "lang").count() == 0
