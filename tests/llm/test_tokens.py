import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from quadloom.llm.tokens import PATTERN, TOKENIZERS, Encoder, Vocabulary, count_tokens, encode_corpus

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")

TEXTS = ["", None, "Hello world", "don't I'LL we've", "  two  spaces\n\n\tand tabs ", "a" * 3000, "<|endoftext|> plain", "日本語テキスト 😀😀👩‍👩‍👧", "x1y22z333", "ééé é", "\n", " ", "naïve café—“quotes”", "0" * 50, "https://example.org/a?b=c&d", "ab" * 5000]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids(spark, reference):
    r = random.Random(6)
    texts = TEXTS + ["".join(r.choice("abc dé\n'1,.漢") for _ in range(r.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, t string, ids string")
    got = {x.id: x.ids for x in encode_corpus(df, "id", "t").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {x.id: x.n_tokens for x in count_tokens(df, "t", keep=["id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.limit(0), "id", "t").count() == 0
    assert dict(encode_corpus(df, "id", "t").dtypes) == {"id": "bigint", "ids": "array<int>"}


def test_round_trip():
    v = Vocabulary(PATH)
    words = ["tokenization", " unbelievable", "zzzzqqqq", "漢字", "a" * 999]
    assert [b"".join(v.token[i] for i in ids).decode() for ids in v.encode_words(words)] == words


def test_forgetting(reference, monkeypatch):
    from quadloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    e = Encoder(Vocabulary(PATH))
    for i in range(30):
        text = f"word{i} other{i * 7} more"
        flat, offsets = e.ids([text, None, text])
        assert flat[offsets[0] : offsets[1]].tolist() == reference.encode_ordinary(text) and offsets[1] == offsets[2]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", None)], "id long, t string, src string")
    assert count_tokens(df, "t").first().asDict() == {"id": 1, "src": None, "n_tokens": 2}
    assert count_tokens(df.withColumn("t", F.lit(None).cast("string")), "t").first()["n_tokens"] == 0
