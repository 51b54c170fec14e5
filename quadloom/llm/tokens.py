"""Byte-level BPE over a corpus by merge replay.

Every text is split into words once, and kept as numbers of the words of its block of texts. The different words of the
corpus are encoded once each: an inverted index leads from each pair of neighbouring tokens to the words and positions
where it occurs; the merges are applied in rank order, and each one touches only the neighbours of its positions. As merges
never cross words, the index is split by words over the cluster. The ids go back to the blocks, and by vectorised gathering to
the texts: what is shuffled are the different words of a block and numbers, never the occurrences of words as text.

Counts alone, which other operators need, come from batches: a worker replays the words that it hasn't seen.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging

#: Where the vocabulary files of public tokenizers are found unless a path is given.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of words that a worker remembers before it starts anew; bounds its memory, not the result.
REMEMBERED = 5_000_000


class Vocabulary:
    """The ranks of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self._pairs: dict[tuple[int, int], int] = {}

    def merged(self, pair: tuple[int, int]) -> int:
        """The rank of the token that a pair makes, or -1."""
        r = self._pairs.get(pair)
        if r is None:
            r = self._pairs[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return r

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        """The ids of each word, by replaying all merges over all the words at once."""
        ids: list[int] = []
        nxt: list[int] = []
        prev: list[int] = []
        starts: list[int] = []
        done: dict[int, int] = {}
        for n, w in enumerate(words):
            b = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            starts.append(len(ids))
            if whole is not None:  # a word that is a token needs no replay
                done[n] = whole
                continue
            at = len(ids)
            ids.extend(map(self.first.__getitem__, b))
            prev.extend(range(at - 1, at + len(b) - 1))
            nxt.extend(range(at + 1, at + len(b) + 1))
            prev[at], nxt[-1] = -1, -1
        index: dict[int, list[int]] = defaultdict(list)  # the rank of a pair's token: the positions of its left parts
        merged = self.merged
        for i, j in enumerate(nxt):
            if j >= 0:
                r = merged((ids[i], ids[j]))
                if r >= 0:
                    index[r].append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            for i in sorted(index.pop(rank)):
                j = nxt[i]
                # the pair may be gone, or its left part may have been merged away
                if ids[i] < 0 or j < 0 or merged((ids[i], ids[j])) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                k = nxt[i] = nxt[j]
                h = prev[i]
                if k >= 0:
                    prev[k] = i
                for left, right in ((h, i), (i, k)):
                    if left >= 0 and right >= 0:
                        r = merged((ids[left], ids[right]))
                        if r >= 0:
                            if r not in index:
                                heapq.heappush(heap, r)
                            index[r].append(left)
        starts.append(len(ids))
        return [[done[n]] if n in done else [x for x in ids[starts[n] : starts[n + 1]] if x >= 0] for n in range(len(starts) - 1)]


class _Places(dict):
    """Word to place; a word that is asked for the first time gets the next place and waits to be learnt."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at


class Encoder:
    """Encodes batches of texts; remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.place, self.letters = _Places(), 0
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        new = self.vocabulary.encode_words(words)
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.int32, int(size.sum()))
        self.letters += sum(map(len, words))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words of the texts, one after another, and the number of words of each text."""
        if self.letters > REMEMBERED:
            self._reset()
        found = [self.find(t) if t else () for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        return at, counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        at, words = self.places(texts)
        upto = np.concatenate([[0], np.cumsum(self.size[at])])
        ends = np.cumsum(words)
        return upto[ends] - upto[ends - words]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the offsets of the texts in them."""
        at, words = self.places(texts)
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[at] - upto[:-1], size) + np.arange(upto[-1])]
        return flat, upto[np.concatenate([[0], np.cumsum(words)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many characters, at least one row each."""
    sizes, start, total = [len(t) if (t := x.as_py()) else 0 for x in batch.column(column)], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def _split(key: str, characters: int):
    """Texts to the numbers of their words in their block, whose different words stand at its first text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task, n = regex.compile(PATTERN).findall, uuid.uuid4().hex, 0
        for whole in batches:
            for b in _slices(whole, "_text", characters):
                place = _Places()
                found = [find(t) if t else () for t in b.column("_text").to_pylist()]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                at = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int32, int(counts.sum()))
                numbers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(at, pa.int32()))
                words = pa.array([[w.encode("utf-8", "surrogatepass") for w in place.new], *[None] * (len(found) - 1)], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"] * len(found)), b.column("_key"), numbers, words], names=["_block", key, "_at", "_words"])
                n += 1

    return run


def _replay(path: str):
    """Different words to their ids: all words of a partition in one index, or, where they are very many, in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words, size = encoder(path).vocabulary, [], 0

        def encoded() -> pa.RecordBatch:
            ids = vocabulary.encode_words([w.decode("utf-8", "surrogatepass") for w in words])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], names=["_word", "_ids"])

        for b in batches:
            for w in b.column("_word").to_pylist():
                words.append(w)
                size += len(w)
                if size > REMEMBERED:
                    yield encoded()
                    words, size = [], 0
        if words:
            yield encoded()

    return run


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _gather(key: str, ids: str):
    """A block's texts and the ids of its words to the ids of the texts."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        lists = _whole(words.column("_ids")).take(pa.array(np.argsort(words.column("_n").to_numpy())))
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        start, flat = np.cumsum(size) - size, lists.flatten().to_numpy()
        at = _whole(texts.column("_at"))
        place, ends = at.flatten().to_numpy(), np.cumsum(np.diff(at.offsets.to_numpy()))
        sizes = size[place]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        found = flat[np.repeat(start[place] - upto[:-1], sizes) + np.arange(upto[-1])]
        out = pa.ListArray.from_arrays(pa.array(upto[np.concatenate([[0], ends])], pa.int32()), pa.array(found, pa.int32()))
        return pa.Table.from_arrays([texts.column(key), pa.chunked_array([out])], names=[key, ids])

    return run


def encode_corpus(
    df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", ids: str = "ids", block_characters: int = 4_000_000, staging: Staging | None = None
) -> DataFrame:
    """``key`` and the list of token ids of each text, without special tokens; their strings in a text are plain text.

    NULL and empty texts have the empty list. Texts of any length are encoded whole; repeated rows stay. A block has
    about ``block_characters``, or one text. Its texts and words meet in one task, which is what bounds a task's memory; a
    word that stands in every block has a row per block, and no more. ``path`` must be readable on every executor.
    """
    staging = staging or Staging(df.sparkSession, "tokens")
    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    split = staging.cut(rows.mapInArrow(_split(key, block_characters), f"_block string, `{key}` {kind}, _at array<int>, _words array<binary>"))
    words = split.where("_words IS NOT NULL").select("_block", F.posexplode("_words").alias("_n", "_word"))
    encoded = words.select("_word").distinct().mapInArrow(_replay(path), "_word binary, _ids array<int>")
    tables = words.join(encoded, "_word").select(F.col("_block").alias("_of"), "_n", "_ids")
    texts = split.select("_block", key, "_at")
    return texts.groupBy("_block").cogroup(tables.groupBy("_of")).applyInArrow(_gather(key, ids), f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(df: DataFrame, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text) and the number of tokens of each text; 0 for NULL and empty."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for b in _slices(whole, "_text"):
                n = pa.array(e.counts(b.column("_text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, out])

    rows = df.select(*keep, df[text].alias("_text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` bigint"]))
