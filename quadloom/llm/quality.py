"""Statistics by which natural prose is told from lists, tables, forms and junk.

Each text is read once. Its lines are put together into blocks (wrapped lines belong to one block), and every block gets
statistics of its words, symbols and layout. Per language, mergeable quantile sketches say how those statistics are
distributed over blocks that begin and end like sentences. A block that doesn't, or one of whose robust z-scores lies in a
tail of these distributions, is no sentence; a text of which more than half the characters lie in such blocks is no prose.
The same sketches over whole texts give percentiles, robust z-scores and flagged tails of each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging

#: The statistics of a text, in the order of the columns, and the least scale of their robust z-scores.
STATISTICS = {
    "n_words": 0.1, "mean_word_length": 0.1, "symbol_ratio": 0.02, "digit_ratio": 0.02, "line_end_share": 0.02, "common_share": 0.02, "distinct_share": 0.02, "sentence_share": 0.02
}
#: Those of which a low (or high) value speaks against prose.
LOW, HIGH = ("line_end_share", "common_share", "distinct_share", "sentence_share"), ("symbol_ratio", "digit_ratio", "mean_word_length")
#: The statistics of a block with the least scale of each, and which tails speak against a sentence.
BLOCK_STATISTICS = {"common": 0.03, "distinct": 0.1, "length": 0.15, "symbols": 0.01, "digits": 0.02, "gaps": 0.02, "low_starts": 0.05}
BLOCK_LOW, BLOCK_HIGH = ("common", "distinct", "length"), ("common", "length", "symbols", "digits", "gaps", "low_starts")
#: Robust z-score beyond which a text's or a block's value lies in a tail.
TAIL, BLOCK_TAIL = 3.5, 6.0
#: Words from which a block's values count for the distributions, and at which its z-scores have their full weight:
#: the spread of a mean over n words goes with 1 / sqrt(n).
ENOUGH_WORDS, FULL_WORDS = 12, 24
#: Values that the distribution of all languages counts for in that of each one.
SHRINK = 100
#: Levels of the quantiles that are taken from a sketch, close together at the ends.
LEVELS = (0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 1)
#: Words of a window in which different ones are counted.
WINDOW = 40

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMERALS = b"0123456789"
_LINE = re.compile(r"\r\n|\r|\n")
_GAP = re.compile(r"\t+| {3,}|\.{4,}|(?<![^\s:])_{3,}|\||\[ ?\]")
_MARK = re.compile(r"\s*(?:(?P<list>[*•·‣▪–—-]\s+|\([a-z]{1,4}\)\s+|[a-z]\)\s+)|(?P<number>\(\d+\)|\[\d+\]|\d{1,3}(?:[.)](?=\s)|(?=\t))|¶\s?\d+|§\s?\d+)\s*)")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*\Z")
_FULL_STOP = re.compile(r"[^\W\d_]{3,}[.!?][\"'”’»)\]]*\s+[\"'“‘«(\[]*[A-ZÀ-ÞŒ]")
_NEXT = re.compile(r"[^\W\d_]{4,}[.!?]\s+([^\W\d_])")
_VISIBLE = re.compile("[^\\s­​-‏⁠﻿]")
_FIRST = re.compile(r"[^\W\d_]")
_MARKUP = re.compile(r"(?:\s*<\|\w+\|>)+\Z")


def _has_gap(line: str) -> bool:
    return ("\t" in line or "   " in line or "...." in line or "__" in line or "|" in line or "[" in line) and bool(_GAP.search(line))


def _blocks(lines: list[str]) -> Iterator[str]:
    """Lines that belong together: a wrapped paragraph, or a single line of any other kind.

    A line goes on with the one before if that is long and doesn't end like a sentence, or ends like an abbreviation that
    a lower-case letter or a number follows; never if it has a mark of a list or gaps of a table.
    """
    block: list[str] = []
    last = ""
    for line in lines:
        s = line.strip()
        if not s:
            if block:
                yield " ".join(block)
            block = []
            continue
        mark = _MARK.match(line)
        if block and not mark and not _has_gap(s):
            end = last[-1]
            if (end not in ".!?:;" and len(last) >= 25) or (end in ".!?;" and len(last) >= 40 and (s[0].islower() or s[0].isdigit())):
                block.append(line)
                last = s
                continue
        if block:
            yield " ".join(block)
        block, last = [line], s
    if block:
        yield " ".join(block)


def statistics_of(text: str | None, common: frozenset[str]) -> tuple:
    """The statistics of a text but for its sentence share, and its blocks: words, characters (blanks aside), form (0
    like no sentence, 1 like a sentence) and the block statistics."""
    if not text or not _VISIBLE.search(text):
        return (0.0, None, None, None, None, None, None, [])
    lines = _LINE.split(text)
    kept = [x.rstrip() for x in lines if x and not x.isspace()]
    n = letters = n_common = n_symbols = n_digits = 0
    distinct: set[str] = set()
    blocks = []
    for whole in _blocks(lines):
        words = whole.lower().split()
        size, k = sum(map(len, words)), len(words)
        raw = whole.encode("utf-8", "surrogatepass")
        symbols, digits = len(raw) - len(raw.translate(None, _PUNCTUATION)), len(raw) - len(raw.translate(None, _NUMERALS))
        known = sum(map(common.__contains__, words))
        n, letters, n_common, n_symbols, n_digits = n + k, letters + size, n_common + known, n_symbols + symbols, n_digits + digits
        distinct.update(words)
        mark = _MARK.match(whole)
        body = whole[mark.end() :] if mark else whole
        body = (_MARKUP.sub("", body) if body.rstrip().endswith("|>") else body).strip()
        first = _FIRST.search(body)
        begins = first is not None and (first.group().isupper() or body[0] in "█[_*…")
        form = k >= 3 and begins and not (mark and mark["list"] and k < 8) and bool(_STOP.search(body) or _FULL_STOP.search(body))
        starts = _NEXT.findall(body)
        if k <= WINDOW:
            different = len(set(words)) / k
        else:
            parts = [words[i : i + WINDOW] for i in range(0, k if k % WINDOW >= 10 else k - k % WINDOW, WINDOW)]
            different = sum(len(set(x)) / len(x) for x in parts) / len(parts)
        blocks.append((
            k, size, int(form), known / k, different, size / k, symbols / size, digits / size, len(_GAP.findall(body)) / k if _has_gap(body) else 0.0,
            sum(map(str.islower, starts)) / len(starts) if starts else 0.0,
        ))
    return (float(n), letters / n, n_symbols / letters, n_digits / letters, sum(x[-1] in ".!?…:;\"”»" for x in kept) / len(kept), n_common / n, len(distinct) / n, blocks)


_BLOCK_FIELDS = [("words", pa.int32(), "int"), ("chars", pa.int32(), "int"), ("form", pa.int8(), "tinyint"), *((s, pa.float32(), "float") for s in BLOCK_STATISTICS)]


def _block_lists(blocks: list[list[tuple]]) -> pa.Array:
    """The blocks of many texts as an array of lists of structs."""
    flat = list(zip(*chain.from_iterable(blocks))) or [[]] * len(_BLOCK_FIELDS)
    fields = [pa.field(n, k) for n, k, _ in _BLOCK_FIELDS]
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, blocks))], pa.int32()), structs)


def read_texts(df: DataFrame, key: str, text: str, lang: str, common_words: list[str]) -> DataFrame:
    """``key``, ``language`` (lower case, '' for NULL), the statistics but for ``sentence_share``, and ``blocks`` per text.

    ``common_words`` is a fixed word list. NULL, empty and blank texts have 0 words, NULL ratios and no blocks. Whole texts count.
    """
    words = frozenset(common_words)
    names = [s for s in STATISTICS if s != "sentence_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics_of(t.as_py(), words) for t in b.column("_text")]
            columns = list(zip(*rows)) or [[]] * (len(names) + 1)
            figures = [pa.array(c, pa.float64()) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("language"), *figures, _block_lists(columns[-1])], names=[key, "language", *names, "blocks"])

    rows = df.select(df[key].alias("_key"), F.coalesce(F.lower(F.trim(df[lang])), F.lit("")).alias("language"), df[text].alias("_text"))
    block = ", ".join(f"{n}: {k}" for n, _, k in _BLOCK_FIELDS)
    schema = f"`{key}` {dict(rows.dtypes)['_key']}, language string, {', '.join(f'{n} double' for n in names)}, blocks array<struct<{block}>>"
    return rows.mapInArrow(run, schema)


def sketch_by_language(values: DataFrame, statistics) -> DataFrame:
    """Per language one row with the number of rows and a KLL sketch of every statistic; '*' merges all languages."""
    own = values.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"kll_sketch_agg_double({s})").alias(s) for s in statistics])
    merged = own.agg(F.lit("*").alias("language"), F.sum("n").alias("n"), *[F.expr(f"kll_merge_agg_double({s})").alias(s) for s in statistics])
    return own.unionByName(merged)


def distributions(values: DataFrame, least: dict[str, float], staging: Staging) -> DataFrame:
    """(_language, _<statistic>): the middle, scale and quantiles of each statistic in each language, and in '*', all of them.

    The quantiles of a language are drawn to those of all with the weight of SHRINK values, so that a language with few
    values leans on the others and there is no size from which it is judged in another way.
    """
    sketches = staging.cut(sketch_by_language(values, least))
    steps = f"array({', '.join(f'{x}D' for x in LEVELS)})"
    grid = sketches.where("n > 0").select("language", "n", *[F.expr(f"kll_sketch_get_quantile_double({s}, {steps})").alias(s) for s in least])
    every = grid.where("language = '*'").select(*[F.col(s).alias(f"a_{s}") for s in least])
    own = F.col("n") / (F.col("n") + SHRINK)
    drawn = grid.join(F.broadcast(every)).select(  # one row of all languages
        F.col("language").alias("_language"),
        *[F.when(F.col("language") == "*", F.col(s)).otherwise(F.zip_with(s, f"a_{s}", lambda x, a: own * x + (1 - own) * a)).alias(s) for s in least],
    )
    at = lambda s, q: F.get(F.col(s), F.lit(LEVELS.index(q)))
    return staging.cut(drawn.select(
        "_language", *[F.struct(at(s, 0.5).alias("mid"), F.greatest((at(s, 0.75) - at(s, 0.25)) / 1.349, F.lit(least[s])).alias("scale"), F.col(s).alias("grid")).alias(f"_{s}") for s in least]
    ))


def _with_distribution(rows: DataFrame, known: DataFrame, least: dict[str, float]) -> DataFrame:
    """Join each row to the distributions of its language, or, where it has none, of all.

    The distributions have a row per language, a set that the tags in use bound; Spark broadcasts it by its size.
    """
    every = known.where("_language = '*'").select(*[F.col(f"_{s}").alias(f"_a_{s}") for s in least])
    own = rows.join(known, F.col("language") == F.col("_language"), "left").join(F.broadcast(every), how="left")  # the right side has one row at most
    return own.select(*rows.columns, *[F.coalesce(f"_{s}", f"_a_{s}").alias(f"_{s}") for s in least])


def judge_blocks(texts: DataFrame, staging: Staging) -> DataFrame:
    """Replace ``blocks`` by ``sentence_share``, ``prose_chars``, ``caption_chars`` and ``other_chars``.

    A block is a sentence, or several, if it has the form of one and no statistic in a tail of its language's distribution
    over blocks of that form. Short blocks without gaps that lead up to the first sentence are captions; they count for neither
    side as long as the sentences outweigh them. Texts without words have a NULL share.
    """
    values = texts.select("language", F.explode("blocks").alias("b")).where(f"b.form = 1 AND b.words >= {ENOUGH_WORDS}")
    known = distributions(values.select("language", *[F.col(f"b.{s}").cast("double").alias(s) for s in BLOCK_STATISTICS]), BLOCK_STATISTICS, staging)
    rows = _with_distribution(texts, known, BLOCK_STATISTICS)

    def sentence(b: Column) -> Column:
        widened = F.lit(BLOCK_TAIL) * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(FULL_WORDS)) / b["words"]))
        inside = b["form"] == 1
        for s in BLOCK_STATISTICS:
            off = b[s] - F.col(f"_{s}.mid")
            reach = widened * F.col(f"_{s}.scale")
            if s in BLOCK_LOW:
                inside = inside & (off >= -reach)
            if s in BLOCK_HIGH:
                inside = inside & (off <= reach)
        return F.coalesce(inside, F.lit(False))

    seen = F.transform("blocks", lambda b: F.struct(b["chars"].cast("bigint").alias("chars"), sentence(b).alias("is"), ((b["words"] <= ENOUGH_WORDS) & (b["gaps"] == 0)).alias("short")))
    none = F.lit(0).cast("bigint")
    start = F.struct(none.alias("prose"), none.alias("out"), none.alias("captions"))
    step = lambda t, b: F.struct(
        (t["prose"] + F.when(b["is"], b["chars"]).otherwise(none)).alias("prose"), (t["out"] + F.when(b["is"], none).otherwise(b["chars"])).alias("out"),
        (t["captions"] + F.when(~b["is"] & b["short"] & (t["prose"] == 0), b["chars"]).otherwise(none)).alias("captions"),
    )
    judged = rows.withColumn("_t", F.aggregate(seen, start, step))
    captions = F.when(F.col("_t.captions") <= F.col("_t.prose"), F.col("_t.captions")).otherwise(none)
    judged = judged.select(*[c for c in texts.columns if c != "blocks"], F.col("_t.prose").alias("prose_chars"), captions.alias("caption_chars"), (F.col("_t.out") - captions).alias("other_chars"))
    share = F.when(F.col("n_words") > 0, F.coalesce(F.try_divide("prose_chars", F.col("prose_chars") + F.col("other_chars")), F.lit(0.0)))
    return judged.withColumn("sentence_share", share)


def text_statistics(df: DataFrame, key: str, text: str, lang: str, common_words: list[str], staging: Staging | None = None) -> DataFrame:
    """The statistics of each text as ``read_texts`` and ``judge_blocks`` give them. Texts are read once and staged."""
    staging = staging or Staging(df.sparkSession, "quality")
    return judge_blocks(staging.cut(read_texts(df, key, text, lang, common_words)), staging)


def flag_tails(stats: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Add to each text's statistics ``<statistic>_pct``, its percentile in its language (the greatest of LEVELS whose
    quantile is at most its value), ``<statistic>_z``, its robust z-score by median and interquartile range, and ``tails``,
    the names of the statistics whose value lies in the tail that speaks against prose.

    Texts without words have NULL scores and no tails.
    """
    staging = staging or Staging(stats.sparkSession, "quality")
    known = distributions(stats.where("n_words > 0"), STATISTICS, staging)
    keyed = _with_distribution(stats, known, STATISTICS)
    some = F.col("n_words") > 0
    levels = F.array(*[F.lit(float(x)) for x in LEVELS])
    pct = lambda s: F.get(levels, F.greatest(F.size(F.filter(F.col(f"_{s}.grid"), lambda q: q <= F.col(s))), F.lit(1)) - 1)
    scored = keyed.select(
        *stats.columns, *[F.when(some, pct(s)).alias(f"{s}_pct") for s in STATISTICS],
        *[F.when(some, (F.col(s) - F.col(f"_{s}.mid")) / F.col(f"_{s}.scale")).alias(f"{s}_z") for s in STATISTICS],
    )
    tails = [F.when(F.col(f"{s}_z") < -TAIL, F.lit(s)) for s in LOW] + [F.when(F.col(f"{s}_z") > TAIL, F.lit(s)) for s in HIGH]
    return scored.withColumn("tails", F.array_compact(F.array(*tails)))


def not_prose(stats: DataFrame, key: str) -> DataFrame:
    """The keys of texts of whose characters, captions aside, more than half lie in blocks that are no sentences."""
    return stats.where("other_chars > prose_chars").select(key)
