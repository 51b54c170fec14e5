"""One form for texts that look the same.

The form is that of compatibility normalization (NFKC) over text whose unprintable characters are gone, whose blanks are
plain spaces, and whose letters of other scripts are replaced by the Latin letter of the same shape. A text is scanned once
for unstable segments: runs of characters whose quick check says they may change, with the character before each run as
context for composition. Only these segments are normalized and spliced back; stable text, and every text of plain
ASCII, is passed on as it is.
"""

from __future__ import annotations

import unicodedata
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging

# Letters of other scripts, and Latin letters of other names, with the shape of the letter before the colon.
SHAPES = (
    "A:АΑᎪ B:ВΒᏴ C:СϹᏟ D:Ꭰ E:ЕΕᎬ F:Ϝ G:ԌᏀ H:НΗᎻ I:ІΙӀ J:ЈᎫͿ K:КΚᏦ L:Ꮮ M:МΜϺᎷ N:Ν O:ОΟՕ P:РΡᏢ Q:Ԛ R:Ꭱ S:ЅՏᏚ T:ТΤᎢ U:Ս V:ѴᏙ "
    "W:ԜᎳ X:ХΧ Y:ҮΥУ Z:ΖᏃ a:аαɑ c:сϲ d:ԁ e:е g:ɡց h:һհ i:іιɩ j:јϳ l:ӏ n:ո o:оοօ p:рρ q:ԛգ s:ѕ u:սυ v:ѵν w:ԝ x:хχ y:уүγ "
    "Γ:Г Φ:Ф Π:П κ:к φ:ф"
)
#: Code point of such a letter to its target.
_TO = {ord(other): target for target, _, others in (x.partition(":") for x in SHAPES.split()) for other in others}
#: These letters, and the composed ones that decompose to one of them.
_SHAPED = "".join(c for c in map(chr, range(0x80, 0x3000)) if any(ord(x) in _TO for x in unicodedata.normalize("NFKD", c)))
_SHAPED += "".join(chr(c) for c in _TO if c >= 0x3000)
_VANISHES = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--\p{White_Space}]", regex.V1)
_BLANK = regex.compile(r"\p{White_Space}")
_UNSTABLE = regex.compile(
    r"[\S]?[\p{NFKC_Quick_Check=No}\p{NFKC_Quick_Check=Maybe}\P{ccc=0}\p{Default_Ignorable_Code_Point}\p{Cc}" + _SHAPED + r"[\p{White_Space}--[ ]]]+", regex.V1
)


def _canonical(segment: str) -> str:
    """The canonical form of a segment that starts and ends where composition can't reach beyond it."""
    s = _VANISHES.sub("", unicodedata.normalize("NFKD", _BLANK.sub(" ", _VANISHES.sub("", segment))))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", s.translate(_TO)))


def same_form(text: str | None) -> str | None:
    """The form that texts share that look the same; NULL for NULL. Idempotent."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    return _UNSTABLE.sub(lambda m: _canonical(m.group()), text)


def same_forms(texts: pd.Series) -> pd.Series:
    """As ``same_form`` over a batch; each different text is treated once."""
    memo: dict[str | None, str | None] = {}
    return pd.Series([memo[t] if t in memo else memo.setdefault(t, same_form(t)) for t in texts], dtype=object)


def canonical_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the canonical form of each text column: ``columns`` maps a column to the name of its form. NULL stays NULL."""
    form = F.pandas_udf(same_forms, "string")
    return df.withColumns({new: form(F.col(old)) for old, new in columns.items()})


def _looks(df: DataFrame, key: str, text: str, tag: str, staging: Staging) -> DataFrame:
    """(k, t, form, tag) of the rows with a text, staged; ``tag`` is '' for NULL, else begins with =."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(tag).alias("l")).where("t IS NOT NULL AND t <> ''")
    rows = canonical_text(rows, {"t": "form", "l": "tag"})
    rows = rows.select("k", "t", F.struct("form", F.lower("tag").alias("tag")).alias("look"))
    return staging.cut(rows.select("k", "t", F.col("look.form").alias("form"), F.coalesce(F.concat(F.lit("="), "look.tag"), F.lit("")).alias("tag")))


def lookalike_classes(df: DataFrame, key: str, text: str, tag: str, group: str = "look_id", links: str = "n_links", staging: Staging | None = None) -> DataFrame:
    """One row per row with a text: ``key``, the least key of all rows that look the same, and the number of those that are
    spelt differently. All pairs of ``lookalike_pairs`` follow from it, and it grows with the rows whatever a look holds.

    Rows are counted by look and spelling first, so that a repeated text is one row of what is shuffled further. NULL and
    empty texts have no row; repeated rows stay.
    """
    rows = _looks(df, key, text, tag, staging or Staging(df.sparkSession, "lookalike"))
    spelt = rows.groupBy("form", "tag", "t").agg(F.count(F.lit(1)).alias("own"), F.min("k").alias("k0"))
    whole = spelt.groupBy("form", "tag").agg(F.sum("own").alias("all"), F.min("k0").alias("least"))
    known = spelt.join(whole, ["form", "tag"]).select("form", "tag", "t", "least", (F.col("all") - F.col("own")).alias("other"))
    return rows.join(known, ["form", "tag", "t"]).select(F.col("k").alias(key), F.col("least").alias(group), F.col("other").alias(links))


def lookalike_pairs(df: DataFrame, key: str, text: str, tag: str, a: str, b: str, staging: Staging | None = None) -> DataFrame:
    """Pairs of rows (a < b by ``key``) whose texts differ in characters but look the same, and whose tags read the same.

    Tags compare by canonical form apart from case; NULL only equals NULL. NULL and empty texts are no case, and rows
    with equal texts make no pair with each other. Rows of one look are first reduced to its different spellings; only
    spellings are compared with each other, and only looks with several spellings go on to the rows, so that a text
    that is repeated in a third of the table meets nothing but its rarer spellings. The forms are computed once and
    staged, as three joins read them. ``key`` should be unique: a row
    repeated with its key makes its pairs repeatedly.
    """
    rows = _looks(df, key, text, tag, staging or Staging(df.sparkSession, "lookalike"))
    spellings = rows.select("form", "tag", "t").distinct()
    several = spellings.groupBy("form", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form", "tag")
    spellings = spellings.join(several, ["form", "tag"], "left_semi")
    two = spellings.select("form", "tag", F.col("t").alias("t1")).join(spellings.select("form", "tag", F.col("t").alias("t2")), ["form", "tag"]).where("t1 < t2")
    one = rows.select("form", "tag", F.col("t").alias("t1"), F.col("k").alias("k1"))
    other = rows.select("form", "tag", F.col("t").alias("t2"), F.col("k").alias("k2"))
    pairs = two.join(one, ["form", "tag", "t1"]).join(other, ["form", "tag", "t2"])
    return pairs.select(F.least("k1", "k2").alias(a), F.greatest("k1", "k2").alias(b))
