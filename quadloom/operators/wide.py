"""Entity–attribute–value rows into one typed row per entity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200C))) + "    ⁠　﻿"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def with_whole_number(df: DataFrame, text: str, shift: Column, out: str) -> DataFrame:
    """Add ``out``: the value of an XSD numeral times 10**shift as BIGINT; NULL unless it is whole and fits.

    ``text`` is a trimmed column. The digits themselves are shifted, so neither a long fraction nor an exponent is
    rounded. The steps are projections of their own, which Catalyst keeps apart where a result is used repeatedly.
    """
    form = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$"
    t, rest = F.col(text), [c for c in df.columns if c != out]
    df = df.select(*rest, F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).alias("_w"))
    df = df.select(
        *rest,
        F.when(F.col("_w").startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("_sign"),
        F.ltrim(F.concat(F.regexp_extract("_w", form, 2), F.regexp_extract("_w", form, 3)), F.lit("0")).alias("_digits"),
        F.length(F.regexp_extract("_w", form, 3)).alias("_part"),
        F.regexp_replace(F.regexp_extract("_w", form, 4), r"^([+-]?)0+(?=[0-9])", "$1").alias("_power"),
    )
    far = F.when(F.col("_power").startswith("-"), F.lit(-9999999)).otherwise(F.lit(9999999))
    power = F.when(F.col("_power") == "", F.lit(0)).when(F.length("_power") > 7, far).otherwise(F.col("_power").try_cast("int"))
    df = df.select(*rest, "_sign", "_digits", (F.col("_part") - power - shift).alias("_down"), F.length("_digits").alias("_n"))
    number = (
        F.when(F.col("_digits") == "", F.lit("0"))
        .when((F.col("_down") <= 0) & (F.col("_n") - F.col("_down") <= 19), F.concat("_sign", "_digits", F.repeat(F.lit("0"), -F.col("_down"))))
        .when((F.col("_down") > 0) & (F.col("_down") < F.col("_n")) & F.right("_digits", F.col("_down")).rlike("^0*$"), F.concat("_sign", F.left("_digits", F.col("_n") - F.col("_down"))))
    )
    return df.select(*rest, number.try_cast("decimal(38,0)").try_cast("bigint").alias(out))


def xsd_boolean(lex: Column) -> Column:
    """1 or 0 for a trimmed XSD boolean; NULL otherwise."""
    t = lex
    return F.when(t.isin("true", "1"), F.lit(1)).when(t.isin("false", "0"), F.lit(0)).cast("bigint")


def xsd_calendar_date(lex: Column) -> Column:
    """``yyyy-mm-dd`` as written in a trimmed xsd:date or xsd:dateTime of an existing day; NULL otherwise."""
    t = lex
    zone = r"(Z|[+-]((0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
    clock = r"(T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?))?"
    day = F.when(t.rlike(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{clock}{zone}$"), F.left(t, F.lit(10)))
    return F.when((F.left(day, F.lit(4)) != "0000") & day.try_cast("date").isNotNull(), day)


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: how its values are read from ``lex``, and from which rows.

    ``read`` is ``number`` (an XSD numeral, times 10**shift), ``boolean``, ``date`` or ``text``. ``where`` is a
    condition on the row's columns. Of several different values the least stands; with ``count``, the column is the
    number of different values instead.
    """

    name: str
    kind: str
    read: str
    where: Column
    shift: int = 0
    count: bool = False


def attributes_to_wide(rows: DataFrame, entities: DataFrame, entity: str, lex: str, position: Column, attributes: Sequence[Attribute], out: str) -> DataFrame:
    """One row per entity with a typed column per attribute.

    ``entities`` has the entities in its column ``entity``; repeated ones count once, NULL ones not at all.
    ``position`` gives the index of a row's attribute, NULL for rows of no attribute. The grid of entities and
    attribute positions is completed, the values are joined to it, and each entity's values, sorted by position, are
    projected by fixed index through a try_cast to the column's type. Entities without values have NULL (0 in counts);
    rows of other entities, NULL and unreadable values vanish; an empty text is no value. Equal values are merged by
    (entity, position, value) before anything is gathered, so that an array never holds more than one element per
    attribute, however many rows an entity has.
    """
    which = {r: [i for i, a in enumerate(attributes) if a.read == r] for r in ("number", "boolean", "date", "text")}
    of = lambda r: F.col("_pos").isin(which[r]) if which[r] else F.lit(False)
    wanted = F.coalesce(*[F.when(F.col("_pos") == i, a.where) for i, a in enumerate(attributes)], F.lit(False))
    read = rows.withColumn("_pos", position).where(F.col("_pos").isNotNull() & F.col(entity).isNotNull() & wanted)
    read = read.select(F.col(entity).alias("_e"), "_pos", trimmed(F.col(lex)).alias("_t")).where("_t <> ''")
    shift = F.coalesce(*[F.when(F.col("_pos") == i, F.lit(a.shift)) for i, a in enumerate(attributes) if a.shift], F.lit(0))
    read = with_whole_number(read, "_t", shift, "_number")
    number = F.when(of("number"), F.col("_number")).when(of("boolean"), xsd_boolean(F.col("_t")))
    text = F.when(of("date"), xsd_calendar_date(F.col("_t"))).when(of("text"), F.col("_t"))
    read = read.select("_e", "_pos", number.alias("_num"), text.alias("_txt")).where("_num IS NOT NULL OR _txt IS NOT NULL")
    values = read.distinct().groupBy("_e", "_pos").agg(
        F.min("_num").alias("_num"), F.min("_txt").alias("_txt"), F.count(F.lit(1)).alias("_count")
    )
    counted = [i for i, a in enumerate(attributes) if a.count]
    value = F.when(F.col("_pos").isin(counted), F.col("_count").cast("string")) if counted else F.when(F.lit(False), F.lit(""))
    values = values.select("_e", "_pos", value.otherwise(F.coalesce(F.col("_num").cast("string"), F.col("_txt"))).alias("_value"))
    grid = entities.select(F.col(entity).alias("_e")).where("_e IS NOT NULL").distinct()
    grid = grid.withColumn("_pos", F.explode(F.array(*[F.lit(i) for i in range(len(attributes))])))
    whole = grid.join(values, ["_e", "_pos"], "left")
    gathered = whole.groupBy("_e").agg(F.sort_array(F.collect_list(F.struct("_pos", "_value"))).alias("_row"))
    cell = lambda i, a: F.get(F.col("_row"), F.lit(i))["_value"].try_cast(a.kind)
    return gathered.select(
        F.col("_e").alias(out),
        *[(F.coalesce(cell(i, a), F.lit(0).cast(a.kind)) if a.count else cell(i, a)).alias(a.name) for i, a in enumerate(attributes)],
    )
