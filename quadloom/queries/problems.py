"""Queries of the general problems: hot predicates, films as a wide table, time literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.frequency import distinct_profile, modes
from quadloom.operators.instants import normalise_instants
from quadloom.operators.wide import Attribute, attributes_to_wide

SCHEMA = "http://kb.example/schema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def quads(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/quads.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    q = quads(spark, d).select("p", F.col("s.id").alias("s_id"), F.col("o.id").alias("o_id"))
    return distinct_profile(q, "p", {"s_id": "n_subjects", "o_id": "n_objects"}, "n_rows", "n_triples").select(
        "p", "n_rows", "n_triples", "n_subjects", "n_objects"
    )


P1_SQL = """
SELECT p, count(*) AS n_rows, count(DISTINCT (s.id, o.id)) AS n_triples, count(DISTINCT s.id) AS n_subjects, count(DISTINCT o.id) AS n_objects
FROM quads WHERE p IS NOT NULL AND s.id IS NOT NULL AND o.id IS NOT NULL GROUP BY p
"""


def p1_modes(spark: SparkSession, d: str) -> DataFrame:
    return modes(quads(spark, d).select("p", F.col("o.id").alias("o_id")), "p", "o_id")


P1_MODES_SQL = """
SELECT p, mode, mode_rows FROM (
  SELECT p, o_id AS mode, n AS mode_rows, row_number() OVER (PARTITION BY p ORDER BY n DESC, o_id) AS r
  FROM (SELECT p, o.id AS o_id, count(*) AS n FROM quads WHERE p IS NOT NULL AND o.id IS NOT NULL GROUP BY 1, 2) x) y WHERE r = 1
"""

FILM_COLUMNS = ("label_en", "runtime", "votes", "rating100", "released", "colour", "n_genres")


def film_attributes() -> tuple[dict[str, int], list[Attribute]]:
    literal, iri = F.col("kind") == 2, F.col("kind") == 1
    attributes = [
        Attribute("label_en", "string", "text", literal & (F.lower(F.col("lang")) == "en")),
        Attribute("runtime", "bigint", "number", literal),
        Attribute("votes", "bigint", "number", literal),
        Attribute("rating100", "bigint", "number", literal, shift=2),
        Attribute("released", "string", "date", literal),
        Attribute("colour", "bigint", "boolean", literal),
        Attribute("n_genres", "bigint", "text", iri, count=True),
    ]
    predicates = [RDFS_LABEL, *(SCHEMA + x for x in ("runtime", "votes", "rating", "initial_release_date", "in_colour", "genre"))]
    return {p: i for i, p in enumerate(predicates)}, attributes


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    position, attributes = film_attributes()
    flat = quads(spark, d).select("p", F.col("s.lex").alias("s"), "o.kind", "o.lex", "o.lang")
    films = flat.where((F.col("p") == RDF_TYPE) & (F.col("kind") == 1) & (F.col("lex") == SCHEMA + "Film"))
    rows = flat.where(F.col("p").isin(list(position)) & F.col("lex").isNotNull())
    at = F.coalesce(*[F.when(F.col("p") == p, F.lit(i)) for p, i in position.items()])
    return attributes_to_wide(rows, films, "s", "lex", at, attributes, "s")


def p5_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every time literal with its instant, how it was read, and whether it is certain."""
    return normalise_instants(spark.read.parquet(f"{d}/time_literals.parquet"), spark.read.parquet(f"{d}/graph_zones.parquet"), "lit_id", "g", "lex")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_instants(spark, d).where("resolved").select("lit_id", "instant_us")


_BLANK = r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$"
_NUMERAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?))?(Z|[+-]((0[0-9]|1[0-3]):[0-5][0-9]|14:00))?$"


def _sql_number(name: str, times: int) -> str:
    x = f"round(try_cast(v AS DOUBLE) * {times}, 6)"
    return f"min(CASE WHEN p = '{SCHEMA}{name}' AND kind = 2 AND regexp_matches(v, '{_NUMERAL}') AND {x} = round({x}) THEN CAST({x} AS BIGINT) END)"


P2_SQL = f"""
WITH flat AS (SELECT s.lex AS s, p, o.kind AS kind, o.lang AS lang, o.lex AS lex, regexp_replace(o.lex, '{_BLANK}', '', 'g') AS v FROM quads),
films AS (SELECT DISTINCT s FROM flat WHERE p = '{RDF_TYPE}' AND kind = 1 AND lex = '{SCHEMA}Film' AND s IS NOT NULL)
SELECT films.s AS s,
  min(CASE WHEN p = '{RDFS_LABEL}' AND kind = 2 AND lower(lang) = 'en' AND v <> '' THEN v END) AS label_en,
  {_sql_number("runtime", 1)} AS runtime, {_sql_number("votes", 1)} AS votes, {_sql_number("rating", 100)} AS rating100,
  min(CASE WHEN p = '{SCHEMA}initial_release_date' AND kind = 2 AND regexp_matches(v, '{_DATE}') AND try_cast(substr(v, 1, 10) AS DATE) IS NOT NULL THEN substr(v, 1, 10) END) AS released,
  CAST(min(CASE WHEN p = '{SCHEMA}in_colour' AND kind = 2 AND v IN ('true', '1') THEN 1 WHEN p = '{SCHEMA}in_colour' AND kind = 2 AND v IN ('false', '0') THEN 0 END) AS BIGINT) AS colour,
  count(DISTINCT CASE WHEN p = '{SCHEMA}genre' AND kind = 1 THEN lex END) AS n_genres
FROM films JOIN flat ON flat.s = films.s GROUP BY films.s
"""

QUERIES = {"p1_found": p1_found, "p1_modes": p1_modes, "p2_found": p2_found, "p5_found": p5_found, "p5_instants": p5_instants}
SQL = {"p1_found": P1_SQL, "p1_modes": P1_MODES_SQL, "p2_found": P2_SQL}
