"""Operations on whole graphs: quads DataFrames of which the triples count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import term_of_id
from quadloom.functions.vocab import RDF
from quadloom.operators.stars import contract
from quadloom.plans.staging import Staging


def _set(q: DataFrame) -> DataFrame:
    return q.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select("s", "p", "o", F.col("s.id").alias("_s"), F.col("o.id").alias("_o")).dropDuplicates(["_s", "p", "_o"])


def _keys(q: DataFrame) -> DataFrame:
    return q.select(F.col("s.id").alias("x_s"), F.col("p").alias("x_p"), F.col("o.id").alias("x_o"))


_SAME = "_s = x_s AND p = x_p AND _o = x_o"


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of either graph, each once."""
    return _set(a.select("s", "p", "o").unionByName(b.select("s", "p", "o"))).select("s", "p", "o")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _set(a).join(_keys(b), F.expr(_SAME), "left_semi").select("s", "p", "o")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _set(a).join(_keys(b), F.expr(_SAME), "left_anti").select("s", "p", "o")


def parts(q: DataFrame, which: str) -> DataFrame:
    """Distinct subjects, predicates or objects, or pairs of them: ``which`` is any one or two of s, p and o."""
    ids = {"s": F.col("s.id").alias("s"), "p": F.col("p").alias("p"), "o": F.col("o.id").alias("o")}
    return q.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select(*[ids[c] for c in which]).distinct()


def all_nodes(q: DataFrame) -> DataFrame:
    """The ids of all subjects and objects."""
    return q.where("s.id IS NOT NULL AND o.id IS NOT NULL").select(F.explode(F.array("s.id", "o.id")).alias("node")).distinct()


def match(q: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Quads that have the given ids (N3) and predicate IRI; None is a wildcard."""
    for column, value in (("s.id", s), ("p", p), ("o.id", o), ("g", g)):
        if value is not None:
            q = q.where(F.col(column) == value)
    return q


def contains(q: DataFrame, s: str, p: str, o: str) -> bool:
    return bool(match(q, s, p, o).head(1))


def value(q: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> str | None:
    """The id that completes a triple of which exactly two parts are given; the least of several, None without one."""
    if [s, p, o].count(None) != 1:
        raise ValueError("exactly two of s, p and o are needed")
    c = F.col("s.id") if s is None else F.col("p") if p is None else F.col("o.id")
    return match(q, s, p, o).agg(F.min(c).alias("v")).first()["v"]


def node_labels(q: DataFrame, staging: Staging | None = None) -> DataFrame:
    """(v, root): every node with the least id of its connected component, directions aside."""
    staging = staging or Staging(q.sparkSession, "labels")
    ids = q.where("s.id IS NOT NULL AND o.id IS NOT NULL").select(F.col("s.id").alias("u"), F.col("o.id").alias("v"))
    alone = ids.where("u = v").select("v", F.col("v").alias("root"))
    return contract(ids, staging).unionByName(alone).groupBy("v").agg(F.min("root").alias("root"))


def connected(q: DataFrame) -> DataFrame:
    """One row: whether all nodes hang together, directions aside; true without nodes."""
    return node_labels(q).agg((F.count_distinct("root") <= 1).alias("connected"))


def collections(q: DataFrame, staging: Staging | None = None) -> DataFrame:
    """(list, items, cells): every rdf:List head with the ids of its items and of its cells in order.

    The cells' distances from their heads come from pointer doubling over rdf:rest; a list that runs in a ring or lacks
    an end ends where it first repeats or stops.
    """
    staging = staging or Staging(q.sparkSession, "lists")
    first = q.where(F.col("p") == RDF.first).groupBy(F.col("s.id").alias("cell")).agg(F.min("o.id").alias("item"))
    rest = q.where(F.col("p") == RDF.rest).groupBy(F.col("s.id").alias("cell")).agg(F.min("o.id").alias("next"))
    cells = staging.cut(first.join(rest, "cell", "left"))
    heads = cells.select("cell").join(cells.select(F.col("next").alias("n")), F.col("cell") == F.col("n"), "left_anti")
    # reach: (list, cell, distance), doubled by jumps over 2^k cells
    reach = staging.cut(heads.select(F.col("cell").alias("list"), "cell", F.lit(0).alias("at")))
    jump = staging.cut(cells.where("next IS NOT NULL").select(F.col("cell").alias("from"), F.col("next").alias("to")))
    step = 1
    while True:
        more = reach.join(jump, F.col("cell") == F.col("from")).select("list", F.col("to").alias("cell"), (F.col("at") + step).alias("at"))
        grown = staging.cut(reach.unionByName(more).groupBy("list", "cell").agg(F.min("at").alias("at")))
        if grown.count() == reach.count():
            reach = grown
            break
        reach = grown
        j2 = jump.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
        jump = staging.cut(jump.join(j2, F.col("to") == F.col("f2")).select("from", F.col("t2").alias("to")))
        step *= 2
    items = reach.join(cells.select("cell", "item"), "cell")
    whole = items.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("at", "item", "cell"))).alias("x"))
    return whole.select("list", F.transform("x", lambda x: x["item"]).alias("items"), F.transform("x", lambda x: x["cell"]).alias("cells"))


def terms(df: DataFrame, *columns: str) -> DataFrame:
    """Replace id columns by term structs."""
    return df.withColumns({c: term_of_id(F.col(c)) for c in columns})
