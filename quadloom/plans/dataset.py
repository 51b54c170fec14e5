"""Graphs and datasets as users meet them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import IRI, TERM_DDL, Term, parse_id
from quadloom.functions.vocab import RDF, Prefixes
from quadloom.operators import graph_ops
from quadloom.plans.graphs import Layout, QuadGraph, frame_of_terms
from quadloom.plans.graphs import folder_of as _folder
from quadloom.sparql.compiler import Result, run_query
from quadloom.sparql.update import add_quads, apply_update, remove_quads


class Dataset:
    """A snapshot of quads; changes give a new one. ``union_default`` makes all graphs together the default graph."""

    def __init__(self, quads: DataFrame, prefixes: Prefixes | None = None, is_set: bool = True, union_default: bool = False, names: set[str] | None = None, layout: Layout | None = None):
        self.stored, self.quads = quads, quads.drop("_part") if layout else quads
        self.prefixes, self.is_set, self.union_default, self.names, self.layout = prefixes or Prefixes(), is_set, union_default, set(names or ()), layout
        self.spark = quads.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Dataset:
        return cls(frame_of_terms(spark, []))

    @classmethod
    def of(cls, spark: SparkSession, quads) -> Dataset:
        """The dataset of driver-side (graph, s, p, o)."""
        return cls(add_quads(frame_of_terms(spark, []), frame_of_terms(spark, quads)))

    def _next(self, quads: DataFrame, is_set: bool = True) -> Dataset:
        return Dataset(quads, self.prefixes, is_set, self.union_default, self.names)

    def query(self, text: str, bindings: dict[str, Term] | None = None) -> Result:
        head = "".join(f"PREFIX {p}: <{n}>\n" for p, n in self.prefixes.of.items())
        return run_query(QuadGraph(self.stored, self.is_set, self.union_default, layout=self.layout), head + text, bindings)

    def update(self, text: str, loader: Callable[[str], DataFrame] | None = None) -> Dataset:
        head = "".join(f"PREFIX {p}: <{n}>\n" for p, n in self.prefixes.of.items())
        return self._next(apply_update(self.quads, head + text, loader, self.names))

    # graphs
    def graph(self, name: str | None = None) -> DataFrame:
        return self.quads.where("g IS NULL") if name is None else self.quads.where(F.col("g") == name)

    def graphs(self) -> DataFrame:
        return self.quads.where("g IS NOT NULL").select("g").distinct()

    def remove_graph(self, name: str | None) -> Dataset:
        if name is None:
            raise ValueError("the default graph can't be removed")
        return self._next(self.quads.where(F.col("g").isNull() | (F.col("g") != name)))

    def contexts(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The names of the graphs that have a triple of these ids."""
        return self._match(s, p, o, None).select("g").distinct()

    # triples
    def _match(self, s: str | None, p: str | None, o: str | None, g: str | None) -> DataFrame:
        q = self.stored
        if self.layout:
            q = self.layout.prune(q, p=p, g=g).drop("_part")
        return graph_ops.match(q, s, p, o, g)

    def triples(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        q = self._match(s, p, o, g)
        q = q.offset(offset) if offset else q
        return q if limit is None else q.limit(limit)

    def count(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> int:
        return self._match(s, p, o, g).count()

    def exists(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> bool:
        return bool(self._match(s, p, o, g).head(1))

    def add(self, quads: DataFrame) -> Dataset:
        return self._next(add_quads(self.quads, quads))

    def remove(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> Dataset:
        """Without the quads of these ids; None is a wildcard, also for the graph."""
        hit = F.lit(True)
        for column, v in (("s.id", s), ("p", p), ("o.id", o), ("g", g)):
            if v is not None:
                hit = hit & F.col(column).eqNullSafe(F.lit(v))
        return self._next(self.quads.where(~hit))

    def remove_quads(self, quads: DataFrame) -> Dataset:
        return self._next(remove_quads(self.quads, quads))

    def set_value(self, quad: tuple) -> Dataset:
        """Replace all values of the quad's subject and predicate (in its graph) by its object."""
        g, s, p, _ = quad
        name = g.lex if isinstance(g, Term) else g
        pred = p.lex if isinstance(p, Term) else p
        kept = self.quads.where(~(F.col("g").eqNullSafe(F.lit(name).cast("string")) & (F.col("s.id") == s.id) & (F.col("p") == pred)))
        return self._next(add_quads(kept, frame_of_terms(self.spark, [quad])))

    def write(self, path: str, by: str = "predicate", folders: int = 64) -> None:
        """Parquet by predicate or by graph, and the prefixes.

        Predicates (or graphs) are spread over ``folders`` by their hash, so that the many rare ones don't get a folder each,
        and lie sorted in the files of a folder: a pattern with a constant reads one folder, and in it the row groups of
        that constant. A hot one is split over several files by range.
        """
        column, n = {"predicate": "p", "graph": "g"}[by], F.lit(folders)
        rows = self.quads.withColumn("_part", _folder(F.col(column), n))
        rows = rows.repartitionByRange("_part", column, "s.id", "p", "o.id").sortWithinPartitions("_part", column, "s.id", "p", "o.id")
        rows.write.partitionBy("_part").mode("errorifexists").parquet(f"{path}/quads")
        self.spark.createDataFrame(sorted(self.prefixes.of.items()), "prefix string, namespace string").coalesce(1).write.parquet(f"{path}/prefixes")
        self.spark.createDataFrame([(column, folders)], "part_of string, folders int").coalesce(1).write.parquet(f"{path}/layout")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dataset:
        prefixes = {r["prefix"]: r["namespace"] for r in spark.read.parquet(f"{path}/prefixes").collect()}
        layout = spark.read.parquet(f"{path}/layout").first()
        quads = spark.read.schema(f"g string, s {TERM_DDL}, p string, o {TERM_DDL}, _part int").parquet(f"{path}/quads")
        return cls(quads, Prefixes(prefixes), layout=Layout(layout["part_of"], layout["folders"]))


class Resource:
    """A node and what it is linked to."""

    def __init__(self, dataset: Dataset, node: Term):
        self.dataset, self.node = dataset, node

    def objects(self, predicate: str) -> DataFrame:
        return self.dataset.triples(s=self.node.id, p=predicate).select("o").distinct()

    def subjects(self, predicate: str) -> DataFrame:
        return self.dataset.triples(o=self.node.id, p=predicate).select("s").distinct()

    def value(self, predicate: str) -> str | None:
        return graph_ops.value(self.dataset.quads, s=self.node.id, p=predicate)


class Collection:
    """An rdf:List of a dataset by its head: one list, read as arrays. Changes give a new dataset."""

    def __init__(self, dataset: Dataset, head: Term):
        self.dataset, self.head = dataset, head
        self._arrays: tuple[list[str], list[str]] | None = None

    def _read(self) -> tuple[list[str], list[str]]:
        if self._arrays is None:
            cells = self.dataset.quads.where(F.col("p").isin(RDF.first, RDF.rest))
            row = graph_ops.collections(cells).where(F.col("list") == self.head.id).first()
            self._arrays = ([], []) if row is None else (row["items"], row["cells"])
        return self._arrays

    def items(self) -> list[str]:
        """The ids of the items in order."""
        return self._read()[0]

    def __len__(self) -> int:
        return len(self.items())

    def __getitem__(self, i: int) -> str:
        return self.items()[i]

    def __iter__(self):
        return iter(self.items())

    def index(self, item: Term) -> int:
        return self.items().index(item.id)

    def append(self, item: Term, cell: Term) -> Dataset:
        """The dataset in which the list ends with a new cell that holds the item."""
        cells = self._read()[1]
        end = Term(IRI, RDF.nil)
        if not cells:
            raise ValueError(f"{self.head} is no list")
        last = parse_id(cells[-1])
        changed = self.dataset.remove(s=last.id, p=RDF.rest)
        return changed.add(frame_of_terms(self.dataset.spark, [(None, last, Term(IRI, RDF.rest), cell), (None, cell, Term(IRI, RDF.first), item), (None, cell, Term(IRI, RDF.rest), end)]))

    def clear(self) -> Dataset:
        """The dataset without the cells of the list."""
        gone = self.dataset.quads.where(F.col("p").isin(RDF.first, RDF.rest) & F.col("s.id").isin(self._read()[1]))
        return self.dataset.remove_quads(gone)
