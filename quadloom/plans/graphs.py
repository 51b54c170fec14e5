"""Graphs: quads in a DataFrame, and tables seen as graphs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import BNODE, IRI, QUADS, TERM_DDL, TRIPLE, Term, parse_id, triple_parts
from quadloom.functions.values import IdVal, Val, constant, same, string
from quadloom.functions.vocab import RDF, XSD
from quadloom.plans.frames import Frame, unite
from quadloom.sparql.ast import TripleTermPattern, Var

_DT = {"bigint": XSD.integer, "int": XSD.integer, "smallint": XSD.integer, "tinyint": XSD.integer, "double": XSD.double, "float": XSD.double, "string": XSD.string, "boolean": XSD.boolean, "timestamp": XSD.dateTime, "timestamp_ntz": XSD.dateTime, "date": XSD.date}


def frame_of_terms(spark: SparkSession, quads: Iterable[tuple[Term | str | None, Term, Term | str, Term]]) -> DataFrame:
    """A quads DataFrame of driver-side terms: (graph or None, s, p, o)."""
    rows = [(g.lex if isinstance(g, Term) else g, s.row(), p.lex if isinstance(p, Term) else p, o.row()) for g, s, p, o in quads]
    return spark.createDataFrame(rows, QUADS)


def folder_of(value, folders):
    """The number of the folder of a predicate or graph, which a constant one folds to when the plan is made."""
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), folders).cast("int")


@dataclass
class Layout:
    """Quads stored in folders (column ``_part``) by the hash of a column, p or g."""

    column: str
    folders: int

    def prune(self, df: DataFrame, **known: str | None) -> DataFrame:
        """The folder of a constant predicate or graph alone, if the quads lie by that."""
        value = known.get(self.column)
        return df if value is None else df.where(F.col("_part") == folder_of(F.lit(value), F.lit(self.folders)))


class QuadGraph:
    """Quads with an active part: the default graph (g is NULL), all graphs merged, or a chosen few.

    ``is_set`` promises that no triple repeats within a graph, as is true of what the loaders write; otherwise each
    pattern removes repetitions. Rows that lack s, p or o are no triples.
    """

    def __init__(self, quads: DataFrame, is_set: bool = False, union_default: bool = False, default: list[str] | None = None, named: list[str] | None = None, layout: Layout | None = None):
        self.layout = layout
        self.quads, self.is_set, self.union_default, self.default, self.named = quads, is_set, union_default, default, named
        self.spark = quads.sparkSession

    def active(self, graph) -> DataFrame:
        q = self.quads.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL")
        if graph is None:
            if self.union_default:
                return q
            return q.where("g IS NULL") if self.default is None else q.where(F.col("g").isin(self.default))
        q = q.where("g IS NOT NULL") if self.named is None else q.where(F.col("g").isin(self.named))
        return q if isinstance(graph, Var) else q.where(F.col("g") == graph)

    def merges(self, graph) -> bool:
        """Whether the active graph merges several."""
        return graph is None and (self.union_default or (self.default is not None and len(self.default) > 1))

    def graph_names(self) -> DataFrame:
        return self.active(Var("g")).select("g").distinct()

    def triple(self, s, p, o, graph=None) -> Frame:
        """The solutions of a triple pattern."""
        df, vals, extra = self.active(graph), {}, []
        if self.layout:
            df = self.layout.prune(df, p=p.lex if isinstance(p, Term) else None, g=graph if isinstance(graph, str) else "" if graph is None and not self.merges(None) and self.default is None else None)

        def place(node, val: Val) -> None:
            nonlocal df
            if isinstance(node, Term):
                df = df.where(val.col == node.lex if val.t == "iri" else val.id() == node.id)
            elif isinstance(node, Var):
                if node.name in vals:
                    df = df.where(same(vals[node.name], val))
                else:
                    vals[node.name] = val
            else:
                extra.append((node, val))

        place(s, IdVal(F.col("s.id")))
        place(p, Val("iri", F.col("p")))
        place(o, IdVal(F.col("o.id")))
        if isinstance(graph, Var):
            place(graph, Val("iri", F.col("g")))
        for k, (node, val) in enumerate(extra):
            df = df.where(val.kind() == TRIPLE)
            df = self._match_parts(df, node, val.id(), f"_t{k}", vals)
        out = Frame.make(df, vals)
        return out if self.is_set and not self.merges(graph) else out.distinct()

    def _match_parts(self, df: DataFrame, node: TripleTermPattern, id, name: str, vals: dict[str, Val]) -> DataFrame:
        df = df.withColumn(name, triple_parts(id)).where(F.col(name)["s"].isNotNull())
        for field_, part in (("s", node.s), ("p", node.p), ("o", node.o)):
            inner = F.col(name)[field_]
            if isinstance(part, Term):
                df = df.where(inner == part.id)
            elif isinstance(part, Var):
                if part.name in vals:
                    df = df.where(vals[part.name].id() == inner)
                else:
                    vals[part.name] = IdVal(inner)
            else:
                df = df.where(inner.startswith("<<("))
                df = self._match_parts(df, part, inner, f"{name}{field_}", vals)
        return df

    def nodes(self, graph=None) -> DataFrame:
        """The ids of all subjects and objects (with g under a graph variable), distinct."""
        q = self.active(graph)
        g = ["g"] if isinstance(graph, Var) else []
        return q.select(*g, F.explode(F.array("s.id", "o.id")).alias("n")).distinct()

    # graph operations
    def triples(self) -> DataFrame:
        """Distinct triples of the active graph."""
        return self.active(None).select("s", "p", "o", F.col("s.id").alias("_s"), F.col("o.id").alias("_o")).dropDuplicates(["_s", "p", "_o"]).drop("_s", "_o")


@dataclass
class Column_:
    """A predicate's column: a literal of a datatype, or, with ``to``, the key of the nodes of a template."""

    column: str
    dt: str | None = None
    to: str | None = None


@dataclass
class ClassMap:
    """A table whose rows are the nodes of a class."""

    iri: str
    table: DataFrame
    template: str
    key: list[str]
    columns: dict[str, Column_] = field(default_factory=dict)

    def key_column(self):
        return F.col(self.key[0]) if len(self.key) == 1 else F.concat_ws("/", *self.key)


def map_table(table: DataFrame, iri: str, template: str, key: list[str], namespace: str, links: dict[str, tuple[str, str]] | None = None) -> ClassMap:
    """A class map with a predicate per column, and links: predicate name to (column, template of the target)."""
    columns = {namespace + c: Column_(c, _DT[t]) for c, t in table.dtypes if t in _DT}
    columns |= {namespace + name: Column_(c, to=to) for name, (c, to) in (links or {}).items()}
    return ClassMap(iri, table, template, key, columns)


class VirtualGraph:
    """Tables as a graph. The patterns of one subject are one scan of its table, and joins go over native keys.

    Each table's key must be unique, as a graph is a set. NULL columns are absent triples. All is in the default graph.
    """

    is_set = True

    def __init__(self, classes: list[ClassMap]):
        self.classes, self.spark = classes, classes[0].table.sparkSession

    def graph_names(self) -> DataFrame:
        return self.spark.createDataFrame([], "g string")

    def optional_star(self, s, triples: list, groups: list[list]) -> Frame | None:
        """A star with optional groups of patterns of the same subject, whose objects are new variables, as one scan.

        None unless a single class answers the star and has all the predicates.
        """
        options = [c for c in self.classes if self._star_of(c, s, triples) is not None]
        if len(options) != 1 or any(t.p.lex not in options[0].columns for g in groups for t in g):
            return None
        return self._star_of(options[0], s, triples, groups)

    def star(self, s, triples: list) -> Frame:
        """The solutions of the patterns of one subject."""
        options = [f for c in self.classes if (f := self._star_of(c, s, triples)) is not None]
        if options:
            return unite(options)
        names = {x.name for t in triples for x in (s, t.p, t.o) if isinstance(x, Var)}
        return Frame.make(self.spark.range(0), {n: string(F.lit("")) for n in names})

    def _star_of(self, c: ClassMap, s, triples: list, groups: list[list] = ()) -> Frame | None:
        df, vals, certain = c.table, {}, {}
        key = Val("iri", c.key_column(), prefix=c.template)
        conditions = []

        types = dict(c.table.dtypes)

        def put(node, val: Val, kind: str = "string") -> bool:
            if isinstance(node, Var):
                if node.name in vals:
                    conditions.append(same(vals[node.name], val))
                else:
                    vals[node.name] = val
            elif isinstance(node, Term):
                if node.kind == BNODE:
                    return False
                if val.t == "iri":
                    if node.kind != IRI or not node.lex.startswith(val.prefix):
                        return False
                    conditions.append(val.col == F.lit(node.lex[len(val.prefix) :]).try_cast(kind))
                else:
                    k = constant(node)
                    if k.t != val.t or k.dt != val.dt:
                        conditions.append(val.id() == node.id)
                    else:
                        conditions.append(val.col == k.col)
            else:
                return False
            return True

        if isinstance(s, Term):
            if s.kind != IRI or not s.lex.startswith(c.template):
                return None
            text = s.lex[len(c.template) :]
            conditions.append(c.key_column() == text if len(c.key) > 1 else F.col(c.key[0]) == F.lit(text).try_cast(types[c.key[0]]))
        elif not put(s, key):
            return None
        wild = []
        for t in triples:
            if isinstance(t.p, Term) and t.p.lex == RDF.type:
                if isinstance(t.o, Term):
                    if t.o.lex != c.iri:
                        return None
                elif not put(t.o, Val("iri", F.lit(c.iri))):
                    return None
            elif isinstance(t.p, Term):
                m = c.columns.get(t.p.lex)
                if m is None:
                    return None
                v = Val("iri", F.col(m.column), prefix=m.to) if m.to else Val("native", F.col(m.column), m.dt)
                if m.to is None and m.dt == XSD.integer:
                    v = Val("native", F.col(m.column).cast("bigint"), m.dt)
                conditions.append(F.col(m.column).isNotNull())
                if not put(t.o, v, types[m.column]):
                    return None
            else:
                wild.append(t)
        for k, t in enumerate(wild):  # a variable predicate: the row's triples, unpivoted
            cells = [F.struct(F.lit(RDF.type).alias("p"), Val("iri", F.lit(c.iri)).id().alias("o"))]
            for p, m in c.columns.items():
                v = Val("iri", F.col(m.column), prefix=m.to) if m.to else Val("native", F.col(m.column), m.dt)
                cells.append(F.when(F.col(m.column).isNotNull(), F.struct(F.lit(p).alias("p"), v.id().alias("o"))))
            df = df.withColumn(f"_w{k}", F.explode(F.array_compact(F.array(*cells))))
            if not put(t.p, Val("iri", F.col(f"_w{k}")["p"])) or not put(t.o, IdVal(F.col(f"_w{k}")["o"])):
                return None
        for x in conditions:
            df = df.where(x)
        for g in groups:  # all of a group or none of it
            whole = F.lit(True)
            for t in g:
                whole = whole & F.col(c.columns[t.p.lex].column).isNotNull()
            for t in g:
                m = c.columns[t.p.lex]
                col = F.col(m.column).cast("bigint") if m.to is None and m.dt == XSD.integer else F.col(m.column)
                vals[t.o.name] = Val("iri", F.when(whole, col), prefix=m.to) if m.to else Val("native", F.when(whole, col) if len(g) > 1 else col, m.dt)
                certain[t.o.name] = False
        return Frame.make(df, vals, certain)

    def triple(self, s, p, o, graph=None) -> Frame:
        from quadloom.sparql.ast import Triple

        return self.star(s, [Triple(s, p, o)])

    def nodes(self, graph=None) -> DataFrame:
        f = self.triple(Var("s"), Var("p"), Var("o"))
        return f.df.select(F.explode(F.array(f.val("s").id(), f.val("o").id())).alias("n")).distinct()

    def quads(self) -> DataFrame:
        """All triples as quads."""
        f = self.triple(Var("s"), Var("p"), Var("o"))
        return f.df.select(F.lit(None).cast("string").alias("g"), f.val("s").term().alias("s"), f.val("p").lex().alias("p"), f.val("o").term().alias("o"))


__all__ = ["ClassMap", "Column_", "QuadGraph", "VirtualGraph", "frame_of_terms", "map_table", "parse_id", "TERM_DDL"]
