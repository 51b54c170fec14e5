"""RDFS and OWL 2 RL by forward chaining.

Triples are (s, p, o) of ids. RDFS is a single pass: the schema, closed by the path operator, says for each property what
a triple of it gives. OWL runs in rounds over representatives: individuals that are the same are one node, the least of
their group, and the results are written out for all members at the end. Only rules are planned whose vocabulary occurs
in the triples. Rules of one atom derive from what the last round added; new triples are staged as a part of their own, and
the loop ends when a round adds none. Joins with schema tables are left to Spark, which broadcasts the small ones by
their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import term_of_id
from quadloom.functions.vocab import OWL, RDF, RDFS, XSD
from quadloom.operators.closure import closure
from quadloom.operators.graph_ops import collections
from quadloom.operators.stars import contract
from quadloom.plans.staging import Grown, Staging

SAME = OWL.sameAs
SCHEMA_PREDICATES = (RDFS.subClassOf, RDFS.subPropertyOf, RDFS.domain, RDFS.range)
# The vocabulary that the rules look for, as predicates and as types.
OWL_PREDICATES = tuple(
    OWL[x] for x in """inverseOf equivalentProperty equivalentClass sameAs onProperty hasValue someValuesFrom allValuesFrom maxCardinality maxQualifiedCardinality onClass
    intersectionOf unionOf oneOf hasKey propertyChainAxiom propertyDisjointWith members disjointWith complementOf differentFrom sourceIndividual assertionProperty
    targetIndividual targetValue""".split()
)
OWL_TYPES = tuple(
    OWL[x] for x in """SymmetricProperty TransitiveProperty FunctionalProperty InverseFunctionalProperty Nothing IrreflexiveProperty AsymmetricProperty AllDisjointProperties
    AllDisjointClasses""".split()
)


def _ids(quads: DataFrame) -> DataFrame:
    return quads.where("s.id IS NOT NULL AND p IS NOT NULL AND o.id IS NOT NULL").select(F.col("s.id").alias("s"), "p", F.col("o.id").alias("o"))


def _iri(name: str) -> str:
    return f"<{name}>"


def _strip(c):
    """The IRI of an id."""
    return F.when(F.col(c).startswith("<"), F.expr(f"substring({c}, 2, length({c}) - 2)"))


def _is_resource(c: str):
    return F.left(F.col(c), F.lit(1)).isin("<", "_")


class Triples:
    """All triples so far, the last round's, the vocabulary that occurs, and who else is the same as a representative."""

    def __init__(self, all: DataFrame, delta: DataFrame, vocabulary: set[str], same: DataFrame | None = None):
        self.all, self.delta, self.vocabulary, self.same = all, delta, vocabulary, same

    def has(self, *names: str) -> bool:
        return self.vocabulary.issuperset(names)

    def p(self, iri: str) -> DataFrame:
        return self.all.where(F.col("p") == iri).select("s", "o")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """The rows with IRIs in place of ids; a representative stands for all IRIs that are the same. Others are dropped."""
        for c in columns:
            if self.same is not None:
                others = df.join(self.same.select(F.col("rep").alias("_rep"), F.col("member").alias("_member")), F.col(c) == F.col("_rep"))
                df = df.unionByName(others.withColumn(c, F.col("_member")).select(*df.columns))
            df = df.withColumn(c, _strip(c)).where(F.col(c).isNotNull())
        return df.distinct()


def vocabulary_of(triples: DataFrame) -> set[str]:
    """The names of the rules' vocabulary that occur: at most as many as these lists have."""
    types = [_iri(x) for x in OWL_TYPES]
    used = triples.where(F.col("p").isin(*OWL_PREDICATES, *SCHEMA_PREDICATES, RDF.first) | ((F.col("p") == RDF.type) & F.col("o").isin(*types)))
    return {r["v"] for r in used.select(F.when(F.col("p") == RDF.type, _strip("o")).otherwise(F.col("p")).alias("v")).distinct().collect()}


def _named(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col("s").alias(a), F.col("o").alias(b))


def _out(df: DataFrame, s, p, o) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) and (x.startswith("http") or x.startswith("<")) else F.col(x) if isinstance(x, str) else x
    return df.select(as_col(s).alias("s"), as_col(p).alias("p"), as_col(o).alias("o"))


def rdfs_schema(t: Triples, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """(prop, kind, value), what a triple of a property gives: 0 the triple of property ``value``, 1 and 2 its subject's and
    object's class ``value``; and (sub, sup), the classes above a class. Both closed, small as a schema is, and staged."""
    pairs = lambda p: t.p(p).select(F.col("s").alias("a"), F.col("o").alias("b"))
    empty = t.all.limit(0).select(F.col("s").alias("a"), F.col("o").alias("b"))
    above = closure(pairs(RDFS.subClassOf), staging).where("a <> b") if t.has(RDFS.subClassOf) else empty
    above = staging.cut(above.select(F.col("a").alias("sub"), F.col("b").alias("sup")))
    props = t.named(closure(pairs(RDFS.subPropertyOf), staging).where("a <> b") if t.has(RDFS.subPropertyOf) else empty, "a", "b").where("a <> b")
    props = staging.cut(props.select(F.col("a").alias("sub"), F.col("b").alias("sup")))
    gives = props.select(F.col("sub").alias("prop"), F.lit(0).alias("kind"), F.col("sup").alias("value"))
    for kind, p in ((1, RDFS.domain), (2, RDFS.range)):
        if t.has(p):
            own = t.named(t.p(p).select(F.col("s").alias("prop"), F.col("o").alias("value")), "prop")
            own = own.unionByName(props.join(own, F.col("sup") == F.col("prop")).select(F.col("sub").alias("prop"), "value")).distinct()
            own = own.unionByName(own.join(above, F.col("value") == F.col("sub")).select("prop", F.col("sup").alias("value")))
            gives = gives.unionByName(own.select("prop", F.lit(kind).alias("kind"), "value"))
    return staging.cut(gives.distinct()), above


def rdfs_rules(d: DataFrame, schema: tuple[DataFrame, DataFrame]) -> list[DataFrame]:
    """rdfs2, rdfs3, rdfs7 and rdfs9 over the closed schema; transitive schema triples themselves aren't added."""
    gives, above = schema
    types = d.where(F.col("p") == RDF.type)
    met = d.join(gives, d.p == F.col("prop")).where((F.col("kind") < 2) | _is_resource("o"))
    return [
        met.select(
            F.when(F.col("kind") == 2, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("kind") == 0, F.col("value")).otherwise(F.lit(RDF.type)).alias("p"),
            F.when(F.col("kind") == 0, F.col("o")).otherwise(F.col("value")).alias("o"),
        ),
        _out(types.join(above, types.o == F.col("sub")), "s", RDF.type, "sup"),
    ]


def _props_of(t: Triples, kind: str) -> DataFrame:
    return t.named(t.all.where((F.col("p") == RDF.type) & (F.col("o") == _iri(kind))).select(F.col("s").alias("prop")), "prop")


def _both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.unionByName(df.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def _members(lists: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, n, i, member): list members of (owner, list)."""
    joined = owners.join(lists, F.col("o") == F.col("list"))
    return joined.select(F.col("s").alias("owner"), F.size("items").alias("n"), F.posexplode("items").alias("i", "member"))


def owl_rules(t: Triples, lists: DataFrame | None) -> list[DataFrame]:
    """The property and class rules of OWL 2 RL that the engine supports, as far as the vocabulary occurs.

    Equality has no rules here: triples are those of representatives.
    """
    a, d = t.all, t.delta
    rules: list[DataFrame] = []
    res, objects = d.where(_is_resource("o")), a.where(_is_resource("o"))
    types = t.p(RDF.type)
    typed = types.select(F.col("s").alias("x"), F.col("o").alias("c"))
    pairs = lambda p, x, y: t.p(p).select(F.col("s").alias(x), F.col("o").alias(y))
    # prp-symp, prp-inv1/2, prp-eqp1/2, cax-eqc1/2
    if t.has(OWL.SymmetricProperty):
        rules.append(_out(res.join(_props_of(t, OWL.SymmetricProperty), res.p == F.col("prop"), "left_semi"), "o", "p", "s"))
    if t.has(OWL.inverseOf):
        inverse = _both_ways(t.named(pairs(OWL.inverseOf, "p1", "p2"), "p1", "p2"), "p1", "p2")
        rules.append(_out(res.join(inverse, res.p == F.col("p1")), "o", "p2", "s"))
    if t.has(OWL.equivalentProperty):
        same_prop = _both_ways(t.named(pairs(OWL.equivalentProperty, "p1", "p2"), "p1", "p2"), "p1", "p2")
        rules.append(_out(d.join(same_prop, d.p == F.col("p1")), "s", "p2", "o"))
    if t.has(OWL.equivalentClass):
        rules.append(_out(types.join(_both_ways(pairs(OWL.equivalentClass, "c1", "c2"), "c1", "c2"), types.o == F.col("c1")), "s", RDF.type, "c2"))
    # prp-trp: paths that have a new step, one doubling a round
    if t.has(OWL.TransitiveProperty):
        trp = _props_of(t, OWL.TransitiveProperty)
        step = lambda df, x, p, y: df.join(trp, df.p == F.col("prop"), "left_semi").select(F.col("s").alias(x), F.col("p").alias(p), F.col("o").alias(y))
        for left, right in ((d, a), (a, d)):
            two = step(left, "x", "tp", "y").join(step(right, "y2", "tp2", "z"), (F.col("y") == F.col("y2")) & (F.col("tp") == F.col("tp2")))
            rules.append(_out(two.where("x <> z"), "x", "tp", "z"))
    # prp-fp, prp-ifp: a star around the least
    if t.has(OWL.FunctionalProperty):
        rules += _stars(objects.join(_props_of(t, OWL.FunctionalProperty), objects.p == F.col("prop"), "left_semi"))
    if t.has(OWL.InverseFunctionalProperty):
        of_inv = a.join(_props_of(t, OWL.InverseFunctionalProperty), a.p == F.col("prop"), "left_semi")
        rules += _stars(of_inv.select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
    # restrictions
    if t.has(OWL.onProperty):
        on = t.named(pairs(OWL.onProperty, "r", "rp"), "rp")
        if t.has(OWL.hasValue):
            hv = on.join(pairs(OWL.hasValue, "r", "v"), "r")
            rules.append(_out(hv.join(typed, F.col("r") == F.col("c")), "x", "rp", "v"))
            rules.append(_out(d.join(hv, (d.p == F.col("rp")) & (d.o == F.col("v"))), "s", RDF.type, "r"))
        if t.has(OWL.someValuesFrom):
            svf = on.join(pairs(OWL.someValuesFrom, "r", "v"), "r")
            rules.append(_out(d.join(svf.where(F.col("v") == _iri(OWL.Thing)), d.p == F.col("rp")), "s", RDF.type, "r"))
            rules.append(_out(a.join(svf, a.p == F.col("rp")).join(typed, (F.col("o") == F.col("x")) & (F.col("v") == F.col("c"))), "s", RDF.type, "r"))
        if t.has(OWL.allValuesFrom):
            avf = on.join(pairs(OWL.allValuesFrom, "r", "v"), "r").join(typed, F.col("r") == F.col("c"))
            rules.append(_out(objects.join(avf, (objects.s == F.col("x")) & (objects.p == F.col("rp"))), "o", RDF.type, "v"))
        one = lambda c: F.col(c).rlike('^("0*1"|[+]?0*1$)')
        if t.has(OWL.maxCardinality):
            maxc = on.join(pairs(OWL.maxCardinality, "r", "n").where(one("n")), "r").join(typed, F.col("r") == F.col("c"))
            rules += _stars(objects.join(maxc, (objects.s == F.col("x")) & (objects.p == F.col("rp"))).select("s", "p", "o"))
        if t.has(OWL.maxQualifiedCardinality, OWL.onClass):
            maxq = on.join(pairs(OWL.maxQualifiedCardinality, "r", "n").where(one("n")), "r").join(pairs(OWL.onClass, "r", "q"), "r").join(typed, F.col("r") == F.col("c"))
            held = objects.join(maxq, (objects.s == F.col("x")) & (objects.p == F.col("rp")))
            inst = typed.select(F.col("x").alias("ox"), F.col("c").alias("oc"))
            of_class = held.join(inst, (F.col("o") == F.col("ox")) & (F.col("q") == F.col("oc")), "left_semi")
            rules += _stars(of_class.select("s", F.concat("p", F.lit(" "), "q").alias("p"), "o"))
            rules += _stars(held.where(F.col("q") == _iri(OWL.Thing)).select("s", "p", "o"))
    # lists of classes
    if lists is not None:
        if t.has(OWL.intersectionOf):
            inter = _members(lists, t.p(OWL.intersectionOf))
            whole = inter.join(typed, F.col("member") == F.col("c")).groupBy("owner", "n", "x").agg(F.count_distinct("i").alias("k")).where("k = n")
            rules.append(_out(whole, "x", RDF.type, "owner"))
            rules.append(_out(inter.join(typed, F.col("owner") == F.col("c")), "x", RDF.type, "member"))
        if t.has(OWL.unionOf):
            rules.append(_out(_members(lists, t.p(OWL.unionOf)).join(typed, F.col("member") == F.col("c")), "x", RDF.type, "owner"))
        if t.has(OWL.oneOf):
            rules.append(_out(_members(lists, t.p(OWL.oneOf)), "member", RDF.type, "owner"))
        if t.has(OWL.hasKey):
            rules.append(_keys(t, lists, typed))
        if t.has(OWL.propertyChainAxiom):
            rules += _chains(t, lists)
    return rules


def _stars(held: DataFrame) -> list[DataFrame]:
    """The objects of each (s, p) are the same as the least of them."""
    least = held.groupBy("s", "p").agg(F.min("o").alias("m"), F.max("o").alias("_x")).where("m <> _x").select(F.col("s").alias("s2"), F.col("p").alias("p2"), "m")
    return [_out(held.join(least, (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2"))).where("o <> m"), "m", SAME, "o")]


def _keys(t: Triples, lists: DataFrame, typed: DataFrame) -> DataFrame:
    """prp-key: instances that share a value of every key property are linked to the least of them.

    Keys are joined one position after the other, so that only instances that share the values so far go on: a tuple of
    values that no other instance has is dropped at the first position at which it is alone.
    """
    keys = t.named(_members(lists, t.p(OWL.hasKey)).select("owner", "n", "i", F.col("member").alias("kp")), "kp")
    have = t.all.join(keys, F.col("p") == F.col("kp")).join(typed, (F.col("s") == F.col("x")) & (F.col("owner") == F.col("c"))).select("owner", "n", "i", "o", "s").distinct()
    longest = keys.agg(F.max("n")).first()[0] or 0  # the length of the longest key of the schema
    tuples, done = None, []
    for i in range(longest):
        at = have.where(F.col("i") == i).select("owner", "n", "s", F.col("o").alias("v"))
        new = at.withColumn("key", F.col("v")) if tuples is None else tuples.join(at, ["owner", "n", "s"]).withColumn("key", F.concat("key", F.lit(" "), "v"))
        new = new.select("owner", "n", "s", "key")
        shared = new.groupBy("owner", "key").agg(F.min("s").alias("_a"), F.max("s").alias("_b")).where("_a <> _b").select("owner", "key")
        tuples = new.join(shared, ["owner", "key"], "left_semi")
        done.append(tuples.where(F.col("n") == i + 1))
    if not done:
        return _out(t.all.limit(0), "s", "p", "o")
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    return _stars(rows.select(F.col("owner").alias("p"), F.col("key").alias("s"), F.col("s").alias("o")))[0]


def _chains(t: Triples, lists: DataFrame) -> list[DataFrame]:
    """prp-spo2. The chains are schema: their number and lengths, which shape the plan, are read on the driver."""
    owners = t.p(OWL.propertyChainAxiom)
    rows = t.named(owners.join(lists, F.col("o") == F.col("list")).select(F.col("s").alias("sup"), "items"), "sup").collect()
    out = []
    for r in rows:
        props = [x[1:-1] for x in r["items"] if x.startswith("<")]
        if len(props) < 2:
            continue
        walk = t.p(props[0]).select(F.col("s").alias("start"), F.col("o").alias("end"))
        for p in props[1:]:
            walk = walk.join(_named(t.p(p), "via", "to"), F.col("end") == F.col("via")).select("start", F.col("to").alias("end"))
        out.append(_out(walk, "start", r["sup"], "end"))
    return out


def _new(rules: list[DataFrame], known: DataFrame) -> DataFrame:
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    found = found.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").where(_is_resource("s")).distinct()
    old = known.select(F.col("s").alias("x_s"), F.col("p").alias("x_p"), F.col("o").alias("x_o"))
    return found.join(old, F.expr("s = x_s AND p = x_p AND o = x_o"), "left_anti")


def rdfs_closure(ids: DataFrame, staging: Staging, materialize_schema: bool = False) -> Grown:
    """The triples, staged and distinct, with all that RDFS derives as further parts.

    One pass, as the schema is closed; others follow only where the schema speaks about rdf:type or about itself.
    """
    known, delta, gives, above = Grown(ids), ids, None, None
    vocabulary = vocabulary_of(ids)
    while vocabulary.intersection(SCHEMA_PREDICATES):
        if gives is None:
            gives, above = rdfs_schema(Triples(known.df, delta, vocabulary), staging)
            reflexive = gives.where((F.col("prop") == RDF.type) | ((F.col("kind") == 0) & F.col("value").isin(RDF.type, *SCHEMA_PREDICATES)))
            again = bool(reflexive.head(1))
        delta = staging.cut(_new(rdfs_rules(delta, (gives, above)), known.df))
        if not again:
            known.add(delta)
            break
        if not delta.head(1):
            break
        known.add(delta)
        if vocabulary_of(delta).intersection(SCHEMA_PREDICATES):
            vocabulary, gives, delta = vocabulary | vocabulary_of(delta), None, known.df
    if materialize_schema and above is not None:
        sub = above.select(F.col("sub").alias("s"), F.lit(RDFS.subClassOf).alias("p"), F.col("sup").alias("o"))
        prop = gives.where("kind = 0").select(F.concat(F.lit("<"), "prop", F.lit(">")).alias("s"), F.lit(RDFS.subPropertyOf).alias("p"), F.concat(F.lit("<"), "value", F.lit(">")).alias("o"))
        known.add(staging.cut(_new([sub, prop], known.df)))
    return known


def _merge(triples: DataFrame, edges: DataFrame, same: DataFrame | None, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """The triples over new representatives, and (member, rep) of all nodes that aren't their own.

    The representative is the least node of a group, but one of the W3C's vocabulary if there is any.
    """
    labels = contract(edges.select(F.col("s").alias("u"), F.col("o").alias("v")), staging)
    best = labels.groupBy("root").agg(F.min(F.struct((~F.col("v").startswith("<http://www.w3.org/")).alias("f"), "v")).alias("b")).select("root", F.col("b.v").alias("rep"))
    step = staging.cut(labels.join(best, "root").select(F.col("v").alias("member"), "rep").where("member <> rep"))
    if same is None:
        whole = step
    else:
        to = step.select(F.col("member").alias("old"), F.col("rep").alias("new"))
        whole = staging.cut(same.join(to, F.col("rep") == F.col("old"), "left").select("member", F.coalesce("new", "rep").alias("rep")).unionByName(step))
    for c in ("s", "o"):
        to = step.select(F.col("member").alias("old"), F.col("rep").alias("new"))
        triples = triples.join(to, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).select("s", "p", "o")
    return staging.cut(triples.distinct()), whole


def _written_out(triples: DataFrame, same: DataFrame) -> DataFrame:
    """The triples of representatives for all members, and that members are the same."""
    group = same.select("rep", "member").unionByName(same.select("rep", F.col("rep").alias("member")).distinct())
    out = triples.where(f"NOT (p = '{SAME}' AND s = o)")
    for c in ("s", "o"):
        g = group.select(F.col("rep").alias("_r"), F.col("member").alias("_m"))
        out = out.join(g, F.col(c) == F.col("_r"), "left").withColumn(c, F.coalesce("_m", c)).select("s", "p", "o")
    other = group.select("rep", F.col("member").alias("o"))
    pairs = group.join(other, "rep").where("member <> o").select(F.col("member").alias("s"), F.lit(SAME).alias("p"), "o")
    return out.unionByName(pairs)


def owl_closure(ids: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """The triples, staged and distinct, with all that RDFS and the supported OWL 2 RL rules derive; and the derived ones."""
    known, same = Grown(ids), None
    delta, vocabulary, schema, lists = ids, vocabulary_of(ids), None, None
    while True:
        edges = delta.where((F.col("p") == SAME) & (F.col("s") != F.col("o")) & _is_resource("o")) if SAME in vocabulary else None
        if edges is not None and edges.head(1):
            merged, same = _merge(known.df, edges, same, staging)
            known, delta, schema, lists = Grown(merged), merged, None, None
        t = Triples(known.df, delta, vocabulary, same)
        rules = []
        if vocabulary.intersection(SCHEMA_PREDICATES):
            if schema is None:
                schema = rdfs_schema(t, staging)
            rules += rdfs_rules(delta, schema)
        if lists is None and RDF.first in vocabulary and vocabulary.intersection((OWL.intersectionOf, OWL.unionOf, OWL.oneOf, OWL.hasKey, OWL.propertyChainAxiom)):
            cells = known.df.where(F.col("p").isin(RDF.first, RDF.rest)).select(F.struct(F.col("s").alias("id")).alias("s"), "p", F.struct(F.col("o").alias("id")).alias("o"))
            lists = staging.cut(collections(cells, staging))
        rules += owl_rules(t, lists)
        if not rules:
            break
        fresh = staging.cut(_new(rules, known.df))
        if not fresh.head(1):
            break
        known.add(fresh)
        delta, seen = fresh, vocabulary_of(fresh)
        if seen - {SAME}:  # the schema has grown: all triples meet it anew
            schema, lists, delta = None, None, known.df
        vocabulary = vocabulary | seen
    if same is None:
        return known.df, known.added
    out = staging.cut(_written_out(known.df, same).unionByName(ids).distinct())
    old = ids.select(F.col("s").alias("x_s"), F.col("p").alias("x_p"), F.col("o").alias("x_o"))
    return out, out.join(old, F.expr("s = x_s AND p = x_p AND o = x_o"), "left_anti")


def inconsistencies(ids: DataFrame, staging: Staging) -> DataFrame:
    """(rule, message) of every contradiction in a closed set of triples."""
    t = Triples(ids, ids, vocabulary_of(ids))
    types = _named(t.p(RDF.type), "x", "c")
    lists = None
    if t.has(OWL.members, RDF.first):
        cells = ids.where(F.col("p").isin(RDF.first, RDF.rest)).select(F.struct(F.col("s").alias("id")).alias("s"), "p", F.struct(F.col("o").alias("id")).alias("o"))
        lists = staging.cut(collections(cells, staging))
    found: list[DataFrame] = []

    def report(rule: str, df: DataFrame, *cols: str) -> None:
        found.append(df.select(F.lit(rule).alias("rule"), F.concat_ws(" ", *cols).alias("message")))

    a, two = ids, types.select(F.col("x").alias("x2"), F.col("c").alias("c2"))
    b = a.select(F.col("s").alias("s2"), F.col("p").alias("q2"), F.col("o").alias("o2"))
    disjoint_props = lambda rule, dis: report(rule, a.join(dis, a.p == F.col("p1")).join(b, F.expr("s = s2 AND o = o2 AND q1 = q2")), "s", "p", "q1", "o")
    disjoint = lambda rule, dis: report(rule, types.join(dis, F.col("c") == F.col("d1")).join(two, F.expr("x = x2 AND d2 = c2")), "x", "d1", "d2")
    pairs = lambda p, x, y: t.p(p).select(F.col("s").alias(x), F.col("o").alias(y))

    def listed(kind: str) -> DataFrame:
        """All pairs of members of the lists of a kind, which are schema."""
        of = types.where(F.col("c") == _iri(kind)).select(F.col("x").alias("k"))
        m = _members(lists, t.p(OWL.members).join(of, F.col("s") == F.col("k"), "left_semi"))
        n = m.select(F.col("owner").alias("owner2"), F.col("i").alias("i2"), F.col("member").alias("member2"))
        return m.join(n, F.expr("owner = owner2 AND i < i2")).select("member", "member2")

    if t.has(OWL.Nothing):
        report("cls-nothing2", types.where(F.col("c") == _iri(OWL.Nothing)), "x")
    if t.has(OWL.IrreflexiveProperty):
        report("prp-irp", a.where("s = o").join(_props_of(t, OWL.IrreflexiveProperty), a.p == F.col("prop"), "left_semi"), "s", "p")
    if t.has(OWL.AsymmetricProperty):
        asym = a.join(_props_of(t, OWL.AsymmetricProperty), a.p == F.col("prop"), "left_semi")
        back = asym.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        report("prp-asyp", asym.join(back, F.expr("s = o2 AND o = s2 AND p = p2")).where("s <= o"), "s", "p", "o")
    if t.has(OWL.propertyDisjointWith):
        disjoint_props("prp-pdw", t.named(pairs(OWL.propertyDisjointWith, "p1", "q1"), "p1", "q1"))
    if t.has(OWL.AllDisjointProperties) and lists is not None:
        disjoint_props("prp-adp", t.named(listed(OWL.AllDisjointProperties).toDF("p1", "q1"), "p1", "q1"))
    if t.has(OWL.disjointWith):
        disjoint("cax-dw", pairs(OWL.disjointWith, "d1", "d2"))
    if t.has(OWL.AllDisjointClasses) and lists is not None:
        disjoint("cax-adc", listed(OWL.AllDisjointClasses).toDF("d1", "d2"))
    if t.has(OWL.complementOf):
        disjoint("cls-com", pairs(OWL.complementOf, "d1", "d2"))
    if t.has(OWL.sameAs, OWL.differentFrom):
        diff = _both_ways(pairs(OWL.differentFrom, "x2", "y2"), "x2", "y2")
        report("eq-diff1", pairs(SAME, "x", "y").join(diff, F.expr("x = x2 AND y = y2")).where("x <= y"), "x", "y")
    if t.has(OWL.onProperty):
        on = t.named(pairs(OWL.onProperty, "r", "rp"), "rp")
        zero = lambda p: t.p(p).where(F.col("o").rlike('^("0+"|[+-]?0+$)')).select(F.col("s").alias("r"))
        if t.has(OWL.maxCardinality):
            none = on.join(zero(OWL.maxCardinality), "r").join(types, F.col("r") == F.col("c"))
            report("cls-maxc1", a.join(none, F.expr("s = x AND p = rp")), "s", "p", "o")
        if t.has(OWL.maxQualifiedCardinality, OWL.onClass):
            noneq = on.join(zero(OWL.maxQualifiedCardinality), "r").join(pairs(OWL.onClass, "r", "q"), "r").join(types, F.col("r") == F.col("c"))
            held = a.join(noneq, F.expr("s = x AND p = rp")).select("s", "p", "o", "q")
            report("cls-maxqc1", held.join(two, F.expr("o = x2 AND q = c2"), "left_semi"), "s", "p", "o")
            report("cls-maxqc2", held.where(F.col("q") == _iri(OWL.Thing)), "s", "p", "o")
    if t.has(OWL.sourceIndividual, OWL.assertionProperty):
        src = t.p(OWL.sourceIndividual).select(F.col("s").alias("n"), F.col("o").alias("ns"))
        prop = t.named(t.p(OWL.assertionProperty).select(F.col("s").alias("n"), F.col("o").alias("np")), "np")
        for rule, target in (("prp-npa1", OWL.targetIndividual), ("prp-npa2", OWL.targetValue)):
            if t.has(target):
                npa = src.join(prop, "n").join(t.p(target).select(F.col("s").alias("n"), F.col("o").alias("no")), "n")
                report(rule, a.join(npa, F.expr("s = ns AND p = np AND o = no"), "left_semi"), "s", "p", "o")
    if not found:
        return ids.sparkSession.createDataFrame([], "rule string, message string")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def expand(quads: DataFrame, regimes: set[str] | frozenset[str] = frozenset({"rdfs"}), materialize_schema: bool = False, staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The triples that hold under the regimes (``rdfs``, ``owlrl``), those that were added, and the inconsistencies.

    The input's graphs count as one. The results have term structs s and o; the third is (rule, message), and empty
    without ``owlrl``. Closing a closed graph adds nothing.
    """
    staging = staging or Staging(quads.sparkSession, "reasoning")
    ids = staging.cut(_ids(quads).distinct())
    if "owlrl" in regimes:
        closed, added = owl_closure(ids, staging)
        bad = inconsistencies(closed, staging)
    else:
        known = rdfs_closure(ids, staging, materialize_schema)
        closed, added, bad = known.df, known.added, quads.sparkSession.createDataFrame([], "rule string, message string")
    as_terms = lambda df: df.select(term_of_id(F.col("s")).alias("s"), "p", term_of_id(F.col("o")).alias("o"))
    return as_terms(closed), as_terms(added), bad


__all__ = ["expand", "rdfs_closure", "owl_closure", "inconsistencies", "XSD"]
