"""Shapes, read on the driver from a shapes graph of quads."""

from __future__ import annotations

from dataclasses import dataclass, field

from quadloom.functions.terms import BNODE, IRI, LITERAL, Term, triple_term
from quadloom.functions.vocab import OWL, RDF, RDFS, SH, SHNEX, XSD
from quadloom.sparql.ast import Alternative, Inverse, Link, Repeat, Sequence


class ShapeError(ValueError):
    pass


class ShapesGraph:
    """Index of the shapes graph's triples, which are few."""

    def __init__(self, quads: list):
        self.of: dict[str, dict[str, list[Term]]] = {}
        self.triples = []
        seen = set()
        for _, s, p, o in quads:
            key = (s.id, p.lex, o.id)
            if key not in seen:
                seen.add(key)
                self.of.setdefault(s.id, {}).setdefault(p.lex, []).append(o)
                self.triples.append((s, p, o))
        self.term = {s.id: s for s, _, _ in self.triples}

    def all(self, s: Term, p: str) -> list[Term]:
        return self.of.get(s.id, {}).get(p, [])

    def one(self, s: Term, p: str) -> Term | None:
        return next(iter(self.all(s, p)), None)

    def list(self, head: Term) -> list[Term]:
        out, seen = [], set()
        while head.lex != RDF.nil and head.id not in seen:
            seen.add(head.id)
            first = self.one(head, RDF.first)
            if first is None:
                break
            out.append(first)
            head = self.one(head, RDF.rest) or Term(IRI, RDF.nil)
        return out

    def subjects(self, p: str, o: str | None = None) -> list[Term]:
        return [s for s, q, x in self.triples if q.lex == p and (o is None or x.lex == o)]

    def path(self, node: Term):
        """A property path of the algebra."""
        if node.kind == IRI:
            return Link(node.lex)
        for p, make in (
            (SH.inversePath, lambda x: Inverse(self.path(x))), (SH.alternativePath, lambda x: Alternative(tuple(map(self.path, self.list(x))))),
            (SH.zeroOrMorePath, lambda x: Repeat(self.path(x), 0, None)), (SH.oneOrMorePath, lambda x: Repeat(self.path(x), 1, None)), (SH.zeroOrOnePath, lambda x: Repeat(self.path(x), 0, 1)),
        ):
            x = self.one(node, p)
            if x is not None:
                return make(x)
        items = self.list(node)
        if not items:
            raise ShapeError(f"{node} is no path")
        return Sequence(tuple(map(self.path, items)))


@dataclass
class Constraint:
    kind: str
    value: object
    component: str
    extra: dict = field(default_factory=dict)


@dataclass
class Shape:
    id: Term
    path: object = None
    path_id: str | None = None
    targets: list = field(default_factory=list)  # (kind, value)
    constraints: list[Constraint] = field(default_factory=list)
    severity: str = SH.Violation
    messages: list[Term] = field(default_factory=list)
    deactivated: bool = False
    values: Term | None = None


#: Local names of constraint parameters that take one value each.
_SIMPLE = "class datatype nodeKind minCount maxCount minExclusive minInclusive maxExclusive maxInclusive minLength maxLength equals disjoint lessThan lessThanOrEquals hasValue node not someValue subsetOf memberShape minListLength maxListLength expression nodeByExpression".split()
_LISTS = "in languageIn and or xone".split()
_FLAGS = "uniqueLang singleLine uniqueMembers".split()


class Shapes:
    """All shapes of a shapes graph, and the SPARQL constraint components it declares."""

    def __init__(self, quads: list):
        self.graph = g = ShapesGraph(quads)
        self.by_id: dict[str, Shape] = {}
        self.components = self._components()
        roots = [s for kind in (SH.NodeShape, SH.PropertyShape) for s in g.subjects(RDF.type, kind)]
        for p in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "target", "targetWhere", "property"):
            roots += g.subjects(SH[p])
        for s in roots:
            self.shape(s)

    def shape(self, node: Term) -> Shape:
        if node.id in self.by_id:
            return self.by_id[node.id]
        g = self.graph
        s = self.by_id[node.id] = Shape(node)
        path = g.one(node, SH.path)
        if path is not None:
            s.path, s.path_id = g.path(path), path.id
        s.values = g.one(node, SH.values)
        s.deactivated = any(x.lex == "true" for x in g.all(node, SH.deactivated))
        s.severity = (g.one(node, SH.severity) or Term(IRI, SH.Violation)).lex
        s.messages = g.all(node, SH.message)
        for name in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf", "targetWhere"):
            s.targets += [(name, x) for x in g.all(node, SH[name])]
        s.targets += [("sparql", x) for x in g.all(node, SH.target)]
        types = {t.lex for t in g.all(node, RDF.type)}
        if types & {RDFS.Class, OWL.Class} and node.kind == IRI or SH.ShapeClass in types:
            s.targets.append(("targetClass", node))
        add = lambda kind, value, component, **extra: s.constraints.append(Constraint(kind, value, SH[component + "ConstraintComponent"], self._annotated(node, kind, value, extra)))
        cap = lambda n: n[0].upper() + n[1:]
        for n in _SIMPLE:
            for v in g.all(node, SH[n]):
                if n in ("class", "datatype", "nodeKind") and v.kind == BNODE:
                    v = g.list(v)
                add(n, v, cap(n))
        for n in _LISTS:
            for v in g.all(node, SH[n]):
                add(n, g.list(v), cap(n))
        for n in _FLAGS:
            if any(v.lex == "true" for v in g.all(node, SH[n])):
                add(n, True, cap(n))
        flags = g.one(node, SH.flags)
        for v in g.all(node, SH.pattern):
            add("pattern", v, "Pattern", flags=flags.lex if flags else "")
        for v in g.all(node, SH.property):
            add("property", v, "Property")
        for v in g.all(node, SH.qualifiedValueShape):
            disjoint = any(x.lex == "true" for x in g.all(node, SH.qualifiedValueShapesDisjoint))
            for n in ("qualifiedMinCount", "qualifiedMaxCount"):
                for c in g.all(node, SH[n]):
                    add(n, v, cap(n), count=int(c.lex), disjoint=disjoint)
        for v in g.all(node, SH.closed):
            if v.lex in ("true", SH.ByTypes):
                ignored = g.one(node, SH.ignoredProperties)
                add("closed", v.lex, "Closed", ignored=[x.lex for x in g.list(ignored)] if ignored else [])
        for v in g.all(node, SH.reifierShape):
            add("reifierShape", v, "ReifierShape", required=any(x.lex == "true" for x in g.all(node, SH.reificationRequired)))
        for v in g.all(node, SH.sparql):
            if not any(x.lex == "true" for x in g.all(v, SH.deactivated)):
                s.constraints.append(Constraint("sparql", v, SH.SPARQLConstraintComponent))
        for c in self.components:
            given = {name: g.one(node, iri) for iri, name, _ in c["parameters"]}
            if all(given[name] is not None for _, name, optional in c["parameters"] if not optional) and any(v is not None for v in given.values()):
                s.constraints.append(Constraint("component", c, c["id"].lex, {"arguments": {k: v for k, v in given.items() if v is not None}}))
        return s

    def _annotated(self, node: Term, kind: str, value, extra: dict) -> dict:
        """Severity, message and deactivation that a reifier of the constraint's triple states."""
        if isinstance(value, Term):
            t = triple_term(node, Term(IRI, SH[kind]), value)
            for r in [s for s, p, o in self.graph.triples if p.lex == RDF.reifies and o.id == t.id]:
                for name in ("severity", "message", "deactivated"):
                    x = self.graph.one(r, SH[name])
                    if x is not None:
                        extra[name] = x
        return extra

    def _components(self) -> list[dict]:
        g, out = self.graph, []
        for c in g.subjects(RDF.type, SH.ConstraintComponent):
            parameters = []
            for p in g.all(c, SH.parameter):
                iri = g.one(p, SH.path).lex
                optional = any(x.lex == "true" for x in g.all(p, SH.optional))
                parameters.append((iri, iri.rsplit("#", 1)[-1].rsplit("/", 1)[-1], optional))
            out.append({"id": c, "parameters": parameters, "validator": g.one(c, SH.validator), "node": g.one(c, SH.nodeValidator), "property": g.one(c, SH.propertyValidator)})
        return out

    def prefixes(self, node: Term) -> dict[str, str]:
        """The prefixes that sh:prefixes declares, through owl:imports, besides the usual ones."""
        out = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "sh": SH}
        queue, seen = list(self.graph.all(node, SH.prefixes)), set()
        while queue:
            x = queue.pop()
            if x.id in seen:
                continue
            seen.add(x.id)
            for d in self.graph.all(x, SH.declare):
                out[self.graph.one(d, SH.prefix).lex] = self.graph.one(d, SH.namespace).lex
            queue += self.graph.all(x, OWL.imports)
        return {k: str(v) for k, v in out.items()}

    def siblings(self, parent_property: Shape, value_shape: Term) -> list[Term]:
        """The other qualified value shapes of the property shapes beside this one."""
        out = []
        for s, p, o in self.graph.triples:
            if p.lex == SH.property and o.id == parent_property.id.id:
                for sibling in self.graph.all(s, SH.property):
                    out += [q for q in self.graph.all(sibling, SH.qualifiedValueShape) if q.id != value_shape.id]
        return list({q.id: q for q in out}.values())


__all__ = ["Constraint", "LITERAL", "SHNEX", "Shape", "ShapeError", "Shapes", "ShapesGraph"]
