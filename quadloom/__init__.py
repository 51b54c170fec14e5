"""quadloom: RDF-style graph analytics compiled to Spark DataFrame plans."""

import importlib

#: Public names by module, loaded when they are first used.
_PUBLIC = {
    "quadloom.plans.dataset": ("Collection", "Dataset", "Resource"),
    "quadloom.plans.graphs": ("ClassMap", "QuadGraph", "VirtualGraph", "frame_of_terms", "map_table"),
    "quadloom.functions.terms": ("Term", "bnode", "iri", "literal", "parse_id", "triple_term"),
    "quadloom.functions.vocab": ("DC", "DCAT", "DCTERMS", "FOAF", "OWL", "PROV", "Prefixes", "RDF", "RDFS", "SH", "SKOS", "SOSA", "SSN", "VOID", "XSD"),
    "quadloom.functions.library": ("register_function",),
    "quadloom.sparql.parser": ("parse_query", "parse_update"),
    "quadloom.sparql.compiler": ("Result", "run_query"),
    "quadloom.operators.paths": ("Path", "link", "none_of"),
    "quadloom.operators.graph_ops": ("all_nodes", "collections", "connected", "difference", "intersection", "union"),
    "quadloom.operators.isomorphism": ("isomorphic",),
    "quadloom.reasoning.rules": ("expand",),
    "quadloom.shacl.validate": ("Report", "validate"),
    "quadloom.shacl.rules": ("RuleSet",),
    "quadloom.sources.io": ("detect", "parse_text", "read", "register_parser", "register_serializer", "serialize", "write"),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(_WHERE[name]), name)
    raise AttributeError(name)
