"""Namespaces."""


class Namespace(str):
    """An IRI prefix: ``RDF.type``, ``RDF["type"]``."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return str(self) + name

    def __getitem__(self, name):
        return str(self) + name if isinstance(name, str) else str.__getitem__(self, name)


class ClosedNamespace(Namespace):
    """A namespace that knows all its names."""

    def __new__(cls, base: str, names: str):
        self = super().__new__(cls, base)
        self.names = frozenset(names.split())
        return self

    def __getattr__(self, name: str) -> str:
        if name.startswith("__") or name == "names":
            raise AttributeError(name)
        if name not in self.names:
            raise AttributeError(f"{name} is no term of {str(self)}")
        return str(self) + name

    def __getitem__(self, name):
        return getattr(self, name)


# Published namespace IRIs.
RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Namespace("http://www.w3.org/2000/01/rdf-schema#")
OWL = Namespace("http://www.w3.org/2002/07/owl#")
XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
SH = Namespace("http://www.w3.org/ns/shacl#")
FOAF = Namespace("http://xmlns.com/foaf/0.1/")
DC = Namespace("http://purl.org/dc/elements/1.1/")
DCTERMS = Namespace("http://purl.org/dc/terms/")
SKOS = Namespace("http://www.w3.org/2004/02/skos/core#")
PROV = Namespace("http://www.w3.org/ns/prov#")
SOSA = Namespace("http://www.w3.org/ns/sosa/")
SSN = Namespace("http://www.w3.org/ns/ssn/")
DCAT = Namespace("http://www.w3.org/ns/dcat#")
VOID = Namespace("http://rdfs.org/ns/void#")
SHNEX = Namespace("http://www.w3.org/ns/shacl-node-expr#")

DEFAULT_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL}
INTEGER_TYPES = tuple(
    XSD[x] for x in "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
)
NUMERIC_TYPES = (*INTEGER_TYPES, XSD.decimal, XSD.double, XSD.float)


class Prefixes:
    """Bindings of prefixes to namespaces, with compact names of IRIs."""

    def __init__(self, bindings: dict[str, str] | None = None):
        self.of = {k: str(v) for k, v in {**DEFAULT_PREFIXES, **(bindings or {})}.items()}

    def bind(self, prefix: str, namespace: str, override: bool = True) -> None:
        if override or prefix not in self.of:
            self.of[prefix] = str(namespace)

    def namespace(self, prefix: str) -> str | None:
        return self.of.get(prefix)

    def prefix(self, namespace: str) -> str | None:
        return next((p for p, n in self.of.items() if n == namespace), None)

    def expand(self, curie: str) -> str:
        prefix, _, local = curie.partition(":")
        if prefix not in self.of:
            raise KeyError(f"prefix {prefix!r} isn't bound")
        return self.of[prefix] + local

    def qname(self, iri: str) -> str | None:
        """prefix:local by the longest namespace that leaves a simple local name; None if there is none."""
        best = max(((n, p) for p, n in self.of.items() if n and iri.startswith(n)), key=lambda x: len(x[0]), default=None)
        if best is None:
            return None
        local = iri[len(best[0]) :]
        simple = local == "" or (local[0].isalnum() or local[0] == "_") and all(c.isalnum() or c in "_-." for c in local) and not local.endswith(".")
        return f"{best[1]}:{local}" if simple else None


def split_iri(iri: str) -> tuple[str, str]:
    """The namespace and the local name of an IRI: split after the last #, / or :, past which a name starts with a letter."""
    at = max(iri.rfind(c) for c in "#/:") + 1
    while at < len(iri) and not (iri[at].isalpha() or iri[at] == "_"):
        at += 1
    return iri[:at], iri[at:]
