"""A remote SPARQL endpoint as a Spark data source.

    spark.dataSource.register(SparqlEndpoint)
    spark.read.format("sparql").option("url", ...).load()

Each predicate in the option ``predicates`` (separated by blanks) is a partition; without it there is one. With
``page_size`` the endpoint is asked for counts, and every page of so many ordered solutions is a partition of its own. The
options ``subject`` and ``object`` (N3) and ``graph`` bind the pattern; with ``pushdown`` = true, which Spark allows where
``spark.sql.python.filterPushdown.enabled`` is set, equalities on s.id, p, o.id and g do the same. Blank nodes can't be asked for by label and are filtered here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from quadloom.functions.terms import QUADS, parse_id


def select(url: str, query: str, timeout: float = 60.0):
    """The variables and solutions (or the truth value) that an endpoint answers."""
    import urllib.parse
    import urllib.request

    from quadloom.sources.results import parse_json_results, parse_xml_results

    data = urllib.parse.urlencode({"query": query}).encode()
    request = urllib.request.Request(url, data, {"Accept": "application/sparql-results+json, application/sparql-results+xml;q=0.8"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        text = r.read().decode("utf-8")
        return parse_xml_results(text) if "xml" in (r.headers.get("Content-Type") or "") else parse_json_results(text)


class _Part(InputPartition):
    def __init__(self, predicate: str | None, limit: int | None = None, offset: int = 0):
        self.predicate, self.limit, self.offset = predicate, limit, offset


class _EndpointReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.graph = options["url"], options.get("graph")
        self.predicates = (options.get("predicates") or "").split()
        self.ends = {"s": options.get("subject"), "o": options.get("object")}
        self.page_size = int(options.get("page_size") or 0)
        self.nothing = False

    def _bind(self, attribute: tuple[str, ...], value: str) -> bool:
        """Whether an equality now is part of the query."""
        if attribute == ("p",):
            self.nothing |= bool(self.predicates) and value not in self.predicates
            self.predicates = [value]
        elif attribute == ("g",):
            self.nothing |= self.graph not in (None, value)
            self.graph = value
        elif attribute in (("s", "id"), ("o", "id")) and not value.startswith("_:"):
            self.nothing |= self.ends[attribute[0]] not in (None, value)
            self.ends[attribute[0]] = value
        else:
            return False
        return True

    def _where(self, predicate: str | None) -> str:
        pattern = f"{self.ends['s'] or '?s'} {f'<{predicate}>' if predicate else '?p'} {self.ends['o'] or '?o'}"
        return f"GRAPH <{self.graph}> {{ {pattern} }}" if self.graph else pattern

    def partitions(self):
        if self.nothing:
            return []
        whole = [_Part(p) for p in self.predicates] or [_Part(None)]
        if not self.page_size:
            return whole
        pages = []
        for part in whole:
            count = int(select(self.url, f"SELECT (COUNT(*) AS ?n) WHERE {{ {self._where(part.predicate)} }}")[1][0]["n"].lex)
            pages += [_Part(part.predicate, self.page_size, at) for at in range(0, count, self.page_size)]
        return pages

    def read(self, part):
        if part is None:  # no partition at all
            return
        order = f" ORDER BY ?s ?p ?o LIMIT {part.limit} OFFSET {part.offset}" if part.limit else ""
        _, rows = select(self.url, f"SELECT * WHERE {{ {self._where(part.predicate)} }}{order}")
        s, o = ({x: parse_id(v) if v else None for x, v in self.ends.items()}[x] for x in ("s", "o"))
        for r in rows:
            yield (self.graph, (s or r["s"]).row(), part.predicate or r["p"].lex, (o or r["o"]).row())


class _PushingReader(_EndpointReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not (isinstance(f, EqualTo) and self._bind(tuple(f.attribute), f.value)):
                yield f


class SparqlEndpoint(DataSource):
    @classmethod
    def name(cls):
        return "sparql"

    def schema(self):
        return QUADS

    def reader(self, schema):
        return (_PushingReader if self.options.get("pushdown") == "true" else _EndpointReader)(self.options)
