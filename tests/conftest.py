import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


EX = "http://example.org/"
HEAD = """@prefix ex: <http://example.org/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix shnex: <http://www.w3.org/ns/shacl-node-expr#> .
"""


@pytest.fixture(scope="session")
def graph(spark):
    """A function from Turtle (with the usual prefixes) to a quads DataFrame."""
    from quadloom.sources.io import parse_text

    return lambda text, format="turtle": parse_text(spark, HEAD + text, format)


@pytest.fixture(scope="session")
def short():
    """An id without the example namespace."""

    def f(x):
        return None if x is None else x.replace(f"<{EX}", "").rstrip(">") if x.startswith(f"<{EX}") else x.replace(EX, "")

    return f
