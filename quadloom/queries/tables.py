"""The driver's tables as one virtual graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quadloom.plans.graphs import VirtualGraph, map_table

NS = "http://ex.org/t#"
BASE = "http://ex.org/"
PREFIX = f"PREFIX : <{NS}>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
#: table: (class, key columns, links by name: (column, target table))
TABLES = {
    "region": ("Region", ["r_regionkey"], {}),
    "nation": ("Nation", ["n_nationkey"], {"n_region": ("n_regionkey", "region")}),
    "customer": ("Customer", ["c_custkey"], {"c_nation": ("c_nationkey", "nation")}),
    "supplier": ("Supplier", ["s_suppkey"], {"s_nation": ("s_nationkey", "nation")}),
    "part": ("Part", ["p_partkey"], {}),
    "orders": ("Order", ["o_orderkey"], {"o_customer": ("o_custkey", "customer")}),
    "lineitem": ("Lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")}),
    "events": ("Event", ["event_id"], {}),
    "documents": ("Document", ["doc_id"], {}),
}


def virtual_graph(spark: SparkSession, d: str, only: tuple[str, ...] = tuple(TABLES)) -> VirtualGraph:
    classes = []
    for t in only:
        cls, key, links = TABLES[t]
        targets = {name: (column, f"{BASE}{to}/") for name, (column, to) in links.items()}
        classes.append(map_table(spark.read.parquet(f"{d}/{t}.parquet"), NS + cls, f"{BASE}{t}/", key, NS, targets))
    return VirtualGraph(classes)
