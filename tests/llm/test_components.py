import random

import pytest

from quadloom.llm.components import group_pairs


def union_find(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def chain(n, prefix):
    ids = [f"{prefix}{i * 7919 % n:05d}" for i in range(n)]
    return list(zip(ids, ids[1:]))


def ring(n, prefix):
    return chain(n, prefix) + [(chain(n, prefix)[-1][1], chain(n, prefix)[0][0])]


r = random.Random(4)
GRAPHS = {
    "empty": [],
    "odd": [("a", "a"), ("b", None), (None, "c"), (None, None), ("d", "e"), ("e", "d"), ("d", "e")],
    "chains and rings": chain(150, "c") + ring(41, "r") + ring(2, "two") + ring(3, "tri"),
    "star": [("hub", f"leaf{i}") for i in range(200)] + [("z", "hub")],
    "lollipop": ring(20, "l") + [("l00000", "m0")] + chain(30, "m0") + [("m0", "m000000")],
    "tree": [(f"t{i}", f"t{i // 2}") for i in range(2, 260)],
    "tangle": [(f"x{r.randrange(90):02d}", f"x{r.randrange(90):02d}") for _ in range(100)] + [(f"y{r.randrange(30)}", f"y{r.randrange(30)}") for _ in range(150)],
    "bridge": [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)] + [(f"q{i}", f"q{j}") for i in range(6) for j in range(i)] + [("k3", "b1"), ("b1", "b2"), ("b2", "q4")],
    "parallel chains": [("s", "a1"), ("a1", "a2"), ("a2", "e"), ("s", "b1"), ("b1", "e"), ("s", "e"), ("s", "c1"), ("c1", "s2"), ("s2", "s")],
    "like ids": [("<http://a/1>", "<http://a/1 >"), ("<http://A/1>", "<http://a/2>"), ("é", "é")],
}


@pytest.mark.parametrize("name", ["empty", "odd"])
def test_small(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "s string, o string")
    assert {x.node: x.group_id for x in group_pairs(df, "s", "o").collect()} == union_find(GRAPHS[name])


def test_all_shapes_at_once(spark):
    """Node names are prefixed by graph, so that one run covers every shape."""
    pairs = [(f"{n}/{a}", f"{n}/{b}") for n, g in GRAPHS.items() if n != "odd" for a, b in g]
    r.shuffle(pairs)
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], "s string, o string, n int, node string")
    got = group_pairs(df, "s", "o").collect()
    assert {x.node: x.group_id for x in got} == union_find(pairs) and len(got) == len(union_find(pairs))
