import random

from mosaicry.operators.components import connected_components
from mosaicry.operators.skew import left_join, salted_join


def brute(edges):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {n: find(n) for n in par}


def test_components_of_chains_hubs_and_random_links(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:9] + [(5000, 5000), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join_meets_each_pair_once(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 7), (None, 8)], "k int, x int")
    right = spark.createDataFrame([(1, i) for i in range(9)] + [(3, 1), (None, 2)], "k int, y int")
    for block in (10, 1000):
        got = sorted((r["x"], r["y"]) for r in salted_join(left, right, "k", "x", block).collect())
        assert got == sorted((i, j) for i in range(100) for j in range(9))


def test_left_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(None, i) for i in range(50)] + [(1, 100), (2, 101)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, y string")
    got = {(r["k"], r["x"], r["y"]) for r in left_join(left, right, "k", "x").collect()}
    assert got == {(None, i, None) for i in range(50)} | {(1, 100, "a"), (2, 101, None)}
