from pyspark.sql import functions as F

import __spark_entry__ as entry
from mosaicry.operators.facts import prefer, resolve_links, same_set_key


def test_entry_runs_and_every_sql_has_a_query(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 45
    df = entry.entry(spark)
    assert df.columns == ["kind", "key_a", "key_b"] and df.count() > 0


def test_links_and_sets(spark):
    rows = [("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C"), ("d", "zz", "D"), ("e", None, None)]
    got = {r["key"]: r["chain"] for r in resolve_links(spark.createDataFrame(rows, "k string, p string, n string"), "k", "p", "n").collect()}
    assert got == {"a": "A > B > C", "b": "B > C > A", "c": "C > A > B", "d": "D", "e": ""}
    s = spark.createDataFrame([(["B", " a", "b", None, ""],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in s.select(same_set_key(F.col("t"))).collect()] == ["a|b", "", ""]


def test_prefer_takes_the_first_by_order(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "y", None), (4, "x", 1)], "id int, g string, v int")
    assert {tuple(r) for r in prefer(df, ["g"], [F.col("v"), F.col("id")]).collect()} == {(2, "x", 1), (3, "y", None)}
    assert prefer(df.limit(0), ["g"], [F.col("v")]).count() == 0
