import pytest
from pyspark.sql import functions as F

from mosaicry.operators.review import counted_terms, done_counts, merged_taxonomy, page, path_tree, stage_plan, status_counts, taxonomy, validated
from mosaicry.operators.rules import standard_rules
from mosaicry.operators.scope import FileScope
from mosaicry.plans.exports import EXPORTS, export_all


def test_files_against_a_folder(spark):
    files = [(1, "/a", "x"), (2, "/b", "y"), (3, "/c", "x"), (4, "/d", None), (5, "/e", None), (6, "/f", "z"), (7, "/g", "z"), (1, "/a", "x"), (None, "/h", "x"), (8, "/i", "q")]
    now = [("/a", "x"), ("/b", "other"), ("/d", "any"), ("/f", None), ("/a", "x"), (None, "x"), ("/new", "q")]
    f, p = spark.createDataFrame(files, "id long, path string, sha256 string"), spark.createDataFrame(now, "path string, sha256 string")
    got = {r["id"]: (r["status"], r["detail"]) for r in validated(f, p).collect()}
    assert got == {1: ("ok", None), 2: ("changed", "other"), 3: ("moved", "/a"), 4: ("ok", None), 5: ("missing", None), 6: ("ok", None), 7: ("moved", "/f"), 8: ("missing", None)}
    assert validated(f.limit(0), p).count() == 0 and {r["status"] for r in validated(f, p.limit(0)).collect()} == {"missing"}


def test_pages_and_counts(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", "pending" if i % 2 else "accepted") for i in range(40)] + [(99, None, "pending")], "id long, term string, status string")
    t = counted_terms(df, "term", "id", ["status"])
    assert t.count() == 7 and {r["file_count"] for r in t.collect()} == {5, 6}
    pages = [[r["term"] for r in page(t, [F.desc("file_count"), F.asc("term")], 3, o).orderBy("place").collect()] for o in (0, 3, 6, 9)]
    assert pages == [["t0", "t1", "t2"], ["t3", "t4", "t5"], ["t6"], []]
    assert tuple(status_counts(df, "term", "status", {"open": ["pending"], "none": ["x"]}).first()) == (7, 7, 0)
    assert tuple(done_counts(df.select("id").distinct(), spark.createDataFrame([(1,), (1,), (500,)], "file_id long")).first()) == (41, 1, 40)


def test_trees_and_taxonomies(spark):
    p = spark.createDataFrame([("Wild::Bear",), ("Nature::Wild::Bear",), ("Wild::Bear",), ("alone",), ("a::b::c::d",), (None,)], "p string")
    assert {tuple(r) for r in path_tree(p, "p").collect()} == {("Wild", None, "Bear"), ("Nature", "Wild", "Bear")}
    rules = spark.createDataFrame([(r["category"], r["result_tag"]) for r in standard_rules()], "category string, tag string")
    t = taxonomy(("Tags", rules, F.initcap("category"), F.col("tag")), ("Keys", p, F.lit(None).cast("string"), F.col("p")))
    assert t.filter("section = 'Tags'").count() == len({(r["category"], r["result_tag"]) for r in standard_rules()})
    old = spark.createDataFrame([("s", "b", "z", 0), ("s", "b", "a", 1), ("own", None, "k", 0)], "section string, branch string, leaf string, place long")
    new = spark.createDataFrame([("s", "b", "m"), ("s", "b", "a"), ("s", "b", "c"), ("own", None, "k"), ("fresh", None, "x")], "section string, branch string, leaf string")
    got = {(r["section"], r["branch"], r["leaf"]): r["place"] for r in merged_taxonomy(old, new).collect()}
    assert got == {("s", "b", "z"): 0, ("s", "b", "a"): 1, ("s", "b", "c"): 2, ("s", "b", "m"): 3, ("own", None, "k"): 0, ("fresh", None, "x"): 0}


def test_plans_of_stages():
    needs = {"scan": [], "hash": ["scan"], "text": ["hash"], "voice": ["hash"], "join": ["text", "voice"], "loop": ["loop"]}
    assert stage_plan(needs, "join") == ["scan", "hash", "text", "voice", "join"]
    assert stage_plan(needs, "join", {"scan", "text"}, {"join": "review"}) == ["hash", "voice", "gate:review", "join"]
    assert stage_plan(needs, "join", {"review", "join"}, {"join": "review"}) == ["scan", "hash", "text", "voice"] and stage_plan(needs, "loop") == ["loop"]
    with pytest.raises(ValueError):
        stage_plan(needs, "nothing")


def test_exports_are_written_for_the_scope(spark, tmp_path):
    names = export_all(spark, "/root/testdata/sf0.001", str(tmp_path), FileScope(file_type="image"))
    assert names == list(EXPORTS)
    images = {str(r["id"]) for r in spark.read.parquet("/root/testdata/sf0.001/files.parquet").filter("file_type = 'image'").collect()}
    rows = spark.read.csv(f"{tmp_path}/hashes", header=True).collect()
    assert {r["file_id"] for r in rows} == images
    assert spark.read.csv(f"{tmp_path}/people", header=True).columns[:2] == ["id", "preferred_name"]
