import difflib
import itertools
import random

from pyspark.sql import functions as F

from mosaicry.operators.facts import coverage, first_known, json_facts, pivot_max, trimmed_centroids
from mosaicry.operators.graph import communities, dbscan, npmi_edges
from mosaicry.operators.hashes import canonical_ids, greedy_groups
from mosaicry.operators.matching import alike_candidates, best_overlap, mentions, nearest_place, places_within, similar_names
from mosaicry.operators.ranking import combined_rank, distributed_rank, quality_rank
from mosaicry.operators.rules import apply_rules, normalised_name, standard_rules
from mosaicry.operators.scope import FileScope, having_any, originals, pending, upsert


def test_rank_equals_sorting(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), rnd.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r["id"]: (r["rank"], r["n"]) for r in distributed_rank(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    for g in "ab":
        s = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert all(got[r[0]] == (i, len(s)) for i, r in enumerate(s))
    assert distributed_rank(df.limit(0), ["g"], [F.asc("v")]).count() == 0


def test_combined_and_quality_ranks(spark):
    s = [(1, "m", 0.1), (2, "m", 0.5), (3, "m", 0.9), (1, "n", 0.9), (3, "n", 0.2), (4, "n", None)]
    got = {r["file_id"]: (r["score"], r["band"]) for r in combined_rank(spark.createDataFrame(s, "file_id long, model_name string, score double")).collect()}
    assert got == {1: (0.5, "good"), 3: (0.5, "good")}
    assert combined_rank(spark.createDataFrame(s[:3], "file_id long, model_name string, score double")).count() == 0
    q = spark.createDataFrame([(1, 5.0, 0.5, 0.0, 0.0), (2, 9.0, 1.0, 0.2, 0.0)], "file_id long, sharpness double, exposure double, highlights double, shadows double")
    assert {r["id"]: round(r["quality_rank"], 6) for r in quality_rank(q).collect()} == {1: 0.75, 2: 0.7}


def greedy(rows, most):
    left = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    out = {}
    for r in left:
        if r[0] in out:
            continue
        out[r[0]] = r[0]
        for o in left:
            if o[0] not in out and (int(r[1], 16) ^ int(o[1], 16)).bit_count() <= most:
                out[o[0]] = r[0]
    size = list(out.values())
    return {i: s for i, s in out.items() if size.count(s) > 1}


def test_greedy_groups_equal_a_sequential_visit(spark):
    rnd = random.Random(2)
    hs = []
    for _ in range(12):
        h = rnd.getrandbits(64)
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.randrange(0, 7)):
                h ^= 1 << b
            hs.append(h)
    rows = [(i, f"{h:016x}", rnd.choice([None, 0.1, 0.5, 0.9])) for i, h in enumerate(hs)] + [(900, None, 0.5), (901, "xyz", 0.5)]
    df = spark.createDataFrame(rows, "id long, phash string, score double")
    got = {r["id"]: r["seed_id"] for r in greedy_groups(df, "id", "phash", "score", 10).collect()}
    assert got == greedy(rows[:-2], 10)


def test_canonical_ids(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b"), (6, "a"), (6, "a")], "id long, sha256 string")
    assert {r["id"]: r["canonical_id"] for r in canonical_ids(df).collect()} == {3: 1, 6: 1}


def test_places(spark):
    pts = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.01, 8.0), (3, None, 8.0), (4, 0.0, 0.0)], "id long, lat double, lon double")
    pl = spark.createDataFrame([("a", 50.0, 8.001, None), ("b", 50.0, 8.0, 2000.0), ("c", 50.0, 8.0005, 10.0)], "place string, lat double, lon double, radius_m double")
    assert {(r["id"], r["place"]) for r in places_within(pts, pl).collect()} == {(1, "a"), (1, "b"), (2, "b")}
    assert {(r["id"], r["place"]) for r in nearest_place(pts, pl).collect()} == {(1, "b"), (2, "b")}
    assert places_within(pts, pl.limit(0)).count() == 0


def test_overlaps_and_mentions(spark):
    s = spark.createDataFrame([(1, 1, 0, 100), (2, 1, 0, 50), (3, 1, None, 50), (4, 2, 0, 300_000), (5, 1, 50, 50)], "id long, f long, start_ms long, end_ms long")
    v = spark.createDataFrame([(10, 1, 0, 40), (11, 1, 40, 100), (12, 2, 100_000, 290_000), (13, 1, 10, 50)], "span_id long, f long, start_ms long, end_ms long")
    assert {tuple(r) for r in best_overlap(s, v, "f").collect()} == {(1, 11, 60), (2, 10, 40), (4, 12, 190_000)}
    d = spark.createDataFrame([(1, "The Old-Mill, Lane"), (2, "old mill"), (3, None), (4, "mill old"), (5, "")], "id long, t string")
    t = spark.createDataFrame([("Old Mill",), ("mill",), ("?",), (None,)], "t string")
    assert {tuple(r) for r in mentions(d, "id", "t", t, "t").collect()} == {(1, "Old Mill"), (2, "Old Mill"), (1, "mill"), (2, "mill"), (4, "mill")}


def test_similar_names_equal_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(4, 16))).strip() or "x" for _ in range(40)]
    names = sorted({n for b in base for n in (b, b[:-1], b[0] + b, b[:3] + "h" + b[4:], b.upper()) if n.strip()})
    norm = {n: " ".join("".join(c for c in n.lower() if c.isalnum() or c == " ").split()) for n in names}
    want = set()
    for a, b in itertools.combinations(names, 2):
        x, y = norm[a], norm[b]
        if x and y and x != y and difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.85:
            want.add((a, b))
    got = {(r["name_a"], r["name_b"]) for r in similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", 0.85).collect()}
    assert got == want and want


def test_similar_names_of_any_length_and_likeness(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdefghijkl\u00e9\U0001d4b6 ") for _ in range(k)).strip() or "x" for k in (1, 1, 2, 2, 3, 3, 4, 5, 7, 12, 20, 38, 39, 40, 41, 45, 60, 63, 64, 65, 66, 70, 90)]
    names = sorted({n for b in base for k in range(3) for n in (b, b[k:], b[k::-1] + b[k:], b[:k] + "l" + b[k + 1 :], b[: 2 + k] + "?" + b[2 + k :], b + b[:k] + "aa") if n.strip()})
    norm = {n: " ".join(n.replace("?", "").split()) for n in names}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for t in (0.5, 0.85):
        ratio = {(a, b): difflib.SequenceMatcher(None, norm[a], norm[b], autojunk=False).ratio() for a, b in itertools.combinations(names, 2) if norm[a] != norm[b]}
        got = {(r["name_a"], r["name_b"]): r["ratio"] for r in similar_names(df, "n", t).collect()}
        assert got.keys() == {p for p, r in ratio.items() if r >= t} and got
        assert all(abs(r - ratio[p]) < 6e-5 for p, r in got.items())


def test_similar_names_do_not_meet_by_what_all_share(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + " by the old quay" for _ in range(1500)})
    names += [n[:4] + "z" + n[5:] for n in names[:40] if n[4] != "z"]
    ids = {n: i for i, n in enumerate(names)}
    got = alike_candidates(spark.createDataFrame([(i, n) for n, i in ids.items()], "id long, s string"), 0.85).collect()
    assert len({tuple(r) for r in got}) == len(got) < len(names) * len(names) // 2 // 100
    assert {(ids[a], i) for i, b in enumerate(names[1500:], 1500) for a in [next(n for n in names[:40] if n[:4] == b[:4] and n[5:] == b[5:])]} <= {tuple(r) for r in got}


def test_npmi_and_communities(spark):
    f = [(d, t) for d in range(3) for t in "ab"] + [(9, "c"), (9, None)]
    e = {(r["term_a"], r["term_b"]): r["score"] for r in npmi_edges(spark.createDataFrame(f[:6], "d int, t string"), "d", "t").collect()}
    assert e == {("a", "b"): 1.0}
    links = [(a, b, 1.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w", 0.1)]
    got = {r["node"]: r["community"] for r in communities(spark.createDataFrame(links, "a string, b string, w double"), "a", "b", "w").collect()}
    assert {got[n] for n in "abcd"} == {"a"} and {got[n] for n in "wxyz"} == {"w"}


def test_dbscan(spark):
    rows = [(i, 10 + i * 0.001, 5.0) for i in range(6)] + [(10, 10.006, 5.0), (20, 20.0, 5.0), (21, None, 1.0), (30, 30.0, 0.0), (31, 30.0, 0.0), (32, 30.0, 0.0)]
    got = {r["id"]: r["cluster_id"] for r in dbscan(spark.createDataFrame(rows, "id long, lat double, lon double"), "id", "lat", "lon", 120.0, 3).collect()}
    assert got == {**{i: 1 for i in range(6)}, 10: 1, 20: None, 30: 30, 31: 30, 32: 30}


def test_facts(spark):
    e = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "broken"), (3, None), (4, '{"a": null}')], "id long, j string")
    assert {tuple(r) for r in json_facts(e, "id", "j").collect()} == {(1, "a", "1"), (1, "b", "x")}
    f = spark.createDataFrame([(1, "w", "9"), (1, "v", "8"), (2, "v", None)], "id long, n string, v string")
    reg = spark.createDataFrame([("width", "v", 2), ("width", "w", 1)], "canonical string, name string, priority int")
    assert [tuple(r) for r in first_known(f, "id", "n", "v", reg).collect()] == [(1, "width", "9")]
    assert [tuple(r) for r in pivot_max(f, "id", "n", "v", ["v", "z"]).orderBy("id").collect()] == [(1, "8", None), (2, None, None)]
    files = spark.createDataFrame([(1, "p"), (2, "q")], "id long, path string")
    t = spark.createDataFrame([(1,), (1,), (7,)], "file_id long")
    assert {tuple(r) for r in coverage(files, {"has": t}, {"n": t}).collect()} == {(1, "p", True, 2), (2, "q", False, 0)}


def test_trimmed_centroid_drops_the_far_row(spark):
    rows = [(i, 1, [1.0, 0.0]) for i in range(9)] + [(9, 1, [-1.0, 0.1]), (10, 2, [0.0, 2.0]), (11, 1, [0.0, 0.0]), (12, None, [1.0, 1.0]), (13, 1, None)]
    got = {r["g"]: r for r in trimmed_centroids(spark.createDataFrame(rows, "id long, g long, v array<float>"), "g", "id", "v").collect()}
    assert got[1]["n"] == 9 and got[1]["centroid"] == [1.0, 0.0] and got[1]["spread"] == 0.0 and got[2]["centroid"] == [0.0, 1.0]


def test_rules(spark):
    rules = standard_rules()
    assert len(rules) == 75
    cases = {
        1: {"file_date": "2024-03-31", "hour_of_day": "7"}, 2: {"file_date": "1984", "focal_length_35mm": "24.0", "iso": "x"}, 3: {"exif_width": "400", "exif_height": "100", "aspect_ratio": "4"},
        4: {"file_format": "DNG", "gps_present": "true", "flash_fired": "0"}, 5: {"file_date": "2023-12-25", "file_date_precision": "year"}, 6: {"exif_width": "4", "exif_height": "0"},
    }
    df = spark.createDataFrame(list(cases.items()), "id int, f map<string,string>")
    got = {}
    for r in apply_rules(df, "id", "f", rules).collect():
        got.setdefault(r["id"], set()).add(r["tag"])
    assert got == {1: {"Easter", "Spring", "2020s", "golden_hour_morning"}, 2: {"1980s", "ultra_wide", "wide_angle"}, 3: {"Landscape", "Widescreen", "Panoramic"}, 4: {"raw_file", "geotagged", "no_flash"}, 5: {"2020s"}, 6: {"Landscape"}}


def test_name_rules(spark):
    rules = [
        {"pattern": r"(\d{4})(\d{2})(\d{2})$", "is_regex": True, "action": "capture", "extract_as": "file_date", "format_str": "{1}-{2}-{3}", "keep_token": False},
        {"pattern": "img", "is_regex": False, "action": "ignore"}, {"pattern": "tmp.*", "is_regex": True, "action": "reject"},
        {"pattern": "xmas", "is_regex": False, "action": "replace", "replace_with": "christmas"}, {"pattern": "xm", "is_regex": True, "action": "reject"},
    ]
    df = spark.createDataFrame([("IMG_20231225_xmas_the_tmp1_20240101.jpg",), (None,)], "f string")
    r = df.select(normalised_name(F.col("f"), rules, ["the"], ["bad"], [("christmas", "yule")]).alias("n")).collect()
    assert r[0]["n"]["name"] == "yule" and r[0]["n"]["captured"] == {"file_date": "2024-01-01"}


def test_scope_and_pending(spark):
    f = spark.createDataFrame([(1, 1, "/a/B/x_1.JPG", "x_1.JPG", "image", 0.0, None), (2, 1, "/a/bb/y.jpg", "y.jpg", "image", 86400.0 * 400, 1), (3, 2, "/a/b/z%.mp4", "z%.mp4", "video", None, None)], "id long, source_id long, path string, filename string, file_type string, mtime double, canonical_id long")
    ids = lambda s: {r["id"] for r in f.filter(s.condition()).collect()}
    assert ids(FileScope(folder_prefix="/A/b/")) == {1, 3} and ids(FileScope(name_pattern="*_?.jpg")) == {1} and ids(FileScope(name_pattern="z%*")) == {3}
    assert ids(FileScope(date_from="1970-01-01", date_to="1970-12-31")) == {1} and ids(FileScope.of({"source_id": "2", "file_type": ""})) == {3} and FileScope.of({"source_id": "x"}).is_empty()
    done = spark.createDataFrame([(1, "failed"), (2, "done")], "file_id long, status string")
    assert {r["id"] for r in pending(f, done).collect()} == {3} and {r["id"] for r in pending(f, done, retry=("failed",)).collect()} == {1, 3}
    assert {r["id"] for r in originals(f).collect()} == {1, 3} and {r["id"] for r in having_any(f, done, done).collect()} == {1, 2}
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "k int, v string, status string")
    new = spark.createDataFrame([(2, "c", "u"), (3, "d", "u")], "k int, v string, status string")
    assert {tuple(r) for r in upsert(old, new, ["k"], keep=("status",)).collect()} == {(1, "a", "s"), (2, "c", "t"), (3, "d", "u")}
