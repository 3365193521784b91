import datetime
import itertools
import random

from pyspark.sql import functions as F

from mosaicry.llm.mixing import mix, with_tokens
from mosaicry.llm.names import link_names, parse, rewritings
from mosaicry.llm.survivors import current_scores, current_values, duplicate_groups, field_values, survivors, value_precedence
from mosaicry.operators.hashes import hamming_pairs


def test_hamming_pairs_equal_brute_force(spark):
    rnd = random.Random(9)
    hs = [rnd.getrandbits(64) for _ in range(60)]
    for h in hs[:40]:
        for bits in (1, 5, 6, 11):
            x = h
            for b in rnd.sample(range(64), bits):
                x ^= 1 << b
            hs.append(x)
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hs)], "id long, hi long, lo long")
    for bits in (0, 5, 10):
        want = {(a, b) for a, b in itertools.combinations(range(len(hs)), 2) if (hs[a] ^ hs[b]).bit_count() <= bits}
        assert {(r["a"], r["b"]) for r in hamming_pairs(df, "id", "hi", "lo", bits).collect()} == want


FILES = "id long, file_size long, sha256 string, canonical_id long, g string"
HASHES = "file_id long, phash string"


def test_groups_and_survivors(spark):
    files = [(1, 10, "a", None, ""), (2, 20, "a", None, ""), (3, 5, None, 1, ""), (4, 0, "a", None, ""), (5, 7, "b", None, ""), (6, 7, None, 99, ""), (7, 9, None, None, ""), (8, 9, None, None, ""), (9, 9, None, None, ""), (1, 10, "a", None, "")]
    hashes = [(5, "00000000000000FF"), (6, "00000000000000f8"), (7, "0" * 16), (8, "0" * 16), (9, "not hex"), (9, None), (4, "00000000000000ff"), (7, "ffff000000000000"), (8, "ffff000000000000")]
    f, h = spark.createDataFrame(files, FILES), spark.createDataFrame(hashes, HASHES)
    g = duplicate_groups(f, h)
    assert {r["file_id"]: r["group_id"] for r in g.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7}
    t = datetime.datetime
    scores = [(1, 1, "nima_mobilenet", 0.9, t(2020, 1, 1)), (2, 1, "nima_mobilenet", 1.5, t(2021, 1, 1)), (3, 3, "nima_mobilenet", 0.1, t(2020, 1, 1)), (4, 2, "other", 0.99, t(2020, 1, 1)), (5, 6, "nima_mobilenet", None, t(2020, 1, 1))]
    s = current_scores(spark.createDataFrame(scores, "id long, file_id long, model_name string, score double, scored_at timestamp"))
    got = {r["file_id"]: r["survivor_id"] for r in survivors(g, f, s).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 5: 5, 6: 5, 7: 7, 8: 7}
    assert duplicate_groups(f.limit(0), h).count() == 0


def test_current_values_by_learned_precedence(spark):
    rows = []
    for g in range(5):  # draft is regularly replaced by final
        rows += [(g, "draft", 1.0), (g, "final", 2.0)]
    rows += [(10, "draft", None), (10, "final", None), (11, "draft", 9.0), (12, "x", None), (12, "y", None), (12, "y", None), (13, None, 1.0), (14, "final", None), (14, "draft", 5.0), (15, "final", 1.0), (15, "draft", 2.0)]
    df = spark.createDataFrame(rows, "g long, s string, at double")
    v = field_values(df, "g", {"s": F.col("s")}, F.col("at"))
    seen = v.groupBy("g", "field", "v").agg(F.max("at").alias("last"))
    assert [tuple(r) for r in value_precedence(seen).collect()] == [("s", "draft", "final")]
    got = {r["g"]: r["v"] for r in current_values(v, ("s",)).collect()}
    assert got == {0: "final", 1: "final", 2: "final", 3: "final", 4: "final", 10: "final", 11: "draft", 12: "y", 14: "final", 15: "draft"}
    # a field nothing is learned for keeps the dated, the frequent, the smallest
    assert {r["g"]: r["v"] for r in current_values(v).collect()} == got | {10: "draft", 14: "draft"}
    assert current_values(v.limit(0), ("s",)).count() == 0


def test_precedence_is_closed_over_absent_values(spark):
    rows = []
    for g in range(0, 30, 3):  # a before b, b before c, c before d; p, q and r form a cycle
        rows += [(g, "a", 1.0), (g, "b", 2.0), (g + 1, "b", 1.0), (g + 1, "c", 2.0), (g + 2, "c", 4.0), (g + 2, "d", 5.0)]
        rows += [(100 + g, "p", 1.0), (100 + g, "q", 2.0), (101 + g, "q", 1.0), (101 + g, "r", 2.0), (102 + g, "r", 1.0), (102 + g, "p", 2.0)]
    rows += [(900, "a", None), (900, "d", None), (901, "a", 7.0), (901, "c", None), (902, "q", None), (902, "p", None), (903, "rare", None), (903, "b", None), (903, "b", None)]
    # dated a and c with an undated b: b lies below c, so c stays
    rows += [(904, "a", 1.0), (904, "c", 3.0), (904, "b", None)]
    df = spark.createDataFrame(rows, "g long, s string, at double")
    got = {r["g"]: r["v"] for r in current_values(field_values(df, "g", {"s": F.col("s")}, F.col("at")), ("s",)).filter("g >= 900").collect()}
    assert got == {900: "d", 901: "c", 902: "p", 903: "b", 904: "c"}


def test_parsing_of_names():
    assert parse("Dr. Bob  Lanholm ") == ("full", "bob", "", "lanholm") and parse("Lanholm, Bob") == ("full", "bob", "", "lanholm")
    assert parse("LANHOLM, R.") == ("initial", "r", "", "lanholm") and parse("Zoë_Lánholm") == ("full", "zoe", "", "lanholm")
    assert parse("Ann De Vries") == ("full", "ann", "", "de vries") and parse("Ann Mary K. Vries") == ("full", "ann", "mary k", "vries")
    assert parse("face 1") is parse("") is parse(None) is parse("?") is parse("A. B.") is parse("Bob") is parse("unknown person") is None
    assert parse("Acme Limited") == parse("ACME, Ltd.") == ("org", "acme", "", "ltd") and parse("Cher") == ("single", "cher", "", "")
    assert (1, "e|lanholm|robert", "") in rewritings(*parse("Bob Lanholm"))
    assert parse("Jo Li", {"jo": ["jolanta"]}) == ("full", "jo", "", "li") and (1, "e|jolanta|li", "") in rewritings("full", "jo", "", "li", {"jo": ["jolanta"]})


def test_variants_link_to_one_person(spark):
    people = [(1, "Robert Lanholm"), (2, "Bob Lanholm"), (3, "Lanholm, R."), (4, "Robert Lanhlom"), (5, "Rebecca Ossmick"), (6, "Robin Ossmick"), (7, "R. Ossmick"), (8, None), (9, "?"), (10, "Lanholm Robert"), (11, "ROBERT Q. LANHOLM"), (1, "Robert Lanholm")]
    faces = [(1, "Capt Robert Länholm"), (2, "R. Lanholm"), (3, "R. Ossmick"), (4, "Rebeca Ossmick"), (5, "Robert Van Lanholm"), (6, "tbd"), (7, None), (8, "Bob Lanholmm"), (9, "")]
    a, b = link_names(spark.createDataFrame(people, "id long, name string"), "id", "name", spark.createDataFrame(faces, "id long, name string"))
    assert {r["id"]: r["person_id"] for r in a.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 11: 1, 5: 5, 6: 6}
    assert {r["id"]: r["person_id"] for r in b.collect()} == {1: 1, 2: 1, 4: 5, 8: 1}
    e = spark.createDataFrame([], "id long, name string")
    a, b = link_names(e, "id", "name", e)
    assert a.count() == 0 and b.count() == 0


def test_middle_names_and_organisations(spark):
    people = [
        (1, "Mary Ann Smith"), (2, "Mary Beth Smith"), (3, "Mary Smith"), (4, "Mary A. Smith"), (5, "Smith Mary Ann"), (6, "Mray Smith"),
        (20, "Northern Steel Works Ltd"), (21, "Northern Copper Works Ltd"), (22, "Steel Works Northern Limited"), (23, "Northern Steel Wroks Ltd"),
        (30, "Acme Ltd"), (31, "Acme Limited"), (32, "Acme Inc"), (33, "ACME"), (40, "Cher"), (41, "cher"), (42, "Bob"), (43, "unknown"), (44, "Unknown"),
        (50, "Tom Brook Vale"), (51, "Thomas Vale"), (52, "T. Vale"), (60, "Ted Moor"), (61, "Ted Moor"), (70, "Zephyr Ltd"), (71, "zephyr"),
    ]
    faces = [(1, "Mary Cate Smith"), (2, "Mary Beth Smith"), (3, "Mary Smith"), (4, "Northern Steel Works"), (5, "Thomas B. Vale"), (6, "acme ltd"), (7, "Zephyr")]
    a, b = link_names(spark.createDataFrame(people, "id long, name string"), "id", "name", spark.createDataFrame(faces, "id long, name string"))
    got = {r["id"]: r["person_id"] for r in a.collect()}
    assert got == {1: 1, 4: 1, 5: 1, 2: 2, 3: 3, 6: 3, 20: 20, 22: 20, 23: 20, 21: 21, 30: 30, 31: 30, 32: 32, 40: 40, 41: 40, 50: 50, 51: 50, 52: 50, 60: 60, 61: 60, 70: 70, 71: 70}
    assert {r["id"]: r["person_id"] for r in b.collect()} == {1: 3, 2: 2, 5: 50, 6: 30, 7: 70}


def test_mixture_meets_targets(spark):
    rnd = random.Random(11)
    docs = [(i, "abc"[i % 3] if i % 10 else None, rnd.randrange(1, 40)) for i in range(3000)]
    docs += [(9001, "a", None), (9002, "a", 0), (None, "a", 5), (9003, "untargeted", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 2), ("c", 0.1, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    out, rep = mix(df, targets, total=40_000)
    rows, r = out.collect(), {x["source"]: x for x in rep.collect()}
    have = {s: sum(n for _, t, n in docs if t == s and n) - (5 if s == "a" else 0) for s in "abc"}
    cap = {"a": 3, "b": 2, "c": 1}
    for s in "abc":
        assert r[s]["available"] == have[s]
        want = min(r[s]["wanted"], have[s] * cap[s])
        assert abs(r[s]["drawn"] - want) <= 40 and r[s]["drawn"] == sum(x["size"] * x["copies"] for x in rows if x["source"] == s)
        assert max(x["copies"] for x in rows if x["source"] == s) <= cap[s]
    assert r["none"]["drawn"] == 0 and r["none"]["at_cap"] and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    again = {x["doc_id"] for x in mix(df, targets, total=40_000)[0].collect()}
    assert again == {x["doc_id"] for x in rows} and len(rows) == len(again)
    out, rep = mix(df.limit(0), targets)
    assert out.count() == 0 and rep.count() == 4


def test_inclusion_follows_weights(spark):
    df = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, source string, n_tokens long, w double")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = [r["doc_id"] % 2 for r in mix(df, t, total=10_000, weight="w")[0].collect()]
    assert abs(len(got) - 1000) <= 1 and 0.7 < sum(got) / len(got) < 0.8


def test_token_counts_of_whole_texts(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "a tide mill <|endoftext|>", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert {r["id"]: r["n_tokens"] for r in with_tokens(df, "text").collect()} == want


def test_an_undated_score_is_settled_by_learned_precedence(spark):
    at = "2024-01-0{} 00:00:00"
    rows = [(f, "nima_mobilenet", s, at.format(day)) for f in (1, 2, 3) for day, s in ((1, 0.2), (2, 0.8))]
    rows += [(4, "nima_mobilenet", 0.2, at.format(5)), (4, "nima_mobilenet", 0.8, None), (5, "nima_mobilenet", 0.8, at.format(1)), (5, "nima_mobilenet", 0.2, None)]
    df = spark.createDataFrame(rows, "file_id long, model_name string, score double, at string").withColumn("scored_at", F.col("at").cast("timestamp"))
    assert {r["file_id"]: r["score"] for r in current_scores(df).collect()} == {1: 0.8, 2: 0.8, 3: 0.8, 4: 0.8, 5: 0.8}
