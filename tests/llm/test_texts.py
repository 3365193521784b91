import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from mosaicry.llm import cooccurrence, leakage, lookalike
from mosaicry.llm.cooccurrence import clean_items, pair_counts
from mosaicry.llm.leakage import leaked_items, words_of
from mosaicry.llm.lookalike import bigram_model, compatible, consistent, consistent_texts, same_look_pairs
from mosaicry.llm.transcripts import Cleaner, speaker_turns, turn_texts


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [f"t{int(rnd.expovariate(0.15))}" for _ in range(rnd.randrange(0, 8))], "x") for i in range(300)]
    rows += [(900, None, None), (901, [], None), (902, [None, "", " T1 "], None)] + rows[:4] + [(None, ["t1", "t2"], None)]
    df = spark.createDataFrame(rows, "id long, tags array<string>, n string").withColumn("items", clean_items("tags"))
    sets = {i: {t.strip().lower() for t in ts or [] if t and t.strip()} for i, ts, _ in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    n, f, p = len(sets), {}, {}
    for s in sets.values():
        for a in s:
            f[a] = f.get(a, 0) + 1
            for b in s:
                if a < b:
                    p[a, b] = p.get((a, b), 0) + 1
    for least, lift in ((1, 0.0), (3, 1.2)):
        want = {(a, b, c, f[a], f[b]) for (a, b), c in p.items() if c >= least and c * n >= lift * f[a] * f[b]}
        got = pair_counts(df, "id", "items", least, lift).collect()
        assert {(r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"]) for r in got} == want and len(got) == len(want)
        assert all(r["n"] == n and r["odds_ratio"] > 0 for r in got)
    assert pair_counts(df.limit(0), "id", "items").count() == 0


def test_a_basket_of_very_many_items(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(2500)]), (2, ["1", "2"])], "id long, items array<string>")
    got = pair_counts(df, "id", "items")
    assert got.count() == 2500 * 2499 // 2
    assert got.filter("n_ab = 2").collect()[0]["item_a"] == "1"


def test_large_baskets_are_cut_into_blocks(spark, monkeypatch):
    rnd = random.Random(15)
    rows = [(i, [f"t{k}" for k in rnd.sample(range(40), rnd.randrange(0, 30))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    want = sorted(map(tuple, pair_counts(df, "id", "items").collect()))
    monkeypatch.setattr(cooccurrence, "BASKET", 7)
    assert sorted(map(tuple, pair_counts(df, "id", "items").collect())) == want and want


def test_leaks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice("ab cd ef gh ij kl mn op qr st Ärger x1 99".split())
    items = [(i, " ".join(word() for _ in range(rnd.randrange(3, 40))), "t") for i in range(30)] + [(90, None, None), (91, "", None), (None, "a b", None)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            src = rnd.choice(items[:30])[1].split()
            at, ln = rnd.randrange(len(src)), rnd.randrange(4, 20)
            w[10:10] = [x.upper() + "," for x in src[at : at + ln]]
        docs.append((i, rnd.choice([" ", "\n", " - "]).join(w), 1))
    docs += [(500, None, 1), (501, "", 1), (502, " ".join(["pad"] * 20_000) + " " + items[0][1], 1)]

    def holds(d, t, n):
        d, t = words_of(d), words_of(t)
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        return any(tuple(d[i : i + n]) in grams for i in range(len(d) - n + 1))

    dd, ii = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, task string")
    for n in (5, 12):
        want = {(d, i) for d, t, _ in docs for i, x, _ in items if i is not None and x and t and holds(t, x, n)}
        got = leaked_items(dd, "doc_id", "text", ii, "item_id", "text", n, whole_short=False).select("doc_id", "item_id").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want
    assert leaked_items(dd, "doc_id", "text", ii.limit(0), "item_id", "text").count() == 0
    want = {(d, i) for d, t, _ in docs for i, x, _ in items if i is not None and x and t and holds(t, x, min(12, len(words_of(x))))}
    whole = leaked_items(dd, "doc_id", "text", ii, "item_id", "text", 12)
    assert {(r["doc_id"], r["item_id"]) for r in whole.collect()} == want and any(len(words_of(x)) < 5 for _, x, _ in items if x)
    # a bitmap with all bits set and windows too large to broadcast change nothing
    monkeypatch.setattr(leakage, "MOST_BITS", 64)
    monkeypatch.setattr(leakage, "BROADCAST_LIMIT", 0)
    assert sorted(map(tuple, leaked_items(dd, "doc_id", "text", ii, "item_id", "text", 12).collect())) == sorted(map(tuple, whole.collect()))


def test_share_of_an_item_that_a_document_holds(spark):
    item = [f"w{i}" for i in range(15)]  # four passages of twelve words
    docs = [(1, " ".join(item)), (2, " ".join(item[:13]) + " and " + " ".join(item[:13])), (3, " ".join(item[:11]))]
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, " ".join(item))], "i long, t string"), "i", "t")
    assert {r["doc_id"]: (r["first_word"], r["containment"]) for r in got.collect()} == {1: (0, 1.0), 2: (0, 0.5)}


def test_bitmaps_stay_small_for_many_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 16)
    for n in (1, 400, 40_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("key"))
        bitmap = leakage.key_bitmap(keys)
        assert len(bitmap) * 64 <= 1 << 16
        at = [r["key"] & (len(bitmap) * 64 - 1) for r in keys.limit(500).collect()]
        assert all(int(bitmap[i >> 6]) >> (i & 63) & 1 for i in at)


def test_consistent_form_is_blind_to_spelling():
    base = "Naïve café in Ursjaley: 42 coins, Émile Zola!"
    full = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base)
    cyr = base.translate(str.maketrans({"a": "а", "e": "е", "o": "о", "c": "с", "i": "і"}))
    gaps = "​".join(base).replace(" ", " ")
    parts = "".join(c + "­" for c in base)
    for t in (full, cyr, gaps, parts, compatible(base)):
        assert consistent(t) == base
    assert consistent("На снимке видна сосна") == "На снимке видна сосна"
    assert consistent("Hа снимкe") == "На снимке" and consistent("Η λήψη έγινε") == "Η λήψη έγινε"
    assert consistent("resume") != consistent("résumé") and consistent("May") != consistent("may")
    assert consistent("ﬁne") == "fine" and consistent("") == ""
    long = "каша maсhine " * 20_000
    assert len(consistent(long)) == len(long)


def test_same_look_pairs(spark):
    rows = [(1, "coin box", "a"), (2, "соіn box", "b"), (3, "coin box", "c"), (4, " ​", "d"), (5, "\n", "e"), (6, None, "f"), (7, "Coin box", "g"), (8, "coin box", "h"), (None, "coin bоx", "i")]
    df = spark.createDataFrame(rows, "id long, text string, look string")
    assert {tuple(r) for r in same_look_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert same_look_pairs(df.limit(0), "id", "text").count() == 0
    forms = {r["id"]: r["form"] for r in consistent_texts(df, "id", "text").collect()}
    assert forms[2] == "coin box" and forms[6] is None and len(forms) == 9


def test_cleaning_of_segments():
    c = Cleaner()
    cases = {
        "[00:00:09] I think it was the second chapel?": ("I think it was the second chapel", None, 9000),
        "SPEAKER_00: Before the flood": ("Before the flood", 0, None),
        ">> spk1: The committee": ("The committee", 1, None),
        "[Speaker 2] (laughs) we um, left": ("we left", 2, None),
        "ah, Uh": ("", None, None),
        "[music] Ummm": ("", None, None),
        "*coughs* errr... that summer her umbrella": ("that summer her umbrella", None, None),
        "♪ every summer ♪": ("every summer", None, None),
        "<00:01:18> Later on": ("Later on", None, 78000),
        "We said speaker 1: hello": ("We said speaker 1 hello", None, None),
        "an unclosed (bracket": ("an unclosed bracket", None, None),
        "at 00:10:00 we met": ("at we met", None, 600000),
        "hmmm uhhhm AAAH": ("", None, None),
        "don't stop": ("don't stop", None, None),
    }
    for text, want in cases.items():
        assert c(text) == want, text
    assert c(None) == ("", None, None) and c("") == ("", None, None)
    assert c("um word " * 50_000)[0].count("word") == 50_000


SEG = "id long, file_id long, start_ms long, end_ms long, text string, speaker_label string, part int"
VOICE = "file_id long, start_ms long, end_ms long, speaker_label string, person_id long, id long"


def test_turns(spark):
    seg = [
        (1, 1, 0, 900, "hello there", "S0", 1), (2, 1, 1000, 1900, "more words", "Speaker 0", 1), (3, 1, 2000, 2900, "um", "S1", 1),
        (4, 1, 3000, 3900, "again", "Ann Lee :", 1), (5, 1, None, 4900, "[00:00:04] [Speaker 1] reply", None, 1), (6, 1, 5000, 5900, "heard", None, 1),
        (7, 1, 6000, 6900, "nobody", None, 1), (8, 1, 7000, 7900, "nobody", None, 1), (9, 1, 0, 900, "hello there", "S0", 1),
        (10, 1, 700_000, 700_900, "late", "spk1", 1), (11, 1, 1_900_000, 1_900_100, "later", "S1", 1), (12, 2, None, None, "no time", "S1", 1), (13, 2, 5, 9, None, "S1", 1), (1, 1, 0, 900, "hello there", "S0", 1),
    ]
    voice = [(1, 0, 900, "SPEAKER_00", 7, 1), (1, 4000, 6000, "SPEAKER_01", None, 2), (1, 5500, 5600, "SPEAKER_00", 7, 3)]
    people = spark.createDataFrame([(7, "Ann Lee", 1), (9, " ann  lee", 2), (8, None, 3)], "id long, preferred_name string, file_id int")
    t = speaker_turns(spark.createDataFrame(seg, SEG), spark.createDataFrame(voice, VOICE), people)
    got = {r["id"]: r["turn_id"] for r in t.collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 10: 10, 11: 10, 12: 12}
    texts = {r["turn_id"]: (r["text"], r["person_id"]) for r in turn_texts(t).collect()}
    assert texts[1] == ("hello there more words again", 7) and texts[5] == ("reply heard", None)
    empty = speaker_turns(spark.createDataFrame([], SEG), spark.createDataFrame([], VOICE), people.limit(0))
    assert empty.count() == 0


def test_turns_do_not_depend_on_slices(spark):
    rnd = random.Random(8)
    seg = [(i, i % 3, rnd.randrange(0, 100_000), 0, f"w{i}", rnd.choice(["S0", "S0", "S1", None]), 0) for i in range(300)]
    args = (spark.createDataFrame(seg, SEG), spark.createDataFrame([], VOICE), spark.createDataFrame([], "id long, preferred_name string"))
    a, b = ({r["id"]: r["turn_id"] for r in speaker_turns(*args, slice_ms=ms).collect()} for ms in (500, 10**9))
    want, last = {}, {}
    for i, f, t, _, _, s, _ in sorted(seg, key=lambda r: (r[1], r[2], r[0])):
        want[i] = last[f][1] if s and f in last and last[f][0] == s else i
        last[f] = (s, want[i])
    assert a == b == want
    assert re.match("w", "w1")


def test_every_pair_of_items_is_counted(spark, tmp_path):
    # "sea" is in every file, "rare" in one: neither has a lift or a count that a cut would keep
    rows = [(1, ["sea", " Boat"], None), (2, ["sea"], ["rare"]), (3, ["Sea ", "boat"], []), (4, ["sea"], ["quay", "boat"]), (5, None, None)]
    spark.createDataFrame(rows, "file_id long, derived_tags array<string>, vocab_terms array<string>").write.parquet(f"{tmp_path}/file_contexts.parquet")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"], round(r["lift"], 9)) for r in entry.queries()["p6_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("boat", "sea"): (3, 3, 4, 4, 1.0), ("rare", "sea"): (1, 1, 4, 4, 1.0), ("quay", "sea"): (1, 1, 4, 4, 1.0), ("boat", "quay"): (1, 3, 1, 4, round(4 / 3, 9))}


def test_every_look_alike_is_met():
    for cls in lookalike.LOOKALIKES:
        for x in cls[1:].replace(".", ""):
            assert consistent(f"q{x}zz w{x}") == consistent(f"q{cls[0]}zz w{cls[0]}"), (cls, x)
    assert consistent("Ьank ɑpple ıtem") == "bank apple item"
    # words keep the script of their own unmistakable letters, whatever the rest of the text is written in
    assert consistent("На снимке видна баржа near the bar") == "На снимке видна баржа near the bar"


def test_skipping_the_search_changes_nothing():
    rnd = random.Random(12)
    letters = "".join(c for cls in lookalike.LOOKALIKES for c in cls if c != ".") + "fkrtéß"
    score = {}

    def random_score(a, b):
        return score.setdefault((a, b), rnd.uniform(lookalike.FLOOR, 0)) if a else 0.0

    for _ in range(400):
        token = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))).translate(lookalike._TO_FIRST)
        assert lookalike._viterbi(token, "LATIN", random_score) == token


def test_what_remains_is_speech():
    clean = Cleaner()
    for text, words in [
        ("we met (my brother and I) at the pier", "we met my brother and I at the pier"), ("that was *really* good", "that was really good"), ("so *coughs* yes (speaking softly) no", "so yes no"),
        ("(um, it rained for hours on end) yes", "it rained for hours on end yes"), ("(the door closes) and [as they say] so", "and so"), ("a (wind) b *laughing* c", "a b c"), ("open (bracket", "open bracket"), ("x (clearly I was wrong) y", "x clearly I was wrong y"),
    ]:
        assert clean(text)[0] == words


def test_plain_texts_count_for_the_letter_pairs(spark):
    model = bigram_model(spark.createDataFrame([("harbour",), ("\u043c\u043e\u0440\u0435",), (None,)], "t string"), "t")
    assert {("h", "a"), ("o", "u"), ("\u043c", "\u043e")} <= set(model)
