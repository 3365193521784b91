"""Results that must not depend on how large a table is or how its rows lie."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mosaicry.operators import hashes
from mosaicry.operators.graph import communities
from mosaicry.operators.ranking import running_total, word_blocks


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_any_choice_of_blocks_finds_all_near_hashes(spark, monkeypatch, k):
    rnd = random.Random(3)
    hs = [rnd.getrandbits(64) for _ in range(30)]
    for h in hs[:30]:
        for bits in (3, 5, 6):
            for b in rnd.sample(range(64), bits):
                h ^= 1 << b
            hs.append(h)
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hs)], "id long, hi long, lo long")
    monkeypatch.setattr(hashes, "_chosen_blocks", lambda n, m: k)
    want = {(a, b) for a, b in itertools.combinations(range(len(hs)), 2) if (hs[a] ^ hs[b]).bit_count() <= 5}
    assert {(r["a"], r["b"]) for r in hashes.hamming_pairs(df, "id", "hi", "lo", 5).collect()} == want


def test_more_hashes_take_wider_keys():
    assert [hashes._chosen_blocks(n, 5) for n in (100, 10**5, 10**8)] == sorted(hashes._chosen_blocks(n, 5) for n in (100, 10**5, 10**8))


def test_communities_gain_nothing_by_any_move(spark):
    rnd = random.Random(5)
    w = {(a, b): rnd.random() for a, b in itertools.combinations(range(24), 2) if rnd.random() < 0.25}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "a long, b long, w double")
    one, two = ({r["node"]: r["community"] for r in communities(t, "a", "b", "w").collect()} for t in (df, df.orderBy(F.desc("w")).repartition(7)))
    assert one == two
    for n in one:
        votes: dict = {}
        for (a, b), x in w.items():
            if n in (a, b):
                o = one[b if n == a else a]
                votes[o] = votes.get(o, 0) + x
        assert votes.get(one[n], 0) >= max(votes.values()) - 1e-5


def test_running_totals_and_windows_equal_one_pass(spark):
    rnd = random.Random(6)
    rows = [(g, i, [f"w{g}_{i}_{j}" for j in range(rnd.randrange(1, 9))]) for g in (1, 2, 3) for i in range(1 if g == 3 else 60)]
    df = spark.createDataFrame(rows, "g long, i long, w array<string>").repartition(5)
    total = {(r["g"], r["i"]): (r["before"], r["total"]) for r in running_total(df, ["g"], [F.asc("i")], F.size("w")).collect()}
    got = {(r["g"], r["no"]): r["window"] for r in word_blocks(df, "g", ["i"], "w", 20, 5).collect()}
    want = {}
    for g in (1, 2, 3):
        mine = [r for r in rows if r[0] == g]
        words = [x for r in mine for x in r[2]]
        at = 0
        for r in mine:
            assert total[(g, r[1])] == (at, len(words))
            at += len(r[2])
        for no, a in enumerate(range(0, max(1, len(words) - 5), 15)):
            want[(g, no)] = " ".join(words[a : a + 20])
    assert got == want
