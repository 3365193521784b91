"""Copies by equal values, and 64-bit fingerprints that differ in a few bits."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize


def hash_halves(hex16: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a 64-bit hash written as 16 hex digits in any case; null if it is none."""
    h = F.lower(F.trim(hex16))
    ok = h.rlike("^[0-9a-f]{16}$")
    half = lambda a: F.when(ok, F.conv(F.substring(h, a, 8), 16, 10).cast("long"))
    return half(1), half(9)


def _chosen_blocks(n: int, max_bits: int) -> int:
    """How many of max_bits + k blocks to compare at once: the k with the least work for ``n`` hashes.

    A larger k gives more keys a hash but of more bits, so fewer pairs meet by chance. Every k finds the same pairs.
    """

    def work(k: int) -> float:
        keys, bits = comb(max_bits + k, k), 64 * k // (max_bits + k)
        return 2.0 * keys * n + keys * n * n / 2 / 2**bits / 8

    return min((k for k in range(1, 17) if k == 1 or (comb(max_bits + k, k) <= 1024 and 64 * k // (max_bits + k) <= 40)), key=work)


def hamming_pairs(hashes: DataFrame, id_col: str, hi: str, lo: str, max_bits: int = 5) -> DataFrame:
    """(a, b, bits) of distinct hashes whose 64 bits differ in at most ``max_bits``, a < b.

    The bits are cut into max_bits + k blocks; a pair within reach agrees in k blocks at
    least, so it shares the key of some choice of k blocks. k grows with the number of hashes,
    which keeps chance meetings in proportion. Ids must be unique and each hash should
    occur once; a crowded key is cut into parts.
    """
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must lie in 0 to 15")
    k = _chosen_blocks(hashes.count(), max_bits)
    blocks = max_bits + k
    cut = [64 * i // blocks for i in range(blocks + 1)]
    h = hashes.select(F.col(id_col).alias("id"), F.shiftleft(F.col(hi), 32).bitwiseOR(F.col(lo)).alias("h"))
    keys = []
    for tag, chosen in enumerate(combinations(range(blocks), k)):
        key, wide = F.lit(tag).cast("long"), sum(cut[i + 1] - cut[i] for i in chosen)
        for i in chosen:
            a, b = cut[i], cut[i + 1]
            key = F.shiftleft(key, b - a).bitwiseOR(F.shiftrightunsigned("h", a).bitwiseAND((1 << (b - a)) - 1)) if wide <= 40 else F.col("h")
        keys.append(key)
    each = h.select(F.explode(F.array(*keys)).alias("k"), "id", "h")
    left, right = each.withColumnsRenamed({"id": "a", "h": "ha"}), each.withColumnsRenamed({"id": "b", "h": "hb"})
    bits = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return salted_join(left, right, "k", "a").filter((F.col("a") < F.col("b")) & (bits <= max_bits)).select("a", "b", bits.alias("bits")).distinct()


def star_links(rows: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b) from the smallest node of each non-null key to its other nodes: a key's copies become one star."""
    r = rows.filter(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("b"), F.col(key).alias("_k"))
    first = r.groupBy("_k").agg(F.min("b").alias("a"), F.max("b").alias("z")).filter("a < z").select("_k", "a")
    return r.join(first, "_k").filter("a <> b").select("a", "b")


def canonical_ids(files: DataFrame, content: str = "sha256") -> DataFrame:
    """(id, canonical_id): every file whose content also is that of a smaller id, with the smallest one."""
    f = files.select("id", content).dropDuplicates(["id"])
    return star_links(f, "id", content).select(F.col("b").alias("id"), F.col("a").alias("canonical_id")).distinct()


def greedy_groups(rows: DataFrame, id_col: str, phash: str, score: str, max_bits: int = 10) -> DataFrame:
    """(id, seed_id, distance, place): near-duplicates around seeds, as if rows were visited best first.

    A row that no earlier seed has taken becomes a seed and takes every free row
    within ``max_bits``; the order is score descending, nulls last, then id. Which
    rows are seeds follows from the order alone, so rounds over all rows find them:
    a row whose earlier neighbours are all taken is a seed. Groups of one are left
    out; place counts inside a group by score, then id. Null, malformed and repeated
    rows: no group, no group, once.
    """
    hi, lo = hash_halves(F.col(phash))
    r = rows.select(F.col(id_col).alias("id"), F.col(score).cast("double").alias("score"), hi.alias("hi"), lo.alias("lo")).filter("id IS NOT NULL AND hi IS NOT NULL").dropDuplicates(["id"])
    r = materialize(r.withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))), "hashes")
    order = F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), F.col("id").alias("i"))
    # equal hashes act alike: their best row stands for all
    one = materialize(r.groupBy("h").agg(F.min(order).alias("o"), F.first("hi").alias("hi"), F.first("lo").alias("lo")), "hashes")
    near = hamming_pairs(one, "h", "hi", "lo", max_bits)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
    edge = both.join(one.select(F.col("h").alias("a"), F.col("o").alias("oa")), "a").join(one.select(F.col("h").alias("b"), F.col("o").alias("ob")), "b").filter("ob < oa")
    edge = materialize(edge.select(F.col("a").alias("late"), F.col("b").alias("early"), F.col("ob").alias("early_o"), "bits"), "edges")
    seeds = materialize(one.select("h").join(edge.select(F.col("late").alias("h")).distinct(), "h", "left_anti"), "seeds")
    open_ = edge
    while True:
        taken = open_.join(seeds.select(F.col("h").alias("early")), "early", "left_semi").select(F.col("late").alias("h")).distinct()
        rest = open_.join(taken.select(F.col("h").alias("late")), "late", "left_anti")
        waiting = rest.join(taken.select(F.col("h").alias("early")), "early", "left_anti")
        waiting = materialize(waiting.select("late", "early", "early_o", "bits"), "edges")
        fresh = rest.select(F.col("late").alias("h")).distinct().join(waiting.select(F.col("late").alias("h")).distinct(), "h", "left_anti")
        fresh = materialize(fresh, "seeds")
        if fresh.isEmpty() and waiting.isEmpty():
            break
        seeds = materialize(seeds.unionByName(fresh), "seeds")
        open_ = waiting.unionByName(edge.join(fresh.select(F.col("h").alias("early")), "early", "left_semi").select("late", "early", "early_o", "bits")).distinct()
    mine = edge.join(seeds.select(F.col("h").alias("early")), "early", "left_semi").join(seeds.select(F.col("h").alias("late")), "late", "left_anti")
    mine = mine.groupBy("late").agg(F.min(F.struct("early_o", "early", "bits")).alias("m")).select(F.col("late").alias("h"), F.col("m.early_o.i").alias("seed_id"), F.col("m.bits").alias("distance"))
    own = seeds.join(one, "h").select("h", F.col("o.i").alias("seed_id"), F.lit(0).alias("distance"))
    g = r.select("id", "score", "h").join(mine.unionByName(own), "h")
    size = g.groupBy("seed_id").agg(F.count("*").alias("n")).filter("n > 1").select("seed_id")
    g = materialize(g.join(size, "seed_id").select("id", "seed_id", "distance", "score"), "groups")
    from mosaicry.operators.ranking import distributed_rank

    return distributed_rank(g, ["seed_id"], [F.col("score").isNull(), F.desc("score"), F.asc("id")]).select("id", "seed_id", F.col("distance").cast("int").alias("distance"), (F.col("rank") + 1).alias("place"))
