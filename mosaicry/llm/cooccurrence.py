"""Items that appear together, counted by an external sort of packed pair codes.

Every kept item gets a dense 32-bit code, a pair is one 64-bit number. Each task
sorts its pairs in runs of bounded size and run-length counts them before the
shuffle; Spark's sorter spills and merges the runs of a partition, and one pass
adds the counts of equal neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicry.scratch import materialize
from mosaicry.tables import small

#: Pair codes that a task holds before it sorts and counts them.
RUN = 1 << 21
#: Items of a basket that one row holds; larger baskets are cut into blocks.
BASKET = 4096


def clean_items(*arrays: str) -> Column:
    """Trimmed lower-case distinct non-empty items of several array columns; null arrays count as empty."""
    both = F.concat(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    tidy = F.transform(both, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != "")))


def _codes(items: DataFrame) -> DataFrame:
    """``items`` with a dense ``code``, numbered by partition."""
    t = materialize(items.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "items")
    sizes = t.groupBy("_p").agg((F.max(F.col("_m").bitwiseAND((1 << 33) - 1)) + 1).alias("_n"))
    # one row for each partition of the items
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select("_p", "_n", before.alias("_before")), "sizes")
    if (sizes.agg(F.sum("_n")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more than 2^31 kept items")
    j = t.join(small(sizes, 32), "_p")
    return j.withColumn("code", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_n", "_before")


def _batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def _offsets(col: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.diff(col.offsets.to_numpy()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted and counted runs of the pairs inside ``codes``, or of the pairs of one of ``codes`` and one of ``others`` where these are not empty."""
    held, size = [], 0

    def run() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return _batch(code, n)

    for b in batches:
        mine, theirs = b.column(0), b.column(1)
        flat, off = mine.flatten().to_numpy(zero_copy_only=False), _offsets(mine)
        flat2, off2 = theirs.flatten().to_numpy(zero_copy_only=False), _offsets(theirs)
        for s, e, s2, e2 in zip(off[:-1], off[1:], off2[:-1], off2[1:]):
            x = np.sort(flat[s:e]).astype(np.int64)
            if e2 > s2:
                y = flat2[s2:e2].astype(np.int64)
                parts = ((np.minimum(v, y) << 32) | np.maximum(v, y) for v in x)
            elif len(x) <= 1024:
                a, c = np.triu_indices(len(x), 1)
                parts = iter([(x[a] << 32) | x[c]])
            else:
                parts = ((x[i] << 32) | x[i + 1 :] for i in range(len(x) - 1))
            for p in parts:
                held.append(p)
                size += len(p)
                if size >= RUN:
                    yield run()
                    held, size = [], 0
    if size:
        yield run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = None, 0
    for b in batches:
        code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(code):
            continue
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        c, s = code[start], np.add.reduceat(n, start)
        if last is not None:
            if c[0] == last:
                s[0] += total
            else:
                yield _batch(np.array([last]), np.array([total]))
        last, total = int(c[-1]), int(s[-1])
        if len(c) > 1:
            yield _batch(c[:-1], s[:-1])
    if last is not None:
        yield _batch(np.array([last]), np.array([total]))


def pair_counts(baskets: DataFrame, basket: str, items: str, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio) of pairs, item_a < item_b by code point.

    ``items`` is an array; a repeated basket id counts once (its rows must be equal),
    repeats and nulls inside an array count once and not at all. n counts baskets
    with any item. Two exact prunings come before any pair is made: an item in
    fewer than ``min_together`` baskets, and one in more than n / ``min_lift``
    (n_ab <= min(n_a, n_b) bounds the lift by n / max(n_a, n_b)). The odds ratio adds
    0.5 to each cell of the 2 x 2 table. Empty tables give no rows.
    """
    base = baskets.select(F.col(basket).alias("_b"), F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())).alias("_items"))
    base = materialize(base.filter(F.col("_b").isNotNull() & (F.size("_items") > 0)).dropDuplicates(["_b"]), "baskets")
    n = base.count()
    long = base.select("_b", F.explode("_items").alias("item"))
    count = long.groupBy("item").agg(F.count("*").alias("f")).filter(F.col("f") >= min_together)
    if min_lift > 0:
        count = count.filter(F.col("f") * min_lift <= n)
    words = materialize(_codes(count), "codes")
    coded = long.join(small(words.select("item", "code"), 64), "item").select("_b", "code")
    none = F.array().cast("array<bigint>")
    big = materialize(base.filter(F.size("_items") > BASKET).select("_b", F.ceil(F.size("_items") / BASKET).cast("int").alias("_k")), "big")
    if big.isEmpty():
        lists = coded.groupBy("_b").agg(F.collect_list("code").alias("codes")).select("codes", none.alias("others"))
    else:
        # a large basket is cut into blocks of about BASKET items, and each two blocks meet in one row
        small_ones = coded.join(big.select("_b"), "_b", "left_anti").groupBy("_b").agg(F.collect_list("code").alias("codes")).select("codes", none.alias("others"))
        t = coded.join(big, "_b").withColumn("p", F.pmod(F.xxhash64("code"), F.col("_k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        lo, hi = F.least("p", "o"), F.greatest("p", "o")
        t = t.groupBy("_b", lo.alias("lo"), hi.alias("hi")).agg(F.collect_list(F.when(F.col("p") == lo, F.col("code"))).alias("codes"), F.collect_list(F.when(F.col("p") > lo, F.col("code"))).alias("others"))
        lists = small_ones.unionByName(t.filter("lo = hi OR (size(codes) > 0 AND size(others) > 0)").select("codes", "others"))
    runs = lists.mapInArrow(_runs, "code long, n long")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n long").filter(F.col("n") >= min_together)
    merged = merged.select(F.shiftright("code", 32).alias("ca"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("cb"), F.col("n").alias("n_ab"))
    side = lambda s: small(words.select(F.col("code").alias("c" + s), F.col("item").alias("i" + s), F.col("f").alias("f" + s)), 80)
    j = merged.join(side("a"), "ca").join(side("b"), "cb")
    swap = F.col("ia") > F.col("ib")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    j = j.select(pick("ia", "ib").alias("item_a"), pick("ib", "ia").alias("item_b"), "n_ab", pick("fa", "fb").alias("n_a"), pick("fb", "fa").alias("n_b"), F.lit(n).cast("long").alias("n"))
    j = j.filter(F.col("n_ab").cast("double") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    only_a, only_b = F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    odds = (F.col("n_ab") + 0.5) * (neither + 0.5) / ((only_a + 0.5) * (only_b + 0.5))
    return j.withColumn("lift", lift).withColumn("odds_ratio", odds)
