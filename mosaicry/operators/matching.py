"""Joins by distance to places, by words in texts, by overlap of intervals, and by likeness of names."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.functions.geo import EARTH_M, haversine_m, usable_point
from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize
from mosaicry.tables import small

#: Letter pairs in a key that two names share; one alone where either name is longer than LONG.
TOGETHER, LONG = 2, 40
#: Room for rounding where a bound on matched letters is worked out.
_EPS = 1e-9


def _xyz(lat: str, lon: str) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [EARTH_M * F.cos(la) * F.cos(lo), EARTH_M * F.cos(la) * F.sin(lo), EARTH_M * F.sin(la)]


def places_within(points: DataFrame, places: DataFrame, default_m: float = 500.0) -> DataFrame:
    """(id, place, distance_m): all places whose own radius reaches a point.

    points: id, lat, lon; places: place, lat, lon, radius_m (null or 0 means
    ``default_m``). Radii are met in classes of like size, each with a grid of its
    own, so one far-reaching place does not coarsen the grid of the others.
    """
    pts = points.select("id", "lat", "lon").filter(usable_point(F.col("lat"), F.col("lon"))).dropDuplicates(["id"])
    pl = places.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.coalesce(F.when(F.col("radius_m") > 0, F.col("radius_m")), F.lit(default_m)).cast("double").alias("r"))
    pl = pl.filter(usable_point(F.col("plat"), F.col("plon"))).withColumn("size", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(2 * F.col("r"))), F.lit(5))))
    pl = materialize(pl, "places")
    sizes = [r["size"] for r in pl.select("size").distinct().collect()]  # powers of two up to the earth's size
    if not sizes:
        return pts.select("id", F.lit(None).cast("string").alias("place"), F.lit(0.0).alias("distance_m")).limit(0)
    slot = lambda v, s: F.floor(v / s) + F.lit(1 << 20)
    key = lambda s, c: F.xxhash64(s, *c)
    x = pts.select("*", *[c.alias(f"c{i}") for i, c in enumerate(_xyz("lat", "lon"))])
    x = x.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    x = x.select("id", "lat", "lon", key(F.col("size"), [slot(F.col(f"c{i}"), F.col("size")) for i in range(3)]).alias("cell"))
    y = pl.select("*", *[c.alias(f"c{i}") for i, c in enumerate(_xyz("plat", "plon"))])
    for i in range(3):
        c = F.col(f"c{i}")
        y = y.withColumn(f"c{i}", F.explode(F.sequence(slot(c - F.col("r") - 1e-3, F.col("size")), slot(c + F.col("r") + 1e-3, F.col("size")))))
    y = y.select("place", "plat", "plon", "r", key(F.col("size"), [F.col(f"c{i}") for i in range(3)]).alias("cell"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return salted_join(x, y, "cell", "id").withColumn("distance_m", d).filter("distance_m <= r").select("id", "place", "distance_m").distinct()


def nearest_place(points: DataFrame, places: DataFrame, default_m: float = 500.0) -> DataFrame:
    """(id, place, distance_m): the nearest place within reach of each point; ties go to the smaller place."""
    m = places_within(points, places, default_m)
    best = m.groupBy("id").agg(F.min(F.struct("distance_m", "place")).alias("b"))
    return best.select("id", F.col("b.place").alias("place"), F.col("b.distance_m").alias("distance_m"))


def best_overlap(segments: DataFrame, spans: DataFrame, key: str, slice_ms: int = 60_000) -> DataFrame:
    """(id, span_id, overlap_ms): the span of the same key with the longest common time; ties: the smaller span_id.

    segments: id, key, start_ms, end_ms; spans: span_id, key, start_ms, end_ms. Null
    or empty intervals overlap nothing. Both are cut into slices of time, so a long
    recording is many small joins.
    """

    def sliced(df: DataFrame) -> DataFrame:
        df = df.filter("end_ms > start_ms")
        return df.withColumn("_part", F.explode(F.sequence(F.floor(F.col("start_ms") / slice_ms), F.floor((F.col("end_ms") - 1) / slice_ms))))

    a = sliced(segments.select("id", key, "start_ms", "end_ms"))
    b = sliced(spans.select("span_id", key, "start_ms", "end_ms")).select("span_id", key, "_part", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    j = a.join(b, [key, "_part"]).withColumn("o", F.least("end_ms", "e2") - F.greatest("start_ms", "s2")).filter("o > 0")
    best = j.groupBy("id").agg(F.max(F.struct("o", (-F.col("span_id")).alias("s"))).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("span_id"), F.col("b.o").alias("overlap_ms"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def mentions(texts: DataFrame, id_col: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(id, term): terms whose words stand in a row in a text, whatever their case and what lies between.

    Terms are grouped by their number of words; each text gives its runs of those
    lengths and meets the terms by an equi-join. Terms without words match nothing.
    """
    t = terms.select(F.col(term).alias("term")).distinct().withColumn("w", _words(F.col("term"))).withColumn("n", F.size("w")).filter("n > 0")
    t = materialize(t.select("term", "n", F.array_join("w", " ").alias("run")), "terms")
    lengths = sorted(r["n"] for r in t.select("n").distinct().collect())
    d = texts.select(F.col(id_col).alias("id"), _words(F.col(text)).alias("w")).filter(F.size("w") > 0)

    def runs_of(n: int) -> Column:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("w", i, n), " "))

    runs = F.concat(F.array().cast("array<string>"), *[runs_of(n) for n in lengths])
    d = d.select("id", F.explode(F.array_distinct(runs)).alias("run"))
    if t.count() * 100 <= 64 << 20:
        t = F.broadcast(t)
    return d.join(t, "run").select("id", "term").distinct()


def _bucket(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """A number below 65,536 for two neighbouring letters."""
    return (a * 40503 + b) & 0xFFFF


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        c = np.frombuffer("\0".join(b.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
        inside = (c[:-1] > 0) & (c[1:] > 0)
        total += np.bincount(_bucket(c[:-1], c[1:])[inside], minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def _shared_pairs(n: int, threshold: float) -> tuple[dict[int, int], list[int]]:
    """For a name of n letters: the fewest letter pairs it shares with partners met by keys of k pairs, for each k; lengths of partners that may share none."""
    least, free = {}, []
    for o in range(math.ceil(n * threshold / (2 - threshold) - _EPS), math.floor(n * (2 - threshold) / threshold + _EPS) + 1):
        m = math.ceil((n + o) * (threshold / 2) - _EPS)
        if m <= min(n, o) and m < max(n, o):  # else too few letters, or equal names
            shared = 3 * m - n - o - 1
            k = min(shared, 1 if max(n, o) > LONG else TOGETHER)
            if k > 0:
                least[k] = min(shared, least.get(k, shared))
            else:
                free.append(o)
    return least, free


_KEYS = "key long, id long, len int, letters long, more_letters int, pairs long, more_pairs int"


def _name_keys(threshold: float, count: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``_KEYS`` for (id, s): the keys of a name, and its letters and letter pairs as bits (what has no bit of its own is counted in more_...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, plan = count.tolist(), functools.cache(lambda n: _shared_pairs(n, threshold))
        for b in batches:
            key, times, facts = [], [], []
            for s in b.column(1).to_pylist():
                letters = [ord(c) for c in s]
                buckets = [_bucket(x, y) for x, y in pairwise(letters)]
                nth: Counter[int] = Counter()
                rare = []
                for x in buckets:
                    rare.append((often[x], x, nth[x]))
                    nth[x] += 1
                rare = [x | (i & 0x7FFF) << 16 for _, x, i in sorted(rare)]
                n = len(s)
                least, free = plan(n)
                mine = {3 << 61 | min(n, o) << 20 | max(n, o) for o in free}
                for k, shared in least.items():
                    for c in combinations(rare[: n - 1 - shared + k], k):
                        mine.add(1 << 62 | c[0] if k == 1 else c[0] << 31 | c[1])
                key += mine
                times.append(len(mine))
                bits = sum(((1 << min(k, 2)) - 1) << 2 * x for x, k in Counter(x % 32 for x in letters).items())
                bits2 = sum(1 << x for x in {x % 64 for x in buckets})
                facts.append((n, bits, n - bits.bit_count(), bits2, len(buckets) - bits2.bit_count()))
            cols = [np.array([f[i] for f in facts], t) for i, t in enumerate((np.int32, np.uint64, np.int32, np.uint64, np.int32))]
            cols = [np.array(key, np.int64), *[np.repeat(c, times) for c in (b.column(0).to_numpy(), *cols)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=[x.split()[0] for x in _KEYS.split(", ")])

    return run


def alike_candidates(norms: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i < j: pairs of (id, s) that may have ``threshold`` of their letters in common; no pair that does is missing.

    A ratio of t needs M = t (la + lb) / 2 letters in the same order. Of the M - 1 steps
    between them each unmatched letter of either name breaks one at most, so at least
    c = 3 M - la - lb - 1 pairs of neighbouring letters are shared. With all pairs in one
    order, rare ones first, the first k shared pairs stand among the first n - c + k of the
    n pairs of each name; k of them make a key, so what many names have in common
    makes none. What meets must share enough letters and enough pairs, counted in bits.
    """
    spark = norms.sparkSession
    count = np.zeros(1 << 16, np.int64)
    for r in norms.select("s").mapInArrow(_count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        count[r["bucket"]] = r["n"]
    keys = materialize(norms.select("id", "s").mapInArrow(_name_keys(threshold, count), _KEYS), "keys")
    # a small table makes many pairs
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x, y = (keys.repartition(tasks, "key").withColumnsRenamed({c: c + k for c in keys.columns if c != "key"}) for k in "12")
    need = F.ceil((F.col("len1") + F.col("len2")) * (threshold / 2) - _EPS)
    shared = lambda c: F.bit_count(F.col(c + "1").bitwiseAND(F.col(c + "2"))) + F.least(f"more_{c}1", f"more_{c}2")
    j = salted_join(x, y, "key", "id1").filter("id1 < id2").filter(F.least("len1", "len2") >= need).filter(shared("letters") >= need)
    j = j.filter(shared("pairs") >= 3 * need - F.col("len1") - F.col("len2") - 1)
    return j.select(F.col("id1").alias("i"), F.col("id2").alias("j")).distinct().repartition(tasks, "i", "j")


def _in_order(x: list[str], y: list[str]) -> np.ndarray:
    """Letters in the longest common subsequence of each pair of names of at most 64 letters; a bit for each letter of x."""
    a, b = (np.array(v, "U64").view(np.uint32).reshape(-1, 64) for v in (x, y))
    v = np.full(len(x), 2**64 - 1, np.uint64)
    for k in range(min(64, max(map(len, y), default=0))):
        c = b[:, k : k + 1]
        u = v & np.packbits((a == c) & (c > 0), axis=1, bitorder="little").view("<u8").ravel()
        v = (v + u) | (v - u)
    return np.bitwise_count(~v)


def similar_names(names: DataFrame, name: str, threshold: float = 0.85) -> DataFrame:
    """(name_a, name_b, ratio) of distinct names with a matching-blocks ratio of at least ``threshold``, name_a < name_b.

    Names are compared in lower case without punctuation; those that become equal are
    left out. The ratio is 2 M / (la + lb) with M matched letters. Each spelling is
    compared once, whatever the names that have it. The blocks depend on which name comes first, so
    two spellings are compared in both directions if their names stand in both orders.
    """
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"\s+", " "))
    n = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("name"), norm.alias("s")).filter("s <> ''").distinct()
    n = materialize(n, "names")
    s = n.groupBy("s").agg(F.min("name").alias("first"), F.max("name").alias("last")).repartition(n.sparkSession.sparkContext.defaultParallelism, "s")
    s = materialize(s.withColumn("id", F.monotonically_increasing_id()), "spellings")

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            lx, ly = np.array([len(v) for v in x], int), np.array([len(v) for v in y], int)
            may = (np.maximum(lx, ly) > 64) | (_in_order(x, y) >= np.ceil((lx + ly) * (threshold / 2) - _EPS))
            one, other = np.zeros(len(x)), np.zeros(len(x))
            for r, u, v, wanted in ((one, x, y, b.column(4)), (other, y, x, b.column(5))):
                for k in np.flatnonzero(may & wanted.to_numpy(zero_copy_only=False)):
                    r[k] = SequenceMatcher(None, u[k], v[k], autojunk=False).ratio()
            keep = pa.array(np.maximum(one, other) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one), pa.array(other)], names=["i", "j", "one", "other"]).filter(keep)

    side = lambda df, i, **c: small(df.select(F.col("id").alias(i), *[F.col(v).alias(k) for k, v in c.items()]), 200)
    pairs = alike_candidates(s, threshold).join(side(s, "i", x="s", x1="first", x2="last"), "i").join(side(s, "j", y="s", y1="first", y2="last"), "j")
    pairs = pairs.select("i", "j", "x", "y", F.col("x1") < F.col("y2"), F.col("y1") < F.col("x2")).mapInArrow(ratios, "i long, j long, one double, other double")
    n = materialize(n.join(s, "s").select("name", "id"), "names")
    out = pairs.join(side(n, "i", a="name"), "i").join(side(n, "j", b="name"), "j")
    out = out.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"), F.when(F.col("a") < F.col("b"), F.col("one")).otherwise(F.col("other")).alias("ratio"))
    return out.filter(F.col("ratio") >= threshold).select("name_a", "name_b", F.round("ratio", 4).alias("ratio"))
