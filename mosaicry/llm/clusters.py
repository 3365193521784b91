"""Records in clusters of mutually similar ones.

MinHash bands give candidate pairs, the Jaccard similarity of the whole sets
verifies them, connected components form groups, and groups that are too loose are
split around the members with most links. Vectors become sets first: a vector
takes one of two tokens from each of many random planes, depending on its side, so
that the Jaccard similarity of two sets tells their angle; pairs that pass are
verified by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.components import connected_components
from mosaicry.operators.ranking import distributed_rank
from mosaicry.operators.skew import salted_join
from mosaicry.scratch import materialize, release
from mosaicry.tables import small

PLANES = 256
#: Share of the pairs of exactly the asked cosine that meet in some band; more similar ones meet more often.
RECALL = 0.999
#: Rows that a bucket holds by chance, at most.
CHANCE = 8
#: Bands whose buckets link their members to the smallest one before pairs are looked at.
STAR_BANDS = 12
#: Rows up to which a bucket's pairs are formed by one join on the bucket.
SMALL_BUCKET = 256
#: Members of a group that meet as many others in one task.
PAIR_BLOCK = 1024
SEED = 20_260_101


def jaccard_of_cosine(c: float) -> float:
    """Expected Jaccard similarity of the token sets of two vectors with cosine ``c``."""
    same = 1 - np.arccos(np.clip(c, -1, 1)) / np.pi
    return float(same / (2 - same))


def band_recall(jaccard: float, bands: int, rows: int) -> float:
    """Share of pairs of that similarity that meet in some band."""
    return 1 - (1 - jaccard**rows) ** bands


def bands_for(n: int, jaccard: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, MinHashes per band) for ``n`` rows: buckets of unrelated rows stay small and the recall stays the same at any size.

    Unrelated token sets agree in a MinHash with 1/3, so r of them leave n / 3^r rows to meet by chance.
    """
    rows = max(3, math.ceil(math.log(max(n, 1) / CHANCE, 3))) if n > CHANCE else 3
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows)), rows


def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, float32 rows) of a list column for each length that occurs; null, all-zero and non-finite rows are left out."""
    if not len(col):
        return
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat, start = col.values.to_numpy(zero_copy_only=False).astype(np.float32), col.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[start[at][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield at[ok], x[ok]


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose lists all have one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def lists_of(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(kind))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision inside."""
    y = x.astype(np.float64)
    return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _band_keys(sides: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of token sets given as one side per plane.

    A MinHash ranks all 2 x PLANES tokens by a random permutation and takes the first
    one present. Half of all tokens are, so the first 24 ranks nearly always decide;
    a row that none of them decides takes the rest of its permutation.
    """
    n, planes = sides.shape
    rng = np.random.default_rng(SEED)
    out = np.zeros((n, bands), dtype=np.int64)
    for b in range(bands):
        key = np.full(n, b, dtype=np.uint64)
        for _ in range(rows):
            order = rng.permutation(2 * planes)
            head = order[:24]
            there = sides[:, head >> 1] == (head & 1)
            first = there.argmax(axis=1)
            least = head[first]
            for i in np.flatnonzero(~there.any(axis=1)):
                least[i] = order[(sides[i, order >> 1] == (order & 1)).argmax()]
            key = (key ^ least.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        out[:, b] = key.view(np.int64)
    return out


def vector_tokens(rows: DataFrame, id_col: str, vector: str, bands: int = 1, per_band: int = 1) -> DataFrame:
    """(id, vec, code, bands): unit vector, its sides as packed longs, its band keys; unusable vectors are left out.

    Vectors of each length have planes of their own, and keys that tell the length.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in by_length(b.column(1)):
                x = unit(x)
                dim = x.shape[1]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, PLANES)).astype(np.float32)
                sides = (x @ planes[dim] > 0).astype(np.uint8)
                code = np.packbits(sides, axis=1).view(">i8").astype(np.int64)
                keys = _band_keys(sides, bands, per_band) ^ np.int64(dim)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists_of(x, pa.float32()), lists_of(code, pa.int64()), lists_of(keys, pa.int64())], names=["id", "vec", "code", "bands"])

    src = rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    return src.mapInArrow(sign, "id long, vec array<float>, code array<bigint>, bands array<bigint>")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            p = b.filter(pa.array(sizes == dim))
            x, y = (matrix(p.column(i)).astype(np.float64) for i in (2, 3))
            cos = np.einsum("ij,ij->i", x, y) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(cos)], names=["a", "b", "cosine"])


def similar_vector_links(rows: DataFrame, id_col: str, vector: str, min_cosine: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(a, b) links whose components are the groups of vectors with cosine >= ``min_cosine``.

    Equal vectors meet first and stand as one star. Of the rest, each bucket of the first
    STAR_BANDS bands links its members to its smallest one; once these links have formed groups, only pairs of
    different groups that share a bucket of any band are still looked at, so a voice with a third of
    all rows costs one pair per row and band, not one per pair of rows. Buckets carry 128 of the sides only;
    the others and the vectors are fetched for the pairs that these leave. A pair is a
    candidate if the Jaccard similarity of the token sets is within four standard errors
    of what the cosine would give, and a link if the exact cosine is high enough.
    Vectors of different lengths are never similar.
    """
    bands, per_band = bands_for(rows.count(), jaccard_of_cosine(min_cosine), recall)
    t = materialize(vector_tokens(rows, id_col, vector, bands, per_band).withColumn("same", F.xxhash64("vec")), "tokens")
    copies = t.groupBy("same", "vec").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    copies = copies.filter("a < z")
    stars = materialize(t.join(copies, ["same", "vec"]).filter("id > a").select("a", F.col("id").alias("b")), "copies")
    t1 = materialize(t.groupBy("same", "vec").agg(F.min("id").alias("id"), F.first("code").alias("code"), F.first("bands").alias("bands")).drop("same"), "tokens")
    release(t)
    same = 1 - np.arccos(min_cosine) / np.pi
    most = lambda planes: int(planes - np.floor(planes * same - 4 * np.sqrt(planes * same * (1 - same))))
    near = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) + F.bit_count(F.col("da").bitwiseXOR(F.col("db"))) <= most(128)
    differ = sum((F.bit_count(F.col("ca")[i].bitwiseXOR(F.col("cb")[i])) for i in range(PLANES // 64)), F.lit(0))
    codes, vec = t1.select("id", "code"), t1.select("id", "vec")
    few_codes = small(codes, 64)

    def verified(pairs: DataFrame) -> DataFrame:
        p = pairs.distinct().join(few_codes.select(F.col("id").alias("a"), F.col("code").alias("ca")), "a").join(few_codes.select(F.col("id").alias("b"), F.col("code").alias("cb")), "b")
        p = materialize(p.filter(differ <= most(PLANES)).select("a", "b"), "candidates")
        p = p.join(vec.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(vec.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
        return p.select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cosine double").filter(F.col("cosine") >= min_cosine).select("a", "b")

    short = (F.col("code")[0].alias("c"), F.col("code")[1].alias("d"))
    head = t1.select("id", *short, F.explode(F.slice("bands", 1, STAR_BANDS)).alias("key"))
    first = head.groupBy("key").agg(F.min(F.struct("id", "c", "d")).alias("p"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("p.id").alias("a"), F.col("p.c").alias("ca"), F.col("p.d").alias("da"))
    star = head.join(first, "key").filter("id > a").select("a", F.col("id").alias("b"), "ca", "da", F.col("c").alias("cb"), F.col("d").alias("db")).filter(near).select("a", "b")
    links = materialize(verified(star).unionByName(stars), "links")
    group = connected_components(links).withColumnsRenamed({"node": "id", "component": "g"})
    grouped = materialize(t1.select("id", *short, "bands").join(group, "id", "left").withColumn("g", F.coalesce("g", "id")), "grouped")
    member = grouped.select("id", "c", "d", "g", F.explode("bands").alias("key"))
    # a bucket of few rows: one join; of many rows: by pairs of its groups, so that rows of one group never meet
    crowded = materialize(member.groupBy("key").agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).filter(F.col("n") > SMALL_BUCKET).select("key", "lo", "hi"), "crowded")
    few = member.join(small(crowded.select("key"), 16), "key", "left_anti")
    x = few.select("key", F.col("g").alias("ga"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("d").alias("da"))
    y = few.select("key", F.col("g").alias("gb"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("d").alias("db"))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    more = x.join(y, "key").filter(F.col("ga") < F.col("gb")).filter(near).select(*ordered("a", "b"))
    if not crowded.isEmpty():
        many = materialize(member.join(small(crowded.filter("lo < hi").select("key"), 16), "key", "left_semi"), "many")
        sides = many.select("key", "g").distinct()
        meet = salted_join(sides.withColumnRenamed("g", "ga"), sides.withColumnRenamed("g", "gb"), "key", "ga").filter("ga < gb")
        left = meet.join(many.select("key", F.col("g").alias("ga"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("d").alias("da")), ["key", "ga"]).withColumn("k2", F.xxhash64("key", "gb"))
        right = many.select(F.xxhash64("key", "g").alias("k2"), F.col("key").alias("kb"), F.col("g").alias("g2"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("d").alias("db"))
        wide = salted_join(right, left, "k2", "b").filter(F.col("kb") == F.col("key")).filter(F.col("g2") == F.col("gb")).filter(near).select(*ordered("a", "b"))
        more = more.unionByName(wide)
    return links.unionByName(materialize(verified(more), "links"))


def vector_groups(rows: DataFrame, id_col: str, vector: str, min_cosine: float = 0.8) -> DataFrame:
    """(id, group_id) of vectors in a group of two or more; group_id is the smallest id.

    A group is everything that pairs of cosine >= ``min_cosine`` join, directly or
    through others. Null, all-zero and non-finite vectors belong to none; repeated
    ids should have equal vectors and count once; an empty table gives no rows.
    """
    c = connected_components(similar_vector_links(rows.dropDuplicates([id_col]), id_col, vector, min_cosine))
    return c.select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def similar_pairs_within(members: DataFrame, min_cosine: float = 0.8) -> DataFrame:
    """(a, b) of all pairs of one group with cosine >= ``min_cosine``, a < b; ``members`` has (group_id, id, vec).

    A group is cut into blocks of about PAIR_BLOCK members and each pair of blocks meets
    in one task, so no task holds more than two blocks and their cosines.
    """
    parts = members.groupBy("group_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("parts"))
    t = members.join(parts, "group_id").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = t.select("group_id", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"), "p", "id", "vec")

    def meet(block: pa.Table) -> pa.Table:
        ids, p = block.column("id").to_numpy(), block.column("p").to_numpy()
        lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
        x = matrix(block.column("vec")).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        i, j = np.flatnonzero(p == lo), np.flatnonzero(p == hi)
        r, c = np.nonzero(x[i] @ x[j].T >= min_cosine)
        u, v = ids[i[r]], ids[j[c]]
        keep = u < v if lo == hi else u != v
        return pa.table({"a": pa.array(np.minimum(u, v)[keep], pa.int64()), "b": pa.array(np.maximum(u, v)[keep], pa.int64())})

    return t.groupBy("group_id", "lo", "hi").applyInArrow(meet, "a long, b long")


def split_around_medoids(links: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(id, medoid) for every end of ``links`` (a, b): groups of which each member is linked to its medoid.

    A round makes medoids of all open nodes that have more links than any open
    neighbour (ties: the smaller id); open nodes linked to one join the medoid with
    most links. Rounds go on until no node is open; each closes the best node of
    every component. ``links`` must hold every link. With ``copies`` (id, copies) a node
    stands for so many equal ones, and links count as they would between all of these.
    """
    e = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    rank = F.struct("n", (-F.col("a")).alias("i"))
    if copies is None:
        degree = e.groupBy("a").agg(F.count("*").alias("n"))
    else:
        degree = e.join(copies.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
        degree = degree.join(copies.select(F.col("id").alias("a"), F.col("copies").alias("own")), "a").select("a", (F.col("n") + F.col("own") - 1).alias("n"))
    node = materialize(degree.select(F.col("a").alias("id"), rank.alias("r")), "nodes")
    done = None
    while not node.isEmpty():
        near = e.join(node.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
        top = near.groupBy("a").agg(F.max("rb").alias("top"))
        lead = node.join(top.withColumnRenamed("a", "id"), "id", "left").filter("top IS NULL OR r > top").select("id", "r")
        lead = materialize(lead, "medoids")
        mine = e.join(lead.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b").join(node.select(F.col("id").alias("a")), "a", "left_semi").groupBy("a").agg(F.max(F.struct(F.col("rb"), F.col("b"))).alias("m"))
        closed = lead.select("id", F.col("id").alias("medoid")).unionByName(mine.select(F.col("a").alias("id"), F.col("m.b").alias("medoid")))
        closed = materialize(closed, "closed")
        done = closed if done is None else done.unionByName(closed)
        node = materialize(node.join(closed, "id", "left_anti"), "nodes")
    return done if done is not None else links.sparkSession.createDataFrame([], "id long, medoid long")


def describe_groups(rows: DataFrame, id_col: str, vector: str, groups: DataFrame, typical: int = 3, min_cosine: float = 0.8, links: DataFrame | None = None, split: bool = False) -> DataFrame:
    """(group_id, size, spread, typical): each group's size, mean 1 - cosine to its centre, and most typical ids.

    ``groups`` has (id, group_id). With ``split`` a group whose mean cosine to its
    centre is below ``min_cosine`` is loose and is split around its medoids first: all
    similar pairs of its distinct vectors are found, and equal vectors get one medoid.
    ``links`` splits by given links instead, which must hold every similar pair.
    Typical ids are those closest to the centre, the closest first, ties by id.
    """

    def centred(g: DataFrame) -> DataFrame:
        t = vec.join(g, "id")
        c = t.select("group_id", F.posexplode("vec").alias("i", "x")).groupBy("group_id", "i").agg(F.sum("x").alias("x"))
        c = c.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
        dot = F.aggregate(F.zip_with("vec", "centre", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda a, b: a + b)
        norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, b: a + b * b))
        return materialize(t.join(c, "group_id").select("id", "group_id", (dot / norm).alias("cosine")), "centred")

    vec = materialize(vector_tokens(rows.dropDuplicates([id_col]), id_col, vector, 1, 1).select("id", "vec"), "vectors")
    near = centred(groups)
    if links is not None or split:
        loose = near.groupBy("group_id").agg(F.avg("cosine").alias("m")).filter(F.col("m") < min_cosine).select("group_id")
        inside = materialize(groups.join(loose, "group_id", "left_semi").select("id", "group_id"), "loose")
        if links is not None:
            parts = split_around_medoids(links.join(inside.select(F.col("id").alias("a")), "a", "left_semi"))
        else:
            t = vec.join(inside, "id").withColumn("same", F.xxhash64("vec"))
            first = materialize(t.groupBy("group_id", "same", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct")
            parts = split_around_medoids(similar_pairs_within(first.select("group_id", "id", "vec"), min_cosine), first.select("id", "copies"))
            of = first.join(parts, "id").select("group_id", "same", "vec", "medoid")
            parts = materialize(t.join(of, ["group_id", "same", "vec"]).select("id", "medoid"), "parts")
        near = centred(groups.join(parts, "id", "left").select("id", F.coalesce("medoid", "group_id").alias("group_id")))
    best = distributed_rank(near, ["group_id"], [F.desc("cosine"), F.asc("id")]).filter(F.col("rank") < typical)
    best = best.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda p: p["id"]).alias("typical"))
    size = near.groupBy("group_id").agg(F.count("*").alias("size"), (1 - F.avg("cosine")).alias("spread"))
    return size.join(best, "group_id")
