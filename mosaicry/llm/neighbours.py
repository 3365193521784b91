"""The most similar vectors of every vector, by vantage-point trees.

A tree over a bounded sample routes vectors to shards; every vector is indexed in
exactly one. Each shard holds its own tree and lies in a folder of its own; a task answers
a block of queries and reads the shards these must look at, so vectors travel to their shard
once and no copy of them follows a query. Angles between unit vectors are a
metric, so a branch can be left out when the triangle inequality shows that it
holds nothing within the search radius. ``factor`` divides that radius in the test:
one is exact, larger values leave out more and may lose neighbours.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.llm.clusters import by_length, matrix, unit
from mosaicry.scratch import materialize, release
from mosaicry.tables import small

#: Vectors that the routing tree is fitted on, at most.
SAMPLE = 20_000
#: Vectors of a shard, about, and of a leaf of its tree.
SHARD, LEAF = 32_768, 1024
#: Queries of a shard that one task answers.
BLOCK = 8_192
#: Pairs whose exact cosines are computed at once.
CHUNK = 1 << 15
SEED = 7


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y, -1.0, 1.0))


def _pick(x: np.ndarray, rng: np.random.Generator, tries: int = 5) -> int:
    """The vantage point whose distances spread most, of a few tried on a few."""
    few = x[rng.choice(len(x), min(len(x), 256), replace=False)]
    cand = rng.choice(len(x), min(len(x), tries), replace=False)
    return int(cand[np.argmax([_angles(few, x[c]).std() for c in cand])])


class Tree:
    """A vantage-point tree over unit vectors; leaves are index arrays."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = SEED) -> None:
        self.leaves: list[np.ndarray] = []
        self.vantage: list[np.ndarray] = []
        self.root = self._grow(x, np.arange(len(x)), leaf, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, idx: np.ndarray, leaf: int, rng: np.random.Generator):
        if len(idx) > leaf:
            v = x[idx[_pick(x[idx], rng)]]
            d = _angles(x[idx], v)
            cut = float(np.median(d))
            inner = d <= cut
            if inner.any() and not inner.all():
                self.vantage.append(v)
                return (len(self.vantage) - 1, cut, self._grow(x, idx[inner], leaf, rng), self._grow(x, idx[~inner], leaf, rng))
        self.leaves.append(idx)
        return len(self.leaves) - 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                v, cut, a, b = node
                inner = _angles(x[rows], self.vantage[v]) <= cut
                todo += [(a, rows[inner]), (b, rows[~inner])]
        return out

    def visit(self, x: np.ndarray, radius, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows that must look at it); nearer branches first. ``radius(rows)`` may shrink meanwhile."""
        todo = [(self.root, np.arange(len(x)), np.zeros(len(x)))]
        while todo:
            node, rows, gap = todo.pop()
            keep = gap <= radius(rows) / factor  # tested again, the radius may have shrunk
            rows = rows[keep]
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            v, cut, a, b = node
            d = _angles(x[rows], self.vantage[v])
            inner = d <= cut
            away = np.abs(d - cut)
            # the far side is pushed first and so looked at last
            todo += [(b, rows[inner], away[inner]), (a, rows[~inner], away[~inner]), (a, rows[inner], np.zeros(inner.sum())), (b, rows[~inner], np.zeros((~inner).sum()))]


def _search(tree: Tree, x: Vectors, q: Vectors, found: tuple[np.ndarray, np.ndarray], asked: np.ndarray, min_cosine: float, factor: float) -> None:
    """Put what ``x`` holds for the queries ``asked`` among the ids and cosines ``found`` so far; -1 where there are fewer than k."""
    who, best = found
    k = best.shape[1]
    slack = 1e-5  # float32 products; what passes is computed again in double precision
    for leaf, rows in tree.visit(q.unit[asked], lambda r: _radius(best[asked[r]], min_cosine), factor):
        at, rows = tree.leaves[leaf], asked[rows]
        sim = q.unit[rows] @ x.unit[at].T
        least = np.maximum(best[rows, -1], min_cosine).astype(np.float32) - np.float32(slack)
        r, c = np.nonzero(sim >= least[:, None])
        r, c = rows[r], at[c]
        other = q.ids[r] != x.ids[c]
        r, c = r[other], c[other]
        if not len(r):
            continue
        exact = np.concatenate([q.cosines(r[i : i + CHUNK], x, c[i : i + CHUNK]) for i in range(0, len(r), CHUNK)])
        ok = exact >= min_cosine
        r, c, exact = r[ok], c[ok], exact[ok]
        hit = np.unique(r)
        r = np.concatenate([r, np.repeat(hit, k)])
        s = np.concatenate([exact, best[hit].ravel()])
        i = np.concatenate([x.ids[c], who[hit].ravel()])
        o = np.lexsort((i, -s, r))  # ties go to the smaller id
        r, s, i = r[o], s[o], i[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        best[r[top], place[top]], who[r[top], place[top]] = s[top], i[top]


def _radius(best: np.ndarray, min_cosine: float) -> np.ndarray:
    return np.minimum(np.arccos(min_cosine), np.arccos(np.clip(best[:, -1], -1, 1))) + 1e-4


class Vectors:
    """Ids and vectors as they are stored, with their unit vectors in single precision."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray) -> None:
        self.ids, self.raw, self.unit = ids, raw, unit(raw)

    def cosines(self, rows: np.ndarray, other: Vectors, at: np.ndarray) -> np.ndarray:
        a, b = self.raw[rows].astype(np.float64), other.raw[at].astype(np.float64)
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def packed(x: np.ndarray) -> pa.Array:
    """Float32 rows, without loss, as the bytes of equal place together, compressed: no wider than the columns of a table on their way to a shard."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)).reshape(len(x), -1)
    return pa.array([pa.compress(row.tobytes(), codec="zstd", asbytes=True) for row in planes], pa.binary())


def unpacked(rows: pa.Array, dim: int) -> np.ndarray:
    flat = b"".join(pa.decompress(r, decompressed_size=4 * dim, codec="zstd", asbytes=True) for r in rows.to_pylist())
    planes = np.frombuffer(flat, np.uint8).reshape(len(rows), 4, dim).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(np.float32).reshape(len(rows), dim)


def _read(folder: str, rows: int) -> Iterator[Vectors]:
    """The vectors of a folder, at most ``rows`` at once, always in the same order and pieces."""
    fs, path = LocalFileSystem(), re.sub("^file:/*", "/", folder)
    if path == folder:
        fs, path = FileSystem.from_uri(folder)
    for f in sorted(i.path for i in fs.get_file_info(FileSelector(path)) if i.path.endswith(".parquet")):
        with fs.open_input_file(f) as src:
            for b in ParquetFile(src).iter_batches(batch_size=rows, columns=["id", "dim", "packed"]):
                if b.num_rows:
                    yield Vectors(b.column(0).to_numpy(), unpacked(b.column(2), b.column(1)[0].as_py()))


def fit_router(vectors: DataFrame, n: int, sample: int = SAMPLE, shard: int = SHARD) -> bytes:
    """A pickled tree for each space, over at most ``sample`` vectors in all, whose leaves are the shards of all ``n`` vectors.

    A space that the sample holds nothing of has one shard.
    """
    # the ids are chosen first, so that no vector is sorted
    few = vectors.select("id").orderBy(F.xxhash64("id")).limit(sample)
    rows = vectors if n <= sample else vectors.join(F.broadcast(materialize(few, "sample")), "id", "left_semi")
    t = rows.select("space", "vec").toArrow().combine_chunks()
    space = np.array(t.column("space").to_pylist(), dtype=object)
    trees = {}
    for name in sorted(set(space.tolist())):
        x = unit(matrix(t.column("vec").filter(pa.array(space == name))))
        trees[name] = Tree(x, max(1, int(shard * len(space) / max(n, 1))))
        trees[name].leaves = [np.zeros(0, dtype=np.int64)] * len(trees[name].leaves)
    return pickle.dumps(trees)


def unit_vectors(rows: DataFrame, id_col: str, vector: str, space: str | None = None) -> DataFrame:
    """(space, id, vec) of what has a direction; null, all-zero and non-finite vectors are left out, and rows of an unknown space.

    Vectors are compared inside a space, which is the value of ``space`` and the length. They stay
    as they are stored, which packs better than at unit length. An id with several usable vectors keeps the
    smallest one; only rows of ids that occur more than once are shuffled for that.
    """

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _ in by_length(b.column(2)):
                yield b.take(pa.array(at))

    name = F.col(space).cast("string") if space else F.lit("")
    src = rows.select(name.alias("space"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).filter("space IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    src = src.withColumn("space", F.concat_ws("/", "space", F.size("vec")))
    many = small(materialize(rows.select(F.col(id_col).cast("long").alias("id")).groupBy("id").count().filter("count > 1").select("id"), "repeated"), 32)
    schema = "space string, id long, vec array<float>"
    one, several = (src.join(many, "id", how).select("space", "id", "vec").mapInArrow(usable, schema) for how in ("left_anti", "left_semi"))
    return one.unionByName(several.groupBy("id").agg(F.min(F.struct("space", "vec")).alias("v")).select("v.space", "id", "v.vec"))


def _shards(vectors: DataFrame, router: bytes, n: int, shard: int, name: str) -> DataFrame:
    """``vectors`` (id, vec) written to a folder for each shard they lie in, named by ``cell``, with space and shard."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(router)
        for b in batches:
            for name in set(b.column(0).to_pylist()):
                part = b.filter(pc.equal(b.column(0), name))
                x = matrix(part.column(2))
                leaf = trees[name].place(unit(x)) if name in trees else np.zeros(len(x), np.int64)
                dim = pa.array(np.full(len(x), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), dim, packed(x), pa.array(leaf, pa.int64())], names=["space", "id", "dim", "packed", "shard"])

    placed = vectors.select("space", "id", "vec").mapInArrow(home, "space string, id long, dim int, packed binary, shard long")
    placed = placed.withColumn("cell", F.concat_ws("-", F.md5("space"), "shard"))
    # a crowded shard has several files, so that no task writes all of it
    spread = F.pmod(F.xxhash64("id"), F.lit(4))
    return materialize(placed.repartition(max(4, min(4096, 4 * n // shard)), "cell", spread), name, by="cell")


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, min_cosine: float = 0.7, factor: float = 5.0, sample: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(id, other, cosine) of the ``k`` base vectors of its space most similar to each query, at least ``min_cosine``.

    Both inputs are (space, id, vec) as unit_vectors gives them, with unique ids. A
    query does not find its own id. Equal cosines: the smaller id first. A query
    first searches the shard it would lie in itself. What it finds sets its radius, and it goes on to
    the other shards that the relaxed triangle inequality cannot rule out within
    that radius. The queries of a shard are answered in blocks, each a task that
    reads the shards it needs from their folders, a piece at a time with a tree of its own; so the
    disk holds each vector once, a task holds one block and one piece, and a crowded shard
    (many equal vectors cannot be told apart by distance) is many pieces. Exactness does not depend
    on how shards are cut.
    """
    spark = base.sparkSession
    n = base.count()
    router = fit_router(base, n, sample, shard)
    placed = _shards(base, router, n, shard, "shards")
    asked = placed if queries is base else _shards(queries, router, n, shard, "asked")
    root, ours = placed._mosaicry_path, asked._mosaicry_path
    sized = lambda t: [tuple(r) for r in t.groupBy("space", "shard", "cell").count().orderBy("space", "shard").collect()]  # noqa: E731 - one row per shard
    full = sized(placed)
    cells = {(space, s): cell for space, s, cell, _ in full}
    wanted = full if queries is base else sized(asked)
    step = max(1, min(block, -(-sum(m for *_, m in wanted) // (4 * spark.sparkContext.defaultParallelism))))
    step = max(step, min(block, 1024))
    blocks = [(space, s, cell, at, min(at + step, m)) for space, s, cell, m in wanted for at in range(0, m, step)]
    schema = "id long, other long, cosine double"
    if not blocks or not cells:
        return spark.createDataFrame([], schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(router)
        for b in batches:
            for space, home, cell, lo, hi in (blocks[i] for i in b.column(0).to_pylist()):
                at, ids, raw = 0, [], []
                for v in _read(f"{ours}/cell={cell}", shard):
                    part = slice(max(lo - at, 0), max(hi - at, 0))
                    ids.append(v.ids[part])
                    raw.append(v.raw[part])
                    at += len(v.ids)
                    if at >= hi:
                        break
                q = Vectors(np.concatenate(ids), np.concatenate(raw))
                best = np.full((len(q.ids), k), -2.0)
                who = np.full((len(q.ids), k), -1, dtype=np.int64)

                def look(s: int, rows: np.ndarray) -> None:
                    for x in _read(f"{root}/cell={cells[space, s]}", shard) if (space, s) in cells else ():
                        _search(Tree(x.unit, LEAF), x, q, (who, best), rows, min_cosine, factor)

                look(home, np.arange(len(q.ids)))
                others: dict[int, list[np.ndarray]] = {}
                for s, rows in trees[space].visit(q.unit, lambda r: _radius(best[r], min_cosine), factor) if space in trees else ():
                    others.setdefault(s, []).append(rows)
                for s, rows in others.items():
                    if s != home:
                        look(s, np.concatenate(rows))  # each row goes to a shard once
                r, c = np.nonzero(best > -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[r]), pa.array(who[r, c]), pa.array(best[r, c])], names=["id", "other", "cosine"])

    found = materialize(spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(answer, schema), "found")
    for t in {id(t): t for t in (placed, asked)}.values():
        release(t)
    return found
