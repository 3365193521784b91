"""Connected components by alternating large and small stars, with links contracted inside each partition first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.scratch import materialize, release

#: Links that a task contracts at once.
CHUNK = 1 << 20


def _contract(links: pa.Table) -> pa.RecordBatch:
    """A star for each component of some links: its nodes with its smallest one."""
    n = links.num_rows
    ends = pa.chunked_array([*links.column(0).chunks, *links.column(1).chunks]).combine_chunks().dictionary_encode()
    values = ends.dictionary
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    both = rank[ends.indices.to_numpy()]
    u, v = both[:n], both[n:]
    label = np.arange(len(order))
    while True:
        lu, lv = label[u], label[v]
        if (lu == lv).all():
            break
        low = np.minimum(lu, lv)
        np.minimum.at(label, lu, low)
        np.minimum.at(label, lv, low)
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(order)))
    values = values.take(pa.array(order))
    return pa.RecordBatch.from_arrays([values.take(pa.array(moved)), values.take(pa.array(label[moved]))], names=["u", "v"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield _contract(pa.Table.from_batches(held))
            held = []
    if held:
        yield _contract(pa.Table.from_batches(held))


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one link at most towards a smaller node, which has none itself."""
    twice = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    inner = e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each task first contracts the links it holds to stars. Each round then moves every node's
    larger neighbours to the smallest neighbour and every node to its own smallest one, and contracts again,
    until only stars are left. A node's
    neighbours are never gathered: minima are aggregated map-side and joined back,
    so a hub with a third of all links is split like any other skewed join key.
    Null ends and self-links are ignored; repeated links count once; no links give
    no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    schema = e.schema
    e = materialize(e.mapInArrow(_forests, schema), "cc")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter(F.col("u") != F.col("v")).distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().mapInArrow(_forests, schema), "cc")
        release(large)
        release(e)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
