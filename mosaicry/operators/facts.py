"""Long tables of facts into wide records, and reports over many tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.ranking import distributed_rank
from mosaicry.functions.vectors import cosine


def pivot_max(facts: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key with the greatest value of each of ``names``; the names are given, so no extra pass finds them."""
    return facts.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def json_facts(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value) of the top-level fields of JSON objects; malformed and null documents give none."""
    m = F.from_json(F.col(document), "map<string,string>")
    return rows.select(F.col(key), F.explode(m).alias("name", "value")).filter("value IS NOT NULL")


def first_known(facts: DataFrame, key: str, name: str, value: str, registry: DataFrame) -> DataFrame:
    """(key, canonical, value): each canonical field from its best present source field.

    ``registry`` has (canonical, name, priority); smaller priorities win, ties the
    smaller name.
    """
    j = facts.filter(F.col(value).isNotNull()).join(registry.select("canonical", F.col("name").alias(name), "priority"), name)
    best = j.groupBy(key, "canonical").agg(F.min(F.struct("priority", name, value)).alias("b"))
    return best.select(key, "canonical", F.col(f"b.{value}").alias(value))


def coverage(files: DataFrame, flags: dict[str, DataFrame], counts: dict[str, DataFrame], key: str = "file_id") -> DataFrame:
    """One row per file: whether it occurs in each of some tables, and how often in each of others.

    All tables are stacked, aggregated once by file and joined once, whatever their number.
    """
    facts = None
    for name, df in {**flags, **counts}.items():
        f = df.select(F.col(key).alias("id"), F.lit(name).alias("what"))
        facts = f if facts is None else facts.unionByName(f)
    agg = [F.max(F.when(F.col("what") == n, True)).alias(n) for n in flags] + [F.count(F.when(F.col("what") == n, 1)).alias(n) for n in counts]
    wide = facts.groupBy("id").agg(*agg)
    out = files.select("id", "path").join(wide, "id", "left")
    return out.select("id", "path", *[F.coalesce(n, F.lit(False)).alias(n) for n in flags], *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def joined_text(rows: DataFrame, key: str, text: str, separator: str = " ") -> DataFrame:
    """(key, text): the distinct texts of each key in order."""
    d = rows.filter(F.col(text).isNotNull()).select(key, text).distinct()
    return d.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), separator).alias(text))


def prefer(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``; aggregated map-side, so no group is gathered."""
    names = [f"_p{i}" for i in range(len(order))]
    r = rows.select("*", *[c.alias(n) for c, n in zip(order, names)])
    best = r.groupBy(*[F.col(g) for g in group]).agg(F.min_by(F.struct(*rows.columns), F.struct(*names)).alias("b"))
    return best.select("b.*")


def _vector_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, s, k): the sum and number of the vectors of each group among a task's rows; vectors of one group must be of one length."""
    sums: dict = {}

    def out() -> pa.RecordBatch:
        s = pa.array([x[0] for x in sums.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), s, pa.array([x[1] for x in sums.values()], pa.int64())], names=["g", "s", "k"])

    for b in batches:
        kind, g = b.schema.field(0).type, b.column(0).dictionary_encode()
        col = b.column(1)
        flat, at = col.values.to_numpy(zero_copy_only=False).astype(np.float64), col.offsets.to_numpy()
        code = g.indices.to_numpy()
        for i, key in enumerate(g.dictionary.to_pylist()):
            rows = np.flatnonzero(code == i)
            x = np.stack([flat[at[r] : at[r + 1]] for r in rows]).sum(axis=0)
            old = sums.get(key)
            sums[key] = (x, len(rows)) if old is None else (old[0] + x, old[1] + len(rows))
        if len(sums) > 20_000:
            yield out()
            sums = {}
    if sums:
        yield out()


def trimmed_centroids(rows: DataFrame, group: str, id_col: str, vector: str, trim: float = 0.10) -> DataFrame:
    """(group, centroid, n, spread): mean direction of each group without its floor(trim n) rows farthest from the mean.

    Distances are 1 - cosine to the group's mean, ties go by id; the spread is the
    mean distance of the kept rows to the centroid. Means are sums per coordinate,
    and the cut is found by a distributed rank, so one large group is many tasks.
    All-zero and null vectors are left out.
    """
    from mosaicry.scratch import materialize
    from mosaicry.tables import small

    v = rows.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vector).alias("v")).filter("g IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id"])
    v = materialize(v.filter(F.exists("v", lambda x: x != 0)), "vectors")

    def centre(t: DataFrame) -> DataFrame:
        # sums over each task's rows first, so that only one vector for each group and task is taken apart
        part = t.select("g", "v").mapInArrow(_vector_sums, f"g {t.schema['g'].dataType.simpleString()}, s array<double>, k bigint")
        c = part.select("g", "k", F.posexplode("s").alias("i", "x")).groupBy("g", "i").agg((F.sum("x") / F.sum("k")).alias("x"))
        c = c.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
        size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
        return c.select("g", F.when(size > 0, F.transform("c", lambda x: x / size)).otherwise(F.col("c")).alias("c"))

    # ranked without the vectors, which stay where they are
    far = v.join(small(materialize(centre(v), "centres"), 4096), "g").select("g", "id", (1 - cosine(F.col("v"), F.col("c"))).alias("d"))
    kept = distributed_rank(far, ["g"], [F.asc("d"), F.asc("id")]).filter(F.col("rank") < F.col("n") - F.floor(F.col("n") * trim)).select("id")
    kept = materialize(v.join(kept, "id", "left_semi"), "kept")
    c = small(materialize(centre(kept), "centres"), 4096)
    spread = kept.join(c, "g").groupBy("g").agg(F.count("*").alias("n"), F.avg(1 - cosine(F.col("v"), F.col("c"))).alias("spread"))
    return c.join(spread, "g").select(F.col("g").alias(group), F.col("c").alias("centroid"), "n", "spread")


def same_set_key(items: Column) -> Column:
    """One string for all arrays that hold the same items, whatever their order, case, blanks and repeats; empty for none."""
    tidy = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(tidy)), "|")


def resolve_links(rows: DataFrame, key: str, parent: str, name: str, depth: int = 3) -> DataFrame:
    """(key, name, chain): each row's name followed by those of its parents, up to ``depth`` steps.

    A step that leads to a row already in the chain, or to no row, ends it.
    """
    links = rows.select(F.col(key).alias("_k"), F.col(parent).alias("_up"), F.col(name).alias("_name")).dropDuplicates(["_k"])
    out = links.select(F.col("_k").alias("key"), F.col("_name").alias("name"), F.col("_up").alias("next"), F.array("_k").alias("seen"), F.array("_name").alias("names"))
    for _ in range(depth):
        j = out.join(links, out["next"] == links["_k"], "left")
        new = F.col("_k").isNotNull() & ~F.array_contains("seen", F.coalesce("_k", F.col("key")))
        out = j.select("key", "name", F.when(new, F.col("_up")).alias("next"), F.when(new, F.concat("seen", F.array("_k"))).otherwise(F.col("seen")).alias("seen"), F.when(new, F.concat("names", F.array("_name"))).otherwise(F.col("names")).alias("names"))
    return out.select("key", "name", F.array_join("names", " > ").alias("chain"))
