"""Measures of pictures and sound given as arrays of numbers, and folds over ordered lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mosaicry.functions.vectors import hamming_hex

_QUALITY = "id long, sharpness double, exposure double, highlights double, shadows double, luminance_std_dev double, saturation_mean double, dominant_hue double"


def frame_quality(rgb: np.ndarray) -> tuple[float, ...]:
    """Sharpness (variance of the Laplacian, edges wrapped), mean brightness, shares above 250 and below 5,
    spread of brightness, mean saturation and the middle of the fullest of 36 hue bins, of an H x W x 3 image of bytes."""
    x = rgb.astype(np.float64)
    grey = x @ np.array([0.299, 0.587, 0.114])
    around = sum(np.roll(grey, s, axis=a) for a in (0, 1) for s in (-1, 1))
    high, low = x.max(axis=2), x.min(axis=2)
    span = high - low
    saturation = np.divide(span, high, out=np.zeros_like(high), where=high > 0)
    r, g, b = (x[..., i] for i in range(3))
    safe = np.where(span > 0, span, 1)
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    bins = np.bincount((hue[span > 0] // 10).astype(int) % 36, minlength=36)
    main = float(bins.argmax() * 10 + 5) if bins.any() else 0.0
    return float((around - 4 * grey).var()), float(grey.mean() / 255), float((grey > 250).mean()), float((grey < 5).mean()), float(grey.std() / 255), float(saturation.mean()), main


def image_quality(images: DataFrame, id_col: str, pixels: str, width: str, height: str) -> DataFrame:
    """The measures of raw images (binary, three bytes a pixel); rows whose size does not fit give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p, w, h in zip(b["id"], b["p"], b["w"], b["h"]):
                fits = p is not None and w and h and len(p) == 3 * int(w) * int(h)
                rows.append((i, *(frame_quality(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)) if fits else [None] * 7)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _QUALITY.split(", ")])

    src = images.select(F.col(id_col).cast("long").alias("id"), F.col(pixels).alias("p"), F.col(width).alias("w"), F.col(height).alias("h"))
    return src.mapInPandas(run, _QUALITY)


def mean_metrics(frames: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Each key's mean of every metric over its frames."""
    return frames.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics])


def has_speech(samples: Column, rate: int, threshold_dbfs: float, window_ms: int = 100) -> Column:
    """Whether a window of 16-bit samples is louder (RMS) than the threshold."""
    n = max(1, rate * window_ms // 1000)
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), F.lit(n))).otherwise(F.array().cast("array<int>"))
    limit = (32768 * 10 ** (threshold_dbfs / 20)) ** 2

    def loud(s: Column) -> Column:
        w = F.slice(samples, s, n)
        return F.aggregate(w, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(w) > limit

    return F.exists(starts, loud)


def peak(samples: Column) -> Column:
    """struct(peak_db, clipped) of 16-bit samples; silence and empty arrays have no peak."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("long"))))
    return F.struct(F.when(top > 0, 20 * F.log10(top / 32768.0)).alias("peak_db"), F.coalesce(top >= 32700, F.lit(False)).alias("clipped"))


def normalised_samples(samples: Column) -> Column:
    """16-bit samples scaled so that the loudest is full; silence stays."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("long"))))
    return F.when(top > 0, F.transform(samples, lambda x: F.floor(x * 32767 / top).cast("smallint"))).otherwise(samples)


def sample_times(duration_ms: Column, n: int) -> Column:
    """``n`` times spread evenly inside a duration."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(duration_ms * i / (n + 1)).cast("long"))


def distinct_frames(hashes: Column, max_bits: int) -> Column:
    """Of an ordered array of 16-digit hashes, those that differ from the last one kept in more than ``max_bits`` bits."""
    last = lambda kept: F.element_at(kept, -1)
    return F.aggregate(hashes, F.array().cast("array<string>"), lambda kept, h: F.when((F.size(kept) == 0) | (hamming_hex(last(kept), h) > max_bits), F.concat(kept, F.array(h))).otherwise(kept))


def leaders(rows: DataFrame, key: str, id_col: str, order: str, vector: str, threshold: float, block: int = 5_000) -> DataFrame:
    """(id, key, leader, similarity): each vector in order joins the most similar running centroid of its key, if at least ``threshold``, or starts one.

    The fold is sequential within a key. A key with more than ``block`` rows is folded in
    stretches of its order; a full stretch hands its centroids and their counts to the
    next one as a written table, so no task takes more rows than a stretch and the leaders are those of
    one fold over the whole key. Null and zero vectors are left out. Keys share no leaders.
    """
    from mosaicry.operators.ranking import distributed_rank
    from mosaicry.scratch import materialize

    r = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(order).alias("o"), F.col(vector).cast("array<float>").alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    most = r.select("key", "id").distinct().groupBy("key").count().agg(F.max("count")).first()[0] or 0
    last = max(0, most - 1) // block
    if last:
        # ranks without the vectors, so that these are sorted and written nowhere
        r = r.dropDuplicates(["id"])
        ranks = distributed_rank(r.select("key", "id", "o"), ["key"], [F.asc("o"), F.asc("id")]).select("id", "rank")
        r = r.drop("o").join(ranks, "id").withColumn("part", F.floor(F.col("rank") / block)).select("key", "part", "id", F.col("rank").alias("o"), "v")
        r = materialize(r, "ranked")
    else:
        # every key fits a task, which puts its rows in order itself; the vectors travel once
        r = r.select("key", F.lit(0).cast("long").alias("part"), "id", "o", "v")
    schema = f"id long, key {r.schema['key'].dataType.simpleString()}, leader long, similarity double, no long, members long, centre array<double>"

    kinds = pa.schema([("id", pa.int64()), ("key", to_arrow_type(r.schema["key"].dataType)), ("leader", pa.int64()), ("similarity", pa.float64()), ("no", pa.int64()), ("members", pa.int64()), ("centre", pa.list_(pa.float64()))])

    def fold(b: pa.Table, before: pa.Table | None = None) -> pa.Table:
        names, counts, centres = [], [], np.zeros((0, 0))
        if before is not None and before.num_rows:
            before = before.sort_by("no")
            names, counts = before.column("leader").to_pylist(), before.column("members").to_pylist()
            centres = before.column("centre").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1).copy()
        n = len(names)
        ids, whom, how = [], [], []
        b = b.take(pc.sort_indices(b.select(["o", "id"]), sort_keys=[("o", "ascending"), ("id", "ascending")], null_placement="at_start"))
        every = b.column("id").to_numpy()
        b = b.filter(pa.array(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]))
        vs = b.column("v").combine_chunks()
        for i, v in zip(b.column("id").to_pylist(), vs):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.linalg.norm(x)
            if not size or not np.isfinite(size):
                continue
            x = x / size
            sims = centres[:n] @ x if n else np.zeros(0)
            k = int(sims.argmax()) if n else -1
            if k >= 0 and sims[k] >= threshold:
                m = centres[k] * counts[k] + x
                centres[k], counts[k] = m / max(np.linalg.norm(m), 1e-12), counts[k] + 1
                whom.append(names[k])
                how.append(float(sims[k]))
            else:
                if n == len(centres):
                    centres = np.concatenate([centres.reshape(n, len(x)), np.zeros((max(16, n), len(x)))])
                centres[n] = x
                n += 1
                counts.append(1)
                names.append(i)
                whom.append(i)
                how.append(1.0)
            ids.append(i)
        kept = range(n) if b.num_rows == block else range(0)
        f, g = [None] * len(ids), [None] * len(kept)
        one = b.column("key")[0].as_py() if b.num_rows else None
        cols = [ids + g, [one] * (len(ids) + len(kept)), whom + [names[k] for k in kept], how + g, f + list(kept), f + [counts[k] for k in kept], f + [centres[k] for k in kept]]
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, kinds)], schema=kinds)

    def start(b: pa.Table) -> pa.Table:
        return fold(b)

    def go_on(b: pa.Table, before: pa.Table) -> pa.Table:
        return fold(b, before)

    # later stretches lie together in files, so that a round reads its own only
    late = materialize(r.filter("part > 0").repartitionByRange("part").sortWithinPartitions("part"), "stretches") if last else None
    state = done = None
    for part in range(last + 1):
        now = (late if part else r).filter(F.col("part") == part).groupBy("key")
        step = now.applyInArrow(start, schema) if state is None else now.cogroup(state.groupBy("key")).applyInArrow(go_on, schema)
        step = materialize(step, "leaders") if last else step
        state, found = step.filter("id IS NULL"), step.filter("id IS NOT NULL").select("id", "key", "leader", "similarity")
        done = found if done is None else done.unionByName(found)
    return done.withColumnRenamed("key", key)


def merged_centroid(a: Column, n: Column, b: Column, m: Column) -> Column:
    """The count-weighted mean of two centroids, of length one."""
    s = F.zip_with(a, b, lambda x, y: x.cast("double") * n + y.cast("double") * m)
    size = F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
    return F.when(size > 0, F.transform(s, lambda x: (x / size).cast("float"))).otherwise(s.cast("array<float>"))
