"""Ranks over whole tables without gathering a group in one task, and scores made of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicry.scratch import materialize

# Lower bounds of the bands of each model's scores, best first.
BANDS = {
    "nima_mobilenet": (("excellent", 0.75), ("good", 0.55), ("average", 0.30)),
    "clip_vit_b32": (("excellent", 0.80), ("good", 0.62), ("average", 0.30)),
    "combined_rank": (("excellent", 0.75), ("good", 0.50), ("average", 0.25)),
}


def distributed_rank(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``) and ``n`` (rows) of each group.

    The order should be total, or ties fall anyhow.
    """
    return running_total(df, group, order, F.lit(1)).withColumnsRenamed({"before": "rank", "total": "n"})


def running_total(df: DataFrame, group: list[str], order: list[Column], amount: Column) -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` over the rows of its group that come earlier by ``order``, and ``total``, that of the group.

    Rows are sorted by range over all tasks and summed inside each range; what
    comes before a range is a sum over range sums, of which there are few.
    """
    plain = [F.asc(c) if isinstance(c, str) else c for c in order]
    t = df.repartitionByRange(*[F.col(g) for g in group], *plain).withColumns({"_p": F.spark_partition_id(), "_a": amount.cast("long")})
    t = materialize(t, "ranges")
    inside = Window.partitionBy("_p", *group).orderBy(*plain)
    sizes = t.groupBy("_p", *group).agg(F.sum("_a").alias("_c"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_c").over(over)).drop("_c")
    # a null is a group like any other
    sizes = sizes.select("_before", "total", F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = t.withColumn("_r", F.sum("_a").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(sizes, same)
    out = out.drop("_q", *[f"_g{i}" for i in range(len(group))])
    return out.withColumn("before", F.col("_before") + F.col("_r") - F.col("_a")).drop("_p", "_r", "_a", "_before")


def band(score: Column, model: Column) -> Column:
    """poor, average, good or excellent by the model's bounds; unknown models use those of combined ranks."""
    by = {m: F.coalesce(*[F.when(score >= lo, name) for name, lo in b], F.when(score.isNotNull(), "poor")) for m, b in BANDS.items()}
    out = by["combined_rank"]
    for m in ("nima_mobilenet", "clip_vit_b32"):
        out = F.when(model == m, by[m]).otherwise(out)
    return out


def rank_share(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """``df`` with ``share``: rank / (n - 1) of ``value`` in its group, 0.5 where it is alone."""
    r = distributed_rank(df, group, [F.asc(value), F.asc(tie)])
    return r.withColumn("share", F.when(F.col("n") > 1, F.col("rank") / (F.col("n") - 1)).otherwise(0.5)).drop("rank", "n")


def combined_rank(scores: DataFrame, file: str = "file_id", model: str = "model_name", score: str = "score") -> DataFrame:
    """(file_id, score, band) of files that all models scored: the mean of the shares they have among each model's scores.

    Nothing with fewer than two models. Each (file, model) must occur once; null
    scores count as missing.
    """
    s = scores.filter(F.col(score).isNotNull() & F.col(file).isNotNull() & F.col(model).isNotNull()).select(F.col(file).alias("file_id"), F.col(model).alias("model"), F.col(score).alias("v"))
    s = rank_share(s, ["model"], "v", "file_id")
    models = s.select("model").distinct().count()
    if models < 2:
        return s.select("file_id", F.col("v").alias("score"), F.lit("").alias("band")).limit(0)
    f = s.groupBy("file_id").agg(F.avg("share").alias("score"), F.count("*").alias("k")).filter(F.col("k") == models)
    return f.select("file_id", "score", band(F.col("score"), F.lit("combined_rank")).alias("band"))


def quality_rank(rows: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(id, quality_rank): mean of the share of sharpness, closeness of exposure to a half, and the lack of highlights and shadows."""
    r = rank_share(rows.select(F.col(id_col).alias("id"), "sharpness", "exposure", "highlights", "shadows"), [], "sharpness", "id")
    share = F.col("share")
    return r.select("id", ((share + (1 - 2 * F.abs(F.col("exposure") - 0.5)) + (1 - F.col("highlights")) + (1 - F.col("shadows"))) / 4).alias("quality_rank"))


def word_blocks(pieces: DataFrame, group: str, order: list[str], words: str, size: int, shared: int) -> DataFrame:
    """(group, no, window): windows of ``size`` words of each group's pieces in order, each sharing ``shared`` with the one before.

    ``words`` is an array. A running total says where each piece begins, so every window is put together from
    its own pieces only and no group is gathered. A window begins
    only where more than ``shared`` words are left, the first one always.
    """
    t = running_total(pieces, [group], [F.asc(c) for c in order], F.size(words))
    step, n = size - shared, F.size(words)
    first = F.greatest(F.floor((F.col("before") - size) / step) + 1, F.lit(0))
    t = t.withColumn("no", F.explode(F.sequence(first, F.floor((F.col("before") + n - 1) / step))))
    t = t.filter((F.col("no") == 0) | (F.col("no") * step < F.col("total") - shared))
    lo = F.greatest(F.col("no") * step - F.col("before"), F.lit(0))
    hi = F.least(F.col("no") * step + size - F.col("before"), n.cast("long"))
    part = F.array_join(F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int")), " ")
    g = t.filter(hi > lo).groupBy(group, "no").agg(F.sort_array(F.collect_list(F.struct("before", part.alias("p")))).alias("s"))
    return g.select(group, "no", F.array_join(F.transform("s", lambda x: x["p"]), " ").alias("window"))
