"""Mixing sources to target shares of a size in tokens.

A source whose target exceeds its size is taken whole as often as its cap allows;
the rest is a Pareto order sample: documents are ranked by the odds of a random
number over their inclusion odds, and the first ones that make up the size are
taken. Cutting the ranking needs no sort of a whole source: a histogram of the
ranks finds the bucket where the size is reached, and only that bucket is ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaicry.scratch import materialize
from mosaicry.tables import small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BUCKETS = 4096


def with_tokens(docs: DataFrame, text: str, tokenizer: str = TOKENIZER, to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; null texts have none.

    The tokenizer file is read by the driver and travels with the task.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec)
        t.encode_special_tokens = True
        t.no_truncation()
        for b in batches:
            texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
            n = [len(e.ids) for i in range(0, len(texts), 256) for e in t.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], to])

    rest = docs.drop(text)
    return docs.select(*rest.columns, text).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{to}` bigint")


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", total: int | None = None, weight: str | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, size, copies), report): documents to take, and what share each source reached.

    ``targets`` has (source, target_share, max_repeats), one row per source. ``total``
    is the size to reach, by default what all sources with a target hold once. No
    document is taken more than max_repeats times. Inclusion odds follow ``weight``
    (default: all alike); a document whose inclusion probability reaches one is
    certain. The draw depends on ``seed`` and the id only. Documents without id,
    source, size or a positive size are not drawn, nor are sources without a target;
    a target without documents draws nothing. The report has one row per target:
    target_share, max_repeats, available, wanted, drawn, actual_share and
    at_cap (the cap keeps the source below its target). Ids must be unique.
    """
    t = materialize(targets.filter(F.col(source).isNotNull()).dropDuplicates([source]).select(F.col(source).alias("source"), "target_share", "max_repeats"), "targets")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), w.alias("w"))
    d = materialize(d.filter("doc_id IS NOT NULL AND source IS NOT NULL AND size > 0").join(small(t.select("source"), 64), "source"), "sizes")
    have = d.groupBy("source").agg(F.sum("size").alias("available"), F.sum(F.col("size") * F.greatest("w", F.lit(0.0))).alias("weighted"))
    plan = t.join(have, "source", "left").na.fill(0, ["available"]).na.fill(0.0, ["weighted"])
    if total is None:
        total = plan.agg(F.sum("available")).first()[0] or 0
    plan = plan.withColumn("wanted", F.round(F.col("target_share") * F.lit(float(total))).cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("available") > 0, F.least(F.floor(F.col("wanted") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.least("available", F.col("wanted") - F.col("whole") * F.col("available"))).otherwise(0))
    plan = materialize(plan, "plan")  # one row per target

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    j = d.join(small(plan.select("source", "whole", "rest", "weighted"), 96), "source")
    p = F.when(F.col("weighted") > 0, F.greatest("w", F.lit(0.0)) * F.col("rest") / F.col("weighted")).otherwise(0.0)
    q = F.when(p >= 1, 0.0).when(p <= 0, F.lit(float("inf"))).otherwise(u / (1 - u) / (p / (1 - p)))
    j = j.withColumn("rank", q).withColumn("bucket", F.when(F.col("rank") == float("inf"), BUCKETS).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS)).cast("int"))
    j = materialize(j.select("doc_id", "source", "size", "whole", "rest", "rank", "bucket"), "ranks")
    hist = j.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("below"), "s")
    j = j.join(small(materialize(hist, "histogram"), 96), ["source", "bucket"])
    edge = (F.col("below") <= F.col("rest")) & (F.col("below") + F.col("s") > F.col("rest"))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = j.filter(edge).withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    drawn = cut.select("doc_id", "source", "size", "whole", ((F.col("at") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)).cast("int").alias("extra"))
    drawn = drawn.unionByName(j.filter(~edge).select("doc_id", "source", "size", "whole", (F.col("below") + F.col("s") <= F.col("rest")).cast("int").alias("extra")))
    out = materialize(drawn.select("doc_id", "source", "size", (F.col("whole") + F.col("extra")).alias("copies")).filter("copies > 0"), "drawn")
    got = out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn"))
    everything = out.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    report = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        (F.coalesce("drawn", F.lit(0)) / F.lit(float(max(everything, 1)))).alias("actual_share"),
        (F.col("wanted") > F.col("available") * F.col("max_repeats")).alias("at_cap"),
    )
    return out, report
