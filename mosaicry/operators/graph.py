"""Term graphs and clusters of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicry.functions.geo import usable_point
from mosaicry.operators.components import connected_components
from mosaicry.operators.skew import salted_join
from mosaicry.operators.spatial import near_pairs
from mosaicry.scratch import materialize, release


def npmi_edges(facts: DataFrame, doc: str, term: str, min_score: float = 0.1, min_docs: int = 1) -> DataFrame:
    """(term_a, term_b, n_ab, score): normalised pointwise mutual information of terms in one document.

    ``facts`` has one row per document and term, repeats count once. The score is
    ln(p_ab / (p_a p_b)) / -ln(p_ab), and 1 where the pair is in every document.
    Only terms in at least ``min_docs`` documents take part.
    """
    f = facts.filter(F.col(doc).isNotNull() & F.col(term).isNotNull()).select(F.col(doc).alias("d"), F.col(term).alias("t")).distinct()
    f = materialize(f, "facts")
    n = f.select("d").distinct().count()
    count = f.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    kept = materialize(f.join(count, "t"), "facts")
    a = kept.select("d", F.col("t").alias("term_a"), F.col("n").alias("n_a"))
    b = kept.select("d", F.col("t").alias("term_b"), F.col("n").alias("n_b"))
    pairs = salted_join(a, b, "d", "term_a").filter("term_a < term_b").groupBy("term_a", "term_b").agg(F.count("*").alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    p = F.col("n_ab") / F.lit(float(max(n, 1)))
    score = F.when(F.col("n_ab") == n, 1.0).otherwise(F.log(p * F.lit(float(n)) * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))) / -F.log(p))
    return pairs.withColumn("score", score).filter(F.col("score") >= min_score).select("term_a", "term_b", "n_ab", "score")


def communities(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(node, community) by weighted label propagation; a community is named by its smallest node.

    A node wants the label with the greatest weight among its neighbours (ties: the
    smaller label) if that is more than its own label has there. Of neighbours that
    want to move only the one with the most to gain does (ties: by hash), so every
    move adds to the weight inside communities and the rounds end by themselves when
    nobody gains. The outcome depends on the edges only.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.round(F.col(weight).cast("double"), 9).alias("w")).filter("u <> v")
    e = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "edges")
    label = materialize(e.select("u").distinct().withColumn("label", F.col("u")), "labels")
    while True:
        votes = e.join(label.withColumnRenamed("u", "v"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("u").agg(F.min(F.struct((-F.round("w", 6)).alias("w"), "label")).alias("m"))
        own = label.join(votes, ["u", "label"], "left").select("u", F.coalesce(F.round("w", 6), F.lit(0.0)).alias("own"))
        want = best.join(own, "u").select("u", F.col("m.label").alias("new"), F.struct((-F.col("m.w") - F.col("own")).alias("gain"), F.xxhash64("u").alias("h"), "u").alias("r"))
        want = materialize(want.filter(F.col("r.gain") > 1e-6), "wants")
        if want.isEmpty():
            break
        ahead = e.select("u", "v").join(want.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v").groupBy("u").agg(F.max("rv").alias("rv"))
        move = want.join(ahead, "u", "left").filter("rv IS NULL OR r > rv").select("u", "new")
        last, label = label, materialize(label.join(move, "u", "left").select("u", F.coalesce("new", "label").alias("label")), "labels")
        release(last)
        release(want)
    name = label.groupBy("label").agg(F.min("u").alias("community"))
    return label.join(name, "label").select(F.col("u").alias("node"), "community")


def dbscan(points: DataFrame, id_col: str, lat: str, lon: str, eps_m: float, min_points: int) -> DataFrame:
    """(id, cluster_id): density clusters; the cluster is its smallest core point, null is noise.

    A point is core if at least ``min_points`` points, itself included, lie within
    ``eps_m``. Core points within reach share a cluster; another point in reach of a
    core joins the smallest cluster among them. Unusable points are left out.
    """
    p = points.filter(F.col(id_col).isNotNull() & usable_point(F.col(lat), F.col(lon))).select(F.col(id_col).alias("id")).distinct()
    pairs = materialize(near_pairs(points, id_col, lat, lon, eps_m).select("id_a", "id_b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    degree = both.groupBy("id_a").agg((F.count("*") + 1).alias("n")).filter(F.col("n") >= min_points).select(F.col("id_a").alias("id"))
    core = materialize(degree if min_points > 1 else p, "core")
    inner = pairs.join(core.select(F.col("id").alias("id_a")), "id_a", "left_semi").join(core.select(F.col("id").alias("id_b")), "id_b", "left_semi")
    comp = connected_components(inner, "id_a", "id_b").withColumnsRenamed({"node": "id", "component": "c"})
    cluster = materialize(core.join(comp, "id", "left").select("id", F.coalesce("c", "id").alias("cluster_id")), "clusters")
    border = both.join(cluster.select(F.col("id").alias("id_b"), "cluster_id"), "id_b").join(core.select(F.col("id").alias("id_a")), "id_a", "left_anti").groupBy("id_a").agg(F.min("cluster_id").alias("cluster_id"))
    return p.join(cluster.unionByName(border.select(F.col("id_a").alias("id"), "cluster_id")), "id", "left").select("id", "cluster_id")
