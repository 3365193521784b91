"""One surviving record for each group of duplicates.

Groups come from equal contents, declared copies and fingerprints that differ in a
few bits. What is known about an entity is settled by currency reasoning: dated rows
teach which value of a field tends to replace which, this precedence is closed
transitively, every entity's values form a partial order, and the topologically
latest one is current. A file's score is settled this way before the survivor is
ranked, and so are the fields of a group's record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicry.operators.components import connected_components
from mosaicry.operators.hashes import hamming_pairs, hash_halves, star_links
from mosaicry.scratch import materialize
from mosaicry.tables import small


def duplicate_groups(files: DataFrame, hashes: DataFrame, max_bits: int = 5) -> DataFrame:
    """(file_id, group_id) of files in a group of two or more; group_id is the smallest file id.

    files: id, file_size, sha256, canonical_id; hashes: file_id, phash. Only files
    with file_size > 0 take part. Two are joined, also through others, by one
    non-null sha256, by one being the other's canonical_id, or by phashes at most
    ``max_bits`` apart; a phash that is null, all zero or no 16 hex digits joins
    nothing. Repeated rows count once; equal values are joined as stars, so a value
    that a third of all files share costs one link per file.
    """
    f = materialize(files.filter("file_size > 0 AND id IS NOT NULL").select("id", "sha256", "canonical_id").dropDuplicates(["id"]), "files")
    hi, lo = hash_halves(F.col("phash"))
    h = hashes.select(F.col("file_id").alias("id"), hi.alias("hi"), lo.alias("lo")).filter("hi IS NOT NULL AND (hi <> 0 OR lo <> 0)")
    h = h.join(f.select("id"), "id", "left_semi").withColumn("_h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))).dropDuplicates(["id", "_h"])
    h = materialize(h, "phashes")
    one = materialize(h.groupBy("_h").agg(F.min("id").alias("id"), F.first("hi").alias("hi"), F.first("lo").alias("lo")), "distinct")
    # a file with several hashes stands for each: pairs are found between hashes, named by their number
    near = hamming_pairs(one, "_h", "hi", "lo", max_bits)
    rep = one.select("_h", "id")
    near = near.join(rep.select(F.col("_h").alias("a"), F.col("id").alias("ia")), "a").join(rep.select(F.col("_h").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    told = f.filter("canonical_id IS NOT NULL AND canonical_id <> id").select(F.col("id").alias("a"), F.col("canonical_id").alias("b"))
    told = told.join(f.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    links = star_links(f, "id", "sha256").unionByName(told).unionByName(star_links(h, "id", "_h")).unionByName(near)
    return connected_components(links).select(F.col("node").alias("file_id"), F.col("component").alias("group_id"))


def field_values(rows: DataFrame, entity: str, fields: dict[str, Column], at: Column) -> DataFrame:
    """(g, field, v, at): one row per entity and field with a value, as text, and the time it was seen.

    ``at`` must be a number; NaN and null mean undated. All fields travel in one table, so
    whatever their number they share each later pass.
    """
    each = F.array(*[F.struct(F.lit(k).alias("field"), c.cast("string").alias("v")) for k, c in fields.items()])
    t = rows.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("g"), F.explode(each).alias("f"), F.nanvl(at.cast("double"), F.lit(None)).alias("at"))
    return t.select("g", "f.field", "f.v", "at").filter("v IS NOT NULL")


def value_precedence(seen: DataFrame, min_support: int = 2) -> DataFrame:
    """(field, older, newer): values that come before others, directly or through values in between.

    ``seen`` has (g, field, v, last), one row per distinct value of an entity. Only values
    that at least ``min_support`` entities have can teach anything; an entity's values of that kind in the
    order of their dates give a transition between each two neighbours of different
    dates. A transition counts if it is seen at least ``min_support`` times more
    often than its reverse. The closure follows chains to any length, so an older value
    precedes a newer one even where the entity lacks the one in between. Values on a
    cycle do not precede each other.
    """
    shared = seen.groupBy("field", "v").agg(F.count("*").alias("k")).filter(F.col("k") >= min_support).select("field", "v")
    dated = seen.filter("last IS NOT NULL").join(small(materialize(shared, "vocabulary"), 96), ["field", "v"])
    w = Window.partitionBy("g", "field").orderBy("last", "v")
    step = dated.select("field", F.lag("v").over(w).alias("older"), F.col("v").alias("newer"), F.lag("last").over(w).alias("b"), "last").filter("older IS NOT NULL AND b < last")
    n = materialize(step.groupBy("field", "older", "newer").agg(F.count("*").alias("n")), "transitions")
    back = n.select("field", F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("n").alias("m"))
    n = n.join(back, ["field", "older", "newer"], "left").filter(F.col("n") - F.coalesce("m", F.lit(0)) >= min_support)
    reach, size = materialize(n.select("field", "older", "newer"), "precedence"), -1
    while (now := reach.count()) != size:
        on = reach.select("field", F.col("older").alias("newer"), F.col("newer").alias("later"))
        further = reach.join(on, ["field", "newer"]).select("field", "older", F.col("later").alias("newer"))
        reach, size = materialize(reach.unionByName(further).distinct(), "precedence"), now
    return reach.join(reach.select("field", F.col("older").alias("newer"), F.col("newer").alias("older")), ["field", "older", "newer"], "left_anti")


def current_values(values: DataFrame, learned: tuple[str, ...] = (), min_support: int = 2) -> DataFrame:
    """(g, field, v): each entity's current value of each field.

    ``values`` has (g, field, v, at) as field_values gives it. An entity's distinct values of a field
    form a partial order: of two dated values the later one is newer; if one is
    undated the precedence learned from all dated rows decides, for the fields in
    ``learned``. These should be fields whose values recur over entities; of
    identifiers nothing can be learned. A value is beaten if a newer one is present. Of
    the values that nothing beats come dated ones first, then the latest, the most
    frequent, the smallest; where a cycle beats all, all stay. Entities without a value
    give no row. Everything is aggregated map-side; values are compared along
    the learned precedence only, never all with all.
    """
    v = values.groupBy("g", "field", "v").agg(F.max("at").alias("last"), F.count("*").alias("n"))
    best = lambda t, beaten: t.groupBy("g", "field").agg(F.min(F.struct(beaten.alias("beaten"), F.col("last").isNull().alias("undated"), (-F.col("last")).alias("l"), (-F.col("n")).alias("n"), "v")).alias("b")).select("g", "field", "b.v")
    if not learned:
        return best(v, F.lit(False))
    v = materialize(v, "values")
    known = v.filter(F.col("field").isin(*learned))
    # precedence matters only where an undated value has company; without such values none is learned
    open_ = known.groupBy("g", "field").agg(F.max("last").alias("top"), F.count("*").alias("k"), F.count("last").alias("dated")).filter("k > 1 AND dated < k").select("g", "field", "top")
    open_ = materialize(open_, "open")
    if open_.isEmpty():
        return best(v, F.lit(False))
    order = small(materialize(value_precedence(known, min_support), "precedence"), 128)
    part = materialize(known.join(open_, ["g", "field"]), "undated")
    older = part.filter("last IS NULL OR last = top").select("g", "field", F.col("v").alias("older"), F.col("last").alias("l1")).join(order, ["field", "older"])
    newer = part.select("g", "field", F.col("v").alias("newer"), F.col("last").alias("l2"))
    beaten = older.join(newer, ["g", "field", "newer"]).filter("l1 IS NULL OR l2 IS NULL").select("g", "field", F.col("older").alias("v"))
    beaten = beaten.unionByName(part.filter("last < top").select("g", "field", "v")).distinct().withColumn("beaten", F.lit(True))
    return best(v.join(beaten, ["g", "field", "v"], "left"), F.coalesce("beaten", F.lit(False)))


def current_scores(scores: DataFrame, model: str = "nima_mobilenet") -> DataFrame:
    """(file_id, score): the current score of each file by that model, if it lies in 0 to 1.

    The score is the file's current value in the sense of current_values: dated rows by their dates, an undated
    one by the precedence that the dated rows of all files teach. A row without
    a score is a value too, and so is one out of range: if such a row is the latest, the
    file has no score. Rows of one time: the one seen more often, then the smaller text.
    """
    s = scores.filter((F.col("model_name") == model) & F.col("file_id").isNotNull())
    now = current_values(field_values(s, "file_id", {"score": F.coalesce(F.col("score").cast("string"), F.lit("none"))}, F.unix_micros("scored_at")), ("score",))
    return now.select(F.col("g").alias("file_id"), F.col("v").try_cast("double").alias("score")).filter("score >= 0 AND score <= 1")


def survivors(groups: DataFrame, files: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_id, group_id, survivor_id): the highest score, then the larger file, then the smaller id survives.

    A group's best is a map-side aggregate, so no group is gathered.
    """
    f = groups.join(files.select(F.col("id").alias("file_id"), "file_size").dropDuplicates(["file_id"]), "file_id").join(scores, "file_id", "left")
    rank = F.struct(F.coalesce("score", F.lit(-1.0)), "file_size", -F.col("file_id"))
    best = f.groupBy("group_id").agg(F.max_by("file_id", rank).alias("survivor_id"))
    return groups.join(best, "group_id").select("file_id", "group_id", "survivor_id")
