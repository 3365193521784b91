"""What is left to look at and what was decided: pages, conditional counts, checks of files against a folder, plans of stages, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicry.operators.ranking import distributed_rank


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset`` in ``order``, with their ``place`` from 0.

    Sorted over all tasks and cut by rank, so deep pages cost no more than the first. The
    order should be total.
    """
    r = distributed_rank(rows, [], order).drop("n").withColumnRenamed("rank", "place")
    return r.filter((F.col("place") >= offset) & (F.col("place") < offset + limit))


def counted_terms(rows: DataFrame, term: str, file: str, first: list[str] = ()) -> DataFrame:
    """(term, file_count, and the smallest of each column in ``first``) of every non-null term."""
    g = rows.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term"))
    return g.agg(F.countDistinct(file).alias("file_count"), *[F.min(c).alias(c) for c in first])


def status_counts(rows: DataFrame, term: str, status: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row: the number of distinct terms in all, and of those with a status in each of ``groups``."""
    some = [F.countDistinct(F.when(F.col(status).isin(*v), F.col(term))).alias(k) for k, v in groups.items()]
    return rows.agg(F.countDistinct(term).alias("total"), *some)


def done_counts(files: DataFrame, done: DataFrame, key: str = "file_id") -> DataFrame:
    """One row: files in all, those with a row in ``done`` and those without."""
    d = done.select(F.col(key).alias("id"), F.lit(1).alias("_d")).distinct()
    return files.join(d, "id", "left").agg(F.count("*").alias("total"), F.count("_d").alias("done"), (F.count("*") - F.count("_d")).alias("pending"))


def validated(files: DataFrame, present: DataFrame) -> DataFrame:
    """(id, status, detail) of files compared with what a folder holds now.

    files: id, path, sha256; present: path, sha256. A path that is there is ok if its
    content is the recorded one, unreadable or not recorded, and else changed (detail: the
    new content). A path that is gone has moved if another file of the same content is
    there (detail: the first of their paths), else it is missing. Repeated ids and paths count once.
    """
    f = files.select("id", "path", "sha256").filter("id IS NOT NULL").dropDuplicates(["id"])
    p = present.filter("path IS NOT NULL").groupBy("path").agg(F.max("sha256").alias("now"), F.lit(True).alias("there"))
    f = f.join(p, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    other = f.filter("there AND sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("elsewhere"))
    # files without a recorded content are told apart, lest they all go to one task
    known = f.filter("sha256 IS NOT NULL").join(other, "sha256", "left").select("id", "sha256", "now", "there", "elsewhere")
    blank = f.filter("sha256 IS NULL").select("id", "sha256", "now", "there", F.lit(None).cast("string").alias("elsewhere"))
    same = F.col("sha256").isNull() | F.col("now").isNull() | (F.col("now") == F.col("sha256"))
    status = F.when(F.col("there") & same, "ok").when(F.col("there"), "changed").when(F.col("elsewhere").isNotNull(), "moved").otherwise("missing")
    detail = F.when(F.col("there") & ~same, F.col("now")).when(~F.col("there"), F.col("elsewhere"))
    return known.unionByName(blank).select("id", status.alias("status"), detail.alias("detail"))


def decisions(*parts: tuple[str, DataFrame, Column, Column, Column]) -> DataFrame:
    """(id, token, action, detail) of several tables of decisions; an id is the table's name and the row's id."""
    out = None
    for name, df, token, action, detail in parts:
        d = df.select(F.concat(F.lit(name + ":"), F.col("id").cast("string")).alias("id"), token.alias("token"), action.alias("action"), F.coalesce(detail, F.lit("")).alias("detail"))
        out = d if out is None else out.unionByName(d)
    return out


def taxonomy(*sections: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """(section, branch, leaf), each once: the leaves of several tables under their section and branch; blank ones are left out."""
    out = None
    for name, df, branch, leaf in sections:
        t = df.select(F.lit(name).alias("section"), F.trim(branch).alias("branch"), F.trim(leaf).alias("leaf")).filter("leaf <> ''")
        out = t if out is None else out.unionByName(t)
    return out.distinct()


def merged_taxonomy(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """``existing`` (section, branch, leaf, place) with the generated leaves it lacks behind it in each branch, in alphabetic order."""
    keys = ["section", "branch"]
    new = generated.join(existing.select(*[F.col(c).alias("_" + c) for c in (*keys, "leaf")]), (F.col("section") == F.col("_section")) & F.col("branch").eqNullSafe(F.col("_branch")) & (F.col("leaf") == F.col("_leaf")), "left_anti")
    last = existing.groupBy(*keys).agg((F.max("place") + 1).alias("_next"))
    new = distributed_rank(new, keys, [F.asc("leaf")]).join(last.select(F.col("section").alias("_s"), F.col("branch").alias("_b"), "_next"), (F.col("section") == F.col("_s")) & F.col("branch").eqNullSafe(F.col("_b")), "left")
    return existing.unionByName(new.select(*keys, "leaf", (F.coalesce("_next", F.lit(0)) + F.col("rank")).alias("place")))


def path_tree(paths: DataFrame, path: str, separator: str = "::") -> DataFrame:
    """(top, middle, leaf) of paths with two or three parts, each once; middle is null for two. Other paths are left out."""
    p = paths.select(F.split(F.col(path), separator).alias("p")).filter(F.size("p").isin(2, 3))
    return p.select(F.col("p")[0].alias("top"), F.when(F.size("p") == 3, F.col("p")[1]).alias("middle"), F.element_at("p", -1).alias("leaf")).distinct()


def stage_plan(needs: dict[str, list[str]], target: str, completed: set[str] = frozenset(), gates: dict[str, str] | None = None) -> list[str]:
    """The stages to run for ``target``, needed ones first; a gate not passed yet stands before its stage as ``gate:name``.

    Completed stages are left out but what they need is still looked at; each stage is visited once, so cycles end.
    """
    if target not in needs:
        raise ValueError(f"unknown stage {target!r}")
    out, seen, todo = [], set(), [(target, False)]
    while todo:
        stage, ready = todo.pop()
        if not ready:
            if stage in seen:
                continue
            seen.add(stage)
            todo.append((stage, True))
            todo += [(s, False) for s in reversed(needs.get(stage, []))]
            continue
        gate = (gates or {}).get(stage)
        if gate and gate not in completed and f"gate:{gate}" not in out:
            out.append(f"gate:{gate}")
        if stage not in completed:
            out.append(stage)
    return out
