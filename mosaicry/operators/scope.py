"""Which files an operation looks at: saved filters, and what is still to be done."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_like(pattern: str) -> str:
    """A LIKE pattern (escape !) for * and ? wildcards."""
    return "".join({"*": "%", "?": "_", "%": "!%", "_": "!_", "!": "!!"}.get(c, c) for c in pattern)


@dataclass(frozen=True)
class FileScope:
    """A conjunction of conditions on files; None means any."""

    source_id: int | None = None
    folder_prefix: str | None = None
    file_type: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    name_pattern: str | None = None

    @classmethod
    def of(cls, d: dict) -> FileScope:
        kept = {k: d.get(k) or None for k in cls.__dataclass_fields__}
        try:
            kept["source_id"] = int(kept["source_id"]) if kept["source_id"] is not None else None
        except (TypeError, ValueError):
            kept["source_id"] = None
        return cls(**kept)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def is_empty(self) -> bool:
        return not self.as_dict()

    def summary(self) -> str:
        return " · ".join(f"{k.replace('_', ' ')}: {v}" for k, v in self.as_dict().items())

    def condition(self) -> Column:
        """True for files in scope. Names and folders ignore case; days are those of mtime in UTC, both ends included."""
        c = F.lit(True)
        if self.source_id is not None:
            c = c & (F.col("source_id") == self.source_id)
        if self.folder_prefix:
            p = self.folder_prefix.rstrip("/\\").lower()
            c = c & (F.lower("path").startswith(p + "/") | F.lower("path").startswith(p + "\\"))
        if self.file_type:
            c = c & (F.col("file_type") == self.file_type)
        day = F.to_date(F.timestamp_seconds("mtime"))
        if self.date_from:
            c = c & (day >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            c = c & (day <= F.lit(self.date_to).cast("date"))
        if self.name_pattern:
            c = c & F.expr("filename ILIKE '{}' ESCAPE '!'".format(glob_like(self.name_pattern).replace("'", "''")))
        return c


def originals(files: DataFrame) -> DataFrame:
    """Files that are no known copy of another one."""
    return files.filter(F.col("canonical_id").isNull())


def pending(files: DataFrame, done: DataFrame, key: str = "file_id", retry: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """Files without a finished row in ``done``: no row at all, or none but with a status in ``retry``."""
    finished = done.filter(~F.coalesce(F.col(status), F.lit("")).isin(*retry)) if retry else done
    return files.join(finished.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def having_any(files: DataFrame, *facts: DataFrame, key: str = "file_id") -> DataFrame:
    """Files with a row in at least one of several tables."""
    ids = facts[0].select(F.col(key).alias("id"))
    for f in facts[1:]:
        ids = ids.unionByName(f.select(F.col(key).alias("id")))
    return files.join(ids, "id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` or missing from ``new`` keep their old value.

    A null in ``new`` leaves the old value. Keys must be unique in both.
    """
    n = new.select(*keys, *[F.col(c).alias("_n_" + c) for c in new.columns if c not in keys])
    j = old.join(n, keys, "full")
    pick = lambda c: F.col(c) if "_n_" + c not in n.columns else F.coalesce(c, "_n_" + c) if c in keep else F.coalesce("_n_" + c, c)
    return j.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def behind(files: DataFrame, version: str, current: int | None) -> DataFrame:
    """Files written under no version or an older one than ``current``; none if there is no current version."""
    return files.filter(F.lit(False)) if current is None else files.filter(F.col(version).isNull() | (F.col(version) < current))


def marked(files: DataFrame, written: DataFrame, version: str, current: int, key: str = "id") -> DataFrame:
    """``files`` with the current version on those whose id is in ``written``."""
    w = written.select(F.col(key).alias("_w")).distinct()
    j = files.join(w, F.col("id") == F.col("_w"), "left")
    return j.withColumn(version, F.when(F.col("_w").isNotNull(), F.lit(current)).otherwise(F.col(version))).drop("_w")
