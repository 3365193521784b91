"""Files of a folder as a table, and the filters of a source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicry.operators.scope import glob_like

# Extensions by file type.
TYPES = {
    "images": "jpg jpeg png gif bmp tif tiff webp heic heif raw cr2 cr3 nef arw orf rw2 dng".split(),
    "video": "mp4 mov avi mkv m4v mts m2ts wmv flv webm 3gp".split(),
    "audio": "mp3 wav flac m4a aac ogg wma opus".split(),
}


def file_type(ext: Column) -> Column:
    """images, video, audio or null for an extension with or without its dot, in any case."""
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.coalesce(*[F.when(e.isin(*v), k) for k, v in TYPES.items()])


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, filename, ext, file_type, file_size, mtime) of the files under ``root``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return f.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), name.alias("filename"), F.when(ext != "", ext).alias("ext"), file_type(ext).alias("file_type"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").alias("us")).withColumn("mtime", F.col("us") / 1_000_000).drop("us")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) over whole file contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


@dataclass(frozen=True)
class SourceFilter:
    """What a source takes in: files changed after a day, of a name pattern, not under some path parts, and so many at most."""

    modified_after: str | None = None
    exclude: tuple[str, ...] = field(default_factory=tuple)
    glob: str | None = None
    count_limit: int | None = None

    def apply(self, files: DataFrame) -> DataFrame:
        """In this order: day, excluded parts (wildcards match one whole part), name, and the first paths if limited."""
        if self.modified_after:
            files = files.filter(F.timestamp_seconds("mtime") > F.lit(self.modified_after).cast("timestamp"))
        for p in self.exclude:
            like = glob_like(p).replace("'", "''")
            files = files.filter(f"NOT exists(split(path, '[/\\\\\\\\]'), x -> x LIKE '{like}' ESCAPE '!')")
        if self.glob:
            files = files.filter("filename LIKE '{}' ESCAPE '!'".format(glob_like(self.glob).replace("'", "''")))
        return files if self.count_limit is None else files.orderBy("path").limit(self.count_limit)


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found files that are new or differ from the known row of their path in size or modification time."""
    k = known.select("path", F.col("file_size").alias("_s"), F.col("mtime").alias("_m")).dropDuplicates(["path"])
    j = found.join(k, "path", "left")
    same = F.col("_s").eqNullSafe(F.col("file_size")) & F.col("_m").eqNullSafe(F.col("mtime"))
    return j.filter(F.col("_s").isNull() & F.col("_m").isNull() | ~same).drop("_s", "_m")
