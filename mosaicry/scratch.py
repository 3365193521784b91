"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Iterative operators cut their lineage by writing a table and reading it back.
A written table survives the loss of an executor, unlike a block kept on one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: set[tuple[int, str]] = set()
#: How much larger than its files a table may be in memory; Spark's own factor of 1 broadcasts tables that do not fit.
EXPANSION = "8.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def honest_sizes(spark: SparkSession) -> None:
    """Let Spark estimate tables by what their compressed files may grow to, unless the session has its own factor.

    Joins whose sides it cannot prove small are then shuffled; adaptive execution turns to
    a broadcast when it has measured a side.
    """
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, EXPANSION)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mosaicry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; ``by`` names a column whose values get folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosaicry/{name}-{uuid.uuid4().hex}"
    honest_sizes(spark)
    df.write.parquet(path, partitionBy=by)
    _open.add((id(spark), path))
    out = spark.read.schema(df.schema).parquet(path)
    out._mosaicry_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_mosaicry_path", None)
    if path:
        _delete(df.sparkSession, path)
        _open.discard((id(df.sparkSession), path))


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for _, path in list(_open):
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
