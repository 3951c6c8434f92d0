"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost
executor costs only the tasks it was running. Where the session names no such
folder (tests), a temporary one of this process is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []
_MADE: list[tuple[SparkSession, str]] = []


#: Bytes of rows that a Python worker gets at once; a longer row comes alone.
BATCH_BYTES = "8m"


def map_arrow(rows: DataFrame, f, schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes, not by rows alone, unless the session sets its own bound."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return rows.mapInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else one for this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="plumbline-"))
    return "file://" + _LOCAL[0].name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}/{name}"
    _MADE.append((spark, path))
    return path


def store(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; then the stored table `instead_of` is deleted."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if instead_of is not None:
        forget(df.sparkSession, {instead_of.stored_at})
    return out


def made() -> set[str]:
    """The paths handed out and not yet deleted."""
    return {path for _, path in _MADE}


def forget(spark: SparkSession, paths: set[str]) -> None:
    """Delete tables that are no longer read."""
    for path in paths:
        drop(spark, path)
    _MADE[:] = [m for m in _MADE if m[1] not in paths]


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # the session may be gone; the folder's owner cleans it then
            return
