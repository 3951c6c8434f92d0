"""Tables that operators keep on their way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Parts of a table that is dealt out, at most, unless the session asks for more.
MOST_PARTS = 2000


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where a local session names none, below a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="plumbline-work-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        named = "file://" + _LOCAL[0]
    return f"{named.rstrip('/')}/work/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage is cut, and it is computed once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_read(df: DataFrame) -> int:
    """Bytes of the files that df reads; tables of the session count as Spark estimates them, if they are no larger than a file may be."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 50)


def dealt(df: DataFrame, *by: str, each: int = 8 << 20) -> DataFrame:
    """df over all cores, by the columns named or evenly: a small table is read in few tasks, however much work its rows are.

    One part for each so many bytes read, so that a task's memory doesn't grow with the input.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(min(max(least, -(-_bytes_read(df) // each)), max(least, MOST_PARTS)), *by)


def spread_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Pairs of rows equal in `on`, made where both are dealt out by it: were the smaller side broadcast, the pairs
    would be made in the few tasks that read the other."""
    return dealt(a, *on).join(dealt(b, *on).hint("merge"), on, how)
