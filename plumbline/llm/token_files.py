"""Token ids in files of Simple-8b blocks, in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import simple8b
from plumbline.llm.pretokens import encoder, proved_vocabulary
from plumbline.llm.scratch import map_arrow

#: Bytes of text in a block; one document is never split, so a long one makes a block of its own.
BLOCK_BYTES = 1 << 17
#: Characters of a text that help to deal out rows of one doc_id; texts are written whole.
HEAD = 32


def _schema(doc_id: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("bucket", T.IntegerType())  # buckets ascend with doc_id
        .add("block", T.IntegerType())
        .add("first", T.LongType())  # ids before this block in its bucket
        .add("total", T.LongType())
        .add("doc_ids", T.ArrayType(doc_id))
        .add("offsets", T.ArrayType(T.LongType()))  # where each document's ids begin in the block, then their number
        .add("words", T.BinaryType())
    )


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text, append end_id, and write blocks of words below path.

    Null texts count as empty and hold end_id alone; rows that repeat a doc_id
    are all written, in the order of their texts; null ids come first. A long
    text makes a block of its own, an empty table writes no block. Only doc_id
    and text are read, so other columns may have any name. The texts are
    shuffled once, by ranges of doc_id and of the first characters, so that a
    doc_id with many texts is spread as well; encoding follows the shuffle, so
    that no id is encoded twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proved_vocabulary(docs.sparkSession, vocabulary_path))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bucket, block, before = encoder(*shared.value), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first, last, ids, at, _ in coder.texts(batch.column(1), BLOCK_BYTES):
                at = at + np.arange(at.size)
                values = np.full(int(at[-1]), end_id, dtype=np.uint32)
                values[np.delete(np.arange(values.size), at[1:] - 1)] = ids
                words = simple8b.encode(values).astype("<u8").tobytes()
                keys = batch.column(0).slice(first, last - first)
                row = [
                    pa.array([bucket], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([values.size], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([at.tolist()], pa.list_(pa.int64())),
                    pa.array([words], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, names=["bucket", "block", "first", "total", "doc_ids", "offsets", "words"])
                block, before = block + 1, before + values.size

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.left("text", F.lit(HEAD))).sortWithinPartitions("doc_id", "text")
    map_arrow(rows, blocks, _schema(docs.schema[doc_id].dataType)).write.option("compression", "zstd").parquet(path)
    shared.destroy()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; rows that repeat a doc_id
    have a row each, in the order of their texts. Files of an empty table give
    no rows; a text of any length is decoded whole. Only the totals of buckets
    meet in one place, and there are as many buckets as tasks wrote files.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, first, keys, at, packed = (batch.column(c)[k] for c in ("bucket", "first", "doc_ids", "offsets", "words"))
                at = np.asarray(at.values)
                ids = simple8b.decode(np.frombuffer(packed.as_buffer(), "<u8"), int(at[-1])).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()] * len(sums), pa.int32()), keys.values, pa.array(first.as_py() + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], names=["bucket", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = map_arrow(files.select("bucket", "first", "doc_ids", "offsets", "words"), decoded, T.StructType().add("bucket", T.IntegerType()).add("doc_id", kind).add("start", T.LongType()).add("n_tokens", T.LongType()).add("ids_crc32", T.LongType()))
    totals = files.groupBy("bucket").agg(F.sum("total").alias("n")).orderBy("bucket").collect()
    before, bases = 0, []
    for bucket, n in totals:
        bases.append((bucket, before))
        before += n
    base = spark.createDataFrame(bases, "bucket int, base long")
    return rows.join(F.broadcast(base), "bucket").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
