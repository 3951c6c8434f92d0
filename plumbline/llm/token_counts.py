"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.pretokens import encoder, proved_vocabulary
from plumbline.llm.scratch import map_arrow


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens of every whole text as the tokenizers library gives them.

    Returns doc_id, n_bytes, n_tokens, n_whole (pre-tokens that are one token by
    the offline proof) and over_limit, a row for each row of docs. Null and
    empty texts have 0 tokens; repeated rows are counted alike; an empty table
    gives an empty one; other columns, whatever their names, are not read. A
    long text is counted whole, in a slice of its own. No ties arise. No
    shuffle: each task counts its own rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(proved_vocabulary(spark, vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(*shared.value)
        for batch in batches:
            parts = [(np.diff(at), whole) for _, _, _, at, whole in counter.texts(batch.column(1))]
            n = pa.array(np.concatenate([p[0] for p in parts]) if parts else [], pa.int64())
            whole = pa.array(np.concatenate([p[1] for p in parts]) if parts else [], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, whole, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "n_whole", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text), count, f"doc_id {kind}, n_bytes long, n_tokens long, n_whole long, over_limit boolean")
