"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import store
from plumbline.llm.vectors import mix

#: A source's target is at most so many times its size.
MOST = 3
WEIGHTS = (5, 2, 1)
#: Rows that one task rounds in a go, and groups that meet in a round of the tree.
GROUP_ROWS, FAN_IN = 4_000, 64


def text_size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: shares of the whole by weight, at most MOST times each size.

    Resharing what is over a cap until nothing is above ends where every source
    has min(cap, level * weight) for one common level; the level follows from a
    running sum over the sources by cap/weight. One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * MOST).cast("double")).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    # The level if this source and all before it were capped and those from the next on were not.
    per = (
        per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("capped", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("free", F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight"))
    )
    # With the sources before this one at their caps, the level that shares the rest; capped if that is past its own cap.
    level = (F.col("total") - F.col("capped")) / F.col("free")
    settled = F.min(F.when(level <= F.col("at"), F.struct("at", (-level).alias("less")))).over(whole)
    per = per.withColumn("level", -settled["less"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _pivot(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round fractions pair by pair, moving words from one to the other until one is whole.

    Returns the rounded fractions, and the index and fraction of what is left
    (-1 if nothing is). Each step keeps the sum of fraction times size and every
    expected fraction.
    """
    out = np.zeros(part.size)
    held, share = -1, 0.0
    for i, (p, s, u) in enumerate(zip(part.tolist(), size.tolist(), draw.tolist(), strict=True)):
        if s <= 0 or p <= 0 or p >= 1:
            out[i] = 1.0 if s > 0 and p >= 1 else 0.0
            continue
        if held < 0:
            held, share = i, p
            continue
        t = size[held]
        up = min((1 - share) * t, p * s)  # words the held one can take from this one
        down = min(share * t, (1 - p) * s)
        move = up if u * (up + down) < down else -down
        a, b = share + move / t, p - move / s
        if a <= 1e-9 or a >= 1 - 1e-9:
            out[held] = round(a)
            held, share = (i, b) if 1e-9 < b < 1 - 1e-9 else (-1, 0.0)
            if held < 0:
                out[i] = round(b)
        else:
            out[i] = round(b)
            share = a
    return out, held, share


def _round(table: pa.Table, last: bool) -> pa.Table:
    # Long texts first, so that what is left unrounded in the end is short.
    table = table.sort_by([("size", "descending"), ("key", "ascending"), ("rid", "ascending")])
    draw = _uniform(table["key"].to_numpy().astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    extra, held, share = _pivot(table["part"].to_numpy(), table["size"].to_numpy().astype(float), draw)
    left = np.zeros(len(table))
    if held >= 0:
        if last:
            extra[held] = round(share)  # to the nearer, so its source misses the target by half a text at most
        else:
            left[held] = share
    return table.append_column("extra", pa.array(extra.astype(np.int64))).append_column("left", pa.array(left))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How often each row of docs is taken so that the sources reach their targets.

    Returns doc_id, source, size, source_size, target, copies, taken (= copies *
    size) and key (the hash that fixes the row's draw), a row for each row of
    docs. Sources rank by code point, null last, and weigh `weights` in
    turn. A source takes copies floor(f) or ceil(f) of each document, f =
    target / source_size, so that its words miss the target by half a
    document at most. Texts that are null or have no words are never taken; long
    ones are counted whole. Rows that repeat are separate rows; an empty table
    gives an empty one; other columns are not read. Draws hang on hashes of
    doc_id and text alone, and groups on the same hashes, so a rerun over the
    same rows agrees; rows whose hashes tie are alike in all that is read.

    A source's rows are dealt over groups of about GROUP_ROWS rows; each group
    leaves at most one unrounded row, and FAN_IN groups at a time meet in a
    reduction tree until one row is left for each source.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    sizes = store(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_size(F.col(text)).alias("size"), key.alias("key")), "sizes")
    targets = source_targets(sizes, weights)
    counts = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    plan = targets.join(counts, targets["source"].eqNullSafe(counts["source"])).select(targets["source"].alias("s"), "source_size", "target", F.ceil(F.col("rows") / GROUP_ROWS).alias("groups"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("base", F.floor(times)).withColumn("part", times - F.floor(times))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups"))).withColumn("rid", F.col("group"))

    done = store(_rounds(rows, last=False), "round")
    spark = docs.sparkSession
    depth, most = 0, plan.agg(F.max("groups")).first()[0] or 1
    while FAN_IN**depth < most:
        depth += 1
    left = done.where("left > 0").select("source", "size", "key", "rid", "group", F.col("left").alias("part"))
    settled = []
    for level in range(1, max(depth, 1) + 1):
        left = left.withColumn("group", F.floor(F.col("group") / FAN_IN) if level < depth else F.lit(0).cast("long"))
        step = store(_rounds(left, last=level >= depth), f"tree{level}")
        settled.append(step.where("left = 0").select("source", "rid", F.col("extra").alias("more")))
        left = step.where("left > 0").select("source", "size", "key", "rid", "group", F.col("left").alias("part"))
    tree = settled[0]
    for s in settled[1:]:
        tree = tree.union(s)
    tree = tree.withColumnRenamed("source", "s").withColumnRenamed("rid", "r")
    # At most a row for each group of GROUP_ROWS rows: only those unrounded after the first round.
    whole = done.where("left = 0").withColumn("copies", F.col("base") + F.col("extra"))
    rest = done.where("left > 0").join(tree, F.col("source").eqNullSafe(F.col("s")) & (F.col("rid") == F.col("r"))).withColumn("copies", F.col("base") + F.col("more"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long").alias("copies"), "key"]
    return whole.select(*columns).union(rest.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))


def _rounds(rows: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: each (source, group) in one task; at most one row of it stays unrounded."""
    schema = T.StructType(list(rows.schema.fields)).add("extra", T.LongType()).add("left", T.DoubleType())
    return rows.groupBy("source", "group").applyInArrow(lambda table: _round(table, last), schema)


def repeat_by_copies(docs: DataFrame, mixed: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs as often as mix_sources took them, all columns kept, whatever their names.

    Rows of one source with the same doc_id and text share their copies: each
    gets the same number, and the remainder goes to the first of them. Rows of
    null, empty and wordless texts are never taken, long ones whole or not at
    all; an empty table gives an empty one.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    per = mixed.groupBy(F.col("source").alias("m_source"), F.col("key").alias("m_key")).agg(F.sum("copies").alias("m_copies"), F.count(F.lit(1)).alias("m_rows"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("r_source"), key.alias("r_key"))
    met = row.join(per, (F.col("r_key") == F.col("m_key")) & F.col("r_source").eqNullSafe(F.col("m_source")))
    alone = met.where("m_rows = 1").withColumn("times", F.col("m_copies"))
    nth = F.row_number().over(Window.partitionBy("m_source", "m_key").orderBy(F.col("row")[text]))
    shared = met.where("m_rows > 1").withColumn("times", F.floor(F.col("m_copies") / F.col("m_rows")) + (nth <= F.col("m_copies") % F.col("m_rows")).cast("long"))
    return alone.union(shared).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
