"""Near-duplicate classes: weighted MinHash bands, verified multiset overlap, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import bag_minhash as bag
from plumbline.llm.scratch import map_arrow, store
from plumbline.llm.vectors import slices

SIMILARITY = 0.8
#: Bytes of text signed at once, and nodes in a block that meets another.
CHUNK, BLOCK = 2 << 20, 512
#: Signatures that fall short of the threshold by this much (over 5 standard deviations) aren't compared further.
PRUNE = 0.18
_NODE = "struct<a:bigint,b:bigint>"


def _nodes(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> pa.Array:
    fields = [pa.array(x.view(np.int64), pa.int64()) for x in (a, b)]
    return pa.StructArray.from_arrays(fields, ["a", "b"], mask=pa.array(~some))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in slices(batch.column(1), CHUNK):
            b = bag.bags(docs)
            some = np.diff(b.at) > 0
            minima = bag.signatures(b)
            keys = bag.bands(minima)
            at = np.concatenate([[0], np.cumsum(np.where(some, bag.BANDS, 0))])
            registers = pa.array([r.tobytes() if s else None for r, s in zip(bag.registers(minima), some.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(docs.first, docs.n) for c in (0, 2)), _nodes(*bag.identity(b), some), _lists(keys[some].ravel(), at), registers],
                names=["doc_id", "text_hash", "node", "bands", "registers"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in slices(batch.column(1), CHUNK):
            rows = [*(batch.column(c).slice(docs.first, docs.n) for c in (0, 2, 3)), _lists(*bag.elements(docs))]
            yield pa.RecordBatch.from_arrays(rows, names=["node", "registers", "bands", "elements"])


def _near_pairs(table: pa.Table, threshold: float, root: np.ndarray) -> np.ndarray:
    """Rows of two blocks of a bucket that must be compared, with their agreeing registers, the most alike first.

    They lie in different components, their signatures are near enough, and this
    band is the first that they share: a pair that meets in several buckets is
    compared in that of its first common band.
    """
    left, right, band = table["i"][0].as_py(), table["j"][0].as_py(), table["band"][0].as_py()
    block = table["block"].to_numpy()
    signed = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(table), bag.REGISTERS)
    keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), bag.BANDS)
    xs = np.flatnonzero(block == left)
    ys = xs if left == right else np.flatnonzero(block == right)
    found = [np.empty((3, 0), np.int64)]
    for x in xs.tolist():
        near = ys[ys > x] if left == right else ys
        near = near[root[near] != root[x]]
        share = (signed[near] == signed[x]).sum(axis=1)
        use = (share >= (threshold - PRUNE) * bag.REGISTERS) & ~(keys[near, :band] == keys[x, :band]).any(axis=1)
        if use.any():
            found.append(np.stack([np.full(use.sum(), x), near[use], share[use]]))
    pairs = np.concatenate(found, axis=1)
    return pairs[:2, np.argsort(-pairs[2], kind="stable")]


def _roots(table: pa.Table) -> np.ndarray:
    """A number for each row's component."""
    root = table["root"].combine_chunks()
    return np.unique(np.stack([np.asarray(root.field(f)) for f in ("a", "b")]), axis=1, return_inverse=True)[1].ravel()


def _open(threshold: float):
    """The nodes of one pair of blocks that have a pair to compare; decided on signatures, without elements."""

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.take(pa.array(np.unique(_near_pairs(table, threshold, _roots(table))))).select(["band", "key", "i", "j", "block", "root", "node"])

    return find


def _closing(threshold: float):
    """Links that unite components within one pair of blocks of a bucket."""

    def close(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        root = _roots(table)
        pairs = _near_pairs(table, threshold, root)
        links: list[tuple[int, int, float]] = []
        elements = table["elements"].combine_chunks()
        at, flat = np.asarray(elements.offsets), np.asarray(elements.values)
        while pairs.shape[1]:
            now, pairs = pairs[:, :256], pairs[:, 256:]
            (u, u_at), (v, v_at) = (bag.pick(flat, at, side) for side in now)
            value = bag.similarities(u, u_at, v, v_at)
            for k in np.flatnonzero(value >= threshold).tolist():
                x, y = int(now[0, k]), int(now[1, k])
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    links.append((x, y, float(value[k])))
            pairs = pairs[:, root[pairs[0]] != root[pairs[1]]]
        nodes = table["node"].combine_chunks()
        return pa.table({"u": nodes.take(pa.array([x for x, _, _ in links], pa.int64())), "v": nodes.take(pa.array([y for _, y, _ in links], pa.int64())), "similarity": pa.array([s for _, _, s in links], pa.float64())})

    return close


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left_elements", "right_elements"):
                column = batch.column(name)
                sides.append((np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])))
            (left, left_at), (right, right_at) = sides
            first = 0
            while first < batch.num_rows:  # some million elements at a time
                last = max(first + 1, int(np.searchsorted(left_at + right_at, left_at[first] + right_at[first] + (2 << 20), "right")) - 1)
                last = min(last, batch.num_rows)
                a, b = left_at[first : last + 1], right_at[first : last + 1]
                value = bag.similarities(left[a[0] : a[-1]], a - a[0], right[b[0] : b[-1]], b - b[0])
                hit = np.flatnonzero(value >= threshold) + first
                if hit.size:
                    rows = pa.array(hit)
                    yield pa.RecordBatch.from_arrays([batch.column("u").take(rows), batch.column("v").take(rows), pa.array(value[hit - first])], names=["u", "v", "similarity"])
                first = last

    return verify


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of nodes whose multisets are similar, compared exactly."""
    left = sets.select(F.col("node").alias("l_node"), F.col("elements").alias("left_elements"))
    right = sets.select(F.col("node").alias("r_node"), F.col("elements").alias("right_elements"))
    met = pairs.join(left, F.col("u") == F.col("l_node")).drop("l_node").join(right, F.col("v") == F.col("r_node")).drop("r_node")
    return map_arrow(met, _verify(threshold), f"u {_NODE}, v {_NODE}, similarity double")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node and root (its component's smallest node) for every node of edges (u, v).

    Alternates large-star and small-star steps until the edges no longer change;
    a node's neighbours are only ever reduced to their minimum, never gathered.
    A table goes as soon as the one made from it is stored.
    """
    now = store(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), name)
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        # Large star: neighbours above a node move to the smallest node around it.
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("m").alias("u"), "v").where("u != v")
        large = store(large.distinct(), f"{name}-large", instead_of=now)
        # Small star: a node and its neighbours below move to the smallest of them.
        low = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        small = large.join(low, F.col("v") == F.col("n")).select("m", F.col("u").alias("v")).where("m != v").union(low.select("m", "n"))
        now = store(small.distinct().toDF("u", "v"), f"{name}-small", instead_of=large)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """The near-duplicate class of every row of docs.

    Two texts are linked if their multisets of five-word shingles (words
    ``[0-9a-z]`` and all beyond ASCII, A-Z lower-cased; a text of one to four
    words is one shingle) have a weighted Jaccard similarity of threshold or
    more; classes are the connected components. Returns doc_id, class_id (the
    smallest doc_id in the class), class_size, kept (doc_id = class_id) and
    text_hash (xxhash64 of the text). Null, empty and wordless texts are classes
    of their own; long texts are signed and compared whole; rows that repeat a
    doc_id are all counted, and each that carries the class id (of ties, the
    smallest text hash too) is marked kept; null ids never name a class that has
    others. Other columns are not read; an empty table gives an empty one.

    Texts of equal multisets become one node. Nodes that agree in a band meet in
    a bucket: each is compared with the bucket's first node (one row for each
    member), and where that leaves several components in a bucket, the members
    outside its largest component are compared with all others, in blocks of
    BLOCK nodes, so no pair that shares a band is left out and no pair is a row.
    Blocks meet with their signatures first; the shingles follow only for nodes
    that have something to compare. What a bucket has in common (its first node,
    its largest component) is stored and joined to its members, so that the
    members of a large bucket may be split over tasks.
    """
    kind = docs.schema[doc_id].dataType
    node = T.StructType().add("a", T.LongType()).add("b", T.LongType())
    longs = T.ArrayType(T.LongType())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = T.StructType().add("doc_id", kind).add("text_hash", T.LongType()).add("node", node).add("bands", longs).add("registers", T.BinaryType())
    members = store(map_arrow(rows, _sign, signed), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = store(members.where("node is not null").groupBy("node").agg(first, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers")), "nodes")

    met = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    centre = met.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centre = store(centre.select(F.col("band").alias("c_band"), F.col("key").alias("c_key"), F.col("centre.node").alias("centre"), "size"), "centres")
    buckets = store(met.join(centre, (F.col("key") == F.col("c_key")) & (F.col("band") == F.col("c_band"))).select("band", "key", "node", "centre", "size"), "buckets")

    wanted = buckets.select("node").distinct().join(nodes.select(F.col("node").alias("n_node"), "first.doc_id", "first.text_hash", "registers", "bands"), F.col("node") == F.col("n_node"))
    wanted = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "registers", "bands")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & F.col("text_hash").eqNullSafe(F.col("w_hash"))).select("node", "text", "registers", "bands")
    sets = T.StructType().add("node", node).add("registers", T.BinaryType()).add("bands", longs).add("elements", longs)
    sets = store(map_arrow(texts, _elements, sets).dropDuplicates(["node"]), "sets")

    pairs = buckets.where("node != centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    stars = store(linked(pairs, sets.drop("registers", "bands"), threshold), "stars")
    root = components(stars, "star")

    # Buckets of three or more in which several components are left.
    inside = buckets.where("size > 2").join(root.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    inside = store(inside, "inside")
    per = inside.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("band", "key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size")).where("most.n < size")
    per = per.select(F.col("band").alias("p_band"), F.col("key").alias("p_key"), F.col("most.root").alias("main"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("many"))
    per = store(per, "several")
    open_ = inside.join(per, (F.col("key") == F.col("p_key")) & (F.col("band") == F.col("p_band")))
    side, deal = F.col("root") == F.col("main"), F.xxhash64("node", "key")
    block = F.when(side, F.col("few") + F.pmod(deal, F.col("many"))).otherwise(F.pmod(deal, F.col("few"))).cast("int")
    # Block pairs (i, j): i among the members outside the largest component.
    with_ = F.when(side, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
    open_ = open_.withColumn("block", block).withColumn("other", F.explode(with_)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    pair = ["band", "key", "i", "j"]
    signature = nodes.select(F.col("node").alias("s_node"), "registers", "bands")
    open_ = open_.select(*pair, "block", "root", "node").join(signature, F.col("node") == F.col("s_node")).drop("s_node")
    part = T.StructType([f for f in open_.schema.fields if f.name not in ("registers", "bands")])
    open_ = store(open_.groupBy(*pair).applyInArrow(_open(threshold), part), "open").withColumnRenamed("node", "o_node")
    links = T.StructType().add("u", node).add("v", node).add("similarity", T.DoubleType())
    closing = open_.join(sets, F.col("o_node") == F.col("node")).drop("o_node").groupBy(*pair).applyInArrow(_closing(threshold), links)
    closing = store(closing, "closing")
    # Star roots stand for their members, so only what the second step found is joined anew.
    top = root.select(F.col("node").alias("r_node"), "root")
    merged = closing.join(top, F.col("u") == F.col("r_node"), "left").select(F.coalesce("root", "u").alias("u"), "v").join(top, F.col("v") == F.col("r_node"), "left").select("u", F.coalesce("root", "v").alias("v"))
    high = components(merged, "closing").select(F.col("node").alias("h_node"), F.col("root").alias("h_root"))

    named = nodes.select("node", "first", "n").join(top, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("r_node")
    named = named.join(high, F.col("root") == F.col("h_node"), "left").select("node", "first", "n", F.coalesce("h_root", "root").alias("class"))
    classes = named.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    named = store(named.select("node", F.col("class").alias("of")).join(classes, F.col("of") == F.col("class")).select(F.col("node").alias("c_node"), "head", "class_size"), "classes")
    wordy = members.where("node is not null").join(named, F.col("node") == F.col("c_node"))
    alone = members.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_hash")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_hash").eqNullSafe(F.col("head.text_hash"))
    return wordy.select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size", kept.alias("kept"), "text_hash").union(alone)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row of docs, all columns kept whatever their names, for each near-duplicate class.

    The row with the class's smallest doc_id stays; of rows that repeat doc_id
    and text one does. Null, empty and wordless texts all stay; long texts are
    compared whole; an empty table gives an empty one.
    """
    found = near_duplicates(docs, text, doc_id, threshold)
    keep = found.where("kept").groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.count(F.lit(1)).alias("k_rows"), F.max("class_size").alias("k_size"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("r_id"), F.xxhash64(text).alias("r_hash"))
    met = row.join(keep, F.col("r_id").eqNullSafe(F.col("k_id")) & F.col("r_hash").eqNullSafe(F.col("k_hash")))
    single = (F.col("k_rows") == 1) | (F.col("k_size") == 1)
    return met.where(single).select("row.*").union(met.where(~single).dropDuplicates(["r_id", "r_hash"]).select("row.*"))
