"""Near duplicates among vectors by a pivot-permutation index.

A vector is described by the order of the pivots (reference vectors) nearest to it: its first PREFIX of them. Vectors that lie
near each other have near pivots in common. An inverted list holds the vectors that have the same SHARED pivots among theirs,
so two vectors meet in a list exactly if they share that many; of the lists in which they meet, that of the least shared
pivots is the one that verifies them, by their cosine in double precision.

Equal vectors are one, with a count. A list of any length is dealt into blocks, and pairs of blocks meet in tasks of bounded
size; what leaves a task is a number of links for each vector and the edges of a forest, never its pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities
from . import common

#: Pivots in a vector's description, and pivots that two vectors must share to be compared.
PREFIX, SHARED = 8, 2
#: Pivots at least and at most, bytes that they may take, and vectors of the sample that they are chosen from.
FEWEST, MOST, PIVOT_BYTES, SAMPLE = 16, 4096, 32 << 20, 16384
#: Cosines that pivots may have with each other, at most: the first at which there are enough of them.
APART = (0.5, 0.7, 0.85, 0.95)
#: Vectors of a block.
BLOCK = 1024
#: Cosines this near to the bound are computed again from the vectors as they are.
CLOSE = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; components of any size neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of sample (of length one), each as far from those before it as the others allow."""
    taken: list[int] = []
    near = np.full(len(sample), -np.inf)
    for bound in APART:
        for i in range(len(sample)):
            if len(taken) == n:
                return sample[taken]
            if near[i] < bound:
                taken.append(i)
                near = np.maximum(near, sample @ sample[i])
                near[i] = np.inf
    return sample[taken]


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row the numbers of its PREFIX nearest pivots, the nearest first; ties go to the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :PREFIX].astype("<i4")


def least_shared(x: np.ndarray, y: np.ndarray, n_pivots: int) -> np.ndarray:
    """The list that verifies each pair of rows of permutations: that of the SHARED least pivots which they share, -1 if they
    share fewer. With fewer than SHARED pivots there is one list, 0."""
    if n_pivots < SHARED:
        return np.zeros(len(x), np.int64)
    held = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int32).max)
    held = np.sort(held, 1)[:, :SHARED].astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for k in range(SHARED):
        out = out * n_pivots + held[:, k]
    return np.where(held[:, -1] == np.iinfo(np.int32).max, -1, out)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y whose cosine is least or more."""
    score = units(x) @ units(y).T
    i, j = np.nonzero(score >= least - CLOSE)
    doubt = np.flatnonzero(score[i, j] < least + CLOSE)
    if len(doubt):
        a, b = (v[k[doubt]] / np.abs(v[k[doubt]]).max(1, keepdims=True) for v, k in ((x, i), (y, j)))
        cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        keep = np.ones(len(i), bool)
        keep[doubt] = cosine >= least
        i, j = i[keep], j[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by the links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def distinct(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """rows: key and the two hashes of every row's vector, null where it takes no part. nodes: node, h1, h2, dims, copies, first
    (the least key) and v of every different vector that does."""
    x = F.col(vector)
    fine = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    v = F.when(fine, F.transform(x, lambda c: c.cast("double")))
    # 128 bits tell vectors apart
    rows = vectors.select(F.col(key).alias("key"), v.alias("v")).withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(11), "v"))})
    rows = common.materialize(rows, "pivot-rows")
    found = rows.where("v is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"), F.first("v").alias("v"))
    nodes = found.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.size("v").alias("dims"), "copies", "first", "v")
    return rows.select("key", "h1", "h2"), common.materialize(nodes, "pivot-nodes")


def fitted(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by number of components, chosen from a bounded sample: the SAMPLE vectors of least hash (fewer, if they are long).
    Their number is about the square root of that of all vectors, so that lists keep their length."""
    n = nodes.count()
    longest = nodes.agg(F.max("dims")).first()[0] or 1
    sample = nodes.orderBy("h1", "h2").limit(max(1, min(SAMPLE, 4 * PIVOT_BYTES // (8 * longest)))).select("dims", "v").toArrow()
    want = int(np.clip(2 ** round(np.log2(max(n, 1)) / 2), FEWEST, MOST))
    out = {}
    for d in np.unique(sample.column("dims").to_numpy()).tolist():
        own = sample.filter(pa.compute.equal(sample.column("dims"), d)).column("v").combine_chunks()
        out[d] = choose(units(own.flatten().to_numpy().reshape(-1, d)), min(want, max(1, PIVOT_BYTES // (8 * d))))
    return out


def described(nodes: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """node, dims, copies, pivots (the number there are), near (a vector's nearest, in order) and v (binary numbers of a kind
    that holds them exactly) of all nodes. Vectors of a length that the sample lacks have one pivot, and so share one list."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = part.column("v").flatten().to_numpy().reshape(-1, d)
                own = pivots.get(d, np.eye(1, d))
                near = permutations(units(x), own)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * d), len(x), [None, pa.py_buffer(x.astype(kind).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("dims"), part.column("copies"), pa.array(np.full(len(x), len(own), np.int32)), flat, blobs], ["node", "dims", "copies", "pivots", "near", "v"])

    found = nodes.select("node", "dims", "copies", "v").mapInArrow(run, "node long, dims int, copies long, pivots int, near array<int>, v binary")
    return common.materialize(found, "pivot-permutations")


def lists(vectors: DataFrame) -> DataFrame:
    """vectors with dims and list: a row for each inverted list that holds a vector. A list is told by its SHARED pivots in
    order, as a number."""
    few = F.col("pivots") < SHARED
    near = F.sort_array("near")
    keys = []
    for places in combinations(range(PREFIX), SHARED):
        number = F.lit(0).cast("long")
        for p in places:
            number = number * F.col("pivots") + F.get(near, F.lit(p))
        keys.append(number)  # null where there are fewer pivots
    return vectors.withColumn("list", F.explode(F.when(few, F.array(F.lit(0).cast("long"))).otherwise(F.array_compact(F.array(*keys)))))


def compared(vectors: DataFrame, least: float) -> DataFrame:
    """a, b and n: rows without b give n links to a vector, others connect two. Lists of more than BLOCK vectors are dealt into
    blocks, each pair of which is a task of its own."""
    held = lists(vectors)
    sizes = held.groupBy("dims", "list").agg(F.count(F.lit(1)).alias("size"))
    long = common.materialize(sizes.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size"), "pivot-long-lists")
    dealt = held.join(long, ["dims", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = ["dims", "list", "i", "j"]
    dealt = dealt.select("dims", "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "pivots", "near", "v")

    def verify(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        group = pa.Table.from_batches(rows).combine_chunks()
        head = {c: group.column(c)[0].as_py() for c in (*meet, "pivots")}
        n, d = group.num_rows, head["dims"]
        raw = b"".join(group.column("v").to_pylist())
        x = np.frombuffer(raw, f"<f{len(raw) // (n * d)}").reshape(n, d).astype(np.float64)
        near = group.column("near").combine_chunks().flatten().to_numpy().reshape(n, -1)
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        if head["i"] == head["j"]:
            i, j = linked(x, x, least)
            i, j = i[i < j], j[i < j]
        else:
            one = group.column("own").to_numpy() == head["i"]
            left, right = np.flatnonzero(one), np.flatnonzero(~one)
            i, j = linked(x[left], x[right], least) if len(left) and len(right) else (left[:0], right[:0])
            i, j = left[i], right[j]
        keep = np.concatenate([least_shared(near[i[s : s + BLOCK]], near[j[s : s + BLOCK]], head["pivots"]) == head["list"] for s in range(0, len(i), BLOCK)]) if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        label = forest(n, i, j)
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        a, n_links = np.concatenate([node[some], node[moved]]), np.concatenate([links[some], np.zeros(len(moved))]).astype(np.int64)
        b = np.concatenate([np.zeros(len(some), np.int64), node[label[moved]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) < len(some)), pa.array(n_links)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        last, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in meet], 1)
            cuts = np.flatnonzero(np.append(np.append(True, (keys[1:] != keys[:-1]).any(1)), True)).tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[s])
                if now != last:
                    if sum(r.num_rows for r in rows) > 1 and (out := verify(rows)):
                        yield out
                    last, rows = now, []
                rows.append(batch.slice(s, e - s))
        if sum(r.num_rows for r in rows) > 1 and (out := verify(rows)):
            yield out
        common.release()

    spark = vectors.sparkSession
    met = dealt.repartition(common.shuffle_partitions(spark), *meet).sortWithinPartitions(*meet)
    return common.materialize(met.mapInArrow(run, "a long, b long, n long"), "pivot-links")


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row: the other rows whose vectors have a cosine of least or more with its own
    (0 < least <= 1) and were found, the least key that is reachable by links, and whether that is its own key.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and those of rows without a key, link with
    nothing; so do vectors of different lengths. Rows of one key are rows of their own. Columns but these two take no part."""
    rows, nodes = distinct(vectors, key, vector)
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    found = compared(described(nodes, fitted(nodes), kind), least)
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    group = entities.components(found.where("b is not null").select("a", "b"))
    least_key = group.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    group = group.join(least_key, "component").select("node", "least")
    told = nodes.select("node", "h1", "h2", "copies", "first").join(degree, "node", "left").join(group, "node", "left")
    told = common.materialize(told.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "pivot-told")
    out = rows.join(told, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"), F.coalesce("component_id", "key").eqNullSafe(F.col("key")).alias("kept"))


def op11_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings by a cosine of 0.9."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  coalesce(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings),
f AS (SELECT * FROM e WHERE fine AND vec_id IS NOT NULL),
links AS (SELECT a.rid AS a, b.rid AS b FROM f a JOIN f b ON a.rid <> b.rid AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT rid, rid AS other FROM e UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT r.rid, min(e.vec_id) AS component_id FROM reach r JOIN e ON e.rid = r.other GROUP BY r.rid),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, component_id IS NOT DISTINCT FROM e.vec_id AS kept FROM e JOIN least USING (rid) LEFT JOIN n ON n.a = e.rid
"""
