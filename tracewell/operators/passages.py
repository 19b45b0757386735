"""Chunks of pages and search over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import chunk_text_udf, places_udf
from .iterate import materialize


def chunk(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """chunk_id, doc_id, page_num, ord and text of every chunk."""
    parts = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_num"), F.posexplode(chunk_text_udf(text)).alias("ord", "text"))
    return parts.withColumn("chunk_id", C.digest_id(32, F.col("doc_id"), F.col("page_num"), F.col("ord"), F.col("text"))).select("chunk_id", "doc_id", "page_num", "ord", "text")


def placed(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, doc_id, page_num, start and end of the stretches of its page (text) that a chunk occupies, read in the chunks' order
    (ord): one where the order holds, all where it doesn't, none for a chunk that isn't found. A page's chunks are one list."""
    lists = chunks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text"))).alias("_c"))
    found = lists.join(pages.select("doc_id", "page_num", F.col("text").alias("_page")), ["doc_id", "page_num"])
    spots = found.withColumn("_s", places_udf("_page", F.transform("_c", lambda c: c["text"])))
    each = spots.select("doc_id", "page_num", F.explode(F.arrays_zip(F.transform("_c", lambda c: c["chunk_id"]).alias("id"), F.col("_s").alias("spots"))).alias("x"))
    return each.select(F.col("x.id").alias("chunk_id"), "doc_id", "page_num", F.inline("x.spots"))


def keyword_search(chunks: DataFrame, question: str, limit: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks with most of the question's first 12 words of 3 or more letters; every chunk is scored, then a top-k."""
    import re

    terms = re.findall(r"\w{3,}", question.lower())[:12]
    low = F.lower(text)
    score = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return chunks.select(key, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int, key: str, column: str) -> DataFrame:
    """Rows of largest inner product with the query; other widths are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size(column) == len(query))
    return rows.select(key, F.round(C.dot(F.col(column), q), 4).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def question_vector(parts: DataFrame, column: str) -> DataFrame:
    """The mean of several vectors, of length 1: by place, so that widths need not be known."""
    mean = parts.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select(F.transform("v", lambda p: p["x"] / F.col("n")).alias(column))


def outstanding(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of this model."""
    return chunks.join(index.where((F.col("model") == model) & F.col("embedding").isNotNull()), "chunk_id", "left_anti")


def index_stats(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Chunks, those with a vector, and those whose vector is another model's."""
    held = index.select("chunk_id", "model", F.col("embedding").isNotNull().alias("has"))
    rows = chunks.select("chunk_id").join(held, "chunk_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("has").alias("indexed"), F.count_if(F.col("has") & (F.col("model") != model)).alias("stale"))


def with_documents(chunks: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """chunks with columns of their documents; chunks without one go."""
    return chunks.join(documents.select("doc_id", *columns), "doc_id")


#: Vectors of a part; pivots at most, of which there are no more than full parts, and the sample that they are chosen from.
NEAR_BLOCK, PIVOTS, SAMPLE = 256, 128, 4096
#: Binary digits of the number of parts that travel together.
GROUP_BITS = 4
#: What rounding may take from a bound.
SLACK = 1e-6


def near_blocks(vectors: DataFrame, block: str, key: str, column: str) -> DataFrame:
    """block, part, dims, ids, data (doubles, row by row), n, centre, radius and most of parts of NEAR_BLOCK vectors at most. Vectors
    stand by the pivot nearest in angle and by the angle to it, so that a part is narrow: radius bounds the angles to its centre, most
    the lengths. Vectors without components or with null or non-finite ones are in none."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    x = F.col(column)
    fine = F.col(key).isNotNull() & F.col(block).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(fine).select(F.col(block).alias("block"), F.col(key).alias("id"), x.cast("array<double>").alias("x"))
    sample = [np.array(r.x) for r in rows.orderBy(F.xxhash64("x"), "id").limit(SAMPLE).select("x").collect()]
    most = max(1, min(PIVOTS, rows.count() // NEAR_BLOCK))
    pivots = {d: spread(unit(np.stack([v for v in sample if len(v) == d])), most) for d in {len(v) for v in sample}}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, angle = [], []
            for v in batch.column("x").to_pylist():
                v = np.array(v)
                cosines = pivots.get(len(v), np.eye(1, len(v))) @ unit(v[None])[0]
                nearest.append(int(cosines.argmax()))
                angle.append(float(cosines.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(angle)], [*batch.schema.names, "pivot", "angle"])

    placed = materialize(rows.mapInArrow(place, f"block {kinds[block]}, id {kinds[key]}, x array<double>, pivot int, angle double"), "near-placed")
    # two levels of sorting: a block of any size is in as many ranges as it needs
    by = [F.col("block"), F.size("x"), F.col("pivot"), F.desc("angle"), F.xxhash64("id")]
    ranged = placed.repartitionByRange(*by).sortWithinPartitions(*by)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            data = np.stack([v for _, _, v in held])
            u, size = unit(data), np.sqrt((data * data).sum(1))
            centre = unit(u.sum(0)[None])[0]
            radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) + SLACK if size.min() > 0 else np.pi
            one = lambda values, kind: pa.array([values], kind)
            ids = pa.array([i for _, i, _ in held], id_type)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0][0]], block_type), one(data.shape[1], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(data.astype("<f8").tobytes(), pa.binary()), one(len(held), pa.int32()), one(centre.tolist(), pa.list_(pa.float64())), one(radius, pa.float64()), one(float(size.max()), pa.float64())], ["block", "dims", "ids", "data", "n", "centre", "radius", "most"])

        held: list[tuple] = []
        for batch in batches:
            id_type, block_type = batch.column("id").type, batch.column("block").type
            for b, i, v, p in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "x", "pivot")), strict=True):
                if held and (held[-1][0] != (b, len(v), p) or len(held) == NEAR_BLOCK):
                    yield out()
                    held = []
                held.append(((b, len(v), p), i, np.array(v)))
        if held:
            yield out()

    parts = ranged.select("block", "id", "x", "pivot").mapInArrow(gather, f"block {kinds[block]}, dims int, ids array<{kinds[key]}>, data binary, n int, centre array<double>, radius double, most double")
    return materialize(parts.withColumn("part", F.monotonically_increasing_id()), "near-parts")


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x at most, each the farthest in angle from those before it."""
    taken, near = [0], x @ x[0]
    while len(taken) < min(n, len(x)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    return x[taken]


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def reachable(parts: DataFrame, threshold: float) -> DataFrame:
    """p and q: the parts of a block whose vectors may have a product of threshold or more, each pair once. Angles obey the triangle
    inequality, so two vectors are no nearer than their centres less both radii; outlines alone are compared, NEAR_BLOCK times
    NEAR_BLOCK fewer than pairs of vectors."""
    lines = parts.select("block", "dims", "part", "centre", "radius", "most")
    a, b = (lines.select("block", "dims", *[F.col(c).alias(f"{s}_{c}") for c in ("part", "centre", "radius", "most")]) for s in "pq")
    apart = F.acos(F.least(F.greatest(C.dot(F.col("p_centre"), F.col("q_centre")), F.lit(-1.0)), F.lit(1.0))) - F.col("p_radius") - F.col("q_radius") - SLACK
    # the least angle gives the largest product if that is positive, else the least lengths may; 0 bounds those
    bound = F.when(F.col("p_part") == F.col("q_part"), F.col("p_most") * F.col("q_most")).otherwise(F.col("p_most") * F.col("q_most") * F.greatest(F.cos(F.greatest(apart, F.lit(0.0))), F.lit(0.0)))
    return a.join(b, ["block", "dims"]).where(F.col("p_part") <= F.col("q_part")).where(bound + SLACK * (1 + F.abs(bound)) >= threshold - 0.00005).select(F.col("p_part").alias("p"), F.col("q_part").alias("q"))


def near_pairs(vectors: DataFrame, block: str, threshold: float, key: str, column: str) -> DataFrame:
    """Pairs of one block whose product, to four places, reaches the threshold. Parts of near vectors are held against each other by
    exact bounds, and only those that may hold such a pair meet, as matrices. A threshold of 0 or less makes all meet."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    parts = near_blocks(vectors, block, key, column)
    # parts travel by groups: a group meets another once, whatever number of their parts meet; where few do, only those travel
    group = lambda c: F.shiftright(c, GROUP_BITS)
    met = reachable(parts, threshold).groupBy(group("p").alias("gp"), group("q").alias("gq")).agg(F.collect_list(F.struct("p", "q")).alias("pairs"))
    met = materialize(met, "near-met")
    one = F.struct("part", "block", "dims", "ids", "data")
    few = F.size("pairs") < 1 << GROUP_BITS
    packs = parts.groupBy(group("part").alias("g")).agg(F.collect_list(one).alias("x"))
    alone = parts.select(F.col("part").alias("g"), F.array(one).alias("x"))
    many = met.where(~few).join(packs.toDF("gp", "left"), "gp").join(packs.toDF("gq", "right"), "gq").select("pairs", "left", "right")
    single = met.where(few).select(F.explode("pairs").alias("o")).select(F.array("o").alias("pairs"), F.col("o.p").alias("gp"), F.col("o.q").alias("gq"))
    single = single.join(alone.toDF("gp", "left"), "gp").join(alone.toDF("gq", "right"), "gq").select("pairs", "left", "right")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in ("left", "right")]
                place = [{p: i for i, p in enumerate(s.field("part").to_pylist())} for s in sides]
                for pair in batch.column("pairs")[k].as_py():
                    i, j = place[0][pair["p"]], place[1][pair["q"]]
                    yield held(sides[0], i, sides[1], j, pair["p"] == pair["q"])

    def held(left: pa.StructArray, m: int, right: pa.StructArray, n: int, own: bool) -> pa.RecordBatch:
        d = left.field("dims")[m].as_py()
        x, y = (np.frombuffer(s.field("data")[at].as_py(), "<f8").reshape(-1, d) for s, at in ((left, m), (right, n)))
        score = np.round(x @ y.T, 4)
        i, j = np.nonzero(score >= threshold)
        if own:
            i, j = i[i < j], j[i < j]
        a, b = left.field("ids")[m].values.take(pa.array(i)), right.field("ids")[n].values.take(pa.array(j))
        less = pa.compute.less(a, b)
        ends = [pa.compute.if_else(less, a, b), pa.compute.if_else(less, b, a)]
        block = left.field("block")
        return pa.RecordBatch.from_arrays([pa.array([block[m].as_py()] * len(i), block.type), *ends, pa.array(score[i, j])], ["block", "a", "b", "score"]).filter(pa.compute.not_equal(a, b))

    return many.unionByName(single).mapInArrow(meet, f"block {kinds[block]}, a {kinds[key]}, b {kinds[key]}, score double")
