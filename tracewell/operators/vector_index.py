"""A stored vector index: exact search that reads few of its cells.

Cells are the vectors nearest to one of some centroids, which are fitted on a bounded sample; every vector is in one. A cell's radius
bounds the distance of its vectors to the centroid, so no product of a query with one of them exceeds that with the centroid by more
than radius times the query's length. A search reads the cells of highest bounds first, and then those alone whose bounds reach what
it has found: what it leaves out can't be among the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .iterate import materialize

#: Vectors of the sample that centroids are fitted on, rounds of fitting, and cells at most and first read by a search.
SAMPLE, ROUNDS, MOST_CELLS, FIRST = 20_000, 6, 1024, 4
#: What rounding may take from a bound, in proportion.
SLACK = 1e-9


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of a sample at most, by Lloyd's rounds from spread-out rows."""
    centre = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        own = nearest(sample, centre)
        held = np.unique(own)
        centre = np.stack([sample[own == k].mean(0) for k in held])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)


def usable(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """key and x of the vectors that have a key and dims finite components."""
    x = F.col(column).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(column) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine).select(F.col(key).alias("key"), x.alias("x"))


def placed(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """rows with their cell and the distance to its centroid."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = nearest(x, centre)
            far = np.sqrt(((x - centre[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], ["key", "x", "cell", "far"])

    return rows.mapInArrow(run, f"key {kind}, x array<double>, cell int, far double")


def build(store: Versions, vectors: DataFrame, key: str, column: str, model: str, cells: int | None = None) -> int:
    """Put an index of all vectors (of the width that most of a sample have) in the store, instead of what is there: tables vectors
    (in buckets by cell), cells and about. The number of the version. Rows without a key, and vectors of another width or with null
    or non-finite components, aren't in it."""
    spark = vectors.sparkSession
    some = vectors.where(F.col(key).isNotNull() & (F.size(column) > 0)).orderBy(F.xxhash64(key)).limit(SAMPLE)
    widths = some.groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), "w").first()
    dims = widths["w"] if widths else 0
    sample = np.array([r.x for r in usable(some, key, column, dims).collect()], float).reshape(-1, max(1, dims))
    n = cells or int(np.clip(np.sqrt(vectors.count()), 1, MOST_CELLS))
    centre = centroids(sample, n) if len(sample) else np.zeros((1, max(1, dims)))
    rows = materialize(placed(usable(vectors, key, column, dims), centre), "index-vectors")
    about = spark.createDataFrame([(model, dims)], "model string, dims int")
    return store.commit(replace={"vectors": rows.select("cell", "key", "x"), "cells": described(spark, rows, centre), "about": about}, buckets={"vectors": ("cell", min(len(centre), 64))})


def described(spark, rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """cell, centre, radius and size: one row for each cell, MOST_CELLS at most."""
    found = {r.cell: r for r in rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("size")).collect()}
    return spark.createDataFrame([(k, c.tolist(), found[k].radius if k in found else 0.0, found[k].size if k in found else 0) for k, c in enumerate(centre)], "cell int, centre array<double>, radius double, size long")


def add(store: Versions, vectors: DataFrame, key: str, column: str, model: str) -> int:
    """Put the vectors whose keys the index lacks into their cells, as a version of its own. An index of another model is stale:
    ValueError."""
    held = store.manifest()
    about = store.read("about", held).first()
    if about.model != model:
        raise ValueError(f"the index holds vectors of {about.model}")
    old = {r.cell: r for r in store.read("cells", held).collect()}
    centre = np.array([old[k].centre for k in sorted(old)])
    new = usable(vectors, key, column, about.dims).join(store.read("vectors", held).select("key"), "key", "left_anti")
    rows = materialize(placed(new, centre), "index-new")
    now = described(vectors.sparkSession, rows, centre).toDF("cell", "centre", "_r", "_n")
    both = store.read("cells", held).join(now.drop("centre"), "cell").select("cell", "centre", F.greatest("radius", "_r").alias("radius"), (F.col("size") + F.col("_n")).alias("size"))
    return store.commit(append={"vectors": rows.select("cell", "key", "x")}, replace={"cells": materialize(both, "index-cells")})


def search(store: Versions, query: list[float], k: int, model: str | None = None) -> tuple[DataFrame, list[int]]:
    """key and score (the product, to four places) of the k best of all vectors, ties to the smaller key; and the cells that were
    read. None, without a read, for a query of another width or model."""
    held = store.manifest()
    about = store.read("about", held).first()
    rows, spark = None, store.spark
    for part in store.parts("vectors", held):  # in buckets by cell, so cells that aren't asked for aren't read
        rows = part if rows is None else rows.union(part)
    if len(query) != about.dims or model not in (None, about.model):
        return spark.createDataFrame([], f"key {rows.schema['key'].dataType.simpleString()}, score double"), []
    q = np.array(query, float)
    cells = [c for c in store.read("cells", held).collect() if c.size]
    bound = {c.cell: float(q @ np.array(c.centre)) + c.radius * float(np.sqrt(q @ q)) for c in cells}
    order = sorted(bound, key=lambda c: -bound[c])
    literal = F.array(*[F.lit(float(v)) for v in q])
    score = F.round(F.aggregate(F.zip_with("x", literal, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 4)

    def best(some: list[int]) -> DataFrame:
        return rows.where(F.col("cell").isin(some)).select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)

    first, size = [], 0
    while len(first) < len(order) and (len(first) < FIRST or size < k):
        first.append(order[len(first)])
        size += next(c.size for c in cells if c.cell == first[-1])
    found = materialize(best(first), "index-first")
    bar = found.agg(F.min("score"), F.count(F.lit(1))).first()
    least = bar[0] if bar[1] == k else -np.inf
    rest = [c for c in order[len(first) :] if bound[c] + SLACK * abs(bound[c]) + 0.0001 >= least]
    if rest:
        found = found.union(best(rest)).orderBy(F.desc("score"), "key").limit(k)
    return found, first + rest
