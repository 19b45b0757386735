"""Entities: mentions, labels, likeness of names, merges, and pointers to canonical ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.kernels import RANKS, SUFFIXES, name_score_udf, normalize_udf, rival_keys_udf

STOP = RANKS + SUFFIXES
#: Predicates that state an alias.
ALIAS = r"(?i)^(also known as|a\.?k\.?a\.?|is also called|known as|formerly known as)$"


def with_ids(mentions: DataFrame, exact: bool = True) -> DataFrame:
    """mentions (entity_type, name) with entity_id; exact: by full Unicode decomposition (Python), else by translate()."""
    norm = normalize_udf("name") if exact else C.normalize_name(F.col("name"), STOP)
    return mentions.withColumn("entity_id", F.concat_ws(":", "entity_type", norm))


def entities(mentions: DataFrame) -> DataFrame:
    """entity_id, entity_type, mentions and label: of an entity's forms that without a comma, then of most words, then the
    longest, then the first."""
    words = F.size(F.split(C.squash(F.col("name")), " "))
    order = F.struct((F.contains(F.col("name"), F.lit(",")) & (F.col("entity_type") == "PERSON")).cast("int"), -words, -F.length("name"), "name")
    return mentions.groupBy("entity_id", "entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.min_by("name", order).alias("label"))


def stated_aliases(triples: DataFrame) -> DataFrame:
    """a and b: names that a triple says are one person's."""
    rows = triples.where(F.col("predicate").rlike(ALIAS) & (F.col("subject_type") == "PERSON") & (F.col("object_type") == "PERSON"))
    return rows.select(F.concat_ws(":", F.lit("PERSON"), normalize_udf("subject_name")).alias("a"), F.concat_ws(":", F.lit("PERSON"), normalize_udf("object_name")).alias("b")).where("a <> b").distinct()


def rival_pairs(entity: DataFrame, least: float = 88.0) -> DataFrame:
    """a, b and score of like names of one type: all pairs whose score is least or more.

    Names are never compared all with all. They meet in keys that no pair of that score lacks (kernels.rival_keys): segments
    of the shorter name at the places that so few edits allow, a last name alone, initials."""
    rows = entity.where(F.col("entity_type").isin("PERSON", "ORG", "LOCATION")).select("entity_id", "entity_type", F.substring_index("entity_id", ":", -1).alias("norm"))
    rows = rows.withColumn("keys", rival_keys_udf(least)("norm"))
    a = rows.select("entity_type", F.explode("keys.held").alias("key"), F.col("entity_id").alias("a"), F.col("norm").alias("x"))
    b = rows.select("entity_type", F.explode("keys.sought").alias("key"), F.col("entity_id").alias("b"), F.col("norm").alias("y"))
    met = a.join(b, ["entity_type", "key"]).where("a <> b")
    pair = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "x", "y")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y")))
    return met.select(F.inline(F.array(pair))).distinct().select("a", "b", name_score_udf("x", "y").alias("score")).where(F.col("score") >= least)


def unambiguous(pairs: DataFrame) -> DataFrame:
    """pairs whose ends have no second rival."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id")))))
    doubtful = ends.groupBy("id").count().where("count > 1").select("id")
    return pairs.join(doubtful.withColumnRenamed("id", "a"), "a", "left_anti").join(doubtful.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "score")


#: Edges that starred() takes at a time.
STAR_ROWS = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, for edges between a and b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return root


def starred(edges: DataFrame, a: str, b: str) -> DataFrame:
    """a and b of edges with the same components: of each STAR_ROWS edges of a task, a row for each node, to one node of its component
    among them. Ids other than whole numbers and texts stay as they are."""
    edges = edges.select(F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b"))
    kind = edges.schema["a"].dataType
    if kind != edges.schema["b"].dataType or not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and kind != T.StringType():
        return edges

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches)
        both = whole.drop_null()  # both ends are null, or none
        ends = pa.chunked_array([*both.column("a").chunks, *both.column("b").chunks], both.schema.field("a").type).combine_chunks().dictionary_encode()
        place, n = ends.indices.to_numpy(), len(ends.dictionary)
        root = roots_of(place[: both.num_rows], place[both.num_rows :], n)
        rows = np.flatnonzero((root != np.arange(n)) | (np.bincount(root, minlength=n) == 1))  # a node of no other stays by itself
        lone = pa.nulls(int(both.num_rows < whole.num_rows), ends.dictionary.type)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([ends.dictionary.take(pa.array(x, pa.int64())), lone]) for x in (rows, root[rows])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= STAR_ROWS:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return edges.mapInArrow(each, f"a {kind.simpleString()}, b {kind.simpleString()}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) of all nodes of edges.

    Each round every node hooks to its least neighbour, pointers are doubled to their roots, and the edges are contracted: a round at
    least halves what is left, and a chain of any length is one. Minima are partial before they move, and joins keep one row a node
    on one side, so a star of any size is no hot spot. Files of a round go with the next. Before anything moves, each task puts
    stars for the edges that it reads (starred)."""
    from .iterate import drop, materialize

    edges = starred(edges, a, b)
    edges = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    held, edges = edges, edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("to"))
        step, moved = materialize(hook, "hooks"), True
        while moved:  # to the roots, by doubling
            hook = step.select("node", "to")
            next_one = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")).hint("merge"), "to", "left")
            old, step = step, materialize(next_one.select("node", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooks")
            drop(old)
            moved = not step.where("moved").isEmpty()
        hook = step.select("node", "to")
        old, labels = labels, materialize(labels.join(hook.withColumnRenamed("node", "component").hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        drop(old)
        at, bt = hook.select(F.col("node").alias("a"), F.col("to").alias("x")), hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        old, held = held, materialize(edges.join(at.hint("merge"), "a").join(bt.hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "links")
        drop(old, step)
        edges = held
    drop(held)
    return labels


def merge(entity: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity with merged_into: each component's entity of most words, then longest, then most mentions, then least id."""
    found = components(pairs).join(entity.select(F.col("entity_id").alias("node"), "label", "mentions"), "node")
    order = F.struct(-F.size(F.split("label", " ")), -F.length("label"), -F.col("mentions"), "node")
    root = found.groupBy("component").agg(F.min_by("node", order).alias("root"))
    into = found.join(root, "component").where("node <> root").select(F.col("node").alias("entity_id"), F.col("root").alias("merged_into"))
    return entity.drop("merged_into").join(into, "entity_id", "left")


def resolve(pointers: DataFrame, node: str = "entity_id", parent: str = "merged_into") -> DataFrame:
    """node and root of every pointer, by pointer doubling; null ends a chain. Joins shuffle: pointers are small as files and not in
    memory, and each round's would go through the driver if Spark broadcast them. What leads into a cycle ends at the node where it
    enters it, and a node on a cycle is its own root."""
    from .iterate import materialize

    pointers = materialize(pointers.select(F.col(node).alias("node"), F.nullif(parent, node).alias("up")))
    total, steps = pointers.count(), 1
    now = pointers.select("node", F.coalesce("up", "node").alias("root"))
    while steps <= 2 * total:  # beyond the longest chain, only cycles still move
        up = now.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = now.join(up.hint("merge"), F.col("root") == F.col("_n"), "left")
        step = materialize(step.select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved")))
        now, steps = step.select("node", "root"), 2 * steps
        if step.where("moved").isEmpty():
            break
    # what still points on after so many steps is on a cycle, and all of a cycle is reached
    cycle = materialize(now.select(F.col("root").alias("node")).distinct().join(pointers.where("up is not null").hint("merge"), "node", "left_semi"))
    if cycle.isEmpty():
        return now
    held = cycle.withColumn("_cycle", F.lit(True))
    return resolve(pointers.join(held.hint("merge"), "node", "left").select("node", F.when(F.col("_cycle").isNull(), F.col("up")).alias("up")), "node", "up")


def compact(entity: DataFrame) -> DataFrame:
    """entity (entity_id, label, mentions, merged_into) with every pointer at its root. Of a cycle the entity of most words, then the
    longest, then of most mentions, then of least id is the root."""
    roots = resolve(entity.select("entity_id", "merged_into"))
    own = entity.select(F.col("entity_id").alias("node"), "merged_into", "label", "mentions")
    # a root that points on is on a cycle; the pointers of cycles alone are links of one component each
    on = roots.where("node = root").join(own.hint("merge"), "node").where("merged_into is not null and merged_into <> node")
    ring = components(on.select(F.col("node").alias("a"), F.col("merged_into").alias("b")))
    order = F.struct(-F.size(F.split("label", " ")), -F.length("label"), -F.col("mentions"), "node")
    best = ring.join(own.hint("merge"), "node").groupBy("component").agg(F.min_by("node", order).alias("best"))
    end = ring.join(best.hint("merge"), "component").select(F.col("node").alias("root"), "best")
    into = roots.join(end.hint("merge"), "root", "left").select(F.col("node").alias("entity_id"), F.coalesce("best", "root").alias("_root"))
    return entity.join(into.hint("merge"), "entity_id", "left").withColumn("merged_into", F.when(F.col("_root") != F.col("entity_id"), F.col("_root"))).drop("_root")


def rolled_up(entity: DataFrame, roots: DataFrame) -> DataFrame:
    """Mentions of canonical entities, those merged into them included."""
    rows = entity.join(roots, entity["entity_id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "entity_id"))
    return rows.groupBy("root").agg(F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("forms"))
