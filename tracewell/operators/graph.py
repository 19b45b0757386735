"""The property graph as vertices and edges, and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.versions import Versions
from .iterate import materialize


def mentions(triples: DataFrame) -> DataFrame:
    """A row for each subject and object: entity_type, name and the triple's columns."""
    sides = F.inline(F.array(F.struct(F.col("subject_type").alias("entity_type"), F.col("subject_name").alias("name")), F.struct(F.col("object_type").alias("entity_type"), F.col("object_name").alias("name"))))
    return triples.select("triple_id", "doc_id", "page_num", "event_date", sides)


def entity_id(kind, name):
    return F.concat_ws(":", kind, C.flat(name))


def edges(triples: DataFrame) -> DataFrame:
    """src, dst, rel and the triple's evidence, one for each triple id."""
    rows = triples.select("triple_id", entity_id(F.col("subject_type"), F.col("subject_name")).alias("src"), entity_id(F.col("object_type"), F.col("object_name")).alias("dst"), C.rel_type(F.col("predicate")).alias("rel"), "predicate", "event_date", "doc_id", "page_num")
    # keys of 16 bytes, whatever ids are: what is compared and sorted is short
    keyed = rows.withColumns({"_h": F.xxhash64("triple_id"), "_g": F.xxhash64(F.lit(1), "triple_id")})
    return keyed.dropDuplicates(["_h", "_g"]).drop("_h", "_g")


def degrees(edge: DataFrame) -> DataFrame:
    """entity_id and degree over edges with evidence; an edge to itself counts at both ends."""
    ends = edge.where("triple_id is not null").select(F.inline(F.array(F.struct(F.col("src").alias("entity_id")), F.struct(F.col("dst").alias("entity_id")))))
    return ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def snapshot(edge: DataFrame, limit: int) -> DataFrame:
    """The vertices of highest degree (ties: by id); a top-k, so no full sort."""
    return degrees(edge).orderBy(F.desc("degree"), "entity_id").limit(limit)


def hashed_edges(triples: DataFrame) -> DataFrame:
    """The two ends of each triple id's edge as 64-bit hashes, src and dst: all that degrees need, in numbers alone. Of rows with one
    id, which end counts is not said, as in edges()."""
    ends = [entity_id(F.col(f"{side}_type"), F.col(f"{side}_name")) for side in ("subject", "object")]
    rows = triples.where("triple_id is not null").select(F.xxhash64("triple_id").alias("_h"), F.xxhash64(F.lit(1), "triple_id").alias("_g"), F.xxhash64(ends[0]).alias("src"), F.xxhash64(ends[1]).alias("dst"))
    return rows.groupBy("_h", "_g").agg(F.min("src").alias("src"), F.min("dst").alias("dst")).select("src", "dst")


def top_vertices(triples: DataFrame, limit: int) -> DataFrame:
    """entity_id and degree as snapshot() gives them for the edges of triples. Degrees are counted on hashes; names are looked up
    for those vertices alone whose degree reaches the last that counts."""
    ends = hashed_edges(triples).select(F.explode(F.array("src", "dst")).alias("_v"))
    counts = materialize(ends.groupBy("_v").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    least = counts.orderBy(F.desc("degree")).limit(limit).agg(F.min("degree")).first()[0] or 0
    best = counts.where(F.col("degree") >= least)
    names = triples.select(F.explode(F.array(*[entity_id(F.col(f"{side}_type"), F.col(f"{side}_name")) for side in ("subject", "object")])).alias("entity_id"))
    named = names.withColumn("_v", F.xxhash64("entity_id")).join(best, "_v").groupBy("entity_id", "degree").agg(F.lit(1)).select("entity_id", "degree")
    return named.orderBy(F.desc("degree"), "entity_id").limit(limit)


def snapshot_edges(edge: DataFrame, top: DataFrame) -> DataFrame:
    """Edges with both ends in top, which is bounded by its limit."""
    keep = F.broadcast(top.select("entity_id"))
    return edge.join(keep.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def edges_within(triples: DataFrame, top: DataFrame) -> DataFrame:
    """edges() of triples with both ends in top, which is bounded by its limit: rows are let through before they are shuffled."""
    keep = F.broadcast(top.select("entity_id"))
    ends = [entity_id(F.col(f"{side}_type"), F.col(f"{side}_name")) for side in ("subject", "object")]
    rows = triples.where("triple_id is not null").withColumns({"src": ends[0], "dst": ends[1]})
    met = rows.join(keep.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return edges(met.select(triples.columns))


def entity_detail(edge: DataFrame, entity: str) -> DataFrame:
    """Edges at an entity with direction and other end, by date and predicate."""
    out = edge.where(F.col("src") == entity).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "predicate", "event_date", "doc_id", "page_num")
    into = edge.where((F.col("dst") == entity) & (F.col("src") != entity)).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "predicate", "event_date", "doc_id", "page_num")
    return out.unionByName(into).orderBy("event_date", "predicate", "other")


def timeline(triples: DataFrame) -> DataFrame:
    """Dated triples by date; text dates of any precision sort as they stand."""
    return triples.where("coalesce(event_date, '') <> ''").select("event_date", "subject_name", "predicate", "object_name", "doc_id", "page_num").orderBy("event_date")


def merged_timeline(triples: DataFrame) -> DataFrame:
    """One row for each day, subject, predicate and object: its longest date, its sources and how many rows said it."""
    rows = triples.where("coalesce(event_date, '') <> ''")
    key = [C.day_key(F.col("event_date")).alias("day"), F.lower("subject_name").alias("subject"), F.lower(F.trim("predicate")).alias("predicate"), F.lower("object_name").alias("object")]
    return rows.groupBy(*key).agg(F.max_by("event_date", F.struct(F.length("event_date"), "event_date")).alias("event_date"), F.count(F.lit(1)).alias("said"), F.size(F.collect_set(F.struct("doc_id", "page_num"))).cast("long").alias("sources"))


def visible(vertices: DataFrame, edge: DataFrame, kinds: list[str], term: str) -> DataFrame:
    """Edges whose ends are both of the kinds and, with a term, both named by it."""
    fine = vertices.where(F.col("entity_type").isin(kinds) & F.contains(F.lower("name"), F.lit(term.lower()))).select("entity_id")
    return edge.join(fine.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(fine.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def tally(vertices: DataFrame) -> DataFrame:
    """kind and n of the types of entities, the most frequent first."""
    return vertices.groupBy(F.col("entity_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def focus(edge: DataFrame, entity: str) -> DataFrame:
    """entity_id of an entity and of all that an edge joins to it."""
    here = edge.where((F.col("src") == entity) | (F.col("dst") == entity))
    return here.select(F.inline(F.array(F.struct(F.col("src").alias("entity_id")), F.struct(F.col("dst").alias("entity_id"))))).distinct()


def inferred_top(links: DataFrame, limit: int = 2000) -> DataFrame:
    """Links of highest confidence."""
    return links.where("relation <> ''").orderBy(F.desc("confidence"), "a_id", "b_id").limit(limit)


def draw(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """src, dst and relation of links with both ends in the graph; directed ones start at their subject."""
    known = vertices.select("entity_id")
    both = links.join(known.withColumnRenamed("entity_id", "a_id"), "a_id", "left_semi").join(known.withColumnRenamed("entity_id", "b_id"), "b_id", "left_semi")
    swap = F.coalesce(F.col("subject_id") == F.col("b_id"), F.lit(False))
    return both.select(F.when(swap, F.col("b_id")).otherwise(F.col("a_id")).alias("src"), F.when(swap, F.col("a_id")).otherwise(F.col("b_id")).alias("dst"), "relation", "confidence")


def lost(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row, drawn and lost: how many links have both ends in the graph, and how many don't."""
    known = vertices.select(F.col("entity_id").alias("a_id"), F.lit(1).alias("_a"))
    both = links.join(known, "a_id", "left").join(known.toDF("b_id", "_b"), "b_id", "left")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count_if(whole).alias("drawn"), F.count_if(~whole).alias("lost"))


def load(triples: DataFrame, vertices: DataFrame, edge: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices and edges with those of triples that were never loaded, and triples with loaded_at set; what is there stays."""
    fresh = triples.where(F.col("loaded_at").isNull())
    new = edges(fresh).join(edge.select("triple_id"), "triple_id", "left_anti")
    ends = mentions(fresh).select(entity_id(F.col("entity_type"), F.col("name")).alias("entity_id"), "entity_type", "name")
    first = ends.groupBy("entity_id").agg(F.min(F.struct("entity_type", "name")).alias("v")).select("entity_id", "v.*").join(vertices.select("entity_id"), "entity_id", "left_anti")
    marked = triples.withColumn("loaded_at", F.coalesce("loaded_at", F.lit(now)))
    return vertices.unionByName(first.select(vertices.columns)), edge.unionByName(new.select(edge.columns)), marked


#: Least buckets of a stored graph's tables, and triples of the first increment for each: more triples, more buckets.
BUCKETS, BUCKET_ROWS = 64, 1 << 20


def known(parts: list[DataFrame], new: DataFrame, key: str) -> DataFrame | None:
    """Keys of new that a stored table (its parts) has. What is stored is read by its key alone and, being in buckets of it, isn't
    shuffled; a few new keys are broadcast by Spark, many are dealt to the buckets."""
    keys = new.select(key).distinct()
    found = [p.select(key).join(keys, key, "left_semi") for p in parts]
    out = None
    for f in found:
        out = f if out is None else out.union(f)
    return out


def sink(store: Versions, triples: DataFrame, buckets: int = BUCKETS) -> int:
    """Add the vertices and edges of triples that the stored graph (tables vertices and edges) lacks, both in one version: only they
    are written, whatever is there, and they are shuffled once. triples should be cheap to read twice or three times. The number of the version. Triples that were loaded before change nothing."""
    held = store.manifest()
    there = held.get("edges", {}).get("buckets")
    n = there[1] if there else buckets * max(1, -(-triples.count() // (buckets * BUCKET_ROWS)))
    # rows move once, to their buckets: there they part with copies, meet what is stored and are written
    rows = triples.select("triple_id", entity_id(F.col("subject_type"), F.col("subject_name")).alias("src"), entity_id(F.col("object_type"), F.col("object_name")).alias("dst"), "predicate", "event_date", "doc_id", "page_num")
    new = rows.repartition(n, "triple_id").dropDuplicates(["triple_id"])
    # types and names are told apart by hashing first: a minimum of texts would sort all mentions
    ends = mentions(triples).select(entity_id(F.col("entity_type"), F.col("name")).alias("entity_id"), "entity_type", "name").distinct()
    there = held.get("vertices", {}).get("buckets")
    n_ends = there[1] if there else n
    ends = ends.repartition(n_ends, "entity_id").groupBy("entity_id").agg(F.min(F.struct("entity_type", "name")).alias("v")).select("entity_id", "v.*")
    fresh = {}
    for name, part, key in (("edges", new, "triple_id"), ("vertices", ends, "entity_id")):
        for stored in store.parts(name, held):
            part = part.join(stored.select(key).hint("merge"), key, "left_anti")
        fresh[name] = part
    fresh["edges"] = fresh["edges"].select("triple_id", "src", "dst", C.rel_type(F.col("predicate")).alias("rel"), "predicate", "event_date", "doc_id", "page_num")
    return store.commit(append=fresh, buckets={"edges": ("triple_id", n), "vertices": ("entity_id", n_ends)}, dealt=set(fresh))


def inferred_only(edge: DataFrame, links: DataFrame) -> DataFrame:
    """Vertices that only inferred links touch."""
    stated = edge.select(F.col("src").alias("entity_id")).union(edge.select("dst"))
    touched = links.select(F.col("a_id").alias("entity_id")).union(links.select("b_id")).distinct()
    return touched.join(stated, "entity_id", "left_anti")


def rank_context(facts: DataFrame, limit: int, *partition: str) -> DataFrame:
    """The first facts of each group by date and id."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(F.asc_nulls_last("event_date"), "triple_id"))
    return facts.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")
