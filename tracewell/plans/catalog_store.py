"""Queries over what is stored by versions: graphs by increments, indexes, seeded runs; and places in markup."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import stretches_udf
from ..operators import graph, vector_index
from ..operators.iterate import shared_dir
from ..sources.versions import Versions
from .catalog import WITH
from .evidence import load, triples
from .registry import query
from .runs import Runs


def store(spark: SparkSession, name: str) -> Versions:
    return Versions(spark, f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}")


@query(WITH + """SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1""")
def graph_increments(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees in a graph that was stored in three increments, the last of which has much that was there."""
    kept, rows = store(spark, "graph"), triples(spark, sf)
    share = F.pmod(F.xxhash64("triple_id"), F.lit(100))
    for part in (share < 60, (share >= 60) & (share < 99), share >= 50):
        graph.sink(kept, rows.where(part), buckets=8)
    edge, vertex = kept.read("edges"), kept.read("vertices")
    return graph.degrees(edge).join(vertex.select("entity_id"), "entity_id")


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), lambda p: p[1] * p[2])), 4) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty nearest to a vector by a stored index, a third of which was added later."""
    kept, e = store(spark, "index"), load(spark, sf, "embeddings")
    vector_index.build(kept, e.where("vec_id % 3 < 2"), "vec_id", "embedding", "m")
    vector_index.add(kept, e, "vec_id", "embedding", "m")
    asked = e.orderBy("vec_id").select("embedding").first()[0]
    found, _ = vector_index.search(kept, list(asked), 20)
    return found.withColumnRenamed("key", "vec_id")


@query("""WITH p AS (SELECT page_id, regexp_split_to_array(html, '<[^>]*>') AS t, regexp_extract_all(html, '<[^>]*>') AS m FROM pages),
s AS (SELECT page_id, unnest(t) AS t, unnest(list_prepend('', m)) AS m, generate_subscripts(t, 1) AS i FROM p),
c AS (SELECT page_id, length(t) AS n, sum(length(t)) OVER w - length(t) AS plain, sum(length(t) + length(m)) OVER w - length(t) AS raw FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i))
SELECT page_id, CAST(plain AS BIGINT) AS plain, CAST(raw AS BIGINT) AS raw, n AS "length" FROM c WHERE n > 0""")
def markup_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Where each stretch of a page's text stands, without its markup and with it."""
    return load(spark, sf, "pages").select("page_id", F.inline(stretches_udf("html")))


@query("""SELECT run, CAST(o_custkey % (run + 2) AS INTEGER) AS band, count(*) AS n FROM orders, (SELECT unnest([0, 1, 2]) AS run) GROUP BY 1, 2""")
def seeded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs side by side, each with its own banding of orders."""
    orders = load(spark, sf, "orders")
    return Runs(store(spark, "runs"), "bands", 3, lambda seed: orders.groupBy((F.col("o_custkey") % (seed + 2)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))).run()
