"""Evidence tables derived from the star schema, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What workers get at a time, unless the session sets it: rows of any number may be of any size.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH_BYTES[0]) == "67108864b":  # as it comes
        spark.conf.set(*BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(df: DataFrame, *values) -> DataFrame:
    names = ("doc_id", "page_num", "subject_type", "subject_name", "predicate", "object_type", "object_name", "event_date", "allegation_ref")
    out = df.select(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    quote = F.concat_ws(" ", "subject_name", "predicate", "object_name")
    return out.withColumn("quote", quote).withColumn("triple_id", F.concat_ws("|", "doc_id", F.col("page_num").cast("string"), "subject_name", "predicate", "object_name", F.coalesce("event_date", F.lit(""))))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers placing orders, suppliers supplying lines, and who is based where."""
    orders, customer, nation, region, line, supplier = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region", "lineitem", "supplier"))
    none, day = F.lit(None).cast("string"), lambda c: F.col(c).cast("date").cast("string")
    ref = lambda c: F.when(F.col(c) % 4 > 0, (F.col(c) % 4).cast("string"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    placed = _row(orders.join(customer, orders["o_custkey"] == customer["c_custkey"]), F.concat(F.lit("orders-"), (F.col("o_orderkey") % 50).cast("string")), F.col("o_orderkey") % 7, F.lit("PERSON"), F.col("c_name"), F.lit("placed"), F.lit("DOCUMENT"), text("order ", "o_orderkey"), day("o_orderdate"), ref("o_orderkey"))
    supplied = _row(line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]), F.concat(F.lit("lines-"), (F.col("l_orderkey") % 50).cast("string")), F.col("l_linenumber").cast("long"), F.lit("ORG"), F.col("s_name"), F.lit("supplied"), F.lit("DOCUMENT"), text("order ", "l_orderkey"), day("l_shipdate"), ref("l_orderkey"))
    based = _row(customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]), F.concat(F.lit("people-"), (F.col("c_custkey") % 50).cast("string")), F.col("c_custkey") % 7, F.lit("PERSON"), F.col("c_name"), F.lit("based in"), F.lit("LOCATION"), F.col("n_name"), none, none)
    located = _row(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]), F.lit("atlas"), F.col("n_nationkey").cast("long"), F.lit("LOCATION"), F.col("n_name"), F.lit("located in"), F.lit("LOCATION"), F.col("r_name"), none, none)
    return placed.unionByName(supplied).unionByName(based).unionByName(located)


TRIPLES_SQL = """raw AS (
  SELECT 'orders-' || (o_orderkey % 50) AS doc_id, o_orderkey % 7 AS page_num, 'PERSON' AS subject_type, c_name AS subject_name, 'placed' AS predicate, 'DOCUMENT' AS object_type,
    'order ' || o_orderkey AS object_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS VARCHAR) END AS allegation_ref
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'lines-' || (l_orderkey % 50), CAST(l_linenumber AS BIGINT), 'ORG', s_name, 'supplied', 'DOCUMENT', 'order ' || l_orderkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR),
    CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_orderkey % 4 AS VARCHAR) END FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'people-' || (c_custkey % 50), c_custkey % 7, 'PERSON', c_name, 'based in', 'LOCATION', n_name, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'atlas', CAST(n_nationkey AS BIGINT), 'LOCATION', n_name, 'located in', 'LOCATION', r_name, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey),
triples AS (SELECT *, subject_name || ' ' || predicate || ' ' || object_name AS quote,
  doc_id || '|' || page_num || '|' || subject_name || '|' || predicate || '|' || object_name || '|' || coalesce(event_date, '') AS triple_id FROM raw),
ids AS (SELECT *, subject_type || ':' || lower(trim(regexp_replace(subject_name, '\\s+', ' ', 'g'))) AS src, object_type || ':' || lower(trim(regexp_replace(object_name, '\\s+', ' ', 'g'))) AS dst FROM triples),
edges AS (SELECT DISTINCT ON (triple_id) triple_id, src, dst, predicate, event_date, doc_id, page_num, trim(regexp_replace(upper(predicate), '[^A-Z0-9]+', '_', 'g'), '_') AS rel FROM ids)"""
