"""What an operator asks of the store: lists, scopes, names, sets, reasons; each is one plan of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

#: What a purge of each scope empties, and the words that confirm it.
SCOPES = {"evidence": ("pages", "triples", "entities", "chunks", "entity_links"), "links": ("entity_links",), "reports": ("reports",), "all": ("documents", "pages", "triples", "entities", "chunks", "entity_links", "reports")}
CONFIRM = "delete everything"
#: Rows of a dimension that is broadcast; a larger one is joined by shuffling.
MOST_BROADCAST = 1_000_000


def scan(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """The rows of a statement over the tables; :name stands for an argument, never for text of the statement."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)


def document_list(documents: DataFrame) -> DataFrame:
    """Documents as they were uploaded, the last first."""
    return documents.orderBy(F.desc_nulls_last("uploaded_at"), "doc_id")


def document_detail(documents: DataFrame, pages: DataFrame, doc_id: str) -> DataFrame:
    """One document's row with its pages in order."""
    of = pages.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("pages"))
    return documents.where(F.col("doc_id") == doc_id).join(of, "doc_id", "left")


def purge(tables: dict[str, DataFrame], scope: str, confirm: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with those of the scope emptied, and table and removed for each; without the right words an error."""
    if confirm != CONFIRM:
        raise ValueError("the purge was not confirmed")
    gone = [t for t in SCOPES[scope] if t in tables]
    counts = None
    for t in gone:
        one = tables[t].agg(F.count(F.lit(1)).alias("removed")).select(F.lit(t).alias("table"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    return {t: df.limit(0) if t in gone else df for t, df in tables.items()}, counts


def save_report(reports: DataFrame, new: DataFrame) -> DataFrame:
    """reports with new ones; of one id the latest stays."""
    both = reports.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "report_id"]
    return both.groupBy("report_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("r")).select("report_id", "r.*").select(*both.columns)


def contributing(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id of every document that a passage or a fact comes from."""
    return passages.select("doc_id").union(facts.select("doc_id")).where("doc_id is not null").distinct()


def arrived_since(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id and reason of documents that the corpus gained after a report's snapshot."""
    late = documents.join(known.select("doc_id"), "doc_id", "left_anti")
    return late.select("doc_id", F.lit("ingested after the analysis began").alias("reason"))


def named(rows: DataFrame, dimension: DataFrame, key: str, name: str, otherwise: Column) -> DataFrame:
    """rows with the dimension's name of their key; where it has none, otherwise. The dimension is broadcast while it is small."""
    held = dimension.select(key, F.col(name).alias("_name"))
    small = held.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(held) if small else held, key, "left").withColumn(name, F.coalesce("_name", otherwise)).drop("_name")


def fallback(rows: DataFrame, levels: list[tuple[list[str], DataFrame]], value: str) -> DataFrame:
    """rows with value of the first level (keys, table) that has their keys: from the sharpest key to the widest."""
    out, found = rows, []
    for i, (keys, table) in enumerate(levels):
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}"), F.lit(True).alias(f"_has{i}")), keys, "left")
        found.append(F.when(F.col(f"_has{i}"), F.struct(F.col(f"_v{i}").alias("v"))))
    return out.withColumn(value, F.coalesce(*found)["v"]).select(*rows.columns, value)


def by_count(rows: DataFrame, kind: str) -> DataFrame:
    """kind and n, the most frequent first."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind)


def error_reasons(rows: DataFrame, column: str = "error") -> DataFrame:
    """reason: the distinct first lines of errors."""
    return rows.where(F.coalesce(F.trim(column), F.lit("")) != "").select(F.trim(F.split(F.trim(column), r"\n")[0]).alias("reason")).distinct()


def joined_distinct(rows: DataFrame, keys: list[str], value: str, out: str, separator: str = ", ") -> DataFrame:
    """keys and out: their distinct values in order, joined."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(out))


def entity_sets(mentions: DataFrame) -> DataFrame:
    """entity_id, docs, pages and days: the distinct documents, pages and days of an entity's mentions, in order."""
    day = F.nullif(C.day_key(F.col("event_date")), F.lit(""))
    return mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"), F.array_sort(F.collect_set(F.struct("doc_id", "page_num"))).alias("pages"), F.array_sort(F.collect_set(day)).alias("days"))


def usable(entities: DataFrame, proposition: Callable[[Column], Column], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Entities that are worth comparing, and entity_type and skipped for claims that say nothing."""
    empty = (F.col("entity_type") == "CLAIM") & ~F.coalesce(proposition(F.col(name)), F.lit(False))
    return entities.where(~empty), entities.where(empty).groupBy("entity_type").agg(F.count(F.lit(1)).alias("skipped"))


def pooled(candidates: DataFrame, group: str) -> DataFrame:
    """The candidates (group, draw, place, text) of several draws without repeats, numbered in order: two are the same if the first
    90 characters of what they quote first (of what they say, if they quote nothing) are, white space and case aside."""
    from pyspark.sql import Window

    quote = F.regexp_extract("text", "[\"“]([^\"”]{3,})[\"”]", 1)
    print_of = F.substring(C.flat(F.when(quote != "", quote).otherwise(F.regexp_replace("text", r"^\s*\d+\.\s*", ""))), 1, 90)
    one = candidates.withColumn("_print", print_of).where("_print <> ''").groupBy(group, "_print").agg(F.min(F.struct("draw", "place", "text")).alias("m"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("m.draw", "m.place"))
    return one.select(group, n.alias("n"), F.trim(F.regexp_replace("m.text", r"^\s*\d+\.\s*", "")).alias("text"))
