"""Reports as lines: decoration, sections, lists and tables, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Text without marks of emphasis and code."""
    return F.trim(F.regexp_replace(text, r"\*\*|__|`|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w)", ""))


def undecorate(line: Column) -> Column:
    """A line without heading, quote, bullet, number and emphasis marks."""
    bare = F.regexp_replace(line, r"^\s*(?:>\s*)*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)?", "")
    return plain(bare)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, raw and line (undecorated) of every line."""
    rows = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n")).alias("at", "raw"))
    return rows.withColumn("line", undecorate(F.col("raw")))


def sections(texts: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """key, number, title and body of each section that a line matching `heading` (one group: its title) opens."""
    rows = lines(texts, key, text).withColumn("_title", F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, 1)))
    rows = rows.withColumn("number", F.count("_title").over(Window.partitionBy(key).orderBy("at"))).where("number > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_title").isNull(), F.struct("at", "raw")))), lambda x: x["raw"]), "\n")
    return rows.groupBy(key, "number").agg(F.max("_title").alias("title"), F.trim(body).alias("body"))


def items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, n and item of each bulleted or numbered item; lines that follow without a mark belong to it."""
    marked = F.col("raw").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+")
    rows = lines(texts, key, text).where("line <> ''").withColumn("n", F.sum(marked.cast("int")).over(Window.partitionBy(key).orderBy("at"))).where("n > 0")
    return rows.groupBy(key, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("item"))


def split_allegations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, n and allegation: items where there are any, else lines that say something."""
    found = items(texts, key, text).select(key, "n", F.col("item").alias("allegation"))
    rest = lines(texts, key, text).where("line <> ''").join(found.select(key).distinct(), key, "left_anti")
    n = F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long")
    return found.unionByName(rest.select(key, n.alias("n"), F.col("line").alias("allegation")))


def table_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, at and raw of the lines that are rows of tables; rules between header and body are left out."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n")).alias("at", "raw")).where(F.col("raw").rlike(r"^\s*\|.*\|\s*$") & ~F.col("raw").rlike(r"^[\s|:-]+$"))


def cells(raw: Column) -> Column:
    """The cells of a row of a table."""
    return F.transform(F.split(F.regexp_replace(raw, r"^\s*\||\|\s*$", ""), r"\|"), plain)


def table_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, at and cells of the rows of tables."""
    return table_lines(texts, key, text).select(key, "at", cells(F.col("raw")).alias("cells"))
