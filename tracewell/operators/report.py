"""Checks of a drafted report: citations, element tables, dispositions, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

SECONDHAND = r"(?i)\b(told (me|him|her|us|them)|heard (that|from)|according to|said that)\b"
MOST_PAGES = 40


def citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, name and page of every cited page; ranges are spelt out, absurd ones give their first page."""
    found = texts.select(key, F.explode(C.cited_pages(F.col(text))).alias("cite"))
    name, first, last = (F.regexp_extract("cite", r"^(.*?),? pp?\.? ?(\d+)(?:-(\d+))?$", k) for k in (1, 2, 3))
    first, last = first.cast("int"), F.coalesce(last.try_cast("int"), first.cast("int"))
    end = F.when(last.between(first, first + MOST_PAGES - 1), last).otherwise(first)
    return found.select(key, name.alias("name"), F.explode(F.sequence(first, end)).alias("page"))


def grounded(cites: DataFrame, documents: DataFrame) -> DataFrame:
    """cites with known: whether a document has that name and page."""
    docs = documents.select(F.lower("name").alias("_n"), "page_count")
    return cites.join(docs, F.lower(cites["name"]) == docs["_n"], "left").withColumn("known", F.coalesce(F.col("page").between(1, F.col("page_count")), F.lit(False))).drop("_n", "page_count")


def secondhand(facts: DataFrame) -> DataFrame:
    """Facts told by others, one of each quote."""
    return facts.where(F.col("quote").rlike(SECONDHAND)).withColumn("_q", C.flat(F.col("quote"))).dropDuplicates(["_q"]).drop("_q")


def element_rows(body: DataFrame, key: str, text: str) -> DataFrame:
    """key, element, met and instances of each line "Element n: Met|Not met ... "; the last line of an element counts."""
    lines = body.select(key, F.posexplode(F.split(text, r"\n")).alias("_at", "line"))
    head = r"(?i)^\W*element\s+(\d+)\W+(.*)$"
    rows = lines.where(F.col("line").rlike(head)).withColumn("element", F.regexp_extract("line", head, 1).cast("int")).withColumn("_rest", F.regexp_extract("line", head, 2))
    met = F.when(F.col("_rest").rlike(r"(?i)\bnot met\b|\bno\b"), False).when(F.col("_rest").rlike(r"(?i)\bmet\b|\byes\b"), True)
    numbers = F.transform(F.regexp_extract_all("_rest", F.lit(r"\b(\d{1,3}) (?:instances|occasions|times)"), F.lit(1)), lambda x: x.cast("int"))
    more = F.col("_rest").rlike(r"(?i)\bmore than \d").cast("int")
    return rows.groupBy(key, "element").agg(F.max(F.struct("_at", met.alias("met"), (F.array_max(numbers) + more).alias("instances"))).alias("x")).select(key, "element", "x.met", "x.instances")


def required_disposition(elements: DataFrame, key: str, planned: DataFrame) -> DataFrame:
    """key and disposition: negative if an element is not met, affirmative if all planned are met, else undetermined.

    elements: key, element, met; repeated elements that disagree count as not weighed."""
    one = elements.groupBy(key, "element").agg(F.bool_and("met").alias("all_met"), F.bool_or("met").alias("any_met"))
    one = one.join(planned, [key, "element"], "left_semi").where("all_met = any_met")
    n = planned.groupBy(key).agg(F.count_distinct("element").alias("planned"))
    seen = one.groupBy(key).agg(F.count(F.lit(1)).alias("weighed"), F.bool_and("all_met").alias("met"))
    label = F.when(~F.col("met"), "negative").when(F.col("weighed") == F.col("planned"), "affirmative").otherwise("undetermined")
    return n.join(seen, key, "left").select(key, F.coalesce(label, F.lit("undetermined")).alias("disposition"))


def filter_conflicts(conflicts: DataFrame, group: str) -> DataFrame:
    """Conflicts of different pages that say what is incompatible; a group that would lose all keeps all."""
    fine = (F.col("page_a") != F.col("page_b")) & (F.coalesce(F.trim("incompatible"), F.lit("")) != "")
    kept = conflicts.groupBy(group).agg(F.count_if(fine).alias("_kept"))
    return conflicts.withColumn("_fine", fine).join(kept, group).where("_fine or _kept = 0").drop("_fine", "_kept")


def foreign_findings(findings: DataFrame, facts: DataFrame, share: float = 0.6) -> DataFrame:
    """finding_id and ref whose facts hold most of a finding's long words: where a finding belongs.

    Words meet by equality; the share is of a finding's distinct words of five letters or more."""
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) >= 5))).alias("w"))
    own = words(findings, "finding_id", "text")
    n = own.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"))
    theirs = words(facts, "ref", "quote").distinct()
    hits = own.join(theirs, "w").groupBy("finding_id", "ref").agg(F.count(F.lit(1)).alias("hits")).join(n, "finding_id")
    return hits.where((F.col("n") >= 5) & (F.col("hits") >= share * F.col("n"))).select("finding_id", "ref", "hits", "n")


def other_allegation(findings: DataFrame, allegations: DataFrame, margin: float = 1.5, least: int = 2) -> DataFrame:
    """finding_id and belongs of findings (finding_id, ref, text) that another allegation (ref, allegation) tells better than their own:
    it has at least two of the finding's long words (five are needed, brackets aside, repeats counted), and as many times more of
    them than its own as the margin says. Words meet by equality; of equal ones the last allegation counts."""
    bare = F.regexp_replace(F.lower(F.regexp_replace("text", r"\[[^\]]*\]", " ")), r"[.,;:()\"']+(?=\s|$)|(?<=\s|^)[.,;:()\"']+", "")
    long = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 4)
    own = findings.select("finding_id", "ref", F.posexplode(long(bare)).alias("_at", "w"))
    sizes = own.groupBy("finding_id", "ref").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    told = F.regexp_replace(F.lower("allegation"), r"[.,;:()\"']+(?=\s|$)|(?<=\s|^)[.,;:()\"']+", "")
    terms = allegations.select(F.col("ref").alias("_other"), F.explode(F.array_distinct(long(told))).alias("w"))
    hits = own.join(terms, "w").groupBy("finding_id", "ref", "_other").agg(F.count(F.lit(1)).alias("hits")).join(sizes, ["finding_id", "ref"])
    best = hits.groupBy("finding_id", "ref").agg(F.max(F.struct("hits", "_other")).alias("b"), F.max(F.when(F.col("_other") == F.col("ref"), F.col("hits")).otherwise(0)).alias("mine"))
    fine = (F.col("b._other") != F.col("ref")) & (F.col("b.hits") >= least) & (F.col("b.hits") >= margin * F.col("mine"))
    return best.where(fine).select("finding_id", F.col("b._other").alias("belongs"))


def entities_block(mentions: DataFrame, limit: int = 40) -> DataFrame:
    """entity_type, name, files and mentions of the entities that are mentioned most, ties by name."""
    return mentions.groupBy("entity_type", "name").agg(F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "name").limit(limit)


def context_block(rows: DataFrame, group: str, line, order: list[str]) -> DataFrame:
    """group and block: formatted lines in order."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n").alias("block"))
