"""Grades of a report against a key: whether figures cite their document of record, and how each disposition was reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markdown
from .iterate import by_rows
from .needles import find
from .scoring import norm, words_of

#: How a report says what it weighed, and that nothing settled a disposition.
WEIGHED = r"(?i)\b(\d+)\s+of\s+(\d+)\s+element"
UNSETTLED = r"(?i)\bunsettled\b"
#: Words of a gold fact that tell it: the first so many that are longer than this; a third of them, two at least, must be found.
TELLING, LONGER = 6, 4
#: Reports, and allegations of keys, that a task sorts, however many there are.
REPORTS, ROWS = 50_000, 200_000


def traps(inventory: DataFrame, trap_id: str, text: str) -> DataFrame:
    """trap_id, primary (the document's key in the inventory's own form, numbers of two digits) and fact_ids of the traps (text) that
    name a primary source and facts."""
    source = F.regexp_extract(text, r"(?i)primary source is (?:doc(?:ument)?[\s#]*(?=[A-Za-z0-9]))?([A-Za-z0-9_]+)", 1)
    primary = F.when(source.rlike(r"^\d$"), F.lpad(source, 2, "0")).otherwise(source)
    facts = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(F\d{2})\b"), F.lit(1)))
    return inventory.select(trap_id, primary.alias("primary"), facts.alias("fact_ids")).where("primary <> '' and size(fact_ids) > 0")


def told_by(gold: DataFrame, facts: DataFrame, fact_id: str, text: str, blob: Column, doc: str = "doc_id") -> DataFrame:
    """fact_id and doc of documents one of whose facts (blob) tells a gold fact: enough of its words stand in it, as parts of words.
    Words are looked for by one pass over the facts, however many there are."""
    words = gold.select(fact_id, words_of(F.col(text), LONGER, TELLING).alias("_w")).distinct().withColumn("_n", F.size("_w")).where("_n > 0")
    rows = facts.select(F.col(doc), norm(blob).alias("_blob")).withColumn("_row", F.monotonically_increasing_id())
    hits = find(words.select(F.explode("_w").alias("word")).distinct(), rows.select(F.struct(doc, "_row").alias("_at"), "_blob"), "word", "word", "_at", "_blob")
    # repeated words of a gold fact count as often as it has them; texts of one fact id are held against a document each by itself
    own = words.select(fact_id, "_n", "_w", F.explode("_w").alias("word"))
    got = own.join(hits, "word").groupBy(fact_id, "_n", "_w", "_at").agg(F.count(F.lit(1)).alias("_k"))
    return got.where(F.col("_k") >= F.greatest(F.lit(2), F.floor(F.col("_n") / 3))).select(fact_id, F.col(f"_at.{doc}").alias(doc)).distinct()


def sourcing(inventory: DataFrame, gold: DataFrame, facts: DataFrame, trap_id: str = "trap_id", trap: str = "text") -> DataFrame:
    """trap_id, matched (facts of the trap that some document tells), cited (those documents) and cited_primary, whether the document
    of record is among them: its key begins their ids. A trap without a match is a gap in recall, not a fault of sourcing; gold:
    fact_id and text; facts: doc_id, quote and object_name."""
    asked = traps(inventory, trap_id, trap)
    found = told_by(gold, facts, "fact_id", "text", F.concat_ws(" ", "quote", "object_name"))
    each = asked.select(trap_id, "primary", F.explode("fact_ids").alias("fact_id")).join(found, "fact_id")
    held = each.groupBy(trap_id).agg(F.array_sort(F.collect_set("fact_id")).alias("matched"), F.array_sort(F.collect_set("doc_id")).alias("cited"), F.max(F.col("doc_id").startswith(F.concat("primary", F.lit("_")))).alias("_ok"))
    none = F.array().cast("array<string>")
    return asked.select(trap_id).join(held, trap_id, "left").select(trap_id, F.coalesce("matched", none).alias("matched"), F.coalesce("cited", none).alias("cited"), F.coalesce("_ok", F.lit(False)).alias("cited_primary"))


def summary_rows(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, verdict and basis of the rows of a report's first table of dispositions, by the columns that its header names; of
    a number that repeats the last row counts. Without such a header, all rows that begin with a number: the third cell and the rest."""
    # what is sorted is a line as it stands and what it is; cells are cut before and after
    rows = markdown.table_lines(by_rows(reports, REPORTS, key), key, text).withColumn("_low", F.transform(markdown.cells(F.col("raw")), lambda c: F.lower(F.trim(c))))
    at = lambda name: F.nullif(F.array_position(F.transform("_low", lambda c: c.startswith(name)), True), F.lit(0)).cast("int")
    number = F.col("_low")[0].rlike(r"^\d+$")
    rows = rows.select(key, "at", "raw", F.when(number, F.col("_low")[0].cast("int")).alias("number"), number.alias("_is"), F.when(~number, at("disposition")).alias("_v"), F.when(~number, at("basis")).alias("_b"))
    here = Window.partitionBy(key).orderBy("at")
    every = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a table ends where the next line is none of its rows
    island = F.col("at") - F.row_number().over(here)
    rows = rows.withColumns({"_head": F.first(F.when(F.col("_v").isNotNull(), F.struct("at", "_v", "_b")), ignorenulls=True).over(every), "_island": island})
    rows = rows.withColumn("_own", F.first(F.when(F.col("at") == F.col("_head.at"), F.col("_island")), ignorenulls=True).over(every))
    body = rows.where(F.col("_is") & (F.col("_head").isNull() | ((F.col("at") > F.col("_head.at")) & (F.col("_island") - F.col("_own") <= 1))))
    body = body.select(key, "at", "number", "_head", markdown.cells(F.col("raw")).alias("cells"))
    place = F.least(F.coalesce("_head._v", F.lit(3)), F.size("cells"))
    rest = F.array_join(F.filter(F.slice("cells", place + 1, F.size("cells")), lambda c: F.trim(c) != ""), " ")
    basis = F.coalesce(F.try_element_at("cells", F.col("_head._b").cast("int")), rest)
    found = body.select(key, "at", "number", F.trim(F.element_at("cells", place.cast("int"))).alias("verdict"), F.trim(basis).alias("basis"))
    return found.groupBy(key, "number").agg(F.max_by(F.struct("verdict", "basis"), "at").alias("x")).select(key, "number", "x.*")


def weighing(basis: Column) -> Column:
    """How a disposition was reached, as the report says: stated (whether it says so), weighed and planned elements, and why it is a
    default; null where it isn't one. The label itself is not looked at."""
    weighed, planned = (F.regexp_extract(basis, WEIGHED, k).try_cast("int") for k in (1, 2))
    why = F.when(basis.rlike(UNSETTLED), "marked unsettled").when((weighed == 0) & (planned > 0), F.concat(F.lit("0 of "), planned.cast("string"), F.lit(" weighed"))).when(weighed == 0, "nothing weighed")
    return F.struct((basis.rlike(UNSETTLED) | weighed.isNotNull()).alias("stated"), weighed.alias("weighed"), planned.alias("planned"), why.alias("why"))


def bare(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^A-Za-z]+", ""))


def graded(expected: DataFrame, findings: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """key, number, grade and consistent for each allegation of the key (expected: key, number, expected) and each row of a summary.

    grade: mislabelled, not weighed (a default, which earns nothing whichever label it fell back to), unverified (credited, but its
    report says of others how they were weighed and not of this) or credited; null for a number that the key lacks. findings: key,
    number, disposition and note (what the section says beside it). consistent: whether the summary's verdict and the section's
    are one, by their beginnings; null where the summary has no row."""
    rows = by_rows(expected, ROWS, key, "number").join(findings, [key, "number"], "left").join(summary, [key, "number"], "full")
    found, want, told = bare(F.col("disposition")), bare(F.col("expected")), bare(F.col("verdict"))
    agrees = (found != "") & (told != "") & (found.startswith(told) | told.startswith(found))
    # by key only what labels and reasons come to is sorted
    rows = rows.withColumn("_w", weighing(F.concat_ws(" ", "basis", "note")))
    rows = rows.select(key, "number", F.col("expected").isNotNull().alias("_known"), (found != want).alias("_off"), F.col("_w.stated").alias("_stated"), F.col("_w.why").isNotNull().alias("_default"), F.when(F.col("verdict").isNotNull(), agrees).alias("consistent"))
    stated = F.max(F.coalesce(F.col("_stated") & F.col("_known"), F.lit(False))).over(Window.partitionBy(key))
    grade = F.when(~F.col("_known"), None).when(F.col("_off"), "mislabelled").when(F.col("_default"), "not weighed").when(stated & ~F.col("_stated"), "unverified").otherwise("credited")
    return rows.select(key, "number", grade.alias("grade"), "consistent")


def passed(grades: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """key, credited, wanted and passed of each report: all allegations of the key credited and verified, as many sections as
    allegations, and no summary that says otherwise. sections: key and number of the sections that the report has."""
    counts = sections.groupBy(key).agg(F.count_distinct("number").alias("_s"))
    rows = grades.groupBy(key).agg(F.count("grade").alias("wanted"), F.count_if(F.col("grade").isin("credited", "unverified")).alias("credited"), F.count_if(F.col("grade") == "unverified").alias("_u"), F.count_if(~F.col("consistent")).alias("_m"))
    fine = (F.col("credited") == F.col("wanted")) & (F.col("_u") == 0) & (F.col("_m") == 0) & (F.coalesce("_s", F.lit(0)) == F.col("wanted"))
    return rows.join(counts, key, "left").select(key, "credited", "wanted", fine.alias("passed"))
