"""Who speaks in a document, whom an objective means, and which documents belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions.kernels import RANKS, SUFFIXES, normalize_udf
from .entities import components

#: Labels of forms that introduce the person who speaks.
LABEL = r"(?im)^\s*(?:name|interviewee|witness|name of (?:person|witness))\s*[:\-]\s*(.{2,80}?)\s*$"
#: Characters of a document's first page that are searched for one.
HEAD = 2500
#: Words of objectives that name no one. Fixed values.
COMMON = tuple("the and for with from that this who what when where did was were not case report about".split())


def header_value(text, labels: tuple[str, ...]):
    """What a form's header writes against the first of the labels that has a value, behind it on its line or on the next; null for
    none. A column."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[*_~`]+", "")
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(bare, rf"(?mi)^[ \t>|#+•-]*\Q{label}\E[ \t]*(?:[:.|][ \t|]*|$\s*)([^\n|]*[^\s|][^\n]*)", 1), r"[\s|]+$", "")), F.lit("")) for label in labels]
    return F.coalesce(*found)


def proceeding_time(text):
    """When an interview or statement took place by its header: a day, or a day and a military time behind it; null for none."""
    value = header_value(text, rules.DATE_LABELS)
    day = rf"(?i)\b(\d{{1,2}})\s+({rules.MONTH})\w*\.?,?\s+(\d{{4}})\b"
    part = lambda k: F.regexp_extract(value, day, k)
    iso = F.concat_ws("-", part(3), C.month_number(part(2)), F.lpad(part(1), 2, "0"))
    rest = F.regexp_replace(value, rf"(?i)^.*?\b\d{{1,2}}\s+(?:{rules.MONTH})\w*\.?,?\s+\d{{4}}\b", "")
    hh, mm = (F.regexp_extract(rest, r"\b([01]\d|2[0-3])([0-5]\d)\b", k) for k in (1, 2))
    return F.when(part(1) != "", F.when(hh != "", F.concat(iso, F.lit("T"), hh, F.lit(":"), mm)).otherwise(iso))


def interviewee(pages: DataFrame) -> DataFrame:
    """doc_id and name as the form on the first page gives it."""
    name = F.regexp_extract(F.substring("text", 1, HEAD), LABEL, 1)
    return pages.where("page_num = 1").select("doc_id", name.alias("name")).where("name <> ''")


def speakers(pages: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id and entity_id of the one person of the roster (entity_id, label) whose tokens hold the form's name, its last
    word included; of several that hold it, one whose tokens hold all the others' counts, else none does."""
    said = interviewee(pages).withColumn("_t", F.split(normalize_udf("name"), " "))
    roster = people.select("entity_id", F.split(normalize_udf("label"), " ").alias("_p"))
    # they meet by the last word of the name
    met = said.withColumn("_last", F.element_at("_t", -1)).join(roster.withColumn("_last", F.explode("_p")), "_last")
    met = met.where(F.size(F.array_except("_t", "_p")) == 0).select("doc_id", "entity_id", "_p").distinct()
    most = met.groupBy("doc_id").agg(F.max_by("_p", F.size("_p")).alias("_big"), F.max_by("entity_id", F.size("_p")).alias("entity_id"), F.flatten(F.collect_set("_p")).alias("_all"))
    return most.where(F.size(F.array_except("_all", "_big")) == 0).select("doc_id", "entity_id")


def objective_people(objective: str, people: DataFrame) -> DataFrame:
    """People (entity_id, label) with a name of three letters or more among the objective's words."""
    import re

    words = sorted({w for w in re.findall(r"\w{3,}", objective.lower()) if w not in COMMON and w not in RANKS and w not in SUFFIXES})
    tokens = F.split(normalize_udf("label"), " ")
    return people.where(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words or [""]])))


def document_groups(mentions: DataFrame) -> DataFrame:
    """doc_id, grp and size: documents (doc_id, entity_id) that a chain of shared people connects."""
    edges = mentions.select(F.concat(F.lit("d:"), "doc_id").alias("a"), F.concat(F.lit("p:"), "entity_id").alias("b")).distinct()
    found = components(edges).where(F.col("node").startswith("d:")).select(F.expr("substring(node, 3)").alias("doc_id"), F.col("component").alias("grp"))
    return found.join(found.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp").select("doc_id", "grp", "size")


def objective_match(mentions: DataFrame, people: DataFrame, objective: str) -> DataFrame:
    """doc_id, standing and named: whether a document is in the largest group of documents, of another group (foreign) or
    alone (isolated), and whether it mentions a person of the objective."""
    groups = document_groups(mentions)
    largest = groups.agg(F.max(F.struct("size", "grp")).alias("m")).select("m.*")
    named = mentions.join(objective_people(objective, people), "entity_id", "left_semi").select("doc_id").distinct().withColumn("named", F.lit(True))
    standing = F.when(F.col("g.grp") == F.col("l.grp"), "main").when(F.col("g.size") > 1, "foreign").otherwise("isolated")
    rows = groups.alias("g").join(F.broadcast(largest).alias("l"), F.lit(True))  # one row
    return rows.select("g.doc_id", standing.alias("standing")).join(named, "doc_id", "left").na.fill(False, ["named"])
