"""A report: elements of each allegation, evidence routed to it, a drafted section, and the disposition that its table entails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import elements, report, routing, scoring
from ..sources.models import TextModel, apply_model

LABELS = {"affirmative": "Substantiated", "negative": "Not substantiated"}


def generate(allegations: DataFrame, facts: DataFrame, documents: DataFrame, model: TextModel) -> DataFrame:
    """ref, allegation, body, disposition, corrected, unsettled, unweighed and stray for each allegation (ref, allegation).

    facts: doc_id, page_num, quote, predicate, event_date, refs and unrestricted; documents: doc_id, filename, page_count. The model is
    asked twice for each allegation: for its elements without any evidence, and for the section with what is routed to it. Element
    verdicts are corrected by the record's own arithmetic, and the disposition follows from them."""
    asked = allegations.withColumn("_p", F.concat(F.lit("Decompose into elements:\n"), F.col("allegation")))
    replies = apply_model(asked, "_p", model.generate, "reply", "string").drop("_p", "reply_error")
    plan = elements.decompose(replies, "ref", "reply", "allegation")
    routed = routing.route(facts, allegations.select(F.col("ref").alias("target")))
    line = F.format_string("- %s [%s p.%d]", F.col("quote"), F.col("doc_id"), F.col("page_num").cast("int"))
    evidence = report.context_block(routed.withColumn("ref", F.col("target")), "ref", line, ["doc_id", "page_num", "quote"])
    wanted = report.context_block(plan, "ref", F.format_string("E%d: %s", F.col("element"), F.col("proposition")), ["element"]).withColumnRenamed("block", "plan")
    prompts = allegations.join(wanted, "ref").join(evidence, "ref", "left")
    prompts = prompts.withColumn("_p", F.concat_ws("\n", F.lit("Weigh each element:"), "allegation", "plan", F.coalesce("block", F.lit("(no evidence)"))))
    drafts = apply_model(prompts.select("ref", "allegation", "_p"), "_p", model.generate, "section", "string").drop("_p", "section_error")
    drafts = scoring.without_circular(drafts.withColumn("section", F.coalesce("section", F.lit(""))), "section")
    rows = elements.block_rows(drafts, "ref", "section")
    cites = report.citations(rows.select(F.struct("ref", "element", "at").alias("row"), F.transform("cites", lambda c: F.concat(F.lit("["), c, F.lit("]"))).alias("c")).select("row", F.array_join("c", " ").alias("c")), "row", "c")
    docs = documents.select(F.lower("doc_id").alias("_n"), F.col("doc_id").alias("_d"))
    named = cites.join(docs, F.lower("name") == F.col("_n"), "left")
    held = named.groupBy("row").agg(F.count(F.lit(1)).alias("cited"), F.count("_d").alias("grounded")).select("row.*", "cited", "grounded")
    on_pages = named.where("_d is not null").join(facts.select(F.col("doc_id").alias("_d"), F.col("page_num").cast("int").alias("page"), "event_date"), ["_d", "page"])
    dated = on_pages.where("coalesce(event_date, '') <> ''").groupBy(F.col("row.ref").alias("ref"), F.col("row.element").alias("element")).agg(F.collect_set(C.day_key(F.col("event_date"))).alias("dates"))
    full = rows.join(held, ["ref", "element", "at"], "left").na.fill(0, ["cited", "grounded"])
    verdicts = elements.correct(full, "ref", plan.select("ref", "element", "repeats"), dated)
    stray = rows.join(plan.select("ref", "element"), ["ref", "element"], "left_anti").select("ref", "element", F.lit(None).cast("boolean").alias("met"))
    written = drafts.select("ref", F.regexp_extract(F.regexp_replace("section", r"[*_`~]+", ""), r"(?im)^[ \t>#-]*Disposition[ \t]*[:–—-]+[ \t]*(.+?)[ \t]*$", 1).alias("disposition"))
    settled = elements.settle(written, verdicts.select("ref", "element", "met").unionByName(stray), plan, "ref")
    label = F.when(F.col("disposition") == "affirmative", LABELS["affirmative"]).otherwise(LABELS["negative"])
    notes = verdicts.where("reason is not null").groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "reason"))), lambda x: F.format_string("*E%d: %s*", x["element"], x["reason"])), "\n").alias("_notes"))
    out = drafts.join(settled, "ref").join(notes, "ref", "left")
    text = F.regexp_replace("section", r"(?im)^[ \t>#*_-]*Disposition[ *_\t]*[:–—-]+[^\n]*\n?", "")
    body = F.concat_ws("\n\n", F.format_string("#### Allegation %s: %s", F.col("ref").cast("string"), F.col("allegation")), F.nullif(F.trim(text), F.lit("")), "_notes", F.concat(F.lit("**Disposition:** "), label), F.when(F.col("unsettled"), "*Unsettled: operator review required.*"))
    return out.select("ref", "allegation", body.alias("body"), "disposition", "corrected", "unsettled", "unweighed", "stray")
