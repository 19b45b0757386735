"""Scoring against a key: rules, facts, entities, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .needles import find

NEGATION = ("not", "no", "never", "denied", "denies", "didn't", "wasn't", "without")


def precision_recall(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp and fn of two sets of keys."""
    both = predicted.select(key).distinct().withColumn("p", F.lit(1)).join(gold.select(key).distinct().withColumn("g", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("p").isNotNull() & F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull() & F.col("g").isNotNull()).alias("fn"))


def contamination(needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str) -> DataFrame:
    """Ids of needles and the texts that hold them, as substrings, which a text may cut anywhere."""
    return find(needles, texts, needle_id, needle, text_id, text).select(needle_id, text_id).distinct()


def rules_hold(rows: DataFrame, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """rule, pattern and passed of each rule (kind, pattern, predicates that it is about or None) over assertions, in one pass. None
    holds without a row. A roster is the distinct names of people in both slots."""
    people = F.flatten(F.collect_set(F.array_compact(F.array(F.when(F.col("subject_type") == "PERSON", F.col("subject_name")), F.when(F.col("object_type") == "PERSON", F.col("object_name"))))))
    basis = F.col("event_date_basis") if "event_date_basis" in rows.columns else F.lit(None).cast("string")

    def passed(kind: str, pattern: str, where: str | None) -> Column:
        like = lambda c: F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
        scope = F.coalesce(F.col("predicate").rlike(f"(?i){where}"), F.lit(False)) if where else F.lit(True)
        roster = F.size(F.array_distinct(people))
        return {
            "forbid_entity": lambda: F.count_if(like("subject_name") | like("object_name")) == 0, "require_entity": lambda: F.count_if(like("subject_name") | like("object_name")) > 0,
            "forbid_predicate": lambda: F.count_if(like("predicate")) == 0, "require_predicate": lambda: F.count_if(like("predicate")) > 0,
            "forbid_date": lambda: F.count_if(scope & F.coalesce("event_date", F.lit("")).startswith(pattern)) == 0,
            "forbid_exact_stated_date": lambda: F.count_if(scope & (F.length("event_date") >= 10) & (basis == "stated")) == 0,
            "require_quote_substr": lambda: F.count_if(F.contains(F.lower("quote"), F.lit(pattern.lower()))) > 0,
            "entity_roster_max": lambda: roster <= int(pattern), "entity_roster_min": lambda: roster >= int(pattern),
        }[kind]()

    some = F.count(F.lit(1)) > 0
    each = [F.struct(F.lit(kind).alias("rule"), F.lit(pattern).alias("pattern"), (some & passed(kind, pattern, where)).alias("passed")) for kind, pattern, where in rules]
    return rows.agg(F.array(*each).alias("r")).select(F.inline("r"))


def fact_recall(gold: DataFrame, facts: DataFrame, first: int = 6) -> DataFrame:
    """fact_id, hits and recalled: of a gold fact's first long words, how many the best fact of its document holds."""
    words = F.slice(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) > 4), 1, first)
    g = gold.select("fact_id", F.substring("doc", 1, 12).alias("_doc"), words.alias("_w"))
    f = facts.select(F.substring("doc_id", 1, 12).alias("_doc"), F.lower(F.concat_ws(" ", "quote", "predicate", "object_name")).alias("_text"))
    hits = F.size(F.filter("_w", lambda w: F.contains(F.col("_text"), w)))
    best = g.join(f, "_doc", "left").groupBy("fact_id", F.size("_w").alias("n")).agg(F.max(F.coalesce(hits, F.lit(0))).alias("hits"))
    return best.select("fact_id", "hits", (F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))).alias("recalled"))


def opposes(a, b):
    """Whether two texts oppose: other numbers, other denied words, or less than 0.6 of the shorter's words shared."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\W+"), lambda w: F.length(w) > 3))
    numbers = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))))
    denied = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"\b(?:{'|'.join(NEGATION)}) (\w+)"), F.lit(1))))
    share = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.least(F.size(words(a)), F.size(words(b))), F.lit(1))
    return (numbers(a) != numbers(b)) | (denied(a) != denied(b)) | (share < 0.6)


def rare_weight(words: DataFrame, doc: str, word: str) -> DataFrame:
    """word and 1 / its documents."""
    return words.groupBy(word).agg((1 / F.count_distinct(doc)).alias("weight"))


def merge_graph_sound(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: entities, pointers to nothing, nodes on cycles, and whether the graph is a forest; an empty one is not."""
    ids = entities.select(F.col("entity_id").alias("merged_into"))
    dangling = entities.where("merged_into is not null").join(ids, "merged_into", "left_anti")
    loops = entities.alias("e").where("merged_into is not null").join(roots.alias("r"), F.col("e.entity_id") == F.col("r.node")).where("r.root = e.entity_id")
    total = entities.agg(F.count(F.lit(1)).alias("n"))
    row = total.join(dangling.agg(F.count(F.lit(1)).alias("dangling")), F.lit(True)).join(loops.agg(F.count(F.lit(1)).alias("cycles")), F.lit(True))
    return row.withColumn("sound", (F.col("n") > 0) & (F.col("dangling") == 0) & (F.col("cycles") == 0))
