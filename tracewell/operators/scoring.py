"""Scores of facts and reports against a key: one row a measure, or the rows that fail it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import needles
from .evaluate import opposes
from .iterate import materialize

#: What makes a quote datable, and words about credibility and hearsay.
DATABLE = (
    r"(?i)\b(?:jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\bmay\s+(?:\d{1,2}|(?:19|20)\d{2})\b|\b\d{1,2}\s+may\b"
    r"|\b(?:mon|tues|wednes|thurs|fri|satur|sun)day\b|\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
)
SUFFIX = r"(?:als?|ments?|ings?|ed|es|s)$"
CREDIBILITY = ("credibility", "motive", "bias", "grievance", "lor", "letter of reprimand", "reliability")
HEARSAY = ("hearsay", "secondhand", "second hand", "firsthand", "first hand", "unnamed", "could not name", "heard about", "told me", "repeating what", "independent weight", "no independent", "uncorroborated", "not corroborated", "learned of it from", "was not present")
DISCOUNT = ("weight", "probative", "cannot rely", "not rely", "limits", "limited", "discount", "corroboration")


def norm(text: Column) -> Column:
    """Lower case, letters and digits with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def words_of(text: Column, longer: int, most: int) -> Column:
    """The first `most` words of a text that are longer than this."""
    return F.slice(F.filter(F.split(norm(text), " "), lambda w: F.length(w) > longer), 1, most)


def word_present(word: Column, blob: Column) -> Column:
    """Whether a word stands in a text: one of less than four letters whole, others at the beginning of a word; so does its stem, if
    five letters are left without the endings of inflection."""
    stem = F.regexp_replace(word, SUFFIX, "")
    at = lambda w, end: F.regexp_like(blob, F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E" + end)))
    return F.when(F.length(word) < 4, at(word, r"\b")).otherwise(at(word, "") | ((F.length(stem) >= 5) & at(stem, "")))


def present(words: Column, blob: Column) -> Column:
    """How many of the words stand in the text."""
    return F.size(F.filter(words, lambda w: word_present(w, blob)))


def people_found(facts: DataFrame, persons: DataFrame, peripheral: DataFrame) -> DataFrame:
    """name and person of every person's name in facts; person is null for a phantom: a name that no form (person, form) of the key
    holds or is held by, and whose last word no peripheral mention (text) has."""
    slot = lambda s: F.struct(F.col(f"{s}_type").alias("kind"), F.col(f"{s}_name").alias("name"))
    names = facts.select(F.inline(F.array(slot("subject"), slot("object")))).where("kind = 'PERSON'").select("name").distinct().withColumn("_n", norm(F.col("name")))
    names = names.withColumn("_last", F.element_at(F.split("_n", " "), -1))
    forms = persons.select("person", norm(F.col("form")).alias("_f")).where("_f <> ''").distinct()
    met = needles.held(forms, names, "_f", "_n").unionByName(needles.held(names, forms, "_n", "_f"))
    one = met.join(forms, "_f").groupBy("_n").agg(F.min(F.struct("person", "_f")).alias("_m")).select("_n", F.col("_m.person").alias("person"))
    # a last word has no space, so a mention that has it has it within a word
    words = peripheral.select(F.explode(F.split(norm(F.col("text")), " ")).alias("_w")).where("_w <> ''")
    aside = needles.held(names.where("_last <> ''"), words, "_last", "_w").select("_last").distinct().withColumn("_known", F.lit(True))
    return names.join(one, "_n", "left").join(aside, "_last", "left").where("person is not null or _known is null").select("name", "person")


def entity_score(found: DataFrame, names: int, persons: int) -> DataFrame:
    """One row: precision, matched, phantoms and passed of people_found; a phantom fails, one person may be missing."""
    sums = found.agg(F.count_distinct("person").alias("matched"), F.count_if(F.col("person").isNull()).alias("phantoms"))
    return sums.select(F.round(1 - F.col("phantoms") / max(1, names), 3).alias("precision"), "matched", "phantoms", ((F.col("phantoms") == 0) & (F.col("matched") >= persons - 1)).alias("passed"))


def precision_upgrades(facts: DataFrame) -> DataFrame:
    """Facts with a day that count as stated while their quote hedges the date or only bounds it."""
    text = norm(F.col("quote"))
    month = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    hedged = text.rlike(rf"\b(around|about|approximately|mid|early|late|sometime|following)\b(?:\W+\w+){{0,2}}?\W+({month}|monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|\d{{4}})")
    bound = text.rlike(rf"\bsince\s+({month})\w*(?!\s+\d)")
    return facts.where((F.length("event_date") >= 10) & (hedged | bound) & F.coalesce("event_date_basis", F.lit("")).isin("", "stated"))


def timeline_recall(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """event_id and found for each event (event_id, event, date, precision) of the key: whether a fact of that date, to the event's
    precision, holds half of its first five long words (two at least). Facts meet events by date; events without one meet all."""
    words = words_of(F.col("event"), 3, 5)
    g = gold.withColumn("_w", words).where(F.size("_w") > 0).withColumn("_need", F.greatest(F.lit(2), F.floor(F.size("_w") / 2)))
    blob = norm(F.concat_ws(" ", "quote", "predicate", "object_name", "subject_name"))
    f = facts.select(F.coalesce("event_date", F.lit("")).alias("_d"), blob.alias("_b"))
    keyed = g.withColumn("_k", F.when(F.coalesce("date", F.lit("")) == "", "").when(F.col("precision") == "month", F.substring("date", 1, 7)).otherwise(F.substring("date", 1, 10)))
    keys = F.array_distinct(F.array(F.lit(""), F.substring("_d", 1, 7), F.substring("_d", 1, 10)))
    hit = keyed.join(f.withColumn("_k", F.explode(keys)), "_k").where(present(F.col("_w"), F.col("_b")) >= F.col("_need"))
    return g.select("event_id").distinct().join(hit.select("event_id", F.lit(True).alias("found")).distinct(), "event_id", "left").na.fill(False, ["found"])


def duplicates(facts: DataFrame) -> DataFrame:
    """facts and repeated: how many there are, and how many of one page repeat a shorter quote of the same assertion."""
    key = ["doc_id", "page_num", *(norm(F.col(c)) for c in ("subject_name", "predicate", "object_name")), F.coalesce("event_date", F.lit(""))]
    # keys of 16 bytes, whatever names are; a null is told from no text
    tagged = [x for c in key for x in (c, (F.col(c) if isinstance(c, str) else c).isNull())]
    rows = facts.select(F.xxhash64(*tagged).alias("_h"), F.xxhash64(F.lit(1), *tagged).alias("_g"), norm(F.col("quote")).alias("_q"))
    # equal quotes are one with a count; by two of the keys they move once for both steps
    each = rows.repartition("_h", "_g").groupBy("_h", "_g", "_q").agg(F.count(F.lit(1)).alias("_n"))
    quotes = each.groupBy("_h", "_g").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_q", "_n")).alias("_m"))
    holds = lambda x: F.exists("_m", lambda r: (r["_q"] != "") & (r["_q"] != x["_q"]) & F.contains(x["_q"], r["_q"]))
    # of a quote that holds no other, the first is no repetition
    first = F.when(F.size("_m") == 1, 1).otherwise(F.size(F.filter("_m", lambda x: ~holds(x))))
    return quotes.agg(F.coalesce(F.sum("_all"), F.lit(0)).alias("facts"), F.coalesce(F.sum(F.col("_all") - first), F.lit(0)).alias("repeated"))


def date_coverage(facts: DataFrame) -> DataFrame:
    """One row: datable, dated and inferred: facts whose quote names a time, those of them with a date, and facts with a date that
    their quote doesn't name."""
    datable, dated = F.coalesce(F.col("quote").rlike(DATABLE), F.lit(False)), F.coalesce(F.trim("event_date"), F.lit("")) != ""
    return facts.agg(F.count_if(datable).alias("datable"), F.count_if(datable & dated).alias("dated"), F.count_if(~datable & dated).alias("inferred"))


def numbers_kept(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """value and found of every number of three digits or amount in gold (text): whether a fact has it, with or without commas."""
    value = F.explode(F.regexp_extract_all("text", F.lit(r"\$[\d,]*\d(?:\.\d+)?|\b\d[\d,]*\d\d(?:\.\d+)?\b|\b\d,\d{3}\b"), F.lit(0)))
    plain = lambda c: F.regexp_replace(c, r"(?<=\d),(?=\d{3})", "")
    wanted = gold.select(value.alias("value")).distinct().withColumn("_v", F.regexp_replace(plain("value"), r"^\$", ""))
    seen = facts.select(F.explode(F.regexp_extract_all(plain(F.concat_ws(" ", "quote", "object_name")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("_v")).distinct().withColumn("found", F.lit(True))
    return wanted.join(seen, "_v", "left").select("value", F.coalesce("found", F.lit(False)).alias("found"))


def corpus_cited(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, finished and cited: whether a document is done, and whether a citation (name) names its stem."""
    stem = norm(F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,5}$", ""))
    docs = documents.select("doc_id", (F.coalesce("status", F.lit("done")) == "done").alias("finished"), stem.alias("_s"))
    named = citations.select(norm(F.col("name")).alias("_s")).distinct().withColumn("_hit", F.lit(True))
    return docs.join(named, "_s", "left").select("doc_id", "finished", (F.col("finished") & F.coalesce("_hit", F.lit(False)) & (F.col("_s") != "")).alias("cited"))


def citation_integrity(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """ref, cite and verdict of every bracket of findings (ref, title, text): good where it names a document, circular where it names
    the allegation or three of its title's long words, else unresolved."""
    stems = documents.select(norm(F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,5}$", "")).alias("_s")).where("_s <> ''").distinct()
    cites = findings.select("ref", "title", F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\[\]]+)\]"), F.lit(1))).alias("cite"))
    bare = cites.withColumn("_c", norm(F.col("cite")))
    tokens = F.split("_c", " ")
    # a stem is a run of the citation's words: all runs are keys, and a citation is short
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.transform(F.sequence(i, F.size(tokens)), lambda j: F.array_join(F.slice(tokens, i, j - i + 1), " "))))
    hit = bare.select("_c", F.explode(F.array_distinct(runs)).alias("_s")).distinct().join(stems, "_s", "left_semi").select("_c").distinct().withColumn("_hit", F.lit(True))
    own = F.size(F.filter(F.array_distinct(F.filter(F.split(norm(F.col("title")), " "), lambda w: F.length(w) > 4)), lambda w: F.contains(F.col("_c"), w)))
    verdict = F.when(F.col("_hit"), "good").when(F.col("cite").rlike(r"(?i)\balleg") | (own >= 3), "circular").otherwise("unresolved")
    return bare.join(hit, "_c", "left").select("ref", "cite", verdict.alias("verdict"))


def without_circular(texts: DataFrame, text: str) -> DataFrame:
    """texts without brackets that cite the allegation itself, and without the space before them."""
    return texts.withColumn(text, F.regexp_replace(text, r"(?i)\s*\[[^\[\]]*\balleg\w*[^\[\]]*\]", ""))


def dispositions_named(stated: DataFrame, labels: list[str]) -> DataFrame:
    """stated (ref, disposition) with permitted: whether the disposition is one of the labels, case and punctuation aside."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"[^a-z]+", "")
    return stated.withColumn("permitted", F.coalesce(flat(F.col("disposition")).isin(*["".join(c for c in x.lower() if c.isalpha()) for x in labels]), F.lit(False)))


def conflict_recall(expected: DataFrame, sections: DataFrame) -> DataFrame:
    """conflict_id and detected: whether the conflict sections (text) hold a third of the first five long words of two positions."""
    blob = sections.agg(norm(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("_b"))
    sides = expected.select("conflict_id", words_of(F.col("position"), 3, 5).alias("_w")).where("size(_w) > 0").join(F.broadcast(blob), F.lit(True))  # one row
    hit = present(F.col("_w"), F.col("_b")) >= F.greatest(F.lit(1), F.floor(F.size("_w") / 3))
    return sides.groupBy("conflict_id").agg((F.count_if(hit) >= 2).alias("detected"))


def opposing(conflicts: DataFrame) -> DataFrame:
    """conflicts (a, b) with opposing: whether the two accounts can't both be true."""
    return conflicts.withColumn("opposing", opposes(F.col("a"), F.col("b")))


def quote_routing(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """finding_id, ref and misrouted of findings (finding_id, ref, text) that quote a fact (quote, allegation_ref) of 20 characters or
    more: whether none of the facts that they quote is tagged with their own reference. A quote and a fact are one where either holds
    the other and both begin with the same 20 characters; many may, so they meet as needles do, whole."""
    quoted = findings.select("finding_id", "ref", F.explode(F.regexp_extract_all("text", F.lit("[\"“]([^\"”]{20,})[\"”]"), F.lit(1))).alias("q")).withColumn("q", norm(F.col("q")))
    held = facts.where("coalesce(trim(allegation_ref), '') <> ''").select(norm(F.col("quote")).alias("f"), "allegation_ref").where(F.length("f") >= 20)
    pairs = needles.held(quoted, held, "q", "f").unionByName(needles.held(held, quoted, "f", "q")).where(F.substring("q", 1, 20) == F.substring("f", 1, 20)).distinct()
    met = quoted.join(pairs, "q").join(held.distinct(), "f")
    return met.groupBy("finding_id", "ref").agg((~F.bool_or(F.col("allegation_ref") == F.col("ref"))).alias("misrouted"))


def exculpatory(marked: DataFrame, bodies: DataFrame) -> DataFrame:
    """fact_id and present of facts (fact_id, ref, text) that cut the other way: whether the body of their allegation holds a third of
    their first six long words, two at least."""
    words = marked.select("fact_id", "ref", words_of(F.col("text"), 4, 6).alias("_w"))
    hits = F.size(F.filter("_w", lambda w: F.contains(F.col("_b"), w)))
    rows = words.join(bodies.select("ref", norm(F.col("text")).alias("_b")), "ref", "left")
    return rows.groupBy("fact_id").agg(F.coalesce(F.bool_or(hits >= F.greatest(F.lit(2), F.floor(F.size("_w") / 3))), F.lit(False)).alias("present"))


def credibility(reports: DataFrame, text: str) -> DataFrame:
    """reports with credibility, hearsay and discounted: whether a report speaks of each; it passes with all three."""
    body = norm(F.col(text))
    says = lambda words: F.array_contains(F.array(*[F.contains(body, F.lit(w)) for w in words]), F.lit(True))
    return reports.withColumns({"credibility": says(CREDIBILITY), "hearsay": says(HEARSAY), "discounted": says(DISCOUNT)}).withColumn("passed", F.col("credibility") & F.col("hearsay") & F.col("discounted"))


def merge_traps(persons: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """person, trap and held: aliases (person, canonical, alias) that are entities must be merged into another; people who share a last
    name must each have a name (name) with their first one."""
    e = entities.select(norm(F.col("canonical_name")).alias("_a"), F.col("merged_into").isNotNull().alias("_m"))
    alias = persons.where("alias is not null").select("person", norm(F.col("alias")).alias("_a")).where(F.length("_a") >= 2).join(e, "_a")
    merged = alias.groupBy("person").agg(F.bool_and("_m").alias("held")).select("person", F.lit("alias").alias("trap"), "held")
    who = persons.select("person", F.split(norm(F.col("canonical")), " ").alias("_t")).distinct().select("person", F.element_at("_t", 1).alias("_first"), F.element_at("_t", -1).alias("_last"))
    shared = who.join(who.groupBy("_last").count().where("count > 1").select("_last"), "_last")
    seen = names.select(F.explode(F.split(norm(F.col("name")), " ")).alias("_first")).distinct().withColumn("held", F.lit(True))
    split = shared.join(seen, "_first", "left").select("person", F.lit("surname").alias("trap"), F.coalesce("held", F.lit(False)).alias("held"))
    return merged.unionByName(split)


def negated(facts: DataFrame, denials: DataFrame) -> DataFrame:
    """denial_id and asserted of denials (denial_id, text): whether a fact has two of the rarest three long words of what was denied,
    and no word of denial. Words weigh by how few denials have them; facts meet denials by words."""
    from .evaluate import NEGATION, rare_weight

    words = denials.select("denial_id", F.explode(F.array_distinct(F.filter(F.split(norm(F.col("text")), " "), lambda w: F.length(w) > 4))).alias("w"))
    ranked = words.join(rare_weight(words, "denial_id", "w"), "w")
    top = ranked.groupBy("denial_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("r"), "w"))), 1, 3), lambda x: x["w"]).alias("_w"))
    blob = norm(F.concat_ws(" ", "predicate", "object_name", "quote"))
    plain = facts.select(F.monotonically_increasing_id().alias("_f"), blob.alias("_b")).where(~F.col("_b").rlike(rf"\b(?:{'|'.join(w for w in NEGATION if w.isalpha())})\b"))
    # two of three words are a pair: facts meet different pairs under that word which fewer facts have
    two = lambda i, j: F.when(F.size("_w") > j, F.struct(F.least(F.get("_w", i), F.get("_w", j)).alias("u"), F.greatest(F.get("_w", i), F.get("_w", j)).alias("v")))
    pairs = top.select("denial_id", F.inline(F.array(two(0, 1), two(0, 2), two(1, 2)))).where("u is not null").distinct()
    asked = pairs.select("u", "v").distinct()
    sought = asked.select(F.explode(F.array("u", "v")).alias("w")).distinct()
    had = plain.select("_f", F.explode(F.array_distinct(F.split("_b", " "))).alias("w")).join(sought, "w")
    had = materialize(had.groupBy("_f").agg(F.collect_list("w").alias("_v")), "denied")
    each = had.select("_v", F.explode("_v").alias("w"))
    n = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(n.toDF("u", "_nu"), "u").join(n.toDF("v", "_nv"), "v")
    rarer = F.col("_nu") <= F.col("_nv")
    asked = asked.select("u", "v", F.when(rarer, F.col("u")).otherwise(F.col("v")).alias("w"), F.when(rarer, F.col("v")).otherwise(F.col("u")).alias("_o"))
    said = asked.join(each, "w").where(F.array_contains("_v", F.col("_o"))).select("u", "v").distinct()
    hit = pairs.join(said, ["u", "v"], "left_semi").select("denial_id").distinct().withColumn("asserted", F.lit(True))
    return denials.select("denial_id").distinct().join(hit, "denial_id", "left").na.fill(False, ["asserted"])

