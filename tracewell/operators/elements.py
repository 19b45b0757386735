"""Elements of an allegation: decomposition, the rows that weigh them, what the record carries, and the disposition they entail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules

#: Words of an allegation that assert repetition.
REPETITION = (
    r"(?i)\b(repeated(?:ly)?|repetition|multiple|several|various|numerous|routine(?:ly)?|regular(?:ly)?|habitual(?:ly)?|persistent(?:ly)?|"
    r"continu(?:ed|ing|ous|ously)|ongoing|pattern|practice|course of conduct|on (?:more than one|several|multiple|numerous) occasions|"
    r"each|every|daily|weekly|monthly|times)\b"
)
#: Words of a disposition that make a label of neither kind, and what counts as one.
PARTIAL = r"\b(?:in part|partial\w*|partly|mostly|largely)\b"
NEGATIVE = r"^(?:not substantiat\w*|unsubstantiated|not sustain\w*|unsustained)\b"
AFFIRMATIVE = r"^(?:substantiat\w*|sustain\w*)\b"


def decompose(replies: DataFrame, key: str, reply: str, allegation: str) -> DataFrame:
    """key, element, proposition, repeats and note of each "En | ELEMENT: ..." block of a reply, numbered in order. A reply without
    one gives the allegation itself. repeats is what the block's MULTIPLICITY line says, but never where the allegation asserts
    no repetition; note says what could not be read or was set aside."""
    bare = F.regexp_replace(reply, r"[*_`~]+", "")
    blocks = F.filter(F.split(bare, r"(?im)^[ \t>|#-]*E\d{1,2}[ \t]*[|:.)-]+[ \t]*(?=ELEMENT[ \t]*:)"), lambda b: b.rlike(r"(?i)^ELEMENT[ \t]*:"))
    head = lambda b: C.squash(F.regexp_replace(F.regexp_extract(b, r"(?is)^ELEMENT[ \t]*:[ \t]*(.*?)(?:\n[ \t>|#-]*(?:WORDS|MULTIPLICITY)[ \t]*:|\z)", 1), r"\|", " "))
    multiple = lambda b: F.lower(F.regexp_extract(b, r"(?i)MULTIPLICITY[ \t]*:[ \t]*(yes|no)\b", 1))
    parsed = F.filter(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.struct(head(b).alias("proposition"), multiple(b).alias("mult"))), lambda x: x["proposition"] != "")
    whole = F.array(F.struct(F.trim(F.col(allegation)).alias("proposition"), F.lit("").alias("mult")))
    rows = replies.withColumn("_found", parsed).withColumn("_all", F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole))
    said = F.coalesce(F.col(allegation), F.lit("")).rlike(REPETITION)
    note = F.when(F.size("_found") == 0, "not decomposed").when(F.col("_x.mult") == "", "multiplicity not read").when((F.col("_x.mult") == "yes") & ~said, "repetition not alleged")
    return rows.select("*", F.posexplode("_all").alias("_at", "_x")).select(key, (F.col("_at") + 1).alias("element"), F.col("_x.proposition").alias("proposition"), ((F.col("_x.mult") == "yes") & said).alias("repeats"), note.alias("note"))


def dates_in(text: Column) -> Column:
    """The distinct dates of a text as YYYY-MM-DD or YYYY-MM, in order: ISO, D/M/Y or M/D/Y (a number above 12 is the day), and named
    months with a day before or after them or none."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    two = lambda x: F.lpad(x, 2, "0")

    def key(year, month, day):
        m, d = month.try_cast("int"), day.try_cast("int")
        whole = F.when(d.isNull(), F.concat_ws("-", year, two(month))).when(d.between(1, 31), F.concat_ws("-", year, two(month), two(day)))
        return F.when(m.between(1, 12) & (year >= "1000"), whole)

    part = lambda x, pattern, k: F.regexp_extract(x, pattern, k)
    iso = r"\b(\d{4})-(\d{1,2})(?:-(\d{1,2}))?(?![\d-])"
    slashed = r"(?<![\d/-])(\d{1,2})/(\d{1,2})/(\d{4})\b"
    named = rf"(?i)\b(?:(\d{{1,2}})(?:st|nd|rd|th)?[ \t]+)?(?:of[ \t]+)?({rules.MONTH})\.?(?:[ \t]+(\d{{1,2}})(?:st|nd|rd|th)?)?,?[ \t]+(\d{{4}})\b"
    isos = F.transform(every(iso), lambda x: key(part(x, iso, 1), part(x, iso, 2), F.nullif(part(x, iso, 3), F.lit(""))))
    first, second = (lambda x: part(x, slashed, 1)), (lambda x: part(x, slashed, 2))
    month_first = lambda x: first(x).try_cast("int") <= 12
    numbers = F.transform(every(slashed), lambda x: key(part(x, slashed, 3), F.when(month_first(x), first(x)).otherwise(second(x)), F.when(month_first(x), second(x)).otherwise(first(x))))
    names = F.transform(every(named), lambda x: key(part(x, named, 4), C.month_number(part(x, named, 2)), F.coalesce(F.nullif(part(x, named, 1), F.lit("")), F.nullif(part(x, named, 3), F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(isos, numbers, names), lambda d: d.isNotNull())))


def occasions(dates: Column) -> Column:
    """Dates without those months that a day of them stands for."""
    return F.filter(dates, lambda d: (F.length(d) > 7) | ~F.exists(dates, lambda e: (F.length(e) > 7) & e.startswith(d)))


#: Numbers in words that a count of occasions may be written in.
COUNTS = tuple("zero one two three four five six seven eight nine ten eleven twelve".split())


def block_rows(sections: DataFrame, key: str, text: str) -> DataFrame:
    """key, element, at, body, met, instances, cites of each block "En | ..." of a section, up to the disposition or the next heading.

    met is the last "MET: yes|no" of the block, else a yes or no that ends its first line; instances the largest number on its
    INSTANCES line, in digits or words and one more for "more than"; cites the block's brackets."""
    bare = F.regexp_replace(text, r"[*_`~]+", "")
    table = F.regexp_extract(F.concat(F.lit("\n"), bare), r"(?is)^(.*?)(?:\n[ \t>|#-]*(?:Disposition[ \t]*[:–—-]|(?:Findings|Conflicts|Gaps|Corroboration)\b[^\n.]{0,40}(?=\n|\z))|\z)", 1)
    head = r"\n[ \t>|#-]*E(?=\d{1,2}[ \t]*[|:.)-])"
    parts = F.split(table, head)
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    rows = sections.select(key, F.posexplode(blocks).alias("at", "_b")).select(key, "at", F.regexp_extract("_b", r"^(\d{1,2})", 1).cast("int").alias("element"), F.trim(F.regexp_replace("_b", r"^\d{1,2}[ \t]*[|:.)-]+", "")).alias("body"))
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t>|#-]*MET[ \t]*[:|–—-]+[ \t]*(yes|no)\b"), F.lit(1))
    loose = F.regexp_extract_all("body", F.lit(r"(?i)\bMET[ \t]*:[ \t]*(yes|no)\b"), F.lit(1))
    first = F.regexp_extract(F.split("body", r"\n")[0], r"(?i)[ \t|]{2,}(yes|no)[ \t|]*$", 1)
    said = F.lower(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.try_element_at(loose, F.lit(-1)), F.nullif(first, F.lit(""))))
    value = F.regexp_replace(F.regexp_extract("body", r"(?im)INSTANCES(?:[ \t]+ESTABLISHED)?[ \t]*[:|–—-]+[ \t]*([^\n]*)", 1), r"\[[^\[\]]*\]", " ")
    names = F.array(*[F.lit(w) for w in COUNTS])
    numbers = F.filter(F.transform(F.regexp_extract_all(F.lower(value), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda w: F.coalesce(w.try_cast("int"), F.nullif(F.array_position(names, w), F.lit(0)).cast("int") - 1)), lambda n: n.isNotNull())
    count = F.array_max(numbers) + value.rlike(r"(?i)\b(?:more than|over|greater than)\b").cast("int")
    return rows.select(key, "element", "at", "body", (said == "yes").alias("met"), count.alias("instances"), F.regexp_extract_all("body", F.lit(r"\[([^\[\]]+)\]"), F.lit(1)).alias("cites"))


def correct(rows: DataFrame, key: str, elements: DataFrame, on_pages: DataFrame) -> DataFrame:
    """rows (key, element, met, instances, body, cited, grounded) of planned elements with what stands of their verdict and reason.

    elements: key, element and repeats; on_pages: key, element and dates, those of the facts on the pages that a block cites;
    cited and grounded: the block's citations with a page, and those of them that name a document. An element that asserts
    repetition and was found met needs two occasions, stated or dated: fewer make it not met; without a stated number and with
    fewer than two dates there is nothing to count, and the verdict is withdrawn. Verdicts that rest on no page, or on no known
    document, are withdrawn whichever way they went."""
    planned = rows.join(elements, [key, "element"]).join(on_pages, [key, "element"], "left")
    dated = F.size(occasions(F.array_distinct(F.concat(dates_in(F.regexp_replace("body", r"\[[^\[\]]*\]", " ")), F.coalesce("dates", F.array().cast("array<string>"))))))
    tested = F.col("met") & F.col("repeats")
    reason = (
        F.when(F.col("met").isNull(), None)
        .when(tested & F.col("instances").isNull() & (dated < 2), "no occasions to count")
        .when(tested & F.col("instances").isNotNull() & (F.greatest("instances", dated) < 2), "one occasion")
        .when(F.col("cited") == 0, "no page cited")
        .when(F.col("grounded") == 0, "no document of that name")
    )
    return planned.withColumn("reason", reason).select(key, "element", F.when(F.col("reason").isNull(), F.col("met")).when(F.col("reason") == "one occasion", F.lit(False)).alias("met"), "reason")


def label(raw: Column) -> Column:
    """affirmative or negative for a disposition as it is written; null for one that is partial or neither."""
    clause = C.squash(F.regexp_replace(F.lower(F.element_at(F.split(F.coalesce(raw, F.lit("")), "[-–—;(]"), 1)), "[^a-z ]+", " "))
    return F.when((clause == "") | clause.rlike(PARTIAL), None).when(clause.rlike(NEGATIVE), "negative").when(clause.rlike(AFFIRMATIVE), "affirmative")


def settle(written: DataFrame, rows: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """key, disposition, corrected, unsettled, unweighed and stray of each key of written (key, disposition as written).

    The table is the authority: one element that is not met makes it negative, all planned ones met affirmative. A table that entails
    nothing leaves the burden where it is: negative, unsettled. unweighed and stray list planned elements without one readable
    verdict and numbers that no one planned."""
    votes = rows.where("met is not null").groupBy(key, "element").agg(F.bool_and("met").alias("every"), F.bool_or("met").alias("some"))
    plan = planned.select(key, "element").distinct().withColumn("_planned", F.lit(True))
    seen = rows.select(key, "element").distinct().withColumn("_seen", F.lit(True))
    each = plan.join(votes, [key, "element"], "left").join(seen, [key, "element"], "full")
    one = F.col("every") == F.col("some")
    known, weighed = F.col("_planned").isNotNull(), F.col("_planned").isNotNull() & F.coalesce(one, F.lit(False))
    sums = each.groupBy(key).agg(
        F.count_if(known).alias("_n"), F.count_if(weighed).alias("_k"), F.coalesce(F.bool_or(weighed & ~F.col("every")), F.lit(False)).alias("_no"),
        F.array_sort(F.collect_list(F.when(known & ~weighed, F.col("element")))).alias("unweighed"), F.array_sort(F.collect_list(F.when(~known, F.col("element")))).alias("stray"),
    )
    out = written.select(key, "disposition").join(sums, key, "left")
    required = F.when(F.col("_no"), "negative").when((F.col("_k") > 0) & (F.col("_k") == F.col("_n")), "affirmative")
    empty = F.array().cast("array<int>")
    return out.select(
        key, F.coalesce(required, F.lit("negative")).alias("disposition"), (required.isNotNull() & ~F.coalesce(label(F.col("disposition")) == required, F.lit(False))).alias("corrected"),
        required.isNull().alias("unsettled"), F.coalesce("unweighed", empty).alias("unweighed"), F.coalesce("stray", empty).alias("stray"),
    )
