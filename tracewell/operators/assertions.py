"""Assertions: from a model's replies to admitted, dated and deduplicated triples. Each step is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions.names import SLOTS, admit_udf
from ..functions.kernels import narrow_quote_udf, partial_ratio_udf, salvage_udf
from .containment import contained

REQUIRED = ("subject_type", "subject_name", "predicate", "object_type", "object_name", "quote")
FIELDS = ("subject_type", "subject_name", "predicate", "object_type", "object_name", "event_date", "quote")


def parse(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """A row for each object in a reply; cut replies give the objects that are whole."""
    items = replies.withColumn("_item", F.explode(salvage_udf(reply)))
    return items.select(*[c for c in replies.columns if c != reply], *[F.get_json_object("_item", f"$.{f}").alias(f) for f in FIELDS])


def supported(rows: DataFrame, page: str = "page_text", least: float = 90.0) -> DataFrame:
    """rows with _support: how the quote (first 400 characters) is in the page; exact, without white space, or nearly so."""
    quote, text = C.flat(F.substring("quote", 1, 400)), C.flat(F.col(page))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    exact = (F.length(quote) >= 8) & F.contains(text, quote)
    loose = (F.length(bare(quote)) >= 8) & F.contains(bare(text), bare(quote))
    rows = rows.withColumn("_cheap", F.when(exact, "exact").when(loose, "loose"))
    # only what neither finds goes through Python
    ratio = F.when(F.col("_cheap").isNull(), partial_ratio_udf(F.when(F.col("_cheap").isNull(), quote), F.when(F.col("_cheap").isNull(), text)))
    return rows.withColumn("_support", F.coalesce("_cheap", F.when(ratio >= least, "near"))).drop("_cheap")


def validate(rows: DataFrame, page: str = "page_text", header: str | None = None, speaker: str | None = None) -> DataFrame:
    """rows with drop_reason (null: admitted), narrowed quotes, repaired types and names and dates of known precision.

    Only a missing field or a quote that the page doesn't hold drops a row. Names of people and bodies must stand in the page or the
    document's header (a column, if given) and be names; else they are claims. First and second person get the name they mean:
    that of the speaker whom the quote reports, of the subject, or of the document's speaker (a column)."""
    missing = F.lit(False)
    for f in REQUIRED:
        missing = missing | (F.coalesce(F.trim(f), F.lit("")) == "")
    rows = supported(rows.withColumn("_missing", missing), page)
    rows = rows.withColumn("drop_reason", F.when(F.col("_missing"), "missing field").when(F.col("_support").isNull(), "quote not on page"))
    rows = rows.withColumn("quote", narrow_quote_udf(F.substring("quote", 1, 400), "object_name"))
    given = [F.col(c) if c else F.lit("") for c in (header, speaker)]
    slots = admit_udf("subject_type", C.squash(F.col("subject_name")), "object_type", C.squash(F.col("object_name")), "quote", page, *given)
    rows = rows.withColumn("_slots", F.when(F.col("drop_reason").isNull(), slots))
    rows = rows.withColumns({f.name: F.coalesce(f"_slots.{f.name}", f.name) for f in SLOTS}).drop("_slots")
    when = C.normalize_when(F.col("event_date"))
    rows = rows.withColumn("predicate", F.substring(C.flat(F.col("predicate")), 1, 100))
    rows = rows.withColumn("event_date", F.when(F.col("predicate").rlike(rules.BOUNDARY) | (when == ""), None).otherwise(when))
    return with_basis(rows).drop("_missing", "_support")


def days_in(quote):
    """Numbers of the days that a quote names: beside a month, as an ordinal in digits or words, or as D/M/Y (both parts)."""
    ints = lambda found: F.transform(found, lambda x: x.try_cast("int"))
    every = lambda pattern, k=1: F.regexp_extract_all(quote, F.lit(pattern), F.lit(k))
    slashed = r"\b(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}\b"
    digits = [ints(every(x, k)) for x, k in ((rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:{rules.MONTH})\b", 1), (rf"(?i)\b(?:{rules.MONTH})\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b", 1), (r"(?i)\bthe\s+(\d{1,2})(?:st|nd|rd|th)\b", 1), (slashed, 1), (slashed, 2))]
    words = {w: k for k, w in enumerate(rules.ORDINALS, 1)} | {"thirtieth": 30} | {f"{t} {w}": n + k for t, n in (("twenty", 20), ("thirty", 30)) for k, w in enumerate(rules.ORDINALS[:9], 1)}
    number = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    spelled = F.transform(every(rf"(?i)\bthe\s+((?:twenty|thirty)[\s-](?:{'|'.join(rules.ORDINALS[:9])})|(?:{'|'.join(rules.ORDINALS)}|thirtieth))\b"), lambda x: F.try_element_at(number, F.regexp_replace(F.lower(x), r"[\s-]", " ")))
    return F.array_distinct(F.flatten(F.array(*digits, spelled)))


def with_basis(rows: DataFrame) -> DataFrame:
    """rows with event_date cut to what the quote supports, and event_date_basis: stated, month, approx or inferred (null without
    a date). A time that the quote has no clock for goes; a day stays where the quote names it, or other days only; a quote that
    names a month and no day leaves the month. A basis that rows already have counts for dates with a time."""
    quote = F.coalesce("quote", F.lit(""))
    date = F.coalesce("event_date", F.lit(""))
    date = F.when(date.contains("T") & ~F.regexp_replace(quote, r"\b(?:19|20)\d{2}\b", " ").rlike(rules.CLOCK), F.substring(date, 1, 10)).otherwise(date)
    given = F.col("event_date_basis") if "event_date_basis" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"_d": date, "_days": days_in(quote), "_given": given})
    date, hedged = F.col("_d"), quote.rlike(rules.HEDGE)
    names_day = F.coalesce(F.array_contains("_days", F.substring(date, 9, 2).try_cast("int")), F.lit(False))
    only_month = quote.rlike(rf"(?i)\b(?:{rules.MONTH})\b|\b\d{{4}}-\d{{2}}\b") & (F.size("_days") == 0)
    basis = (
        F.when(date == "", None)
        .when(F.length(date) == 7, F.when(hedged, "approx").otherwise("month"))
        .when(date.contains("T"), F.when(F.col("_given").isin("stated", "inferred"), F.col("_given")).otherwise("stated"))
        .when(F.contains(quote, F.substring(date, 1, 10)), "stated")
        .when(names_day, F.when(hedged, "approx").otherwise("stated"))
        .when(only_month, F.when(hedged, "approx").otherwise("month"))
        .otherwise("inferred")
    )
    whole = date.contains("T") | F.contains(quote, F.substring(date, 1, 10)) | names_day | ~only_month
    return rows.withColumns({"event_date_basis": basis, "event_date": F.nullif(F.when(whole, date).otherwise(F.substring(date, 1, 7)), F.lit(""))}).drop("_d", "_days", "_given")


def expand_series(rows: DataFrame, page_text: str | None = None) -> DataFrame:
    """A row for each date of an undated assertion whose quote lists two or more days and takes none out; others as they are.

    Days without a year have that of the page (column page_text) if it names just one. The basis is stated if the first day has
    its year, else inferred."""
    series = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({rules.MONTH})\w*\.?(?:,?\s+(\d{{4}}))?\b"
    found = F.regexp_extract_all("quote", F.lit(series), F.lit(0))
    if page_text:
        years = F.array_distinct(F.regexp_extract_all(page_text, F.lit(r"\b(20\d{2})\b"), F.lit(1)))
        year = F.when(F.size(years) == 1, F.element_at(years, 1))
    else:
        year = F.lit(None).cast("string")

    def iso(x):
        y = F.coalesce(F.nullif(F.regexp_extract(x, series, 3), F.lit("")), year)
        return F.when(y.isNotNull(), F.concat_ws("-", y, C.month_number(F.regexp_extract(x, series, 2)), F.lpad(F.regexp_extract(x, series, 1), 2, "0")))

    dates = F.array_sort(F.array_distinct(F.filter(F.transform(found, iso), lambda d: d.isNotNull())))
    apply = (F.coalesce("event_date", F.lit("")) == "") & ~F.col("quote").rlike(rules.EXCLUSION) & (F.size(dates) >= 2)
    basis = F.when(F.element_at(found, 1).rlike(r"\d{4}$"), "stated").otherwise("inferred")
    marked = rows.withColumn("_dates", F.when(apply, dates)).withColumn("event_date_basis", F.when(apply, basis).otherwise(F.col("event_date_basis")))
    return marked.withColumn("_one", F.explode_outer("_dates")).withColumn("event_date", F.coalesce("_one", "event_date")).drop("_dates", "_one")


def dedupe(rows: DataFrame, order: str = "triple_id") -> DataFrame:
    """rows without those whose quote another row of the same assertion contains: the longest stays, of equal ones the first by
    order. Rows without a quote all stay.

    Equal quotes are one; which of the others are contained is found by their rarest marks (see containment), and as containment is
    transitive, one anti-join gives what a greedy pass does."""
    from .iterate import materialize

    key = [C.flat(F.col(c)).alias(f"_{c}") for c in ("subject_type", "subject_name", "predicate", "object_type", "object_name")]
    # texts are compared where containment is sought; elsewhere 16 bytes stand for them
    flat = C.flat(F.col("quote"))
    hashes = lambda c: [F.when(c.isNotNull(), F.xxhash64(F.lit(k), c)).alias(n) for k, n in enumerate(("_h", "_g"))]
    keyed = materialize(rows.select("*", F.xxhash64(*key, F.coalesce("event_date", F.lit(""))).alias("_key"), *hashes(flat)), "quotes", "zstd")
    inner = contained(keyed.select("_key", "_h", "_g", flat.alias("_flat")), "_key", "_flat", ["_h", "_g"])
    first = keyed.where("_h is not null").groupBy("_key", "_h", "_g").agg(F.min(order).alias("_first"))
    kept = first.join(inner, ["_key", "_h", "_g"], "left_anti")
    held = keyed.join(kept, ["_key", "_h", "_g"]).where(F.col(order).eqNullSafe(F.col("_first")) | F.col(order).isNull())
    return held.select(rows.columns).unionByName(keyed.where("_h is null").select(rows.columns))


def with_ids(rows: DataFrame) -> DataFrame:
    """rows with triple_id, one row each (insert-ignore)."""
    parts = [F.col(c) for c in ("doc_id", "page_num", "subject_type", "subject_name", "predicate", "object_type", "object_name", "event_date")]
    return rows.withColumn("triple_id", C.triple_id(*parts)).dropDuplicates(["triple_id"])


def first_marker(rows: DataFrame, by: str, place: str, marker: str) -> DataFrame:
    """rows with the marker that last stood before each, by document."""
    w = Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(marker, ignorenulls=True).over(w))
