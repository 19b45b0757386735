"""Queries of rules, scores and the ledger: each calls its operator over a whole table, on strings that tell the rules apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import extraction_chunks_udf, narrow_quote_udf, normalize_udf, quote_offset_udf
from ..functions.names import fault_udf, without_title_udf
from ..operators import assertions, corpus, elements, entities, evaluate, graph, ledger, links, markdown, ocr, passages, people, report, routing, scoring
from ..operators.iterate import by_rows
from ..streaming import sessions
from .evidence import load
from .registry import query


def pick(key: Column, *values) -> Column:
    """The value at the key's remainder."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def nothing(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def dates(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return load(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date")), F.col("o_orderkey")


O = "WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m') AS month FROM orders) "


@query(O + """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN iso WHEN 1 THEN month WHEN 2 THEN month WHEN 3 THEN iso || 'T09:25' WHEN 4 THEN month WHEN 5 THEN '' WHEN 6 THEN iso || 'T09:25:10' WHEN 7 THEN iso ELSE '' END AS event_date FROM o""")
def when_rules(spark: SparkSession, sf: str) -> DataFrame:
    o, k = dates(spark, sf)
    say = lambda f: F.date_format("d", f)
    raw = pick(k, F.concat(say("yyyy-MM-dd"), F.lit(" 2575")), say("MMM yyyy"), F.concat(F.lit("12 and "), say("yyyy-MM"), F.lit(" too")), F.concat(say("yyyy-MM-dd"), F.lit(" 0925")), F.concat(say("MMMM"), F.lit("., "), say("yyyy")), F.lit("unknown"), F.concat(say("yyyy-MM-dd'T'"), F.lit("09:25:10Z")), F.concat(F.lit("on "), say("yyyy-MM-dd"), F.lit(", early")), F.lit("Marceau 2025"))
    return o.select("o_orderkey", C.normalize_when(raw).alias("event_date"))


@query(O + """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN month WHEN 6 THEN month ELSE iso END AS event_date, CASE o_orderkey % 8 WHEN 0 THEN 'stated' WHEN 1 THEN 'approx' WHEN 2 THEN 'month' WHEN 3 THEN 'inferred' WHEN 4 THEN 'stated' WHEN 5 THEN 'stated' WHEN 6 THEN 'approx' ELSE 'stated' END AS event_date_basis FROM o""")
def date_basis(spark: SparkSession, sf: str) -> DataFrame:
    o, k = dates(spark, sf)
    say = lambda f: F.date_format("d", f)
    quote = pick(k, F.concat(F.lit("He talked about it on "), say("d MMMM yyyy")), F.concat(F.lit("around "), say("d MMMM yyyy")), F.concat(F.lit("It was in "), say("MMMM yyyy")), F.lit("No date at all"), F.concat(F.lit("late shift, "), say("yyyy-MM-dd")), F.concat(F.lit("on "), say("dd/MM/yyyy")), F.concat(F.lit("in early "), say("MMMM")), F.concat(F.lit("about 12 requests on "), say("d MMM")))
    return assertions.with_basis(o.select("o_orderkey", say("yyyy-MM-dd").alias("event_date"), quote.alias("quote"))).select("o_orderkey", "event_date", "event_date_basis")


@query(O + """SELECT o_orderkey, strftime(x, '%Y-%m-%d') AS event_date, CASE o_orderkey % 4 WHEN 0 THEN 'inferred' WHEN 1 THEN 'stated' END AS event_date_basis
FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [make_date(2024, 6, 6), make_date(2024, 6, 20), make_date(2024, 7, 3)] WHEN o_orderkey % 4 = 1 THEN [d, d + 9] ELSE [NULL] END) AS x FROM o)""")
def series_rules(spark: SparkSession, sf: str) -> DataFrame:
    o, k = dates(spark, sf)
    say = lambda d: F.date_format(d, "d MMMM yyyy")
    both = [say(F.col("d")), say(F.date_add("d", 9))]
    quote = pick(k, "three advances, dated 6 June, 20 June and 3 July", F.concat_ws(" and ", *both), F.concat_ws(" but not on ", *both), F.lit("6 June"))
    rows = o.select("o_orderkey", quote.alias("quote"), F.lit("All of it in 2024.").alias("page"), nothing().alias("event_date"), nothing().alias("event_date_basis"))
    return assertions.expand_series(rows, "page").select("o_orderkey", "event_date", "event_date_basis")


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'CLAIM' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'CLAIM' WHEN 3 THEN 'CLAIM' WHEN 4 THEN 'PERSON' WHEN 5 THEN 'CLAIM' ELSE 'PERSON' END AS subject_type,
CASE WHEN c_custkey % 7 = 6 THEN 'missing field' WHEN c_custkey % 7 = 5 THEN NULL ELSE NULL END AS drop_reason, CASE WHEN c_custkey % 7 IN (0, 6) THEN NULL ELSE '2024-05-06' END AS event_date FROM customer""")
def validate_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand, groups, titles, blanks and strangers; predicates that bound a period; a field that is missing."""
    k = F.col("c_custkey")
    name = pick(k, "the crew", "Ann Roe", "Flight Chief", "Paul Stranger", "SSgt Ann Roe", "Investigating Officer", "Ann Roe")
    page = F.lit("On 6 May 2024 SSgt Ann Roe met the crew at the gate.\nThe Flight Chief signed the log.\nInvestigating Officer Signature: ______\nAnn Roe left.")
    rows = load(spark, sf, "customer").select("c_custkey", page.alias("page_text"), F.lit("PERSON").alias("subject_type"), name.alias("subject_name"), pick(k, "waited until", "met", "met", "met", "met", "met", "met").alias("predicate"), F.lit("CLAIM").alias("object_type"), F.lit("the gate").alias("object_name"), F.when(k % 7 == 6, nothing()).otherwise(F.lit("2024-05-06")).alias("event_date"), F.when(k % 7 == 6, "").otherwise("On 6 May 2024 SSgt Ann Roe met the crew at the gate.").alias("quote"))
    return assertions.validate(rows).select("c_custkey", "subject_type", "drop_reason", "event_date")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'not in the document' WHEN 2 THEN 'a role' WHEN 3 THEN 'takes an article' ELSE 'a form label' END AS fault FROM customer""")
def name_faults(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.col("c_name"), F.lit(" met the chief. The Wing Planner came.\nApproving Authority: ____"))
    name = pick(F.col("c_custkey"), F.col("c_name"), F.lit("Paul Stranger"), F.lit("the chief"), F.lit("Wing Planner"), F.lit("Approving Authority"))
    return load(spark, sf, "customer").select("c_custkey", fault_udf(name, F.lit("PERSON"), page).alias("fault"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'judge ' ELSE '' END || 'customer ' || right(c_name, 9) AS norm FROM customer""")
def name_norms(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(pick(F.col("c_custkey"), "TSgt ", "A1C ", "2Lt ", "Judge "), F.col("c_name"), F.lit(", Jr."))
    return load(spark, sf, "customer").select("c_custkey", normalize_udf(raw).alias("norm"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'SSgt J. Miller' WHEN 1 THEN 'SSgt Roe, SSgt Vance' ELSE 'Smith, John' END AS name FROM customer""")
def title_strip(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", without_title_udf(pick(F.col("c_custkey"), "SSgt J. Miller, Flight Chief", "SSgt Roe, SSgt Vance", "Smith, John")).alias("name"))


@query("""SELECT event_id, event_id % 6 IN (0, 3, 5) AS says FROM events""")
def propositions(spark: SparkSession, sf: str) -> DataFrame:
    text = pick(F.col("event_id"), "They will go there", "section NCOIC of record", "cables", "He is not going there", "one two three four", "She might go home early")
    return load(spark, sf, "events").select("event_id", links.proposition(text).alias("says"))


@query("""SELECT s_suppkey AS doc_id, unnest([2, 4]) AS ref, unnest([0, 3]) AS "start", unnest([3, 5]) AS "end" FROM supplier""")
def marker_sections(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("**Allegation 2:** "), F.col("s_name"), F.lit("\nbody that runs on\nallegation 3 was put to him.\n| Specification IV | x |\nCharge 3 posted"))
    return routing.marker_spans(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page_num"), text.alias("text"))).drop("page_num")


@query("""SELECT p_partkey AS target, s_suppkey AS k FROM part, supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey = s_suppkey WHERE s_suppkey % 50 > 0""")
def routing_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a target; suppliers name their own, and some are open to all."""
    k = F.col("s_suppkey")
    rows = load(spark, sf, "supplier").select(k.alias("k"), F.array(k).alias("refs"), (k % 50 == 0).alias("unrestricted"))
    return routing.route(rows, load(spark, sf, "part").select(F.col("p_partkey").alias("target"))).select("target", "k")


@query("""SELECT n_nationkey, doc_id FROM (SELECT n_nationkey, ['de', 'zz qq', 'la', 'ing th', 'NATION', 'er der un'][n_nationkey % 6 + 1] AS needle FROM nation) JOIN documents ON contains(text, needle)""")
def contamination_short(spark: SparkSession, sf: str) -> DataFrame:
    """Needles of one to three words, which texts may cut anywhere."""
    n = load(spark, sf, "nation").select("n_nationkey", pick(F.col("n_nationkey"), "de", "zz qq", "la", "ing th", "NATION", "er der un").alias("needle"))
    return evaluate.contamination(n, load(spark, sf, "documents"), "n_nationkey", "needle", "doc_id", "text")


@query("""SELECT l_suppkey AS entity_id, count(DISTINCT l_orderkey) AS docs, count(DISTINCT l_orderkey * 10 + l_linenumber) AS pages, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY 1""")
def entity_sets(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), F.col("l_shipdate").cast("string").alias("event_date"))
    return ledger.entity_sets(m).select("entity_id", *[F.size(c).cast("long").alias(c) for c in ("docs", "pages", "days")])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 'line' WHEN l_orderkey % 2 = 0 THEN 'order' WHEN s_suppkey IS NOT NULL THEN 'supplier ' || s_nationkey END AS ref FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    lines = li.where("l_linenumber = 1 and l_orderkey % 3 = 0").select("l_orderkey", "l_linenumber", F.lit("line").alias("ref")).distinct()
    orders = load(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("order").alias("ref"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("supplier "), F.col("s_nationkey").cast("string")).alias("ref"))
    return ledger.fallback(li, [(["l_orderkey", "l_linenumber"], lines), (["l_orderkey"], orders), (["l_suppkey"], suppliers)], "ref").drop("l_suppkey")


@query("""WITH m AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INT) AS n, '"the ' || event_type || ' of it" by ' || first AS text FROM m""")
def conflict_pool(spark: SparkSession, sf: str) -> DataFrame:
    text = F.format_string('%d. "The  %s of it" by %d', F.col("event_id") % 7, "event_type", "event_id")
    got = ledger.pooled(load(spark, sf, "events").select("user_id", F.col("event_id").alias("draw"), F.lit(0).alias("place"), text.alias("text")), "user_id")
    return got.withColumn("text", F.regexp_replace("text", "The  ", "the "))


@query("""SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def pairing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.by_count(load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind")), "kind")


@query("""SELECT DISTINCT 'no answer from ' || event_type AS reason FROM events WHERE event_id % 2 = 0""")
def error_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" no answer from "), F.col("event_type"), F.lit("\nat "), F.col("event_id").cast("string"))).otherwise(" ").alias("error"))
    return ledger.error_reasons(e)


@query("""SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1""")
def joined_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.joined_distinct(load(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", "segments")


@query("""SELECT 'CLAIM' AS entity_type, count(*) AS skipped FROM part WHERE p_partkey % 3 = 0""")
def usable_claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select(pick(F.col("p_partkey"), "CLAIM", "CLAIM", "PERSON").alias("entity_type"), pick(F.col("p_partkey"), F.col("p_name"), F.concat(F.col("p_name"), F.lit(" was sold there")), F.col("p_name")).alias("name"))
    return ledger.usable(rows, links.proposition)[1]


@query("""SELECT DISTINCT doc_id FROM (SELECT l_orderkey AS doc_id FROM lineitem UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def contributing_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.contributing(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")), load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")))


@query("""SELECT c_custkey AS doc_id, 'ingested after the analysis began' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1997-01-01')""")
def arrived_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an early urgent order."""
    early = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate < timestamp '1997-01-01'")
    return ledger.arrived_since(load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), early.select(F.col("o_custkey").alias("doc_id")))


@query("""SELECT 'entity_links' AS "table", count(*) AS removed FROM lineitem UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'triples', count(*) FROM orders""")
def purge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.purge({"pages": load(spark, sf, "pages"), "triples": load(spark, sf, "orders"), "entity_links": load(spark, sf, "lineitem"), "reports": load(spark, sf, "nation")}, "evidence", ledger.CONFIRM)[1]


@query("""SELECT c_custkey, coalesce(n_name, 'nowhere') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0""")
def dimension_names(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return ledger.named(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "name", F.lit("nowhere")).drop("c_nationkey")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'""")
def bound_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.scan(spark, "SELECT o_orderkey FROM ledger_orders WHERE o_totalprice > :least AND o_orderstatus = :status", {"ledger_orders": load(spark, sf, "orders")}, least=100000, status="F")


@query(O + """SELECT o_orderkey, list_sort(list_distinct([iso, strftime(d + 40, '%Y-%m-%d'), strftime(d + 80, '%Y-%m')])) AS found, 2 + CAST(strftime(d + 80, '%Y-%m') NOT IN (month, strftime(d + 40, '%Y-%m')) AS INT) AS occasions FROM o""")
def date_sets(spark: SparkSession, sf: str) -> DataFrame:
    o, _ = dates(spark, sf)
    text = F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(", again "), F.date_format(F.date_add("d", 40), "d MMMM yyyy"), F.lit(" and in "), F.date_format(F.date_add("d", 80), "MMM yyyy"), F.lit(" (13/45/2024)"))
    return o.select("o_orderkey", elements.dates_in(text).alias("found")).withColumn("occasions", F.size(elements.occasions(F.col("found"))))


@query("""SELECT s_suppkey AS k, unnest([1, 2]) AS element, unnest([s_name || ' took it', 'It was wrong']) AS proposition, unnest([s_suppkey % 2 = 0, false]) AS repeats, unnest([CASE WHEN s_suppkey % 2 = 1 THEN 'repetition not alleged' END, 'multiplicity not read']) AS note FROM supplier WHERE s_suppkey % 5 > 0
UNION ALL SELECT s_suppkey, 1, CASE WHEN s_suppkey % 2 = 0 THEN 'He took it several times' ELSE 'He took it' END, false, 'not decomposed' FROM supplier WHERE s_suppkey % 5 = 0""")
def element_plans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    reply = F.when(k % 5 == 0, "I can't say.").otherwise(F.concat(F.lit("**E1** | **ELEMENT:** "), F.col("s_name"), F.lit(" took\n  it\nWORDS: \"took\"\n**MULTIPLICITY:** **yes**\nE2 | ELEMENT: It was wrong\nWORDS: x")))
    rows = load(spark, sf, "supplier").select(k.alias("k"), reply.alias("reply"), pick(k, "He took it several times", "He took it").alias("allegation"))
    return elements.decompose(rows, "k", "reply", "allegation")


@query("""SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS element, l_returnflag <> 'R' AS met, CAST(l_quantity AS INT) + CAST(l_linestatus = 'F' AS INT) AS instances, 1 AS cites FROM lineitem""")
def element_blocks(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    # columns move, and a section's text is made of them where they meet
    met = lambda x: F.when(x["l_returnflag"] != "R", "Yes").otherwise("No")
    body = lambda x: F.concat(F.lit("E"), x["l_linenumber"].cast("string"), F.lit(" | text\nOPPOSING: it was not met: no waiver. MET: No\n**INSTANCES ESTABLISHED:** "), F.when(x["l_linestatus"] == "F", "more than ").otherwise("one or "), x["l_quantity"].cast("int").cast("string"), F.lit(" [memo p.977]\n**MET:** "), met(x))
    place = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    text = F.concat(F.lit("Intro\n"), F.array_join(F.transform(F.array_sort(F.collect_list(place)), body), "\n"), F.lit("\n**Disposition:** none\nE9 | MET: No"))
    return elements.block_rows(li.groupBy(F.col("l_orderkey").alias("k")).agg(text.alias("text")), "k", "text").select("k", "element", "met", "instances", F.size("cites").alias("cites"))


@query("""SELECT event_id AS k, 1 AS element, CASE event_id % 6 WHEN 0 THEN true WHEN 2 THEN false WHEN 4 THEN true END AS met, CASE event_id % 6 WHEN 1 THEN 'no occasions to count' WHEN 2 THEN 'one occasion' WHEN 3 THEN 'no page cited' WHEN 5 THEN 'no document of that name' END AS reason FROM events""")
def element_corrections(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = load(spark, sf, "events").select(k.alias("k"), F.lit(1).alias("element"), pick(k, True, True, True, False, True, True).alias("met"), pick(k, nothing("int"), nothing("int"), F.lit(1), F.lit(9), F.lit(3), F.lit(2)).alias("instances"), pick(k, "6 June 2024 and 9 June 2024", "6 June 2024, June 2024", "once [June 2020 memo p.3]", "x", "x", "x").alias("body"), pick(k, 1, 1, 1, 0, 1, 1).alias("cited"), pick(k, 1, 1, 1, 0, 1, 0).alias("grounded"))
    plan = rows.select("k", "element", F.lit(True).alias("repeats"))
    return elements.correct(rows, "k", plan, rows.select("k", "element", F.array(F.lit("2024-06")).alias("dates")).where(k % 6 == 1))


@query("""WITH li AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS INT) AS element, l_returnflag <> 'R' AS met FROM lineitem), v AS (SELECT k, element, bool_and(met) AS all_met, bool_or(met) AS any_met FROM li GROUP BY 1, 2),
s AS (SELECT o_orderkey AS k, coalesce(bool_or(element <= 3 AND all_met = any_met AND NOT all_met), false) AS no, count(*) FILTER (element <= 3 AND all_met = any_met) AS n, list_sort(coalesce(list(element) FILTER (element > 3), [])) AS stray,
  list_filter([1, 2, 3], lambda e: NOT list_contains(coalesce(list(element) FILTER (all_met = any_met), []), e)) AS unweighed FROM orders LEFT JOIN v ON k = o_orderkey GROUP BY 1)
SELECT k, CASE WHEN n = 3 AND NOT no THEN 'affirmative' ELSE 'negative' END AS disposition, (no OR n = 3) AND CASE WHEN no THEN k % 4 <> 1 ELSE k % 4 <> 0 END AS corrected, NOT (no OR n = 3) AS unsettled, unweighed, stray FROM s""")
def settled_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """Three elements are planned for every order; lines beyond them are stray, and lines of a number that disagree count for none."""
    k = F.col("o_orderkey")
    written = load(spark, sf, "orders").select(k.alias("k"), pick(k, "**Substantiated** - all met", "NOT SUBSTANTIATED; one failed", "Substantiated in part", "Insufficient evidence").alias("disposition"))
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("element"), (F.col("l_returnflag") != "R").alias("met"))
    plan = written.select("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("element"))
    return elements.settle(written, rows, plan, "k")


@query("""SELECT count(*) FILTER (event_id % 5 < 3) AS datable, count(*) FILTER (event_id % 5 < 3 AND event_id % 2 = 0) AS dated, count(*) FILTER (event_id % 5 >= 3 AND event_id % 2 = 0) AS inferred FROM events""")
def date_coverage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return scoring.date_coverage(load(spark, sf, "events").select(pick(k, "on 14 July", "a Tuesday", "in 2023", "he may go", "he went on").alias("quote"), F.when(k % 2 == 0, "2024-01-01").alias("event_date")))


@query("""SELECT (SELECT count(*) FROM lineitem) * 2 AS facts, (SELECT count(*) FROM lineitem) * 2 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) AS repeated""")
def assertion_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Each line says the same of its order and supplier at two lengths."""
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_name"), F.lit("sold").alias("predicate"), F.lit("it").alias("object_name"), nothing().alias("event_date"), F.explode(F.array(F.lit("It was sold."), F.lit("It was sold, and so on"))).alias("quote"))
    return scoring.duplicates(li)


@query("""SELECT s_suppkey AS event_id, s_suppkey % 4 < 2 AS found FROM supplier""")
def timeline_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Found by day and by month; lost by another day and by other words."""
    k = F.col("s_suppkey")
    s = load(spark, sf, "supplier").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (k * 3).cast("int")))
    gold = s.select(k.alias("event_id"), pick(k, "Smith referred the matter onwards", "Smith referred the matter onwards", "Smith referred the matter onwards", "Jones counted seven barrels yesterday").alias("event"), F.when(k % 4 == 1, F.date_format("d", "yyyy-MM")).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("date"), pick(k, "day", "month", "day", "day").alias("precision"))
    facts = s.select(F.date_format(F.date_add("d", F.when(k % 4 == 2, 1).otherwise(0)), "yyyy-MM-dd'T'09:00").alias("event_date"), F.lit("a referral of the matter").alias("quote"), F.lit("was").alias("predicate"), F.lit("smith").alias("object_name"), F.lit("X").alias("subject_name"))
    return scoring.timeline_recall(gold, facts)


@query("""SELECT 'Customer#' || right(c_name, 9) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS person FROM customer WHERE c_custkey % 3 < 2""")
def people_score(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the customers is on the roster, a third is a phantom, the rest is mentioned aside."""
    c = load(spark, sf, "customer")
    facts = c.select(F.lit("PERSON").alias("subject_type"), F.col("c_name").alias("subject_name"), F.lit("ORG").alias("object_type"), F.lit("x").alias("object_name"))
    return scoring.people_found(facts, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("form")), c.where("c_custkey % 3 = 2").select(F.col("c_name").alias("text")))


@query("""SELECT CAST(100000 + o_orderkey AS VARCHAR) AS value, o_orderkey % 2 = 0 AS found FROM orders""")
def numbers_kept(spark: SparkSession, sf: str) -> DataFrame:
    o, k = dates(spark, sf)
    gold = o.select(F.concat(F.lit("It cost "), (k + 100000).cast("string"), F.lit(" in 12 parts")).alias("text"))
    return scoring.numbers_kept(gold, o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("paid $"), F.format_number(k + 100000, 0)).alias("quote"), F.lit("x").alias("object_name")))


@query("""SELECT s_suppkey AS doc_id, s_suppkey % 3 > 0 AS finished, s_suppkey % 3 = 1 AS cited FROM supplier""")
def corpus_cited(spark: SparkSession, sf: str) -> DataFrame:
    s, k = load(spark, sf, "supplier"), F.col("s_suppkey")
    docs = s.select(k.alias("doc_id"), F.concat(F.col("s_name"), F.lit(".docx")).alias("filename"), pick(k, F.lit("failed"), nothing(), F.lit("done")).alias("status"))
    return scoring.corpus_cited(docs, s.where(k % 3 < 2).select(F.lower("s_name").alias("name")))


@query("""SELECT s_suppkey AS ref, unnest([s_name || ' p.3', 'Allegation 2', 'ledger of missing barrels', 'nobody p.1']) AS cite, unnest(['good', 'circular', 'circular', 'unresolved']) AS verdict FROM supplier""")
def citation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    text = F.concat(F.lit("It was so ["), F.col("s_name"), F.lit(" p.3] and [Allegation 2], [ledger of missing barrels] [nobody p.1]."))
    return scoring.citation_integrity(s.select(F.col("s_suppkey").alias("ref"), F.lit("Missing barrels and the false ledger").alias("title"), text.alias("text")), s.select(F.concat(F.col("s_name"), F.lit(".pdf")).alias("filename")))


@query("""SELECT event_id, event_id % 4 < 2 AS permitted FROM events""")
def disposition_labels(spark: SparkSession, sf: str) -> DataFrame:
    stated = load(spark, sf, "events").select("event_id", pick(F.col("event_id"), F.lit("SUBSTANTIATED"), F.lit("not-substantiated."), F.lit("Insufficient evidence"), nothing()).alias("disposition"))
    return scoring.dispositions_named(stated, ["Substantiated", "Not substantiated"]).drop("disposition")


@query("""SELECT event_id, event_id % 4 <> 1 AS opposing FROM events""")
def opposing_accounts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    pairs = load(spark, sf, "events").select("event_id", F.lit("He took 5 coins from the drawer today").alias("a"), pick(k, "He took 6 coins from the drawer today", "He took 5 coins from the drawer today", "He never took 5 coins from the drawer today", "Nothing else happened in 5 weeks there").alias("b"))
    return scoring.opposing(pairs).drop("a", "b")


@query("""SELECT p_partkey AS conflict_id, p_partkey % 2 = 0 AS detected FROM part""")
def conflict_recall(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    sides = load(spark, sf, "part").select(k.alias("conflict_id"), F.explode(F.array(F.lit("Smith moved the barrels"), pick(k, "Jones refused delivery", "Nobody witnessed anything"))).alias("position"))
    sections = load(spark, sf, "region").select(pick(F.col("r_regionkey"), "Smith says he was moving barrels.", "Jones refused all deliveries.").alias("text"))
    return scoring.conflict_recall(sides, sections)


@query("""SELECT s_suppkey AS finding_id, CAST(s_suppkey % 3 AS INT) AS ref, s_suppkey % 3 <> 1 AS misrouted FROM supplier""")
def quote_routes(spark: SparkSession, sf: str) -> DataFrame:
    s, k = load(spark, sf, "supplier"), F.col("s_suppkey")
    said = F.concat(F.lit("the goods of "), F.col("s_name"), F.lit(" left the yard at noon"))
    findings = s.select(k.alias("finding_id"), (k % 3).cast("int").alias("ref"), F.concat(F.lit('He wrote: "'), F.upper(said), F.lit('" [x p.1]')).alias("text"))
    return scoring.quote_routing(findings, s.select(said.alias("quote"), F.lit(1).alias("allegation_ref")))


@query("""SELECT p_partkey AS fact_id, p_partkey % 3 = 0 AS present FROM part""")
def exculpatory_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    marked = load(spark, sf, "part").select(k.alias("fact_id"), (k % 3).alias("ref"), F.lit("Smith reported himself before anyone asked about barrels").alias("text"))
    bodies = spark.createDataFrame([(0, "It counts that Smith, before anyone asked, reported it."), (1, "Barrels.")], "ref long, text string")
    return scoring.exculpatory(marked, bodies)


@query("""SELECT event_id, event_id % 3 < 2 AS credibility, event_id % 3 = 0 AS hearsay, event_id % 3 = 0 AS discounted, event_id % 3 = 0 AS passed FROM events""")
def credibility_notes(spark: SparkSession, sf: str) -> DataFrame:
    body = pick(F.col("event_id"), "His motive is plain; the rest is hearsay and carries little weight.", "A grievance, perhaps.", "Nothing of note.")
    return scoring.credibility(load(spark, sf, "events").select("event_id", body.alias("body")), "body").drop("body")


@query("""SELECT c_custkey AS person, 'alias' AS trap, c_custkey % 2 = 0 AS held FROM customer WHERE c_custkey % 3 = 0""")
def merge_traps(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the customers has an alias among the entities; half of these are merged."""
    c, k = load(spark, sf, "customer"), F.col("c_custkey")
    alias = F.concat(F.lit("alias "), k.cast("string"))
    persons = c.select(k.alias("person"), F.concat(F.lit("first"), k.cast("string"), F.lit(" last"), k.cast("string")).alias("canonical"), F.when(k % 3 == 0, alias).alias("alias"))
    held = c.where("c_custkey % 3 = 0").select(alias.alias("canonical_name"), F.when(k % 2 == 0, "x").alias("merged_into"))
    return scoring.merge_traps(persons, held, c.select(F.col("c_name").alias("name")))


@query("""SELECT s_suppkey AS denial_id, s_suppkey % 2 = 0 AS asserted FROM supplier""")
def denied_facts(spark: SparkSession, sf: str) -> DataFrame:
    s, k = load(spark, sf, "supplier"), F.col("s_suppkey")
    mark = F.concat(F.lit("barrel"), k.cast("string"), F.lit(" cellar"), k.cast("string"))
    facts = s.select(F.lit("moved").alias("predicate"), mark.alias("object_name"), pick(k, "It was moved.", "He denied it.").alias("quote"))
    return scoring.negated(facts, s.select(k.alias("denial_id"), F.concat(F.lit("Nobody moved "), mark).alias("text")))


@query("""SELECT event_id, event_id % 6 < 4 AS present FROM events""")
def words_present(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    word = pick(k, "referral", "move", "was", "barrels", "was", "remove")
    text = pick(k, "he referred it", "it was moved", "it was there", "one barrel", "a wasp", "it moved")
    return load(spark, sf, "events").select("event_id", scoring.word_present(word, text).alias("present"))


@query("""SELECT s_suppkey AS window, s_suppkey * 10 + 1 AS a, s_suppkey * 10 + 4 AS b, 'caused' AS relation, 'A' AS side, CAST(0.8 AS DOUBLE) AS confidence, 'page 3' AS basis, s_suppkey % 2 = 0 AS complete FROM supplier""")
def group_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One good line among repeats, strangers, labels beyond the window and a pair of one entity."""
    k = F.col("s_suppkey")
    ids = lambda *n: F.array(*[k * 10 + i for i in n])
    reply = F.concat(F.lit("- A1 | B2 | **Caused** | A | 0.8 | page 3 | more\nB2 | A1 | caused | B | 0.1 | again\nA9 | B1 | caused | A | 1 | x\nA1 | B1 | likes | A | 1 | x\nA2 | B1 | caused | A | 1 | same\nA0 | B1 | caused | A | 1 | none\nnoise\n"), pick(k, "End of answer", ""))
    rows = load(spark, sf, "supplier").select(k.alias("window"), ids(1, 3).alias("left_ids"), ids(3, 4).alias("right_ids"), reply.alias("reply"))
    return links.parse_group(rows, ["caused"])


@query("""SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_custkey < y.c_custkey AND (x.c_mktsegment = 'BUILDING' AND y.c_mktsegment = 'MACHINERY' OR x.c_mktsegment = 'MACHINERY' AND y.c_mktsegment = 'BUILDING')""")
def typed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return links.pairs_for(load(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type")), "BUILDING", "MACHINERY")


@query("""WITH w AS (SELECT s_suppkey AS w, list_transform(range(1 + s_suppkey % 6), lambda i: i) AS l, list_transform(range(1 + s_suppkey % 5), lambda i: 100 + i) AS r FROM supplier) SELECT w AS window, (len(l) * len(r)) AS pairs FROM w UNION ALL SELECT 100000 + w, len(l) * (len(l) - 1) // 2 FROM w WHERE len(l) > 1""")
def window_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Windows in halves hold each of their pairs once."""
    k = F.col("s_suppkey")
    left, right = F.sequence(F.lit(0).cast("bigint"), k % 6), F.sequence(F.lit(100).cast("bigint"), k % 5 + 100)
    s = load(spark, sf, "supplier")
    rows = s.select(k.alias("window"), left.alias("left_ids"), right.alias("right_ids"), F.lit(False).alias("same")).unionByName(s.select((k + 100000).alias("window"), left.alias("left_ids"), left.alias("right_ids"), F.lit(True).alias("same")))
    h = links.halves(rows)
    pairs = F.when(F.col("same"), F.size("left_ids") * (F.size("left_ids") - 1) / 2).otherwise(F.size("left_ids") * F.size("right_ids")).cast("long")
    return h.groupBy("window").agg(F.sum(pairs).alias("pairs"))


@query("""SELECT count(*) FILTER (l_suppkey % 2 = 0 AND l_orderkey % 3 > 0) AS drawn, count(*) FILTER (NOT (l_suppkey % 2 = 0 AND l_orderkey % 3 > 0)) AS lost FROM lineitem""")
def links_lost(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("b_id"))
    s = load(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return graph.lost(li, s.union(load(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))))


@query("""SELECT 'PERSON:' || lower(c_name) AS src, 'LOCATION:' || lower(n_name) AS dst, c_custkey % 2 = 0 AS early FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def graph_load(spark: SparkSession, sf: str) -> DataFrame:
    """Triples in two loads; the second has the first's too."""
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = c.select(F.col("c_custkey").cast("string").alias("triple_id"), F.lit("PERSON").alias("subject_type"), F.col("c_name").alias("subject_name"), F.lit("based in").alias("predicate"), F.lit("LOCATION").alias("object_type"), F.col("n_name").alias("object_name"), nothing().alias("event_date"), F.lit("d").alias("doc_id"), F.lit(1).alias("page_num"), nothing().alias("loaded_at"))
    none = graph.edges(t.limit(0))
    v, e, _ = graph.load(t.where(F.col("triple_id").cast("long") % 2 == 0), spark.createDataFrame([], "entity_id string, entity_type string, name string"), none, "1")
    late = t.withColumn("loaded_at", F.when((F.col("triple_id").cast("long") % 4 == 0), "1"))
    v, e, _ = graph.load(late, v, e, "2")
    return e.join(v.select(F.col("entity_id").alias("src")), "src").join(v.select(F.col("entity_id").alias("dst")), "dst").select("src", "dst", (F.col("triple_id").cast("long") % 2 == 0).alias("early"))


@query("""SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1""")
def graph_tally(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tally(load(spark, sf, "part").select(F.col("p_type").alias("entity_type")))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entity_id FROM lineitem WHERE l_suppkey = 7 UNION SELECT 's7'""")
def graph_focus(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_orderkey").cast("string").alias("dst"))
    return graph.focus(e, "s7")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'processing' WHEN o_orderkey % 3 = 1 THEN 'done' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN 'ocr' ELSE 'none' END AS stage, CASE WHEN o_orderkey % 3 = 0 THEN 'now' END AS started_at, CASE WHEN o_orderkey % 3 = 1 THEN 'now' END AS finished_at FROM orders""")
def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    docs = o.select(k.alias("doc_id"), F.lit("queued").alias("status"), F.lit("none").alias("stage"), nothing().alias("started_at"), nothing().alias("finished_at"))
    return corpus.set_status(docs, o.where("o_orderkey % 3 < 2").select(k.alias("doc_id"), pick(k, "processing", "done", "x").alias("new_status"), F.lit("ocr").alias("new_stage")), "now")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders UNION ALL SELECT -1, 'x', NULL""")
def page_upserts(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    new = old.where("k % 2 = 0").select("k", F.lit("new").alias("a"), nothing().alias("b")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("x"), nothing()))
    return corpus.upsert(old, new, ["k"])


@query("""SELECT conv_id AS doc_id, turn AS page_num, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'annex' FROM conversations GROUP BY 1""")
def annex_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text")
    return corpus.annex(c, c.select("doc_id").distinct().select("doc_id", F.lit(1).alias("ord"), F.lit("annex").alias("text")))


@query("""SELECT 'PERSON:customer ' || right(c_name, 9) AS a, 'PERSON:alias ' || c_custkey AS b FROM customer WHERE c_custkey % 3 < 2""")
def stated_aliases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    t = load(spark, sf, "customer").select(F.lit("PERSON").alias("subject_type"), F.col("c_name").alias("subject_name"), pick(k, "also known as", "AKA", "met").alias("predicate"), F.lit("PERSON").alias("object_type"), F.concat(F.lit("Alias "), k.cast("string")).alias("object_name"))
    return entities.stated_aliases(t)


@query("""SELECT event_id AS page_num, CASE WHEN event_id % 3 = 0 THEN 'ocr' ELSE 'vlm' END AS route FROM events""")
def ocr_routes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return ocr.route(load(spark, sf, "events").select(k.alias("page_num"), pick(k, F.lit(25), F.lit(24), nothing("int")).alias("ocr_words"), pick(k, F.lit(82.0), F.lit(99.0), nothing("double")).alias("ocr_conf"))).select("page_num", "route")


@query("""SELECT 's' || s_suppkey AS doc_id, s_name || '  is here' || chr(10) || 'below' AS text FROM supplier""")
def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda text, left, top: F.struct(text.alias("text"), F.lit(left).alias("left"), F.lit(top).alias("top"))
    words = F.explode(F.array(word(F.lit("is"), 118.0, 13.0), word(F.col("s_name"), 10.0, 10.0), word(F.lit("below"), 10.0, 30.0), word(F.lit("here"), 133.0, 11.0)))
    rows = load(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.lit(1).alias("page_num"), words.alias("w")).select("doc_id", "page_num", "w.*", F.when(F.col("w.left") == 10.0, 98.0).otherwise(10.0).alias("width"), F.lit(10.0).alias("height"), F.lit(90.0).alias("conf"))
    return ocr.read_pages(rows).select("doc_id", "text")


@query("""SELECT s_suppkey AS k, unnest([1, 2]) AS number, unnest([s_name, 'Other']) AS title, unnest(['body one' || chr(10) || 'more', 'body two']) AS body FROM supplier""")
def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Intro\n#### Allegation 1: "), F.col("s_name"), F.lit("\nbody one\nmore\n**Allegation 2: Other**\nbody two"))
    return markdown.sections(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("t")), "k", "t", r"(?i)^allegation \d+: (.*)$")


@query("""SELECT s_suppkey AS k, unnest([1, 2]) AS n, unnest([s_name || ' took it', 'and lied']) AS allegation FROM supplier""")
def allegation_items(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(pick(F.col("s_suppkey"), "1. ", "- ", ""), F.col("s_name"), F.lit(" took it\n\n"), pick(F.col("s_suppkey"), "2) ", "* ", ""), F.lit("**and lied**"))
    return markdown.split_allegations(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("t")), "k", "t")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'It was ' || event_type || '.' WHEN event_id % 3 = 1 THEN 'One came. It was ' || event_type || '. Two left.' ELSE 'No. It was ' || event_type || '.' END AS quote FROM events""")
def narrow_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence that holds the needle; the whole quote where none does, or where it is too short."""
    quote = F.concat(pick(F.col("event_id"), "One came. It was ", "One came. It was ", "No. It was "), F.col("event_type"), pick(F.col("event_id"), ". Two left.", ". Two left.", "."))
    return load(spark, sf, "events").select("event_id", narrow_quote_udf(quote, pick(F.col("event_id"), F.col("event_type"), F.lit("absent"), F.lit("No."))).alias("quote"))


@query("""SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 23 + length(event_type) END AS INT) AS place FROM events""")
def quote_places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    text = F.concat(F.lit("He saw:  it was\n"), F.col("event_type"), F.lit(". Later IT WAS "), F.col("event_type"), F.lit("."))
    want = F.concat(F.lit("It  was "), F.col("event_type"))
    return load(spark, sf, "events").select("event_id", quote_offset_udf(text, pick(k, want, want, F.lit("nothing")), pick(k, 0, 10, 0)).alias("place"))


@query("""SELECT o_orderkey, 2 AS chunks, 6000 AS longest FROM orders""")
def prompt_chunks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("word "), 1200), F.col("o_orderkey").cast("string"))
    # keys of a few bytes become texts of 6,000: tasks go by rows, not by the bytes of the file
    c = by_rows(load(spark, sf, "orders").select("o_orderkey"), 10_000).select("o_orderkey", extraction_chunks_udf(text).alias("c"))
    return c.select("o_orderkey", F.size("c").alias("chunks"), (F.array_max(F.transform("c", F.length)) + 1).alias("longest"))


@query("""SELECT s_suppkey AS finding_id, s_suppkey % 2 AS ref, 6 AS hits, 6 AS n FROM supplier""")
def foreign_findings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = pick(k, "sergeant counted seventy barrels behind warehouse", "lieutenant signed several receipts without reading")
    facts = spark.createDataFrame([(0, "The sergeant counted seventy barrels behind a warehouse."), (1, "The lieutenant signed several receipts without reading them.")], "ref long, quote string")
    return report.foreign_findings(load(spark, sf, "supplier").select(k.alias("finding_id"), text.alias("text")), facts)


@query("""SELECT s_suppkey AS k, s_name || ' did it.' AS body FROM supplier""")
def circular_scrub(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("s_name"), F.lit(" did it [the allegation itself]."))
    return scoring.without_circular(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("body")), "body")


@query("""SELECT s_suppkey AS chunk_id, unnest([0, 10 + length(s_name)]) AS "start", unnest([9 + length(s_name), 19 + 2 * length(s_name)]) AS "end" FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, 0, 9 + length(s_name) FROM supplier WHERE s_suppkey % 2 = 0""")
def passage_places(spark: SparkSession, sf: str) -> DataFrame:
    """A page says a thing twice: the first of two chunks takes the first copy; one that comes behind the last has both."""
    k = F.col("s_suppkey")
    said = F.concat(F.col("s_name"), F.lit("  was\nout"))
    s = load(spark, sf, "supplier").select(k, said.alias("said"), F.concat(said, F.lit(" "), said).alias("text"))
    flat = F.regexp_replace(F.upper("said"), r"\s+", " ")
    chunks = s.select(k.alias("chunk_id"), k.alias("doc_id"), F.lit(1).alias("page_num"), F.lit(1).alias("ord"), flat.alias("text")).where("chunk_id % 2 = 0")
    late = s.where(k % 2 == 1)
    chunks = chunks.unionByName(late.select((-k).alias("chunk_id"), k.alias("doc_id"), F.lit(1).alias("page_num"), F.lit(0).alias("ord"), F.lit("OUT").alias("text"))).unionByName(late.select((-k).alias("chunk_id"), k.alias("doc_id"), F.lit(1).alias("page_num"), F.lit(1).alias("ord"), F.lit("out").alias("text"))).unionByName(late.select(k.alias("chunk_id"), k.alias("doc_id"), F.lit(1).alias("page_num"), F.lit(2).alias("ord"), flat.alias("text")))
    pages = s.select(k.alias("doc_id"), F.lit(1).alias("page_num"), "text")
    return passages.placed(chunks, pages).where("chunk_id >= 0 and doc_id = chunk_id").select("chunk_id", "start", "end")


@query("""WITH m AS (SELECT c_custkey AS k, (SELECT max(c_custkey) FROM customer) AS most FROM customer)
SELECT k AS entity_id, CASE k % 5 WHEN 0 THEN CASE WHEN k + 2 <= most THEN k + 2 WHEN k + 1 <= most THEN k + 1 END WHEN 1 THEN CASE WHEN k + 1 <= most THEN k + 1 END WHEN 3 THEN k - 1 END AS merged_into FROM m""")
def merge_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Three customers in a ring, whose third has the fullest label, one that points into it and one alone; the last may be fewer."""
    c = load(spark, sf, "customer")
    most = c.agg(F.max("c_custkey")).first()[0]
    k = F.col("c_custkey")
    into = pick(k, k + 1, k + 1, k - 2, k - 3, nothing("bigint"))
    e = c.select(k.alias("entity_id"), pick(k, "Ann", "Ann", "Ann Roe", "A", "B").alias("label"), F.lit(1).alias("mentions"), F.when(into <= most, into).alias("merged_into"))
    return entities.compact(e).select("entity_id", "merged_into")


@query("""SELECT c_custkey AS chunk_id, c_custkey AS doc_id, n_name AS filename FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("doc_id"))
    d = load(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("filename"))
    return passages.with_documents(c, d, "filename").withColumn("doc_id", F.col("chunk_id"))


@query("""SELECT s_suppkey AS finding_id, 2 AS belongs FROM supplier WHERE s_suppkey % 3 = 0""")
def strayed_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings under the first allegation: one that tells the second's, one that tells both and one of few words."""
    k = F.col("s_suppkey")
    text = pick(k, "The sergeant, again, counted seventy barrels behind warehouse [memo p.1].", "Lieutenant signed receipts; sergeant counted barrels behind.", "Barrels, seventy.")
    allegations = spark.createDataFrame([(1, "The lieutenant signed receipts without reading"), (2, "The sergeant counted barrels behind the warehouse")], "ref int, allegation string")
    return report.other_allegation(load(spark, sf, "supplier").select(k.alias("finding_id"), F.lit(1).alias("ref"), text.alias("text")), allegations)


@query(O + """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN iso || 'T09:25' WHEN 1 THEN iso WHEN 2 THEN iso END AS held FROM o""")
def proceeding_times(spark: SparkSession, sf: str) -> DataFrame:
    o, k = dates(spark, sf)
    day = F.date_format("d", "d MMMM yyyy")
    text = pick(k, F.concat(F.lit("Form 7\n| **Date / Time / Location:** | "), day, F.lit(", 0925, Bldg 1540 |\n")), F.concat(F.lit("Date of interview\n\n"), day, F.lit("\nName: x")), F.concat(F.lit("Room 1540\nDATE: "), day), F.lit("On 6 June 2024 it was.\nDate: soon"))
    return o.select("o_orderkey", people.proceeding_time(text).alias("held"))


@query("""SELECT s_suppkey AS doc_id, s_name AS name FROM supplier WHERE s_suppkey % 3 < 2""")
def interviewees(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = pick(k, F.concat(F.lit("Sworn\nName: "), F.col("s_name"), F.lit("\nI saw it.")), F.concat(F.lit("Interviewee - "), F.col("s_name")), F.lit("No form at all"))
    return people.interviewee(load(spark, sf, "supplier").select(k.alias("doc_id"), F.lit(1).alias("page_num"), text.alias("text")))


@query("""SELECT s_suppkey AS doc_id, 'PERSON:' || s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 2 = 0""")
def document_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the forms name someone of the roster; the other half names two alike."""
    k = F.col("s_suppkey")
    s = load(spark, sf, "supplier")
    who = F.concat(F.lit("Ann x"), k.cast("string"), F.lit(" Roe"), k.cast("string"))
    pages = s.select(k.alias("doc_id"), F.lit(1).alias("page_num"), F.concat(F.lit("Name: Ann Roe"), k.cast("string")).alias("text"))
    roster = s.select(F.concat(F.lit("PERSON:"), k.cast("string")).alias("entity_id"), who.alias("label"))
    twins = s.where(k % 2 == 1).select(F.concat(F.lit("TWIN:"), k.cast("string")).alias("entity_id"), F.concat(F.lit("Ann y Roe"), k.cast("string")).alias("label"))
    return people.speakers(pages, roster.unionByName(twins))


@query("""WITH g AS (SELECT s_suppkey // 3 AS g, count(*) AS n FROM supplier GROUP BY 1) SELECT 'd' || s_suppkey AS doc_id, CAST(n AS BIGINT) AS size FROM supplier JOIN g ON g = s_suppkey // 3""")
def document_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in threes, chained by people whom two of them share."""
    k = F.col("s_suppkey")
    who = F.explode(F.array(F.concat(F.lit("own"), k.cast("string")), F.when(k % 3 < 2, F.concat(F.lit("p"), k.cast("string"))).otherwise(F.concat(F.lit("own"), k.cast("string"))), F.when(k % 3 > 0, F.concat(F.lit("p"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("own"), k.cast("string")))))
    m = load(spark, sf, "supplier").select(F.concat(F.lit("d"), k.cast("string")).alias("doc_id"), who.alias("entity_id"))
    return people.document_groups(m).select("doc_id", "size")


@query("""SELECT p_partkey AS k, p_partkey % 2 = 0 AS known FROM part""")
def grounded_citations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    cites = load(spark, sf, "part").select(k.alias("k"), pick(k, "Memo", "nobody").alias("name"), F.lit(2).alias("page"))
    return report.grounded(cites, spark.createDataFrame([("memo", 3)], "name string, page_count int")).select("k", "known")


@query("""SELECT min(event_id) AS first FROM events WHERE event_id % 2 = 0 GROUP BY event_type""")
def secondhand_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that others told, one of each quote."""
    quote = F.concat(pick(F.col("event_id"), "He told me of the ", "I saw the "), F.col("event_type"))
    e = load(spark, sf, "events").select("event_id", quote.alias("quote"), "event_type")
    kept = report.secondhand(e)
    return kept.join(e.where("event_id % 2 = 0").groupBy("event_type").agg(F.min("event_id").alias("first")), "event_type").select("first")


@query("""SELECT l_orderkey AS g, l_linenumber AS n FROM (SELECT *, count(*) FILTER (l_linenumber % 3 > 0 AND l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) AS kept FROM lineitem) WHERE kept = 0 OR l_linenumber % 3 > 0 AND l_returnflag <> 'R'""")
def conflict_filter(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"), F.lit("p0").alias("page_a"), F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string")).alias("page_b"), F.when(F.col("l_returnflag") == "R", " ").otherwise("can't both be").alias("incompatible"))
    return report.filter_conflicts(li, "g").select("g", "n")


@query("""SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 3 > 0""")
def unjudged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = load(spark, sf, "supplier")
    pairs = s.select(k.alias("a"), (k + 1).alias("b"))
    return links.unjudged(pairs, s.where(k % 3 == 0).select((k + 1).alias("a_id"), k.alias("b_id")))


@query("""SELECT least(s_suppkey, 7) AS a_id, greatest(s_suppkey, 7) AS b_id, CASE WHEN s_suppkey % 3 = 0 THEN 'caused' ELSE '' END AS relation, CASE WHEN s_suppkey % 3 = 0 THEN 7 END AS subject_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence FROM supplier WHERE s_suppkey <> 7""")
def link_records(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts with enough confidence and a basis; those without either are blank."""
    k = F.col("s_suppkey")
    v = load(spark, sf, "supplier").where("s_suppkey <> 7").select(k.alias("a"), F.lit(7).cast("long").alias("b"), F.lit("caused").alias("relation"), F.lit("B").alias("side"), pick(k, 0.5, 0.49, 0.9).alias("confidence"), pick(k, "p.1", "p.1", " ").alias("basis"))
    return links.record(v).drop("basis")


@query("""SELECT DISTINCT least(l_suppkey, l_partkey) AS a_id, greatest(l_suppkey, l_partkey) AS b_id, 'caused' AS relation FROM lineitem WHERE l_suppkey % 10 = 3 OR l_partkey % 10 = 3 ORDER BY 1, 2 LIMIT 45""")
def links_for_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first 45 links with an end on the pages."""
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = li.select(F.least("l_suppkey", "l_partkey").alias("a_id"), F.greatest("l_suppkey", "l_partkey").alias("b_id"), F.lit("caused").alias("relation"), F.lit(0.9).alias("confidence")).distinct()
    ids = rows.select(F.inline(F.array(F.struct(F.col("a_id").alias("entity_id")), F.struct(F.col("b_id").alias("entity_id"))))).distinct()
    pages_of = ids.select("entity_id", F.lit("d").alias("doc_id"), (F.col("entity_id") % 10).alias("page_num"))
    return links.for_pages(rows, pages_of, spark.createDataFrame([("d", 3)], "doc_id string, page_num long"), 45).select("a_id", "b_id", "relation")


@query("""SELECT ref, CAST(1 AS INT) AS base, ref BETWEEN 1 AND 5 AS valid FROM (SELECT DISTINCT CAST(l_linenumber AS INT) AS ref FROM lineitem)""")
def marker_numbering(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("ref")).agg(F.count(F.lit(1)).alias("seen"))
    return routing.numbering(counts, 5).select("ref", "base", "valid")


@query("""SELECT event_id % 7 AS grp, string_agg(event_id || ': ' || event_type, chr(10) ORDER BY event_id) AS block FROM events GROUP BY 1""")
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select((F.col("event_id") % 7).alias("grp"), "event_id", "event_type")
    return report.context_block(e, "grp", F.concat_ws(": ", F.col("event_id").cast("string"), "event_type"), ["event_id"])


@query("""SELECT p_partkey AS chunk_id FROM part WHERE p_partkey % 4 > 0""")
def index_outstanding(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"))
    k = F.col("chunk_id")
    held = p.where(k % 4 < 3).select("chunk_id", pick(k, "m", "other", "m", "m").alias("model"), F.when(k % 4 < 2, F.array(F.lit(1.0))).alias("embedding"))
    return passages.outstanding(p, held, "m")


@query("""SELECT (SELECT count(*) FROM part) AS chunks, count(*) FILTER (p_partkey % 4 < 2) AS indexed, count(*) FILTER (p_partkey % 4 = 1) AS stale FROM part""")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"))
    k = F.col("chunk_id")
    held = p.where(k % 4 < 3).select("chunk_id", pick(k, "m", "other", "m", "m").alias("model"), F.when(k % 4 < 2, F.array(F.lit(1.0))).alias("embedding"))
    return passages.index_stats(p, held, "m")


@query("""WITH m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i) SELECT i, round(x / sqrt((SELECT sum(x * x) FROM m)), 6) AS x FROM m""")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = passages.question_vector(load(spark, sf, "embeddings"), "embedding")
    return v.select(F.posexplode("embedding").alias("i", "x")).select((F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def backlog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What is still to be done, by user."""
    e = load(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "error", "processing").otherwise("done"))
    return sessions.backlog(e).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id AS BIGINT) AS seq, event_type AS data FROM events WHERE event_id >= 500""")
def log_follow(spark: SparkSession, sf: str) -> DataFrame:
    log = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.lit("token").alias("kind"), F.col("event_type").alias("data"))
    return sessions.follow(log, 500).select("run_id", "seq", "data")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[. ]+', '') || '.pdf' AS filename FROM part""")
def safe_filenames(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", C.safe_filename(F.concat(F.lit("../x/"), F.col("p_name"), F.lit(".pdf"))).alias("filename"))


@query("""SELECT c_custkey AS entity_id, count(o_orderkey) + 1 AS mentions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def rolled_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the mentions of their orders, which are merged into them."""
    c = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), nothing().alias("merged_into"))
    o = load(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("merged_into"))
    e = c.unionByName(o).withColumn("mentions", F.lit(1))
    return entities.rolled_up(e, entities.resolve(e)).select(F.substring("root", 2, 20).cast("long").alias("entity_id"), "mentions")
