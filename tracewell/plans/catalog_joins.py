"""Queries of joins that equality alone can't express: overlaps, needles, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import dictionary, grading, intervals, needles
from .evidence import load
from .registry import query


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line, start and end (code points) of every line of documents."""
    each = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "_t"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_t") + 1).over(before), F.lit(0))
    return each.select("doc_id", "line", start.alias("start"), (start + F.length("_t")).alias("end"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, tile, from and to of the stretches of 500 code points, every 400, of documents."""
    each = load(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("_n"), F.explode(F.expr("sequence(0, cast((length(text) - 1) div 400 as int))")).alias("tile"))
    return each.select("doc_id", "tile", (F.col("tile") * 400).alias("from"), F.least(F.col("tile") * 400 + 500, "_n").alias("to"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT doc_id, line, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(t) AS n FROM p),
t AS (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) - 1) // 400 + 1)) AS tile FROM documents WHERE length(text) > 0)
SELECT l.doc_id, CAST(line AS INTEGER) AS line, CAST(tile AS INTEGER) AS tile, CAST(greatest(s, tile * 400) AS BIGINT) AS "start", CAST(least(s + l.n, tile * 400 + 500, t.n) AS BIGINT) AS "end"
FROM l JOIN t ON t.doc_id = l.doc_id AND s < least(tile * 400 + 500, t.n) AND tile * 400 < s + l.n""")
def span_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Which lines of a document which stretches of it touch, and where."""
    met = intervals.overlaps(lines(spark, sf), tiles(spark, sf), ["doc_id"], right_span=("from", "to"))
    return met.select("l.doc_id", "l.line", "r.tile", "start", "end")


@query("""WITH s AS (SELECT custkey, o, a, b FROM (SELECT o_custkey AS custkey, o_orderkey AS o, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS a, CAST(o_orderdate AS DATE) - DATE '1990-01-01' + 1 + o_orderkey % 90 AS b FROM orders))
SELECT x.custkey, x.o AS "first", y.o AS "second", CAST(least(x.b, y.b) - greatest(x.a, y.a) AS BIGINT) AS days FROM s x JOIN s y ON x.custkey = y.custkey AND x.o < y.o AND x.a < y.b AND y.a < x.b""")
def orders_open_together(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer that are open on the same days, spans of mixed lengths."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    spans = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("o"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 90).alias("end"))
    met = intervals.overlaps(spans, spans, ["custkey"]).where("l.o < r.o")
    return met.select("l.custkey", F.col("l.o").alias("first"), F.col("r.o").alias("second"), (F.col("end") - F.col("start")).alias("days"))


def _first_words(n: int) -> str:
    return f"regexp_extract(text, '^\\S+(?:\\s+\\S+){{0,{n - 1}}}')"


#: Facts of a key: the first three words of an item as a name, what users say and what pages say as texts, urls as documents.
KEY_SQL = f"""SELECT 'name' AS kind, {_first_words(3)} AS value FROM benchmark UNION ALL SELECT 'text', text FROM conversations UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'document', url FROM pages"""


def key_facts(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda k, df, c: load(spark, sf, df).select(F.lit(k).alias("kind"), c.alias("value"))
    name = F.regexp_extract("text", r"^\S+(?:\s+\S+){0,2}", 0)
    return kind("name", "benchmark", name).union(kind("text", "conversations", F.col("text"))).union(kind("text", "documents", F.col("text"))).union(kind("document", "pages", F.col("url")))


_FIGURES = " || ".join("regexp_extract_all(value, '" + p.replace("'", "''") + "')" for p in rules.KEY_FIGURES)
_COMMON = "(" + ", ".join(f"'{w}'" for w in rules.COMMON) + ")"
NEEDLES_SQL = f"""key AS ({KEY_SQL}),
f AS (SELECT regexp_replace(regexp_replace(value, '\\(.*?\\)', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g') AS form FROM key WHERE kind = 'name'),
w AS (SELECT form, list_filter(regexp_extract_all(form, '\\b[A-Z][A-Za-z''-]{{2,}}'), lambda x: lower(x) NOT IN {_COMMON}) AS ws FROM f),
n AS (SELECT unnest({_FIGURES}) AS needle, false AS short FROM key WHERE kind = 'text' UNION ALL SELECT value, false FROM key WHERE kind = 'document'
  UNION ALL SELECT unnest(ws || [form]), false FROM w WHERE len(ws) > 0 UNION ALL SELECT form, true FROM f WHERE length(form) IN (2, 3) AND regexp_matches(form, '^\\p{{Lu}}') AND lower(form) NOT IN {_COMMON}),
needles AS (SELECT needle, bool_or(short) AS short FROM n WHERE short OR length(needle) >= 4 GROUP BY 1)"""


@query(f"WITH {NEEDLES_SQL} SELECT needle, short FROM needles")
def key_needles(spark: SparkSession, sf: str) -> DataFrame:
    """The distinctive strings of a key."""
    return needles.distinctive(key_facts(spark, sf))


@query(f"""WITH {NEEDLES_SQL}, held AS MATERIALIZED (SELECT needle, page_id, html FROM needles JOIN pages ON contains(html, needle))
SELECT needle, page_id FROM held WHERE regexp_matches(html, '(^|[^\\p{{L}}\\p{{N}}_$])' || regexp_escape(needle) || '($|[^\\p{{L}}\\p{{N}}_])')""")
def contaminated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that hold distinctive strings of the key, as whole words."""
    return needles.contaminated(needles.distinctive(key_facts(spark, sf)), load(spark, sf, "pages"), "page_id", "html").select("needle", "page_id")


def _flat(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT item_id * 10 + k AS name_id, {_flat("CASE k WHEN 1 THEN " + _first_words(1) + " WHEN 2 THEN " + _first_words(2) + " ELSE " + _first_words(3) + " END")} AS flat FROM benchmark, (SELECT unnest([1, 2, 3]) AS k)),
names AS (SELECT name_id, flat, string_split(flat, ' ') AS ws FROM n WHERE length(flat) >= 3),
t AS (SELECT doc_id, string_split({_flat("text")}, ' ') AS w FROM documents), p AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(len(w))) AS "at" FROM t),
hits AS (SELECT name_id, doc_id, "at", len(ws) AS words FROM p JOIN names ON word = ws[1] AND array_to_string(w["at" + 1:"at" + len(ws)], ' ') = flat)
SELECT name_id, doc_id, "at", CAST(words AS INTEGER) AS words FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = h.doc_id AND b.words > h.words AND b."at" <= h."at" AND h."at" + h.words <= b."at" + b.words)""")
def names_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every place where a document has the first one, two or three words of a benchmark item, the longest only."""
    ks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_extract("text", rf"^\S+(?:\s+\S+){{0,{k - 1}}}", 0).alias("name")) for k in (1, 2, 3)]))
    names = load(spark, sf, "benchmark").select("item_id", ks.alias("x")).select((F.col("item_id") * 10 + F.col("x.k")).alias("name_id"), "x.name")
    return dictionary.occurrences(names, load(spark, sf, "documents"), "name_id", "name", "doc_id", "text", longest=True)


_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH g AS (SELECT 'F' || lpad(CAST(item_id % 90 AS VARCHAR), 2, '0') AS fact_id, list_filter(string_split({_NORM.format("text")}, ' '), lambda w: length(w) > 4)[1:6] AS ws FROM benchmark),
f AS (SELECT lpad(CAST(doc_id % 50 AS VARCHAR), 2, '0') || '_' || doc_id AS doc_id, {_NORM.format("text")} AS blob FROM documents),
hits AS (SELECT DISTINCT fact_id, doc_id FROM g JOIN f ON len(list_filter(ws, lambda w: contains(blob, w))) >= greatest(2, len(ws) // 3) WHERE len(ws) > 0),
traps AS (SELECT item_id AS trap_id, lpad(CAST(item_id % 10 AS VARCHAR), 2, '0') AS "primary", 'F' || lpad(CAST(item_id % 90 AS VARCHAR), 2, '0') AS fact_id FROM benchmark),
each AS (SELECT trap_id, hits.fact_id, doc_id, starts_with(doc_id, "primary" || '_') AS ok FROM traps JOIN hits USING (fact_id))
SELECT t.trap_id, count(DISTINCT e.fact_id) AS matched, count(DISTINCT e.doc_id) AS cited, coalesce(bool_or(ok), false) AS cited_primary FROM (SELECT DISTINCT trap_id FROM traps) t LEFT JOIN each e USING (trap_id) GROUP BY 1""")
def sourcing_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as gold facts, each with a trap that names its document of record; documents as what was found."""
    b, k = load(spark, sf, "benchmark"), F.col("item_id")
    fact = F.concat(F.lit("F"), F.lpad((k % 90).cast("string"), 2, "0"))
    inventory = b.select(k.alias("trap_id"), F.concat(F.lit("The primary source is doc "), (k % 10).cast("string"), F.lit(" for "), fact).alias("text"))
    d = load(spark, sf, "documents").select(F.concat(F.lpad((F.col("doc_id") % 50).cast("string"), 2, "0"), F.lit("_"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("quote"), F.lit("").alias("object_name"))
    found = grading.sourcing(inventory, b.select(fact.alias("fact_id"), "text"), d)
    return found.select("trap_id", F.size("matched").cast("long").alias("matched"), F.size("cited").cast("long").alias("cited"), "cited_primary")


@query("""WITH e AS (SELECT o_orderkey AS k, unnest([1, 2]) AS number, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END, 'a']) AS want, unnest(['a', CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END]) AS found, unnest([o_orderkey % 5, 3]) AS weighed FROM orders),
g AS (SELECT k, number, CASE WHEN want <> found THEN 'mislabelled' WHEN weighed = 0 THEN 'not weighed' ELSE 'credited' END AS grade FROM e)
SELECT k, count(*) FILTER (grade = 'credited') AS credited, 2 AS wanted, count(*) FILTER (grade = 'credited') = 2 AND k % 7 > 0 AS passed FROM g GROUP BY 1""")
def report_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Drafted reports of two allegations for every order: labels beside the key, elements weighed, and a summary that may say
    otherwise."""
    k, label = F.col("o_orderkey"), lambda c: F.when(c, "Substantiated").otherwise("Not substantiated")
    o = load(spark, sf, "orders").select(k.alias("k"), label(F.lit(True)).alias("one"), label(k % 3 != 0).alias("two"))
    second = F.when(F.col("k") % 7 == 0, label(F.col("two") != "Substantiated")).otherwise(F.col("two"))
    text = F.concat(F.lit("# Summary\n| No | Allegation | Disposition | Basis |\n|---|:--|---|---|\n| 1 | it | **"), "one", F.lit("** | "), (F.col("k") % 5).cast("string"), F.lit(" of 5 elements weighed |\n| 2 | that | "), second, F.lit(" | 3 of 3 elements |\n\n| 9 | x | y |"))
    reports = o.select("k", text.alias("text"))
    findings = o.select("k", F.explode(F.array(F.struct(F.lit(1).alias("number"), F.col("one").alias("disposition")), F.struct(F.lit(2).alias("number"), F.col("two").alias("disposition")))).alias("f")).select("k", "f.*", F.lit("").alias("note"))
    expected = o.select("k", F.explode(F.array(F.struct(F.lit(1).alias("number"), label(F.col("k") % 2 == 0).alias("expected")), F.struct(F.lit(2).alias("number"), F.lit("SUBSTANTIATED").alias("expected")))).alias("e")).select("k", "e.*")
    grades = grading.graded(expected, findings, grading.summary_rows(reports, "k", "text"), "k")
    return grading.passed(grades, findings, "k").withColumn("wanted", F.col("wanted").cast("int"))
