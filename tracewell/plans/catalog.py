"""The query catalog: name to query, and the SQL each one is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions.kernels import SHORT, sentence_count_udf
from ..operators import assertions, consensus, corpus, entities, evaluate, graph, links, passages, report, routing
from ..streaming import sessions, state
from .evidence import TRIPLES_SQL, load, triples
from .registry import ORACLES, QUERIES, query  # noqa: F401

def _case(column: str, patterns: list[tuple[str, str]], otherwise: str) -> str:
    """SQL of the first pattern that matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for label, p in patterns) + f" ELSE {otherwise} END"


WITH = f"WITH {TRIPLES_SQL} "


@query(WITH + """SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, entity_id LIMIT 1500""")
def graph_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_vertices(triples(spark, sf), 1500)


@query(WITH + """, top AS (SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, entity_id LIMIT 1000)
SELECT src, dst, rel, event_date, doc_id, page_num FROM edges WHERE src IN (SELECT entity_id FROM top) AND dst IN (SELECT entity_id FROM top)""")
def graph_snapshot_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    return graph.edges_within(rows, graph.top_vertices(rows, 1000)).select("src", "dst", "rel", "event_date", "doc_id", "page_num")


@query(WITH + """SELECT 'out' AS direction, dst AS other, predicate, event_date, doc_id, page_num FROM edges WHERE src = 'LOCATION:' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)
UNION ALL SELECT 'in', src, predicate, event_date, doc_id, page_num FROM edges WHERE dst = 'LOCATION:' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) AND src <> dst""")
def entity_detail(spark: SparkSession, sf: str) -> DataFrame:
    name = load(spark, sf, "nation").where("n_nationkey = 3").select(F.lower("n_name")).first()[0]
    return graph.entity_detail(graph.edges(triples(spark, sf)), f"LOCATION:{name}")


@query(WITH + """SELECT event_date, subject_name, predicate, object_name, doc_id, page_num FROM triples WHERE coalesce(event_date, '') <> ''""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return graph.timeline(triples(spark, sf))


@query("""WITH e AS (SELECT CAST(ts AS VARCHAR) AS t, user_id, event_type, event_id FROM events)
SELECT substr(t, 1, 10) AS day, 'user ' || user_id AS subject, lower(trim(event_type)) AS predicate, 'site' AS object, max_by(substr(t, 1, 16), substr(t, 1, 16)) AS event_date, count(*) AS said, count(DISTINCT event_id % 5) AS sources
FROM e GROUP BY 1, 2, 3, 4""")
def merged_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    rows = e.select(F.substring(F.col("ts").cast("string"), 1, 16).alias("event_date"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("subject_name"), F.col("event_type").alias("predicate"), F.lit("site").alias("object_name"), F.lit("log").alias("doc_id"), (F.col("event_id") % 5).alias("page_num"))
    return graph.merged_timeline(rows)


@query(WITH + """, v AS (SELECT DISTINCT subject_type AS entity_type, subject_name AS name, src AS entity_id FROM ids UNION SELECT object_type, object_name, dst FROM ids),
k AS (SELECT entity_id FROM v WHERE entity_type IN ('PERSON', 'LOCATION') AND (lower(name) LIKE '%a%'))
SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT entity_id FROM k) AND dst IN (SELECT entity_id FROM k) GROUP BY rel""")
def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    v = graph.mentions(t).select("entity_type", "name", graph.entity_id(F.col("entity_type"), F.col("name")).alias("entity_id")).distinct()
    return graph.visible(v, graph.edges(t), ["PERSON", "LOCATION"], "a").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orphan_sweep(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"))
    e = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return corpus.orphans(v, e).select(F.col("entity_id").alias("o_orderkey"))


@query("""SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def upload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return corpus.dedup_content(docs, "content", "doc_id", "doc_id")


@query(f"""WITH s AS (SELECT doc_id, source, concat_ws(chr(10), source, substr(text, 1, 1200)) AS head, coalesce(substr(text, 1, 2500), '') AS t FROM documents)
SELECT doc_id, {_case("head", rules.KINDS, "'unknown'")} AS doc_kind, {_case("t", rules.ROLES, _case("lower(coalesce(source, ''))", rules.ROLE_NAMES, "'witness'"))} AS doc_role FROM s""")
def kind_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and role of every document by its source and the head of its text."""
    return corpus.classify(load(spark, sf, "documents"), "source", "text").select("doc_id", "doc_kind", "doc_role")


@query("""SELECT d.doc_id, coalesce(p.n, 0) AS pages_with_text, coalesce(l.n, 0) AS assertions FROM documents d
LEFT JOIN (SELECT page_id AS doc_id, count(*) AS n FROM pages WHERE html <> '' GROUP BY 1) p USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)""")
def corpus_state(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_state(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), load(spark, sf, "labels").select("doc_id"))


@query("""WITH s AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'text_only' ELSE 'processing' END AS status, o_orderkey % 6 AS said, coalesce(n, 0) AS had
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT doc_id, CASE WHEN status = 'processing' THEN 'not finished' WHEN status = 'text_only' THEN 'never analysed' ELSE 'assertions lost' END AS fault FROM s WHERE status <> 'done' OR said > had""")
def blocking_faults(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("assertions"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "text_only").otherwise("processing")
    docs = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"), F.concat((F.col("o_orderkey") % 6).cast("string"), F.lit(" assertions")).alias("progress"))
    return corpus.blocking_faults(docs.join(n, "doc_id", "left").na.fill(0, ["assertions"]))


@query("""WITH s AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 10 = 1 THEN 'incomplete' ELSE 'done' END AS status, c_custkey % 3 AS assertions FROM customer)
SELECT doc_id, CASE WHEN status <> 'done' THEN status WHEN assertions = 0 THEN 'no assertions' ELSE 'not cited' END AS reason FROM s
WHERE status <> 'done' OR assertions = 0 OR doc_id NOT IN (SELECT o_custkey FROM orders)""")
def silent_documents(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    state = load(spark, sf, "customer").select(key.alias("doc_id"), F.when(key % 10 == 0, "failed").when(key % 10 == 1, "incomplete").otherwise("done").alias("status"), (key % 3).alias("assertions"))
    return corpus.silent_documents(state, load(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id")))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM labels) AS assertions, (SELECT count(*) FROM customer) AS entities""")
def counters(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.counters(documents=load(spark, sf, "documents"), pages=load(spark, sf, "pages"), assertions=load(spark, sf, "labels"), entities=load(spark, sf, "customer"))


@query("""WITH s AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'and') AS INT) + CAST(contains(t, 'idiot') AS INT) + CAST(contains(t, 'worthless') AS BIGINT) AS score FROM s
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return passages.keyword_search(load(spark, sf, "documents"), "the and, idiot? worthless!", 40, "doc_id")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) AS score FROM embeddings v, q ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    return passages.vector_search(v, v.where("vec_id = 7").first()["embedding"], 20, "vec_id", "embedding")


@query("""SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) >= 0.3""")
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return passages.near_pairs(load(spark, sf, "embeddings"), "label", 0.3, "vec_id", "embedding")


@query("""WITH s AS (SELECT l_suppkey AS id, l_orderkey AS doc, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem)
SELECT DISTINCT a, b FROM (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.doc = y.doc AND x.id < y.id UNION ALL SELECT x.id, y.id FROM s x JOIN s y ON x.day = y.day AND x.id < y.id)""")
def connected_pairs(spark: SparkSession, sf: str) -> DataFrame:
    seen = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_shipdate").cast("date").cast("string").alias("day"))
    return links.connected(seen)


@query("""WITH r AS (SELECT CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 25) AS BIGINT) AS block FROM customer), s AS (SELECT block, count(*) AS n FROM r GROUP BY 1)
SELECT a.block AS block_a, b.block AS block_b, CAST(CASE WHEN a.block = b.block THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS BIGINT) AS pairs FROM s a JOIN s b ON a.block <= b.block""")
def link_windows(spark: SparkSession, sf: str) -> DataFrame:
    return links.windows(links.blocks(load(spark, sf, "customer").select("c_custkey"), "c_custkey"))


@query("""SELECT event_id, event_type, turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) WHERE turn <= 50 ORDER BY turn, event_type LIMIT 50""")
def link_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    return links.round_robin(e, "event_type", [F.desc("value"), F.col("event_id")], 50).select("event_id", "event_type", F.col("turn").cast("long").alias("turn"))


@query("""SELECT n_name AS kind, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, CAST(ceil((n * (n - 1) / 2 - n) / 25) AS BIGINT) AS calls FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def link_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sizes = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return links.estimate(sizes.withColumn("judged", F.col("n")))


@query("""SELECT CAST(s_suppkey + 1 AS INT) AS number, 'same ' || (s_suppkey % 3) AS relation, 'A' AS side, CAST(0.75 AS DOUBLE) AS confidence, s_name AS basis FROM supplier""")
def link_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The answer on every supplier, numbered from 1: each reply is asked up to its supplier's number and has a line beyond it."""
    key, n = F.col("s_suppkey"), F.col("s_suppkey") + 1
    lines = [F.format_string("%d. Same %d | A | 0.75 | %s", n, key % 3, "s_name"), F.format_string("%d. repeated | B | 0.5 | late", n), F.format_string("%d. beyond | B | 0.5 | not asked", n + 1), F.lit("nonsense")]
    reply = load(spark, sf, "supplier").select(n.alias("asked"), F.concat_ws("\n", *lines).alias("reply"))
    return links.parse_answers(reply).select("number", "relation", "side", "confidence", "basis")


@query("""SELECT p_name AS label, count(*) AS mentions, 'DOCUMENT:' || lower(p_name) AS entity_id FROM part GROUP BY 1""")
def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "part").select(F.lit("DOCUMENT").alias("entity_type"), F.col("p_name").alias("name"))
    return entities.entities(entities.with_ids(m, exact=False)).select("label", "mentions", "entity_id")


@query("""SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(p_name), '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda t: t NOT IN ('mr', 'jr')), ' ') AS norm FROM part""")
def entity_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", C.normalize_name(F.col("p_name"), ("mr", "jr")).alias("norm"))


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 16 = 0 THEN NULL WHEN (SELECT count(*) FROM customer x WHERE x.c_custkey = c.c_custkey - 1) = 1 THEN c_custkey - 1 END AS up FROM customer c),
r AS (SELECT id, id AS pos FROM p UNION ALL SELECT r.id, p.up FROM r JOIN p ON r.pos = p.id WHERE p.up IS NOT NULL)
SELECT id AS node, min(pos) AS root FROM r GROUP BY id""")
def merge_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey")
    low = c.agg(F.min("c_custkey")).first()[0]
    return entities.resolve(c.select("c_custkey", F.when((F.col("c_custkey") % 16 == 0) | (F.col("c_custkey") == low), None).otherwise(F.col("c_custkey") - 1).alias("up")), "c_custkey", "up")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, -l_orderkey - 1 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u
  UNION (SELECT u.a, min(n.component) FROM r n JOIN u ON u.b = n.node JOIN recurring.r c ON c.node = u.a WHERE n.component < c.component GROUP BY u.a))
SELECT node, component FROM r""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all suppliers and orders (as -key - 1)."""
    li = load(spark, sf, "lineitem")
    return entities.components(li.select(F.col("l_suppkey").alias("a"), (-F.col("l_orderkey") - 1).alias("b")))


@query("""SELECT conv_id, turn, CASE WHEN turn - max(CASE WHEN role = 'system' THEN turn END) OVER w <= 1 THEN conv_id || ':' || max(CASE WHEN role = 'system' THEN turn END) OVER w END AS carried
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def routing_carry(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    marked = c.select("conv_id", "turn", F.when(F.col("role") == "system", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("marker"))
    return routing.carry(marked, "conv_id", "turn", "marker").select("conv_id", "turn", "carried")


@query(WITH + """, t AS (SELECT unnest(['1', '2', '9']) AS target)
SELECT target, count(*) AS rows, target = '9' AND count(*) FILTER (allegation_ref IS NULL) = 0 AS guarded FROM triples, t WHERE (allegation_ref IS NULL OR allegation_ref = target) GROUP BY target""")
def routing_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf).select(F.when(F.col("allegation_ref").isNull(), F.array().cast("array<string>")).otherwise(F.array("allegation_ref")).alias("refs"), F.col("allegation_ref").isNull().alias("unrestricted"))
    targets = spark.createDataFrame([("1",), ("2",), ("9",)], "target string")
    return routing.route(rows, targets).groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("guarded").alias("guarded"))


@query("""WITH s AS (SELECT conv_id, turn AS a, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 1000) AS b FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, s.a AS ref FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND c.turn >= s.a AND c.turn < s.b""")
def span_stabbing(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    spans = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("ref"), F.col("turn").alias("start"), F.coalesce(after, F.col("turn") + 1000).alias("end"))
    return routing.stab(c.select("conv_id", "turn"), spans, ["conv_id"], "turn")


ISLANDS_SQL = """WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_type, min(n) AS "first", max(n) AS "last", string_agg(CAST(event_id AS VARCHAR), '' ORDER BY n) AS joined FROM n GROUP BY user_id, event_type, i"""


@query(ISLANDS_SQL)
def token_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.collapse_tokens(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@query(ISLANDS_SQL)
def token_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream with state, in micro-batches."""
    found = state.replayed(spark, load(spark, sf, "events"), "user_id", "ts", ["event_id"], "event_type", "event_id", late="10 minutes", quiet="100 days")
    return found.withColumnRenamed("kind", "event_type")



@query("""WITH n AS (SELECT p_partkey, substr(trim(regexp_replace(upper(p_type || ' ' || p_brand), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 60) AS r FROM part) SELECT p_partkey, CASE WHEN r = '' THEN 'RELATED_TO' WHEN r SIMILAR TO '[0-9].*' THEN 'R_' || r ELSE r END AS rel FROM n""")
def rel_type(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", C.rel_type(F.concat_ws(" ", "p_type", "p_brand")).alias("rel"))


@query("""WITH q AS (SELECT doc_id * 2 AS item_id, doc_id % 50 AS k, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id * 2 + 1, doc_id % 50, substr(coalesce(text, ''), 5, 200) FROM documents),
f AS (SELECT item_id, k, lower(trim(regexp_replace(t, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))) AS flat FROM q)
SELECT item_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.k = b.k AND contains(b.flat, a.flat) AND (length(b.flat) > length(a.flat) OR length(b.flat) = length(a.flat) AND b.item_id < a.item_id))""")
def assertion_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and a cut of it as quotes of fifty assertions."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = d.select((F.col("doc_id") * 2).alias("item_id"), "doc_id", "t").union(d.select(F.col("doc_id") * 2 + 1, "doc_id", F.substring("t", 5, 200)))
    rows = rows.select("item_id", F.col("t").alias("quote"), F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string")).alias("subject_name"), *[F.lit("x").alias(c) for c in ("subject_type", "predicate", "object_type", "object_name")], F.lit(None).cast("string").alias("event_date"))
    return assertions.dedupe(rows, "item_id").select("item_id")


@query("""SELECT o_orderkey, CAST(d AS VARCHAR) AS event_date FROM (SELECT o_orderkey, unnest([CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 40]) AS d FROM orders)""")
def date_series_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _series(load(spark, sf, "orders"))


def _series(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    say = lambda d: F.date_format(d, "d MMMM yyyy")
    rows = o.select("o_orderkey", F.concat(F.lit("Goods came on "), say(F.col("d")), F.lit(" and again on "), say(F.date_add("d", 40))).alias("quote"), F.lit(None).cast("string").alias("event_date"), F.lit(None).cast("string").alias("event_date_basis"))
    return assertions.expand_series(rows).select("o_orderkey", "event_date")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T09:30' ELSE strftime(o_orderdate, '%Y-%m') END AS event_date,
CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 2 THEN 'minute' ELSE 'month' END AS event_precision FROM orders""")
def date_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("on "), d("yyyy-MM-dd"), F.lit(", early"))).when(k == 1, d("yyyy-MM")).when(k == 2, F.concat(d("yyyy-MM-dd"), F.lit(" 0930"))).otherwise(F.concat(F.lit("in "), d("MMMM yyyy")))
    return load(spark, sf, "orders").select("o_orderkey", C.normalize_when(raw).alias("event_date")).withColumn("event_precision", C.date_precision(F.col("event_date")))


@query()
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_num"), "text")
    return passages.chunk(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '([\\p{L}\\p{N}_]*)([.!?]+)\\s+', 1) AS w, regexp_extract_all(coalesce(text, ''), '([\\p{L}\\p{N}_]*)([.!?]+)\\s+', 2) AS p FROM documents),
b AS (SELECT *, list_transform(list_zip(w, p), lambda x: NOT (x[2][1] = '.' AND (lower(x[1]) IN (%s) OR regexp_full_match(x[1], '\\p{Lu}')))) AS breaks FROM t)
SELECT doc_id, CAST(len(list_filter(breaks, lambda x: x)) + CASE WHEN regexp_full_match(text, '\\s*') OR regexp_matches(text, '[.!?]\\s+$') AND breaks[-1] THEN 0 ELSE 1 END AS INTEGER) AS sentences FROM b""" % ", ".join(f"'{w}'" for w in sorted(SHORT)))
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", sentence_count_udf("text").alias("sentences"))


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(c) AS votes, sum(c) AS runs FROM c GROUP BY 1)
SELECT m.l_partkey, m.votes, CAST(m.runs AS BIGINT) AS runs, CASE WHEN count(*) = 1 THEN min(c.l_returnflag) END AS modal FROM m JOIN c ON c.l_partkey = m.l_partkey AND c.c = m.votes GROUP BY 1, 2, 3""")
def consensus_mode(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.modes(load(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@query("""WITH p AS (SELECT l_partkey, l_linestatus, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, count(*) FILTER (k = n) AS shared, count(*) AS cited, count(*) FILTER (k = n) = count(*) AS stable FROM p JOIN r USING (l_partkey) GROUP BY 1""")
def evidence_stability(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.stability(load(spark, sf, "lineitem"), "l_partkey", "l_returnflag", "l_linestatus")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, bool_and(l_returnflag <> 'R') AS met FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2 HAVING bool_and(l_returnflag <> 'R') = bool_or(l_returnflag <> 'R')),
p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, count(*) AS k, bool_and(met) AS m FROM e GROUP BY 1)
SELECT p.l_orderkey, CASE WHEN NOT m THEN 'negative' WHEN k = n THEN 'affirmative' ELSE 'undetermined' END AS disposition FROM p LEFT JOIN w USING (l_orderkey)""")
def required_disposition(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("element"), (F.col("l_returnflag") != "R").alias("met"), "l_quantity")
    return report.required_disposition(li.where("l_quantity > 5"), "l_orderkey", li.select("l_orderkey", "element").distinct())


@query("""SELECT s_suppkey, s_name AS name, CAST(unnest(range(s_suppkey % 9 + 1, s_suppkey % 9 + 4)) AS INT) AS page FROM supplier""")
def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey") % 9
    text = load(spark, sf, "supplier").select("s_suppkey", F.format_string("It was so [%s p.%d] and then [see note] [%s pp. %d-%d].", "s_name", n + 1, "s_name", n + 2, n + 3).alias("text"))
    return report.citations(text, "s_suppkey", "text")


@query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.contamination(load(spark, sf, "benchmark"), load(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars >= 400), l AS (SELECT doc_id, quality FROM labels)
SELECT count(*) FILTER (p.doc_id IS NOT NULL AND quality = 1) AS tp, count(*) FILTER (p.doc_id IS NOT NULL AND quality = 0) AS fp, count(*) FILTER (p.doc_id IS NULL AND quality = 1) AS fn FROM l LEFT JOIN p USING (doc_id)""")
def eval_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    labels = load(spark, sf, "labels")
    found = load(spark, sf, "documents").where("n_chars >= 400").join(labels, "doc_id", "left_semi")
    return evaluate.precision_recall(found, labels.where("quality = 1"), "doc_id")


@query(WITH + """, t AS (SELECT *, CASE WHEN predicate = 'placed' THEN 'stated' END AS basis, (SELECT count(DISTINCT n) FROM (SELECT subject_name AS n FROM triples WHERE subject_type = 'PERSON' UNION SELECT object_name FROM triples WHERE object_type = 'PERSON')) AS roster FROM triples)
SELECT unnest(['require_predicate', 'forbid_predicate', 'forbid_entity', 'require_entity', 'forbid_date', 'forbid_date', 'forbid_exact_stated_date', 'forbid_exact_stated_date', 'require_quote_substr', 'entity_roster_max', 'entity_roster_min']) AS rule,
unnest(['placed|supplied', '^stole', 'order 7$', 'ORDER 7$', '1992', '19', 'x', 'y', 'Based In', '100', '100']) AS pattern,
unnest([count(*) FILTER (predicate IN ('placed', 'supplied')) > 0, count(*) FILTER (predicate LIKE 'stole%') = 0, count(*) FILTER (regexp_matches(subject_name, 'order 7$') OR regexp_matches(object_name, 'order 7$')) = 0,
count(*) FILTER (regexp_matches(subject_name, 'order 7$') OR regexp_matches(object_name, 'order 7$')) > 0, count(*) FILTER (predicate = 'based in' AND event_date LIKE '1992%') = 0, count(*) FILTER (event_date LIKE '19%') = 0,
count(*) FILTER (predicate = 'supplied' AND length(event_date) >= 10 AND basis = 'stated') = 0, count(*) FILTER (length(event_date) >= 10 AND basis = 'stated') = 0, count(*) FILTER (contains(lower(quote), 'based in')) > 0, max(roster) <= 100, max(roster) >= 100]) AS passed FROM t""")
def mechanics_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All nine kinds of rules in one pass."""
    t = triples(spark, sf).withColumn("event_date_basis", F.when(F.col("predicate") == "placed", "stated"))
    rules_of = [("require_predicate", "placed|supplied", None), ("forbid_predicate", "^stole", None), ("forbid_entity", "order 7$", None), ("require_entity", "ORDER 7$", None), ("forbid_date", "1992", "^based"), ("forbid_date", "19", None), ("forbid_exact_stated_date", "x", "supplied"), ("forbid_exact_stated_date", "y", None), ("require_quote_substr", "Based In", None), ("entity_roster_max", "100", None), ("entity_roster_min", "100", None)]
    return evaluate.rules_hold(t, rules_of)


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def title_extract(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", C.page_title(F.col("html")).alias("title"))


@query("""WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS started, count(*) AS events FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(load(spark, sf, "events")).select("user_id", F.col("session.start").cast("string").alias("started"), "events")


@query("""WITH n AS (SELECT c_custkey, 'orders-' || (c_custkey % 50) AS name FROM customer) SELECT c_custkey, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS k FROM n)""")
def name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit("orders-"), (F.col("c_custkey") % 50).cast("string")).alias("name"))
    return corpus.distinct_names(c, "name", "c_custkey").select("c_custkey", "unique_name")


@query("""SELECT conv_id AS doc_id, string_agg('--- page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS transcript FROM conversations GROUP BY 1""")
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.transcripts(load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text"))


@query(WITH + """, m AS (SELECT subject_type AS entity_type, subject_name AS name, doc_id FROM triples UNION ALL SELECT object_type, object_name, doc_id FROM triples)
SELECT entity_type, name, count(DISTINCT doc_id) AS files, count(*) AS mentions FROM m GROUP BY 1, 2 ORDER BY mentions DESC, name LIMIT 40""")
def entities_block(spark: SparkSession, sf: str) -> DataFrame:
    return report.entities_block(graph.mentions(triples(spark, sf)))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 12))) AS word FROM documents) SELECT word, 1 / count(DISTINCT doc_id) AS weight FROM w GROUP BY 1""")
def rare_words(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 12))).alias("word"))
    return evaluate.rare_weight(w, "doc_id", "word")


@query("""WITH l AS (SELECT user_id, max_by(event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || event_type) AS value, max(ts) AS latest FROM events GROUP BY 1) SELECT 'user ' || user_id AS "key", value, CAST(latest AS VARCHAR) AS updated_at FROM l""")
def settings_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    kv = e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("updated_at"))
    return corpus.latest(kv).select("key", "value", F.col("updated_at").cast("string").alias("updated_at"))


from . import catalog_joins, catalog_rules, catalog_store  # noqa: E402, F401  register the rest
