"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time for each pass over its source: the words of its source up to and with
it, divided by the source's target. A global order by that time, cut at the total budget, takes each source in
proportion. Running sums are taken in two levels (sums of buckets of a bounded number of rows, then rows within a
bucket), so no task holds a whole source, whatever its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target's most, in sizes of its source.
MOST = 3
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of a running sum, on average, and the most buckets (their sums are one group).
BUCKET_ROWS, MOST_BUCKETS = 2048, 1 << 20


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """source, source_size and target of each row of sizes (source, source_size): water filling of the budget (None: the
    total) by weight, no target above `most` times its source's size.

    Sources reach that limit in the order of limit / weight. If all before one have reached it, the level (words for a
    weight of 1) is what is left over the weights from it on; the first source whose limit is not below that level sets
    the level of all that follow. The windows hold a row for each source, not for each document."""
    place = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy("ratio", F.asc_nulls_last("source"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) if budget is None else F.lit(budget)
    found = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    found = found.withColumn("level", (total.cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    found = found.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    return found.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows before each one, within keys, ordered by bucket and then order."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in (*keys, bucket)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    match = F.lit(True)
    for k in (*keys, bucket):
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(sums, match).select(*df.columns, (F.col("_within") + F.col("_ahead")).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, text: str = "text", budget: int | None = None, identity: Column | None = None) -> DataFrame:
    """doc_id, source, h (hash of row: of identity, a 64-bit column, where given, else of doc_id and text), size, source_size, target and taken for each row of docs (doc_id, source, text).

    budget: words to take in all (None: as many as the documents have). Null and empty texts have size 0 and are never
    taken. Null sources are one source, the last. Equal rows stay rows of their own. No document is taken more than
    `most` times; one that the budget's end cuts is taken in part. An empty table gives no rows."""
    if identity is None:  # 60 bits that SQL engines agree on
        told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
        identity = F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), identity.alias("h"))
    rows = common.materialize(rows, "mix-sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, budget)
    count, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    words = words if budget is None else budget
    n = min(max(64, count // BUCKET_ROWS), MOST_BUCKETS)
    placed = running(rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(n))), ["source"], "bucket", ["h", "doc_id"], "size", "ahead")
    goal = goal.withColumnRenamed("source", "_source")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bucket")
    # a copy for each pass; a source reaches its target at virtual time 1
    turn = F.col("pass") * F.col("source_size") + F.col("ahead")
    copies = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("start", F.when(F.col("target") > 0, turn / F.col("target")).otherwise(2.0)).withColumn("finish", F.when(F.col("target") > 0, (turn + F.col("size")) / F.col("target")).otherwise(2.0))
    row = ["doc_id", "source", "h", "size", "ahead", "source_size", "target"]
    idle = copies.where("start >= 1 and pass = 0")
    copies = copies.where("start < 1").withColumn("slot", F.least(F.floor(F.col("finish") * n), F.lit(2 * n)).cast("long")).withColumn("queue", F.lit(0))
    queued = running(copies, ["queue"], "slot", ["finish", "h", "doc_id", "ahead", "pass"], "size", "before")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.lit(words) - F.col("before")))
    taken = queued.groupBy(*row).agg(F.sum(part).cast("long").alias("taken"))
    none = placed.where("size = 0").select(*row).unionByName(idle.select(*row))
    return taken.unionByName(none.withColumn("taken", F.lit(0).cast("long"))).drop("ahead")


def take(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole pass, and one with the first words of the text for the rest of
    what is taken. All columns of docs stay; rows that are not taken go.

    A row is told by a hash of all its columns (maps as JSON), so rows that differ in any of them, the source too, are taken as
    they are; rows equal in all are alike, and each of them may stand for the others."""
    seed, text = options.get("seed", 17), options.get("text", "text")
    docs, back = common.apart(docs, "doc_id", "source", text)
    name = lambda f: f"`{f.name}`"
    plain = [F.to_json(name(f)) if "map<" in f.dataType.simpleString() else F.col(name(f)).cast("string") if f.dataType.simpleString() in ("variant", "void") else F.col(name(f)) for f in docs.schema.fields]
    # a null is told from a zero or an empty value beside it
    own = F.xxhash64(F.lit(seed), F.concat_ws("", *[F.col(name(f)).isNull().cast("int").cast("string") for f in docs.schema.fields]), *plain)
    took = mix(docs, identity=own, **options).where("taken > 0").groupBy("h", "size").agg(F.sum("taken").alias("_tw_taken"))
    took = took.select(F.col("h").alias("_tw_h"), F.col("size").alias("_tw_size"), "_tw_taken")
    rows = docs.withColumn("_tw_key", own).dropDuplicates(["_tw_key"]).join(took, F.col("_tw_key") == F.col("_tw_h"))
    passes = F.ceil(F.col("_tw_taken") / F.col("_tw_size")).cast("int")
    rows = rows.withColumn("_tw_pass", F.explode(F.sequence(F.lit(1), passes)))
    rest = (F.col("_tw_taken") - (F.col("_tw_pass") - 1) * F.col("_tw_size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    return back(rows.withColumn(text, F.when(rest < F.col("_tw_size"), first).otherwise(F.col(text))))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
m AS (SELECT greatest(64, count(*) // 2048) AS n, CAST(sum(size) AS BIGINT) AS total FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS lim FROM s),
l AS (SELECT *, lim / weight AS ratio, ((SELECT total FROM m) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(lim, coalesce(weight * (SELECT max(level) FROM l WHERE ratio >= level), lim)) AS target FROM l),
p AS (SELECT row_number() OVER () AS rid, d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY (h >> 20) % (SELECT n FROM m), h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (turn + size) / target AS finish FROM (SELECT *, CAST(pass * source_size + ahead AS DOUBLE) AS turn FROM (SELECT *, unnest([0, 1, 2]) AS pass FROM p WHERE size > 0 AND target > 0)) WHERE turn / target < 1),
q AS (SELECT rid, least(size, greatest(0, (SELECT total FROM m) - coalesce(sum(size) OVER (ORDER BY finish, h, doc_id NULLS FIRST, ahead, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part FROM c)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(part), 0) AS BIGINT) AS taken FROM p LEFT JOIN q USING (rid) GROUP BY rid, doc_id, size, source_size, target
"""
