"""Documents and pages: uploads, statuses, counters, faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..schemas import TERMINAL

def dedup_content(files: DataFrame, content: str, order: str, *keep: str) -> DataFrame:
    """One row of each content: sha256, copies, and of the first by order the columns of keep. One shuffle, partial before."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), *[F.min_by(c, order).alias(c) for c in keep])


def classify(docs: DataFrame, name: str, text: str) -> DataFrame:
    """docs with doc_kind (name and first 1200 characters) and doc_role (first 2500 characters, then the name)."""
    head = F.concat_ws("\n", F.col(name), F.substring(text, 1, 1200))
    role = C.first_match(F.coalesce(F.substring(text, 1, 2500), F.lit("")), rules.ROLES, "")
    by_name = C.first_match(F.lower(F.coalesce(name, F.lit(""))), rules.ROLE_NAMES, rules.NO_ROLE)
    return docs.withColumn("doc_kind", C.first_match(head, rules.KINDS, "unknown")).withColumn("doc_role", F.when(role != "", role).otherwise(by_name))


def counters(**tables: DataFrame) -> DataFrame:
    """One row: the count of each table, each one pass over no column."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, F.lit(True))  # single rows
    return out


def corpus_state(docs: DataFrame, pages: DataFrame, triples: DataFrame) -> DataFrame:
    """docs with pages_with_text and assertions, aggregated before they are joined."""
    p = pages.where("text is not null and text <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_with_text"))
    t = triples.groupBy("doc_id").agg(F.count(F.lit(1)).alias("assertions"))
    return docs.join(p, "doc_id", "left").join(t, "doc_id", "left").na.fill(0, ["pages_with_text", "assertions"])


def blocking_faults(state: DataFrame) -> DataFrame:
    """doc_id and fault of the documents that a report must wait for."""
    recorded = F.regexp_extract("progress", r"(\d+) assertion", 1).try_cast("long")
    fault = F.when(~F.col("status").isin(*TERMINAL), "not finished").when(F.col("status") == "text_only", "never analysed").when((F.col("status") == "done") & (recorded > F.col("assertions")), "assertions lost")
    return state.select("doc_id", fault.alias("fault")).where("fault is not null")


def silent_documents(state: DataFrame, contributing: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id and reason of finished documents that a report says nothing from, and of documents that came after its snapshot."""
    from .ledger import arrived_since

    used = contributing.select("doc_id").distinct().withColumn("used", F.lit(True))
    reason = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "incomplete", "incomplete").when(F.col("assertions") == 0, "no assertions").when(F.col("used").isNull(), "not cited")
    out = state.where(F.col("status").isin("done", "failed", "incomplete")).join(used, "doc_id", "left").select("doc_id", reason.alias("reason")).where("reason is not null")
    return out if documents is None else out.unionByName(arrived_since(documents, state))


def set_status(docs: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """docs with updates (doc_id, new_status, new_stage): stage stays where none is given, started once, finished at an end."""
    rows = docs.join(updates, "doc_id", "left")
    hit = F.col("new_status").isNotNull()
    return rows.select(
        *[c for c in docs.columns if c not in ("status", "stage", "started_at", "finished_at")],
        F.coalesce("new_status", "status").alias("status"), F.coalesce("new_stage", "stage").alias("stage"),
        F.when(hit & (F.col("new_status") == "processing"), F.coalesce("started_at", F.lit(now))).otherwise(F.col("started_at")).alias("started_at"),
        F.when(hit & F.col("new_status").isin(*TERMINAL), F.lit(now)).otherwise(F.col("finished_at")).alias("finished_at"),
    ).select(*docs.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; values of new where they are not null, else those of old."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest])


def latest(settings: DataFrame) -> DataFrame:
    """The last value of each key."""
    return settings.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at"))


def annex(pages: DataFrame, extra: DataFrame) -> DataFrame:
    """pages and, after each document's last page, the texts of extra (doc_id, ord, text)."""
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("_last"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    more = extra.join(last, "doc_id", "left").select("doc_id", (F.coalesce("_last", F.lit(0)) + place).alias("page_num"), "text")
    return pages.unionByName(more, allowMissingColumns=True)


def delete_document(doc_id: str, vertices: DataFrame, edges: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """All tables without the document, and the graph without its edges and the vertices that then have none."""
    out = {n: t.where(F.col("doc_id") != doc_id) for n, t in tables.items()}
    left = edges.where(F.col("doc_id") != doc_id)
    return out | {"edges": left, "vertices": with_edges(vertices, left)}


def with_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("entity_id")).union(edges.select("dst"))
    return vertices.join(ends, "entity_id", "left_semi")


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("entity_id")).union(edges.select("dst"))
    return vertices.join(ends, "entity_id", "left_anti")


def transcripts(pages: DataFrame) -> DataFrame:
    """doc_id and transcript: a document's pages in order, each under its number."""
    page = F.struct("page_num", F.concat(F.lit("--- page "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit(""))).alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["t"]), "\n\n").alias("transcript"))


def distinct_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """files whose name is unique: later ones of one name get -2, -3, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))
