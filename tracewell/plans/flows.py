"""Flows over the evidence store, put together from operators: ingest, ask, resolve, link, report, consensus."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import extraction_chunks_udf
from ..operators import assertions, consensus, corpus, entities, graph, links, passages, report
from ..sources.docx import docx_pages
from ..sources.pages import image_pages, pdf_pages
from ..sources.models import Embedder, TextModel, apply_model, embed_chunks


@dataclass
class Store:
    """The evidence tables that a flow reads."""

    documents: DataFrame
    pages: DataFrame
    triples: DataFrame
    chunks: DataFrame


def ingest(files: DataFrame, read_pdf=None, render_pdf=None, normalise_image=None) -> tuple[DataFrame, DataFrame]:
    """documents and pages of uploads: Word files, PDF files where read_pdf is given, and images. Files of a kind that nothing reads
    stay queued."""
    pages = docx_pages(files.where("media_type = 'word'"))
    more = [image_pages(files.where("media_type = 'image'"), normalise_image)]
    if read_pdf is not None:
        more.append(pdf_pages(files.where("media_type = 'pdf'"), read_pdf, render_pdf))
    for part in more:
        pages = pages.unionByName(part, allowMissingColumns=True)
    first = pages.where("page_num = 1").select("doc_id", F.coalesce("text", F.lit("")).alias("_first"))
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.max("error").alias("error"), F.count_if(F.col("route").isNotNull()).alias("_unread"))
    docs = files.drop("content").join(counts, "doc_id", "left").join(first, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("page_count").isNull(), "queued").when(F.col("_unread") > 0, "processing").otherwise("done")
    return corpus.classify(docs.withColumn("_first", F.coalesce("_first", F.lit(""))), "filename", "_first").withColumn("status", status).drop("_first", "_unread"), pages


def extract(pages: DataFrame, model: TextModel) -> DataFrame:
    """Admitted triples from a model's replies to pages, chunk by chunk."""
    parts = pages.where("text is not null").select("doc_id", "page_num", F.col("text").alias("page_text"), F.posexplode(extraction_chunks_udf("text")).alias("chunk", "asked"))
    said = apply_model(parts, "asked", model.generate, "reply", "string").drop("reply_error", "asked", "chunk")
    admitted = assertions.validate(assertions.parse(said)).where("drop_reason is null")
    return assertions.dedupe(assertions.with_ids(assertions.expand_series(admitted, "page_text")))


def index(chunks: DataFrame, held: DataFrame, model: Embedder, name: str) -> DataFrame:
    """Vectors of the chunks that have none of this model."""
    return embed_chunks(passages.outstanding(chunks, held, name), model, name)


def search(chunks: DataFrame, question: str, limit: int, vectors: DataFrame | None = None, model: Embedder | None = None) -> DataFrame:
    """chunk_id and score by vectors; by keywords where there is no model, no vector or another width."""
    if model is not None and vectors is not None:
        query = model.embed([question])[0]
        if not vectors.where(F.size("embedding") == len(query)).isEmpty():
            return passages.vector_search(vectors, query, limit, "chunk_id", "embedding")
    return passages.keyword_search(chunks, question, limit)


#: Entities of a question below which the best passages' entities are added, and how many passages that are.
FEW, TOP_UP = 6, 4


def runs_of(text: str, longest: int) -> set[str]:
    """All runs of a text's words, up to so many words."""
    words = re.sub(r"[^\w\s]", " ", text.lower()).split()
    return {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + longest) + 1)}


def relationships_for(question: str, triples: DataFrame, limit: int = 45, most: int = 10, chunks: DataFrame | None = None) -> DataFrame:
    """Edges at the entities that the question names as whole words, without repeats; where it names few, also at those that the
    passages (chunks) name which answer it best.

    The question's runs of words, as long as the longest name, are keys: names meet them by equality, not by search in every
    name."""
    spark, flat = triples.sparkSession, lambda c: C.squash(F.regexp_replace(F.lower(c), r"[^\w\s]", " "))
    named = graph.mentions(triples).select(flat(F.col("name")).alias("flat")).where(F.length("flat") >= 3)
    longest = named.agg(F.max(F.size(F.split("flat", " ")))).first()[0] or 0

    def best(runs: set[str], n: int) -> list[str]:
        keys = spark.createDataFrame([(r,) for r in sorted(runs)], "flat string")
        return [r.flat for r in named.join(keys, "flat", "left_semi").groupBy("flat").count().orderBy(F.desc("count"), "flat").limit(n).collect()]

    found = best(runs_of(question, longest), most)
    if len(found) < FEW and chunks is not None:
        texts = passages.keyword_search(chunks, question, TOP_UP).join(chunks, "chunk_id").select("text").collect()
        more = set().union(*[runs_of(r.text, longest) for r in texts]) - set(found)
        found += best(more, most - len(found)) if more else []
    top = spark.createDataFrame([(f,) for f in found], "flat string")
    both = triples.select("*", flat(F.col("subject_name")).alias("_s"), flat(F.col("object_name")).alias("_o"))
    hit = both.join(F.broadcast(top), (F.col("_s") == F.col("flat"))).unionByName(both.join(F.broadcast(top), F.col("_o") == F.col("flat")))
    one = hit.dropDuplicates(["flat", "predicate", "_s", "_o", "doc_id", "page_num"])
    return one.orderBy(F.asc_nulls_last("event_date"), "triple_id").limit(limit).select("subject_name", "predicate", "object_name", "event_date", "doc_id", "page_num")


def ask(question: str, store: Store, model: TextModel, k: int = 8) -> dict:
    """answer, and the sources that the prompt held (bounded by k and the cap on relationships)."""
    found = search(store.chunks, question, k).join(store.chunks, "chunk_id").orderBy(F.desc("score"), "chunk_id").collect()
    facts = relationships_for(question, store.triples, chunks=store.chunks).collect()
    lines = [f"{r.subject_name} {r.predicate} {r.object_name} ({r.event_date or 'undated'}) [{r.doc_id} p.{r.page_num}]" for r in facts]
    prompt = "\n".join([*lines, *[f"[{r.doc_id} p.{r.page_num}] {r.text}" for r in found], question])
    return {"answer": model.generate([prompt])[0], "sources": [(r.doc_id, r.page_num) for r in found], "relationships": lines}


def resolve_entities(triples: DataFrame) -> DataFrame:
    """Entities of all mentions, merged where names are alike beyond doubt or stated to be one."""
    found = entities.entities(entities.with_ids(graph.mentions(triples).select("entity_type", "name")))
    alike = entities.unambiguous(entities.rival_pairs(found)).select("a", "b")
    return entities.merge(found, alike.unionByName(entities.stated_aliases(triples)).distinct())


def link_pass(seen: DataFrame, judged: DataFrame, model: TextModel, prompt, mode: str = "connected", near: DataFrame | None = None, kinds: tuple[str, str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """entity_links of pairs that were never asked about; prompt(a, b) is a column. mode: connected (a document, a day or near),
    exhaustive (all pairs of the two kinds; seen has entity_type) or grouped (window by window: prompt takes the ids of both blocks,
    relations are those that count, and pairs of windows that never ended stay unjudged, see grouped_pass)."""
    if mode == "grouped":
        if not relations:
            raise ValueError("the grouped mode needs the relations that count")
        found, _ = grouped_pass(seen.select("entity_id").distinct(), model, prompt, relations)
        done = judged.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
        return found.join(done, ["a_id", "b_id"], "left_anti")
    if mode == "exhaustive":
        found = links.pairs_for(seen.select("entity_id", "entity_type").distinct(), *kinds)
    elif mode == "connected":
        found = links.connected(seen, near)
    else:
        raise ValueError(f"no such mode: {mode}")
    pairs = links.unjudged(found, judged)
    asked = pairs.select("a", "b", F.lit(1).alias("asked"), prompt(F.col("a"), F.col("b")).alias("prompt"))
    said = apply_model(asked, "prompt", model.generate, "reply", "string").drop("prompt", "reply_error")
    return links.record(links.parse_answers(said))


def grouped_pass(entity: DataFrame, model: TextModel, prompt, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """entity_links of entities (entity_id), asked in windows of two blocks; prompt(left_ids, right_ids) is a column. Also the windows
    whose pairs are still to be judged one by one."""
    blocked = links.blocks(entity, "entity_id").groupBy("block").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    left, right = blocked.select(F.col("block").alias("x"), F.col("ids").alias("left_ids")), blocked.select(F.col("block").alias("y"), F.col("ids").alias("right_ids"))
    windows = left.join(right, F.col("x") <= F.col("y")).select(F.concat_ws("-", F.col("x").cast("string"), F.col("y").cast("string")).alias("window"), "left_ids", "right_ids", (F.col("x") == F.col("y")).alias("same"))

    def ask(rows: DataFrame) -> DataFrame:
        return apply_model(rows.withColumn("prompt", prompt(F.col("left_ids"), F.col("right_ids"))), "prompt", model.generate, "reply", "string").drop("prompt", "reply_error")

    found, left_over = links.resolve_windows(windows, ask, relations)
    return links.record(found), left_over


def check_report(body: DataFrame, documents: DataFrame, planned: DataFrame) -> dict[str, DataFrame]:
    """Citations with whether they are grounded, and dispositions that the element table requires, of reports (report_id, body)."""
    elements = report.element_rows(body, "report_id", "body").where("met is not null")
    return {"citations": report.grounded(report.citations(body, "report_id", "body"), documents), "dispositions": report.required_disposition(elements, "report_id", planned)}


def agree(reports: DataFrame, requested: int) -> DataFrame:
    """Consensus of drafted reports (report_id, body)."""
    read = consensus.read_run(reports)
    cites = report.citations(reports, "report_id", "body").groupBy("report_id").agg(F.collect_set(F.concat_ws(" p.", "name", F.col("page").cast("string"))).alias("citations"))
    runs = read.join(cites, "report_id", "left").select(F.col("report_id").alias("run"), "allegation", "disposition", F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
    return consensus.compare(runs, requested)
