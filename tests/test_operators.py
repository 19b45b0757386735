"""Kernels, columns and evidence operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import columns as C
from tracewell.functions import kernels as K
from tracewell.operators import assertions, consensus, corpus, entities, evaluate, graph, links, passages, report, routing


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for n in (0, 5, 200, 3000):
        text = " ".join(rng.choices(["alpha", "beta.", "gamma", "x" * 30], k=n)) + "\n\nlast one."
        found = K.chunk_text(text)
        assert all(0 < len(c) <= 1051 for c in found)
        assert set(text.split()) <= set(" ".join(found).split())
    assert K.chunk_text(None) == [] and K.chunk_text("y" * 2000) and max(map(len, K.chunk_text("y" * 2000))) == 900


def test_kernels():
    assert K.sentences("Dr. Roe saw J. Doe. He ran! Why?") == ["Dr. Roe saw J. Doe.", "He ran!", "Why?"]
    assert K.narrow_quote("One came. The red car left. It was late.", "red car") == "The red car left."
    assert K.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13) and K.indel_ratio("", "") == 100
    assert K.partial_ratio("needle", "hay needle hay") == 100
    assert K.normalize("Capt. José Núñez, Jr.") == "jose nunez" and K.normalize("Sgt") == "sgt"
    assert K.name_score("fbi", "federal bureau investigation") == 92 and K.name_score("doe", "jane doe") == 90 and K.name_score("doe jane", "jane doe") == 100
    assert K.salvage_objects('```json\n{"triples": [{"a": 1}, {"a": 2}]}\n```') == ['{"a": 1}', '{"a": 2}']
    assert K.salvage_objects('{"triples": [{"a": 1}, {"a": 2}, {"a": ') == ['{"a": 1}', '{"a": 2}']
    assert K.locate_all("The  RED\ncar. the red car", "the red car") == [0, 14]


def test_columns(spark):
    df = spark.createDataFrame([("1 the  Reports to/2", "2024-03-05 0930"), ("", "March 2024"), (None, "2024-03"), ("99 x", "soon")], "p string, d string")
    got = rows(df.select(C.rel_type(F.col("p")), C.normalize_when(F.col("d"))))
    assert got == sorted([("R_1_THE_REPORTS_TO_2", "2024-03-05T09:30"), ("RELATED_TO", "2024-03"), ("RELATED_TO", "2024-03"), ("R_99_X", "")], key=str)
    assert spark.range(1).select(C.safe_filename(F.lit("../a/b c?.pdf")), C.day_key(F.lit("2024-03-05T09:30"))).first()[:] == ("b c_.pdf", "2024-03-05")


def test_schema_evolution(spark):
    for name in schemas.SCHEMAS:
        out = schemas.conform(spark.createDataFrame([("x",)], f"{next(iter(schemas.SCHEMAS[name]))} string"), name)
        assert out.columns == list(schemas.SCHEMAS[name]) and out.count() == 1


def test_corpus(spark):
    docs = spark.createDataFrame([("a", "done", "3 assertions", None, None, None), ("b", "queued", None, None, None, None), ("c", "text_only", None, None, None, None), ("d", "failed", None, None, None, None)], "doc_id string, status string, progress string, stage string, started_at string, finished_at string")
    triples = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "")], "doc_id string, page_num int, text string")
    state = corpus.corpus_state(docs, pages, triples)
    assert rows(state.select("doc_id", "pages_with_text", "assertions")) == [("a", 1, 2), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0)]
    assert rows(corpus.blocking_faults(state)) == [("a", "assertions lost"), ("b", "not finished"), ("c", "never analysed")]
    assert rows(corpus.silent_documents(state, triples)) == [("d", "failed")]
    new = spark.createDataFrame([("b", "processing", "ocr")], "doc_id string, new_status string, new_stage string")
    assert corpus.set_status(docs, new, "now").where("doc_id = 'b'").first()["started_at"] == "now"
    extra = spark.createDataFrame([("a", 1, "note"), ("z", 1, "first")], "doc_id string, ord int, text string")
    assert ("a", 3, "note") in rows(corpus.annex(pages, extra)) and ("z", 1, "first") in rows(corpus.annex(pages, extra))
    assert "--- page 1 ---\nx" in corpus.transcripts(pages).first()["transcript"]
    old = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "k int, x string, y string")
    assert rows(corpus.upsert(old, spark.createDataFrame([(2, None, "d"), (3, "e", None)], "k int, x string, y string"), ["k"])) == [(1, "a", None), (2, "b", "d"), (3, "e", None)]


TRIPLE = "triple_id string, doc_id string, page_num int, subject_type string, subject_name string, predicate string, object_type string, object_name string, event_date string, quote string"


def test_graph(spark):
    t = spark.createDataFrame([("1", "d", 1, "PERSON", "Ann", "met", "PERSON", "Bob", "2024-01-02", "q"), ("2", "d", 2, "PERSON", "ann", "Met ", "PERSON", "bob", "2024-01-02T10:00", "q"), ("3", "e", 1, "PERSON", "Bob", "left", "LOCATION", "Rome", None, "q")], TRIPLE)
    edge = graph.edges(t)
    assert rows(graph.snapshot(edge, 2)) == [("PERSON:ann", 2), ("PERSON:bob", 3)]
    assert graph.snapshot_edges(edge, graph.snapshot(edge, 2)).count() == 2
    assert [r.direction for r in graph.entity_detail(edge, "PERSON:bob").collect()] == ["out", "in", "in"]
    assert rows(graph.merged_timeline(t)) == [("2024-01-02", "ann", "met", "bob", "2024-01-02T10:00", 2, 2)]
    v = spark.createDataFrame([("PERSON:ann",), ("PERSON:bob",), ("PERSON:eve",)], "entity_id string")
    assert rows(corpus.orphans(v, edge)) == [("PERSON:eve",)]
    link = spark.createDataFrame([("PERSON:ann", "PERSON:bob", "caused", "PERSON:bob", 0.9), ("PERSON:ann", "PERSON:zed", "caused", None, 0.9)], "a_id string, b_id string, relation string, subject_id string, confidence double")
    assert rows(graph.draw(link, v)) == [("PERSON:bob", "PERSON:ann", "caused", 0.9)]
    assert rows(graph.inferred_only(edge, link)) == [("PERSON:zed",)]
    assert corpus.delete_document("d", v, edge, triples=t)["vertices"].count() == 1


def test_assertions(spark):
    reply = '{"triples": [{"subject_type": "PERSON", "subject_name": "Ann Roe", "predicate": "Drove", "object_type": "ALIEN", "object_name": "a red car", "event_date": "2024-03-05", "quote": "On 5 March 2024 Ann Roe drove a red car."}, {"subject_type": "PERSON", "subject_name": "He", "predicate": "saw", "object_type": "PERSON", "object_name": "Bob", "quote": "nothing like the page at all"}, {"quote": "x"'
    got = assertions.validate(assertions.parse(spark.createDataFrame([("d", 1, "Well. On 5 March  2024 Ann Roe drove a red car. He left.", reply)], "doc_id string, page_num int, page_text string, reply string"))).collect()
    fine = [r for r in got if r.drop_reason is None]
    assert len(got) == 2 and len(fine) == 1
    assert (fine[0].object_type, fine[0].predicate, fine[0].event_date, fine[0].event_date_basis) == ("CLAIM", "drove", "2024-03-05", "stated")
    rows_in = spark.createDataFrame([("Seen on 3 May 2024 and 9 June.", None), ("Seen once.", None)], "quote string, event_date string").withColumn("event_date_basis", F.lit(None).cast("string")).withColumn("y", F.lit("2024"))
    assert rows(assertions.expand_series(rows_in, "y").select("event_date", "event_date_basis")) == sorted([("2024-05-03", "stated"), ("2024-06-09", "stated"), (None, None)], key=str)
    d = spark.createDataFrame([("1", "d", 1, "P", "a", "p", "P", "b", None, "long quote here"), ("2", "d", 1, "P", "A", "p", "P", "b", None, "quote  here"), ("3", "d", 1, "P", "a", "p", "P", "c", None, "quote here"), ("4", "d", 1, "P", "a", "p", "P", "c", None, "Quote here")], TRIPLE)
    assert [r[0] for r in rows(assertions.dedupe(d).select("triple_id"))] == ["1", "3"]


def test_entities(spark):
    m = spark.createDataFrame([("PERSON", n) for n in ("Doe, Jane", "Jane Doe", "jane doe", "Dr. Jane Doe", "Jane Do", "Zed")] + [("ORG", "Fbi"), ("ORG", "Federal Bureau Investigation")], "entity_type string, name string")
    e = entities.entities(entities.with_ids(m))
    assert {r.label: r.mentions for r in e.collect()}["Dr. Jane Doe"] == 3
    pairs = entities.unambiguous(entities.rival_pairs(e))
    assert ("ORG:fbi", "ORG:federal bureau investigation") in {(r.a, r.b) for r in pairs.collect()}
    merged = entities.merge(e, pairs)
    assert rows(merged.where("entity_id = 'ORG:fbi'").select("merged_into")) == [("ORG:federal bureau investigation",)]
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 9), (7, 4)], "entity_id long, merged_into long")
    assert rows(entities.resolve(p)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 9), (7, 4)]  # a cycle is left where it is entered
    c = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in entities.components(c).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_rivals_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    parts = "catherine katherine jon john jonathan stephen steven mohammed muhammad li smith smyth o connor oconnor petersen pedersen macdonald mcdonald".split()
    names = {"js", "john smith", "catherine", "katherine", "macdonald", "mcdonald", "x"}
    for _ in range(120):
        text = list(" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "n", " "])
            text = text or ["x"]
        names.add(" ".join("".join(text).split()) or "x")
    entity = [(f"{kind}:{n}", kind) for kind in ("PERSON", "ORG", "EVENT") for n in sorted(names)]
    got = {(r.a, r.b): r.score for r in entities.rival_pairs(spark.createDataFrame(entity, "entity_id string, entity_type string")).collect()}
    want = {(f"{k}:{a}", f"{k}:{b}"): K.name_score(a, b) for k in ("PERSON", "ORG") for a in names for b in names if a < b and K.name_score(a, b) >= 88}
    assert got == want and ("PERSON:catherine", "PERSON:katherine") in want and len(want) > 40


def test_links(spark):
    seen = spark.createDataFrame([("a", "d1", None), ("b", "d1", "x"), ("c", "d2", "x"), ("e", "d3", None)], "entity_id string, doc_id string, day string")
    pairs = links.connected(seen)
    assert rows(pairs) == [("a", "b"), ("b", "c")]
    assert rows(links.unjudged(pairs, spark.createDataFrame([("b", "a")], "a_id string, b_id string"))) == [("b", "c")]
    blocked = links.blocks(spark.range(60), "id")
    assert sorted(r["count"] for r in blocked.groupBy("block").count().collect()) == [10, 25, 25]
    assert links.windows(blocked).agg(F.sum("pairs")).first()[0] == 60 * 59 // 2
    said = spark.createDataFrame([(2, "1. Caused | A | 0.9 | page 3\n1. caused | B | 0.1 | again\n7. caused | A | 0.9 | beyond\nnoise\n2. none | - | 0.2 |")], "asked int, reply string")
    got = links.parse_answers(said)
    assert [(r.number, r.relation, r.side) for r in sorted(got.collect())] == [(1, "caused", "A"), (2, "none", "-")]
    out = links.record(got.withColumns({"a": F.lit("y"), "b": F.lit("x")})).collect()
    assert {(r.a_id, r.relation, r.subject_id) for r in out} == {("x", "caused", "y"), ("x", "", None)}


def test_routing(spark):
    pages = spark.createDataFrame([("d", 1, "Intro.\nAllegation 1: theft\nbody.\nALLEGATION II\nmore")], "doc_id string, page_num int, text string")
    spans = routing.marker_spans(pages)
    assert rows(spans) == [("d", 1, 1, 1, 3), ("d", 1, 2, 3, 5)]
    points = spark.createDataFrame([("d", 1, k) for k in range(5)], "doc_id string, page_num int, at int")
    assert [r.ref for r in sorted(routing.stab(points, spans, ["doc_id", "page_num"], "at").collect(), key=lambda r: r.at)] == [None, 1, 1, 2, 2]
    c = spark.createDataFrame([("d", 1, "m", False), ("d", 2, None, False), ("d", 3, None, False), ("e", 1, "m", False), ("e", 2, None, True)], "g string, p int, m string, r boolean")
    assert [r.carried for r in sorted(routing.carry(c, "g", "p", "m", reset="r").collect())] == ["m", "m", None, "m", None]
    ev = spark.createDataFrame([(["1"], False), (["1"], True)], "refs array<string>, unrestricted boolean")
    assert rows(routing.route(ev.where("not unrestricted"), spark.createDataFrame([("1",), ("2",)], "target string")).select("target", "guarded")) == [("1", False), ("2", True)]
    assert {r.ref: r.valid for r in routing.numbering(spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "ref int, seen int"), 3).collect()} == {0: True, 1: True, 2: True}


def test_reports(spark):
    t = spark.createDataFrame([(1, "So it was [Ann p.3-5] and [Bob pp. 2], [none].")], "k int, text string")
    cites = report.citations(t, "k", "text")
    assert rows(cites) == [(1, "Ann", 3), (1, "Ann", 4), (1, "Ann", 5), (1, "Bob", 2)]
    known = report.grounded(cites, spark.createDataFrame([("ann", 4)], "name string, page_count int"))
    assert [r.known for r in sorted(known.collect(), key=lambda r: (r.name, r.page))] == [True, True, False, False]
    body = spark.createDataFrame([(1, "Element 1: Met, more than 2 times\n**Element 2**: not met\nElement 1 - Met, 3 instances")], "k int, text string")
    assert rows(report.element_rows(body, "k", "text")) == [(1, 1, True, 3), (1, 2, False, None)]
    plan = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "k int, element int")
    e = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (3, 1, True), (3, 1, False)], "k int, element int, met boolean")
    assert rows(report.required_disposition(e, "k", plan)) == [(1, "negative"), (2, "affirmative"), (3, "undetermined")]
    c = spark.createDataFrame([(1, "a", "a", "x"), (1, "a", "b", "x"), (2, "a", "a", "x")], "g int, page_a string, page_b string, incompatible string")
    assert report.filter_conflicts(c, "g").count() == 2


def test_consensus(spark):
    v = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y"), ("t", "x"), ("t", "y"), ("n", None)], "key string, label string")
    assert rows(consensus.modes(v, "key", "label")) == [("k", 2, 3, "x"), ("t", 1, 2, None)]
    runs = spark.createDataFrame([(1, 1, "x", ["p1"]), (2, 1, "x", ["p1", "p2"])], "run int, allegation int, disposition string, citations array<string>")
    got = consensus.compare(runs, 2).first()
    assert got.unanimous and got.evidence_unstable
    r = spark.createDataFrame([("r", "| 1 | Theft | Sustained |\n#### Allegation 1: Theft\n**Disposition:** Not sustained\n| 2 | Lies | Unfounded |")], "report_id string, body string")
    assert rows(consensus.read_run(r)) == [("r", 1, "Not sustained", True), ("r", 2, "Unfounded", False)]


def test_evaluation(spark):
    needles = spark.createDataFrame([(1, "one two three four five six seven"), (2, "zip")], "i int, n string")
    texts = spark.createDataFrame([("a", "x one two three four five six seven y"), ("b", "one two three four five six eleven zip"), ("c", "")], "d string, t string")
    assert rows(evaluate.contamination(needles, texts, "i", "n", "d", "t")) == [(1, "a"), (2, "b")]
    pair = spark.createDataFrame([("He took 5 coins today", "He took 6 coins today"), ("He was there today", "He was there today")], "a string, b string")
    assert [r[0] for r in pair.select(evaluate.opposes(F.col("a"), F.col("b"))).collect()] == [True, False]
    g = spark.createDataFrame([("F1", "d", "Alice entered the garage before midnight")], "fact_id string, doc string, text string")
    f = spark.createDataFrame([("d", "Alice entered at midnight", "entered", "house")], "doc_id string, quote string, predicate string, object_name string")
    assert rows(evaluate.fact_recall(g, f)) == [("F1", 3, True)]
    forest = spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone")], "entity_id string, merged_into string")
    assert not evaluate.merge_graph_sound(forest, entities.resolve(forest)).first().sound
    assert not evaluate.merge_graph_sound(forest.limit(0), entities.resolve(forest.limit(0))).first().sound


def test_passages(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m"), ("c", [1.0], "m")], "chunk_id string, embedding array<float>, model string")
    assert rows(passages.vector_search(v, [1.0, 0.0], 1, "chunk_id", "embedding")) == [("a", 1.0)]
    q = passages.question_vector(v.where("chunk_id <> 'c'"), "embedding").first()["embedding"]
    assert q == pytest.approx([2**-0.5, 2**-0.5])
    chunks = spark.createDataFrame([("a", "the cat"), ("z", "the dog and cat")], "chunk_id string, text string")
    assert rows(passages.outstanding(chunks, v, "m").select("chunk_id")) == [("z",)]
    assert [tuple(r) for r in passages.keyword_search(chunks, "dog, cat?", 5).collect()] == [("z", 2), ("a", 1)]
    assert rows(passages.index_stats(chunks, v, "other")) == [(2, 1, 1)]
