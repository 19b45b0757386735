"""Rules of dates, names, claims, markers and containment, on inputs that tell them apart."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import kernels as K
from tracewell.operators import assertions, corpus, entities, evaluate, links, routing
from tracewell.operators import needles as needles_of
from tracewell.plans import flows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2025-06-06 2575", "2025-06-06"), ("2026-05-14 0925", "2026-05-14T09:25"), ("2026-05-14T0925", "2026-05-14T09:25"), ("2026-05-14 09:25", "2026-05-14T09:25"), ("2026-05-14T09:25:10Z", "2026-05-14T09:25:10"),
        ("Sep 2025", "2025-09"), ("sept., 2025", "2025-09"), ("12 and 2025-06 too", "2025-06"), ("on 2025-06-06, early", "2025-06-06"), ("2025-13", ""), ("2025-06", "2025-06"), ("unknown", ""), ("Marceau 2025", ""), (None, ""), ("", ""), ("soon", ""),
    ],
)
def test_dates_are_read(spark, raw, want):
    assert one(spark, C.normalize_when(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "date, quote, want",
    [
        ("2025-06-06", "He talked about it on 6 June 2025", ("2025-06-06", "stated")), ("2025-06-06", "around 6 June 2025", ("2025-06-06", "approx")), ("2025-06-06", "It was in June 2025.", ("2025-06", "month")),
        ("2025-06", "early June 2025", ("2025-06", "approx")), ("2025-03-14", "on the fourteenth of March", ("2025-03-14", "stated")), ("2025-03-21", "on the twenty-first of March", ("2025-03-21", "stated")),
        ("2025-03-15", "on 14 March", ("2025-03-15", "inferred")), ("2025-03-14", "on 14/03/2025", ("2025-03-14", "stated")), ("2025-08-01T20:26", "in August 2026", ("2025-08", "month")), ("2025-08-01T09:25", "at 0925 on 1 August", ("2025-08-01T09:25", "stated")),
        ("2025-06-06", "about 12 requests on 6 June", ("2025-06-06", "stated")), ("2025-06-06", "no date here", ("2025-06-06", "inferred")), (None, "on 6 June", (None, None)), ("2025-06-06", None, ("2025-06-06", "inferred")),
    ],
)
def test_dates_are_no_sharper_than_quotes(spark, date, quote, want):
    row = assertions.with_basis(spark.createDataFrame([(date, quote)], "event_date string, quote string")).first()
    assert (row.event_date, row.event_date_basis) == want


def test_series_of_dates(spark):
    quotes = ["four advances, dated 6 June, 20 June, 3 July and 17 July", "He came on 6 June 2025 but not on 20 June 2025", "on 6 June 2025 and 20 June 2025", "on 6 June"]
    rows = spark.createDataFrame([(k, q, "In 2025 it was so.", None, None) for k, q in enumerate(quotes)], "k int, quote string, page string, event_date string, event_date_basis string")
    got = {}
    for r in assertions.expand_series(rows, "page").collect():
        got.setdefault(r.k, []).append((r.event_date, r.event_date_basis))
    assert got[0] == [(f"2025-{d}", "inferred") for d in ("06-06", "06-20", "07-03", "07-17")] and got[1] == [(None, None)] == got[3]
    assert got[2] == [("2025-06-06", "stated"), ("2025-06-20", "stated")]
    two = rows.withColumn("page", F.lit("2024 or 2025"))
    assert assertions.expand_series(two.where("k = 0"), "page").count() == 1


def test_boundaries(spark):
    from tracewell.functions import rules

    got = [one(spark, F.lit(p).rlike(rules.BOUNDARY)) for p in ("issued by", "borrowed from", "was there until", "in place as of", "prior to", "up to", "suntil")]
    assert got == [False, False, True, True, True, True, False]


def test_names():
    assert [K.normalize(n) for n in ("TSgt Jane Smith", "A1C Bob Roe", "2Lt Ann Poe", "Judge Lee", "Don Quill")] == ["jane smith", "bob roe", "ann poe", "judge lee", "don quill"]
    assert K.name_score("j s", "john smith") == 92 and K.name_score("", "") == 0 and K.name_score("", "ann") == 0


def test_rivals_by_initials_of_several_tokens(spark):
    df = spark.createDataFrame([("PERSON:j s", "PERSON"), ("PERSON:john smith", "PERSON"), ("PERSON:js", "PERSON")], "entity_id string, entity_type string")
    assert {(r.a, r.b) for r in entities.rival_pairs(df).collect()} == {("PERSON:j s", "PERSON:john smith"), ("PERSON:j s", "PERSON:js"), ("PERSON:john smith", "PERSON:js")}


def test_propositions(spark):
    said = ["They will go there", "section NCOIC of record", "cables", "He is not going there", "one two three four"]
    assert [one(spark, links.proposition(F.lit(x))) for x in said] == [True, False, False, True, False]


def test_relation_names(spark):
    assert len(one(spark, C.rel_type(F.lit("9" + "x" * 80)))) == 60 and one(spark, C.rel_type(F.lit("9 lives"))) == "R_9_LIVES"


def test_markers(spark):
    page = "**Allegation 2:** theft\nbody that runs on\nallegation 3 was put to him.\n| Specification IV | x |\nIO: Allegation 5\nCharge 3 posted."
    spans = routing.marker_spans(spark.createDataFrame([("d", 1, page)], "doc_id string, page_num int, text string"))
    assert [r.ref for r in spans.orderBy("start").collect()] == [2, 4, 5]


def test_routing_has_no_cap(spark):
    rows = spark.createDataFrame([(1, [], False), (2, ["t7"], False), (3, ["t8"], True)], "k int, refs array<string>, unrestricted boolean")
    targets = spark.createDataFrame([(f"t{k}",) for k in range(1200)], "target string")
    got = routing.route(rows, targets).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {1: 1200, 2: 1, 3: 1200}
    none = routing.route(rows.where("k = 2"), targets)
    assert none.where("guarded").count() == 1199 and none.count() == 1200


@pytest.mark.parametrize("chars", [1 << 20, 8])
def test_contamination_of_cut_words(spark, chars, monkeypatch):
    monkeypatch.setattr(needles_of, "SHARD_CHARS", chars)
    needles = ["one two three four five six", "two three", "a", "b c d", "one two", "zz yy xx", "...", "x two three y"]
    texts = ["at one two three four five sixty", "someone two three", "", None, "ab cd", "b  c d", "b c de ... zz yy xxy", "x two three y x two three y"]
    n = spark.createDataFrame(list(enumerate(needles)), "i int, n string")
    t = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {(r.i, r.d) for r in evaluate.contamination(n, t, "i", "n", "d", "t").collect()}
    assert got == {(i, d) for i, x in enumerate(needles) for d, y in enumerate(texts) if y and x in y}


def test_a_name_of_many_words_is_found(spark):
    name = "the royal society for the relief of lost and found dogs"
    t = spark.createDataFrame([("1", "d", 1, "ORG", name, "keeps", "CLAIM", "dogs", None), ("2", "d", 1, "ORG", "Other", "keeps", "CLAIM", "cats", None)], "triple_id string, doc_id string, page_num int, subject_type string, subject_name string, predicate string, object_type string, object_name string, event_date string")
    got = flows.relationships_for(f"What does {name.title()}, of late, keep?", t).collect()
    assert {r.object_name for r in got} == {"dogs"}
    chunks = spark.createDataFrame([("c", "Other keeps the strays."), ("d", "nothing")], "chunk_id string, text string")
    assert {r.object_name for r in flows.relationships_for("Who keeps strays?", t, chunks=chunks).collect()} == {"cats"}
    assert flows.relationships_for("Who keeps strays?", t).count() == 0


def test_roles_and_kinds(spark):
    docs = [("a", "Q: What happened?"), ("log.txt", "I maintain the log."), ("subject_smith", "text"), ("x", "calibration record, form 7"), (None, None), ("memo", " " * 2000 + "I supervise them")]
    got = corpus.classify(spark.createDataFrame(docs, "n string, t string"), "n", "t").collect()
    assert [(r.doc_kind, r.doc_role) for r in got] == [("interview", "witness"), ("record", "custodian"), ("unknown", "subject"), ("record", "witness"), ("unknown", "witness"), ("unknown", "supervisor")]


def test_quotes_are_placed():
    text = "He  said\nit was Red. Later he said it was blue and then some more words came to pass."
    assert K.quote_offset(text, "he said it WAS") == 0 and K.quote_offset(text, "he said it was", 5) == 26 and K.quote_offset(text, "nothing") is None
    assert K.quote_offset(text, "later he said it was blue and then some other end") == 20
    assert K.quote_offset(text, "") is None and K.salvage_objects("{" * 4000) == []
