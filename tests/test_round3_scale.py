"""What the findings of round 3 found: results, and steps whose rows may not grow faster than the input."""

from __future__ import annotations

import datetime
import glob
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import kernels
from tracewell.llm import packing
from tracewell.operators import assertions, containment, dictionary, entities, grading, graph, links, needles, passages, routing, scoring
from tracewell.operators import iterate
from tracewell.operators.iterate import by_rows, shared_dir
from tracewell.sources.versions import Versions
from tracewell.streaming import state


def test_gold_facts_of_one_id_are_held_each_by_itself(spark):
    gold = spark.createDataFrame([("F01", "barrels hidden cellar"), ("F01", "wagons burned yesterday"), ("F01", "wagons burned yesterday")], "fact_id string, text string")
    inventory = spark.createDataFrame([(1, "F01: primary source is doc 9")], "trap_id int, text string")
    facts = spark.createDataFrame([("09_a", "barrels and wagons", "x"), ("09_b", "wagons in one place", "x"), ("07_c", "hidden barrels", "x")], "doc_id string, quote string, object_name string")
    got = grading.sourcing(inventory, gold, facts).collect()
    assert [(r.matched, r.cited, r.cited_primary) for r in got] == [(["F01"], ["07_c"], False)]


def test_packs_and_pieces_are_those_of_the_plain_loops():
    rng = random.Random(3)
    for _ in range(300):
        sizes, most, gap = [rng.randrange(12) for _ in range(rng.randrange(30))], rng.randrange(1, 15), rng.randrange(3)
        want, held = [], 0
        for i, n in enumerate(sizes):
            if not want or held + gap + n > most:
                want.append(i)
                held = n
            else:
                held += gap + n
        assert kernels.packed(sizes, most, gap) == want
        text = "".join(rng.choice("ab.!?  \n\t") for _ in range(rng.randrange(40)))
        words = text.split() or ["a"]
        heads = kernels.packed([len(w) + 1 for w in words], most + 1, 0)
        assert kernels.by_words(" ".join(words), most) == ([" ".join(words[a:b]) for a, b in zip(heads, [*heads[1:], len(words)], strict=True)])
        assert kernels.pieces_of(text) == re.split(r"(?<=[.!?])\s+|\n", text)


def test_derived_texts_are_dealt_by_rows(spark):
    assert by_rows(spark.range(95).coalesce(1), 10).rdd.getNumPartitions() == 10


def test_people_are_found_by_forms_within_names_and_names_within_forms(spark):
    facts = [("PERSON", n, "ORG", "x") for n in ("Ann Roe", "roe", "Bo Lee junior", "Cy", "Dora Fox", "Eve Wolf", "!!", None)]
    persons = [(2, "Roe"), (1, "Ann Roe the elder"), (3, "bo lee"), (4, "!")]
    got = scoring.people_found(spark.createDataFrame(facts, "subject_type string, subject_name string, object_type string, object_name string"), spark.createDataFrame(persons, "person int, form string"), spark.createDataFrame([("the foxes and",), (None,)], "text string"))
    assert {(r.name, r.person) for r in got.collect()} == {("Ann Roe", 1), ("roe", 1), ("Bo Lee junior", 3), ("Cy", None), ("Eve Wolf", None), ("!!", 1), (None, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_forms" not in plan and "_aside" not in plan  # no row holds the whole key


def test_denials_meet_facts_by_pairs_of_words(spark):
    denials = [(k, f"Nobody moved barrel{k} cellar{k}") for k in range(40)] + [(100, "Nobody"), (101, None), (102, "moved moved nobody")]
    facts = [("moved", f"barrel{k}", f"It was seen in cellar{k + k % 2}.") for k in range(40)] + [("moved", "x", "he denied it: cellar1"), ("moved", "nobody", "it")]
    got = scoring.negated(spark.createDataFrame(facts, "predicate string, object_name string, quote string"), spark.createDataFrame(denials, "denial_id int, text string"))
    # an odd one's barrel was moved, but two of the three rarest words are barrel and moved
    assert {r.denial_id: r.asserted for r in got.collect()} == {**dict.fromkeys(range(40), True), 100: False, 101: False, 102: True}
    made = []
    scoring.negated(spark.createDataFrame(facts, "predicate string, object_name string, quote string").where("object_name like 'barrel%'"), spark.createDataFrame(denials, "denial_id int, text string")).foreach(made.append)
    assert not made


@pytest.mark.parametrize("block", [links.PAIR_BLOCK, 3])
def test_pairs_of_two_types_come_from_lists_and_meet_no_types_again(spark, block, monkeypatch):
    monkeypatch.setattr(links, "PAIR_BLOCK", block)
    rows = [(f"e{k}", "abc"[k % 3]) for k in range(30)] + [("e0", "a"), (None, "a"), ("x", None)]
    entities = spark.createDataFrame(rows, "entity_id string, entity_type string")
    found = links.pairs_for(entities, "a", "b")
    ids = {t: {e for e, u in rows if e and u == t} for t in "ab"}
    got = [(r.a, r.b) for r in found.collect()]
    assert sorted(got) == sorted((min(x, y), max(x, y)) for x in ids["a"] for y in ids["b"])
    same = [(r.a, r.b) for r in links.pairs_for(entities, "a", "a").collect()]
    assert sorted(same) == sorted((x, y) for x in ids["a"] for y in ids["a"] if x < y)
    assert "entity_type" not in found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]  # above the lists no types are joined


@pytest.mark.parametrize("few", [links.FEW, 2])
def test_pairs_that_recur_in_many_groups_are_marked_once(spark, few, monkeypatch):
    monkeypatch.setattr(links, "FEW", few)
    rng = random.Random(7)
    rows = [(rng.randrange(40), rng.randrange(3), rng.randrange(4)) for _ in range(200)] + [(k, 9, 9) for k in range(30)] + [(None, 9, 9)]
    got = [(r.a, r.b) for r in links.within(spark.createDataFrame(rows, "m int, g int, h int"), ["g", "h"], "m").collect()]
    assert sorted(got) == sorted({(a, b) for a, *g in rows for b, *h in rows if g == h and a is not None and b is not None and a < b})


def test_windows_come_from_many_tasks(spark):
    found = links.windows(spark.createDataFrame([(k // 2,) for k in range(41)], "block long"))
    n = {k: 2 for k in range(20)} | {20: 1}
    assert sorted(map(tuple, found.collect())) == [(a, b, n[a] * (n[a] - 1) // 2 if a == b else n[a] * n[b]) for a in n for b in n if a <= b]
    assert found.rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("whole", [False, True])
def test_many_needles_are_one_pass_over_texts(spark, whole, monkeypatch):
    monkeypatch.setattr(needles, "SHARD_CHARS", 40)
    hay = spark.createDataFrame([(k, f"https://a.b/x{k}") for k in range(300)] + [(300, "é"), (301, "x")], "n int, needle string")
    texts = spark.createDataFrame([(1, "see https://a.b/x17, https://a.b/x170 and xé"), (2, None), (3, "")], "t int, text string")
    found = needles.find(hay, texts, "n", "needle", "t", "text", whole)
    part = {(1, 1, 4), (17, 1, 4), (170, 1, 21)} | {(300, 1, 43), (301, 1, 16)}
    assert {tuple(r) for r in found.collect()} == ({(17, 1, 4), (170, 1, 21)} if whole else part)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # not a pass for each shard of needles


def test_quotes_that_begin_alike_meet_by_what_they_hold(spark):
    said = [f"the goods of supplier {k} left the yard" for k in range(50)]
    findings = spark.createDataFrame([(k, k % 2, f'"{s.upper()}"') for k, s in enumerate(said)] + [(90, 1, '"the goods of supplier 7 left the yard at noon"'), (91, 1, '"and the goods of supplier 7 left the yard"')], "finding_id int, ref int, text string")
    got = scoring.quote_routing(findings, spark.createDataFrame([(s, 1) for s in said], "quote string, allegation_ref int"))
    assert {tuple(r) for r in got.collect()} == {(k, k % 2, k % 2 == 0) for k in range(50)} | {(90, 1, False)}
    assert "_h#" not in got._jdf.queryExecution().optimizedPlan().toString()  # no join on how quotes begin


def test_sentences_are_counted_without_being_put_out(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "Mr", "Dr", "B", "é", "_", ".", "!", "?", " ", "\n", "\t", " ", "..", "word"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [kernels.sentence_count(t) for t in texts] == [len(kernels.sentences(t)) for t in texts]


def test_joins_of_pointers_send_nothing_to_the_driver(spark):
    rows = spark.createDataFrame([(k, "a", 1, k + 1 if k < 5 else 0) for k in range(6)] + [(9, "b", 1, 3)], "entity_id long, label string, mentions int, merged_into long")
    got = entities.compact(rows)
    assert {r.entity_id: r.merged_into for r in got.collect()} == {0: None, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 0}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_nested_places_are_told_by_one_sort(spark):
    rows = [(t, rng.randrange(12), rng.randrange(1, 5)) for rng in [random.Random(6)] for t in [1, 2, 3, None] for _ in range(9)]
    hits = spark.createDataFrame(rows, "t int, at long, words int")
    want = sorted((r for r in rows if r[0] is None or not any(o[0] == r[0] and o[2] > r[2] and o[1] <= r[1] and r[1] + r[2] <= o[1] + o[2] for o in rows)), key=str)
    got = dictionary.unnested(hits, "t")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edges_within_the_top_are_let_through_before_they_move(spark):
    rows = [(str(k), "P", f"p{k % 4}", "knows", "P", f"p{(k + 1) % 5}", None, "d", 1) for k in range(40)]
    rows = spark.createDataFrame([*rows, *rows], "triple_id string, subject_type string, subject_name string, predicate string, object_type string, object_name string, event_date string, doc_id string, page_num int")
    edge = graph.edges(rows)
    top = graph.top_vertices(rows, 3)
    names = [r.entity_id for r in top.collect()]
    want = sorted(map(str, edge.where(edge.src.isin(names) & edge.dst.isin(names)).collect()))
    assert sorted(map(str, graph.edges_within(rows, top).select(edge.columns).collect())) == want and want


def test_summaries_sort_lines_and_not_cells(spark):
    text = "| 1 | x | early |\n\n# S\n| No | What | Disposition | Basis |\n|--|--|--|--|\n| 1 | a | met | b1 |\n| 1 | a | unmet | b2 |\n| 2 | a | met |\n\n| 3 | far | away | - |"
    got = grading.summary_rows(spark.createDataFrame([("k", text), ("n", "| 2 | x | yes | why | not |"), ("o", None)], "k string, t string"), "k", "t")
    assert {tuple(r) for r in got.collect()} == {("k", 1, "unmet", "b2"), ("k", 2, "met", ""), ("n", 2, "yes", "why not")}
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("at#" in x.split("], [")[-1] and "_low" not in x for x in windows)  # one order for all, of narrow rows


def test_repeats_are_counted_on_hashed_keys(spark):
    rng = random.Random(8)
    facts = [(rng.choice([1, None]), 1, rng.choice(["S", "T", None]), "p", "o", None, rng.choice(["", "a", "ab", "b a", "c", None, "ab c"])) for _ in range(120)]
    want, groups = 0, {}
    for doc, page, subject, *_, quote in facts:
        groups.setdefault((doc, page, subject or ""), []).append(quote or "")
    for quotes in groups.values():
        quotes.sort(key=lambda q: (len(q), q))
        want += sum(any(r == q if not r else r in q for r in quotes[:i]) for i, q in enumerate(quotes))
    got = scoring.duplicates(spark.createDataFrame(facts, "doc_id int, page_num int, subject_name string, predicate string, object_name string, event_date string, quote string"))
    assert tuple(got.first()) == (120, want)
    assert "_subject_name" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_reports_are_graded_in_tasks_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(grading, "REPORTS", 10)
    rows = spark.range(95).selectExpr("id k", "'| 1 | a | met | b |' t")
    assert grading.summary_rows(rows, "k", "t").rdd.getNumPartitions() == 10


def test_parts_travel_by_groups(spark, monkeypatch):
    monkeypatch.setattr(passages, "NEAR_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], rng.normal(size=5).tolist()) for k in range(90)]
    found = passages.near_pairs(spark.createDataFrame(rows, "id int, label string, v array<double>"), "label", 0.5, "id", "v")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and round(float(np.dot(x[2], y[2])), 4) >= 0.5}
    got = [(r.a, r.b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()  # parts are put together before they meet


def test_quotes_move_as_hashes(spark):
    rows = [(1, "a long enough quote"), (2, "A long  enough quote"), (3, "enough"), (4, None), (5, "other"), (None, "other")]
    rows = spark.createDataFrame([(k, "P", "s", "p", "O", "o", None, q) for k, q in rows], "triple_id int, subject_type string, subject_name string, predicate string, object_type string, object_name string, event_date string, quote string")
    got = assertions.dedupe(rows)
    assert sorted(str(r.triple_id) for r in got.collect()) == ["1", "4", "5", "None"]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x or "Join LeftAnti" in x]
    assert joins and not any("_flat" in x for x in joins)


@pytest.mark.parametrize("rows", [state.CALL_ROWS, 8])
def test_a_replay_is_written_by_many_tasks_and_its_keys_share_state(spark, rows, monkeypatch):
    monkeypatch.setattr(state, "CALL_ROWS", rows)
    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    log = [(None if k % 50 == 0 else rng.randrange(12), start + datetime.timedelta(minutes=rng.randrange(3000)), k, rng.choice(["a", "b", None]), rng.choice(["x", None, 'é"\n'])) for k in range(300)]
    entries = spark.createDataFrame(log, "run long, ts timestamp, seq long, kind string, data string").repartition(3)
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tracewell/replay-*"))
    got = state.replayed(spark, entries, "run", "ts", ["seq"], "kind", "data", parts=2, quiet="100 days")
    want = state.joined(entries.where("run is not null"), "run", ["ts", "seq"], "kind", "data")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    (base,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tracewell/replay-*")) - before
    assert len(glob.glob(f"{base}/log/*.parquet")) > 3  # not one file a part


def test_edges_move_once_to_as_many_buckets_as_they_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_ROWS", 100, raising=False)
    monkeypatch.setattr(graph, "materialize", None)  # no step is written beside the store
    kinds = [F.lit("PERSON").alias("subject_type"), F.concat(F.lit("P "), F.col("id") % 7).alias("subject_name"), F.lit("met").alias("predicate"), F.lit("PERSON").alias("object_type"), F.concat(F.lit(" Q  "), F.col("id")).alias("object_name"), F.lit(None).cast("string").alias("event_date"), F.lit("d").alias("doc_id"), F.lit(1).alias("page_num")]
    triples = lambda low, high: spark.range(low, high).select(F.concat(F.lit("t"), F.col("id")).alias("triple_id"), *kinds)
    store = Versions(spark, f"file://{tmp_path}/store")
    graph.sink(store, triples(0, 400).union(triples(100, 400)), buckets=2)
    graph.sink(store, triples(300, 450), buckets=2)
    assert store.manifest()["edges"]["buckets"] == ["triple_id", 8] and store.manifest()["vertices"]["buckets"] == ["entity_id", 8]
    assert [p.count() for p in store.parts("edges")] == [400, 50] and [p.count() for p in store.parts("vertices")] == [407, 50]
    assert store.read("edges").select("triple_id").distinct().count() == 450 and store.read("edges").where("dst = 'PERSON:q 449' and rel = 'MET'").count() == 1


@pytest.mark.parametrize("text", [False, True])
def test_tasks_put_stars_for_the_edges_they_read(spark, text, monkeypatch):
    monkeypatch.setattr(entities, "STAR_ROWS", 50, raising=False)
    rng = random.Random(4)
    rows = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1400)] + [(500, 500), (600, None), (None, 601), (None, None)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    edges = edges.select(F.col("a").cast("string"), F.col("b").cast("string")) if text else edges
    group = {}
    for a, b in rows:
        a, b = (b if a is None else a), (a if b is None else b)
        one = group.setdefault(a, {a}) | group.setdefault(b, {b})
        group.update(dict.fromkeys(one, one))
    want = {(str(k), min(map(str, v))) if text and k is not None else (k, min(v)) for k, v in group.items()}
    assert {tuple(r) for r in entities.components(edges).collect()} == want
    wide = spark.range(40).select((F.col("id") % 5).alias("a"), (F.col("id") % 8 + 5).alias("b")).coalesce(1)
    assert entities.starred(wide, "a", "b").count() == 12  # 13 nodes of 40 different edges


def test_new_words_are_told_without_going_through_all_that_are_known():
    import public_tokenizers

    class Known(dict):
        def keys(self):
            raise AssertionError("all that is known")

    words = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    texts = ["The quick, brown FOX's 12 dens.", "", "été? x1y2 İ a.b", "The the quick"]
    plain = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words.words, words.runs = Known(words.words), Known(words.runs)
    assert words.ids(texts) == plain


def test_pairs_of_routing_are_dealt_by_their_number(spark):
    rows = spark.range(400).select("id", F.array().cast("array<long>").alias("refs"), F.lit(False).alias("unrestricted"))
    assert routing.route(rows, spark.range(200_000).withColumnRenamed("id", "target")).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("few", [0, 64])
def test_routing_by_cells_loses_and_doubles_nothing(spark, few, monkeypatch):
    for name, value in (("BLOCK", 8), ("PAIRS", 32), ("CELLS", 2), ("FEW", few)):
        monkeypatch.setattr(routing, name, value)
    data = [(i // 2, [3], True) for i in range(15)] + [(i, [i, i, 99, None], False) for i in range(10, 20)]
    rows = spark.createDataFrame(data, "k int, refs array<int>, unrestricted boolean")
    targets = spark.createDataFrame([(t,) for t in [*range(50), *range(9), None]], "target int")
    got = routing.route(rows, targets).select("k", "target").collect()
    assert sorted(map(tuple, got)) == sorted([(i // 2, t) for i in range(15) for t in range(50)] + [(i, i) for i in range(10, 20)])
    left = routing.route(rows.where("not unrestricted"), targets).where("guarded").select("k", "target").collect()
    assert sorted(map(tuple, left)) == [(i, t) for i in range(10, 20) for t in range(50) if not 10 <= t < 20]
    assert routing.route(rows.where("unrestricted"), targets.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "few", "marks", "once"), [(2048, 16, 1 << 22, 128), (64, 2, 50, 3), (7, 4, 50, 2)])
def test_pairs_of_groups_of_all_sizes_meet_in_squares(spark, block, few, marks, once, monkeypatch):
    for name, value in (("PAIR_BLOCK", block), ("FEW", few), ("MARKS", marks), ("AT_ONCE", once), ("SIDE", 4), ("SIDES", 3)):
        monkeypatch.setattr(links, name, value)
    kept = []
    monkeypatch.setattr(links, "materialize", lambda df, what="step", was=links.materialize: kept.append((what, was(df, what))) or kept[-1][1])
    rng = random.Random(11)
    sizes = [*[rng.randrange(1, 9) for _ in range(60)], *[rng.randrange(10, 60) for _ in range(12)], 150]
    rows = [(f"é{m:03}", g, datetime.date(2020, 1, 1 + g % 3) if m < 40 else None) for g, size in enumerate(sizes) for m in rng.choices(range(300), k=size)] + [(None, 1, None), ("alone", None, None)]
    got = [(r.a, r.b) for r in links.sharing([(spark.createDataFrame(rows, "m string, g int, d date"), c) for c in (["g"], ["d"])], "m").collect()]
    want = {(a, b) for k in (1, 2) for key in {r[k] for r in rows} - {None} for a in {r[0] for r in rows if r[k] == key} - {None} for b in {r[0] for r in rows if r[k] == key} - {None} if a < b}
    assert sorted(got) == sorted(want)
    # what moves is what each group has of each block, not that of all pairs of blocks
    lists = [df for what, df in kept if what == "lists"][0]
    assert lists.selectExpr("coalesce(sum(octet_length(h)), 0) / 16").first()[0] <= len({(r[k], r[0]) for r in rows for k in (1, 2)})


def asked_of(raws, ask=True):
    """What texts ask for, or have for all who ask, by text: levels and hashes."""
    size = np.array([len(x) for x in raws])
    own = sum((size >= n).astype(int) for n in containment.OWN) - 1
    everything = {"lengths": list(range(1, containment.OWN[0])), "short": np.full(8, 255, np.uint8)}
    found = containment._found(np.frombuffer(b"".join(raws), np.uint8), np.cumsum(size) - size, size, own, np.ones((len(raws), len(containment.OWN) + 1), bool), np.zeros(len(raws), np.uint64), None if ask else everything)
    out = [set() for _ in raws]
    for i, level, h in zip(*(x.tolist() for x in found), strict=True):
        out[i].add((level, h))
    return out


def test_what_a_part_asks_for_the_whole_has():
    rng = random.Random(8)
    for letters in (b"a", b"ab", b"abcdefgh"):
        wholes = [bytes(rng.choices(letters, k=rng.randint(1, 4000))) for _ in range(60)]
        parts = []
        for w in wholes:
            s = rng.randrange(len(w))
            parts.append(w[s : s + rng.choice([1, 7, 14, 15, 22, 23, 118, 119, 120, 300, 902, 903, 904, 2000])])
        for part, whole in zip(asked_of(parts), asked_of(wholes, ask=False), strict=True):
            assert part and part <= whole


def test_copies_that_differ_beside_their_marks_ask_for_what_no_other_has():
    rng = random.Random(9)
    raw = bytes(rng.choices(b"abcdefgh ", k=6000))
    told = containment.marks(raw, containment.WINDOWS[-1]).tolist()
    for at in range(1500, 4500, 300):
        copy = raw[:at] + b"#" + raw[at + 1 :]
        if containment.marks(copy, containment.WINDOWS[-1]).tolist() == told:  # marks alone don't tell them apart
            one, other = asked_of([raw, copy])
            assert one - other and other - one


def test_long_quotes_give_only_what_short_ones_ask_for(spark, monkeypatch):
    counts, was = {}, iterate.materialize

    def counted(df, what="step", *rest):
        out = was(df, what, *rest)
        counts[what] = out.count()
        return out

    monkeypatch.setattr(iterate, "materialize", counted)
    rng = random.Random(10)
    long = ["".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(20)]
    rows = [("k", x) for x in long] + [("k", long[0][500:530]), ("k", long[3][700:760]), ("k", "no such words anywhere at all")]
    got = containment.contained(spark.createDataFrame([(1, t, i) for i, (_, t) in enumerate(rows)], "g long, t string, i long"), "g", "t", ["i"])
    assert {r.i for r in got.collect()} == {20, 21}
    assert counts["contained-marks"] < 5000  # 400 KB of texts have some 90,000 marks of the first window
