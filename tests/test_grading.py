"""Grades of reports: documents of record, tables of dispositions, how a disposition was reached."""

import pytest

from tracewell.operators import elements, grading, links
from tracewell.plans import flows

REPORT = """# Summary
| No | Allegation | Disposition | Basis |
|---|---|---|---|
| 1 | he took it | **Not substantiated** | 3 of 3 elements weighed |
| 2 | he lied | Substantiated | **Unsettled** - review |
| 1 | again | Substantiated | 0 of 3 elements |

| 9 | an element | yes | no |
"""


def test_summary_by_columns(spark):
    rows = [("a", REPORT), ("b", "| 1 | x | Substantiated | weighed | all |\n|---|\n| 2 | y |\ntext"), ("c", None), ("d", "no table")]
    got = {(r.k, r.number): (r.verdict, r.basis) for r in grading.summary_rows(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {("a", 1): ("Substantiated", "0 of 3 elements"), ("a", 2): ("Substantiated", "Unsettled - review"), ("b", 1): ("Substantiated", "weighed all"), ("b", 2): ("y", "")}


def test_a_default_earns_nothing_whatever_its_label(spark):
    expected = spark.createDataFrame([(k, 1, "SUBSTANTIATED") for k in "abcdef"] + [("e", 2, "NOT_SUBSTANTIATED")], "k string, number int, expected string")
    found = [("a", 1, "Substantiated", "0 of 4 elements weighed"), ("b", 1, "Not substantiated", "4 of 4 elements weighed"), ("c", 1, "Substantiated", "DISPOSITION UNSETTLED"), ("d", 1, "Substantiated", None), ("e", 1, "Substantiated", "2 of 2 elements"), ("e", 2, "Not substantiated", ""), ("g", 1, "Substantiated", "")]
    findings = spark.createDataFrame(found, "k string, number int, disposition string, note string")
    summary = spark.createDataFrame([("a", 1, "Substantiated", ""), ("d", 1, "Not substantiated", ""), ("d", 3, "Substantiated", "")], "k string, number int, verdict string, basis string")
    grades = grading.graded(expected, findings, summary, "k")
    got = {(r.k, r.number): (r.grade, r.consistent) for r in grades.collect()}
    assert got == {
        ("a", 1): ("not weighed", True), ("b", 1): ("mislabelled", None), ("c", 1): ("not weighed", None), ("d", 1): ("credited", False), ("d", 3): (None, False),
        ("e", 1): ("credited", None), ("e", 2): ("unverified", None), ("f", 1): ("mislabelled", None),
    }
    ended = {r.k: (r.credited, r.wanted, r.passed) for r in grading.passed(grades, findings, "k").collect()}
    assert ended == {"a": (0, 1, False), "b": (0, 1, False), "c": (0, 1, False), "d": (1, 1, False), "e": (2, 2, False), "f": (0, 1, False)}


def test_figures_cite_their_document_of_record(spark):
    inventory = [(1, "F01 and F02: primary source is doc 9"), (2, "primary source is DOC_B; see F03"), (3, "no source named, F01"), (4, "Primary source is document 12: F04"), (5, None)]
    gold = [("F01", "The ledger counted seventeen barrels behind warehouse number three"), ("F02", "a b c"), ("F03", "Pallets vanished overnight"), ("F04", "Nothing anywhere mentions these words"), ("F05", None)]
    facts = [("09_ledger", "Seventeen BARRELS were counted.", "by him"), ("07_memo", "the ledger says barrels", "x"), ("DOC_A", "pallets vanished", None), ("x", None, None)]
    got = {r.trap_id: (r.matched, r.cited, r.cited_primary) for r in grading.sourcing(spark.createDataFrame(inventory, "trap_id int, text string"), spark.createDataFrame(gold, "fact_id string, text string"), spark.createDataFrame(facts, "doc_id string, quote string, object_name string")).collect()}
    assert got == {1: (["F01"], ["07_memo", "09_ledger"], True), 2: (["F03"], ["DOC_A"], False), 4: ([], [], False)}


def test_blocks_have_no_cap(spark):
    text = "\n".join(f"E{k % 99 + 1} | it\nMET: yes" for k in range(250))
    rows = elements.block_rows(spark.createDataFrame([("a", text)], "k string, t string"), "k", "t")
    assert rows.count() == 250 and rows.where("met").count() == 250


class Says:
    def generate(self, prompts):
        return ["A1 | B1 | caused | A | 0.9 | p.1\nEnd of answer" for _ in prompts]


def test_the_grouped_mode_of_a_link_pass(spark):
    from pyspark.sql import functions as F

    seen = spark.createDataFrame([(f"e{k:03d}", "PERSON") for k in range(60)], "entity_id string, entity_type string")
    prompt = lambda x, y: F.concat_ws(" ", F.concat(x, y))
    judged = spark.createDataFrame([], "a_id string, b_id string")
    found = flows.link_pass(seen, judged, Says(), prompt, mode="grouped", relations=["caused"])
    n = -(-60 // links.WINDOW)
    assert found.count() == n * (n - 1) // 2  # a window of a block with itself names one entity twice
    assert flows.link_pass(seen, found.select("b_id", "a_id").toDF("a_id", "b_id"), Says(), prompt, mode="grouped", relations=["caused"]).count() == 0
    for wrong in ({"mode": "grouped"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            flows.link_pass(seen, judged, Says(), prompt, **wrong)
