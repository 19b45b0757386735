"""Markdown lines and people."""

from tracewell.operators import markdown, people


def test_markdown(spark):
    text = "# Title\n## Allegation 1: *theft*\nBody **bold**\n\n- one\n  more\n2) two\n## Allegation 2: lies\n| # | Label |\n|---|---|\n| 1 | **Met** |"
    df = spark.createDataFrame([(1, text), (2, "plain line\nother"), (3, None)], "k int, t string")
    got = {(r.k, r.number): (r.title, r.body) for r in markdown.sections(df, "k", "t", r"(?i)^allegation \d+: (.*)$").collect()}
    assert got[1, 1][0] == "theft" and got[1, 1][1].startswith("Body **bold**") and got[1, 2][0] == "lies"
    said = {(r.k, r.n): r.allegation for r in markdown.split_allegations(df, "k", "t").collect()}
    assert said[1, 1] == "one more" and said[1, 2].startswith("two") and said[2, 1] == "plain line" and said[2, 2] == "other"
    assert [r.cells for r in markdown.table_rows(df, "k", "t").orderBy("at").collect()] == [["#", "Label"], ["1", "Met"]]


def test_people(spark):
    pages = spark.createDataFrame([("d", 1, "Form\nName: Sgt. Jane Doe\nText"), ("e", 1, "Witness - Roe"), ("f", 1, "nothing")], "doc_id string, page_num int, text string")
    roster = spark.createDataFrame([("p1", "Jane Doe"), ("p2", "Jane Ann Doe"), ("p3", "Al Roe"), ("p4", "Bo Roe")], "entity_id string, label string")
    assert [tuple(r) for r in people.speakers(pages, roster).collect()] == [("d", "p2")]
    seen = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("b", "p2"), ("c", "p2"), ("x", "p3"), ("y", "p3"), ("z", "p4")], "doc_id string, entity_id string")
    got = {r.doc_id: (r.standing, r.named) for r in people.objective_match(seen, roster, "What did Ann do?").collect()}
    assert got == {"a": ("main", False), "b": ("main", True), "c": ("main", True), "x": ("foreign", False), "y": ("foreign", False), "z": ("isolated", False)}
