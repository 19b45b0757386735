"""Reports, windows, stores and sources, end to end on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import links, passages
from tracewell.plans import flows, reporting
from tracewell.sources import pages, store

SECTIONS = {
    "theft": "E1 | took it\nMET: Yes [memo p.1]\nE2 | on several days\nINSTANCES ESTABLISHED: one [memo p.1]\nMET: Yes\n**Disposition:** Substantiated\nE1 | MET: No",
    "lies": "E1 | lied\n| MET: No [memo p.2] |\nE7 | more\nMET: Yes [memo p.2]\nDisposition: Substantiated",
    "sloth": "E1 | slept\nMET: Yes [unknown p.4]\nSo says [the allegation].\nDisposition: Substantiated in part",
    "fraud": "E1 | signed\nMET: Yes [memo p.1]\nDisposition: Not substantiated",
}
PLANS = {"theft": "E1 | ELEMENT: took it\nMULTIPLICITY: no\nE2 | ELEMENT: on several days\nMULTIPLICITY: yes", "lies": "E1 | ELEMENT: lied\nMULTIPLICITY: no", "sloth": "cannot", "fraud": "E1 | ELEMENT: signed\nMULTIPLICITY: yes"}


class Stub:
    def generate(self, prompts):
        table = lambda p: PLANS if p.startswith("Decompose") else SECTIONS
        return [next(v for k, v in table(p).items() if k in p) for p in prompts]


def test_report(spark):
    allegations = spark.createDataFrame([("1", "repeated theft"), ("2", "lies"), ("3", "sloth"), ("4", "fraud once")], "ref string, allegation string")
    facts = spark.createDataFrame([("memo", 1, "He took it.", "took", "2024-06-06", ["1"], False), ("memo", 2, "He lied.", "lied", None, ["2"], False)], "doc_id string, page_num int, quote string, predicate string, event_date string, refs array<string>, unrestricted boolean")
    documents = spark.createDataFrame([("memo", "memo.docx", 3)], "doc_id string, filename string, page_count int")
    got = {r.ref: r for r in reporting.generate(allegations, facts, documents, Stub()).collect()}
    # one day and one occasion don't make several
    assert (got["1"].disposition, got["1"].corrected, got["1"].unsettled) == ("negative", True, False) and "E2: one occasion" in got["1"].body
    assert (got["2"].disposition, got["2"].corrected, got["2"].stray) == ("negative", True, [7])
    assert (got["3"].disposition, got["3"].unsettled, got["3"].unweighed) == ("negative", True, [1]) and "[the allegation]" not in got["3"].body
    assert (got["4"].disposition, got["4"].corrected) == ("affirmative", True)  # repetition was not alleged
    assert all(r.body.count("**Disposition:**") == 1 for r in got.values())


class Windows:
    """Names a pair in every window of four ids or fewer; longer answers break off."""

    def generate(self, prompts):
        return ["A1 | B1 | caused | A | 0.9 | p.1\n" + ("End of answer" if len(p.split()) <= 4 else "A1 | B") for p in prompts]


def test_windows_are_split_until_they_end(spark):
    entity = spark.createDataFrame([(f"e{k:03d}",) for k in range(30)], "entity_id string")
    prompt = lambda x, y: F.concat_ws(" ", F.array_distinct(F.concat(x, y)))
    found, rest = flows.grouped_pass(entity, Windows(), prompt, ["caused"])
    assert found.count() > 0 and found.where("relation <> 'caused'").count() == 0
    sizes = [(len(r.left_ids), len(r.right_ids), r.same) for r in rest.collect()]
    pairs = sum(a * (a - 1) // 2 if s else a * b for a, b, s in sizes)
    assert 0 < pairs < 30 * 29 // 2


@pytest.mark.parametrize("block", [links.PAIR_BLOCK, 3])
def test_connected_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(links, "PAIR_BLOCK", block)
    rng = random.Random(4)
    rows = [(f"e{rng.randrange(12)}", f"d{rng.randrange(3)}", rng.choice([None, "x", "y"])) for _ in range(60)]
    near = spark.createDataFrame([("z2", "z1")], "a string, b string")
    got = {(r.a, r.b) for r in links.connected(spark.createDataFrame(rows, "entity_id string, doc_id string, day string"), near).collect()}
    want = {(a, b) for a, d, x in rows for b, e, y in rows if a < b and (d == e or x and x == y)} | {("z1", "z2")}
    assert got == want


@pytest.mark.parametrize("block", [passages.NEAR_BLOCK, 4])
def test_near_pairs_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(passages, "NEAR_BLOCK", block)
    rng = random.Random(5)
    rows = [(k, k % 2, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(40)] + [(99, 0, [1.0]), (98, 0, [])]
    got = {(r.a, r.b) for r in passages.near_pairs(spark.createDataFrame(rows, "id int, label int, v array<double>"), "label", 0.5, "id", "v").collect()}
    dot = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)), 4)
    assert got == {(a, b) for a, la, x in rows for b, lb, y in rows if a < b and la == lb and len(x) == len(y) > 0 and dot(x, y) >= 0.5}


def test_store_replaces_all_or_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    store.replace(spark, base, {"a": one, "b": one})
    store.replace(spark, base, {"a": two, "b": two})
    assert {n: df.count() for n, df in store.read(spark, base, "a", "b").items()} == {"a": 5, "b": 5}
    broken = one.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.replace(spark, base, {"a": one, "b": broken})
    assert {n: df.count() for n, df in store.read(spark, base, "a", "b").items()} == {"a": 5, "b": 5}
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["a", "b"]


def test_pdf_and_image_pages(spark):
    files = spark.createDataFrame([("d", b"long|short"), ("e", b"bad")], "doc_id string, content binary")

    def read(content):
        if content == b"bad":
            raise ValueError("no pdf")
        return [("x" * 200, ["look here"]), ("y", [])]

    got = {(r.doc_id, r.page_num): r for r in pages.pdf_pages(files, read, lambda c, n: b"img%d" % n).collect()}
    assert got["d", 1].text.endswith("[comment: look here]") and got["d", 1].text_source == "embedded" and got["d", 1].route is None
    assert got["d", 2].route == "vlm" and bytes(got["d", 2].image) == b"img2" and got["e", 1].error == "no pdf"
    upright = pages.image_pages(files, lambda c: c[::-1] if c != b"bad" else 1 / 0).collect()
    assert {r.doc_id: bytes(r.image) for r in upright} == {"d": b"trohs|gnol", "e": b"bad"} and {r.doc_id: r.error is None for r in upright} == {"d": True, "e": False}
    kinds = files.select("*", F.lit("f.pdf").alias("filename"), F.lit("pdf").alias("media_type"))
    docs, _ = flows.ingest(kinds, read)
    assert {r.doc_id: r.status for r in docs.collect()} == {"d": "processing", "e": "failed"}
    assert {r.status for r in flows.ingest(kinds)[0].collect()} == {"queued"}
