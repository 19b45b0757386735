"""The corpus pipeline, stage by stage against brute force, and with rows that stages must bear."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, packing, rindex

from test_llm_operators import SCHEMA, TEXTS, WORD, components_of, sets_of, windows_of

INSULT = "you vile scum and worthless filth of all"


def rows_of(extra=()):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [(1000 + i, f"{INSULT} {TEXTS[12 + i]}", "en", "s1", None, "x", 1, "y") for i in range(30)]
    return rows + [(5, "a b c", "en", "s1", 5, "x", 1, "y"), (None, TEXTS[20], "en", "s2", 3, "x", 1, "y"), *extra]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, 0) for i in range(len(TEXTS))] + [(1000 + i, 0, 1) for i in range(30)] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = common.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "suffix_dedup", "source_mix", "packing"]
    before = Counter(map(tuple, docs.collect()))
    out = common.materialize(stages["toxicity"](spark, docs, folder))
    left = Counter(map(tuple, out.collect()))
    assert out.columns == docs.columns and not left - before
    assert {r.doc_id for r in out.collect()} >= {i for i in range(len(TEXTS))} and not any(r.doc_id and r.doc_id >= 1000 for r in out.collect())
    docs, rows = out, out.collect()
    out = common.materialize(stages["ngram_jaccard"](spark, docs, folder))
    of = components_of([(k, r.text) for k, r in enumerate(rows)])
    groups = {component for (_, n, component) in of if n}
    assert out.count() == len(groups) + sum(not sets_of(r.text) for r in rows) and out.columns == docs.columns
    docs, rows = out, out.collect()
    out = common.materialize(stages["suffix_dedup"](spark, docs, folder))
    parts, marked = windows_of([(r.doc_id, r.text) for r in rows], lambda t: (t or "").encode(), 200)
    want = Counter()
    for r, raw, m in zip(rows, parts, marked, strict=True):
        spans = rindex.characters(bytes(raw), rindex.anchors.runs(np.array(m, bool), np.array([0, len(m)]))[0])
        want[(r.doc_id, None if r.text is None else rindex.keep(bytes(raw), spans).decode(), r.source)] += 1
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == want and out.columns == docs.columns
    docs, rows = out, out.collect()
    out = common.materialize(stages["source_mix"](spark, docs, folder))
    words = lambda t: len(sets_words(t))
    assert sum(words(r.text) for r in out.collect()) == sum(words(r.text) for r in rows) and out.columns == docs.columns
    held = Counter((r.doc_id, r.source) for r in rows)
    assert {(r.doc_id, r.source) for r in out.collect()} <= set(held)
    rows = out.collect()
    packed = stages["packing"](spark, out, folder).collect()
    import public_tokenizers

    ids = packing.WordIds(public_tokenizers.path(packing.TOKENIZER)).ids([r.text or "" for r in rows])
    total = Counter()
    for r, x in zip(rows, ids, strict=True):
        total[r.doc_id] += len(x) // 4 + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == total
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def sets_words(text):
    return WORD.findall(text or "")


def test_run_twice(spark, folder):
    first, second = (corpus_pipeline.run(spark, folder).agg(F.count(F.lit(1)), F.sum("length")).first() for _ in range(2))
    assert first == second and first[0] > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder, tmp_path):
    clash = ["_label", "_order", "_key", "_doc", "h", "size", "taken", "_tw_spans", "component", "node", "sequence_id", "piece"]
    docs = common.materialize(common.table(spark, folder, "documents").withColumns({c: F.lit(1) for c in clash}))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name, stage in corpus_pipeline.STAGES[:3]:
        more, plain = stage(spark, docs, folder), stage(spark, docs.drop(*clash[3:]), folder)
        assert more.columns == docs.columns and more.count() == plain.count(), name

