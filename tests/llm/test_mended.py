"""What once lost data, crashed or grew with a square."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewell.llm import extract, jaccard, media, phrases, rindex, search

LONG = "This is a sentence that is long enough, with commas, and it goes on for quite a while. It ends here."


@pytest.mark.parametrize("key", ["string", "date", "long"])
def test_keep_one_takes_keys_of_any_type(spark, key):
    make = {"string": str, "date": lambda i: datetime.date(2020, 1, i + 1), "long": int}[key]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(make(3), text), (make(1), text.upper()), (None, text), (make(2), "other words stand in this one here"), (None, ""), (make(5), None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, f"doc_id {key}, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {(make(1), text.upper()), (make(2), rows[3][1]), (None, ""), (make(5), None)}


def test_equal_rows_give_spans_in_proportion(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(60))
    n = 3000
    docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.range(n).select(F.lit(None).cast("long"), F.lit(text))).repartition(8)
    for spans in (phrases.phrase_spans(docs), rindex.dedup_spans(docs)):
        sizes = spans.agg(F.max(F.size("_tw_spans")), F.min(F.size("_tw_spans")), F.count(F.lit(1))).first()
        assert 2 <= sizes[1] and sizes[0] < 64 and sizes[2] == 2 * n


def brute_top(rows, k, every):
    import math

    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % every == 0:
            scores = sorted((max(-search.MOST_SCORE, min(search.MOST_SCORE, sum(a * b for a, b in zip(q, v, strict=True)))) * -1, j) for m, (j, v) in enumerate(whole) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.0]), (1, [3e7, 0.0]), (2, [0.5, 0.0])],
    [(0, [1.0, 0.0]), (1, [3e37, -1.0]), (2, [-3e37, 5.0]), (3, [1e9, 1e9]), (50, [2e30, 2e30]), (4, [0.0, 7.0]), (5, [1e20, 0.3])],
])
def test_no_vector_is_too_large(spark, rows):
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 3, 50)


def test_only_picked_queries_move(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(3000)]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 10)


@pytest.mark.parametrize(("page", "text"), [
    (f"<form id=aspnetForm><article><p>{LONG}</p></article></form>", LONG),
    (f"<form id=f><div><p>{LONG}</p><p>{LONG}</p></div></form><form><label>Name</label><p>Send it, please.</p></form>", f"{LONG}\n{LONG}"),
    (f"<main><fieldset><p>{LONG}</p></fieldset></main>", LONG),
    ("<article><p>a <label>Sir</label> text, yes.</p></article>", "a Sir text, yes."),
    (f"<article><p>{LONG}</p></article><div class='user-comments'><p>{LONG} no</p></div>", LONG),
    (f"<article><p>{LONG}</p><div class='user-comments'><p>{LONG} no</p></div></article>", LONG),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><div id='cookie-law-info-bar'><p>{LONG} cookies</p></div>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><p>Subscribe now, please.</p></form></article>", LONG),
    ("<body><form><label>User</label> <label>Password</label></form></body>", ""),
])
def test_forms_and_marks(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("token", ["has-sidebar", "overflow-hidden", "share-price", "social-science", "content-sidebar-wrap", "article-header", "cookie-recipe", "reader"])
def test_tokens_that_name_content_or_layout(token):
    assert not extract.names_other(token)


def test_damaged_media_give_null_or_a_value():
    rng = random.Random(3)
    whole = media.encode(media.pad(b"some payload " * 400))
    assert media.features_of(whole)["samples"] == -(-5200 // 192)
    head = whole.index(b"mdat")
    for _ in range(10_000):
        raw = bytearray(whole[: rng.choice([len(whole), rng.randrange(len(whole))])])
        for _ in range(rng.randint(1, 6)):
            if raw:
                at = rng.randrange(min(len(raw), head))
                raw[at : at + rng.choice([1, 4])] = rng.choice([b"\xff\xff\xff\xff", b"\0", bytes([rng.randrange(256)]), b"moof", b"trun"])
        found = media.features_of(bytes(raw))
        assert found is None or found["samples"] <= len(raw)


def test_media_built_to_hurt():
    nested = b""
    for _ in range(3000):
        nested = struct.pack(">I4s", len(nested) + 8, b"moov") + nested
    assert media.features_of(nested) is None
    trak = lambda *inner: media.box(b"moov", media.box(b"trak", *inner))
    stbl = lambda *inner: trak(media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *inner))))
    assert media.features_of(trak(media.box(b"tkhd"))) is None
    assert media.features_of(stbl(media.box(b"stz2", struct.pack(">III", 0, 4, 1 << 31)))) is None
    assert media.features_of(stbl(media.box(b"stsz", struct.pack(">III", 0, 1, (1 << 32) - 1)))) is None
    assert media.features_of(stbl(media.box(b"stsz", struct.pack(">III", 0, 0, (1 << 32) - 1)))) is None


def rows_of_a_family(spark, n, seed, linked):
    """n sets of 200 numbers that share 80 (linked: all but a few) and their sketches, each its own component but for a main one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**63, 200).astype(np.uint64)
    rows = []
    for i in range(n):
        own = 3 if linked else 120
        tokens = np.concatenate([shared[: 200 - own], rng.integers(0, 2**63, own).astype(np.uint64)])
        sketch = jaccard.sketches(np.sort(tokens), np.array([0, len(tokens)]))[0]
        rows.append((7, 0, i, 0 if i % 3 == 0 else i, 200, bytearray(sketch), i % 5, i % 4))
    return spark.createDataFrame(rows, "family long, main long, node long, component long, n_shingles long, sketch binary, block int, rest int")


def test_texts_go_only_where_sketches_may_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 300)
    n = 2000
    assert jaccard.met_in(rows_of_a_family(spark, n, 1, linked=False)).count() <= n // 100
    sent = jaccard.met_in(rows_of_a_family(spark, 200, 2, linked=True)).groupBy("role").agg(F.count_distinct("node").alias("n")).collect()
    assert {r.role: r.n for r in sent} == {0: 199, 1: 133}  # all but the last, which no other of the rest is below
