"""Every operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import anchors, chat, extract, jaccard, media, mixing, packing, phrases, rindex, search, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, spans int, node string"


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(400)]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, texts = draw(70), [None, "", "   ", "one", "One", "a b c", "\t\n", "x" * 700, "0 " * 450]
    for _ in range(40):
        texts.append(draw(rng.randint(3, 160)))
    base = draw(120)
    texts += [base, base, base.upper(), base]
    for _ in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{draw(20)} {passage} {draw(9)}" for _ in range(5)] + [f"{draw(4)}\n{passage[:250]}  {draw(3)}"] + [draw(9000)] + [f"{passage} {passage}"]
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [(5, "a b c", "en", "s1", 5, "x", 1, "y"), (None, TEXTS[20], "en", "s2", 3, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(map(tuple, rows))


def test_media_round_trip(docs, empty):
    got = media.digest(media.encode_column(docs))
    want = []
    for i, t in all_rows(docs):
        raw = (t or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert counted(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()) == counted(want)
    assert media.digest(media.encode_column(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 64, 192 * 65 + 5, 300_000])
def test_media_tables_are_exact(n):
    payload = bytes(random.Random(n).randbytes(n))
    stored = media.encode(payload)
    assert media.payload_of(stored) == payload
    found = media.features_of(stored)
    assert found["codec"] == "raw " and found["samples"] == max(1, -(-n // 192))
    for key in found["keyframes"]:
        assert stored[key["offset"] : key["offset"] + key["size"]] in payload


def test_media_digest_by_hand(spark):
    """What is stored, found by the names of its boxes alone, and the features that follow from it."""
    text = "héllo " * 100
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % 192)
    stored = media.encode_column(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    blob = bytes(stored.first().media)
    at = blob.index(payload)
    assert blob.count(payload) == 1 and blob[at - 4 : at] == b"mdat"
    table = lambda kind: blob.index(kind) + 4
    be = lambda place: int.from_bytes(blob[place : place + 4], "big")
    n, size = be(table(b"stsz") + 8), be(table(b"stsz") + 4)
    keys = [be(table(b"stss") + 8 + 4 * k) for k in range(be(table(b"stss") + 4))]
    assert n * size == len(payload) and be(table(b"stco") + 8) == at
    places = [f"{at + (k - 1) * size}+{size}" for k in keys]
    seconds = be(table(b"mdhd") + 16) / be(table(b"mdhd") + 12)
    got = media.digest(stored).first()
    assert (got.n_bytes, got.payload_bytes, got.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert (got.tail_crc32, got.media_bytes, got.media_sha256) == (zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest())
    ranges = hashlib.sha256(",".join(places).encode()).hexdigest()[:16]
    assert got.feature == f"codec=raw;duration={seconds:.3f};samples={n};keyframes={len(keys)};ranges={ranges};first={places[0]};last={places[-1]}"


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def test_fragments_and_compact_sizes():
    be = lambda *xs: b"".join(x.to_bytes(4, "big") for x in xs)
    head = lambda *tables: box(b"trak", box(b"tkhd", be(0, 0, 0, 7)), box(b"mdia", box(b"mdhd", be(0, 0, 0, 1000, 0)), box(b"minf", box(b"stbl", *tables))))
    moov = box(b"moov", head(box(b"stsd", be(0, 1, 16), b"abcd", b"    ")), box(b"mvex", box(b"trex", be(0, 7, 1, 40, 5, 0x10000))))
    # a run with sizes, flags and an offset; one that follows it with the defaults of the track
    run = box(b"trun", be(0x000001 | 0x000004 | 0x000200, 2), (100).to_bytes(4, "big"), be(0), be(3, 4))
    moof = box(b"moof", box(b"traf", box(b"tfhd", be(0x020000, 7)), run, box(b"trun", be(0, 2))))
    t = media.tracks(moov + moof + box(b"mdat", bytes(200)))[0]
    base = len(moov)
    assert t["samples"] == [(base + 100, 3), (base + 103, 4), (base + 107, 5), (base + 112, 5)] and t["keys"] == [(base + 100, 3)]
    assert t["duration"] == 160 and t["timescale"] == 1000
    for bits, raw, want in ((4, bytes([0x12, 0x30]), [1, 2, 3]), (8, bytes([1, 2, 3]), [1, 2, 3]), (16, bytes([0, 1, 1, 0, 0, 3]), [1, 256, 3])):
        assert media.compact_sizes(memoryview(be(0) + bytes([0, 0, 0, bits]) + be(3) + raw), 0) == want


def test_media_features_of_what_is_no_media(spark):
    df = spark.createDataFrame([(1, b"none"), (2, None), (3, media.encode(b"abc")), (4, media.encode(b"abc")[:60])], "id int, media binary").withColumn("features", F.lit(1))
    got = {r.id: r.features for r in media.inspect_column(df).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and got[3].keyframes[0].size == 3


def sets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    s, at = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                at[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s[i]), least.get(root(i)) if s[i] else d) for i, (d, _) in enumerate(rows)]


def test_jaccard_components(docs, empty):
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(got) == counted(components_of(all_rows(docs)))
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    n = len({c for d, k, c in components_of(all_rows(docs)) if k})
    assert kept.where(F.col("text").rlike(r"\S")).count() == n


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies that don't all link, in groups far above a block's size, against all pairs."""
    for name, size in (("BLOCK_SETS", 64), ("SMALL", 4)):
        monkeypatch.setattr(jaccard, name, size)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=60)
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == {d: (n, c) for d, n, c in components_of(rows)}
    assert 3 < len({c for _, c in got.values()}) < 650


@pytest.mark.parametrize("near", [True, False])
def test_signatures_lose_no_link(near):
    rng = np.random.default_rng(3)
    edges = jaccard.edges_of_bands(1 << 20)
    plans = [jaccard.plan(int(edges[k + 1]) - 1, 10**9 if near else 1) for k in range(len(edges) - 1)]
    assert any(p[1] for p in plans)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, n // 4 + 2))):
            b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**63, dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            row, sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), edges, plans)
            assert np.intersect1d(sig[row == 0], sig[row == 1]).size


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights a 5, b 2, c 1, null 5: a stops at 30, the rest is 1480 over 2 and 5
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] == pytest.approx(1480 * 2 / 7) and got[None] == pytest.approx(1480 * 5 / 7)


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    assert counted((r.doc_id, r.size) for r in rows) == counted((d, len(WORD.findall(t or ""))) for d, t in all_rows(docs))
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert counted(mixing.mix(docs.repartition(5)).collect()) == counted(rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in rows)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in taken.collect()) == sum(r.taken for r in rows)


def queue(rows, weights=(5, 2, 1), most=3):
    """Taken words of each row (doc_id, source, h, size), by the queue as it is told: every pass of every document, by virtual
    finish time, until the words are used up."""
    total = sum(r.size for r in rows)
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.size for r in rows if r.source == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:  # fill, fix those above their limit, fill the rest again
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level > most * size[s]}
        if not full:
            break
        target |= {s: most * size[s] for s in full}
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    line, ahead = [], Counter()
    for r in sorted(rows, key=lambda r: ((r.h >> 20) % 64, r.h)):  # shuffled by a hash
        for k in range(most):
            turn = k * size[r.source] + ahead[r.source]
            if r.size and target[r.source] and turn / target[r.source] < 1:
                line.append(((turn + r.size) / target[r.source], r.h, turn, r))
        ahead[r.source] += r.size
    taken, used = Counter(), 0
    for _, h, _, r in sorted(line, key=lambda x: x[:3]):
        part = min(r.size, max(0, total - used))
        used += r.size
        taken[(r.doc_id, r.source, h)] += part
    return taken, target


def test_mix_equals_a_plain_queue(docs):
    rows = mixing.mix(docs).collect()
    taken, target = queue(rows)
    for r in rows:
        assert r.target == pytest.approx(target[r.source])
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.source, r.h)] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def test_take_keeps_rows_apart(spark):
    rows = [(1, "a b c d", "s1", 1), (1, "a b c d", "s2", 1), (1, "a b c d", "s2", 2), (1, "a b c d", "s2", 2), (2, None, None, 3), (None, "e f", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _tw_x int")
    own = {r.source: r.target for r in mixing.mix(df).collect()}
    got = mixing.take(df).collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
        assert (r.doc_id, r.source, r["_tw_x"]) in {(d, s, x) for d, _, s, x in rows}
    assert sum(words.values()) == 18 and all(abs(words[s] - own[s]) <= 4 for s in own)
    assert counted(mixing.take(df.repartition(4)).collect()) == counted(got)


def test_search(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=24) * rng.integers(1, 4)]) for i in range(700)]
    data[51] = (51, data[50][1])
    data += [(50, data[3][1]), (900, None), (950, [None] * 24), (1000, [float("nan")] * 24), (1050, []), (1100, [1.0, 2.0]), (1150, [3.0, 1.0]), (None, data[0][1])]
    data += [(1200 + 50 * i, [float(x) for x in rng.normal(size=3) * 2.0**20]) for i in range(4)] + [(1501, [2.0**40] * 3), (1550, [1e30] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    small = lambda v: all(abs(x) < 2.0**22 for x in v)  # noqa: E731  larger ones take no part
    whole = [(i, np.floor(256 * np.array(v, float))) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and small(v)]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 50 == 0:
            others = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(whole) if m != n and len(v) == len(q))[:5]  # noqa: E501
            want += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    assert counted(search.top_k(df).collect()) == counted(want)
    assert search.top_k(df.where("vec_id = 1")).count() == 0
    assert search.top_k(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("size", [4096, 16])
def test_search_in_small_blocks(spark, size, monkeypatch):
    for name, value in (("BLOCK", size), ("QUERY_BLOCK", 4), ("PAGE", 8)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16))
    data = [(i, [float(x) for x in centres[i % 8] + 0.05 * rng.normal(size=16)]) for i in range(600)]
    v = np.floor(256 * np.array([x for _, x in data]))
    want = []
    for i in range(0, 600, 20):
        others = sorted((-int(v[i] @ v[j]), j) for j in range(600) if j != i)[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    got = search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3), 3, 20)
    assert counted(got.collect()) == counted(want)


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(30, 37))
    assert (search.reach(q, search.outline(x)[None])[:, 0] >= (q @ x.T).max(1)).all()
    for level in search.LEVELS:
        assert (search.statistics(q, level) @ search.statistics(x, level).T >= q @ x.T - 1e-9).all()


def windows_of(rows, unit, w):
    parts = [unit(t) for _, t in rows]
    seen = Counter(tuple(p[k : k + w]) for p in parts for k in range(len(p) - w + 1))
    out = []
    for p in parts:
        marked = [False] * len(p)
        for k in range(len(p) - w + 1):
            if seen[tuple(p[k : k + w])] > 1:
                marked[k : k + w] = [True] * w
        out.append(marked)
    return parts, out


@pytest.mark.parametrize("whole, search", [(anchors.WHOLE, anchors.SEARCH_BYTES), (0, 2000)])
def test_suffix_and_phrase_spans(docs, empty, whole, search, monkeypatch):
    monkeypatch.setattr(anchors, "WHOLE", whole)
    monkeypatch.setattr(anchors, "SEARCH_BYTES", search)
    rows = all_rows(docs)
    for find, unit, w in ((rindex.dedup_spans, lambda t: (t or "").encode(), 200), (phrases.phrase_spans, lambda t: WORD.findall(t or ""), 35)):
        parts, marked = windows_of(rows, unit, w)
        got = counted((r.doc_id, r.text, tuple(map(tuple, rindex.flat_spans(r["_tw_spans"]).tolist()))) for r in find(docs).collect())
        want = counted((d, t, tuple(map(tuple, anchors.runs(np.array(m, bool), np.array([0, len(m)]))[0].tolist()))) for (d, t), m in zip(rows, marked, strict=True))
        assert got == want and any(s for _, _, s in want)
        assert find(empty).count() == 0
        del parts


def test_phrases_are_found_by_the_automaton():
    words = [f"w{k}" for k in range(50)]
    passage = " ".join(words[:40])
    texts = pa.array([f"a {passage} b", None, "", f"{passage} {passage}", "x y"])
    held = pa.array([[passage.encode()], None, None, [passage.encode()], [passage.encode()]], pa.list_(pa.binary()))
    *_, spans = phrases.occurrences(texts, held)
    assert [s.tolist() for s in spans] == [[[1, 41]], [], [], [[0, 80]], []]
    assert [len(s) for s in phrases.recurring([(passage.encode(), 2), (b"a b", 9), (b"", 3), (" ".join(words[10:50]).encode(), 1)])] == [1, 0, 0, 0]


def test_a_broken_automaton_removes_nothing(spark, docs, monkeypatch):
    rows = docs.where("text is not null").limit(60)
    assert phrases.phrase_spans(rows.union(rows)).where("_tw_spans is not null").count() > 0
    batch = pa.array(["a b c"]), pa.array([[b"a b"]], pa.list_(pa.binary()))
    assert phrases.occurrences(*batch)[-1][0].tolist() == [[0, 2]]
    monkeypatch.setattr(phrases, "automaton", lambda found: found_nothing())
    assert not len(phrases.occurrences(*batch)[-1][0])


def found_nothing():
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    out.add_word((10**6,), 1)
    out.make_automaton()
    return out


def test_dedup_text_keeps_characters(spark, docs):
    out = rindex.dedup_text(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    long = "é" * 150
    df = spark.createDataFrame([(1, "x" + long + "é tail"), (2, "y" + long + "ê end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in rindex.dedup_text(df).collect()}
    assert got == {1: "x tail", 2: "yê end", 3: None}  # the first byte of ê repeats, the letter does not


def test_run_index_samples_run_ends():
    text = bytes(random.Random(1).randbytes(900))
    index = rindex.build([text, *[bytes([k]) + text[100:700] for k in range(20)]], [1] * 21, 200)
    assert len(index.byte) < index.length.sum() / 8
    ms = rindex.matching_statistics(index, np.array([900] + [601] * 20))
    assert ms[100] == 600 and ms[300] == 400 and ms[901] == 600 and ms[900] < 200 and ms[0] < 200


@pytest.mark.parametrize("seed", range(6))
def test_run_index_is_the_transform(seed):
    rng = random.Random(seed)
    base = rng.choices(b"ab" if seed % 2 else b"acgt", k=300)
    contents = [bytes(base[rng.randint(0, 40) : rng.randint(60, 300)]) + bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(8)]
    copies, window = [rng.choice((1, 1, 2)) for _ in contents], 8
    n = np.array([len(c) for c in contents])
    suffixes = [(c[i:], k, i) for k, c in enumerate(contents) for i in range(len(c) - window + 1)]
    suffixes.sort(key=lambda x: x[0])
    want = [-1 if i == 0 else contents[k][i - 1] for _, k, i in suffixes]
    index = rindex.build(contents, copies, window)
    assert np.repeat(index.byte, index.length).tolist() == want
    # each suffix's longest match elsewhere, by comparison with all others
    prefix = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    ms, first = rindex.matching_statistics(index, n), np.cumsum(n) - n
    for s, k, i in suffixes:
        longest = max([prefix(s, t) for t, q, j in suffixes if (q, j) != (k, i)] + [len(s)] * (copies[k] > 1))
        if longest >= window:
            assert ms[first[k] + i] == longest
    # the answer hangs on the runs' ends alone
    index.first_match[:], index.last_match[:] = 0, 0
    index = rindex.RunIndex(index.byte, index.length, index.first, index.first_match, index.last, index.last_match, (index.repeats[0][:0], index.repeats[1][:0]))
    assert not rindex.matching_statistics(index, n).any()


PAGE = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies, as ever.</div>{0}<aside>See also.</aside><div id=comments><p>First, great!</p></div><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE.format("<article><h1>A &amp; B</h1><p><b>One,\n two. <br><p>Three.<form><input></form></article>"), "A & B\nOne, two.\nThree."),
        (PAGE.format("<div class=post><h2>T</h2><p>One, two. And more of it.</p><ul><li>x</li></ul></div>"), "T\nOne, two. And more of it.\nx"),
        (PAGE.format("<p>Plain paragraph, long enough. Yes.</p><p>Be.</p>"), "Plain paragraph, long enough. Yes.\nBe."),
        ("<script>var t='<p>no</p>'</script><!-- c --><p>Yes, it is.", "Yes, it is."), ("no tags", "no tags"), ("", ""), (None, ""), ("<p></p>", ""), ("<nav>Menu</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert extract.main_text(page) == text


LEAD, SMALL = "A lead of some words, in two parts. It is short.", "A section of its own, small as it is. But it counts, too."
PARAGRAPH = "Long text, with marks. And more of it, and so on. " * 6


@pytest.mark.parametrize("n", [1, 10, 1000])
@pytest.mark.parametrize("outer", ["{0}", "<html><body>{0}</body></html>", "<html><body><div><div>{0}</div></div></body></html>"])
def test_leads_stay_however_long_the_body(n, outer):
    page = f"<div><h1>Title</h1><p>{LEAD}</p><div>{f'<p>{PARAGRAPH}</p>' * n}</div><section><h2>More</h2><p>{SMALL}</p></section><ul><li><a href=/>Home, and away.</a></ul></div>"
    want = ["Title", LEAD, *[PARAGRAPH.strip()] * n, "More", SMALL]
    got = extract.main_text(outer.format(page)).split("\n")
    assert got == want
    nested = f"<h1>Title</h1><div><div>{f'<p>{PARAGRAPH}</p>' * n}</div></div>"
    assert extract.main_text(outer.format(nested)).split("\n") == ["Title", *[PARAGRAPH.strip()] * n]


def test_a_lead_stays_beside_one_vast_paragraph():
    vast = (PARAGRAPH * 100).strip()
    assert extract.main_text(f"<body><div><h1>Title</h1><p>{LEAD}</p><div><p>{vast}</p></div></div><p>&copy; me</p></body>").split("\n") == ["Title", LEAD, vast]


@pytest.mark.parametrize("wrap", ["<div class='overflow-hidden'>{0}</div>", "<div id=reader>{0}</div>", "<div title='a hidden gem' data-x=\"class='nav'\">{0}</div>", "<div class='layout has-sidebar md:hidden'>{0}</div>", "<svg/>{0}", "<svg width='1' /><math/>{0}", "<svg width=1>{0}"])
@pytest.mark.parametrize("article", ["<article>{0}</article>", "<article class='has-sidebar sidebar'>{0}</article>", "<main id=main-header>{0}</main>", "<div class=post><div class='page-header'><h1>T</h1></div><p>One, two. And more of it.</p></div>"])
def test_layout_loses_no_article(wrap, article):
    page = f"<html><body><nav>Menu</nav>{wrap}</body></html>".format(article.format("<h1>T</h1><p>One, two. And more of it.</p>"))
    assert extract.main_text(page) == "T\nOne, two. And more of it."


@pytest.mark.parametrize("attributes", ["class=ad", "class='x ad-slot-2'", "class='ad-300x250'", "class=siteFooter", "id='comments'", "class='cookie-banner wrapper'", "class=related-posts", "hidden", "title='x'hidden=''", "style='color:red; display: none'", "aria-hidden=true", "role=navigation", "class=site-header"])
def test_what_is_marked_goes(attributes):
    page = f"<body><div class=post><p>One, two. And more of it.</p><p>Three, four.</p></div><div {attributes}><p>Not this, of course. No.</p></div></body>"
    assert extract.main_text(page) == "One, two. And more of it.\nThree, four."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p class=it's>Hello, there. Text.</p><p>More, text.</p>", "Hello, there. Text.\nMore, text."), ("<p title='a > b'>One, two.</p>", "One, two."), ('<p title="a > b" x=">">One, two.</p>', "One, two."), ("<a b='c", ""),
        ("<article class='post tag-social share'><p>Hello, there. Text.</p></article>", "Hello, there. Text."), ("<div class='social-life'><p>Hello, there. Text.</p></div>", "Hello, there. Text."),
        ("<div class='comments'><p>All there is, here. Yes.</p></div>", "All there is, here. Yes."), ("<p>The text</p><div class=ad>Buy, now. Buy, here. Buy, there.</div>", "The text"),
        ("<p>The <span class=ad>Buy, now.</span> text, whole. Yes.</p>", "The\ntext, whole. Yes."), ("<div hidden><p>One, two.</p></div>", ""),
    ],
)
def test_marks_and_quotes(page, text):
    assert extract.main_text(page) == text


class Article(HTMLParser):
    """The blocks of a page's article by the standard library's parser, for pages that close what they open but for br and img."""

    BLOCK = frozenset("article p div ul ol li h1 h2 h3 h4 blockquote pre table tr td th section figure".split())
    SKIP = frozenset("script style form nav aside footer header button select".split())

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.now = [], [], []

    def flush(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            self.now.append("\n" if tag == "br" else "")
            return
        if tag in self.BLOCK:
            self.flush()
        self.open.append((tag, "ad" in (dict(attrs).get("class") or "").split()))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            if tag in self.BLOCK:
                self.flush()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not self.SKIP & set(tags) and not any(ad for _, ad in self.open):
            self.now.append(data)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no driver tables")
def test_articles_equal_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in extract.op6_main_text(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        plain = Article()
        plain.feed(r.html or "")
        plain.close()
        plain.flush()
        assert got[r.page_id] == "\n".join(plain.blocks), r.page_id
    assert len(got) == len(rows) > 0


@pytest.mark.parametrize("page", ["<div>" * 60000 + "x", "<div>" * 30000 + "</section>" * 30000, "<ul>" + "<div>" * 20000 + "<li>a" * 20000, "<p>a<b>" * 40000, "<script>" * 40000, "<div><b>" * 30000 + "</i>" * 30000])
def test_nesting_costs_in_proportion(page):
    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 3


def test_a_self_closed_drawing_is_empty():
    assert extract.main_text("<article><p>One, two.</p><svg/><p>Three, four.</p><svg a=b><text>no</text></svg></article>") == "One, two.\nThree, four."


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi, you. All.</article>", "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract.extract(df).collect()), key=str) == sorted([(1, "u", "Hi, you. All.", 13), (None, None, "", 0)], key=str)
    assert extract.extract(df.where("page_id > 5")).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 40, "ann", "late"), (2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "ann", "y"), (4, 1, "ann", "same"), (4, 1, "ann", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    got = chat.rotate(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.perspective, r.start)):
        text = by.setdefault((r.conv_id, r.perspective), "")
        assert r.start == len(text) and r.length == len(r.piece)
        by[r.conv_id, r.perspective] = text + r.piece
    assert by[1, "bob"] == "<|system|>\nBe kind.<|end|>\n<|user name=ann|>\nHi<|end|>\n<|user name=ann|>\ntie<|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>\nlate<|end|>\n"
    own = [r for r in got if r.conv_id == 1 and r.perspective == "ann" and r.mask_length]
    assert {by[1, "ann"][r.mask_start : r.mask_start + r.mask_length] for r in own} == {"Hi<|end|>\n", "tie<|end|>\n", "late<|end|>\n"}
    assert set(by) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann"), (4, "ann")} and len([r for r in got if r.conv_id == 4]) == 2
    assert chat.rotate(df.where("turn > 99")).count() == 0


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(packing.TOKENIZER)


def test_word_ids_equal_whole_texts():
    path = tokenizer_path()
    own = packing.WordIds(path)
    texts = [t or "" for t in TEXTS] + ["I'll  \t b's İstanbul 3.14 中文 !!'s don'T", "á b ΣΑΣ x y <|endoftext|>z", "a\u0085b\x1cc"]
    for t, ids in zip(texts, own.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def first_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    return len(room)


def test_packing(docs, empty):
    path = tokenizer_path()
    rows = packing.best_fit_pack(docs, path, capacity=512).collect()
    own = packing.WordIds(path)
    want = []
    for d, t in all_rows(docs):
        ids = own.ids([t or ""])[0] + np.array([1], "<u4").tobytes()
        want += [(d, k, s, len(ids[4 * s : 4 * s + 2048]) // 4, zlib.crc32(ids[4 * s : 4 * s + 2048])) for k, s in enumerate(range(0, len(ids) // 4, 512))]
    assert counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == counted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= first_fit([r.length for r in rows], 512) + 1 and packing.best_fit_pack(empty, path).count() == 0


def test_best_two_fit_is_whole():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        lengths = rng.integers(1, 101, n)
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(lengths[b].sum() <= 100 for b in bins)
    assert len(packing.best_two_fit(np.array([60, 50, 45, 40, 5]), 100)) == 2


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    clean = [" ".join(rng.choices(["the", "of", "sea", "red", "fox", "ran", "home"], k=30)) for _ in range(300)]
    rows = [(i, t if i % 5 else t.replace("sea", "vile scum", 2) + " vile scum", int(i % 5 == 0)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("source", F.lit("x"))
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.train(df.select("doc_id", "text"), labels)
    assert 0 < len(model.index) < 100
    for r in toxicity.score(df, model).collect():
        assert (r["_tw_score"] >= toxicity.THRESHOLD) == (r.toxic == 1)
    assert toxicity.clean(df.drop("toxic"), labels).count() == 240
    none = toxicity.train(docs.select("doc_id", "text"), labels.where("doc_id > 10000"))
    assert none.bias == 0 and not len(none.index) and toxicity.score(docs, none).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0


def plain_ftrl(rows, labels, dims, alpha, beta, l1, epochs, toxic):
    """FTRL-proximal of one coordinate at a time, as published."""
    z, n, w = {}, {}, {}
    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            x = {int(i): toxicity.VALUES[i & toxicity.KIND] for i in at} | {dims: 1.0}
            for i in x:
                shrink = 0.0 if i == dims else l1
                zi = z.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= shrink else -(zi - (1 if zi > 0 else -1) * shrink) / ((beta + n.get(i, 0.0) ** 0.5) / alpha)
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v * (toxic if y else 1.0)
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    weight = lambda i, s: -(z[i] - np.sign(z[i]) * s) / ((beta + n[i] ** 0.5) / alpha)
    return weight(dims, 0.0), {i: weight(i, l1) * toxicity.VALUES[i & toxicity.KIND] for i in sorted(z) if i != dims and abs(z[i]) > l1}


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(3)
    dims = 64
    rows = [np.unique(rng.integers(0, dims, rng.integers(0, 12))) for _ in range(200)]
    labels = np.array([float(5 in r or 9 in r) for r in rows])
    got = toxicity.ftrl(rows, labels, dims, 2.0, 1.0, 0.5, 0.0, 3, 2.0)
    bias, want = plain_ftrl(rows, labels, dims, 2.0, 1.0, 0.5, 3, 2.0)
    assert got.bias == pytest.approx(bias) and got.index.tolist() == list(want)
    assert got.value == pytest.approx(np.array(list(want.values())))


def test_toxicity_features():
    row, at = toxicity.features(pa.array(["Abcdefgh abcd", None, "", "ab"]))
    kinds = Counter((int(r), int(a & toxicity.KIND)) for r, a in zip(row, at, strict=True))
    assert kinds == {(0, 0): 2, (0, 1): 1, (0, 4): 5, (3, 0): 1}  # two words, one pair, stems of 4 to 7 bytes and of 4
    stems = [set(at[(row == r) & (at & toxicity.KIND == 4)]) for r in (0,)][0]
    assert len(stems) == 4  # both words begin alike


def test_toxicity_sample_is_bounded(spark):
    rows = [(i % 40, f"word{i % 7} " * 50, int(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({"_label": F.lit(1), "_order": F.lit(2), "_key": F.lit("x")})
    labels = df.select("doc_id", "toxic")
    for options in ({"most": 5}, {"most_bytes": 2000}, {"most_bytes": 10}, {}):
        model = toxicity.train(df, labels, **options)
        assert toxicity.score(df, model).count() == 400
    assert toxicity.train(df.limit(0), labels).bias == 0
    nulls = spark.createDataFrame([(1, None), (2, None), (None, "x")], "doc_id long, text string")
    assert toxicity.score(nulls, toxicity.train(nulls, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))).count() == 3
    assert toxicity.clean(df, labels).columns == df.columns


def test_word_hashes_do_not_depend_on_place():
    texts = ["alpha Beta gamma", "", "gamma  alpha\tBETA " + "z" * 700_000 + " beta"]
    out = {}
    for group in ([texts[0]], [texts[2]], texts, texts[::-1]):
        raw = [t.encode() for t in group]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, first = words.spans(data, offs)
        for s, e, h in zip(starts, ends, words.hashes(data, starts, ends, lower=True), strict=True):
            key = bytes(data[s:e]).decode().lower()
            assert out.setdefault(key, h) == h
        assert first[-1] == len(starts)
    assert len(set(out.values())) == len(out) == 4


def test_chunks_split_batches():
    from tracewell.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    assert [c.num_rows for c in common.chunks(iter([batch]), "text", 20)] == [2, 1, 1]


def test_words_are_learnt_anew_beyond_the_bound(monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = packing.WordIds(tokenizer_path()).ids(texts)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 0)
    words = packing.WordIds(tokenizer_path())
    assert words.ids(texts) == want == words.ids(texts) and len(words.words) <= 1


def test_small_groups_of_pieces(docs):
    parts = packing.pieces(docs, tokenizer_path(), "text", "doc_id", 128)
    rows = packing.pack(parts, "doc_id", 128, group_rows=8).collect()
    assert counted((r.doc_id, r.piece, r.length) for r in rows) == counted((r.doc_id, r.piece, r.length) for r in parts.collect())
    full = Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 128


def test_one_bucket_of_a_running_sum(docs, monkeypatch):
    want = sum(r.taken for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MOST_BUCKETS", 1)
    rows = mixing.mix(docs).collect()
    assert sum(r.taken for r in rows) == want and all(0 <= r.taken <= 3 * r.size for r in rows)


@pytest.mark.parametrize("most", [jaccard.MOST_BITS, 9])
def test_sketches_never_exceed_the_difference(most, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
    parts = [np.unique(rng.choice(pool, n)) for n in (3, 300, 310, 2000, 2500)]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    drawn = jaccard.sketches(np.concatenate(parts), offs)
    p, q = np.triu_indices(len(parts), 1)
    differ = [len(np.setxor1d(parts[i], parts[j])) for i, j in zip(p, q, strict=True)]
    assert (jaccard.gaps(drawn, drawn, p, q) <= np.array(differ)).all()
