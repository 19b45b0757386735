"""Joins against all with all: overlaps, needles, dictionaries, containment, products."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import assertions, containment, dictionary, intervals, needles, passages


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, id int, start long, end long")


def test_overlaps_of_mixed_lengths(spark):
    rng = random.Random(1)

    def draw(n, shift):
        out = []
        for i in range(n):
            at = rng.randrange(-3000, 3000)
            out.append((rng.choice(["a", "b", None]), i + shift, at, at + rng.choice([0, -3, 1, 2, 8, 9, 63, 64, 65, 700, 5000])))
        return [*out, ("a", n + shift, None, 5), ("b", n + shift + 1, 2**40, 2**41)]

    left, right = draw(200, 0), draw(200, 1000)
    left += left[:3]  # equal rows are rows of their own
    got = sorted((r.l.id, r.r.id, r.start, r.end) for r in intervals.overlaps(spans(spark, left), spans(spark, right), ["k"]).collect())
    fine = lambda rows: [r for r in rows if r[0] and r[2] is not None and r[2] < r[3]]
    want = sorted((a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in fine(left) for b in fine(right) if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert got == want and len(want) > 500
    assert intervals.overlaps(spans(spark, []), spans(spark, right), ["k"]).collect() == []


def test_one_document_with_many_spans(spark):
    n = 100_000
    small = spark.range(n).select(F.lit("d").alias("k"), F.col("id").cast("int").alias("id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 15).alias("end"))
    large = spark.createDataFrame([("d", -1, 0, 10 * n + 100)], small.schema)
    # each touches the next; the one over all touches all
    met = intervals.overlaps(small.union(large), small.union(large), ["k"]).where("l.id < r.id")
    assert met.agg(F.count(F.lit(1)), F.count_if(F.col("l.id") < 0)).first() == (2 * n - 1, n)


def test_a_span_is_in_two_bins_at_most_at_its_level():
    for length in [1, 2, 7, 8, 9, 63, 64, 65, 512, 513]:
        level = -(-(length - 1).bit_length() // intervals.BITS)
        assert 8**level >= length and (level == 0 or 8 ** (level - 1) < length)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_needles(spark, whole, chars, monkeypatch):
    monkeypatch.setattr(needles, "SHARD_CHARS", chars)  # one shard, and several
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abé$_.", k=rng.randint(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(98, ""), (99, None), (1, "ab ab")]
    hay = [(i, " ".join(word() for _ in range(rng.randint(1, 2)))) for i in range(50)] + [(50, ""), (51, None), (52, "ab"), (53, "ab")]
    got = sorted(map(tuple, needles.find(spark.createDataFrame(hay, "n int, needle string"), spark.createDataFrame(texts, "t int, text string"), "n", "needle", "t", "text", whole).collect()))
    want = []
    for n, needle in hay:
        for t, text in texts:
            if needle is None or text is None or whole and not needle:
                continue
            found = re.search(rf"(?<![\w$]){re.escape(needle)}(?!\w)" if whole else re.escape(needle), text)
            if found:
                want.append((n, t, found.start()))
    assert got == sorted(want) and got


def test_needles_of_a_key(spark):
    facts = [("name", "MSgt Owen T. Brandt (appointing authority)"), ("name", "Ox"), ("name", "the NCOIC"), ("name", "of"), ("name", None), ("text", "On 4 May he paid $1,250.50, see AFI 36-2903 and Article 92; 14 of 2023-05-11, 12.50, 1400."), ("document", "doc-17"), ("document", "d1"), ("text", None)]
    got = {r.needle: r.short for r in needles.distinctive(spark.createDataFrame(facts, "kind string, value string")).collect()}
    assert got == {"MSgt Owen T. Brandt": False, "Owen": False, "Brandt": False, "Ox": True, "the NCOIC": False, "NCOIC": False, "4 May": False, "$1,250.50": False, "1,250.50": False, "AFI 36-2903": False, "Article 92": False, "2023-05-11": False, "12.50": False, "250.50": False, "doc-17": False}
    texts = spark.createDataFrame([(1, "everyone calls him Ox,\nhe said"), (2, "an Oxen pulls"), (3, "on 14 May"), (4, "on 4 May,")], "id int, text string")
    hits = needles.contaminated(needles.distinctive(spark.createDataFrame(facts, "kind string, value string")), texts, "id", "text").collect()
    assert sorted((r.needle, r.id, r.at) for r in hits) == [("4 May", 4, 3), ("Ox", 1, 19)] and {r.excerpt for r in hits} == {"everyone calls him Ox, he said", "on 4 May,"}


@pytest.mark.parametrize("longest", [False, True])
def test_names_in_texts(spark, longest):
    rng = random.Random(3)
    words = ["ann", "Roe", "bob", "poe", "é", "x_1", "de", "la"]
    names = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(40)] + [(40, None), (41, ""), (42, "Ann  ROE"), (43, "ann roe")]
    texts = [(i, " ".join(rng.choices([*words, "and,", "zed"], k=rng.randint(0, 25)))) for i in range(50)] + [(50, None), (51, "")]
    got = sorted(map(tuple, dictionary.occurrences(spark.createDataFrame(names, "n int, name string"), spark.createDataFrame(texts, "t int, text string"), "n", "name", "t", "text", longest).collect()))
    plain = lambda s: " ".join(re.sub(r"[^\w]+", " ", (s or "").lower()).split())
    found = []
    for t, text in texts:
        w = plain(text).split()
        for n, name in names:
            p = plain(name).split()
            if len(plain(name)) >= 3:
                found += [(n, t, i, len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    if longest:
        found = [h for h in found if not any(b[1] == h[1] and b[3] > h[3] and b[2] <= h[2] and h[2] + h[3] <= b[2] + b[3] for b in found)]
    assert got == sorted(found) and got


def test_names_are_let_through_by_a_bitmap_of_fixed_size(spark):
    names = spark.range(5000).select("id", F.concat(F.lit("name number "), F.col("id").cast("string")).alias("name"))
    flat = names.select(dictionary.flat(F.col("name")).alias("flat"))
    marked = dictionary.bitmap(flat, 1 << 20)
    assert len(marked) == 1 << 17 and 4900 < int(np.unpackbits(marked).sum()) <= 5000


def quotes(spark, rows):
    return spark.createDataFrame([(i, k, q) for i, (k, q) in enumerate(rows)], "item_id long, subject_name string, quote string").withColumns({c: F.lit("x") for c in ("subject_type", "predicate", "object_type", "object_name")}).withColumn("event_date", F.lit(None).cast("string"))


def test_dedupe_against_all_with_all(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcd é", k=n)).strip() for n in (3, 9, 14, 15, 16, 40, 62, 63, 64, 200, 455, 456, 1500, 3000)]
    rows = [(rng.choice("kl"), q) for q in base * 2]
    for _ in range(300):
        q = rng.choice(base)
        s = rng.randrange(len(q))
        rows.append((rng.choice("kl"), q[s : s + rng.choice([1, 2, 5, 14, 15, 30, 63, 100, 460, 2000])]))
    rows += [("k", ""), ("k", None), ("k", None), ("m", ""), ("m", "")]
    flat = [(k, None if q is None else " ".join(q.split()).lower()) for k, q in rows]
    got = sorted(r.item_id for r in assertions.dedupe(quotes(spark, rows), "item_id").collect())
    want = [i for i, (k, q) in enumerate(flat) if q is None or not any(j != i and l == k and o is not None and q in o and (len(o) > len(q) or len(o) == len(q) and j < i) for j, (l, o) in enumerate(flat))]
    assert got == want


def test_one_assertion_with_many_quotes(spark):
    n = 50_000
    # all share a long beginning; every tenth is the beginning of another
    text = F.concat(F.lit("the witness stated that it was seen at the gate by the guard, number "), F.sha2(F.floor(F.col("id") / 2).cast("string"), 256))
    cut = F.when(F.col("id") % 20 == 1, F.substring(text, 1, 110)).otherwise(F.concat(text, F.col("id").cast("string")))
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.lit("k").alias("subject_name"), cut.alias("quote"), *[F.lit("x").alias(c) for c in ("subject_type", "predicate", "object_type", "object_name")], F.lit(None).cast("string").alias("event_date"))
    assert assertions.dedupe(rows, "item_id").count() == n - n // 20


def test_marks_of_a_part_are_among_those_of_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        raw = bytes(rng.choices(b"abc", k=rng.randint(20, 1200)))
        s = rng.randrange(len(raw) - 15)
        part = raw[s : s + rng.randint(15, 1000)]
        for window, least in zip(containment.WINDOWS, containment.LEAST, strict=True):
            found = set(containment.marks(part, window).tolist())
            assert found <= set(containment.marks(raw, window).tolist()) and bool(found) == (len(part) >= least)


def near_brute(rows, threshold):
    out = []
    for i, (a, x, k) in enumerate(rows):
        for b, y, l in rows[i + 1 :]:
            if k == l and a is not None and b is not None and a != b and x and y and len(x) == len(y) and all(v is not None and np.isfinite(v) for v in x + y):
                score = round(float(np.dot(x, y)), 4)
                if score >= threshold:
                    out.append((k, min(a, b), max(a, b)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.8, 0.0, -0.5])
def test_products_of_vectors(spark, threshold, monkeypatch):
    monkeypatch.setattr(passages, "NEAR_BLOCK", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] * 0.3 + rng.normal(size=6) * 0.2).tolist(), "ab"[i % 2]) for i in range(120)]
    rows += [(120, [0.0] * 6, "a"), (121, None, "a"), (122, [], "a"), (123, [1.0, None] * 3, "a"), (124, [float("nan")] * 6, "b"), (125, [9.0], "a"), (126, [9.0], "a"), (None, [1.0] * 6, "a")]
    got = sorted((r.block, r.a, r.b) for r in passages.near_pairs(spark.createDataFrame(rows, "id int, v array<double>, label string"), "label", threshold, "id", "v").collect())
    assert got == near_brute(rows, threshold) and got


def test_few_parts_of_clustered_vectors_meet(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    n = 20_000
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * 0.01
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "id int, v array<double>, label string").repartition(4)
    parts = passages.near_blocks(df, "label", "id", "v")
    size = parts.select("part", "n")
    met = passages.reachable(parts, 0.95).join(size.toDF("p", "np"), "p").join(size.toDF("q", "nq"), "q")
    multiplied = met.agg(F.sum(F.when(F.col("p") == F.col("q"), F.col("np") * (F.col("np") - 1) / 2).otherwise(F.col("np") * F.col("nq")))).first()[0]
    assert multiplied < 0.1 * n * (n - 1) / 2
