"""Pivot index, token alignment and Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewell.llm import align, merkle, pivots

CLASH = {"node": "x", "h1": 1, "list": "y", "leaf": "z", "group": "g", "index": 3, "shard": 4, "key": "k"}


def clashing(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


# pivots


def near_brute(rows):
    """n_links and class of (key, vector) rows."""
    fine = [k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for k, v in rows]
    linked = defaultdict(set)
    for i, j in combinations([i for i, f in enumerate(fine) if f], 2):
        a, b = (np.array(rows[k][1], float) for k in (i, j))
        if len(a) == len(b):
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((k, len(linked[i]), low, low == k))
    return out


def planted(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    base = x[: n // 4] / np.linalg.norm(x[: n // 4], axis=1)[:, None]
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    c = rng.uniform(0.901, 0.93, size=(n // 4, 1))
    x[n // 4 : n // 2] = 3 * (c * base + np.sqrt(1 - c * c) * off)  # barely linked
    x[n // 2 : n // 2 + n // 3] = x[n // 2] + rng.normal(size=(n // 3, dims)) * 0.05  # near copies
    x[-n // 20 :] = x[-1]  # equal
    return x


@pytest.mark.parametrize("dims", [3, 64])
def test_pivots_find_what_brute_force_finds(spark, dims, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)  # several blocks a list
    x = planted(600, dims, dims)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = near_brute(rows)
    assert all(got[k].n_links <= n for k, n, _, _ in want)  # nothing below the bound
    assert sum(got[k].n_links for k, *_ in want) >= 0.98 * sum(n for _, n, *_ in want)
    assert np.mean([got[k].component_id == c for k, _, c, _ in want]) >= 0.98


def test_pivots_edges(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [-1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    df = clashing(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    got = Counter(map(tuple, pivots.near_duplicates(df).collect()))
    assert got == Counter((k, n, c, c == k or (c is None and k is None)) for k, n, c, _ in near_brute(odd))
    assert pivots.near_duplicates(df.limit(0)).collect() == []
    one = spark.createDataFrame([("b", [1.0]), ("a", [2.0])], "vec_id string, embedding array<float>")
    assert sorted(map(tuple, pivots.near_duplicates(one).collect())) == [("a", 1, "a", True), ("b", 1, "a", False)]


def test_a_pair_is_verified_in_one_list_only():
    rng = np.random.default_rng(1)
    x = np.array([rng.permutation(20)[: pivots.PREFIX] for _ in range(400)], np.int32)
    y = np.array([rng.permutation(20)[: pivots.PREFIX] for _ in range(400)], np.int32)
    for a, b, found in zip(x, y, pivots.least_shared(x, y, 20), strict=True):
        both = sorted(set(a.tolist()) & set(b.tolist()))[: pivots.SHARED]
        assert found == (-1 if len(both) < pivots.SHARED else both[0] * 20 + both[1])


def test_work_of_a_large_group_of_near_copies_stays_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 128)
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(1500, 16))
    got = pivots.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.where("n_links = 1499 and component_id = 0").count() == 1500


# alignment


@pytest.fixture(scope="module")
def pair():
    return align.Pair(public_tokenizers.path(align.A_FILE), public_tokenizers.path(align.B_FILE))


def align_brute(texts):
    """Ids of both, groups as text and links (pair of ids: how often), by whole texts and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(align.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_FILE))
    names, to_byte = {i: t for t, i in a.get_vocab().items()}, align.byte_of()
    spell = (lambda i: bytes(to_byte[c] for c in names[i]), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
    out = []
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[s(i) for i in x] for s, x in zip(spell, ids, strict=True)]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append(([], [], "", Counter()))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links = Counter()
        for i, e in enumerate(ends[0]):
            for j, f in enumerate(ends[1]):
                if e - len(parts[0][i]) < f and f - len(parts[1][j]) < e:
                    links[ids[0][i], ids[1][j]] += 1
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, x[s:e])) for x, s, e in zip(ids, at, to, strict=True)))
            at = to
        out.append((*ids, ";".join(groups), links))
    return out


def digest_of(told):
    return hashlib.sha256(told.encode()).hexdigest() if told else ""


ALPHABET = [*"ab zé. ,'\n \t  ▁<|>0x41漢🙂　\x00\x1c\x85", "<|endoftext|>", "<s>", "<0x41>", "'s", " the ", ", ", "anting", "\r\n"]


def test_words_give_what_whole_texts_give(pair):
    rng = random.Random(4)
    for _ in range(12):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(40)]
        got = align.documents(pair, texts)
        for k, (a, b, told, links) in enumerate(align_brute(texts)):
            assert got.counts[k].tolist() == [len(a), len(b), told.count(";") + 1 if told else 0, sum(links.values())], texts[k]
            assert got.digests[k] == digest_of(told)
            s, e = got.offsets[k], got.offsets[k + 1]
            assert {(c >> 16, c & 0xFFFF): n for c, n in zip(got.codes[s:e].tolist(), got.often[s:e].tolist(), strict=True)} == dict(links)


def test_a_worker_forgets_words_beyond_its_bound(pair, monkeypatch):
    monkeypatch.setattr(align, "KNOWN_WORDS", 50)
    own = align.Pair(public_tokenizers.path(align.A_FILE), public_tokenizers.path(align.B_FILE))
    texts = [" ".join(f"word{i * 7 + k}" for k in range(30)) for i in range(9)]
    for some in (texts[:3], texts[3:], texts):
        got, want = align.documents(own, some), align.documents(pair, some)
        assert got.digests == want.digests and got.codes.tolist() == want.codes.tolist() and got.counts.tolist() == want.counts.tolist()
        assert len(own.known) <= 50 and len(own.table.words) <= 50


def test_alignments_of_a_corpus(spark, monkeypatch):
    monkeypatch.setattr(align, "SHARD_BYTES", 2000)  # many shards
    monkeypatch.setattr(align, "SUM_PAIRS", 500)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(60)]
    texts = [None, "", " ", "one", "a▁b", "x" * 3000, " lead", "tail \n"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) + rng.choice([".", "\n", "  "]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one more"), (None, None)]
    got = align.alignments(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    made = align_brute([t or "" for _, t in rows])
    docs = Counter(p for *_, links in made for p in links)
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    want = Counter((k, len(a), len(b), told.count(";") + 1 if told else 0, sum(links.values()), sum(n for p, n in links.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in links.items()), digest_of(told)) for (k, _), (a, b, told, links) in zip(rows, made, strict=True))
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == want
    assert align.alignments(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    shown = {r.doc_id: r for r in align.groups(spark.createDataFrame(rows[:10], "doc_id long, text string")).collect()}
    for (k, _), (a, b, told, _) in zip(rows[:10], made, strict=False):
        r = shown[k]
        assert (r.a_ids, r.b_ids, len(r.cuts)) == (a, b, told.count(";") + 1 if told else 0)
        assert not r.cuts or (r.a_to[-1], r.b_to[-1]) == (len(a), len(b))


def test_bitsets():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 500):
        one, other = (np.unique(np.append(rng.integers(1, n + 1, n // 2 + 1), n)) for _ in range(2))
        a, b = align.Bits(one, n), align.Bits(other, n)
        assert (a & b).select().tolist() == sorted(set(one.tolist()) & set(other.tolist()))
        assert (a | b).select().tolist() == sorted(set(one.tolist()) | set(other.tolist()))
        at = np.arange(n + 1)
        assert a.rank(at).tolist() == [int((one < x).sum()) for x in at]


# manifest


def manifest_brute(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root and verified of (doc_id, source, lang, n_chars, text) rows."""
    sha = lambda s: hashlib.sha256(s).hexdigest().encode()
    field = lambda v: b"-" if v is None else b"%d:" % len(str(v).encode()) + str(v).encode()
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r: sha(b"".join(map(field, r)))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(b"".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def walk(levels, at, now):
        told = []
        for nodes in levels[:-1]:
            low = at // 8 * 8
            run = nodes[low : low + 8]
            told += run[: at - low] + run[at - low + 1 :]
            now = sha(b"".join([*run[: at - low], now, *run[at - low + 1 :]]))
            at //= 8
        return told, now

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for n, g in enumerate(order):
        for at, r in enumerate(by[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            told, now = walk(trees[n], at, leaf((*r[:4], lower(r[4]))) if hit else leaf(r))
            above, now = walk(top, n, now)
            out.append((r[0], leaf(r).decode(), trees[n][-1][0].decode(), top[-1][0].decode(), sha(b"".join(told + above)).decode(), now.decode(), now == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}", "en", i * 3, f"Text {i} Ä" if i % 4 else None) for i in range(333)]
    rows += [(i, None, "de", None, rng.choice(["", "ABC", "abc", "Straße"])) for i in range(1000, 1065)] + [(5000 + i, "s", f"l{i}", 1, "One") for i in range(11)]
    return rows + [(2000, "s", None, 4, "X" * 100000), (2001, "s", None, 4, "X"), (None, "s", "en", 4, "X"), (None, "s", "en", 4, "Y"), (7, "s", "en", 4, "X"), (7, "s", "en", 4, "X"), (3000, "s", "one", 1, "T")]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_by_superblocks_of_any_size(spark, levels):
    rows = manifest_rows()
    random.Random(levels).shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")).repartition(5)
    made = merkle.manifest(df, levels=levels)
    want, root = manifest_brute(rows), made.root
    got = made.each(lambda leaf, claim, subroot, siblings, shape: (leaf.decode(), subroot.decode(), root, merkle.sha(siblings).decode(), merkle.fold(claim, siblings, shape).decode()), "leaf string, subroot string, root string, proof string, folded string")
    assert Counter(map(tuple, got.collect())) == Counter(r[:6] for r in want)
    proofs = made.proofs().collect()
    assert all(merkle.fold(r.leaf.encode(), bytes(r.siblings), bytes(r.shape)).decode() == made.root for r in proofs) and len(proofs) == len(rows)


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    none = merkle.manifest(spark.createDataFrame([], schema))
    assert none.root == "" and none.proofs().collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema))
    (row,) = one.proofs().collect()
    assert row.leaf == row.subroot == one.root == hashlib.sha256(b"1:1----").hexdigest() and bytes(row.siblings) == b""
