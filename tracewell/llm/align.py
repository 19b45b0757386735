"""Alignment of two tokenizers over the same text, by packed bitsets.

Both tokenizers cut the bytes of space + text. A bitset for each marks the bytes at which its tokens end: their AND has the
shared cuts, their OR the ends of all stretches that one token of each covers, which are the links. Popcounts before a bit
(rank) turn a cut into the number of tokens before it, so that cuts give ranges of tokens and stretches give pairs.

Neither tokenizer joins anything across a space between two other characters, so a text is cut there into words, and a word
that occurs again is looked up. What can't be told by words is taken whole.

How many documents link a pair of ids is counted by shards of documents: each gives its pairs once, with their numbers of
documents; these are dealt by a hash of the pair, summed, and sent back to the shards that asked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bits of an id of B in a pair's code; ids of both are below 2 ** 16.
B_BITS = 16
#: Words that a worker remembers; others are computed anew for each shard, with the same result.
KNOWN_WORDS = 300_000
#: Words that are encoded together; bytes of text of a batch, and of a shard; pairs that one task sums.
TOGETHER, PART_BYTES, SHARD_BYTES, SUM_PAIRS = 4096, 1 << 20, 8 << 20, 1 << 21
#: Bytes that white space other than the space and the line feed begins with, in UTF-8, and the rest of it.
ODD_BYTES, ODD_PARTS = bytes([*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xE1, 0xE2, 0xE3, 0xEF]), (b"  ", b" \n", b"\n ", b"\xc2\x85", b"\xc2\xa0")
#: That white space, in the widest sense, and the spaces at which a text is cut.
_OTHER = r"\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
CUT = re.compile(rf"(?<=[^ \n{_OTHER}]) (?=[^ \n{_OTHER}])")


class Bits:
    """A bitset over n places, in 64-bit words, with the popcounts before each word."""

    def __init__(self, places: np.ndarray, n: int) -> None:
        marked = np.zeros(-(-(n + 1) // 64) * 64, bool)
        marked[places] = True
        self.set_words(np.packbits(marked, bitorder="little").view("<u8"))

    def set_words(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def _with(self, words: np.ndarray) -> Bits:
        out = Bits.__new__(Bits)
        out.set_words(words)
        return out

    def __and__(self, other: Bits) -> Bits:
        return self._with(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return self._with(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked places before each of those given."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def select(self) -> np.ndarray:
        """All marked places in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Shared cuts (byte offsets, the last byte's included) with the tokens of A and B that end at or before them, and the
    links as pairs of token places, with the byte at which each stretch ends."""

    cuts: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    link_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """What the ends (bytes up to and with each token, ascending) of two sequences of tokens over the same bytes share."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    a, b = Bits(a_ends, n), Bits(b_ends, n)
    cuts, ends = (a & b).select(), (a | b).select()
    return Aligned(cuts, a.rank(cuts) + 1, b.rank(cuts) + 1, ends, a.rank(ends), b.rank(ends))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of the tokens of a vocabulary, one after another."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            self.sizes[i] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[common.take_ranges(self.starts[ids], self.sizes[ids])]


class Pair:
    """Two tokenizers and what is known of words (text between two cuts, without the space before it)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = byte_of()
        self.a_vocabulary = Vocabulary({i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()})
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.vocab_size())}
        self.b_vocabulary = Vocabulary({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        if max(len(self.a_vocabulary.sizes), len(self.b_vocabulary.sizes)) > 1 << B_BITS:
            raise ValueError(f"ids of {1 << B_BITS} and more are beyond a pair's code")
        self.known: dict[str, int] = {}
        self.table = Table()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text by A, and of text by B, which adds the space."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return np.array(a, np.int64), np.array(self.b.encode(text), np.int64)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by both, None where the bytes of either differ from those of space + text."""
        if not text:
            return None
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        a, b = self.encode(text)
        return (a, b) if np.array_equal(self.a_vocabulary.spell(a), raw) and np.array_equal(self.b_vocabulary.spell(b), raw) else None

    def learn(self, words: list[str]) -> Table:
        """A row for each word: by one encoding of many that may stand side by side, and by one for each other."""
        fine = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and "\u2581" not in w]
        out, alone = Table(), list(set(words).difference(fine))
        for i in range(0, len(fine), TOGETHER):
            some = fine[i : i + TOGETHER]
            found = self.whole(" ".join(some))
            if not found or not out.add(self, some, *found):
                alone += some
        for w in alone:
            found = self.whole(w)
            out.add(self, [w], *(found or [np.zeros(0, np.int64)] * 2))
        return out


#: Decimals of ids with a mark behind, six bytes each, and which of the six count.
_MARKS = b",|;"
_DECIMALS: list[np.ndarray] = []


def decimals() -> list[np.ndarray]:
    if not _DECIMALS:
        table = np.zeros((len(_MARKS), 1 << B_BITS, 6), np.uint8)
        for k in range(len(_MARKS)):
            for n in range(1 << B_BITS):
                shown = b"%d%c" % (n, _MARKS[k])
                table[k, n, : len(shown)] = list(shown)
        _DECIMALS[:] = [table, table[0] > 0]
    return _DECIMALS


def told(a: np.ndarray, b: np.ndarray, to: Aligned) -> tuple[bytes, np.ndarray]:
    """The text of all groups (`a1,a2|b1;`), and where each group ends in it."""
    seq, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    n_a, n_b = np.diff(to.a_to, prepend=0), np.diff(to.b_to, prepend=0)
    seq[np.arange(len(a)) + np.repeat(to.b_to - n_b, n_a)] = a
    seq[np.arange(len(b)) + np.repeat(to.a_to, n_b)] = b
    mark[to.a_to + to.b_to - n_b - 1] = 1
    mark[to.a_to + to.b_to - 1] = 2
    table, counts = decimals()
    which = counts[seq]
    return table[mark, seq][which].tobytes(), np.cumsum(which.sum(1))[to.a_to + to.b_to - 1]


class Table:
    """Rows of words: their groups as text; their numbers of tokens of A and B and of groups; and the codes of their links, from
    one offset to the next. A word without tokens can't be told alone."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.texts: list[bytes] = []
        self.counts = np.zeros((0, 3), np.int64)
        self.codes = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def add(self, pair: Pair, words: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Rows of words that stand side by side, from the ids of all of them; False, and no rows, if a word's end is no shared cut.
        One word without ids is added as such."""
        if not len(a):
            self._extend(words, [b""], np.zeros((1, 3), np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
            return True
        to = align(np.cumsum(pair.a_vocabulary.sizes[a]), np.cumsum(pair.b_vocabulary.sizes[b]))
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cut = np.searchsorted(to.cuts, ends)
        if cut[-1] >= len(to.cuts) or not np.array_equal(to.cuts[cut], ends):
            return False
        text, at = told(a, b, to)
        at = at[cut].tolist()
        texts = [text[i : j - 1] for i, j in zip([0, *at], at, strict=False)]
        counts = np.stack([np.diff(x, prepend=0) for x in (to.a_to[cut], to.b_to[cut], cut + 1)], 1)
        codes = (a[to.link_a] << B_BITS | b[to.link_b]).astype(np.uint32)
        self._extend(words, texts, counts, codes, np.searchsorted(to.link_end, ends, side="right"))
        return True

    def _extend(self, words: list[str], texts: list[bytes], counts: np.ndarray, codes: np.ndarray, to: np.ndarray) -> None:
        self.words += words
        self.texts += texts
        self.counts = np.concatenate([self.counts, counts])
        self.offsets = np.concatenate([self.offsets, to + self.offsets[-1]])
        self.codes = np.concatenate([self.codes, codes])

    def extend(self, other: Table) -> None:
        self._extend(other.words, other.texts, other.counts, other.codes, other.offsets[1:])

    def cut(self, n: int) -> None:
        """Only the first n words stay."""
        self.words, self.texts, self.counts, self.codes, self.offsets = self.words[:n], self.texts[:n], self.counts[:n], self.codes[: self.offsets[n]], self.offsets[: n + 1]


def pair_of(a_path: str, b_path: str) -> Pair:
    """The worker's own, kept from task to task of this kernel."""
    found = common.kept("align")
    if (a_path, b_path) not in found:
        found[a_path, b_path] = Pair(a_path, b_path)
    return found[a_path, b_path]


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, without the space before each, and the text that each is of: a text's words stand in order and
    side by side, those of texts that aren't cut at all of their spaces behind the others'."""
    raw = [t.encode() for t in texts]
    odd = np.array([bool(x) and (x[0] == 0x20 or x[-1] == 0x20 or any(y in x for y in ODD_PARTS) or len(x.translate(None, ODD_BYTES)) != len(x)) for x in raw], bool)
    plain = np.flatnonzero(~odd & (np.array([len(x) for x in raw]) > 0))
    split = pa.compute.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    cut = [CUT.split(texts[i]) for i in np.flatnonzero(odd)]
    owner = np.concatenate([np.repeat(plain, np.diff(split.offsets.to_numpy())), np.repeat(np.flatnonzero(odd), [len(c) for c in cut])]).astype(np.int64)
    return pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]), owner


@dataclass
class Part:
    """Of some documents: n_a, n_b, n_groups, n_links and the digest of the groups' text; and their distinct links, from one
    document's offset to the next: codes in order, and how often the document has them."""

    counts: np.ndarray
    digests: list[str]
    offsets: np.ndarray
    codes: np.ndarray
    often: np.ndarray


def documents(pair: Pair, texts: list[str]) -> Part:
    """The alignment of each text: by its words, each of which is aligned once, or whole where one of them can't be told alone."""
    words, owner = words_of(texts)
    words = words.dictionary_encode()
    distinct, number, table = words.dictionary.to_pylist(), pair.known, pair.table
    new = [w for w in distinct if w not in number]
    if new:
        learnt = pair.learn(new)
        number.update(zip(learnt.words, range(len(number), len(number) + len(new)), strict=True))
        table.extend(learnt)
    at = np.fromiter(map(number.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
    whole = np.unique(owner[table.counts[at, 0] == 0])
    if len(whole):
        fine = ~np.isin(owner, whole)
        at, owner = at[fine], owner[fine]
    counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    text_of = table.texts.__getitem__
    for row, s, e in zip(owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
        digests[row] = hashlib.sha256(b";".join(map(text_of, at[s:e].tolist()))).hexdigest()
    if len(first):
        counts[owner[first], :3] = np.add.reduceat(table.counts[at], first)
    # links by (text, word), then by (text, pair)
    by_word, often = counted(owner << 32 | at)
    word = by_word & 0xFFFFFFFF
    n = np.diff(table.offsets)[word]
    key = np.repeat(by_word >> 32, n) << 32 | table.codes[common.take_ranges(table.offsets[word], n)]
    often = np.repeat(often, n)
    for row in whole.tolist():
        if found := pair.whole(texts[row]):
            made = Table()
            made.add(pair, [texts[row]], *found)
            digests[row] = hashlib.sha256(made.texts[0]).hexdigest()
            counts[row, :3] = made.counts[0]
            key, often = np.append(key, row << 32 | made.codes.astype(np.int64)), np.append(often, np.ones(len(made.codes), np.int64))
    key, often = counted(key, often)
    doc = key >> 32
    counts[:, 3] = np.bincount(doc, often, len(texts)).astype(np.int64)
    if len(number) > KNOWN_WORDS:
        for w in table.words[KNOWN_WORDS:]:
            del number[w]
        table.cut(KNOWN_WORDS)
    return Part(counts, digests, np.searchsorted(doc, np.arange(len(texts) + 1)), key & 0xFFFFFFFF, often)


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how many of each there are, or the sums of n."""
    order = np.argsort(keys) if n is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if order is None else np.add.reduceat(n[order], first) if len(keys) else np.zeros(0, np.int64)
    return keys[first], sums


def small(values: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    raw = values.astype("<i8").tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def large(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n, codec="zstd", asbytes=True) if n else b"", "<i8")


SHARD = "shard long, bucket int, ids array<{key}>, digests array<string>, counts binary, offsets binary, codes binary, often binary"
_BYTES = ["counts", "offsets", "codes", "often"]


def shards(docs: DataFrame, a_path: str, b_path: str, buckets: int, text: str, key: str) -> DataFrame:
    """A row for each shard with its documents (bucket -1), and rows for its distinct pairs by bucket of the pair, with the
    number of its documents that link them (often)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(shard: int, bucket: int, ids: pa.Array, digests: list[str], **arrays: np.ndarray) -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([bucket], pa.int32()), one(ids), one(pa.array(digests, pa.string())), *[common.binary([small(arrays[c]) if c in arrays else b""]) for c in _BYTES]], ["shard", "bucket", "ids", "digests", *_BYTES])

        def flush() -> Iterator[pa.RecordBatch]:
            part, shard = documents(pair, texts), (TaskContext.get().partitionId() << 32) + made
            yield row(shard, -1, pa.concat_arrays(held), part.digests, counts=part.counts.ravel(), offsets=part.offsets, codes=part.codes, often=part.often)
            distinct, n = counted(part.codes)
            bucket = (distinct.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            none = pa.array([], held[0].type)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                yield row(shard, b, none, [], codes=distinct[at], often=n[at])

        pair = pair_of(a_path, b_path)
        held, texts, size, made = [], [], 0, 0
        for batch in common.chunks(batches, text, PART_BYTES, owner="align"):
            raw = batch.column(text).cast(pa.large_binary()).to_pylist()
            now = [x.decode("utf-8", "replace") if x else "" for x in raw]
            # bytes that are no UTF-8 are no token's
            texts += ["" if "\ufffd" in t and t.encode() != x else t for t, x in zip(now, raw, strict=True)]
            held.append(batch.column(key))
            size += sum(len(x) for x in raw if x)
            if size >= SHARD_BYTES:
                yield from flush()
                held, texts, size, made = [], [], 0, made + 1
        if held:
            yield from flush()
        common.release()

    return docs.select(key, text).mapInArrow(run, SHARD.format(key=kind))


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Texts that are null or empty, or whose joined tokens of either side differ from space + text, have no tokens: zeros and an
    empty digest. Repeated rows are documents of their own; a null key is a key. Other columns take no part."""
    spark = docs.sparkSession
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)
    kind = docs.schema[key].dataType.simpleString()
    size = common.text_bytes(docs, text)
    # some fifth of the bytes of a text is a pair that is new to its shard, at most
    buckets = max(1, -(-size // (5 * SUM_PAIRS)), common.shuffle_partitions(spark) if size > SUM_PAIRS else 1)
    made = common.materialize(shards(docs, a_path, b_path, buckets, text, key), "align-shards")

    def total(group: pa.Table) -> pa.Table:
        shard, codes = group.column("shard").to_pylist(), [large(x.as_py()) for x in group.column("codes")]
        distinct, n = counted(np.concatenate(codes), np.concatenate([large(x.as_py()) for x in group.column("often")]))
        a = distinct >> B_BITS
        order = np.lexsort((n, a))
        last = np.flatnonzero(np.append(a[order][1:] != a[order][:-1], True))
        tops = order[last]
        rows = [(s, c, n[np.searchsorted(distinct, c)]) for s, c in zip(shard, codes, strict=True)] + [(-1, a[tops], n[tops])]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), *[common.binary([small(r[k]) for r in rows]) for k in (1, 2)]], names=["shard", "codes", "n"])

    pairs = made.where("bucket >= 0").select("bucket", "shard", "codes", "often")
    sums = common.materialize(pairs.groupBy("bucket").applyInArrow(lambda t: total(t.select(["shard", "codes", "often"])), "shard long, codes binary, n binary"), "align-counts")

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n in zip(batch.column("codes"), batch.column("n"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(large(c.as_py())), pa.array(large(n.as_py()))], ["a", "n"])

    # a row for each id of A's vocabulary at most
    best = sums.where("shard = -1").select("codes", "n").mapInArrow(unroll, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    tops = np.zeros(1 << B_BITS, np.int64)
    tops[best.column("a").to_numpy()] = best.column("n").to_numpy()

    def finish(group: pa.Table) -> pa.Table:
        docs_row = next(r for r in group.to_pylist() if r["ids"] is not None)
        asked = [r for r in group.select(["codes", "n"]).to_pylist() if r["n"] is not None]
        codes = np.concatenate([np.zeros(0, np.int64), *[large(r["codes"]) for r in asked]])
        n = np.concatenate([np.zeros(0, np.int64), *[large(r["n"]) for r in asked]])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        own, often, offsets = (large(docs_row[c]) for c in ("codes", "often", "offsets"))
        of = n[np.searchsorted(codes, own)] if len(own) else own
        counts = large(docs_row["counts"]).reshape(-1, 4)
        totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (often * (of == tops[own >> B_BITS]), often * of)]
        ids = group.filter(pa.compute.is_valid(group.column("ids"))).column("ids").combine_chunks().flatten()
        return pa.table([ids, *[pa.array(x) for x in (*counts.T, *totals)], pa.array(docs_row["digests"], pa.string())], names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    held = made.where("bucket < 0").select("shard", "ids", "digests", *_BYTES).withColumn("n", F.lit(None).cast("binary"))
    answers = sums.where("shard >= 0").select("shard", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<string>").alias("digests"), *[F.lit(None).cast("binary").alias(c) if c != "codes" else F.col(c) for c in _BYTES], "n")
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = held.unionByName(answers).groupBy("shard").applyInArrow(lambda t: finish(t.drop_columns(["shard"])), schema)
    return out.withColumnRenamed("key", key)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, a_ids, b_ids, cuts (byte offsets in space + text at which tokens of both end), a_to and b_to (tokens of each up to a
    cut) of every row: the alignment itself. Empty arrays where there are no tokens."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)
    kind, names = docs.schema[key].dataType.simpleString(), ["a_ids", "b_ids", "cuts", "a_to", "b_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in common.chunks(batches, text, PART_BYTES, owner="align"):
            columns: list[list] = [[] for _ in names]
            for t in batch.column(text).to_pylist():
                found = pair.whole(t or "")
                values = [np.zeros(0, np.int64)] * 5
                if found:
                    to = align(np.cumsum(pair.a_vocabulary.sizes[found[0]]), np.cumsum(pair.b_vocabulary.sizes[found[1]]))
                    values = [*found, to.cuts, to.a_to, to.b_to]
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} array<long>" for c in names))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over every document, and how common its links are in the corpus."""
    return alignments(common.table(spark, sf_dir, "documents"))
