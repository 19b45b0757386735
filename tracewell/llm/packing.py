"""Best-fit packing of tokenised documents: best-two-fit.

A sequence is filled greedily with the longest piece that still fits; then its smallest piece is replaced by two unpacked
pieces that fit the widened gap more tightly. Pieces are dealt by a hash into groups of bounded size and each group is
packed on its own, which costs at most one sequence that is not full for each group."""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a sequence, the token that ends a document, and documents of a group that is packed together.
CAPACITY, END_ID, GROUP_ROWS = 4096, 1, 16384
TOKENIZER = "word_bpe_49k.json"
#: Words, and runs, that a tokenising worker remembers; others are computed anew, with the same result.
KNOWN_WORDS = 200_000


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of lengths (each from 1 to capacity) by sequence. Equal lengths are taken in the order given."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stock[lengths[i]].append(i)
    count = np.array([len(x) for x in stock])
    #: at_most[x]: the largest length in stock that is no more than x, 0 if none
    at_most = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))

    def change(length: int, by: int) -> None:
        nonlocal at_most
        count[length] += by
        if count[length] == (1 if by > 0 else 0):
            if by > 0:
                seg = at_most[length:]
                seg[seg < length] = length
            else:
                low, seg = at_most[length - 1], at_most[length:]
                seg[seg == length] = low

    out, left = [], len(lengths)
    while left:
        now, gap = [], capacity
        while gap and (x := int(at_most[gap])):
            now.append((x, stock[x].pop()))
            change(x, -1)
            gap, left = gap - x, left - 1
        if gap and left > 1:
            small = min(now)
            room = gap + small[0]
            a = np.flatnonzero(count[: room + 1])
            if len(a):
                b = at_most[room - a]
                b = np.where((b == a) & (count[a] < 2), at_most[np.maximum(np.minimum(a, room - a) - 1, 0)], b)
                sums = np.where(b > 0, a + b, 0)
                k = int(np.argmax(sums))
                if sums[k] > small[0]:
                    for x in (int(a[k]), int(b[k])):
                        now.append((x, stock[x].pop()))
                        change(x, -1)
                    now.remove(small)
                    stock[small[0]].append(small[1])
                    change(small[0], 1)
                    left -= 1
        out.append([i for _, i in now])
    return out


#: What one run of the tokenizer's own splitting pattern is; white space parts runs and is dropped.
RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are normalised by lower-casing alone, and split by RUN in any Unicode version.
PLAIN = r"[!-~\u00a1-\u024f\n]*"
#: Marks that are a run of their own behind a word of letters.
MARKS = frozenset(".,;:!?")


class WordIds:
    """Token ids of texts, by words. The tokenizer drops white space and never joins across it or across its runs, so the
    ids of a text are those of its words in turn, and those of a word are those of its runs (tests hold this against
    whole texts). Words are looked up; only new runs go through the tokenizer."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of_runs = self.lean(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs_of, self.plain = regex.compile(RUN).findall, regex.compile(PLAIN).fullmatch
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}

    def lean(self, path: str):
        """A tokenizer for runs in lower case with a space between them: without normalising and splitting what already is."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if steps[0].get("type") != "Split":
            return self.tokenizer
        parts["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, *steps[1:]]
        return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "post_processor": None, "added_tokens": []}))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)  # goes through the new ones; "- keys()" goes through all that is known
        if new:
            self.learn(new)
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        if len(self.words) > KNOWN_WORDS:
            for w in new:
                del self.words[w]
        return out

    def learn(self, new: set[str]) -> None:
        words = list(new)
        joined = "\n".join(words)
        other: list[str] = []
        if "<|" in joined or not self.plain(joined):
            other = [w for w in words if "<|" in w or not self.plain(w)]
            words = list(new.difference(other))
            joined = "\n".join(words)
        if other:
            for w, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()
        lows = joined.lower().split("\n") if words else []
        one = list(map(str.isalpha, lows))  # of one run, which most are
        single, runs = list(compress(words, one)), list(compress(lows, one))
        several = []  # words with their runs
        if len(single) < len(words):
            rest = list(map(not_, one))
            for w, low in zip(compress(words, rest), compress(lows, rest), strict=True):
                several.append((w, [low[:-1], low[-1]] if low[-1] in MARKS and low[:-1].isalpha() else self.runs_of(low)))
        fresh = list(set(runs).union(*[r for _, r in several]).difference(self.runs))
        if fresh:
            ids = np.array(self.of_runs.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(fresh):
                raise ValueError("the tokenizer's runs don't end words")
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.runs.update(zip(fresh, [raw[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        known = self.runs.__getitem__
        self.words.update(zip(single, map(known, runs), strict=True))
        self.words.update([(w, b"".join(map(known, runs))) for w, runs in several])
        if len(self.runs) > KNOWN_WORDS:
            for r in fresh:
                del self.runs[r]


def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task of this kernel."""
    found = common.kept("packing")
    if path not in found:
        found[path] = WordIds(path)
    return found[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each piece of each document: its ids and end_id, cut only where longer
    than capacity. Null texts are empty; an empty text is the one id end_id. Repeated rows stay."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here has cycles, and the words that are held are many to go through
        try:
            yield from tokenised(batches)
        finally:
            gc.enable()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in common.chunks(batches, text, owner="packing"):
            at, rows = [], [[] for _ in range(4)]
            for i, ids in enumerate(words.ids([x or "" for x in batch.column(text).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * (s + capacity)]
                    at.append(i)
                    for out, v in zip(rows, (k, s, len(part) // 4, zlib.crc32(part)), strict=True):
                        out.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *[pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]], ["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def pack(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """parts with sequence_id and offset. Pieces of full length are sequences by themselves."""
    spark = parts.sparkSession
    parts = common.materialize(parts, "pack-pieces")
    groups = max(1, -(-parts.where(F.col("length") < capacity).count() // group_rows))
    columns = parts.columns
    # equal rows part by nothing in them: the file and place where they stand spread a group of copies
    dealt = parts.withColumn("_tw_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, sort_keys=[(key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        group = group.take(order)
        lengths = group.column("length").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        base = (group.column("_tw_group")[0].as_py() << 32) if len(lengths) else 0
        for s, members in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = base + s, at
                at += lengths[i]
        return group.drop_columns(["_tw_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_tw_group").applyInArrow(fill, schema).select(*columns, "sequence_id", "offset")


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most capacity tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return pack(pieces(docs, tokenizer, text, key, capacity), key, capacity)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return best_fit_pack(common.table(spark, sf_dir, "documents"))
