"""Needles in texts: distinctive strings of a key, and where texts hold them.

Few needles are compiled into an Aho-Corasick automaton. Of many, workers get two bitmaps of their hashes: at the places of a text
whose next characters begin a needle, stretches of the lengths that needles have are hashed, and those that may be needles meet them
by equality. Either way every text is read once, however many needles there are, and never moves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .iterate import materialize

#: Characters of the needles of an automaton, which the driver sends to all workers: it takes some hundred bytes for each.
SHARD_CHARS = 1 << 20
#: Bits of a bitmap for each needle, and of a bitmap at least and at most (16 MB); pieces that it is put together from.
BITS_A_NEEDLE, LEAST_BITS, MOST_BITS, PIECES = 64, 1 << 20, 1 << 27, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def distinctive(values: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """needle and short: what the facts of a key (kind: text, document or name; value) hold that is evidence of copying. Dates, money,
    grouped or fractional numbers and cited authorities of texts; ids of documents; names without their glosses and their capitalised
    words. short: forms of two or three letters, which stand as a name only. Four characters at least, but for those."""
    text = F.when(F.col(kind) == "text", F.col(value))
    of_text = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array().cast("array<string>")) for p in rules.KEY_FIGURES]))
    form = F.trim(F.regexp_replace(F.regexp_replace(F.when(F.col(kind) == "name", F.col(value)), r"\(.*?\)", " "), r"^[ ,]+|[ ,]+$", ""))
    common = F.array(*[F.lit(w) for w in rules.COMMON])
    rare = lambda w: ~F.array_contains(common, F.lower(w))
    words = F.filter(F.regexp_extract_all(form, F.lit(r"\b[A-Z][A-Za-z'-]{2,}"), F.lit(0)), rare)
    of_name = F.when(F.size(words) > 0, F.array_append(words, form))
    brief = form.rlike(r"^[\p{Lu}].{1,2}$") & rare(form)
    of_document = F.when(F.col(kind) == "document", F.array(F.col(value)))
    none = F.array().cast("array<string>")
    long = F.filter(F.concat(F.coalesce(of_text, none), F.coalesce(of_name, none), F.coalesce(of_document, none)), lambda n: F.length(n) >= 4)
    each = F.concat(F.transform(long, lambda n: F.struct(n.alias("needle"), F.lit(False).alias("short"))), F.when(brief, F.array(F.struct(form.alias("needle"), F.lit(True).alias("short")))).otherwise(F.array().cast("array<struct<needle:string,short:boolean>>")))
    return values.select(F.inline(each)).groupBy("needle").agg(F.max("short").alias("short"))


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word or sum runs on over either end of a stretch."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (before.isalnum() or before in ("_", "$") and before) and not (after.isalnum() or after == "_")


def find(needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str, whole: bool = False) -> DataFrame:
    """needle_id, text_id and at (code points before its first occurrence) of every needle that a text holds; whole: as whole words
    only. Needles are of any length; null needles and texts hold nothing, an empty needle is in every text (whole: in none).
    Needles of one id are needles of their own; a text whose id repeats is a text of its own."""
    kinds = [needles.schema[needle_id].dataType, texts.schema[text_id].dataType]
    # needles may be made of large tables, and are read more than once
    given = materialize(needles.select(F.col(needle_id).alias("id"), F.col(needle).alias("needle")).where("needle is not null").distinct(), "needles")
    size = given.agg(F.sum(F.length("needle") + F.lit(1))).first()[0] or 0
    rows = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    if not size:
        out = rows.select(F.lit(None).cast(kinds[0]).alias("id"), "_id", F.lit(0).cast("long").alias("at")).limit(0)
    elif size <= SHARD_CHARS:
        out = rows.mapInArrow(finder(given.toArrow(), whole), f"id {kinds[0].simpleString()}, _id {kinds[1].simpleString()}, at long")
    else:
        out = by_hashes(given, rows, whole)
    return out.select(F.col("id").alias(needle_id), F.col("_id").alias(text_id), "at")


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Of every code point, whether a word or sum runs on over it (see bounded)."""
    return np.fromiter((chr(c).isalnum() or chr(c) == "_" for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the stretches of 1, 2, 4, ... characters that begin at each place of a text, as long as it has any."""
    h, n = (codes.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    h ^= h >> np.uint64(29)
    while len(h):
        yield h
        h, n = _joined(h[: max(0, len(h) - n)], h[n:]), 2 * n


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * np.uint64(0xBF58476D1CE4E5B9))) * _ODD
    return h ^ (h >> np.uint64(31))


def stretch(level: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the stretches of n characters at some places: of their first and their last 2 ** k (level), which cover them."""
    return _joined(level[at], level[at + (n - (1 << n.bit_length() - 1))]) + np.uint64(n)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmaps(given: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes of what needles begin with (the power of 2 of characters that they fill), and of those of whole needles."""
    piece = bits // PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n in batch.column("needle").to_pylist():
                *_, level = rolling(points(n))
                for which, h in enumerate((level[:1], stretch(level, np.zeros(1, np.int64), len(n)))):
                    at = int(h[0]) & bits - 1
                    pieces.setdefault((which, at // piece), np.zeros(piece, bool))[at % piece] = True
        for (which, k), found in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([k]), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], ["which", "piece", "marked"])

    def join(group: pa.Table) -> pa.Table:
        all_of = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in group.column("marked").to_pylist()])
        return group.slice(0, 1).set_column(2, "marked", pa.array([all_of.tobytes()], pa.binary()))

    kinds, out = "which long, piece long, marked binary", (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8))
    for row in given.select("needle").mapInArrow(mark, kinds).groupBy("which", "piece").applyInArrow(join, kinds).toLocalIterator():
        out[row["which"]][row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["marked"], np.uint8)
    return out


def by_hashes(given: DataFrame, rows: DataFrame, whole: bool) -> DataFrame:
    """id, _id and at as find() gives them of many needles (id, needle) in rows (_id, _text). What the bitmaps let through by chance
    meets no needle."""
    full = given.where("needle <> ''")
    sizes = full.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("needle"))).alias("lengths")).first()
    lengths: dict[int, list[int]] = {}
    for n in sizes["lengths"]:  # a number for each length that needles have
        lengths.setdefault(n.bit_length() - 1, []).append(n)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (sizes["n"] * BITS_A_NEEDLE - 1).bit_length()))
    heads, wholes = bitmaps(full, bits)
    kind, most = rows.schema["_id"].dataType.simpleString(), max(lengths, default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, places, told = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                codes, first = points(text), {}
                if whole:
                    word = word_characters()[codes]
                    starts = ~np.concatenate([[False], word | (codes == ord("$"))])
                    ends = ~np.concatenate([word, [False]])
                for k, level in zip(range(most + 1), rolling(codes)):  # noqa: B905  one of both ends first
                    if k not in lengths:
                        continue
                    fine = marked(heads, level)
                    at = np.flatnonzero(fine & starts[: len(fine)] if whole else fine)
                    for n in lengths[k] if len(at) else ():
                        here = at[at + n <= len(text)]
                        if whole:
                            here = here[ends[here + n]]
                        here = here[marked(wholes, stretch(level, here, n))]
                        for s in here.tolist():
                            first.setdefault(text[s : s + n], s)
                row += [i] * len(first)
                told += first.keys()
                places += first.values()
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(row, pa.int64())), pa.array(told, pa.string()), pa.array(places, pa.int64())], ["_id", "needle", "at"])

    found = rows.mapInArrow(run, f"_id {kind}, needle string, at long").join(full, "needle").select("id", "_id", "at")
    if whole:
        return found
    return found.unionByName(given.where("needle = ''").select("id").crossJoin(rows.select("_id")).select("id", "_id", F.lit(0).cast("long").alias("at")))


def held(parts: DataFrame, texts: DataFrame, part: str, text: str) -> DataFrame:
    """part and text of every different part that is the whole or a stretch of a different text. Parts as long as the longest text
    can only be equal to one and meet it by equality; shorter ones are looked for in all texts."""
    parts, texts = (df.select(c).where(F.col(c).isNotNull()).distinct() for df, c in ((parts, part), (texts, text)))
    longest = texts.agg(F.max(F.length(text))).first()[0] or 0
    size = F.length(part)
    equal = parts.where(size == longest).join(texts, F.col(part) == F.col(text)).select(part, text)
    return equal.unionByName(find(parts.where(size < longest), texts, part, part, text, text).select(part, text))


def finder(needles: pa.Table, whole: bool):
    """What finds the needles (id, needle) in batches of texts (_id, _text)."""
    ids, told = needles.column("id").combine_chunks(), needles.column("needle").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by: dict[str, list[int]] = {}
        for k, n in enumerate(told):
            by.setdefault(n, []).append(k)
        always = by.pop("", []) if not whole else []
        by.pop("", None)
        find = ahocorasick.Automaton()
        for n in by:
            find.add_word(n, n)
        if by:
            find.make_automaton()
        for batch in batches:
            which, row, at = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                first = dict.fromkeys(always, 0)
                seen: set[str] = set()
                for end, n in find.iter(text) if by else ():
                    if n not in seen and (not whole or bounded(text, end + 1 - len(n), end + 1)):
                        seen.add(n)
                        first.update(dict.fromkeys(by[n], end + 1 - len(n)))
                which += first.keys()
                row += [i] * len(first)
                at += first.values()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), batch.column("_id").take(pa.array(row, pa.int64())), pa.array(at, pa.int64())], ["id", "_id", "at"])

    return run


def contaminated(needles: DataFrame, texts: DataFrame, text_id: str, text: str, around: int = 45) -> DataFrame:
    """needle, text_id, at and excerpt of every distinctive string (needle, see distinctive) that stands in a text as whole words."""
    hits = find(needles, texts, "needle", "needle", text_id, text, whole=True)
    rows = hits.join(texts.select(F.col(text_id), F.col(text).alias("_text")), text_id)
    start = F.greatest(F.col("at") - around, F.lit(0))
    cut: Column = F.substring(F.col("_text"), (start + 1).cast("int"), (F.col("at") + F.length("needle") + around - start).cast("int"))
    return rows.select("needle", text_id, "at", F.regexp_replace(cut, r"\n", " ").alias("excerpt"))
