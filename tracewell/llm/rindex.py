"""Suffix-array dedup by a run-length index.

A shard's snippets are indexed by a Burrows-Wheeler transform of their suffixes of at least one window, kept as runs: equal
snippets are one with a count, and suffixes (with their longest match) are sampled only at both ends of a run of equal
preceding bytes. Within a run, a suffix matches one byte less than the suffix that starts a byte before it; so streaming
over a snippet, the matching statistic at a byte is the furthest end of a sampled match so far, less the byte's place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common

#: Bytes of a repeated string, and of an anchor in it.
WINDOW, GRAM = 200, 32


#: Symbols (bytes from 1, nine bits each) that the first order of suffixes compares.
PACK = 7


@dataclass
class RunIndex:
    """The transform's runs (preceding byte, or -1 where a snippet begins; number of suffixes), and for each run the place in the
    shard and longest match elsewhere of its first and its last suffix. repeats: places and lengths of snippets with copies."""

    byte: np.ndarray
    length: np.ndarray
    first: np.ndarray
    first_match: np.ndarray
    last: np.ndarray
    last_match: np.ndarray
    repeats: tuple[np.ndarray, np.ndarray]


def ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


def suffix_array(text: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order, and the common prefix of each with the one before it, by prefix doubling. A suffix ends
    with its snippet (left: bytes until then), and that end is less than any byte. Equal suffixes keep the order of starts."""
    n, longest = len(text), int(left.max(initial=1))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(PACK, np.int64)])
    packed = np.zeros(n, np.int64)
    for j in range(PACK):
        packed = packed << 9 | np.where(left > j, padded[j : j + n], 0)
    levels, size = [(PACK, ranked(packed))], PACK
    while size < longest:
        rank = levels[-1][1]
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:]
        levels.append((2 * size, ranked(rank.astype(np.int64) * (n + 1) + np.where(left > size, after + 1, 0))))
        size *= 2
    order = starts[np.argsort(levels[-1][1][starts], kind="stable")]
    i, j = order[:-1], order[1:]
    same = np.zeros(len(i), np.int64)
    for size, rank in reversed(levels):
        same += np.where(rank[np.minimum(i + same, n - 1)] == rank[np.minimum(j + same, n - 1)], size, 0)
    gap = packed[np.minimum(i + same, n - 1)] ^ packed[np.minimum(j + same, n - 1)]
    for k in range(PACK):
        same += (gap >> (9 * (PACK - 1 - k))) == 0
    return order, np.concatenate([[0], np.minimum(same, np.minimum(left[i], left[j]))]) if len(order) else np.zeros(0, np.int64)


def build(contents: list[bytes], copies: list[int], window: int = WINDOW) -> RunIndex:
    """The index of snippets. Suffixes shorter than a window take no part. What stands before a snippet is another's, so its
    first suffix is a run of its own."""
    n = np.array([len(c) for c in contents], np.int64)
    first = np.cumsum(n) - n
    text = np.frombuffer(b"".join(contents), np.uint8)
    left = np.repeat(first + n, n) - np.arange(len(text))
    order, prefix = suffix_array(text, left, np.flatnonzero(left >= window))
    prior = np.where(left[order - 1] == 1, -1, text[order - 1].astype(np.int64)) if len(order) else np.zeros(0, np.int64)
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (prior[1:] != prior[:-1]) | (prior[1:] < 0)
    head = np.flatnonzero(new[:-1])
    length = np.diff(np.append(head, len(order)))
    tail = head + length - 1
    many = np.flatnonzero((np.array(copies) > 1) & (n >= window))  # copies of a snippet match it to its end
    return RunIndex(prior[head], length, order[head], prefix[head], order[tail], np.append(prefix, 0)[tail + 1], (first[many], n[many]))


def matching_statistics(index: RunIndex, n: np.ndarray) -> np.ndarray:
    """Length of the longest match elsewhere of every suffix, snippet after snippet (of n bytes), streamed from the ends of
    runs."""
    first = np.cumsum(n) - n
    reach = np.repeat(first, n)  # ends before the snippet say nothing in it
    for at, match in ((index.first, index.first_match), (index.last, index.last_match), index.repeats):
        np.maximum.at(reach, at, at + match)
    reach = np.maximum.accumulate(reach)
    return np.maximum(reach - np.arange(len(reach)), 0)


def covered(snippets: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Spans of bytes of each snippet (content, copies) that a string of window bytes covers which also
    occurs in another of them, at another place of it, or in a copy."""
    contents = [x[0] for x in snippets]
    n = np.array([len(c) for c in contents])
    index = build(contents, [x[1] for x in snippets], window)
    ms = matching_statistics(index, n)
    offs = np.concatenate([[0], np.cumsum(n)])
    long = np.flatnonzero(ms >= window)
    change = np.zeros(offs[-1] + 1, np.int64)
    np.add.at(change, long, 1)
    np.add.at(change, long + ms[long], -1)
    return anchors.runs(np.cumsum(change[:-1]) > 0, offs)


UNITS = anchors.Units(WINDOW, GRAM, word=False)


def dedup_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with _tw_spans: the bytes (of UTF-8) of each row that a 200-byte string covers which also starts elsewhere, in the
    same row or another; equal rows are rows apart. Null texts are empty. Null where there are none."""
    return anchors.with_spans(docs, anchors.repeated(docs.select(key, text), UNITS, covered, text, key), text, key)


def flat_spans(x: list[int] | None) -> np.ndarray:
    return anchors.merged(np.array(x, np.int64).reshape(-1, 2)) if x else np.zeros((0, 2), np.int64)


def keep(raw: bytes, spans: np.ndarray) -> bytes:
    """raw without the spans."""
    at, out = 0, []
    for s, e in spans.tolist():
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.col("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            data, offs = common.utf8(batch.column("text"))
            raw, out = data.tobytes(), [[] for _ in range(4)]
            for a, b, x in zip(offs[:-1], offs[1:], batch.column("_tw_spans").to_pylist(), strict=True):
                spans = flat_spans(x)
                for o, v in zip(out, (b - a, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(keep(raw[a:b], spans)).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return dedup_spans(docs).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans, narrowed to whole characters of UTF-8."""
    out = []
    for s, e in spans.tolist():
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return np.array(out, np.int64).reshape(-1, 2)


def dedup_text(docs: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with their repeated strings gone from the text, in whole characters; n_chars follows if it is a column. Null
    texts stay null."""
    docs, back = common.apart(docs, text, key, n_chars)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, text):
            texts = []
            for t, x in zip(batch.column(text).to_pylist(), batch.column("_tw_spans").to_pylist(), strict=True):
                if x:
                    raw = t.encode()
                    t = keep(raw, characters(raw, flat_spans(x))).decode()
                texts.append(t)
            by_name = {c: batch.column(c) for c in batch.schema.names if c != "_tw_spans"} | {text: pa.array(texts, pa.string())}
            if n_chars in by_name:
                by_name[n_chars] = pa.array([None if t is None else len(t) for t in texts]).cast(by_name[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(by_name.values()), list(by_name))

    return back(dedup_spans(docs, text, key).select(*[f"`{c}`" for c in docs.columns], "_tw_spans").mapInArrow(cut, columns))


OP5_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT rid, unnest(range(1, octet_length(b) - 198)) AS i, md5(b[i:i + 199]) AS h FROM t WHERE octet_length(b) >= 200),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
runs AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM rep),
grp AS (SELECT rid, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM runs),
spans AS (SELECT rid, k, min(i) AS s, max(i) + 200 AS e FROM grp GROUP BY 1, 2),
cuts AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 1) AS before, lead(s) OVER (PARTITION BY rid ORDER BY s) AS after FROM spans),
kept AS (SELECT cuts.rid, count(*) AS n, sum(e - s) AS r, string_agg(hex(b[before:s - 1]) || CASE WHEN after IS NULL THEN hex(b[e:octet_length(b)]) ELSE '' END, '' ORDER BY s) AS k FROM cuts JOIN t USING (rid) GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(CASE WHEN kept.rid IS NULL THEN b ELSE unhex(k) END) AS kept_sha256 FROM t LEFT JOIN kept USING (rid)
"""
