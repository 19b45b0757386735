"""Substring dedup by repeated-phrase automata.

Passages that recur are confirmed in shards of distinct snippets (see anchors) by hashes of their windows. A document gets the
passages that its snippets hold. The passages of a shard of documents are compiled into an Aho-Corasick automaton, and every
document of the shard is streamed through it: where it finds a passage, and nowhere else, words are covered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors, common, words

#: Words of a window, and of an anchor in it.
WINDOW, GRAM = 35, 8
#: Bytes of text of a shard of documents.
SHARD_BYTES = 256 << 10
UNITS = anchors.Units(WINDOW, GRAM, word=True)


def recurring(snippets: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Spans of words of each snippet (content, copies): runs of windows that occur at least twice among all snippets and their
    copies. A snippet of fewer words than a window has none."""
    data, offs = common.utf8(common.binary([x[0] for x in snippets]))
    starts, ends, first = words.spans(data, offs)
    h, at = words.grams(words.hashes(data, starts, ends, lower=False), first, window, short=False)
    weight = np.repeat(np.array([x[1] for x in snippets]), np.diff(at))
    _, which = np.unique(h, return_inverse=True)
    often = np.bincount(which, weight, minlength=1)[which] > 1 if len(h) else np.zeros(0, bool)
    return [s + [0, window - 1] for s in anchors.runs(often, at)]


def automaton(passages: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    """Finds all passages (sequences of word numbers); a match's value is its length."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def occurrences(texts: pa.Array, passages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, list[np.ndarray]]:
    """Starts and ends of all words of the texts, the rows' first words, their bytes, and the spans of each row's words that
    occurrences of the shard's passages (lists, one a row, null: none) cover. A row without passages isn't streamed."""
    data, offs = common.utf8(texts)
    starts, ends, first = words.spans(data, offs)
    none = np.zeros((0, 2), np.int64)
    spans = [none] * len(texts)
    rows = np.flatnonzero(passages.is_valid().to_numpy(zero_copy_only=False))
    if len(rows):
        distinct = passages.flatten().unique()
        p_data, p_offs = common.utf8(distinct)
        p_starts, p_ends, p_first = words.spans(p_data, p_offs)
        at = common.take_ranges(first[rows], first[rows + 1] - first[rows])
        hashes = np.concatenate([words.hashes(p_data, p_starts, p_ends, lower=False), words.hashes(data, starts[at], ends[at], lower=False)])
        number = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
        split = lambda flat, cuts: [tuple(flat[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        find = automaton([p for p in split(number, p_first) if p])
        cuts = np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])])
        for row, text in zip(rows.tolist(), split(number[len(p_starts) :], cuts), strict=True):
            hits = np.array([(end + 1 - size, end + 1) for end, size in find.iter(text)], np.int64) if text and len(find) else none
            spans[row] = anchors.merged(hits.reshape(-1, 2))
    return starts, ends, first, data.tobytes(), spans


def with_passages(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with _tw_passages: the recurring passages that each row's snippets hold, null where there are none."""
    return anchors.with_spans(docs, anchors.repeated(docs.select(key, text), UNITS, recurring, text, key, passages=True), text, key)


def phrase_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with _tw_spans: the words of each row that a window of 35 words covers whose words also occur elsewhere, in the
    same row or another; equal rows are rows apart. Null texts have no words. Null where there are none."""
    names = docs.columns
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, text, SHARD_BYTES):
            *_, spans = occurrences(batch.column(text), batch.column("_tw_passages"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([s.ravel().tolist() if len(s) else None for s in spans], pa.list_(pa.int64()))], [*names, "_tw_spans"])

    return with_passages(docs, text, key).select(*names, "_tw_passages").mapInArrow(run, f"{columns}, _tw_spans array<long>")


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 35 words."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", SHARD_BYTES):
            starts, ends, first, raw, spans = occurrences(batch.column("text"), batch.column("_tw_passages"))
            out = [[] for _ in range(3)]
            for a, b, found in zip(first[:-1], first[1:], spans, strict=True):
                stay = np.ones(b - a, bool)
                for s, e in found.tolist():
                    stay[s:e] = False
                kept = b" ".join([raw[s:e] for s, e in zip(starts[a:b][stay].tolist(), ends[a:b][stay].tolist(), strict=True)])
                for o, v in zip(out, (b - a, b - a - int(stay.sum()), hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_passages(docs, "text", "doc_id").select("doc_id", "text", "_tw_passages").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM t WHERE len(w) >= 35),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
marked AS (SELECT words.rid, words.i, word, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.rid ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN rep ON rep.rid = words.rid AND rep.i = words.i),
kept AS (SELECT rid, count(*) AS n, sum(gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS k FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (rid)
"""
