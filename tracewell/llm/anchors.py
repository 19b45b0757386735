"""Repeated windows of documents, brought together by the anchors that they contain.

A window is W consecutive units (bytes or words) of one document. Its anchor is its k-gram of least hash (the first of
equal ones): equal windows have equal anchors at equal places, so windows that repeat always share an anchor. Windows
that follow each other and share an anchor form a snippet. Only snippets whose anchor occurs again can hold a repeated
window; their distinct forms go to shards by anchor, an index of the shard says which units repeat, and what it says goes
back to every occurrence. Text is only moved by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
#: Units of a document whose anchors are sought at a time; bits of a gram's hash that are compared.
SEGMENT, PLACE_BITS = 1 << 17, 23
#: Bytes of text whose anchors are sought at a time.
SEARCH_BYTES = 128 << 10
#: Bytes of text for each bucket of anchors; distinct snippets of an anchor that one shard takes whole.
BUCKET_BYTES, WHOLE = 8 << 20, 1024
#: Bytes of text that are cut into snippets at a time.
CUT_BYTES = 256 << 10
#: Offsets from the anchor that share a shard when an anchor has more snippets than that.
OFFSETS = 8
#: Bytes of snippets that are indexed at a time, at least; the last anchor's may follow, WHOLE snippets at most. An index takes
#: some hundred bytes for each of them while it is built.
SHARD_BYTES = 128 << 10


@dataclass(frozen=True)
class Units:
    """What documents are made of: window and anchor lengths in units, and whether a unit is a word (else a byte)."""

    window: int
    gram: int
    word: bool

    def hashes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """A hash of each unit, and the rows' offsets in units."""
        if not self.word:
            return words._BYTES[data], offs, None
        starts, ends, first = words.spans(data, offs)
        return words.hashes(data, starts, ends, lower=False), first, (starts, ends)


def rolling(unit: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive units, by doubling."""
    base, out, have = 0x9E3779B97F4A7C15, np.zeros(len(unit), U), 0
    power, size, step = unit, 1, base
    n = len(unit)
    while True:
        if k & size:
            m = n - have - size + 1
            if have:
                out = out[:m] * U(pow(base, size, 2**64)) + power[have : have + m]
            else:
                out = power[:m].copy()
            have += size
        if have == k:
            return words.mix(out)
        m = n - 2 * size + 1
        power = power[:m] * U(step) + power[size : size + m]
        size, step = 2 * size, step * step % 2**64


def least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of all w consecutive keys."""
    size, out = 1, keys
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def snippets(unit: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, lo (unit in its row), length, anchor's offset, anchor hash and content hash of every snippet."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    n = len(unit)
    if n < window:
        return none
    out = []
    for s in range(0, n - window + 1, SEGMENT):
        part = unit[s : s + SEGMENT + window - 1]
        g = rolling(part, gram)
        keys = g & ~U((1 << PLACE_BITS) - 1) | np.arange(len(g), dtype=U)
        at = (least(keys, window - gram + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        i = np.arange(len(at))
        row = np.searchsorted(first, i + s, side="right") - 1
        fine = i + s + window <= first[row + 1]
        i, at, row = i[fine], at[fine], row[fine]
        if not len(i):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(i)]]) - 1
        lo, end, place = i[new], i[last] + window, at[new]
        # a prefix sum of hashes weighted by place tells the content, whatever its length
        weight = np.empty(len(part) + 1, U)
        weight[0] = 0
        up, down = powers(len(part) + 1)
        np.cumsum(part * up[: len(part)], out=weight[1:])
        content = words.mix((weight[end] - weight[lo]) * down[lo] + (place - lo).astype(U) * U(0xD6E8FEB86659FD93) + (end - lo).astype(U))
        out.append((row[new], lo + s - first[row[new]], end - lo, place - lo, g[place], content))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of a fixed odd number and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        base = 0xA24BAED4963EE407
        for k, b in enumerate((base, pow(base, -1, 2**64))):
            out = np.full(size, b, U)
            out[0] = 1
            _POWERS[k:k + 1] = [np.cumprod(out)]
    return _POWERS


FIELDS = "doc_id {key}, h long, lo long, len int, off int, anchor long, snip long"


def occurrences(docs: DataFrame, units: Units, text: str, key: str, size: int) -> DataFrame:
    """doc_id, h, lo, len, off, anchor and snip of every snippet whose anchor occurs at least twice.

    Mappers send what they find in blobs by bucket of the anchor's hash. Where an anchor occurs more than once among the
    texts of a blob, that is known there: those snippets go to any bucket, and one note of the anchor to its own; so a
    bucket gets at most one entry of an anchor from each blob, however often it occurs. Buckets and tasks are made in proportion to
    size, the bytes of all texts."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    n_buckets = max(common.shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    search_bytes = SEARCH_BYTES
    fields = np.dtype([("row", "<i4"), ("lo", "<i8"), ("len", "<i4"), ("off", "<i4"), ("anchor", "<u8"), ("snip", "<u8"), ("known", "u1")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, text):
            found, base = [], 0
            for part in common.split(batch, text, search_bytes):
                data, offs = common.utf8(part.column(text))
                unit, first, _ = units.hashes(data, offs)
                row, lo, length, off, anchor, snip = snippets(unit, first, units.window, units.gram)
                found.append(np.empty(len(row), fields))
                for name, v in zip(fields.names, (row + base, lo, length, off, anchor, snip, 0), strict=True):
                    found[-1][name] = v
                base += part.num_rows
            found = np.concatenate(found)
            found = found[np.argsort(found["anchor"], kind="stable")]
            a = found["anchor"]
            new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(a)]]))
            many = np.repeat(sizes > 1, sizes)
            known = found[many]
            known["known"] = 1
            notes = found[many & new]
            notes["known"] = 2
            everything = np.concatenate([found[~many], known, notes])
            spread = words.mix(everything["snip"] ^ words.mix(everything["row"].astype(U)))
            bucket = np.where(everything["known"] == 1, spread, words.mix(everything["anchor"])) % U(n_buckets)
            order = np.argsort(bucket, kind="stable")
            everything, bucket = everything[order], bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
            ids, hashes = batch.column("_key"), batch.column("_h").to_numpy()
            columns: list[list] = [[], [], [], []]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = everything[s:e].copy()
                rows, part["row"] = np.unique(part["row"], return_inverse=True)
                columns[0].append(int(bucket[s]))
                columns[1].append(ids.take(pa.array(rows)))
                columns[2].append(hashes[rows].tobytes())
                columns[3].append(b"".join(np.ascontiguousarray(part[f]).tobytes() for f in fields.names))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[1]])]).astype(np.int32)), pa.concat_arrays(columns[1]) if columns[1] else pa.array([], ids.type))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), lists, common.binary(columns[2]), common.binary(columns[3])], ["bucket", "ids", "hs", "found"])

    def unpack(raw: bytes) -> np.ndarray:
        n = len(raw) // fields.itemsize
        out, at = np.empty(n, fields), 0
        for f in fields.names:
            size = fields[f].itemsize
            out[f] = np.frombuffer(raw, fields[f], n, at)
            at += n * size
        return out

    def meet(batch_of: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in batch_of.column("found")]
        lists = batch_of.column("ids").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for part, s in zip(parts, starts[:-1], strict=True):
            part["row"] += s
        ids = lists.flatten()
        hs = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in batch_of.column("hs")])
        found = np.concatenate(parts)
        direct, rest = found[found["known"] == 1], found[found["known"] != 1]
        rest = rest[np.argsort(rest["anchor"], kind="stable")]
        a = rest["anchor"]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
        sizes = np.diff(cuts)
        noted = np.maximum.reduceat(rest["known"], cuts[:-1]) > 0 if len(a) else np.zeros(0, bool)
        keep = np.repeat((sizes > 1) | noted, sizes) & (rest["known"] == 0)
        out = np.concatenate([direct, rest[keep]])
        return pa.table([ids.take(pa.array(out["row"])), pa.array(hs[out["row"]]), pa.array(out["lo"]), pa.array(out["len"]), pa.array(out["off"]), pa.array(out["anchor"].view("<i8")), pa.array(out["snip"].view("<i8"))], names=["doc_id", "h", "lo", "len", "off", "anchor", "snip"])

    blobs = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h"), text).mapInArrow(find, f"bucket long, ids array<{kind}>, hs binary, found binary")
    return blobs.repartition(common.tasks(spark, size), "bucket").groupBy("bucket").applyInArrow(lambda t: meet(t.select(["ids", "hs", "found"])), FIELDS.format(key=kind))


def pieces(window: int, lo: np.ndarray, length: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which of the snippets, step, first unit and length of the parts by which snippets of an anchor with many forms are
    indexed. Windows are parted by their distance from the anchor: equal windows have equal distances, so they fall into one
    step. Within a step they are dealt by what all windows of the step hold, so that no anchor's forms must meet in one
    place."""
    last = length - window
    low, high = (off - last) // OFFSETS, off // OFFSETS
    which = np.repeat(np.arange(len(lo)), high - low + 1)
    step = common.take_ranges(low, high - low + 1)
    i = np.maximum(0, off[which] - step * OFFSETS - OFFSETS + 1)
    j = np.minimum(last[which], off[which] - step * OFFSETS)
    fine = i <= j
    return which[fine], step[fine], i[fine], (j - i + window)[fine]


def digest(*parts: bytes) -> int:
    import xxhash

    h = xxhash.xxh64()
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.intdigest() - 2**63


def repeated(docs: DataFrame, units: Units, index: Callable[[list[tuple[bytes, int]]], list[np.ndarray]], text: str = "text", key: str = "doc_id", passages: bool = False) -> DataFrame:
    """doc_id, h (hash of the text) and spans (array of start and end in units, neither sorted nor merged) of the units of
    docs that a repeated window covers; rows without any are left out. passages: instead of spans, an array of what the covered
    stretches of the row's snippets hold (words with one space between them).

    index takes snippets (content, copies) and returns the covered spans of each as rows of start
    and end. It gets all snippets that can share a window at once, and others with them."""
    kind = docs.schema[key].dataType.simpleString()
    size = common.text_bytes(docs, text)
    found = common.materialize(occurrences(docs, units, text, key, size), "repeats")
    distinct = found.groupBy("anchor", "snip").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "h", "lo", "len", "off")).alias("at"))
    forms = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms")).where(F.col("forms") > WHOLE)
    distinct = distinct.join(forms, "anchor", "left").select("at.doc_id", "at.h", F.struct("anchor", "snip", "copies", "at.lo", "at.len", "at.off", F.col("forms").isNotNull().alias("wide")).alias("item"))
    wanted = distinct.groupBy("doc_id", "h").agg(F.collect_list("item").alias("wanted"))
    # rows equal in key and text have the same snippets: one of them is cut, whatever their number. Keys of any type, nulls
    # included, are told by a hash
    told = lambda k: F.xxhash64(F.isnull(k), k)
    source = docs.select(told(key).alias("_key"), F.xxhash64(text).alias("_th"), F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(["_key", "_th"])
    held = source.join(wanted.select(told("doc_id").alias("_key"), F.col("h").alias("_th"), "wanted"), ["_key", "_th"]).select("_text", "wanted")
    window = units.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "_text", CUT_BYTES):
            data, first = common.utf8(batch.column("_text"))
            if units.word:  # words, each with one space behind it
                starts, ends, first = words.spans(data, first)
                sizes = ends - starts
                place = np.concatenate([[0], np.cumsum(sizes + 1)])
                spaced = np.full(place[-1], 0x20, np.uint8)
                spaced[common.take_ranges(place[:-1], sizes)] = data[common.take_ranges(starts, sizes)]
                data = spaced
            wanted = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            items = wanted.flatten()
            anchor, snip, copies, lo, length, off, wide = (items.field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "snip", "copies", "lo", "len", "off", "wide"))
            length, off = length.astype(np.int64), off.astype(np.int64)

            def content(at: np.ndarray, n: np.ndarray) -> pa.Array:
                if units.word:
                    return common.byte_strings(data, place[at], place[at + n] - place[at] - 1)  # noqa: B023
                return common.byte_strings(data, at, n)  # noqa: B023

            whole = np.flatnonzero(~wide)
            at = first[owner[whole]] + lo[whole]
            out = [anchor[whole], snip[whole], anchor[whole], snip[whole], np.zeros(len(whole), np.int64), copies[whole]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), content(at, length[whole])], names)
            if not wide.any():
                continue
            many = np.flatnonzero(wide)
            which, step, i, n = pieces(window, lo[many], length[many], off[many])
            which = many[which]
            at = first[owner[which]] + lo[which] + i
            # every window of a step holds its middle, so equal windows have equal middles
            before = off[which] - i - step * OFFSETS
            core = content(at + before, np.full(len(at), window - OFFSETS + 1))
            held_by = content(at, n)
            group = [digest(b"%d %d" % (x, s), c.as_py()) for x, s, c in zip(anchor[which].tolist(), step.tolist(), core, strict=True)]
            piece = [digest(b"%d" % x, c.as_py()) for x, c in zip(before.tolist(), held_by, strict=True)]
            out = [group, piece, anchor[which], snip[which], i, copies[which]]
            yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out], held_by], names)

    names = ["group", "piece", "anchor", "snip", "at", "copies", "content"]
    parts = common.materialize(held.mapInArrow(cut, "group long, piece long, anchor long, snip long, at long, copies long, content binary"), "snippets")
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            spans = index([x[2:] for x in held_now])
            out = [(x[0], x[1], s) for x, s in zip(held_now, spans, strict=True) if len(s)]
            width = 1 if passages else 2
            offs = pa.array(np.concatenate([[0], np.cumsum([width * len(s) for _, _, s in out])]).astype(np.int32))
            if passages:
                flat = common.binary([p for x, s in zip(held_now, spans, strict=True) if len(s) for p in stretches(x[2], s)])
            else:
                flat = pa.array(np.concatenate([s.ravel() for _, _, s in out]).astype(np.int64) if out else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(offs, flat)], ["group", "piece", "marks"])

        held_now: list[tuple] = []
        size = 0
        common.release()
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("group", "piece", "content", "copies")), strict=True):
                if held_now and held_now[-1][:2] == x[:2]:  # copies of a part count together, whichever forms they come from
                    held_now[-1] = (*x[:3], held_now[-1][3] + x[3])
                    continue
                if size > SHARD_BYTES and x[0] != held_now[-1][0]:
                    yield flush()
                    held_now, size = [], 0
                held_now.append(x)
                size += len(x[2])
        if held_now:
            yield flush()
        common.release()

    kind_of = "array<binary>" if passages else "array<long>"
    marks = parts.select("group", "piece", "copies", "content").repartition(common.tasks(docs.sparkSession, size), "group").sortWithinPartitions("group", "piece").mapInArrow(shard, f"group long, piece long, marks {kind_of}")
    of_form = parts.select("group", "piece", "anchor", "snip", "at").join(marks, ["group", "piece"])
    shifted = lambda by: F.col("marks") if passages else F.transform("marks", lambda x: x + F.col(by))
    of_form = of_form.groupBy("anchor", "snip").agg(F.flatten(F.collect_list(shifted("at"))).alias("marks"))
    # written first, so that the join's inputs are plain shuffles and a form of very many occurrences is split
    of_form = common.materialize(of_form, "marks")
    common.drop(parts)
    placed = found.select("doc_id", "h", "lo", "anchor", "snip").join(of_form, ["anchor", "snip"]).select("doc_id", "h", shifted("lo").alias("marks"))
    # equal rows give equal marks, which count once
    held = F.flatten(F.collect_set("marks"))
    spans = common.materialize(placed.groupBy("doc_id", "h").agg((F.array_distinct(held) if passages else held).alias("passages" if passages else "spans")), "spans")
    common.drop(found, of_form)
    return spans


def stretches(content: bytes, spans: np.ndarray) -> list[bytes]:
    """The words of the spans of a content (words with one space between them)."""
    parts = content.split(b" ")
    return [b" ".join(parts[s:e]) for s, e in spans.tolist()]


def with_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the array _tw_spans (or _tw_passages), null where there are none."""
    named = spans.select(F.col("doc_id").alias("_tw_doc"), F.col("h").alias("_tw_sh"), F.col(spans.columns[-1]).alias(f"_tw_{spans.columns[-1]}"))
    rows = docs.withColumn("_tw_h", F.xxhash64(text))
    return rows.join(named, F.col(key).eqNullSafe(F.col("_tw_doc")) & (F.col("_tw_h") == F.col("_tw_sh")), "left").drop("_tw_doc", "_tw_h", "_tw_sh")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of start and end), sorted, with those that meet or overlap made one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[new, 0], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def runs(marked: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Spans of true units of each row; offs: the rows' offsets in marked. Spans end where their row does."""
    edges = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
        out.append(np.stack([np.maximum(starts[i:j], a) - a, np.minimum(ends[i:j], b) - a], 1))
    return out
