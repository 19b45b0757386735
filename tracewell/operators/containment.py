"""Which texts of a group are contained in a longer one, without comparing all with all.

Of the byte 8-grams of a text, those that are the least by hash in a window of consecutive ones are its marks. A text that contains
another has the other's marks, and between its first and its last no others, so it has the stretches from mark to mark too. A text
looks for holders under that stretch of its own which fewest texts of the group have, and only those that have it are searched; one
that no other text has is in none. Longer texts are marked in wider windows, hence more sparsely; short texts have a mark instead of
stretches, and those too short for marks are looked up whole among the substrings of their length. What short texts ask for goes
into bitmaps, so that of what long ones have at that density only this moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import ragged
from .needles import marked as among

#: Bytes of a gram, and grams of a window at each level; a text's level is the last whose window it fills.
GRAM, WINDOWS = 8, (8, 56, 448)
#: Bytes that a text needs for each level.
LEAST = tuple(GRAM + w - 1 for w in WINDOWS)
#: Bytes from which a text has a mark at the first level, and two of each window after that, so that it has a stretch between two.
OWN = (LEAST[0], *(GRAM + 2 * w - 1 for w in WINDOWS))
LAST = len(OWN) - 1
#: Bits of a bitmap for each hash, and of a bitmap at least and at most (16 MB); pieces that it is put together from.
BITS_A_HASH, LEAST_BITS, MOST_BITS, PIECES = 64, 1 << 17, 1 << 27, 64
#: Bytes of texts that are hashed at once.
AT_ONCE = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the grams that begin at each byte."""
    out = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for i in range(min(GRAM, len(out))):
        part = out[i::GRAM]
        part[:] = np.frombuffer(data[i : i + GRAM * len(part)], "<u8")
    return _mix(out) | np.uint64(1)


def _wider(least: np.ndarray, size: int, window: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of each window of consecutive grams, from those of windows of a smaller size."""
    while size < window and len(least):
        step = min(size, window - size)
        least, size = of(least[: max(0, len(least) - step)], least[step:]), size + step
    return least


def _stretches(grams: np.ndarray, sums: np.ndarray, least: np.ndarray, window: int, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last gram and a hash of what lies between marks that follow each other; beyond: windows that reach over a text's end.

    The marks of a part, from its first to its last, are those of the whole there: a window that holds one of them and reaches over
    the part's end holds that first or last one too. So the whole has all stretches of a part."""
    held = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    inner = held[window - 1 : window - 1 + len(least)]
    inner[:] = least
    inner[beyond[beyond < len(least)]] = 0
    at = np.flatnonzero(_wider(held, 1, window, np.maximum) == grams)
    a, b = at[:-1], at[1:]
    return a, b, _mix((sums[b + 1] - sums[a]) ^ (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def marks(raw: bytes, window: int) -> np.ndarray:
    """Hashes that are the least of a window of consecutive grams' hashes, each once."""
    return np.unique(_wider(_grams(np.frombuffer(raw, np.uint8)), 1, window)).view(np.int64)


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes (h) of some n rows: each task gives those of its rows, by pieces."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_A_HASH).bit_length()))
    piece = bits // PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column("h").to_numpy().view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            which = at // piece
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    held.setdefault(int(which[a]), np.zeros(piece, bool))[at[a:b] % piece] = True
        for k, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["piece", "marked"])

    def join(group: pa.Table) -> pa.Table:
        all_of = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in group.column("marked").to_pylist()])
        return group.slice(0, 1).set_column(1, "marked", pa.array([all_of.tobytes()], pa.binary()))

    out, kinds = np.zeros(bits // 8, np.uint8), "piece long, marked binary"
    for row in hashes.mapInArrow(mark, kinds).groupBy("piece").applyInArrow(join, kinds).toLocalIterator():
        out[row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["marked"], np.uint8)
    return out


def _found(data: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray, has: np.ndarray, tag: np.ndarray, maps: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, level and mark, each once, of texts that stand side by side in data: of each text's own level, or (maps) of all levels
    that it fills of those that its group has (has), if they may be asked for."""
    end, n_bytes, out = first + size, len(data), []

    def add(level: int, at: np.ndarray, to: np.ndarray, chosen: np.ndarray, h: np.ndarray):
        """What begins at some bytes and ends before others, if it is of one text."""
        text = np.searchsorted(first, at, side="right") - 1
        fine = chosen[text] & (to <= end[text])
        text, h = text[fine], h[fine]
        if maps is not None and level in maps:
            fine = among(maps[level], _mix(h ^ tag[text]))
            text, h = text[fine], h[fine]
        out.append((text, np.full(len(text), level, np.int32), h))

    lengths = sorted(set(size[(own < 0) & (size > 0)].tolist())) if maps is None else maps["lengths"]
    if lengths:
        raw, h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(n_bytes + 1, np.uint64)
        for n in range(1, min(lengths[-1], n_bytes) + 1):
            h = _mix((h[: n_bytes - n + 1] ^ raw[n - 1 :]) + np.uint64(n))
            if n in lengths:
                some = (own < 0) & (size == n) if maps is None else has[:, 0]
                at = first[some] if maps is None else np.flatnonzero(among(maps["short"], h))
                add(-1, at, at + n, some, h[at])
    grams, width = _grams(data), 1
    least, sums = grams, np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
    for level, window in enumerate((WINDOWS[0], *WINDOWS)):
        some = (own == level) if maps is None else has[:, level + 1] & (size >= OWN[level])
        if not some.any():
            continue
        least, width = _wider(least, width, window), window
        if level:
            over = np.minimum(size, GRAM + window - 2)
            a, b, h = _stretches(grams, sums, least, window, ragged(end - over, over))
            add(level, a, b + GRAM, some, h)
        else:
            on = np.ones(len(least), bool)
            on[1:] = least[1:] != least[:-1]
            on[first[some]] = True
            at = np.flatnonzero(on)
            add(level, at, at + LEAST[0], some, least[at])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    text, level, h = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((h, level, text))
    text, level, h = text[order], level[order], h[order]
    once = np.ones(len(h), bool)
    once[1:] = (text[1:] != text[:-1]) | (level[1:] != level[:-1]) | (h[1:] != h[:-1])
    return text[once], level[once], h[once].view(np.int64)


def _marked(texts: DataFrame, maps: dict | None = None) -> DataFrame:
    """row, group, size, own, level and mark of texts (those, bytes and levels, a bit for each level that the group has; see _found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("bytes").cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            own, levels, group = (batch.column(c).to_numpy() for c in ("own", "levels", "group"))
            has = (levels[:, None] >> np.arange(LAST + 2)) & 1 > 0
            tag = _mix(group.view(np.uint64))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, side="right")) - 1)
                here = slice(a, b)
                text, level, mark = _found(data[ends[a] : ends[b]], ends[a:b] - ends[a], np.diff(ends[a : b + 1]), own[here], has[here], tag[here], maps)
                at = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("row", "group", "size", "own")], pa.array(level), pa.array(mark)], ["row", "group", "size", "own", "level", "mark"])
                a = b

    return texts.select("row", "group", "size", "own", F.encode("text", "UTF-8").alias("bytes"), "levels").mapInArrow(run, "row long, group long, size long, own int, level int, mark long")


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of marks with their groups."""
    for batch in batches:
        h = _mix(batch.column("mark").to_numpy().view(np.uint64) ^ _mix(batch.column("group").to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def contained(rows: DataFrame, group: str, text: str, ids: list[str]) -> DataFrame:
    """Distinct group and ids of rows with a text that a longer text of the same group (a long) contains. ids: hashes of the text (longs),
    which stand for it, so that texts move only where two are compared. Null texts are in none and hold none; the empty text is in
    every other."""
    from .iterate import drop, materialize

    texts = rows.where(F.col(text).isNotNull()).select(F.col(group).alias("group"), F.col(text).alias("text"), *ids, F.col(ids[0]).alias("row"))
    size = F.octet_length("text")
    own = sum((F.when(size >= n, 1).otherwise(0) for n in OWN), F.lit(-1))
    texts = materialize(texts.withColumns({"size": size.cast("long"), "own": own.cast("int")}), "contained-texts", "zstd")
    of_group = texts.groupBy("group").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("own") + 1)).alias("levels"), F.count_distinct("row").alias("n"))
    alone = materialize(of_group.where("n > 1").drop("n"), "contained-groups")  # texts stay where they are if these are few
    sent = texts.join(alone, "group")
    # what texts of the first levels ask for; of the last level there is little, which is all kept
    asks = materialize(_marked(sent.where(F.col("own") < LAST)).distinct(), "contained-asks")
    held = asks.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("level") < 0, F.col("size"))).alias("lengths")).collect()
    maps = {r["level"]: _bitmap(asks.where(F.col("level") == r["level"]).select("group", "mark").mapInArrow(_tagged, "h long"), r["n"]) for r in held}
    maps |= {k: np.zeros(LEAST_BITS // 8, np.uint8) for k in range(-1, LAST) if k not in maps}
    maps["lengths"] = sorted(n for r in held for n in r["lengths"])
    maps["short"] = _bitmap(asks.where("level < 0").select(F.col("mark").alias("h")), sum(r["n"] for r in held if r["level"] < 0))
    marked = materialize(_marked(sent, maps).distinct(), "contained-marks")
    seen = marked.groupBy("group", "level", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a text asks under what is rarest of its own; short ones under the one of their own length, which is the whole text's
    last = marked.where((F.col("level") == LAST) & (F.col("own") == F.col("level")))
    asking = asks.where("level >= 0").unionByName(last).join(seen, ["group", "level", "mark"], "left")
    rarest = asking.groupBy("row", "group", "level", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "mark")).alias("m")).where("m.n > 1").select("row", "group", "level", "size", "m.mark")
    asked = rarest.unionByName(asks.where("level < 0").select("row", "group", "level", "size", "mark")).select(F.col("row").alias("asker"), "group", "level", "mark", F.col("size").alias("asker_size"))
    holders = marked.select("row", "group", "level", "mark", "size")
    pairs = materialize(asked.join(holders, ["group", "level", "mark"]).where("size > asker_size").select("group", "asker", "row", "level"), "contained-pairs")
    drop(asks, marked)
    # of long texts only those that found a holder move as askers
    found = materialize(pairs.where(F.col("level") == LAST).select("group", F.col("asker").alias("row")).distinct(), "contained-askers")
    inner = texts.where((F.col("own") < LAST) & (F.col("size") > 0)).unionByName(texts.where(F.col("own") == LAST).join(found, ["group", "row"], "left_semi").select(texts.columns))
    inner = inner.select("group", F.col("row").alias("asker"), *ids, F.col("text").alias("inner")).repartition("group", "asker").dropDuplicates(["group", "asker", *ids])
    outer = texts.select("group", "row", F.col(ids[-1]).alias("_id"), F.col("text").alias("outer")).repartition("group", "row").dropDuplicates(["group", "row", "_id"]).drop("_id")
    hit = pairs.drop("level").join(inner, ["group", "asker"]).join(outer, ["group", "row"]).where(F.contains("outer", "inner")).select("group", *ids).distinct()
    empty = texts.where("size = 0").join(alone.select("group"), "group", "left_semi").select("group", *ids).distinct()
    hit = materialize(hit.unionByName(empty), "contained")
    drop(texts, alone, pairs, found)
    return hit.withColumnRenamed("group", group)
