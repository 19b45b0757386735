"""All names of a dictionary in all texts, as whole words, with their places.

Names are never collected. Their hashes go into a bitmap of fixed size, which is all that workers get of them; a text's runs of
words that the bitmap lets through, nearly all of them names, then meet the names by equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Bits of the bitmap for each name, and of the bitmap at least and at most (16 MB); pieces that it is put together from.
BITS_A_NAME, LEAST_BITS, MOST_BITS, PIECES = 16, 1 << 20, 1 << 27, 64
#: Characters that a name needs.
SHORTEST = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def flat(text: Column) -> Column:
    """A text as it is compared: lower case, and one space for all that is neither word character nor underscore."""
    return C.squash(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same on every worker."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True) if words else np.zeros(0, np.uint64)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of all names (flat): each task gives those of its names, by pieces."""
    piece = bits // PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for name in batch.column("flat").to_pylist():
                words = name.split(" ")
                at = int(run_hashes(word_hashes(words), len(words))[0]) % bits
                held.setdefault(at // piece, np.zeros(piece, bool))[at % piece] = True
        for k, marked in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(marked).tobytes()], pa.binary())], ["piece", "marked"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        all_of = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in group["marked"]])
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "marked": [all_of.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for row in names.select("flat").mapInArrow(mark, "piece long, marked binary").groupBy("piece").applyInPandas(join, "piece long, marked binary").toLocalIterator():
        out[row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["marked"], np.uint8)
    return out


def occurrences(names: DataFrame, texts: DataFrame, name_id: str, name: str, text_id: str, text: str, longest: bool = False) -> DataFrame:
    """name_id, text_id, at (words before) and words of every place where a text has a name as whole words, both flattened (see
    flat). Names of fewer than SHORTEST characters count for nothing. longest: without places that lie within a longer name's.
    Several names that flatten alike are found each; a text whose id repeats gives its places each time."""
    known = names.select(F.col(name_id), flat(F.col(name)).alias("flat")).where(F.length("flat") >= SHORTEST)
    known = known.withColumn("words", F.size(F.split("flat", " ")))
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("words")).alias("words")).first()
    lengths = sizes["words"]  # a number for each length that names have
    bits = int(min(MOST_BITS, max(LEAST_BITS, 2 ** int(np.ceil(np.log2(max(1, sizes["n"]) * BITS_A_NAME))))))
    marked = bitmap(known, bits) if lengths else np.zeros(bits // 8, np.uint8)
    kind = texts.schema[text_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pa.compute.split_pattern(pa.compute.fill_null(batch.column("_flat").cast(pa.large_string()), ""), " ")
            words = split.flatten().dictionary_encode()  # each different word is hashed once
            first = split.offsets.to_numpy() - split.offsets[0].as_py()
            told, number = words.dictionary.to_pylist(), words.indices.to_numpy()
            hashes = word_hashes(told)[number]
            for k in lengths:
                h = run_hashes(hashes, k) % np.uint64(bits)
                at = np.flatnonzero(marked[(h >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (h & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(first, at, side="right") - 1
                fine = at + k <= first[row + 1]  # a run stays within its text
                at, row = at[fine], row[fine]
                runs = [words.dictionary.take(pa.array(number[at + i])) for i in range(k)]
                flats = pa.compute.binary_join_element_wise(*runs, pa.scalar(" ", runs[0].type)) if k > 1 else runs[0]
                columns = [batch.column("_id").take(pa.array(row)), pa.array(at - first[row], pa.int64()), pa.array(np.full(len(at), k, np.int32)), flats.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "at", "words", "flat"])

    met = texts.select(F.col(text_id).alias("_id"), flat(F.col(text)).alias("_flat")).mapInArrow(run, f"_id {kind}, at long, words int, flat string")
    hits = met.join(known.select(name_id, "flat"), "flat").select(name_id, F.col("_id").alias(text_id), "at", "words")
    return unnested(hits, text_id) if longest else hits


def unnested(hits: DataFrame, text_id: str) -> DataFrame:
    """hits (text_id, at, words) without those that lie within a longer one of their text, by one sort of the hits."""
    here = Window.partitionBy(text_id).orderBy("at")
    to = F.col("at") + F.col("words")
    # what begins before and ends no sooner is longer, and so is what begins at the same place and ends later
    before, same = (F.max(to).over(here.rangeBetween(*r)) for r in ((Window.unboundedPreceding, -1), (0, 0)))
    rows = hits.withColumns({"_before": before, "_same": same})
    alone = F.col(text_id).isNull() | ((F.coalesce("_before", F.lit(0)) < to) & (F.col("_same") == to))
    return rows.where(alone).select(hits.columns)
