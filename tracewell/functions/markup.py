"""Places in text with markup and in the same text without it, both ways in constant time.

A bit for each character says whether it is kept. Bits stand in 64-bit words with the kept characters before each word (rank), and
the word of every 64th kept character is known (select), so a place is found from either side by one look-up and one word."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is markup: tags, comments and declarations.
TAG = re.compile(r"<[^>]*>")


class MarkupMap:
    """The kept characters of a text: all that no match of the pattern covers."""

    def __init__(self, raw: str, pattern: re.Pattern = TAG) -> None:
        keep = np.ones(-(-(len(raw) + 1) // 64) * 64, bool)
        keep[len(raw) :] = False
        for m in pattern.finditer(raw):
            keep[m.start() : m.end()] = False
        self.raw, self.plain = raw, pattern.sub("", raw)
        self.words = np.packbits(keep, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.hints = np.searchsorted(self.before, np.arange(0, self.before[-1] + 1, 64), side="right") - 1

    def to_plain(self, at: int) -> int:
        """Kept characters before a place of the raw text; places from 0 to its length."""
        if not 0 <= at <= len(self.raw):
            raise IndexError(at)
        word = int(self.words[at >> 6]) & ((1 << (at & 63)) - 1)
        return int(self.before[at >> 6]) + word.bit_count()

    def to_raw(self, at: int) -> int:
        """The place in the raw text of the kept character at a place; the raw length for the place behind the last."""
        total = int(self.before[-1])
        if not 0 <= at <= total:
            raise IndexError(at)
        if at == total:
            return len(self.raw)
        w = int(self.hints[at >> 6])
        while self.before[w + 1] <= at:  # within 64 kept characters of the hint; words without any are skipped by their counts
            w = max(w + 1, int(np.searchsorted(self.before, at, side="right")) - 1)
        word, left = int(self.words[w]), at - int(self.before[w])
        for _ in range(left):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


PLACES = T.ArrayType(T.StructType([T.StructField("plain", T.LongType()), T.StructField("raw", T.LongType()), T.StructField("length", T.LongType())]))


@F.pandas_udf(PLACES)
def stretches_udf(text: pd.Series) -> pd.Series:
    """For each stretch between markup that isn't empty: its place without markup, its place with it, and its length; by the map."""

    def run(raw: str | None) -> list | None:
        if raw is None:
            return None
        found, at = MarkupMap(raw), 0
        out = []
        total = len(found.plain)
        while at < total:
            start = found.to_raw(at)
            end = raw.find("<", start)
            while end >= 0 and found.to_plain(end) == found.to_plain(min(end + 1, len(raw))) - 1:  # a bracket that opens no tag
                end = raw.find("<", end + 1)
            to = found.to_plain(end if end >= 0 else len(raw))
            out.append((at, start, to - at))
            at = to
        return out

    return text.map(run)
