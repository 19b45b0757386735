"""Vectorised words and hashes over batches of UTF-8 text.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit sums of powers modulo 2**64 over a fixed
random byte table, finished by a bijective mix, so equal words have equal hashes in every batch and on every machine."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Whether a byte parts words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
#: A-Z hash as a-z.
_LOWER = _BYTES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 19


def _powers(base: int) -> np.ndarray:
    out = np.ones(_BLOCK + 1, U)
    done, step = 1, base
    while done < len(out):
        take = min(done, len(out) - done)
        out[done : done + take] = out[:take] * U(step)
        done, step = done + take, step * step % 2**64
    return out


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


def spans(data: np.ndarray, offs: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that parts doesn't mark), and the index of the first word of each row
    (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~parts[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = True, True
    edge[1:n] = word[1:] != word[:-1]
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    is_word = word[cuts[:-1]]
    starts, ends = cuts[:-1][is_word], cuts[1:][is_word]
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
    table = _LOWER if lower else _BYTES
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, side="right")))
        to = ends[j - 1]
        if to - at > _BLOCK:  # one word longer than a block: in pieces
            total, place = np.zeros(1, U), 1
            for k in range(at, to, _BLOCK):
                part = data[k : min(to, k + _BLOCK)]
                piece = np.add.reduce(table[part] * _UP[: len(part)])
                total += np.array([piece]) * U(place)
                place = place * pow(_BASE, _BLOCK, 2**64) % 2**64
            out[i] = total[0]
        else:
            sums = np.empty(to - at + 1, U)
            sums[0] = 0
            np.cumsum(table[data[at:to]] * _UP[: to - at], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
        i = j
    return mix(out)


def odd(k: int) -> np.ndarray:
    """k fixed odd multipliers."""
    return mix(np.arange(1, k + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def grams(words: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within rows, in order, and the offsets of the rows. short: a row of 1 to k - 1
    words has its whole sequence as one gram."""
    n_words = np.diff(first)
    counts = np.maximum(n_words - k + 1, 0)
    factors = odd(k)
    if len(words) >= k:
        every = words[: len(words) - k + 1] * factors[0]
        for j in range(1, k):
            every = every + words[j : len(words) - k + 1 + j] * factors[j]
    else:
        every = np.zeros(0, U)
    brief = np.flatnonzero((n_words > 0) & (n_words < k)) if short else np.zeros(0, np.int64)
    counts[brief] = 1
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offs[-1], U)
    row = np.repeat(np.arange(len(counts)), counts)
    place = first[:-1][row] + (np.arange(offs[-1]) - offs[:-1][row])
    usual = np.ones(offs[-1], bool)
    usual[offs[:-1][brief]] = False
    out[usual] = every[place[usual]]
    for r in brief:
        w = words[first[r] : first[r + 1]]
        out[offs[r]] = np.add.reduce(np.append(w * factors[: len(w)], U(mix_int(len(w)))))
    return mix(out), offs
