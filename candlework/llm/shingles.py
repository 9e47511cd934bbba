"""Hashes of words and word shingles, a slice of texts at a time."""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial over the bytes of a word, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WORDS = 5


def mix(z: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of strings (no nulls) and the bounds of each text in them."""
    wide = str(texts.type).startswith("large")
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0] if len(texts) else np.zeros(1, np.int64)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word, and the bounds of each text in the words."""
    blank = BLANKS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1 if len(raw) else starts
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text in the words, and the 64-bit hash of every word; ``lower`` folds A-Z."""
    raw, bounds = text_bytes(texts)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, words = word_spans(raw, bounds)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), dtype=np.uint64)])
    return words, mix((sums[ends] - sums[starts]) * powers(len(raw) + 1, INVERSE)[starts])


def shingles(words: np.ndarray, hashes: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle; a text of fewer words has one shingle of all its words, an empty one none."""
    n = np.diff(words)
    count = np.where(n >= width, n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    first = words[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    got = np.full(len(text), width, np.uint64)
    for k in range(width):
        got = mix(got * np.uint64(BASE) + hashes[first + k]) if len(text) else got
    short = np.flatnonzero((n > 0) & (n < width))
    own = np.array([n[t] for t in short], np.uint64)
    for j, t in enumerate(short):
        for k in range(words[t], words[t + 1]):
            own[j : j + 1] = mix(own[j : j + 1] * np.uint64(BASE) + hashes[k : k + 1])
    text, got = np.concatenate([text, short]), np.concatenate([got, own])
    return text, got


def weighted(text: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their multiplicity, ordered by text."""
    order = np.lexsort((got, text))
    text, got = text[order], got[order]
    new = np.ones(len(got), bool)
    new[1:] = (text[1:] != text[:-1]) | (got[1:] != got[:-1])
    at = np.flatnonzero(new)
    return text[at], got[at], np.diff(np.append(at, len(got)))
