"""Periodic runs of words by an online sparse diagonal recurrence.

A run with period q is a diagonal: as long as a word equals the word q places before it, the match length of lag q grows
by one, else it falls to nothing.  The recurrence is kept sparse: a lag is active only while an earlier occurrence of
what has just been read increments it, and a diagonal that ends with enough matches emits its run at once.

Which earlier occurrences count: a run is at least three periods and 24 words long, so its diagonal has 2q matches or
more, and 16 at least.  Take the smallest k of 8, 16, 32, ... that is not below q.  Inside the run the last k words have
their latest earlier occurrence exactly q places back (a nearer one would give the run a smaller period), and they have
one as soon as the diagonal has k matches, which it reaches.  So each word takes from each length k at most one earlier
occurrence, that with the latest k equal words, and only at lags in (k/2, k]; the match length starts at k there.
Lengths stop as soon as no k words repeat.  Text of any kind costs n log n at most, also a text of one word all over;
words outside repeated eights cost one look.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import arrow_schema, text_or_empty
from candlework.llm.shingles import mix, text_bytes, word_spans

GRAM = 8
MIN_WORDS, MIN_TURNS = 24, 3

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS_SCHEMA = "doc_id long, start long, length long, period long"


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both values are equal."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lags and lengths k at which an earlier occurrence of the last k words counts, by place."""
    n, width = len(words), 1
    names, found = words.astype(np.int64), []
    while True:
        if width >= GRAM:
            order = np.argsort(names, kind="stable")
            same = np.flatnonzero(names[order][1:] == names[order][:-1])
            if not len(same):
                break
            at, lag = order[same + 1], order[same + 1] - order[same]
            use = (lag <= width) & ((lag > width // 2) | (width == GRAM))
            found.append((at[use] + width - 1, lag[use], np.full(int(use.sum()), width)))
        if MIN_TURNS * (width + 1) > max(n, MIN_WORDS) or n < 2 * width:
            break
        names = pair_names(names[:-width], names[width:])  # by first word, so that a name is one of ``width`` words on
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, lag, width = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], lag[order], width[order]


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; ``words`` are numbers of words."""
    out, active = [], {}

    def end(lag: int) -> None:
        last, matches = active.pop(lag)
        if matches + lag >= max(MIN_WORDS, MIN_TURNS * lag):
            out.append((last + 1 - matches - lag, matches + lag, lag))

    now = -1
    for at, lag, width in zip(*(x.tolist() for x in occurrences(words))):
        if at != now:
            for over in [x for x, (last, _) in active.items() if last < at - 1]:
                end(over)
            now = at
        last, matches = active.get(lag, (-1, 0))
        active[lag] = (at, matches + 1 if last == at - 1 else width)
    for lag in list(active):
        end(lag)
    return sorted(out, key=lambda r: (r[0], r[2]))


def rebuilt(doc_id: int | None, n: int) -> np.ndarray:
    """For every word of a text, which of its words stands there by the rule of the test: a tenth of the texts get a period."""
    source = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        source[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def word_numbers(texts):
    """Numbers of the words of Arrow strings, bounds of each text in them, and the distinct words."""
    import pyarrow as pa

    raw, bounds = text_bytes(texts)
    starts, ends, words = word_spans(raw, bounds)
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    own = np.ascontiguousarray(raw[np.cumsum(inside[:-1]) > 0]) if len(raw) else raw
    told = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)).dictionary_encode()
    return told.indices.to_numpy().astype(np.int64), words, told.dictionary


def may_repeat(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether any eight words of a text come twice, by hashes; a text with a run has such."""
    n = len(numbers)
    some = np.zeros(len(bounds) - 1, bool)
    if n < GRAM:
        return some
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashed = mix(numbers.astype(np.uint64) + np.uint64(1))
    names = mix(text[: n - GRAM + 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(GRAM):
        names = mix(names * np.uint64(0x9E3779B97F4A7C15) + hashed[k : n - GRAM + 1 + k])
    own = np.flatnonzero(text[: n - GRAM + 1] == text[GRAM - 1 :])
    order = own[np.argsort(names[own])]
    twice = order[1:][names[order][1:] == names[order][:-1]]
    some[text[twice]] = True
    return some


def mapped(docs: DataFrame, schema: str, row_of, as_test: bool) -> DataFrame:
    """``row_of(doc_id, numbers, found, words)`` gives rows without the id; ``words`` are the distinct words of the slice."""
    arrow = arrow_schema(schema)

    def rows(batches):
        import pyarrow as pa

        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            numbers, bounds, distinct = word_numbers(batch.column("text"))
            if as_test:
                numbers = numbers[np.concatenate([np.zeros(0, np.int64), *[a + rebuilt(i, b - a) for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist())]])]
            repeats = may_repeat(numbers, bounds)
            words = np.array(distinct.to_pylist(), object)
            found = []
            for i, a, b, some in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), repeats.tolist()):
                own = numbers[a:b]
                found += [(i, *row) for row in row_of(own, runs(own) if some else [], words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * len(arrow), arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(rows, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per run of every text (``RUNS_SCHEMA``); nulls, empty texts and texts without a run give no rows."""
    return mapped(docs, RUNS_SCHEMA, lambda own, found, words: found, as_test=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def summary(own: np.ndarray, found: list[tuple[int, int, int]], words: np.ndarray) -> list[tuple]:
    keep = np.ones(len(own), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
    return [(len(own), len(found), *best, sha256(listed), sha256(" ".join(words[own[keep]].tolist())))]


def run_digests(docs: DataFrame, *, as_test: bool = False) -> DataFrame:
    """Per row the number of runs, the run of the greatest exponent, and digests of all runs and of the text without them.

    Of runs with the same exponent the first counts, then that of the smaller period.  Null and empty texts, and texts
    without words, have no words and no runs (nulls for the run, digests of nothing); repeated rows give repeated
    results, an empty table gives none, other columns are left out.  ``as_test`` gives a tenth of the texts a
    period first, by a rule on doc_id; rows without an id stay as they are.  Nothing is shuffled.
    """
    return mapped(docs, SCHEMA, summary, as_test)
