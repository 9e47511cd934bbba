"""Benchmark decontamination by spaced seeds.

A seed hashes the words under the ones of a fixed mask and ignores those under the zeros, so a changed word spoils
only the seeds that look at it.  Every position of every text is hashed under every mask and looked up among the
seeds of the benchmark.  A hit names a diagonal (place in the text minus place in the item); on it the stretch of the highest score
(+1 a matching word, -4 a substituted one) through the hit is taken, and it is an overlap if it has enough matching words.
With ``share``, a diagonal without such a stretch is an overlap too, from its first matching word to its last, if that
share of the item (of 8 words or more) matches on it.  Items of up to 20 words, of which a few changes spoil every seed
of seven words, have seeds of four words as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import in_small_batches, text_or_empty
from candlework.llm.shingles import mix, word_hashes

#: Fixed masks: seven of twelve words each, two masks share at most four.
MASKS = ("110100110101", "111010001011", "101101011001")
SPAN = 12
#: Matching words an overlap needs (all the words of a shorter item), and the cost of a substitution.
MIN_WORDS, PENALTY = 12, 4
#: Per cent of the words of an item that make an overlap wherever on one diagonal they match, and the fewest words of such an item.
SHARE, ONE_OFF = 70, 8
#: Items of up to so many words have seeds of four words under these masks as well.
FEW_WORDS, FEW_MASKS = 20, ("1111", "110011", "10110001", "1001000101")
#: Hits times places that are looked at together.
PAIRS = 1 << 21
#: Words of a piece of a long item, and the words that neighbouring pieces share.
PIECE, SHARED = 2048, 128
#: Benchmark words that are looked up at once.
SLICE_WORDS = 1 << 20

SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_matched int"


def seed_hashes(hashes: np.ndarray, offsets, salt: int) -> np.ndarray:
    """Hash of the words at ``offsets`` from every position where they fit."""
    n = max(0, len(hashes) - max(offsets))
    out = np.full(n, salt, np.uint64)
    factor = 0x9E3779B97F4A7C15 + 2 * salt
    for o in offsets:
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        out = out + hashes[o : o + n] * np.uint64(factor)
    return mix(out)


def shapes(short: list[int]) -> list[tuple[int, list[int], int]]:
    """(salt, offsets, span) of the masks, and one without gaps for each length of a short item."""
    masks = [(k + 1, [o for o, c in enumerate(m) if c == "1"], SPAN) for k, m in enumerate(MASKS)]
    return masks + [(100 + n, list(range(n)), n) for n in short]


class Seeds:
    """Sorted seeds of one slice of the benchmark, and the words of its pieces."""

    def __init__(self, items: list[tuple[int, str]], share: int | None = None):
        import pyarrow as pa

        words, hashes = word_hashes(pa.array([t for _, t in items], pa.string()), lower=True)
        self.item, self.first, self.last, base = [], [], [], []
        for (item, _), a, b in zip(items, words.tolist(), words[1:].tolist()):
            for at in range(a, max(a + 1, b - SHARED), PIECE - SHARED) if b > a else ():
                self.item.append(item)
                self.first.append(at)
                self.last.append(min(at + PIECE, b))
                base.append(at - a)
        self.hashes, self.base, self.share = hashes, base, share
        self.shapes = shapes(sorted({b - a for a, b in zip(self.first, self.last) if b - a < SPAN}))
        keys, pieces, places = [], [], []
        for p, (a, b) in enumerate(zip(self.first, self.last)):
            for salt, offsets, span in self.shapes:
                if span == SPAN or b - a == span:
                    got = seed_hashes(hashes[a:b], offsets, salt)[: max(0, b - a - span + 1)]
                    keys.append(got)
                    pieces.append(np.full(len(got), p))
                    places.append(np.arange(len(got)))
        few = [(200 + k, [o for o, c in enumerate(m) if c == "1"], len(m)) for k, m in enumerate(FEW_MASKS)]
        short = [p for p, (a, b) in enumerate(zip(self.first, self.last)) if share and ONE_OFF <= b - a <= FEW_WORDS]
        for p in short:
            a, b = self.first[p], self.last[p]
            for salt, offsets, span in few:
                got = seed_hashes(hashes[a:b], offsets, salt)
                keys.append(got)
                pieces.append(np.full(len(got), p))
                places.append(np.arange(len(got)))
        self.shapes += few if short else []
        none = [np.zeros(0, np.uint64)]
        self.keys = np.concatenate(keys or none)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.piece, self.place = self.keys[order], np.concatenate(pieces or none)[order].astype(int), np.concatenate(places or none)[order].astype(int)

    @classmethod
    def of(cls, state: dict) -> Seeds:
        """From the plain values that travel to the tasks."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def overlaps(self, texts) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, matching words), best per text and item."""
        words, hashes = word_hashes(texts, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        if not len(self.keys) or not len(hashes):
            return []
        for t, piece, diagonal in self.diagonals(words, hashes):
            size = self.last[piece] - self.first[piece]
            least = min(MIN_WORDS, size)
            found = self.stretch(hashes, int(words[t]), int(words[t + 1]), piece, diagonal)
            if self.share and found[3] < least and size >= ONE_OFF:
                least = self.share * size / 100
                found = self.spread(hashes, int(words[t]), int(words[t + 1]), piece, diagonal)
            if found[3] >= least:
                key = (t, self.item[piece])
                best[key] = max(best.get(key, ()), (found[3], found[2], -found[0], -found[1]))
        return [(t, item, -d, -i, n, m) for (t, item), (m, n, d, i) in best.items()]

    def diagonals(self, words: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """Each (text, piece, place in the texts minus place in the piece) with a hit, once.

        Hits are paired with the places of their seed in parts of bounded size, and a part is reduced to its different
        diagonals, so periodic texts, whose seeds hit everywhere, cost their diagonals and no list of their hits.
        """
        import pandas as pd

        unique, first, count = np.unique(self.keys, return_index=True, return_counts=True)
        wide = np.int64(len(hashes) + PIECE + 1)
        found: list[np.ndarray] = []
        for salt, offsets, span in self.shapes:
            got = seed_hashes(hashes, offsets, salt)
            at = np.searchsorted(unique, got)
            at[at == len(unique)] = 0
            hit = np.flatnonzero(unique[at] == got)
            text = np.searchsorted(words, hit, "right") - 1
            inside = hit + span <= words[text + 1]
            hit, text = hit[inside], text[inside]
            slot = at[hit]
            upto = np.cumsum(count[slot])
            low = 0
            while low < len(hit):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
                n = count[slot[low:high]]
                entry = np.repeat(first[slot[low:high]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                owner = np.repeat(text[low:high], n) * len(self.item) + self.piece[entry]
                found.append(pd.unique(owner * wide + (np.repeat(hit[low:high], n) - self.place[entry] + PIECE)))
                if len(found) > 8:
                    found = [pd.unique(np.concatenate(found))]
                low = high
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        owner, diagonal = codes // wide, codes % wide - PIECE
        return list(zip((owner // len(self.item)).tolist(), (owner % len(self.item)).tolist(), diagonal.tolist()))

    def same(self, hashes: np.ndarray, a: int, b: int, piece: int, diagonal: int) -> tuple[int, np.ndarray]:
        """First word of the piece that a text's words from ``a`` to ``b`` have a partner for, and which words are equal from there on."""
        first, size = self.first[piece], self.last[piece] - self.first[piece]
        low, high = max(0, a - diagonal), min(size, b - diagonal)
        return low, hashes[diagonal + low : diagonal + high] == self.hashes[first + low : first + high]

    def spread(self, hashes: np.ndarray, a: int, b: int, piece: int, diagonal: int) -> tuple[int, int, int, int]:
        """A diagonal from its first matching word to its last."""
        low, same = self.same(hashes, a, b, piece, diagonal)
        at = np.flatnonzero(same)
        left, right = int(at[0]), int(at[-1]) + 1
        return diagonal + low + left - a, self.base[piece] + low + left, right - left, len(at)

    def stretch(self, hashes: np.ndarray, a: int, b: int, piece: int, diagonal: int) -> tuple[int, int, int, int]:
        """The best-scoring stretch of a diagonal, the first of equals."""
        low, same = self.same(hashes, a, b, piece, diagonal)
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
        right = int(np.argmax(score - np.minimum.accumulate(score)))
        left = int(np.argmin(score[: right + 1]))
        return diagonal + low + left - a, self.base[piece] + low + left, right - left, int(same[left:right].sum())


def benchmark_slices(benchmark: DataFrame, slice_words: int = SLICE_WORDS, share: int | None = None):
    """Slices of the benchmark of about ``slice_words`` words each, one after another; null items have no words."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + total // (6 * slice_words)
    for k in range(count):
        yield Seeds([(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).toLocalIterator()], share)


def overlaps(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS, share: int | None = None) -> DataFrame:
    """The longest overlap of every document with every benchmark item (``SCHEMA``); all rows against all items.

    Words are told apart by ASCII white space, A-Z folded.  Null or empty texts on either side overlap nothing;
    repeated rows and repeated items give one row per doc_id and item_id; equal stretches are told apart by their places (first
    in the text, then in the item); empty tables give none; other columns are left out.  The benchmark travels to the
    tasks in slices of bounded size, and each slice is one scan of the documents.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    context, out = docs.sparkSession.sparkContext, None
    for seeds in benchmark_slices(benchmark, slice_words, share):
        shared = context.broadcast(vars(seeds))

        def scan(batches, shared=shared):
            import pyarrow as pa

            names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matched"]
            for batch in slices(batches):
                found = Seeds.of(shared.value).overlaps(batch.column("text"))
                if found:
                    columns = list(zip(*found))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0])), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=names)

        part = rows.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("n_matched", "n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("s")
    return out.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "CAST(-s.d AS INT) AS doc_word", "CAST(-s.i AS INT) AS item_word", "s.n_words AS n_words", "s.n_matched AS n_matched")


def keep_clean(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS, share: int | None = None) -> DataFrame:
    """The documents without an overlap, with their columns; rows are judged one by one, without a shuffle."""
    context = in_small_batches(docs).sparkSession.sparkContext
    for seeds in benchmark_slices(benchmark, slice_words, share):
        shared = context.broadcast(vars(seeds))

        def keep(batches, shared=shared):
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in batches:
                text = pc.fill_null(batch.column("text"), "")
                own = pa.RecordBatch.from_arrays([text, pa.array(np.arange(batch.num_rows))], names=["text", "row"])
                dirty = {row.column("row")[f[0]].as_py() for row in slices([own]) for f in Seeds.of(shared.value).overlaps(row.column("text"))}
                clean = pa.array([k not in dirty for k in range(batch.num_rows)], pa.bool_())
                yield batch.filter(clean)

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
