"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory by the workers.

Counting deals the distinct words and word pairs of each slice of text, packed as sorted blocks, to parts by hash; a
task merges one part at a time and writes it as a sorted array to a folder that all workers see.  Workers map these
files and look words and pairs up by binary search, so the model is never held by the driver and costs a worker no
memory of its own.

- Words are 63-bit hashes; the place of a word in the sorted vocabulary is its id.  Id 0 is the end of a text.
- A pair is (id of the word before) << 32 | id.  The context of the first word has an id of its own.
- A context with more occurrences than a part should hold is spread over several parts by its second word.
"""

from __future__ import annotations

import mmap
import os
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import in_small_batches, kept, mounted_dir, stage, text_or_empty
from candlework.llm.shingles import mix, word_hashes

#: Bytes of training text for each part of the vocabulary, and occurrences of pairs for each part of the pairs.
VOCABULARY_BYTES, PAIRS_PER_PART = 32 << 20, 2_000_000
#: Ids of each part of the tables by id.
IDS_PER_PART = 1 << 20
SLICE = 3 << 20
MERGE_ROWS = 4_000_000

BLOCK = "part long, payload binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, the first one sorted, as a compact block; differences and counts compress well."""
    first = arrays[0].astype(np.int64)
    steps = np.diff(first, prepend=0)
    body = b"".join(np.ascontiguousarray(a.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for a in (steps, *arrays[1:]))
    return len(first).to_bytes(8, "little") + zlib.compress(body, 1)


def unsqueeze(block: bytes) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    body = np.frombuffer(zlib.decompress(block[8:]), np.uint8).reshape(-1, 8, n)
    arrays = [np.ascontiguousarray(a.T).view("<i8").ravel() for a in body]
    return [np.cumsum(arrays[0]), *arrays[1:]]


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values]]


def write_file(path: str, *arrays: np.ndarray) -> None:
    """Write arrays in one file; a repeated or second attempt replaces it as a whole."""
    spare = f"{path}.{uuid.uuid4().hex}"
    with open(spare, "wb") as f:
        f.write(np.array([len(arrays), *[len(a) for a in arrays]], "<i8").tobytes())
        for a in arrays:
            f.write(a.dtype.str.encode().ljust(8))
            f.write(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))
    os.replace(spare, path)


def map_file(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as f:
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    n = int(np.frombuffer(view, "<i8", 1)[0])
    lengths, at, out = np.frombuffer(view, "<i8", n, 8), 8 + 8 * n, []
    for size in lengths.tolist():
        kind = np.dtype(view[at : at + 8].decode().strip())
        out.append(np.frombuffer(view, kind, size, at + 8))
        at += 8 + -(-size * kind.itemsize // 8) * 8
    return out


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of texts in their tokens, and the tokens' hashes: words with A-Z folded, then one end (0)."""
    words, hashes = word_hashes(texts, lower=True)
    n = len(words) - 1
    bounds = words + np.arange(n + 1)
    out = np.zeros(int(bounds[-1]), np.int64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = np.maximum((hashes >> np.uint64(1)).view(np.int64), 1)
    return bounds, out


def dealt(part: np.ndarray, *arrays: np.ndarray):
    """(part, arrays) for each part; the arrays' order is kept."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(part[a]), [x[order[a:b]] for x in arrays]


class Model:
    """The files of a model, for the workers."""

    def __init__(self, folder: str, parts: int, offsets: list[int]):
        self.parts, self.folder, self.offsets = parts, folder, np.array(offsets, np.int64)
        self.size = int(self.offsets[-1])
        self.vocabulary = [map_file(f"{folder}/words-{k}") for k in range(parts)]
        self.pairs: dict[int, list[np.ndarray]] = {}
        self.tables: list[list[np.ndarray]] | None = None

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of tokens."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        part = word_part(distinct, self.parts)
        edges = np.searchsorted(part, np.arange(self.parts + 1))
        for k in range(self.parts):
            own = slice(edges[k], edges[k + 1])
            known, n = self.vocabulary[k]
            if len(known) and own.stop > own.start:
                at = np.minimum(np.searchsorted(known, distinct[own]), len(known) - 1)
                same = known[at] == distinct[own]
                ids[own], counts[own] = np.where(same, at + self.offsets[k], -1), np.where(same, n[at], 0)
        return ids[back], counts[back]

    def pair_counts(self, before: np.ndarray, after: np.ndarray, times: np.ndarray, parts: int) -> np.ndarray:
        """Counts of pairs; ``times`` are the occurrences of the contexts."""
        out = np.zeros(len(before), np.int64)
        keys = (before << 32) | after
        for k, (own, key) in dealt(pair_part(before, after, times, parts), np.arange(len(before)), keys):
            if k not in self.pairs:
                path = f"{self.folder}/pairs-{k}"
                self.pairs[k] = map_file(path) if os.path.exists(path) else [np.zeros(0, np.int64)] * 4
            known, small, rare, large = self.pairs[k]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = np.where(known[at] == key, small[at], 0).astype(np.int64)
            full = np.flatnonzero(found == 255)
            found[full] = large[np.searchsorted(rare, at[full])]
            out[own] = found
        return out

    def by_id(self, ids: np.ndarray, column: int) -> np.ndarray:
        if self.tables is None:
            self.tables = [map_file(f"{self.folder}/ids-{k}") for k in range(self.size // IDS_PER_PART + 1)]
        out = np.zeros(len(ids), np.int64)
        for k, (own, which) in dealt(ids // IDS_PER_PART, np.arange(len(ids)), ids % IDS_PER_PART):
            out[own] = self.tables[k][column][which]
        return out


def word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of the vocabulary; never decreases with the hash, so ids follow the hashes' order over all parts."""
    return ((hashes >> 31) * parts) >> 32


def pair_part(before: np.ndarray, after: np.ndarray, times: np.ndarray, parts: int) -> np.ndarray:
    spread = 1 + times // PAIRS_PER_PART
    return ((mix(before.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) + (mix(after.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) % spread) % parts


def merged_parts(batches):
    """(part, distinct keys, sums...) from batches of blocks ordered by part."""
    part, held, rows = None, [], 0
    for batch in batches:
        for k, block in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist()):
            if k != part and held:
                yield part, summed(*[np.concatenate(c) for c in zip(*held)])
                held, rows = [], 0
            part = k
            held.append(unsqueeze(block))
            rows += len(held[-1][0])
            if rows > MERGE_ROWS:
                held = [summed(*[np.concatenate(c) for c in zip(*held)])]
                rows = len(held[0][0]) - MERGE_ROWS // 2
    if held:
        yield part, summed(*[np.concatenate(c) for c in zip(*held)])


def blocks(rows):
    import pyarrow as pa

    for part, arrays in rows:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([squeeze(*arrays)], pa.binary())], names=["part", "payload"])


def discounts(counts: list[int]) -> list[float]:
    """Discounts for counts of 0, 1, 2 and 3 or more from the numbers of items seen once to four times (Chen and Goodman)."""
    n1, n2, n3, n4 = (max(1, c) for c in counts)
    y = n1 / (n1 + 2 * n2)
    return [0.0, *[min(max(k - (k + 1) * y * more / less, 0.0), float(k)) for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]]


def train(docs: DataFrame) -> dict:
    """Count a model from doc texts; returns its folder and its few totals.  An empty table gives an empty model."""
    spark = docs.sparkSession
    folder = mounted_dir(spark, "kneser-ney")
    rows = in_small_batches(docs).select(text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // VOCABULARY_BYTES

    def words(batches):
        for batch in slices(batches, size_bytes=SLICE):
            distinct, counts = np.unique(tokens_of(batch.column("text"))[1], return_counts=True)
            yield from blocks(dealt(word_part(distinct, parts), distinct, counts))

    def write_words(batches):
        import pyarrow as pa

        out = [(part, len(keys), int(counts.sum())) for part, (keys, counts) in merged_parts(batches) if not write_file(f"{folder}/words-{part}", keys, counts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["part", "words", "tokens"])

    def in_parts(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(int(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part")

    found = {r["part"]: r for r in in_parts(rows.mapInArrow(words, BLOCK), parts).mapInArrow(write_words, "part long, words long, tokens long").toLocalIterator()}
    for k in range(parts):
        if k not in found:
            write_file(f"{folder}/words-{k}", np.zeros(0, np.int64), np.zeros(0, np.int64))
    offsets = [0]
    for k in range(parts):
        offsets.append(offsets[-1] + (found[k]["words"] if k in found else 0))
    tokens, vocabulary = sum(r["tokens"] for r in found.values()), offsets[-1]
    pair_parts = 1 + tokens // PAIRS_PER_PART
    state = {"folder": folder, "parts": parts, "offsets": offsets, "pair_parts": pair_parts, "tokens": tokens, "vocabulary": vocabulary}

    def pairs(batches):
        model = loaded(state)
        for batch in slices(batches, size_bytes=SLICE):
            bounds, hashes = tokens_of(batch.column("text"))
            ids, counts = model.ids(hashes)
            before, times = contexts(ids, counts, bounds, vocabulary)
            key, first, n = np.unique((before << 32) | ids, return_index=True, return_counts=True)
            yield from blocks(dealt(pair_part(before[first], ids[first], times[first], pair_parts), key, n))

    def write_pairs(batches):
        """Writes the parts; passes on, by ranges of ids: per context its occurrences and pairs seen once, twice, more often, and per word its contexts."""
        import pyarrow as pa

        for part, (keys, counts) in merged_parts(batches):
            large = np.flatnonzero(counts >= 255)
            write_file(f"{folder}/pairs-{part}", keys, np.minimum(counts, 255).astype("u1"), large, counts[large])
            ones = [(counts == c).astype(np.int64) for c in (1, 2)] + [(counts >= 3).astype(np.int64)]
            by_context = summed(keys >> 32, counts, *ones)
            by_word = summed(keys & 0xFFFFFFFF, np.ones(len(keys), np.int64))
            none = [np.zeros(len(by_word[0]), np.int64)] * 4
            ids = np.concatenate([by_context[0], by_word[0]])
            columns = [np.concatenate(x) for x in zip([*by_context[1:], np.zeros(len(by_context[0]), np.int64)], [*none, by_word[1]])]
            sums = summed(ids, *columns)
            for k, arrays in dealt(sums[0] // IDS_PER_PART, *sums):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([squeeze(*arrays)], pa.binary()), *[pa.array([int((counts == c).sum()) if k == sums[0][0] // IDS_PER_PART else 0]) for c in (1, 2, 3, 4)]],
                    names=["part", "payload", "c1", "c2", "c3", "c4"],
                )

    def write_ids(batches):
        import pyarrow as pa

        out = []
        for part, (ids, *columns) in merged_parts(batches):
            dense = [np.zeros(min(IDS_PER_PART, vocabulary + 1 - part * IDS_PER_PART), np.int64) for _ in columns]
            for d, c in zip(dense, columns):
                d[ids - part * IDS_PER_PART] = c
            write_file(f"{folder}/ids-{part}", *[d.astype("<u4") if d.max(initial=0) < 1 << 32 else d for d in dense])
            out.append((part, int(columns[-1].sum()), *[int((columns[-1] == c).sum()) for c in (1, 2, 3, 4)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["part", "types", "c1", "c2", "c3", "c4"])

    # The blocks by id are stored: the totals of the pairs and the tables by id both come from them.

    by_id = stage(in_parts(rows.mapInArrow(pairs, BLOCK), pair_parts).mapInArrow(write_pairs, BLOCK + ", c1 long, c2 long, c3 long, c4 long"))
    seen = by_id.agg(*[F.coalesce(F.sum(f"c{c}"), F.lit(0)).alias(f"c{c}") for c in (1, 2, 3, 4)]).first()
    tables = in_parts(by_id.select("part", "payload"), vocabulary // IDS_PER_PART + 1).mapInArrow(write_ids, "part long, types long, c1 long, c2 long, c3 long, c4 long")
    totals = tables.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "c1", "c2", "c3", "c4")]).first()
    return state | {
        "pair_discounts": discounts([seen[f"c{c}"] for c in (1, 2, 3, 4)]),
        "word_discounts": discounts([totals[f"c{c}"] for c in (1, 2, 3, 4)]),
        "types": totals["types"],
        "seen": [totals["c1"], totals["c2"], vocabulary - totals["c1"] - totals["c2"]],
    }


def loaded(state: dict) -> Model:
    return kept(f"kneser-ney {state['folder']}", lambda: Model(state["folder"], state["parts"], state["offsets"]))


def contexts(ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Id of what stands before each token (``begin`` at the start of a text) and how often the training text has it."""
    before, times = np.empty_like(ids), np.empty_like(counts)
    before[1:], times[1:] = ids[:-1], counts[:-1]
    before[bounds[:-1]], times[bounds[:-1]] = begin, np.iinfo(np.int64).max // 2
    return before, times


def token_probabilities(model: Model, state: dict, ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability of each token after the one before it."""
    size = state["vocabulary"]
    d, types = np.array(state["word_discounts"]), max(1, state["types"])
    left = sum(x * n for x, n in zip(d[1:], state["seen"])) / types if state["types"] else 1.0
    known = ids >= 0
    follows = np.zeros(len(ids), np.int64)
    follows[known] = model.by_id(ids[known], 4)
    lower = (follows - d[np.minimum(follows, 3)]) / types + left / (size + 1)
    before, times = contexts(ids, counts, bounds, size)
    out = lower.copy()
    usable = np.flatnonzero(before >= 0)
    total = np.zeros(len(ids), np.int64)
    total[usable] = model.by_id(before[usable], 0)
    usable = usable[total[usable] > 0]
    where = before[usable]
    e = np.array(state["pair_discounts"])
    mass = sum(e[k] * model.by_id(where, k) for k in (1, 2, 3)) / total[usable]
    pair = np.zeros(len(usable), np.int64)
    both = known[usable]
    key, first, back = np.unique((where[both] << 32) | ids[usable][both], return_index=True, return_inverse=True)
    if len(key):
        pair[both] = model.pair_counts(key >> 32, key & 0xFFFFFFFF, times[usable][both][first], state["pair_parts"])[back]
    out[usable] = (pair - e[np.minimum(pair, 3)]) / total[usable] + mass * lower[usable]
    return out


def held_out():
    """Documents whose id, as text, has a checksum divisible by 10 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, state: dict) -> DataFrame:
    """Scores of every text under a trained model (``SCHEMA``)."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    tokens, size = state["tokens"], state["vocabulary"]

    def scores(batches):
        import pyarrow as pa

        model = loaded(state)
        for batch in slices(batches, size_bytes=SLICE):
            bounds, hashes = tokens_of(batch.column("text"))
            ids, counts = model.ids(hashes)
            base = np.log10((counts + 0.1) / (tokens + 0.1 * (size + 1)))
            full = np.log10(token_probabilities(model, state, ids, counts, bounds)) if size else np.zeros(len(ids))
            columns = [np.diff(bounds), np.add.reduceat((counts > 0).astype(np.int64), bounds[:-1]), np.full(batch.num_rows, tokens), np.add.reduceat(base, bounds[:-1]), np.add.reduceat(full, bounds[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in columns]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(scores, SCHEMA)


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all (``SCHEMA``).

    A null text counts as empty: its only token is the end.  Repeated rows count and are scored as often as they
    come; an empty table gives no rows; other columns are left out.  Words never seen get the share that the lowest
    level leaves to one more word, so every score is finite; with no training text at all every score is 0.
    """
    return score(docs, train(docs.where(~held_out())))
