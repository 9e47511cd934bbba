"""Concatenated token ids on disk with Elias-Fano coded document boundaries.

A block is one self-contained byte string::

    b"TOKF" | version u4 | first document's start u8 | n documents u4 | n ids u8 | low bits u4 | n high words u4 | n samples u4
    | bytes of an id u4 | low parts, packed u8 bytes | high parts, unary in 64-bit words | select samples u4 | ids u2 or u4

The n + 1 boundaries of a block never decrease.  The low bits of each are packed; the rest is a unary string in which
the i-th one stands at (boundary >> low) + i.  That takes about 2 + log2(ids / documents) bits a document.  Every
``SAMPLE``-th one's place is kept, so ``select`` reads a bounded part of the string.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlework.llm.bpe import ENCODED_BYTES, encoder, give_back, slices
from candlework.llm.common import in_small_batches, text_or_empty
from candlework.operators.staging import staging_dir

MAGIC, VERSION, SAMPLE = b"TOKF", 1, 256
HEAD = "<4sIQIQIIII"
#: Ids of a block at most, unless one document has more.
BLOCK_IDS = 2_000_000
END_ID = 2


class EliasFano:
    """Non-decreasing integers from 0 to ``top`` in near-minimal space."""

    def __init__(self, n: int, low: int, lows: bytes, high: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.high, self.samples = n, low, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8)
        places = (values >> low) + np.arange(n)
        unary = np.zeros((int(places[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").view("<u8"), places[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        """Low parts of the values from ``first`` to before ``last``."""
        if not self.low:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low, last * self.low
        raw = np.frombuffer(self.lows, np.uint8, (b + 7) // 8 - a // 8, a // 8)
        bits = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low)
        return bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        word = int(self.samples[i // SAMPLE]) // 64
        left = i - i // SAMPLE * SAMPLE
        skip = int(self.samples[i // SAMPLE]) % 64
        x = int(self.high[word]) >> skip << skip
        while (ones := x.bit_count()) <= left:
            left, word = left - ones, word + 1
            x = int(self.high[word])
        for _ in range(left):
            x &= x - 1
        place = word * 64 + (x & -x).bit_length() - 1
        return ((place - i) << self.low) | int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((places - np.arange(self.n)) << self.low) | self._lows(0, self.n)


def pack(start: int, ids: list[np.ndarray]) -> bytes:
    """A block of documents given as arrays of ids; ``start`` counts the ids before it."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    e = EliasFano.of(ends)
    body = np.concatenate(ids)
    width = 2 if not len(body) or int(body.max()) < 1 << 16 else 4
    head = struct.pack(HEAD, MAGIC, VERSION, start, len(ids), int(ends[-1]), e.low, len(e.high), len(e.samples), width)
    return b"".join([head, e.lows, e.high.tobytes(), e.samples.tobytes(), body.astype(f"<u{width}").tobytes()])


def unpack(block: bytes) -> tuple[int, EliasFano, np.ndarray]:
    """First start, boundaries and ids of a block."""
    magic, version, start, n, n_ids, low, high, samples, width = struct.unpack_from(HEAD, block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    view, at = memoryview(block), struct.calcsize(HEAD)
    lows = bytes(view[at : (at := at + ((n + 1) * low + 7) // 8)])
    words = np.frombuffer(bytes(view[at : (at := at + 8 * high)]), "<u8")
    picks = np.frombuffer(bytes(view[at : (at := at + 4 * samples)]), "<u4")
    if len(view) - at != width * n_ids:
        raise ValueError("a block of token ids is cut short")
    return start, EliasFano(n + 1, low, lows, words, picks), np.frombuffer(view[at:], f"<u{width}")


def write_token_files(docs: DataFrame, path: str, out: str | None = None, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Encode texts and write them as blocks in ascending doc_id order; returns the folder.

    A null text counts as empty (only the end id), a null doc_id sorts first, repeated rows are written as often as
    they come, an empty table gives no block, other columns are left out.  The rows are dealt by ranges of doc_id;
    a task counts and writes its own range, and starts follow from one count per task.  Blocks are binary values of
    a Parquet folder, so they are committed by Spark and reach any store that Spark writes to.
    """
    spark = docs.sparkSession
    out = out or f"{staging_dir(spark)}/token-files-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, part = encoder(path), TaskContext.get().partitionId()
        arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
        block, kept, doc_ids, size, before = 0, [], [], 0, 0

        def done():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_ids": size, "doc_ids": doc_ids, "payload": pack(before, kept)}], schema=arrow)

        for batch in slices(batches, size_bytes=ENCODED_BYTES):
            bounds, ids, _, _ = own.words.encode_texts(batch.column("text"), blanks=False, spans=False)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                if kept and size + b - a + 1 > block_ids:
                    yield done()
                    before, block, kept, doc_ids, size = before + size, block + 1, [], [], 0
                kept.append(np.append(ids[a:b], np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += b - a + 1
        if kept:
            yield done()

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(blocks, "part int, block int, n_ids long, doc_ids array<long>, payload binary").write.parquet(out)
    return out


def read_token_files(spark, out: str, checksums: bool = False) -> DataFrame:
    """Rows of doc_id, start, n_tokens and ids (binary) from a folder of blocks; with ``checksums``, ids_crc32 instead of ids."""
    files = spark.read.parquet(out)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                base, doc_ids, block = (batch.column(c)[k].as_py() for c in ("base", "doc_ids", "payload"))
                start, bounds, body = unpack(block)
                ends = bounds.all()
                ids = [body[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if checksums else pa.array(ids, pa.binary())
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(base + start + ends[:-1]), pa.array(np.diff(ends)), last]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32" if checksums else "ids"])
            give_back()

    joined = files.join(F.broadcast(base), "part")  # one row per file of the folder
    return joined.select("base", "doc_ids", "payload").mapInArrow(rows, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if checksums else "ids binary"))


def token_rows(spark, out: str) -> DataFrame:
    """Per document its place, length and the checksum of its ids, read back from the blocks."""
    return read_token_files(spark, out, checksums=True)
