"""SentencePiece BPE in vectorised merge rounds, and decoding.

All words of a slice of texts lie in one flat array of symbols.  A round finds the best pair of every word (segmented
minimum of the ranks of its neighbouring pairs), merges all its places at once, leftmost first where they overlap,
closes the gaps, and looks up the ranks beside the merged places only.  Words without a pair leave the arrays.  The
library merges one pair at a time, the best first and the leftmost of equals; the same comes out, since a merge cannot
change what is left of an equal pair, unless the merged piece opens a pair at least as good as itself.  Such pieces are
known from the model, and a word that makes one makes only its leftmost merge in that round.

A piece never goes over the start of a word (a blank after something else) or over a character that no longer piece
has, so the words of a text are independent and each distinct one is merged once per slice.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import kept, text_or_empty
from candlework.llm.shingles import text_bytes

MARK = "▁"
NONE = np.iinfo(np.int64).max
#: Longer words are cut between characters that are neighbours in no piece; what is longer still goes by an agenda.
WORD_CHARS, ROUND_CHARS = 64, 2048
SLICE_BYTES = 4 << 20
CODE_POINTS = 0x110000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Tables of a BPE model with byte fallback: symbols of characters, ranks of pairs, bytes of pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        pieces = {s: i for i, s in enumerate(names) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(lib.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        if any(a != MARK and b == MARK for s in pieces for a, b in zip(s, s[1:])):
            raise ValueError("the model has pieces that go over the start of a word")
        self.n, self.bos, self.eos = n, lib.bos_id(), lib.eos_id()
        # A character is its piece, or n + its code point where it has none.
        self.symbol_of = np.arange(n, n + CODE_POINTS, dtype=np.int64)
        for s, i in pieces.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        symbol = pieces | {c: n + ord(c) for s in pieces for c in s if c not in pieces}
        ids = np.array([*pieces.values()], np.int64)
        place = np.unique([-lib.get_score(int(i)) for i in ids], return_inverse=True)[1]
        rank_of = np.full(n, NONE)
        rank_of[ids] = place
        pairs = [(symbol[s[:k]], symbol[s[k:]], i) for s, i in pieces.items() for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol]
        left, right, into = (np.array(c, np.int64) for c in zip(*pairs))
        order = np.argsort(left * (n + CODE_POINTS) + right)
        self.keys = (left * (n + CODE_POINTS) + right)[order]
        self.into, self.rank = into[order], rank_of[into[order]]
        self.opens = np.zeros(n, bool)
        for part in (left, right):
            known = part < n
            better = rank_of[into[known]] <= rank_of[part[known]]
            self.opens[part[known][better]] = True
        near = np.unique([ord(a) * CODE_POINTS + ord(b) for s in pieces for a, b in zip(s, s[1:])])
        self.near = near
        joined = {c for s in pieces if len(s) > 1 for c in s}
        self.lone = np.array([chr(b) not in joined and b != 32 for b in range(128)] + [False] * 128)
        self.bytes_of = np.array([s.replace(MARK, " ").encode() if s in pieces else b"" for s in names], object)
        self.bytes_of[self.byte_ids] = [bytes([b]) for b in range(256)]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every pair, and the piece that it makes."""
        key = left * (self.n + CODE_POINTS) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.into[at]

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their words; ``word`` numbers the words and ascends."""
        size = len(symbols)
        rank, into = np.full(size, NONE), np.zeros(size, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], into[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        words = int(word[-1]) + 1 if size else 0
        out = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                over = np.repeat(done, lengths)
                out.append((symbols[over], word[over]))
                symbols, word, rank, into = symbols[~over], word[~over], rank[~over], into[~over]
                best, lengths = best[~done], lengths[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            # Of places that overlap in a row, every second one, from the left.
            number = np.arange(len(at))
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            opens = self.opens[into[at]]
            if opens.any():
                own = word[at]
                single = np.zeros(words, bool)
                single[own[opens]] = True
                at = at[np.concatenate([[True], own[1:] != own[:-1]]) | ~single[own]]
            symbols[at] = into[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word, rank, into = symbols[stay], word[stay], rank[stay], into[stay]
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], into[touched] = self.pairs(symbols[touched], symbols[touched + 1])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, word = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merge_by_agenda(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: pairs in the order of rank and place, from a heap."""
        now, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, into = self.pairs(symbols[:-1], symbols[1:])
        some = np.flatnonzero(rank != NONE)
        agenda = list(zip(rank[some].tolist(), some.tolist(), symbols[some].tolist(), symbols[some + 1].tolist(), into[some].tolist()))
        heapq.heapify(agenda)
        table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.into.tolist())))
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if now[i] != left or j >= n or now[j] != right:
                continue
            now[i], now[j] = piece, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    found = table.get(now[a] * (self.n + CODE_POINTS) + now[b])
                    if found:
                        heapq.heappush(agenda, (found[0], a, now[a], now[b], found[1]))
        return np.array([s for s in now if s >= 0], np.int64)

    def fallback(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: characters without a piece become the ids of their bytes."""
        if not (symbols >= self.n).any():
            return symbols, word
        point = np.maximum(symbols - self.n, 0)
        size = np.where(symbols < self.n, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        first = np.cumsum(size) - size
        out = np.repeat(symbols, size)
        for j in range(4):
            some = np.flatnonzero((symbols >= self.n) & (size > j))
            bits = point[some] >> (6 * (size[some] - 1 - j))
            byte = np.where(size[some] == 1, bits, np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[some]] | bits) if j == 0 else 0x80 | (bits & 0x3F)
            out[first[some] + j] = self.byte_ids[byte]
        return out, np.repeat(word, size)

    def encode_words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word (Arrow strings, with blanks for marks), and all ids."""
        raw, bounds = text_bytes(words)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds])
        chars[chars == 32] = ord(MARK)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        cut = np.ones(len(chars), bool)
        cut[1:] = owner[1:] != owner[:-1]
        inside = np.flatnonzero((lengths > WORD_CHARS)[owner] & ~cut)
        if len(inside):
            key = chars[inside - 1] * CODE_POINTS + chars[inside]
            cut[inside] = self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] != key
        part = np.cumsum(cut) - 1
        symbols = self.symbol_of[chars]
        sizes = np.bincount(part) if len(part) else np.zeros(0, np.int64)
        long = np.flatnonzero(sizes > ROUND_CHARS)
        starts = np.flatnonzero(cut)
        short = ~np.isin(part, long) if len(long) else slice(None)
        merged, parts = self.merge_rounds(symbols[short], part[short])
        if len(long):
            own = [self.merge_by_agenda(symbols[starts[k] : starts[k] + sizes[k]]) for k in long.tolist()]
            merged = np.concatenate([merged, *own])
            parts = np.concatenate([parts, np.repeat(long, [len(x) for x in own])])
            order = np.argsort(parts, kind="stable")
            merged, parts = merged[order], parts[order]
        ids, parts = self.fallback(merged, parts)
        return np.bincount(owner[starts][parts], minlength=len(lengths)), ids

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text in the ids, and the ids, without begin and end; ``texts`` are Arrow strings, no nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        raw, bounds = text_bytes(texts)
        if not len(raw):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        opens = np.zeros(len(raw) + 1, bool)
        opens[bounds[:-1]] = True
        blank, lone = raw == 32, self.lone[raw]
        start = opens[:-1] | lone
        start[1:] |= blank[1:] & ~blank[:-1] | lone[:-1]
        where = np.flatnonzero(start)
        words = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(np.append(where, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        told = words.dictionary_encode()
        counts, ids = self.encode_words(told.dictionary)
        codes = told.indices.to_numpy()
        first, n = np.cumsum(counts) - counts, counts[codes]
        total = np.cumsum(n)
        pick = np.repeat(first[codes] - total + n, n) + np.arange(int(total[-1]))
        return np.concatenate([[0], total])[np.searchsorted(where, bounds)], ids[pick]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids that came from a text: pieces joined, begin and end left out, without the mark put in front."""
        return b"".join(self.bytes_of[ids].tolist()).removeprefix(b" ")


def model(path: str) -> PieceModel:
    """The worker process's model."""
    return kept(f"pieces {path}", lambda: PieceModel(path))


def encode_documents(docs: DataFrame, path: str, *, keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text with begin and end, and digests of ids and of the decoded text (``SCHEMA``).

    One row comes out per row that goes in: a null text counts as empty (begin and end only), rows without an id
    keep their null, repeated rows give repeated results, an empty table gives none; other columns are left out.
    ``keep_ids`` adds ``ids`` (array<int>).  Nothing is shuffled; memory goes with 4 MB of text, or one longer text.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def rows(batches):
        import pyarrow as pa

        own = model(path)
        for batch in slices(batches, size_bytes=SLICE_BYTES):
            bounds, ids = own.encode(batch.column("text"))
            raw, found = ids.astype("<u4").tobytes(), []
            head, tail = (np.array([x], "<u4").tobytes() for x in (own.bos, own.eos))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                row = (b - a + 2, hashlib.sha256(head + raw[4 * a : 4 * b] + tail).hexdigest(), hashlib.sha256(own.decode(ids[a:b])).hexdigest())
                found.append(row + (([own.bos, *ids[a:b].tolist(), own.eos],) if keep_ids else ()))
            columns = [pa.array(c) for c in zip(*found)]
            if keep_ids:
                columns[3] = columns[3].cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(rows, schema)
