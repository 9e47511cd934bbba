"""BPE encoding by tree concatenation, and decoding.

A long text is halved until its pieces are short; the pieces are encoded on their own and joined pairwise.  At each
join a window of tokens around the cut is encoded again and grows until its first token is one the left side has at
the same place and its last token one the right side has at the same place.  A BPE encoding is settled by its
neighbouring token pairs: left of the shared token every pair was made with its context on the left, right of it
with its context in the window.  So the joined sequence equals the encoding of the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import in_small_batches, kept, text_or_empty

#: Characters of a leaf, and of a piece that is a row of its own so that other tasks can encode it.
LEAF_CHARS = 4096
PIECE_CHARS = 65536
#: Parts of words that a worker remembers, twice.
PARTS_KEPT = 120_000
#: Bytes of text that are encoded at once, and those that other work takes at once.
ENCODED_BYTES = 4 << 20
SLICE_BYTES = 2 << 20

IDS_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordEncoder:
    """Encodes texts through their distinct words, each handed to the library once per slice of texts.

    Plain words (letters of Latin-1, then ASCII symbols) need no normalisation but case, and fall into the same two
    parts by either public pattern, so the library's merge model is given the distinct parts, and places follow from
    the lengths of the tokens.  All other words go through the library's whole chain.
    """

    PLAIN = r"^(?P<stem> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, tokenizer, lower: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.lower = tokenizer, lower
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merges = Tokenizer(tokenizer.model)  # the merge model alone, over parts between blanks
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.blank, self.hidden = as_char[32], [(chr(b), as_char[b]) for b in (*range(128, 161), 173)]
        n = tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(tokenizer.id_to_token(i).removesuffix("</w>")) for i in range(n)], np.int64)

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each part (letters or symbols, no blank but one in front), and all their ids.

        Parts are remembered in two generations of bounded size; what is asked for again moves to the younger one.
        """
        young, old = self.young, self.old
        got = list(map(young.get, texts))
        missing = [k for k, g in enumerate(got) if g is None]
        if old:
            for k in missing:
                got[k] = old.get(texts[k])
        fresh = [k for k in missing if got[k] is None]
        if fresh:
            counts, ids = self.new_parts([texts[k] for k in fresh])
            raw, a = ids.tobytes(), 0
            for k, b in zip(fresh, (4 * np.cumsum(counts)).tolist()):
                got[k], a = raw[a:b], b
        young.update((texts[k], got[k]) for k in missing)
        if len(young) > PARTS_KEPT:
            self.young, self.old = {}, young
        return np.fromiter(map(len, got), np.int64, len(got)) >> 2, np.frombuffer(b"".join(got), "<u4")

    def new_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(texts).lower() if self.lower else " ".join(texts)
        joined = joined.encode().decode("latin-1")
        for char, seen in self.hidden:
            joined = joined.replace(char, seen)
        if not self.lower:  # a second blank is the part's own
            joined = joined.replace("  ", " " + self.blank)
            joined = self.blank + joined[1:] if joined[:1] == " " else joined
        got = self.merges.encode(joined, add_special_tokens=False)
        return np.bincount(np.array(got.word_ids, np.int64), minlength=len(texts)), np.array(got.ids, "<u4")

    def direct(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and one-past-last characters, by the library's whole chain."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(got.offsets, np.int64).reshape(-1, 2)
        return np.array(got.ids, "<u4"), spans[:, 0], spans[:, 1]

    def encode(self, words, spans: bool):
        """Number of tokens of each of the distinct words (Arrow strings), all their ids, and their places in the words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.extract_regex(words, self.PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        found = found.filter(pa.array(plain))
        stems, tails = found.field("stem").dictionary_encode(), found.field("tail").dictionary_encode()
        stem_list, tail_list = stems.dictionary.to_pylist(), tails.dictionary.to_pylist()
        odd = [self.direct(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        # Parts: stems, tails, odd words, and an empty one; a word is a stem and a tail, or an odd word and nothing.
        stem_n, stem_ids = self.parts(stem_list)
        tail_got = [self.parts([t]) if t else (np.zeros(1, np.int64), np.zeros(0, "<u4")) for t in tail_list]
        counts = np.concatenate([stem_n, *[n for n, _ in tail_got], [len(x[0]) for x in odd], [0]]).astype(np.int64)
        ids = np.concatenate([stem_ids, *[i for _, i in tail_got], *[x[0] for x in odd]])
        pair = np.empty((len(plain), 2), np.int64)
        pair[plain, 0] = stems.indices.to_numpy()
        pair[plain, 1] = tails.indices.to_numpy() + len(stem_list)
        pair[~plain, 0] = np.arange(len(odd)) + len(stem_list) + len(tail_list)
        pair[~plain, 1] = len(counts) - 1
        first, n = np.cumsum(counts) - counts, counts[pair.ravel()]
        pick = np.repeat(first[pair.ravel()] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        per_word = n.reshape(-1, 2).sum(1)
        if not spans:
            return per_word, ids[pick], None, None
        texts = stem_list + tail_list
        known = int(counts[: len(texts)].sum())
        own = self.bytes_of[ids[:known]]
        ends = np.cumsum(own)
        char = np.cumsum((np.frombuffer("".join(texts).encode(), np.uint8) & 0xC0) != 0x80) - 1
        length = np.array([len(t) for t in texts], np.int64)
        before = np.repeat(np.cumsum(length) - length, counts[: len(texts)])
        starts = np.concatenate([char[ends - own] - before, *[x[1] for x in odd]])
        stops = np.concatenate([char[ends - 1] + 1 - before, *[x[2] for x in odd]])
        shift = np.zeros((len(plain), 2), np.int64)
        shift[plain, 1] = length[pair[plain, 0]]
        shift = np.repeat(shift.ravel(), n)
        return per_word, ids[pick], starts[pick] + shift, stops[pick] + shift

    def encode_texts(self, texts, blanks: bool, spans: bool = True):
        """Bounds of each text in the token arrays; ids, and starts and ends in characters of their texts.

        ``texts`` is an Arrow array of strings.  Words are found and told apart in whole columns.
        """
        words, codes, per_text, places = split_words(texts, blanks, spans)
        if not len(words):
            none = np.zeros(0, np.int64)
            return np.zeros(len(texts) + 1, np.int64), none.astype("<u4"), none, none
        counts, ids, starts, ends = self.encode(words, spans)
        first, n = np.cumsum(counts) - counts, counts[codes]
        total = np.cumsum(n)
        pick = (np.repeat(first[codes] - total + n, n) + np.arange(int(total[-1]))).astype(np.int32)
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per_text)])]
        if not spans:
            return bounds, ids[pick], None, None
        base = np.repeat(places, n)
        return bounds, ids[pick], starts[pick] + base, ends[pick] + base


def slices(batches, *columns: str, size_bytes: int = SLICE_BYTES):
    """Record batches cut so that their columns of text have about ``size_bytes`` each, or one row."""
    for batch in batches:
        sizes = [np.frombuffer(c.buffers()[1], np.int32)[c.offset :][: batch.num_rows + 1].astype(np.int64) for c in map(batch.column, columns or ("text",))]
        size = sum(sizes)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, size[a] + size_bytes, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
        give_back()


def give_back() -> None:
    """Return freed memory to the system; a worker lives on and would keep the largest it ever had."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


BLANK = np.isin(np.arange(256), [32, 9, 10, 13])


def split_words(texts, blanks: bool, places: bool):
    """Distinct words; of each word in the texts its code and first character; words per text.

    Without ``blanks`` a word is a run without blank, tab or line end.  With ``blanks`` nothing is left out: a word
    starts at a blank between visible characters, and at and after a line end between visible characters.
    """
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    opens = np.zeros(len(raw) + 1, bool)
    opens[bounds[:-1]] = True
    opens = opens[:-1]
    if blanks:
        visible = (raw > 32) & (raw < 127)
        latin = np.zeros(len(raw), bool)
        latin[1:] = raw[:-1] == 0xC3
        shown_before = np.concatenate([[False], (visible | latin)[:-1]]) & ~opens
        shown_after = np.concatenate([(visible | (raw == 0xC3))[1:], [False]]) & ~np.concatenate([opens[1:], [True]])
        alone = shown_before & shown_after
        line = alone & (raw == 10)
        start = opens | alone & (raw == 32) | line | np.concatenate([[False], line[:-1]])
        where, kept = np.flatnonzero(start), raw
        offsets = np.append(where, len(raw))
    else:
        blank = BLANK[raw]
        start = ~blank & (opens | np.concatenate([[True], blank[:-1]]))
        where, kept = np.flatnonzero(start), raw[~blank]
        offsets = np.append(np.cumsum(~blank, dtype=np.int32)[where] - 1, len(kept))
    words = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept)))
    told = words.dictionary_encode()
    per_text = np.diff(np.searchsorted(where, bounds))
    if not places:
        return told.dictionary, told.indices.to_numpy(), per_text, None
    char = np.cumsum((raw & 0xC0) != 0x80)
    before = np.concatenate([[0], char])[bounds[:-1]]
    return told.dictionary, told.indices.to_numpy(), per_text, char[where] - 1 - np.repeat(before, per_text)


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """The word-level BPE: white space of ASCII splits words before any merge and is dropped."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.words = WordEncoder(self.tokenizer, lower=True)
        self.pieces: np.ndarray | None = None
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def join(self, text: str, base: int, left, right, end: int):
        """Join two encodings that meet; ``text`` begins at ``base`` and ``right`` ends at ``end``."""
        (lid, lst), (rid, rst) = left, right
        if not len(lid) or not len(rid):
            return np.concatenate([lid, rid]), np.concatenate([lst, rst])
        k = 2
        while True:
            i, j = max(0, len(lid) - k), min(k, len(rid))
            while i and lst[i] == lst[i - 1]:  # part of a character
                i -= 1
            while j < len(rid) and rst[j] == rst[j - 1]:
                j += 1
            a, b = int(lst[i]), int(rst[j]) if j < len(rid) else end
            wid, wst, _ = self.words.direct(text[a - base : b - base])
            wst = wst + a
            same_left = i == 0 or (len(wid) and wid[0] == lid[i] and wst[0] == lst[i])
            same_right = j == len(rid) or (len(wid) and wid[-1] == rid[j - 1] and wst[-1] == rst[j - 1])
            if same_left and same_right:
                return np.concatenate([lid[:i], wid, rid[j:]]), np.concatenate([lst[:i], wst, rst[j:]])
            k *= 2

    def trees(self, texts: list[str], places: list[int], leaf_chars: int = LEAF_CHARS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and start characters of texts that begin at the given characters of their documents.

        The leaves of all the texts are encoded together, then each text is folded.
        """
        import pyarrow as pa

        marks = [cuts(t, leaf_chars, self.special) for t in texts]
        leaves = [t[a:b] for t, mark in zip(texts, marks) for a, b in zip(mark, mark[1:])]
        bounds, ids, starts, _ = self.words.encode_texts(pa.array(leaves, pa.large_string()), blanks=False)
        out, k = [], 0
        for text, at, mark in zip(texts, places, marks):
            parts = []
            for a, b in zip(mark, mark[1:]):
                own = slice(bounds[k], bounds[k + 1])
                parts.append((a, b, (ids[own], starts[own] + (at + a))))
                k += 1
            out.append(self.fold(text, at, parts))
        return out

    def fold(self, text: str, at: int, parts):
        """Join neighbouring parts level by level; a part is (start, end, encoding) within ``text``."""
        while len(parts) > 1:
            parts = [
                (p[0][0], p[1][1], self.join(text, at, p[0][2], p[1][2], at + p[1][1])) if len(p) == 2 else p[0]
                for p in (parts[k : k + 2] for k in range(0, len(parts), 2))
            ]
        return parts[0][2]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` gives; by table where the file names no decoder."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        if self.pieces is None:
            n = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.pieces = np.array([self.tokenizer.id_to_token(i) for i in range(n)], object)
        return " ".join(self.pieces[ids].tolist())


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def cut_allowed(c: str) -> bool:
    """Whether a text may be cut before ``c`` without changing its composed form."""
    return c.isascii() or not (unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF or 0xD7B0 <= ord(c) <= 0xD7FF)


def cuts(text: str, size: int, special: re.Pattern) -> list[int]:
    """Offsets of the pieces of a text: it is halved until pieces have at most about ``size`` characters.

    A cut never falls into a match of ``special`` or in front of a character that composes with the one before.
    """
    out, whole = [0], [m.span() for m in special.finditer(text)] if len(text) > size else []

    def halve(a: int, b: int) -> None:
        m = (a + b) // 2
        k = bisect.bisect(whole, (m,)) - 1
        if k >= 0 and m < whole[k][1]:
            m = whole[k][1]
        while m < b and not cut_allowed(text[m]):
            m += 1
        if b - a > size and a < m < b:
            halve(a, m)
            halve(m, b)
        else:
            out.append(b)

    if text:
        halve(0, len(text))
    else:
        out.append(0)
    return out


def encode_documents(docs: DataFrame, path: str, *, leaf_chars: int = LEAF_CHARS, piece_chars: int = PIECE_CHARS, keep_ids: bool = False) -> DataFrame:
    """Ids of every text by tree concatenation, with digests of ids and decoded text (``IDS_SCHEMA``).

    One row comes out per row that goes in; a null text counts as empty (0 tokens), repeated rows give repeated
    results, other columns are left out.  ``keep_ids`` adds ``ids`` (array<int>).

    Texts above ``piece_chars`` become rows of pieces, which other tasks encode; only those are shuffled, and a group
    is one document.
    """
    schema = IDS_SCHEMA + (", ids array<int>" if keep_ids else "")
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    short = rows.where(F.length("text") <= piece_chars)
    long = rows.where(F.length("text") > piece_chars)

    fields = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def finish(own, arrays) -> list[tuple]:
        out = []
        for ids in arrays:
            text = own.decode(ids)
            row = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            out.append(row + ((ids.astype("i4"),) if keep_ids else ()))
        return out

    def whole(batches):
        import pyarrow as pa

        own = encoder(path)
        for batch in slices(batches, size_bytes=ENCODED_BYTES):
            texts = batch.column("text").to_pylist()
            rows = finish(own, [g[0] for g in own.trees(texts, [0] * len(texts), leaf_chars)])
            columns = [pa.array(list(c)) for c in zip(*rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *fields])

    def pieces(batches):
        special = encoder(path).special
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                mark, name = cuts(text, piece_chars, special), hashlib.md5(text.encode()).hexdigest()
                yield pd.DataFrame({"doc_id": doc_id, "name": name, "piece": range(len(mark) - 1), "at": mark[:-1], "text": [text[a:b] for a, b in zip(mark, mark[1:])]})

    def encoded(batches):
        own = encoder(path)
        for pdf in batches:
            got = own.trees(list(pdf["text"]), list(pdf["at"]), leaf_chars)
            yield pdf.assign(ids=[i.tobytes() for i, _ in got], starts=[s.tobytes() for _, s in got])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        own = encoder(path)
        copies = int((pdf["piece"] == 0).sum())
        pdf = pdf.drop_duplicates("piece").sort_values("piece")
        text = "".join(pdf["text"])
        parts = [(a, a + len(t), (np.frombuffer(i, "<u4"), np.frombuffer(s, "<i8"))) for a, t, i, s in zip(pdf["at"], pdf["text"], pdf["ids"], pdf["starts"])]
        out = pd.DataFrame(finish(own, [own.fold(text, 0, parts)[0]]) * copies, columns=fields)
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out

    piece = "doc_id string, name string, piece int, at long, text string"
    dealt = long.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(pieces, piece).repartition("doc_id", "name", "piece")
    spread = dealt.mapInPandas(encoded, piece + ", ids binary, starts binary")
    grouped = spread.groupBy("doc_id", "name").applyInPandas(joined, schema.replace("doc_id long", "doc_id string"))
    return short.mapInArrow(whole, schema).unionByName(grouped.withColumn("doc_id", F.col("doc_id").cast("long")))
