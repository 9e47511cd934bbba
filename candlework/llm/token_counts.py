"""Token counts of the sections of a document from one encoding of the whole document.

A document is encoded once; its token spans are joined to the spans of its sections by their characters.  (Its pattern never merges across the blank before a word, so
encoding goes word by word; the spans are those of the whole text.)  Two rules
for tokens that cross a boundary are explicit: ``n_tokens`` gives a token to the section of its first character, so
counts of sections add up to the count of the document; ``n_shared`` is the exact share by characters.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import ENCODED_BYTES, WordEncoder, load_tokenizer, slices
from candlework.llm.common import in_small_batches, kept, text_or_empty

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, n_shared double"


def span_encoder(path: str) -> WordEncoder:
    tokenizer = load_tokenizer(path)
    tokenizer.encode_special_tokens = True
    return WordEncoder(tokenizer, lower=False)


def line_sections(text: str) -> np.ndarray:
    """Spans of the lines of a text, each with its line end; one empty span for an empty text."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([[0, *ends[:-1]], ends], np.int64).T


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of sorted token spans and adjoining sections: owned tokens, crossing tokens, shared tokens.

    A token of several characters that reaches into k further sections meets k + 1 of them; its share of each is the
    part of its characters there.  A token without characters belongs to the section it stands in.
    """
    n = len(sections)
    first = np.clip(np.searchsorted(sections[:, 0], starts, "right") - 1, 0, n - 1)
    last = np.maximum(first, np.clip(np.searchsorted(sections[:, 0], np.maximum(ends - 1, starts), "right") - 1, 0, n - 1))
    owned = np.bincount(first, minlength=n)
    meets = last - first + 1
    token = np.repeat(np.arange(len(starts)), meets)
    section = np.repeat(first, meets) + np.arange(len(token)) - np.repeat(np.cumsum(meets) - meets, meets)
    width = np.maximum(ends - starts, 1)[token]
    part = np.minimum(ends[token], sections[section, 1]) - np.maximum(starts[token], sections[section, 0])
    shared = np.bincount(section, np.where(ends[token] > starts[token], part / width, 1.0), minlength=n)
    crossing = np.bincount(section, (meets > 1)[token], minlength=n).astype(np.int64)
    return owned, crossing, shared


def section_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Token counts of every line of every text (``SCHEMA``).

    One row per section and input row.  A null or empty text has one empty section with no tokens; repeated rows give
    repeated results; an empty table gives none; other columns are left out.  ``start`` and ``end`` count code points.
    Bytes of one character that fall into several tokens give tokens of the same span, each counted.
    """

    def count(batches):
        import pyarrow as pa

        words = kept(f"spans {path}", lambda: span_encoder(path))
        for batch in slices(batches, size_bytes=ENCODED_BYTES):
            bounds, _, first, last = words.encode_texts(batch.column("text"), blanks=True)
            out = [[] for _ in range(6)]
            lengths = []
            for text, a, b in zip(batch.column("text").to_pylist(), bounds, bounds[1:]):
                sections = line_sections(text)
                lengths.append(len(sections))
                for column, got in zip(out, (np.arange(len(sections)), sections[:, 0], sections[:, 1], *attribute(first[a:b], last[a:b], sections))):
                    column.append(got)
            if lengths:
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
                kinds = ("i4", "i8", "i8", "i8", "i8", "f8")
                arrays = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_shared"])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, SCHEMA)
