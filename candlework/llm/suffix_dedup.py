"""Removal of bytes covered by a repeated 400-byte string, from a sparse suffix array.

Every 400-byte string holds an anchor: the place of its smallest 16-byte hash.  Equal strings hold it at the same
place, so only suffixes that start at anchors have to be sorted, and only among anchors of the same hash.

An anchor whose whole surroundings (384 bytes before, 400 after, clipped to its document) come twice needs no
sorting: all its strings are repeated.  For the others one copy of each different surroundings is brought together
per hash.  Their suffixes are sorted by deep-shallow sorting: multikey quicksort to ``SHALLOW`` bytes, then a blind
trie for each group that is still tied.  The same is done with what stands before them, read backwards.  Joining
sets of equal left parts from long to short, each anchor's best partners are its neighbours in suffix order, which
gives the furthest it reaches to the left and to the right in repeated strings.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import in_small_batches, stage, text_or_empty, unstage
from candlework.llm.shingles import BASE, INVERSE, mix, powers, text_bytes
from candlework.operators.staging import collecting

LENGTH, GRAM = 400, 16
WINDOW = LENGTH - GRAM + 1
SHALLOW, CHUNK = 48, 8
#: Different surroundings of one anchor hash that one task sorts; beyond that their strings are counted one by one.
GROUP_ROWS = 20_000
KEY = ["doc_key", "text_hash"]


def anchors_of(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """Per anchor: number of the text, place in it, hash, hash of the surroundings, bytes before and after."""
    window = length - GRAM + 1
    n = len(raw) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return (none,) * 6
    pairs = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw).data, strides=(1,))
    grams = mix(pairs[: n] * np.uint64(BASE) + mix(pairs[8 : 8 + n]))
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    full = -(-n // window) * window
    blocks = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = key
    blocks = blocks.reshape(-1, window)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(tail[: n - window + 1], head[window - 1 : n])
    size = np.diff(bounds)
    long = np.flatnonzero(size >= length)
    count = size[long] - length + 1
    start = np.repeat(bounds[:-1][long], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(place):
        return (none,) * 6
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    text = np.searchsorted(bounds, place, "right") - 1
    before = np.minimum(length - GRAM, place - bounds[text])
    after = np.minimum(length, bounds[text + 1] - place)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), dtype=np.uint64)])
    around = mix((sums[place + after] - sums[place - before]) * powers(len(raw) + 1, INVERSE)[place - before])
    around = mix(around + (before * 1024 + after).astype(np.uint64))
    return text, place - bounds[text], grams[place].view(np.int64), around.view(np.int64), before, after


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """Sorted order of ``group`` and the common prefixes of neighbours.

    Inner nodes hold a depth and children by the one byte there; a string is walked down without looking at the bytes
    between, compared once with the leaf it ends at, and hung in where they part.
    """
    at = lambda s, d: s[d] if d < len(s) else -1
    root: list | int = group[0]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1].get(at(s, node[0])) if at(s, node[0]) in node[1] else next(iter(node[1].values()))
        depth = common(s, strings[node])
        above, byte, other, node = None, 0, strings[node], root
        while isinstance(node, list) and node[0] < depth:
            above, byte = node, at(s, node[0])
            node = node[1][byte]
        if isinstance(node, list) and node[0] == depth:
            node[1][-2 - i if -1 in node[1] and depth >= len(s) else at(s, depth)] = i
            continue
        equal = depth >= len(s) and depth >= len(other)  # told apart by number
        fresh = [depth, {at(other, depth): node, -2 - i if equal else at(s, depth): i}]
        if above is None:
            root = fresh
        else:
            above[1][byte] = fresh
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        if isinstance(node, list):
            keys = sorted(node[1])
            for k in reversed(keys[1:]):
                stack.append((node[1][k], node[0]))
            stack.append((node[1][keys[0]], lcp))
        else:
            order.append(node)
            lcps.append(lcp)
    return order, lcps[1:]


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of strings and the common prefix of each with the one before (0 for the first)."""
    order, lcps = [], []
    stack = [(list(range(len(strings))), 0, 0)]  # members, depth they share, common prefix with what came before
    while stack:
        group, depth, lcp = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcps.append(common(strings[order[-2]], strings[group[0]]) if len(order) > 1 else 0)
        elif depth >= SHALLOW:
            got, inner = blind_trie(strings, group)
            lcps.append(common(strings[order[-1]], strings[got[0]]) if order else 0)
            order += got
            lcps += inner
        else:
            keys = [strings[i][depth : depth + CHUNK] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            parts = ([i for i, k in zip(group, keys) if k > pivot], depth), ([i for i, k in zip(group, keys) if k == pivot], depth + CHUNK), ([i for i, k in zip(group, keys) if k < pivot], depth)
            stack += [(part, d, lcp) for part, d in parts if part]
    return order, lcps


def reaches(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """How far each anchor reaches to the left and right in strings of ``length`` that another one of the group has too.

    ``lefts`` are read backwards from the anchor.  (0, 0) where there is none.
    """
    n = len(rights)
    out = [[0, 0] for _ in range(n)]
    rank = [0] * n
    for r, i in enumerate(deep_shallow(rights)[0]):
        rank[i] = r
    member = [0] * n
    for i, r in enumerate(rank):
        member[r] = i
    order, lcps = deep_shallow(lefts)
    sets: list[list[int] | None] = [[rank[i]] for i in order]
    owner = list(range(n))

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    def meet(i: int, j: int, shared: int) -> None:
        right = common(rights[i], rights[j])
        if shared + right >= length:
            for k in (i, j):
                out[k][0] = max(out[k][0], shared)
                out[k][1] = max(out[k][1], right)

    for k in sorted(range(1, n), key=lambda k: -lcps[k]):
        a, b = find(k - 1), find(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for r in sets[b]:
            at = bisect.bisect(large, r)
            if at:
                meet(member[large[at - 1]], member[r], lcps[k])
            if at < len(large):
                meet(member[large[at]], member[r], lcps[k])
            large.insert(at, r)
        owner[b], sets[b] = a, None
    return [(a, b) for a, b in out]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def find(batches):
        import pyarrow as pa

        names = [*KEY, "place", "anchor", "around", "before", "after"]
        for batch in slices(batches, size_bytes=2 << 20):
            text, place, anchor, around, before, after = anchors_of(*text_bytes(batch.column("text")), length)
            ids = [batch.column(c).take(pa.array(text)) for c in KEY]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x.astype(k)) for x, k in zip((place, anchor, around, before, after), ("i4", "i8", "i8", "i2", "i2"))]], names=names)

    return docs.mapInArrow(find, "doc_key long, text_hash long, place int, anchor long, around long, before short, after short")


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spans of repeated strings (doc_key, text_hash, start, end), not merged.

    ``docs`` has doc_key, text_hash and text, none of them null.
    """
    found = stage(anchor_rows(docs, length))
    row = F.xxhash64(*KEY, "place")
    kinds = stage(found.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("one")))
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
    open_anchors = stage(per.where("kinds > 1 AND single > 0").select("anchor", "kinds"))
    told = kinds.join(open_anchors, "anchor", "left").where("n > 1 OR kinds IS NOT NULL")
    marked = found.join(told, ["anchor", "around"])
    marked = stage(marked.select(*KEY, "place", "anchor", "before", "after", "kinds", (F.col("n") == 1).alias("single"), (F.col("kinds").isNotNull() & (row == F.col("one"))).alias("needed")))
    unstage(found, kinds)
    places = marked.where("needed").groupBy(*KEY).agg(F.collect_set(F.struct("place", "anchor", "kinds", "single")).alias("places"))
    texts = docs.select(*KEY, "text").join(places, KEY)

    def surroundings(batches):
        import pyarrow as pa

        kind = pa.schema([("doc_key", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()), ("anchor", pa.int64()), ("kinds", pa.int64()), ("single", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
        for batch in batches:
            for part in slices([batch], size_bytes=1 << 20):
                rows = []
                for doc_key, text_hash, text, places in zip(*(part.column(c).to_pylist() for c in (*KEY, "text", "places"))):
                    raw = text.encode()
                    for p in places:
                        at = p["place"]
                        rows.append((doc_key, text_hash, at, p["anchor"], p["kinds"], p["single"], raw[max(0, at - length + GRAM) : at][::-1], raw[at : at + length]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    fields = "doc_key long, text_hash long, place int, anchor long, kinds long, single boolean, left binary, right binary"
    contexts = texts.mapInArrow(surroundings, fields)
    largest = open_anchors.agg(F.max("kinds")).first()[0] or 0
    if largest > group_rows:
        contexts = stage(contexts)

    def sorted_groups(batches):
        import pyarrow as pa

        rows, last = [], None

        def done():
            got = reaches([r[4] for r in rows], [r[5] for r in rows], length)
            return [(d, h, p - a, p + b) for (d, h, p, single, _, _), (a, b) in zip(rows, got) if single and b]

        kind = pa.schema([("doc_key", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", *KEY, "place", "single", "left", "right"))):
                if anchor != last and rows:
                    out += done()
                    rows = []
                last = anchor
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=kind)
        if rows:
            out = done()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=kind)

    small = contexts.where(F.col("kinds") <= group_rows).drop("kinds").repartition("anchor").sortWithinPartitions("anchor")
    spans = small.mapInArrow(sorted_groups, "doc_key long, text_hash long, start long, end long")
    full = marked.where("NOT single").where(F.col("before") + F.col("after") >= length)
    full = full.select(*KEY, (F.col("place") - F.col("before")).cast("long").alias("start"), (F.col("place") + F.col("after")).cast("long").alias("end"))
    if largest > group_rows:
        spans = spans.unionByName(counted_strings(contexts.where(F.col("kinds") > group_rows), length))
    return spans.unionByName(full)


def counted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """Spans for the groups that are too large for one task: every string around an anchor is hashed and counted."""

    def strings(batches):
        import pyarrow as pa

        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                out = []
                for k, (left, right) in enumerate(zip(rows.column("left").to_pylist(), rows.column("right").to_pylist())):
                    text, n = left[::-1] + right, len(left)
                    for a in range(max(0, len(text) - length + 1)):
                        if a <= n:
                            out.append((k, n - a, int.from_bytes(hashlib.blake2b(text[a : a + length], digest_size=8).digest(), "little", signed=True)))
                if out:
                    which, offset, string = (np.array(c) for c in zip(*out))
                    names = [*KEY, "place", "anchor", "single", "offset", "string"]
                    yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(which)) for c in names[:5]], pa.array(offset, pa.int32()), pa.array(string, pa.int64())], names=names)

    listed = contexts.mapInArrow(strings, "doc_key long, text_hash long, place int, anchor long, single boolean, offset int, string long")
    twice = listed.groupBy("anchor", "offset", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (
        listed.where("single")
        .join(twice, ["anchor", "offset", "string"], "left_semi")
        .groupBy(*KEY, "place")
        .agg((F.col("place") - F.max("offset")).cast("long").alias("start"), (F.col("place") - F.min("offset") + length).cast("long").alias("end"))
        .select(*KEY, "start", "end")
    )


def keys() -> list:
    """What tells a document: its id (a null id counts as -1) and the hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_key"), F.xxhash64(text_or_empty()).alias("text_hash")]


def with_spans(docs: DataFrame, length: int, group_rows: int) -> DataFrame:
    """The rows of ``docs`` with the column ``_spans`` of repeated spans, null where there are none."""
    keyed = in_small_batches(docs).select(*keys(), text_or_empty().alias("text"))
    with collecting() as made:
        spans = repeated_spans(keyed, length, group_rows)
    listed = stage(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("_spans")))
    unstage(*made)
    listed = listed.withColumnsRenamed({"doc_key": "_doc_key", "text_hash": "_text_hash"})
    doc_key, text_hash = keys()
    named = docs.withColumns({"_own_key": doc_key, "_own_hash": text_hash})
    return named.join(listed, (F.col("_own_key") == F.col("_doc_key")) & (F.col("_own_hash") == F.col("_text_hash")), "left")


def cut(text: str | None, spans) -> tuple[bytes, bytes, int]:
    """A text's bytes, those left without the spans, and the number of merged spans."""
    raw, at, left = (text or "").encode(), 0, []
    gone = merged((s["start"], s["end"]) for s in spans or ())
    for a, b in gone:
        left.append(raw[at:a])
        at = b
    return raw, b"".join([*left, raw[at:]]), len(gone)


def removed_bytes(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A null text counts as empty and loses nothing; texts below ``length`` bytes lose nothing; repeated rows are
    documents of their own, so each makes the other's strings repeated; an empty table gives none; other columns are
    left out; strings are judged on the input and never cross documents.
    """

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices([batch], size_bytes=2 << 20):
                got = [cut(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist())]
                columns = [[len(raw) for raw, _, _ in got], [len(raw) - len(left) for raw, left, _ in got], [n for _, _, n in got]]
                sums = pa.array([hashlib.sha256(left).hexdigest() for _, left, _ in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], sums], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), length, group_rows)
    return rows.select("doc_id", "text", "_spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents with repeated strings cut out of their texts, with their columns.

    A document that loses all its bytes goes.  Where a cut falls inside a character, the rest of the character goes too.
    """
    names = docs.columns

    def shorten(batches):
        import pyarrow as pa

        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("_spans").to_pylist()
            left = [t if s is None else cut(t, s)[1].decode("utf-8", "ignore") for t, s in zip(texts, spans)]
            stays = pa.array([s is None or bool(t) for t, s in zip(left, spans)], pa.bool_())
            columns = [pa.array(left, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stays)

    return with_spans(docs, length, group_rows).select(*names, "_spans").mapInArrow(shorten, docs.schema)
