"""Near duplicates by DartMinHash signatures of weighted five-word shingles.

A text is its shingles, weighted by how often they come.  Darts fall on the plane of weight and rank of every shingle;
where they fall depends on the shingle only.  The plane is cut into regions of weight [0, 1), [1, 2), [2, 4) ... and
rank [0, R), [R, 2R), [2R, 4R) ..., each with a hashed Poisson number of darts, so a text throws only about
k (ln k + 3) of them, not one per shingle and coordinate.  The earliest dart below a shingle's weight in each
of k coordinates is the signature; two texts agree in a coordinate with the probability of their weighted Jaccard
similarity.  Bands of the signature bring texts together.  In each band bucket texts are checked (exactly, on their
shingles) against one text first, then, where several classes are left, against ``HEADS`` texts of the bucket, those
that share most with others and then others, round after round, as long as that links many; what stays apart is
checked pair by pair, each pair once.  Exact bounds rule pairs out before: what a text shares with any other, and the
bits in which parities of the shingles differ.  So no link between texts of a bucket is lost, a bucket of one class
costs no pairs, and a large group of alike texts a few pairs per text.  At similarity 0.8 a pair meets in no band with a probability of 8 in a million.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import in_small_batches, stage, text_or_empty, unstage
from candlework.llm.components import components
from candlework.llm.shingles import mix, shingles, weighted, word_hashes

SIMILARITY = 0.8
ROWS, BANDS = 7, 50
FIRST_RANK = 2.0**-10
#: Bits in which the 128-bit sketches of a pair of similarity 0.8 differ: 12.8 on average, with a deviation of 3.4.
SKETCH_BITS = 34
#: Ids of texts that are sent to every task at most (8 bytes each).
WANTED_ROWS = 500_000
#: Texts of a bucket that all its others are compared with in a round; the share of open texts that a round must link to be
#: followed by another one; 64-bit words of a parity.
HEADS, WORTH_A_ROUND, PARITY_WORDS = 8, 0.02, 16
SIGNATURE = "doc_id long, name string, bands array<long>, sketch1 long, sketch2 long, weight long"


def poisson_steps(rate: float) -> np.ndarray:
    """Cumulative Poisson probabilities, up to where they reach 1."""
    n = int(rate + 12 * np.sqrt(rate) + 20)
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate / np.arange(1, n)))]) - rate
    return np.cumsum(np.exp(logs))


def unit(z: np.ndarray) -> np.ndarray:
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def region_darts(ids: np.ndarray, slab: int, layer: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one region: which shingle, coordinate, weight and rank."""
    wide, low_w = (1.0, 0.0) if slab == 0 else (2.0 ** (slab - 1),) * 2
    high, low_r = (FIRST_RANK, 0.0) if layer == 0 else (FIRST_RANK * 2.0 ** (layer - 1),) * 2
    seed = mix(ids + np.uint64((slab * 0x9E3779B97F4A7C15 + layer * 0xC2B2AE3D27D4EB4F + 1) % (1 << 64)))
    count = np.searchsorted(poisson_steps(k * wide * high), unit(seed), "right")
    which = np.repeat(np.arange(len(ids)), count)
    number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(seed[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    coordinate = (((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
    rank = low_r + high * unit(mix(dart + np.uint64(0xA0761D6478BD642F)))
    weight = low_w + wide * unit(mix(dart + np.uint64(0xE7037ED1A0B428DB))) if slab else None
    return which, coordinate, weight, rank


def dart_signatures(text: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) earliest ranks; the bits of a rank tell its dart.  Rows of texts without shingles stay infinite."""
    out = np.full(n * k, np.inf)
    total = np.bincount(text, weights, minlength=n)
    reach = np.zeros(n)
    np.divide(np.log(k) + 3.0, total, out=reach, where=total > 0)
    slab_of = np.ceil(np.log2(np.maximum(weights, 1))).astype(int)
    layer = 0
    live = total > 0
    while live.any():
        mine = live[text]
        for slab in range(int(slab_of[mine].max()) + 1):
            pick = np.flatnonzero(mine & (slab_of >= slab)) if slab else np.flatnonzero(mine)
            which, coordinate, weight, rank = region_darts(ids[pick], slab, layer, k)
            element = pick[which]
            if weight is not None:
                below = weight < weights[element]
                element, coordinate, rank = element[below], coordinate[below], rank[below]
            np.minimum.at(out, text[element] * k + coordinate, rank)
        done = FIRST_RANK * 2.0**layer >= reach
        open_texts = np.isinf(out.reshape(n, k)).any(1)
        live &= ~done | open_texts
        layer += 1
    return out.reshape(n, k)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Signature bands, sketch and weight of every row; a text without words has no bands."""

    def sign(batches):
        import pyarrow as pa

        for batch in slices(batches, size_bytes=2 << 20):
            words, hashes = word_hashes(batch.column("text"))
            text, ids, weights = weighted(*shingles(words, hashes))
            n = batch.num_rows
            got = dart_signatures(text, ids, weights, n, rows * bands)
            some = np.diff(words) > 0
            bits = (mix(got[:, :128].copy().view(np.uint64)) & np.uint64(1)).astype(np.uint8)
            sketch = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            keys = band_keys(got, rows, bands)[some]
            bounds = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("name"),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel())),
                    pa.array(sketch[:, 0].copy()),
                    pa.array(sketch[:, 1].copy()),
                    pa.array(np.bincount(text, weights, minlength=n).astype(np.int64)),
                ],
                names=["doc_id", "name", "bands", "sketch1", "sketch2", "weight"],
            )

    text = text_or_empty()
    rows_in = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("name"))
    return rows_in.mapInArrow(sign, SIGNATURE)


def similar_pairs(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is high enough; the sketch only spares clear cases.

    ``texts`` (rep, text) is stored; where only a few texts are wanted, their ids go to it instead of it to them.
    """
    side = lambda c: sketches.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("sketch1", "sketch2", "weight")])
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.least("weight_a", "weight_b") >= similarity * F.greatest("weight_a", "weight_b"))
        .where(F.expr(f"bit_count(sketch1_a ^ sketch1_b) + bit_count(sketch2_a ^ sketch2_b) <= {SKETCH_BITS}"))
        .select("a", "b")
    )
    near = stage(near)
    if near.isEmpty():
        return near
    wanted = stage(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct())
    picked = stage(texts.join(F.broadcast(wanted) if wanted.count() <= WANTED_ROWS else wanted, "rep", "left_semi"))

    def compare(batches):
        import pyarrow as pa

        for batch in slices(batches, "left", "right", size_bytes=2 << 20):
            sides = [weighted(*shingles(*word_hashes(batch.column(c)))) for c in ("left", "right")]
            text = np.concatenate([s[0] for s in sides])
            ids = np.concatenate([s[1] for s in sides])
            counts = np.concatenate([s[2] for s in sides])
            order = np.lexsort((ids, text))
            text, ids, counts = text[order], ids[order], counts[order]
            twice = np.flatnonzero((text[1:] == text[:-1]) & (ids[1:] == ids[:-1]))
            shared = np.bincount(text[twice], np.minimum(counts[twice], counts[twice + 1]), minlength=batch.num_rows)
            total = np.bincount(text, counts, minlength=batch.num_rows)
            keep = pa.array(shared >= similarity * (total - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = picked.select(F.col("rep").alias("a"), F.col("text").alias("left")), picked.select(F.col("rep").alias("b"), F.col("text").alias("right"))
    links = stage(near.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"))
    unstage(near, wanted, picked)
    return links


def near_duplicate_classes(docs: DataFrame, *, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, n_copies) per row: the smallest doc_id of its class and how many rows have its text.

    Rows of equal text are one class, and so are chains of texts of similarity ``similarity`` or more.  Texts without
    words (null, empty, blank) are alike only if equal (null counts as empty).  A row with a null doc_id links nothing: its
    class_id is that of its text if rows with an id have it, else null.  Repeated rows give repeated results; an
    empty table gives none; other columns are left out.  Ties of class ids cannot occur, ids of distinct texts being
    distinct.
    """
    signed = stage(signatures(docs, rows, bands))
    named = signed.where("doc_id IS NOT NULL").groupBy("name")
    one = F.min_by(F.struct("bands", "sketch1", "sketch2", "weight"), "doc_id").alias("s")
    reps = stage(named.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), one).select("name", "rep", "n_copies", "s.*"))
    owned = stage(signed.select("doc_id", "name"))
    unstage(signed)
    label = linked_classes(docs, reps, similarity, docs_repeat(owned)).withColumnRenamed("node", "rep")
    classes = stage(reps.select("name", "rep", "n_copies").join(label, "rep", "left").selectExpr("name", "coalesce(label, rep) AS class_id", "n_copies"))
    unstage(reps)
    return owned.join(classes, "name", "left").select("doc_id", "class_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def linked_classes(docs: DataFrame, reps: DataFrame, similarity: float, repeated: bool) -> DataFrame:
    """(node, label) of the texts that are linked to any other; ``reps`` has a row per distinct text."""
    sketches = reps.select("rep", "sketch1", "sketch2", "weight")
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).where("n > 1")
    hits = stage(banded.join(heads.drop("n"), "bucket"))
    met = stage(hits.select("rep").distinct())
    few = met.count() <= WANTED_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("text")).join(F.broadcast(met) if few else met, "rep", "left_semi")
    texts = stage(texts.dropDuplicates(["rep"]) if repeated else texts)
    # First every text of a bucket against the bucket's smallest id.
    tested = stage(hits.where("rep <> head").selectExpr("head AS a", "rep AS b").distinct())
    links = similar_pairs(tested, sketches, texts, similarity)
    label = components(links)
    # Then, in buckets that hold several classes yet, against more of their texts.
    open_rows = stage(several_classes(hits.select("bucket", "rep"), label))
    unstage(hits, met)
    if not open_rows.isEmpty():
        apart = unshared_weight(texts.join(open_rows.select("rep").distinct(), "rep", "left_semi"))
        weighed = open_rows.join(apart, "rep", "left").join(reps.select("rep", "weight"), "rep").withColumn("shared", F.expr("weight - coalesce(apart, 0)"))
        # What a text shares with others bounds its similarity to any of them; without enough of it, it links nothing.
        able = stage(weighed.where(F.col("shared") >= similarity * F.col("weight")).select("bucket", "rep", "weight", "shared"))
        unstage(open_rows)
        left = stage(several_classes(able, label))
        unstage(able)
        marked = stage(left.drop("label").join(parities(texts.join(left.select("rep").distinct(), "rep", "left_semi")), "rep"))
        texts_open, turn, news = marked.select("rep").distinct().count(), 0, None
        while news is None or news > texts_open * WORTH_A_ROUND:
            first = F.desc(F.col("shared") / F.col("weight")) if turn == 0 else F.xxhash64(F.lit(turn), "rep")
            placed = several_classes(marked, label)
            chosen = placed.withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(first, "rep"))).where(F.col("_k") <= HEADS)
            pairs = may_link(placed, chosen, similarity).selectExpr("least(rep, rep_b) AS a", "greatest(rep, rep_b) AS b").distinct()
            pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"))
            found = similar_pairs(pairs, sketches, texts, similarity)
            news, turn = found.count(), turn + 1
            more_links, more_tested = stage(links.union(found)), stage(tested.union(pairs))
            unstage(links, tested, found, pairs, label)
            links, tested = more_links, more_tested
            label = components(links)
        # Last, what is in different classes still, pair by pair, in the first bucket that both are in.
        bands = reps.select("rep", F.array_sort("bands").alias("bands"))
        rest = stage(several_classes(marked, label).join(bands, "rep"))
        unstage(left, marked)
        left = rest
        both = may_link(left, left, similarity, (F.col("rep") < F.col("rep_b")) & (F.array_min(F.array_intersect("bands", "bands_b")) == F.col("bucket")))
        pairs = stage(both.selectExpr("rep AS a", "rep_b AS b").join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            found = similar_pairs(pairs, sketches, texts, similarity)
            every = stage(links.union(found))
            unstage(label, found)
            label = components(every)
            unstage(every)
        unstage(left, pairs)
    else:
        unstage(open_rows)
    unstage(texts, tested, links)
    return label


def may_link(one: DataFrame, two: DataFrame, similarity: float, *others) -> DataFrame:
    """Pairs (rep, rep_b) of a bucket in different classes that no exact bound rules out.

    Two texts that are alike differ in at most a (1 - s) / (1 + s) part of their joint weight, and in at least as many
    shingles as bits differ in their parities; they share no more than what either shares with anyone.
    """
    other = two.withColumnsRenamed({c: f"{c}_b" for c in two.columns})
    joint = F.col("weight") + F.col("weight_b")
    differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(1, PARITY_WORDS)), F.bit_count(F.col("p0").bitwiseXOR(F.col("p0_b"))))
    able = [
        F.col("bucket") == F.col("bucket_b"),
        F.col("label") != F.col("label_b"),
        F.least("weight", "weight_b") >= similarity * F.greatest("weight", "weight_b"),
        F.least("shared", "shared_b") >= similarity / (1 + similarity) * joint,
        differ <= (1 - similarity) / (1 + similarity) * joint + 1e-9,
        *others,
    ]
    return one.join(other, reduce(lambda a, b: a & b, able))


def parities(texts: DataFrame) -> DataFrame:
    """(rep, p0, p1, ...): the parity of the shingles, repeated ones as often as they come, that fall on each of 1,024 bits."""
    bits = 64 * PARITY_WORDS

    def rows(batches):
        import pyarrow as pa

        for batch in slices(batches, size_bytes=2 << 20):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text, ids, weights = weighted(*shingles(*word_hashes(part.column("text"))))
                first = np.repeat(np.cumsum(weights) - weights, weights)
                copy = (np.arange(len(first)) - first).astype(np.uint64)
                bit = (mix(np.repeat(ids, weights) + copy * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)
                odd = np.bincount(np.repeat(text, weights) * bits + bit, minlength=part.num_rows * bits).astype(np.uint8) & 1
                words = np.packbits(odd.reshape(part.num_rows, bits), axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column("rep"), *[pa.array(words[:, k].copy()) for k in range(PARITY_WORDS)]], names=["rep", *[f"p{k}" for k in range(PARITY_WORDS)]])

    return texts.select("rep", "text").mapInArrow(rows, ", ".join(["rep long", *[f"p{k} long" for k in range(PARITY_WORDS)]]))


def several_classes(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (bucket, rep, ...) of buckets that hold more than one class, with their labels."""
    placed = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    return placed.join(mixed, "bucket")


def unshared_weight(texts: DataFrame) -> DataFrame:
    """(rep, apart): weight of the shingles of a text that no other of ``texts`` has."""

    def rows(batches):
        import pyarrow as pa

        for batch in slices(batches, size_bytes=2 << 20):
            text, ids, weights = weighted(*shingles(*word_hashes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(text)), pa.array(ids.view(np.int64)), pa.array(weights.astype(np.int64))], names=["rep", "shingle", "weight"])

    once = texts.select("rep", "text").mapInArrow(rows, "rep long, shingle long, weight long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("rep").alias("rep"), F.sum("weight").alias("weight"))
    return once.where("n = 1").groupBy("rep").agg(F.sum("weight").alias("apart"))


def docs_repeat(signed: DataFrame) -> bool:
    """Whether any doc_id comes more than once."""
    return not signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the smallest doc_id; rows without an id stay."""
    classes = stage(near_duplicate_classes(docs, **options))
    dropped = stage(classes.where("doc_id <> class_id").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs_repeat(classes)
    unstage(classes)
    if not repeated:
        return kept
    named, unnamed = kept.where("doc_id IS NOT NULL"), kept.where("doc_id IS NULL")
    return named.dropDuplicates(["doc_id"]).unionByName(unnamed)
