"""Prefix trie of conversations from sorted matrices of turn ids.

A turn's id is the MD5 of its role and text; a conversation is the string of its ids.  Conversations are dealt to
shards by ranges of (string, conv_id), each shard sorted, so that every node of the trie is a stretch of neighbouring
rows.  A shard is worked off in chunks of bounded size.  A chunk is a matrix of ids, padded with zeros: a numpy lexsort
orders it, comparing each row with the one above gives a mask of changes per column, which, OR-accumulated over the
columns, marks where nodes start, and reduceat adds up each depth.  Sums over subtrees climb from the deepest column.

Only nodes on the paths of a chunk's first and last row can have members elsewhere.  They leave the chunk as parts,
are added up by (depth, hash of the prefix), and get what hangs below them from sums along these paths: each node's own
amount stands once, on one path through it, and a node's subtree is the sum over the paths through it of what stands
at its depth or deeper.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.llm.common import arrow_schema, stage

#: Cells of a chunk's matrix; a longer conversation is a chunk of its own.
CELLS = 1 << 20
ID_BYTES = 16

PARTS = (
    "kind int, path long, depth int, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, bytes long, ends_sha256 string, first_end long, ends string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Kinds of rows: a whole node, a whole node below one that is not, a part of a node.
WHOLE, BELOW, PART = 0, 1, 2


def conversation_strings(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): ids of a conversation's turns in order, 16 bytes each, and the UTF-8 bytes of their texts.

    Turns are ordered by turn, null first, and where it is equal by id, so in a fixed way.  Null roles and texts are
    empty; rows without a conv_id belong to none and are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("given"),
            F.col("turn").cast("long").alias("turn"),
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ids = F.transform("ts", lambda t: F.hex(t["id"]))
    return listed.select("conv_id", F.unhex(F.array_join(ids, "")).alias("seq"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations made anew by the rule of the test: the first h turns of c - c % 5, then c's own turns after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = convs.select(F.col("conv_id").alias("base"), F.col("seq").alias("base_seq"), F.col("sizes").alias("base_sizes"))
    both = convs.withColumn("h", h.cast("int")).withColumn("base", F.expr("conv_id - pmod(conv_id, 5)")).join(base, "base", "left")
    return both.select(
        "conv_id",
        F.expr(f"concat(coalesce(substring(base_seq, 1, {ID_BYTES} * h), x''), substring(seq, {ID_BYTES} * h + 1))").alias("seq"),
        F.expr("concat(coalesce(slice(base_sizes, 1, h), cast(array() AS array<bigint>)), if(size(sizes) > h, slice(sizes, h + 1, size(sizes)), cast(array() AS array<bigint>)))").alias("sizes"),
    )


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def path_keys(seq: bytes, depth: int) -> list[bytes]:
    """Hashes of the prefixes of a conversation, from the root on."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(depth):
        state.update(seq[ID_BYTES * d : ID_BYTES * (d + 1)])
        out.append(state.digest())
    return out


def chunk_nodes(conv: np.ndarray, seqs: list[bytes], sizes: list[np.ndarray], chunk: int) -> list[tuple]:
    """Rows of ``PARTS`` for the nodes of one chunk of neighbouring conversations."""
    n, length = len(seqs), np.array([len(s) // ID_BYTES for s in seqs])
    wide = int(length.max())
    matrix = np.zeros((n, wide, 2), np.uint64)
    filled = np.arange(wide) < length[:, None]
    matrix[filled] = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2)
    size = np.zeros((n, wide), np.int64)
    size[filled] = np.concatenate([np.zeros(0, np.int64), *sizes])
    order = np.lexsort((conv, *(matrix[:, d, k] for d in range(wide - 1, -1, -1) for k in (1, 0))))
    conv, length, matrix, size = conv[order], length[order], matrix[order], size[order]
    change = np.ones((n, wide + 1), bool)
    change[1:, 0] = False
    change[1:, 1:] = (matrix[1:] != matrix[:-1]).any(2)
    opens = np.logical_or.accumulate(change, axis=1)
    first, last = path_keys(seqs[order[0]], length[0]), path_keys(seqs[order[-1]], length[-1])

    found = []  # by depth: what reduceat gives
    for d in range(wide + 1):
        rows = np.flatnonzero(length >= d)
        starts = np.flatnonzero(opens[rows, d])
        count = np.diff(np.append(starts, len(rows)))
        node_of = np.full(n, -1)
        node_of[rows] = np.cumsum(opens[rows, d]) - 1
        ending = (length[rows] == d).astype(np.int64)
        open_end = np.zeros(len(starts), bool)  # on the path of the first or the last row
        open_end[[node_of[r] for r in (0, n - 1) if node_of[r] >= 0]] = True
        found.append((rows, rows[starts], count, np.minimum.reduceat(conv[rows], starts), np.add.reduceat(ending, starts), open_end, node_of))
    out: list[tuple] = []
    leaves = saved = np.zeros(0, np.int64)
    for d in range(wide, -1, -1):
        rows, heads, count, least, ending, part, node_of = found[d]
        children, below_leaves, below_saved = (np.zeros(len(heads), np.int64) for _ in range(3))
        if d < wide:  # whole children only; the others are added up later
            whole = np.flatnonzero(~found[d + 1][5])
            up = node_of[found[d + 1][1][whole]]
            np.add.at(children, up, 1)
            np.add.at(below_leaves, up, leaves[whole])
            np.add.at(below_saved, up, saved[whole])
        own = size[heads, d - 1] if d else np.zeros(len(heads), np.int64)
        leaves = np.where(children == 0, 1, below_leaves)
        saved = below_saved + (count - 1) * own
        offset = np.cumsum(count) - count  # members that end here come first in a node, by conv_id
        parent_of = found[d - 1][6][heads] if d else heads * 0 - 1
        for k in range(len(heads)):
            a = offset[k]
            ended = conv[rows[a : a + ending[k]]]
            if not part[k]:
                above = parent_of[k]
                known = not found[d - 1][5][above]
                parent = None if known else (first if found[d - 1][6][0] == above else last)[d - 1]
                out.append((WHOLE if known else BELOW, None, d, None, parent, least[k], found[d - 1][3][above] if known else None, count[k], children[k], leaves[k], saved[k], None, digest(ended), None, None))
                continue
            keys = first if node_of[0] == k else last
            said = ",".join(map(str, ended.tolist())) if len(ended) else None
            amounts = (count[k], children[k], below_leaves[k], below_saved[k], own[k], None, ended[0] if len(ended) else None, said)
            for side, row in enumerate((0, n - 1)):
                if node_of[row] == k:
                    out.append((PART, 2 * chunk + side, d, keys[d], keys[d - 1] if d else None, least[k], None, *amounts))
                    amounts = (0, 0, 0, 0, own[k], None, None, None)  # counted once
    return out


def chunks(batches, cells: int):
    """Neighbouring conversations, as many as fill ``cells`` of a padded matrix."""
    conv, seqs, sizes, wide = [], [], [], 1
    for batch in batches:
        for c, s, z in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), batch.column("sizes")):
            longer = max(wide, len(s) // ID_BYTES)
            if seqs and (len(seqs) + 1) * longer > cells:
                yield np.array(conv, np.int64), seqs, sizes
                conv, seqs, sizes, longer = [], [], [], max(1, len(s) // ID_BYTES)
            conv.append(c)
            seqs.append(s)
            sizes.append(np.asarray(z.values, np.int64))
            wide = longer
    if seqs:
        yield np.array(conv, np.int64), seqs, sizes


def parts_of(convs: DataFrame, cells: int) -> DataFrame:
    arrow = arrow_schema(PARTS)

    def rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for k, chunk in enumerate(chunks(batches, cells)):
            found = chunk_nodes(*chunk, (shard << 32) + k)
            for a in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[a : a + 10_000]), arrow)], schema=arrow)

    shards = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return convs.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(rows, PARTS)


def end_digests(parts: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of nodes in parts; pieces of a node's list pass through one digest in order, unheld."""

    schema = "depth int, key binary, ends_sha256 string"
    arrow = arrow_schema(schema)

    def rows(batches):
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for depth, key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ends"))):
                if (depth, key) == now:
                    state.update(b"," + piece.encode())
                    continue
                if state:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, key), hashlib.sha256(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, state.hexdigest()), arrow)], schema=arrow)

    pieces = parts.where("ends IS NOT NULL").select("depth", "key", "first_end", "ends")
    return pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "first_end").mapInArrow(rows, schema)


def prefix_nodes(convs: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, seq, sizes), the root among them.

    A node: conv_id (its smallest member) and depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (nodes without children in its subtree, itself included), saved_tokens (over its subtree, members beyond the first
    times the size of the last turn), ends_sha256 (of the conv_ids that end here, ascending, joined by commas).
    Conversations of equal turns share all nodes.  A conversation without turns ends at the root.  No conversations, no
    nodes.  A conversation is a row: its ids, 16 bytes a turn, must fit into one.
    """
    parts = stage(parts_of(convs, cells))
    split = parts.where(F.col("kind") == PART)
    node = ["depth", "key"]
    summed = split.groupBy(*node).agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("whole_children"),
        F.sum("n_leaves").alias("leaves_below"),
        F.sum("saved_tokens").alias("saved_below"),
        F.max("bytes").alias("bytes"),
        F.min("path").alias("stands"),
    )
    under = summed.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("split_children"))
    summed = summed.join(under, node, "left").withColumn("n_children", F.col("whole_children") + F.coalesce("split_children", F.lit(0)))
    own = [F.col("leaves_below") + F.when(F.col("n_children") == 0, 1).otherwise(0), F.col("saved_below") + (F.col("n_convs") - 1) * F.col("bytes")]
    summed = stage(summed.select(*node, "parent_key", "conv_id", "n_convs", "n_children", "stands", own[0].alias("leaves"), own[1].alias("saved")))
    along = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once = lambda c: F.sum(F.when(F.col("stands") == F.col("path"), F.col(c)).otherwise(0)).over(along)
    stood = split.select("path", *node).join(summed.select(*node, "stands", "leaves", "saved"), node)
    below = stood.select(*node, once("leaves").alias("n_leaves"), once("saved").alias("saved_tokens")).groupBy(*node).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = summed.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    joined = summed.join(below, node).join(end_digests(split), node, "left").join(above, ["depth", "parent_key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    hanging = parts.where(F.col("kind") == BELOW).drop("parent_conv_id").join(above, ["depth", "parent_key"])
    whole = parts.where(F.col("kind") == WHOLE)
    nodes = whole.select(*COLUMNS).unionByName(hanging.select(*COLUMNS)).unionByName(joined.select(*COLUMNS))
    return nodes.withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(turns: DataFrame, *, as_test: bool = False, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of the conversations in ``turns`` (conv_id, turn, role, text); see ``prefix_nodes``.

    ``as_test`` makes the conversations anew first (``rebuilt``).  Other columns are left out.
    """
    convs = conversation_strings(turns)
    if as_test:
        convs = stage(convs)  # read twice
        convs = rebuilt(convs)
    return prefix_nodes(convs, cells=cells)


#: The query in SQL: the checksum is put together bit by bit, nodes are grouped by the list of their turns.
SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) ) AS crc
    FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS base FROM ids),
rebuilt AS (
    SELECT heads.conv_id, place, role, text FROM heads JOIN turns ON turns.conv_id = base AND place <= h
    UNION ALL
    SELECT heads.conv_id, h + place, role, text FROM heads JOIN turns ON turns.conv_id = heads.conv_id AND place > h
), placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, strlen(text)::BIGINT AS bytes, md5(strlen(role) || ':' || role || text) AS id FROM rebuilt
), prefixes AS (
    SELECT conv_id, depth, bytes, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM placed
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT node, p.depth AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
        sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE last.depth = p.depth), '')) AS ends_sha256
    FROM prefixes p JOIN last USING (conv_id) GROUP BY node, p.depth
), children AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (
    SELECT p.node, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
    FROM prefixes p JOIN full_nodes n ON n.conv_id = p.conv_id AND n.depth >= p.depth GROUP BY p.node
)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (node) LEFT JOIN nodes up ON f.depth > 0 AND up.node = left(f.node, length(f.node) - 32)
"""
