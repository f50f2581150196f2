"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns. Conversations, as lists of turn digests, are sorted by their whole path and cut into shards
of bounded size. Each shard indexes (position, turn) to the bitset of its conversations that have this turn there, and another index has
the conversations that end at each length. Depth first, a node's bitset is intersected with the posting of a next turn (that of
its lowest conversation not yet dealt to a child), which gives the child; popcounts are member counts, intersections with the ends are end lists.

As shards are ranges of sorted paths, a node that holds neither the first nor the last conversation of its shard lies in this shard only and is
finished there, with the sums over its subtree. The others (two paths a shard) are open: their partial rows are added up by Spark, their
end lists meet as sorted chunks and are hashed as a stream, and sums over subtrees of open nodes run by pointer jumping, in as many rounds as the
depth has binary digits. So a first turn, or a conversation, that a third of all rows share is cut over many shards and
costs one row per shard.

Odd inputs: turns sort by number (nulls first), role and digest of the text; null roles and texts are empty; repeated rows are repeated turns;
rows without conv_id take no part; a conversation rebuilt to nothing is a member of the root and ends there; an empty table has no
nodes. Other columns are ignored. The turns of one conversation meet in one row, by 28 bytes each and not by their texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import stored, table
from fieldspark.llm.queries import query

#: A shard is full with so many conversations or turns: bitsets have at most the first number of bits, postings are at most the second.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 32768
ROOT = b""
#: Copies of the small table of open nodes that a hot parent's children are dealt to.
SALTS = 32


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest of role and text, code points of the text) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")))
    turn = F.struct(F.col("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("order"), digest.alias("digest"), F.length(text).alias("size"))
    lists = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def branch_length(conv_id: Column, branches: int = 6) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(branches)).cast("int")


def with_shared_starts(lists: DataFrame, family: int = 100, branches: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % family and goes on with its own after h. A base has at most 2 x family of them."""
    h = branch_length(F.col("conv_id"), branches)
    bases = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, branches).alias("_start"))
    own = lists.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % family, "_h": h})
    start = F.when(F.col("_h") > 0, F.slice(F.coalesce("_start", F.slice("turns", 1, 0)), 1, F.greatest("_h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.join(bases, "_base", "left").select("conv_id", F.concat(start, rest).alias("turns"))


# --- one shard ------------------------------------------------------------------------------------------------------------------------

NODE = (
    "node binary, parent binary, parent_conv_id long, depth int, conv_id long, size long, open boolean, n_convs long, n_children long, n_leaves long, saved long, "
    "ends string, first_end long"
)
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]


def vertical_index(paths: list[list[bytes]]) -> tuple[dict[tuple[int, bytes], int], dict[int, int]]:
    """((position, turn) -> bitset of conversations, length -> bitset of conversations that end there)."""
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for i, path in enumerate(paths):
        bit = 1 << i
        for key in enumerate(path):
            postings[key] = postings.get(key, 0) | bit
        ends[len(path)] = ends.get(len(path), 0) | bit
    return postings, ends


def members(bits: int, ids: list[int]) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return out


def shard_nodes(ids: list[int], paths: list[list[bytes]], sizes: list[list[int]]) -> list[tuple]:
    """The shard's nodes. Finished ones have whole sums; open ones sums over what is finished below them, and no child counts of open children.

    Node names chain digests, so they are equal in all shards.
    """
    postings, ends = vertical_index(paths)
    everyone = (1 << len(paths)) - 1
    border = 1 | (1 << (len(paths) - 1))
    out: list[tuple] = []
    # a frame: name, parent, parent's least member if finished, depth, bits, least, size of the last text, open; bits not yet dealt, children, leaves, saved
    stack = [[(ROOT, None, None, 0, everyone, min(ids), 0, True), everyone & ~ends.get(0, 0), 0, 0, 0]]
    while stack:
        frame = stack[-1]
        (name, parent, parent_least, depth, bits, least, size, is_open), left, children, leaves, saved = frame
        if left:
            i = (left & -left).bit_length() - 1
            turn = paths[i][depth]
            child = bits & postings[depth, turn]
            frame[1] = left & ~child
            known = (hashlib.md5(name + turn).digest(), name, None if is_open else least, depth + 1, child, min(members(child, ids)), sizes[i][depth], bool(child & border))
            stack.append([known, child & ~ends.get(depth + 1, 0), 0, 0, 0])
            continue
        stack.pop()
        n, ended = bits.bit_count(), sorted(members(bits & ends.get(depth, 0), ids))
        text = ",".join(map(str, ended))
        if not is_open:
            leaves += not children
            saved += (n - 1) * size
            above = stack[-1]
            above[2], above[3], above[4] = above[2] + 1, above[3] + leaves, above[4] + saved
            text = hashlib.sha256(text.encode()).hexdigest()
        out.append((name, parent, parent_least, depth, least, size, is_open, n, children, leaves, saved, text, ended[0] if ended else None))
    return out


def _shards(batches):
    ids, paths, sizes, turns = [], [], [], 0

    def close():
        columns = zip(*shard_nodes(ids, paths, sizes))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SHARD_TYPES)], NODE_NAMES)

    for batch in batches:
        for i in range(batch.num_rows):
            path = batch.column("path")[i].as_py()
            if ids and (len(ids) >= SHARD_CONVERSATIONS or turns + len(path) > SHARD_TURNS):
                yield close()
                ids, paths, sizes, turns = [], [], [], 0
            ids.append(batch.column("conv_id")[i].as_py())
            paths.append(path)
            sizes.append(batch.column("sizes")[i].as_py())
            turns += len(path)
    if ids:
        yield close()


SHARD_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.int64()]


# --- all shards -----------------------------------------------------------------------------------------------------------------------


def _stream_digests(batches):
    """Rows (node, first_end, ends) sorted by both: the digest of each node's joined list. Memory holds one chunk."""
    now, digest = None, None
    for batch in batches:
        out = []
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
                digest.update(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out])], ["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def subtree_sums(nodes: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """nodes(node, parent, columns): each column summed over the node's subtree, by pointer jumping.

    After round i a node has the sums over what lies less than 2^i below it and knows its ancestor 2^i above.
    """
    now = nodes.select("node", F.col("parent").alias("above"), *columns)
    reach = 1
    while reach <= depth:
        now = stored(now, "jump")
        given = now.where("above is not null").groupBy("above").agg(*[F.sum(c).alias(f"_{c}") for c in columns]).withColumnRenamed("above", "_to")
        higher = now.select(F.col("node").alias("_at"), F.col("above").alias("_above"))
        # a hot ancestor is one row of ``given``, and one key of ``higher``: rows below it are as many as open nodes at one depth
        now = now.join(given, F.col("node") == F.col("_to"), "left").join(higher, F.col("above") == F.col("_at"), "left").select(
            "node", F.col("_above").alias("above"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]
        )
        reach *= 2
    return now.drop("above")


def prefix_trie(lists: DataFrame) -> DataFrame:
    """``lists(conv_id, turns)`` to one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = lists.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.size").alias("sizes"))
    rows = stored(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_shards, NODE), "trie-shards")
    # finished nodes know all but their parent's smallest member, which an open parent learns from other shards
    partial = rows.where("open")
    merged = stored(
        partial.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        ),
        "trie-open",
    )
    kids = merged.where("parent is not null").groupBy("parent").agg(F.count("*").alias("_kids")).withColumnRenamed("parent", "_p")
    grown = merged.join(kids, F.col("node") == F.col("_p"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    own = grown.select(
        "node", "parent", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    deepest = merged.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, ["n_leaves", "saved"], deepest)
    chunks = partial.where("first_end is not null").select("node", "first_end", "ends")
    digests = chunks.repartition(parts, "node").sortWithinPartitions("node", "first_end").mapInArrow(_stream_digests, "node binary, ends_sha256 string")
    opened = grown.drop("n_leaves", "saved").join(sums, "node").join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    done = rows.where("not open").withColumnRenamed("ends", "ends_sha256")
    # the smallest member of an open parent; salted, as the root may have any number of children
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = merged.select(F.col("node").alias("_node"), F.col("conv_id").alias("_least"), salts.alias("_to"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    below = done.where("parent_conv_id is null").select("node", "parent", *columns).union(opened.select("node", "parent", *columns))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    joined = below.withColumn("_salt", salt).join(least, (F.col("parent") == F.col("_node")) & (F.col("_salt") == F.col("_to")), "left")
    nodes = done.where("parent_conv_id is not null").select("parent_conv_id", *columns).union(joined.select(F.col("_least").alias("parent_conv_id"), *columns))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), crc_step AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM range(256) r(i)
), crc AS (SELECT list(v ORDER BY i) AS tab FROM crc_step
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
              lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, t.n, t.role, t.text, 0 AS own FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h
  UNION ALL SELECT c.conv_id, t.n, t.role, t.text, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h
), o AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS size,
         md5(string_agg(md5(length(role) || ':' || role || ':' || text), '') OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, n)
), p AS (
  SELECT conv_id, depth, size, node FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c
), q AS (
  SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ended FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM q GROUP BY node
), k AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.node) AS n_children FROM n
), s AS (
  SELECT a.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved
  FROM k JOIN p a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.node
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN k u ON u.node = k.parent
"""


@query("op13_prefix_trie", ORACLE)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(with_shared_starts(turn_lists(table(spark, folder, "conversations"))))
