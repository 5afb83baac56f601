"""Operator 12, conversation prefix trie: what conversations share from their first turn on.

A node is a sequence of first turns. It belongs to its smallest member; then it is the owner of the rest of its own path, so each conversation owns
a suffix of its path. With `rest`, the bytes of a conversation from a depth on, all nodes below a node have n_convs x bytes summed up in its
members' `rest`, and bytes (once each) in the members' rest within what they own. So one group-by over prefixes sums the difference, and leaves
are the members that own a childless end.

Turns become 128-bit digests of their SHA-256 and their place, and a prefix their XOR, which is a running aggregate; no prefix is written out.
Hot keys: conversations are numbered across range partitions and cut into blocks of turns, so no window holds more than BLOCK turns of a
conversation or one row a partition or block; owners are aggregated minima, joined back by `join_counted`, where a window over a prefix would put
all members of the root in one task. The members that end in a node are joined in pieces, in all tasks; only the SHA-256 over the pieces of one node,
which can't be split, streams through one task, in bounded memory.

Cases: a null role or text is empty; rows without conv_id are left out; a null turn is first; equal turns go by role, then text, and repeated rows
are several turns; a conversation without turns is a member of the root; texts and conversations of any length are read whole; without rows there
is no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumetry.llm.common import join_counted, map_batches, saved, small, table

#: Turns of a conversation that a window holds at most, and broadcast rows of carried sums.
BLOCK, FEW_ROWS = 1024, 100_000
#: Conversations whose ids make one piece of a digested list.
PIECE = 4096
KEY = ("depth", "ka", "kb")


def digests(role: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of the SHA-256 of a turn."""
    whole = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole)


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, a, b, bytes) of rows (conv_id, turn, role, text), pos in the order of turns."""
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    a, b = digests(F.col("role"), F.col("text"))
    sorted_ = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    sorted_ = sorted_.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), a.alias("a"), b.alias("b"), F.octet_length("text").cast("long").alias("bytes"))
    sorted_ = saved(sorted_, "turns")
    earlier = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one row a partition: those where a conversation goes on
    carried = sorted_.groupBy("conv_id", "part").count().withColumn("carried", earlier).where("carried IS NOT NULL").drop("count")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    placed = sorted_.withColumn("local", local).join(F.broadcast(carried), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("local") + F.coalesce("carried", F.lit(0))).alias("pos"), "a", "b", "bytes")


def whole_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, n, depth, a, b, bytes): turns (conv_id, pos, ...) as paths, each from a root at depth 0 on."""
    lengths = saved(turns.groupBy("conv_id").agg(F.max("pos").cast("long").alias("n")), "lengths")
    root = lengths.select("conv_id", "n", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")))
    return join_counted(turns, lengths, ["conv_id"], "n").select("conv_id", "n", F.col("pos").cast("long").alias("depth"), "a", "b", "bytes").unionByName(root)


def rebuilt(turns: DataFrame, siblings: int = 5, heads: int = 9) -> DataFrame:
    """Paths like whole_paths, where conversation c starts with the first h turns of conversation c - c % siblings in place of its own first h;
    h is the checksum of c modulo `heads`."""
    c = F.col("conv_id")
    lengths = saved(turns.groupBy("conv_id").agg(F.max("pos").cast("long").alias("own")), "lengths")
    base = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    facts = lengths.withColumns({"base": c - c % siblings, "h": F.crc32(c.cast("string").cast("binary")) % heads}).join(base, "base", "left")
    taken = F.least(F.coalesce("of_base", F.lit(0)), "h")
    facts = saved(facts.withColumn("taken", taken).withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    shared = facts.select("conv_id", "base", "h", "n").join(first, "base").where("pos <= h").select("conv_id", "n", F.col("pos").cast("long").alias("depth"), "a", "b", "bytes")
    rest = join_counted(turns, facts.select("conv_id", "own", "h", "taken", "n"), ["conv_id"], "own").where("pos > h")
    rest = rest.select("conv_id", "n", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "bytes")
    root = facts.select("conv_id", "n", *(F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "bytes")))
    return root.unionByName(shared).unionByName(rest)


def prefixes(paths: DataFrame) -> DataFrame:
    """(conv_id, n, depth, ka, kb, pa, pb, rest): each step of a path with the keys of its prefix and of the prefix before it, and the bytes
    from here on."""
    here = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "a", "b")).otherwise(F.lit(0).cast("long"))
    steps = paths.select("conv_id", "n", "depth", here(0).alias("xa"), here(1).alias("xb"), "bytes", F.floor(F.col("depth") / BLOCK).alias("block"))
    block = Window.partitionBy("conv_id", "block")
    so_far = block.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"ka": F.bit_xor("xa").over(so_far), "kb": F.bit_xor("xb").over(so_far), "rest": F.sum("bytes").over(block) - F.sum("bytes").over(so_far) + F.col("bytes")})
    steps = saved(steps, "steps")
    # conversations of several blocks: what comes before and behind each block
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.where(F.col("n") >= BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    earlier = {c: F.coalesce(F.bit_xor(c[-2:]).over(before), zero) for c in ("before_xa", "before_xb")}
    earlier["behind"] = F.sum("bytes").over(whole) - F.coalesce(F.sum("bytes").over(before), zero) - F.col("bytes")
    blocks = saved(blocks.withColumns(earlier).select("conv_id", "block", *earlier), "blocks")
    joined = steps.join(small(blocks, FEW_ROWS), ["conv_id", "block"], "left")
    ka, kb = (F.col(k).bitwiseXOR(F.coalesce(f"before_{x}", zero)) for k, x in (("ka", "xa"), ("kb", "xb")))
    rest = F.col("rest") + F.coalesce("behind", zero)
    return joined.select("conv_id", "n", "depth", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("xa")).alias("pa"), kb.bitwiseXOR(F.col("xb")).alias("pb"), rest.alias("rest"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows (depth, ka, kb, conv_id) as pieces (depth, ka, kb, first id, ids joined by commas), PIECE ids at most."""
    for batch in batches:
        ids = batch["conv_id"].to_pylist()
        keys = np.stack([batch[k].to_numpy() for k in KEY], axis=1)
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))[: len(keys)]
        starts = np.flatnonzero(new).tolist()
        cuts = sorted({*starts, *(k for s, e in zip(starts, [*starts[1:], len(ids)], strict=True) for k in range(s, e, PIECE))})
        pieces = [",".join(map(str, ids[s:e])) for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        first = batch.take(pa.array(cuts, pa.int64()))
        yield pa.RecordBatch.from_arrays([*first.columns, pa.array(pieces, pa.string())], names=[*first.schema.names, "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node; pieces are sorted, and only the open node's state is kept between batches."""
    key, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch[k].to_pylist() for k in (*KEY, "ids")]
        for *own, ids in zip(*columns, strict=True):
            if own != key:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(rows)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def ends(steps: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of the nodes in which conversations end: the digest of their ids, ascending and joined by commas."""
    last = steps.where("depth = n").select(*KEY, "conv_id")
    key = "depth long, ka long, kb long"
    pieces = last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_joined, f"{key}, conv_id long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(_hashed, f"{key}, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all paths."""
    steps = saved(prefixes(paths), "prefixes")
    owners = saved(steps.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("n").alias("longest"), F.count("*").alias("n_convs")), "owners")
    met = join_counted(steps, owners, list(KEY), "n_convs")
    owned, zero = F.col("owner") == F.col("conv_id"), F.lit(0).cast("long")
    leaf = owned & (F.col("depth") == F.col("n")) & (F.col("longest") == F.col("depth"))
    # `rest` only falls along a path: the greatest one of a conversation's own nodes is what it owns
    of_conv = met.groupBy("conv_id").agg(F.coalesce(F.max(F.when(owned, F.col("rest"))), zero).alias("owned"), F.max(leaf.cast("long")).alias("leaf"), F.count("*").alias("steps"))
    of_conv = saved(of_conv, "owned")
    shared = F.greatest(F.col("rest") - F.col("owned"), zero)
    nodes = join_counted(steps, of_conv, ["conv_id"], "steps").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"),
    )
    nodes = saved(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    children = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, list(KEY), "left").join(ends(steps), list(KEY), "left").fillna({"n_children": 0})
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = saved(full.withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie")
    parents = full.where("n_children > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    found = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = join_counted(full.where("depth > 0").select(*up, *found), parents, list(KEY), "siblings").withColumn("depth", F.col("depth") + 1).drop("ka", "kb", "siblings")
    top = full.where("depth = 0").select("depth", *found).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "numbered")
    return trie(rebuilt(turns))


#: The checksum is computed bit by bit; subtrees are summed over all ancestors of every node.
ORACLE_SQL = """
WITH r AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT DISTINCT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
    FROM r),
c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce(steps, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, 4294967295::BIGINT),
               4294967295::BIGINT) % 9 AS h
    FROM bits),
taken AS (
    SELECT c.conv_id, 0 AS part, pos, t FROM c JOIN r ON r.conv_id = base AND pos <= h
    UNION ALL
    SELECT c.conv_id, 1 AS part, pos, t FROM c JOIN r USING (conv_id) WHERE pos > h),
lists AS (
    SELECT conv_id, list(t ORDER BY part, pos) AS path FROM taken GROUP BY conv_id),
p AS (
    SELECT conv_id, coalesce(path, []) AS path FROM c LEFT JOIN lists USING (conv_id)),
steps AS (
    SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM p),
nodes AS (
    SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM steps GROUP BY ALL),
up AS (
    SELECT *, longest = depth AS childless, unnest(range(0, depth + 1)) AS above, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(prefix[depth].text) ELSE 0 END AS saved FROM nodes),
below AS (
    SELECT above AS depth, prefix[1:above] AS prefix, count(*) FILTER (childless) AS n_leaves, sum(saved)::BIGINT AS saved_tokens,
           count(*) FILTER (depth = above + 1) AS n_children
    FROM up GROUP BY ALL)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, n_children, n_leaves, saved_tokens, k.ends_sha256
FROM nodes k JOIN below USING (depth, prefix) LEFT JOIN nodes q ON q.depth = k.depth - 1 AND q.prefix = k.prefix[1:k.depth - 1]
"""
