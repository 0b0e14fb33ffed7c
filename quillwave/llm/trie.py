"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns; the conversations that begin with
it are its members. A shard holds the conversations of one range of ids and one
block of turn positions. In it, an index maps each (position, turn) to the
bitset of conversations that have this turn there. Depth first, the bitset of a
node is intersected with the postings of the next position: each result that
isn't empty is a child, its popcount the number of members, its lowest bit the
smallest member, and the bits without a next turn the end list.

Nodes of different shards are the same if their fingerprints are: the exclusive
or of two 64-bit hashes of (position, turn) over the path. It needs no order,
so the state at the start of a later block is known without walking the blocks
before it. Node counts add up over shards, end lists follow each other in the
order of the shards.

A shard has at most ``per_shard`` conversations and ``per_block`` positions,
whatever first turn most conversations share and however long one of them is.
Sums over subtrees go up by doubled steps, only over nodes with two members or
more; a node with one member is a chain whose sums are known. The digest of an
end list has to be taken in order, so the list of one node passes through one
task, as a stream of one text per shard.

Defined results: null roles and texts are empty; rows without a conversation id
take no part. Turns with equal numbers are ordered by their digest; repeated
rows are repeated turns. Extra columns are not read. No rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema, written
from quillwave.llm.turns import numbered, turns

_NODE = "f1 bigint, f2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n bigint, last_bytes bigint, shard bigint, ends string, n_ends bigint"
_KEY = ["f1", "f2"]


def rebuilt(conversations: DataFrame, family: int = 5, most_shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, n_bytes) of rebuilt conversations, and all their ids.

    Conversation c takes the first h turns of conversation c - c % family, with
    h = crc32(c) % most_shared, and goes on with its own after its first h.
    """
    rows = turns(conversations.where("conv_id IS NOT NULL"))
    rows = rows.select("conv_id", "turn", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    own = written(numbered(rows).select("conv_id", "pos", "digest", "n_bytes"), "turns")
    head = F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes")))
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("pos") < most_shared - 1)).groupBy("conv_id").agg(head.alias("_head"))
    names = own.select("conv_id").distinct()
    names = names.withColumn("_from", F.col("conv_id") - F.col("conv_id") % family)
    names = names.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int"))
    joined = names.join(heads.withColumnRenamed("conv_id", "_from"), "_from", "left")
    taken = F.when(F.col("_h") > 0, F.slice("_head", F.lit(1), F.greatest("_h", F.lit(1))))
    joined = written(joined.select("conv_id", "_h", taken.alias("_head"), F.coalesce(F.size(taken), F.lit(0)).alias("_taken")), "heads")
    first = joined.select("conv_id", F.explode("_head").alias("_t")).select("conv_id", "_t.pos", "_t.digest", "_t.n_bytes")
    rest = own.join(joined.select("conv_id", "_h", "_taken"), "conv_id").where("pos >= _h")
    rest = rest.select("conv_id", (F.col("_taken") + F.col("pos") - F.col("_h")).alias("pos"), "digest", "n_bytes")
    return first.unionByName(rest), joined.select("conv_id")


def _grown(key: tuple, group: pa.Table, per_block: int, arrow: pa.Schema) -> pa.Table:
    """The nodes of one shard: a depth-first walk over bitsets of its conversations."""
    shard, block = (k.as_py() for k in key)
    held = group.to_pydict()
    names = sorted(set(held["conv_id"]))
    place = {name: i for i, name in enumerate(names)}
    postings: dict[tuple, int] = defaultdict(int)
    paths: list[dict] = [{} for _ in names]
    marks: dict[str, tuple] = {}
    starts: dict[tuple, int] = defaultdict(int)
    for name, pos, digest, z1, z2, size in zip(*(held[c] for c in ("conv_id", "pos", "digest", "z1", "z2", "n_bytes"))):
        bit = 1 << place[name]
        if digest is None:
            starts[z1, z2] |= bit
        else:
            postings[pos, digest] |= bit
            paths[place[name]][pos] = digest
            marks[pos, digest] = (z1, z2, size)

    out: list[tuple] = []
    stop = (block + 1) * per_block
    for (f1, f2), members in starts.items():
        stack = [(members, block * per_block, f1, f2, None, None, 0, block == 0)]
        while stack:
            bits, depth, f1, f2, p1, p2, size, counted = stack.pop()
            ended, left = 0, bits if depth < stop else 0
            while left:
                low = left & -left
                digest = paths[low.bit_length() - 1].get(depth)
                if digest is None:
                    ended |= low
                    left ^= low
                    continue
                child = bits & postings[depth, digest]
                left &= ~child
                z1, z2, child_size = marks[depth, digest]
                stack.append((child, depth + 1, f1 ^ z1, f2 ^ z2, f1, f2, child_size, True))
            if counted or ended:
                ends, bit = [], ended
                while bit:
                    low = bit & -bit
                    ends.append(str(names[low.bit_length() - 1]))
                    bit ^= low
                least = names[(bits & -bits).bit_length() - 1]
                out.append((f1, f2, p1, p2, depth, least, bits.bit_count() if counted else 0, size, shard, ",".join(ends) if ends else None, len(ends)))
    columns = list(zip(*out)) or [()] * len(arrow)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def shard_nodes(rows: DataFrame, names: DataFrame, per_shard: int = 2048, per_block: int = 128) -> DataFrame:
    """Nodes of all shards, each with its part of the members and of the end list."""
    z1 = F.xxhash64(F.lit(1), "pos", "digest").alias("z1")
    z2 = F.xxhash64(F.lit(2), "digest", "pos").alias("z2")
    block = F.floor(F.col("pos") / per_block).alias("block")
    marked = rows.select("conv_id", block, "pos", "digest", z1, z2, "n_bytes")
    # Where later blocks of long conversations begin: all of the blocks before.
    long = written(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= per_block), "long")
    sums = marked.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = sums.select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("z1").over(before).alias("z1"), F.bit_xor("z2").over(before).alias("z2"))
    # The mark after the last block is there only if that one is full: there the conversation ends.
    later = later.join(long, "conv_id").where(F.col("block") * per_block <= F.col("_n")).drop("_n")
    first = names.select("conv_id", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("z1"), F.lit(0).cast("bigint").alias("z2"))
    begin = first.unionByName(later).select(
        "conv_id", "block", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("digest"), "z1", "z2", F.lit(0).cast("bigint").alias("n_bytes")
    )
    arrow = arrow_schema(_NODE)
    shards = marked.unionByName(begin).withColumn("shard", F.floor(F.col("conv_id") / per_shard))

    def grow(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _grown(key, group, per_block, arrow)

    return written(shards.groupBy("shard", "block").applyInArrow(grow, _NODE), "nodes")


def end_digests(parts: DataFrame) -> DataFrame:
    """(f1, f2, ends_sha256) of the nodes where conversations end; the parts of a list pass in the order of ids."""
    schema = "f1 bigint, f2 bigint, ends_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, out = None, None, []
        for batch in batches:
            for f1, f2, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or (f1, f2) != key:
                    if running is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = (f1, f2), hashlib.sha256(ends.encode())
                else:
                    running.update(f",{ends}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if running is not None:
            out = [(*key, running.hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    lists = parts.where("ends IS NOT NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "shard")
    return lists.select(*_KEY, "ends").mapInArrow(run, schema)


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(f1, f2, values): sums over the subtree of each node of the written table (f1, f2, p1, p2, values).

    After k rounds a node has the sum over the descendants less than 2^k steps
    below, and points to its ancestor 2^k steps above; the next round adds what
    the nodes exactly 2^k steps below have.
    """
    held = tree.select(*_KEY, "p1", "p2", *values)
    while not held.where("p1 IS NOT NULL").isEmpty():
        below = held.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(*[F.sum(v).alias(f"_{v}") for v in values])
        added = held.join(below.withColumnsRenamed({"p1": "f1", "p2": "f2"}), _KEY, "left")
        above = held.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
        held = written(
            added.join(above, ["p1", "p2"], "left").select(
                *_KEY, F.col("_p1").alias("p1"), F.col("_p2").alias("p2"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
            ),
            "sums",
        )
    return held.select(*_KEY, *values)


def trie(rows: DataFrame, names: DataFrame, per_shard: int = 2048, per_block: int = 128) -> DataFrame:
    """All nodes of turns (conv_id, pos, digest, n_bytes) of the conversations ``names`` (conv_id).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    parts = shard_nodes(rows, names, per_shard, per_block)
    whole = parts.groupBy(*_KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("last_bytes").alias("last_bytes"), F.sum("n_ends").alias("n_ends"),
    )
    whole = written(whole, "trie")
    one = F.col("n_convs") == 1
    below = whole.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(one, 1)).alias("_chains"))
    shared = whole.where(~one).join(below.withColumnsRenamed({"p1": "f1", "p2": "f2"}), _KEY, "left").na.fill(0, ["n_children", "_chains"])
    own = shared.select(
        *_KEY, "p1", "p2", "n_children",
        (F.col("_chains") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved_tokens"),
    )
    own = written(own, "shared")
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"]).join(own.select(*_KEY, "n_children"), _KEY)
    parents = whole.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(sums, _KEY, "left").join(end_digests(parts), _KEY, "left").join(parents, ["p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
