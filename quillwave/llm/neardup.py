"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its shingles of ``words`` words (A-Z lower-cased),
each a 64-bit hash of its words. Documents with equal sets are one class; its
smallest id represents it. Each class has a vector of minwise tokens.
Independent trees branch the classes: a node picks one or two coordinates of
the vector (1 / similarity on average) and sends each class on by its token
there. Nodes of at most ``limit`` classes are compared exhaustively; larger
ones branch again.

One tree goes first and only links large nodes: their members are compared with
their middle, the member nearest to the majority of all in the bits below. That
is the text that a big group of near copies comes from, whose copies may be
linked by it alone. Then one tree, then all others are compared in full. What is
linked is connected, and no later step compares two connected classes: a node
counts as small if at most ``limit`` of its classes are outside of its largest
connected part, and these meet all the others. Larger nodes branch on, for as
many levels as leave nodes of ``limit`` classes of unlinked texts (each level
shrinks such a node by the similarity at least), or until blocks of them take
fewer rows than the trees have. Nodes that are large even then are compared in
blocks: some of the classes outside with some of all others, each with each, so
none of their pairs is lost.

No step lists the pairs of a node. Sizes and two bits of each minwise token tell
which members may be linked with one outside; their texts go to the node, once a
node, where full sets are compared. A node returns a link of each class outside
with each connected part, and a spanning forest if more than ``limit`` classes
are outside: at most ``limit`` links a member, and fewer than members in a
forest. A pair at the threshold shares a compared node of one tree with a chance that falls with the
levels (0.7 after few); ``trees`` = 8 trees miss it with less than 1e-3 there,
and a group of near copies is held together by many links.

Defined results: null or word-less text has an empty set and is linked with
nothing. Rows that share an id are one document, linked if any of their texts
is. A null id takes no part: its component is null and it is kept. No rows give
no rows. Extra columns are not read. A text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import LOWER_ASCII, arrow_schema, on_batches, written
from quillwave.llm.quality import mixed, word_hashes

_TOKENS = 64
_FACTORS = np.random.default_rng(11).integers(1, 2**62, _TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 8192
# Of 64 two-bit tokens a pair at similarity 0.8 has 9.6 different ones on
# average; more than 24 have a chance below 1e-5.
_FAR = 24
# Classes of a block, outside and in all, and rows that are sent to all tasks.
_ROOM, _MEMBERS, _SENT = 256, 2048, 500_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of fewer words, of the whole sequence."""
    held = word_hashes(np.frombuffer(text.encode().translate(LOWER_ASCII), np.uint8))[2]
    size = min(words, len(held))
    gram = np.zeros(len(held) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        gram = mixed(gram + held[k : len(held) - size + 1 + k] + np.uint64(size))
    return np.unique(gram)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate (32 bits)."""
    least = np.full(_TOKENS, 2**32 - 1, np.uint64)
    for begin in range(0, len(hashes), _STEP):
        part = (hashes[None, begin : begin + _STEP] * _FACTORS[:, None]) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least.astype(np.uint32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, tokens, s1, s2): set size and digest, minwise tokens, two bits of each."""
    places = np.uint64(1) << np.arange(_TOKENS, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        out: list = [batch.column(0), *([] for _ in range(6))]
        for text in batch.column(1).to_pylist():
            held = shingle_hashes(text or "", words)
            tokens = minwise(held)
            bits = [int(places[(tokens >> k) & 1 == 1].sum(dtype=np.uint64).view(np.int64)) for k in (7, 19)]
            digest = np.frombuffer(hashlib.blake2b(held.tobytes(), digest_size=16).digest(), "<i8").tolist()
            for column, value in zip(out[1:], (len(held), *digest, tokens.view(np.int32).tolist(), *bits)):
                column.append(value)
        yield out

    schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, tokens array<int>, s1 bigint, s2 bigint"
    return on_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def _near(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1).bitwiseOR(a2.bitwiseXOR(b2))) <= _FAR


def _branch(rows: DataFrame, similarity: float) -> DataFrame:
    """Children of each (node, tokens): one coordinate, and another with the chance that makes 1 / similarity."""
    draw = F.xxhash64("node", F.lit("draw"))
    first = F.pmod(draw, F.lit(_TOKENS)).cast("int")
    other = F.pmod(first + 1 + F.pmod(F.shiftright(draw, 16), F.lit(_TOKENS - 1)).cast("int"), F.lit(_TOKENS))
    twice = F.pmod(F.shiftright(draw, 32), F.lit(1000)) < F.lit(int(1000 * (1 / similarity - 1)))
    taken = F.when(twice, F.array(first, other)).otherwise(F.array(first))
    return rows.withColumn("_at", F.explode(taken)).select(
        F.xxhash64("node", "_at", F.element_at("tokens", F.col("_at") + 1)).alias("node"), "rep", "s1", "s2", "size", "known"
    )


def _with_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (id, ...) with their texts, which are not moved for it as long as few rows are wanted."""
    return texts.where("id IS NOT NULL AND text IS NOT NULL").join(_sent(wanted), "id")


def _sent(rows: DataFrame) -> DataFrame:
    """Written ``rows`` for a join, sent to all tasks if they are few: the wide side stays in place then."""
    return F.broadcast(rows) if rows.count() <= _SENT else rows


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int, together: int = 64) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.

    The texts b of one a are dealt over groups of about ``together``; each
    group gets the text a once.
    """
    schema = "a bigint, b bigint"
    arrow = arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        held: dict = {True: [], False: []}
        for name, text, head in zip(*(group.column(c).to_pylist() for c in ("id", "text", "head"))):
            held[head].append((name, shingle_hashes(text, words)))
        out: tuple[list, list] = ([], [])
        for a, left in held[True]:
            for b, right in held[False]:
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    out[0].append(a)
                    out[1].append(b)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    pairs = written(pairs.distinct(), "pairs")
    counts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("parts")), "parts")
    members = pairs.join(counts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(False).alias("head"))
    heads = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    heads = heads.select(F.col("a").alias("id"), "a", "part", F.lit(True).alias("head"))
    used = _with_texts(written(members.unionByName(heads), "wanted"), texts)
    return written(used.groupBy("a", "part").applyInArrow(run, schema).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for all ids in ``edges`` (a, b).

    Large-star and small-star steps: each id hangs its larger, then its smaller
    neighbours below the smallest one it knows, until nothing changes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")), "least").withColumn("m", F.least("a", "m"))
        edges = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(hung.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return least.select(F.col("a").alias("id"), F.col("m").alias("component"))
        before = now


def _middles(large: DataFrame, sample: int = 63) -> DataFrame:
    """(node, hub): of each node (node, rep, s1, s2, known, n) the member that differs least from the majority of bits.

    The majority is that of about ``sample`` members chosen by hash; it only
    picks the hub, which all members are compared with.
    """
    few = large.where(F.pmod(F.xxhash64("rep", "node", "n"), F.ceil(F.col("n") / sample)) == 0)
    listed = few.groupBy("node").agg(F.collect_list("s1").alias("_l1"), F.collect_list("s2").alias("_l2"))

    def majority(held: str) -> Column:
        def step(bits: Column, k: Column) -> Column:
            ones = F.aggregate(held, F.lit(0).cast("bigint"), lambda n, x: n + F.call_function("shiftright", x, k).bitwiseAND(F.lit(1)))
            one = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
            return bits.bitwiseOR(F.when(2 * ones > F.size(held), one).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), step)

    middle = written(listed.select("node", majority("_l1").alias("_m1"), majority("_l2").alias("_m2")), "middles")
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("_m1")).bitwiseOR(F.col("s2").bitwiseXOR(F.col("_m2"))))
    nearest = F.min(F.struct(far.alias("far"), "rep", "s1", "s2", "known")).alias("hub")
    return written(large.join(middle, "node").groupBy("node").agg(nearest), "hubs")


def _descended(
    reps: DataFrame, trees: range, similarity: float, limit: int, levels: int, enough: int, hubs: bool = False
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Branch (rep, tokens, s1, s2, size, known) by all ``trees``: pairs with hubs, if wanted, and nodes to compare.

    ``known`` names what is connected already. A node is small if at most
    ``limit`` members are outside of its largest connected part; nodes without
    such members are dropped. Branching ends when blocks of all large nodes
    take ``enough`` rows or fewer, and after all ``levels``.
    """
    roots = F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree")
    rows = _branch(reps.select("*", roots).withColumn("node", F.xxhash64("tree", F.lit("root"))), similarity)
    stars, nodes = [], []
    for level in range(1, levels + 1):
        rows = written(rows, "nodes")
        parts = rows.groupBy("node", "known").agg(F.count(F.lit(1)).alias("n"))
        sizes = parts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "known")).alias("_m"))
        sizes = sizes.select("node", "n", F.col("_m.known").alias("most"), (F.col("n") - F.col("_m.n")).alias("others"))
        placed = written(rows.join(written(sizes.where("others > 0"), "sizes"), "node"), "placed")
        placed = placed.withColumn("outside", F.col("known") != F.col("most")).drop("most")
        crowded = (F.col("others") > limit) | (F.col("n") > _MEMBERS)
        nodes.append(placed.where(~crowded).drop("n", "others"))
        nodes.append(_blocks(placed.where(crowded & (F.col("others") <= limit))))
        large = placed.where(F.col("others") > limit)
        left = large.agg(F.sum(F.ceil(F.col("others") / _ROOM)).alias("rows")).first()["rows"]
        if left is None:
            return stars, nodes
        if hubs:
            near = _near(F.col("s1"), F.col("s2"), F.col("hub.s1"), F.col("hub.s2"))
            around = large.join(_middles(large), "node").where((F.col("known") != F.col("hub.known")) & near)
            stars.append(around.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")))
        if left <= enough:
            break
        if level < levels:
            own = _sent(large.select("node", "rep", "s1", "s2", "size", "known"))
            rows = _branch(own.join(reps.select("rep", "s1", "s2", "tokens"), ["rep", "s1", "s2"]), similarity)
    return stars, [*nodes, _blocks(large)]


def _blocks(large: DataFrame) -> DataFrame:
    """Large nodes as small ones: some of those outside of the largest connected part, with some of all members."""
    parts, shares = F.ceil(F.col("others") / _ROOM), F.ceil(F.col("n") / _MEMBERS)
    dealt = large.withColumns({"_own": F.pmod(F.xxhash64("rep", "node"), parts), "_share": F.pmod(F.xxhash64("node", "rep"), shares)})
    held = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    held = held.where(~F.col("outside") | (F.col("_own") != F.col("_part"))).withColumn("outside", F.lit(False))
    met = dealt.where("outside").withColumn("_part", F.col("_own")).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)))
    both = held.unionByName(met).withColumn("node", F.xxhash64("node", "_part", "_share"))
    return both.select("node", "rep", "s1", "s2", "size", "known", "outside")


def _met(node: np.ndarray, outside: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of each node, about ``most`` at a time: j is outside. Rows are in the order of their nodes."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    sizes = np.diff(np.r_[starts, len(node)])
    chosen = np.flatnonzero(outside)
    owner = np.repeat(np.arange(len(starts)), sizes)[chosen]
    counts, begins = sizes[owner], starts[owner]
    ends = np.cumsum(counts)
    at = 0
    while at < len(chosen):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + most, "right")))
        n = counts[at:stop]
        j = np.repeat(chosen[at:stop], n)
        i = np.arange(n.sum()) + np.repeat(begins[at:stop] - np.cumsum(n) + n, n)
        once = ~outside[i] | (i < j)
        yield i[once], j[once]
        at = stop


def _close(nodes: DataFrame, percent: int, groups: int) -> DataFrame:
    """Members (node, rep, known, outside) that may be linked with one of the few outside that they aren't connected with."""
    schema = "node bigint, rep bigint, known bigint, outside boolean"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, known, size, s1, s2 = (group.column(c).to_numpy() for c in ("node", "known", "size", "s1", "s2"))
        outside = group.column("outside").to_numpy()
        found = np.zeros(len(node), bool)
        for i, j in _met(node, outside):
            far = np.bitwise_count(((s1[i] ^ s1[j]) | (s2[i] ^ s2[j])).view(np.uint64))
            fits = (known[i] != known[j]) & (far <= _FAR)
            i, j = i[fits], j[fits]
            fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            found[i[fits]] = found[j[fits]] = True
        return group.select(["node", "rep", "known", "outside"]).filter(pa.array(found))

    dealt = nodes.withColumn("_group", F.pmod(F.xxhash64("node"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, schema)


def _linked(nodes: DataFrame, texts: DataFrame, percent: int, words: int, limit: int, groups: int) -> DataFrame:
    """Links (a, b) of members of ``nodes``, on full sets.

    Each class outside has one with each connected part that it is linked with;
    with more than ``limit`` outside, links that would close a circle are left out.
    """
    schema = "a bigint, b bigint"
    arrow = arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, rep, known = (group.column(c).to_numpy() for c in ("node", "id", "known"))
        outside, held = group.column("outside").to_numpy(), group.column("text").to_pylist()
        sets = {text: shingle_hashes(text, words) for text in set(held)}
        out: tuple[list, list] = ([], [])
        bounds = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        for begin, end in zip(bounds[:-1], bounds[1:]):
            members = np.array([k for k in range(begin, end) if len(sets[held[k]])])
            if len(members) < 2:
                continue
            sizes = np.array([len(sets[held[k]]) for k in members])
            ends = np.cumsum(sizes)
            coded = np.unique(np.concatenate([sets[held[k]] for k in members]), return_inverse=True)[1]
            marked = np.zeros(coded.max() + 1, np.int32)
            part, few = known[members], outside[members]
            forest = few.sum() > limit
            for j in np.flatnonzero(few):
                own = coded[ends[j] - sizes[j] : ends[j]]
                marked[own] = 1
                both = np.add.reduceat(marked[coded], ends - sizes)
                marked[own] = 0
                fits = (100 * both >= percent * (sizes + sizes[j] - both)) & (part != part[j])
                fits &= ~few | (np.arange(len(few)) < j)
                for i in np.flatnonzero(fits)[np.unique(part[fits], return_index=True)[1]]:
                    out[0].append(rep[members[i]])
                    out[1].append(rep[members[j]])
                    if forest:
                        part[part == part[i]] = part[j]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    close = written(_close(nodes, percent, groups).distinct().withColumnRenamed("rep", "id"), "close")
    few = max(1, close.count() // 512)
    used = _with_texts(close, texts).withColumn("_group", F.pmod(F.xxhash64("node"), F.lit(few)))
    return written(used.groupBy("_group").applyInArrow(run, schema).distinct(), "links")


def link(
    docs: DataFrame, percent: int = 80, words: int = 2, trees: int = 8, limit: int = 16, levels: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, class membership (doc_id, rep) of repeated sets, and confirmed links (a, b) between classes.

    ``levels`` defaults to those that shrink all classes by ``percent`` a level to ``limit``.
    """
    similarity = percent / 100
    sets = written(signatures(docs, words), "signatures")
    usable = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    repeated = written(classes.where("n > 1").select("f1", "f2", "rep"), "classes")
    members = usable.select("doc_id", "f1", "f2").join(repeated, ["f1", "f2"]).select("doc_id", "rep").where("doc_id <> rep")
    # A document with an id below others of its class stands for it; single ones stand for themselves.
    others = written(members, "members")
    reps = usable.join(others, usable["doc_id"] == others["doc_id"], "left_anti").dropDuplicates(["doc_id", "f1", "f2"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), "tokens", "s1", "s2", F.col("n_shingles").alias("size")), "reps")
    count = reps.count()
    if levels is None:
        levels = max(6, math.ceil(math.log(max(count / limit, 1)) / -math.log(similarity)))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    stars, _ = _descended(reps.withColumn("known", F.col("rep")), range(1), similarity, limit, min(levels, 4), 0, hubs=True)
    nothing = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    links = _confirmed(reduce(DataFrame.unionByName, stars, nothing), texts, percent, words)
    for some in (range(1), range(1, trees)):
        if not some:
            continue
        known = written(components(links).toDF("rep", "known"), "known")
        named = written(reps.join(_sent(known), "rep", "left").withColumn("known", F.coalesce("known", "rep")), "reps")
        _, nodes = _descended(named, some, similarity, limit, levels, count * len(some) // 2)
        groups = max(1, count * len(some) // 8192)
        links = links.unionByName(_linked(reduce(DataFrame.unionByName, nodes), texts, percent, words, limit, groups))
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return sets, others, written(links.distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 2, trees: int = 8, limit: int = 16, levels: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and its class's number of links."""
    sets, members, links = link(docs, percent, words, trees, limit, levels)
    named = components(
        links.unionByName(members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    )
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    rows = sets.select("doc_id", "n_shingles").join(named.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rows = rows.join(degree.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
