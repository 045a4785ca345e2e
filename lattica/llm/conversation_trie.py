"""The prefix trie of conversations, with totals over every subtree by time-forward processing.

A node is known by a 128-bit digest of its turns, a sum (exclusive or) of one digest for each turn and place, so that prefixes
of one conversation can be made in blocks. Its least member and its depth name it from then on. Subtrees with a bounded number of
rows below them are shards: a task sorts their nodes by reverse level order, and each node hands its totals to its parent
through a priority queue that spills to disk. Nodes above the shards take in the totals of shard roots; they are cut into
segments of bounded depth, whose totals go up through such a queue in one more pass, and then down to the segments' own nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tables import attach, sized, written

#: A subtree with more rows below it than this, and than 1/SHARDS of all rows, isn't worked on in one task.
SHARD_ROWS, SHARDS = 100_000, 4096
#: Turns of a conversation whose prefixes are made in one group; depths of a segment above the shards.
BLOCK, SEGMENT = 8192, 8192
#: Totals that a queue holds in memory.
QUEUE = 200_000
#: Conversations are rebuilt in groups of so many ids, on up to so many turns of the group's first.
GROUP, MOST_SHARED = 5, 8


def shared_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its group, if that has them."""
    return F.crc32(conv.cast("string")) % (MOST_SHARED + 1)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, i, x1, x2, n_bytes: each conversation's turns, numbered from 1, as digests of role and text.

    Sorted by ranges of conversation and turn, so a conversation with very many turns is dealt to several tasks.
    Texts are shuffled only for turns that others of their conversation share.
    """
    text, role, turn = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("")), F.col("turn")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("numbered"), F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"),
    )
    place = ["conv_id", "numbered", "turn"]
    tied = written(rows.groupBy(*place).agg(F.count("*").alias("n_tied")).filter("n_tied > 1"), "tied")
    if tied.isEmpty():
        rows = rows.withColumns({"role": F.lit(""), "text": F.lit("")})
    else:
        rows = attach(rows, tied, place, "n_tied", rows.count())
        rows = rows.withColumns({c: F.when(F.col("n_tied").isNotNull(), F.col(c)).otherwise("") for c in ("role", "text")})
    order = [*place, "role", "text"]
    rows = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    rows = written(rows.select("conv_id", "part", F.row_number().over(within).cast("long").alias("i"), "x1", "x2", "n_bytes"), "turns")
    counts = rows.groupBy("conv_id", "part").count()
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation goes on from earlier ranges in each range
    carried = written(counts.select("conv_id", "part", F.sum("count").over(earlier).alias("before")).filter("before is not null"), "carried")
    rows = rows.join(sized(carried, carried.count()), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "x1", "x2", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x1, x2, n_bytes, length) for the turns of all rebuilt conversations, and (conv_id, length) for each."""
    conv = F.col("conv_id")
    n = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    first = n.select(conv.alias("first"), F.col("n").alias("n_first"))
    lengths = n.withColumn("first", conv - conv % GROUP).join(first, "first", "left")
    own, h = conv == F.col("first"), shared_turns(conv)
    lengths = lengths.withColumns({"skip": F.when(own, 0).otherwise(h), "taken": F.when(own, 0).otherwise(F.least(h, F.coalesce("n_first", F.lit(0))))})
    lengths = written(lengths.select("conv_id", "n", "skip", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("length")), "lengths")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = ["conv_id", "depth", "x1", "x2", "n_bytes", "length"]
    later = attach(turns, lengths, ["conv_id"], "n", total).filter("i > skip").withColumn("depth", F.col("i") - F.col("skip") + F.col("taken"))
    lent = turns.filter((conv % GROUP == 0) & (F.col("i") <= MOST_SHARED)).withColumn("conv_id", F.explode(F.array(*[conv + j for j in range(1, GROUP)])))
    lent = lent.join(lengths.filter("taken > 0"), "conv_id").filter("i <= taken").withColumn("depth", F.col("i"))
    return later.select(*out).unionByName(lent.select(*out)), lengths.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (the digest of the turns up to depth), q1, q2 (of those before), n_bytes, length."""
    depth = F.col("depth")
    turns = turns.select("conv_id", "depth", "n_bytes", "length", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), F.xxhash64("x1", "x2", depth).alias("t1"), F.xxhash64("x2", depth, "x1").alias("t2"))
    up_to = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = written(turns.withColumns({f"p{k}": F.bit_xor(f"t{k}").over(up_to) for k in (1, 2)}), "prefixes")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = inside.filter(f"length > {BLOCK}").groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{k}").alias(f"b{k}") for k in (1, 2)])
    blocks = written(blocks.select("conv_id", "block", *[F.bit_xor(f"b{k}").over(earlier).alias(f"c{k}") for k in (1, 2)]).filter("c1 is not null"), "blocks")
    rows = inside.join(sized(blocks, blocks.count()), ["conv_id", "block"], "left")
    p = {k: F.col(f"p{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2)}
    return rows.select("conv_id", "depth", p[1].alias("p1"), p[2].alias("p2"), p[1].bitwiseXOR(F.col("t1")).alias("q1"), p[2].bitwiseXOR(F.col("t2")).alias("q2"), "n_bytes", "length")


def ends_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: for each node where conversations end, the digest of their ids in order, joined by commas.

    Ids are joined in the tasks of ranges of node and id; only these pieces of up to a batch of ids meet, one after
    another, in the task that makes a node's digest.
    """
    zero = F.lit(0).cast("long")
    ends = rows.filter("depth = length").select("p1", "p2", "conv_id").unionByName(lengths.filter("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, p2, ids = (np.asarray(b[c]) for c in ("p1", "p2", "conv_id"))
            at = np.flatnonzero(np.concatenate(([True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))) if len(ids) else np.zeros(0, np.int64)
            names = ids.astype(str).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (p1, p2, ids)] + [pa.array([",".join(names[i:j]) for i, j in zip(at, [*at[1:], len(ids)])], pa.string())], ["p1", "p2", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for p1, p2, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (p1, p2) == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (p1, p2), hashlib.sha256(ids.encode())
            yield digests(out)
        if node:
            yield digests([(*node, sha.hexdigest())])

    def digests(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["p1", "p2", "ends_sha256"])

    order = ["p1", "p2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "p1 long, p2 long, least long, ids string")
    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "least").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def nodes_of(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, saved (by the node alone), below (rows under it),
    parent_below, ends_sha256, p1, p2."""
    zero = F.lit(0).cast("long")
    made = rows.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth")).alias("below"),
        F.min("n_bytes").alias("n_bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("length").alias("below")).filter("n_convs > 0")
    root = root.select(zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", "below", zero.alias("n_bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    made = written(made.unionByName(root), "nodes")
    children = made.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    made = made.join(children, ["p1", "p2"], "left").join(ends_digests(rows, lengths), ["p1", "p2"], "left")
    none = F.sha2(F.lit(""), 256)
    made = written(made.withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", none)}), "nodes")
    parents = made.filter("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("below").alias("parent_below"), F.col("n_children").alias("siblings"))
    found = attach(made, parents, ["q1", "q2"], "siblings", made.count())
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    return written(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", saved, "below", "parent_below", "ends_sha256", "p1", "p2"), "nodes")


class Inbox:
    """Totals on their way to nodes that come later, in the order in which these come. Beyond `most`, they wait on disk."""

    def __init__(self, most: int | None = None):
        self.most = most or QUEUE
        self.heap: list[tuple[int, int, int, int]] = []
        self.runs: list[tuple] = []  # the next total of each run on disk, with the run

    def put(self, level: int, name: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-level, name, leaves, saved))
        if len(self.heap) > self.most:
            self._spill()

    def take(self, level: int, name: int) -> tuple[int, int]:
        """The sums of what was put for a node."""
        key, leaves, saved = (-level, name), 0, 0
        while self.heap and self.heap[0][:2] == key:
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:2] == key:
            (_, _, a, b), k, run = self.runs[0]
            leaves, saved = leaves + a, saved + b
            if (after := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, k, run))
        return leaves, saved

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()  # noqa: SIM115: closed, and so deleted, with the run
        np.array(self.heap, np.int64).tofile(file)
        file.seek(0)
        self.heap = []

        def run() -> Iterator[tuple]:
            with file:
                while len(part := np.fromfile(file, np.int64, 4 * 4096)):
                    yield from map(tuple, part.reshape(-1, 4).tolist())

        started = run()
        heapq.heappush(self.runs, (next(started), id(started), started))


PASSED = "conv_id long, depth long, parent_conv_id long, top boolean, n_leaves long, saved_tokens long"


def passed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to every node the totals of its subtree. Nodes come by falling depth, then conv_id; those marked top pass nothing on."""
    inbox = Inbox()
    for b in batches:
        conv, depth, parent, up, top, leaves, saved = (b[c].to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "parent_depth", "top", "leaves", "saved"))
        for i in range(len(conv)):
            more_leaves, more_saved = inbox.take(depth[i], conv[i])
            leaves[i] += more_leaves
            saved[i] += more_saved
            if not top[i]:
                inbox.put(up[i], parent[i], leaves[i], saved[i])
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["depth"], b["parent_conv_id"], b["top"], pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["conv_id", "depth", "parent_conv_id", "top", "n_leaves", "saved_tokens"])


def forward(nodes: DataFrame, *shard: str) -> DataFrame:
    """passed_up() over nodes, dealt by shard (all in one task without)."""
    nodes = nodes.repartition(*shard) if shard else nodes.repartition(1)
    return nodes.sortWithinPartitions(F.desc("depth"), "conv_id").select("conv_id", "depth", "parent_conv_id", "parent_depth", "top", "leaves", "saved").mapInArrow(passed_up, PASSED)


def totals(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of each node's subtree. rows: the prefixes that the nodes are made of."""
    total = nodes.filter("depth = 0").agg(F.coalesce(F.max("below"), F.lit(0))).first()[0]
    most = max(SHARD_ROWS, total // SHARDS)
    nodes = nodes.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "parent_depth": F.col("depth") - 1})
    light = nodes.filter(F.col("below") <= most).withColumn("top", F.coalesce(F.col("parent_below") > most, F.lit(True)))
    if total <= most:
        return forward(light).select("conv_id", "depth", "n_leaves", "saved_tokens")
    # a conversation goes through one shard root at most, so the least members of a shard's nodes tell their shard
    tops = light.filter("top").select("p1", "p2", "n_convs")
    shards = attach(rows.select("conv_id", "p1", "p2"), tops, ["p1", "p2"], "n_convs", total).filter("n_convs is not null").select("conv_id", F.col("p1").alias("shard"))
    below = written(forward(light.join(shards, "conv_id"), "shard"), "shards")
    # nodes above the shards: those of one conversation within SEGMENT depths are a segment
    above = _with_sums(nodes.filter(F.col("below") > most), below.filter("top"))
    above = written(above.withColumn("segment", F.expr(f"depth div {SEGMENT}")), "above")
    whole = above.groupBy("conv_id", "segment").agg(F.min("depth").alias("depth"), F.min_by("parent_conv_id", "depth").alias("parent_conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = whole.withColumn("parent_segment", F.expr(f"(depth - 1) div {SEGMENT}"))
    parents = whole.select(F.col("conv_id").alias("parent_conv_id"), F.col("segment").alias("parent_segment"), F.col("depth").alias("parent_depth"))
    whole = whole.join(parents, ["parent_conv_id", "parent_segment"], "left").withColumn("top", F.col("parent_depth").isNull())
    roots = written(forward(whole), "segments")
    own = _with_sums(above, roots.filter("not top")).withColumn("top", (F.col("parent_conv_id") != F.col("conv_id")) | (F.expr(f"(depth - 1) div {SEGMENT}") != F.col("segment")) | (F.col("depth") == 0))
    out = ["conv_id", "depth", "n_leaves", "saved_tokens"]
    return below.select(*out).unionByName(forward(own, "conv_id", "segment").select(*out))


def _with_sums(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the totals of roots below them added to their own."""
    sums = roots.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    nodes = nodes.join(sums, ["conv_id", "depth"], "left")
    return nodes.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of rebuilt conversations, the root (no turns) included.

    A conversation is rebuilt from the first shared_turns() turns of the first of its group of GROUP ids and its own turns
    after as many. Turns go by turn, null first, then by role and text; null role and text are empty; rows that repeat are turns of their own.
    Rows without conv_id are left out. No conversations give no rows.

    conv_id: least member; depth; parent_conv_id: the parent's least member (root: null); n_convs: members; n_children;
    n_leaves: childless nodes in the subtree; saved_tokens: over the subtree, members but one times the bytes of the
    last text; ends_sha256: of the ids that end here. Columns with other names are never read, so none can clash.
    """
    rows, lengths = rebuilt(ordered(conversations.select("conv_id", "turn", "role", "text")))
    rows = prefixes(rows)
    nodes = nodes_of(rows, lengths)
    found = nodes.drop("saved").join(totals(nodes, rows), ["conv_id", "depth"])
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
