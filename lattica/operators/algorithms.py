"""Graph algorithms on edge tables: degree, PageRank, label propagation, components, neighbourhood similarity.

Iterations cut their lineage by writing each state as a table in the folder of spark.checkpoint.dir (or the session's
own scratch folder), so plans stay small and executors can be lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.codes import shortened
from lattica.operators.layout import ranked
from lattica.operators.state import dropped, saved


def degrees(nodes: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """id and degree of every node, 0 included; a self-loop counts once each way."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    found = edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(found, "id", "left").fillna(0, ["degree"])


#: Units in which flows are added up.
UNITS = 1e11


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """id, score after a fixed number of rounds from 1: score = (1 - d) + d * sum of score / out-degree over in-links.

    Parallel edges count once as in-links but each towards the out-degree; what flows into sinks is lost. What a link
    carries is rounded to whole 1e-11, so sums don't depend on their order. Once a round changes no score, all further ones
    would give the same and are left out; that is after as many rounds as the longest path has steps, if there are no cycles.
    """
    once, name = shortened(edges)
    nodes = once.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    out = once.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    scores = saved(nodes.join(out, "id", "left").select("id", "out", F.lit(1.0).alias("score"), F.lit(True).alias("moved")), "scores")
    # a node's links are one row, which is smaller to shuffle than a row each; a hub's are cut into pieces
    piece = F.pmod(F.xxhash64("dst"), F.lit(256))
    links = saved(once.distinct().groupBy("src", piece.alias("piece")).agg(F.collect_list("dst").alias("to")).select("src", "to"), "links", once)
    for _ in range(iterations):
        sent = scores.filter("out is not null").select(F.col("id").alias("src"), F.round(F.col("score") / F.col("out") * UNITS).cast("long").alias("part"))
        flow = links.join(sent, "src").select(F.explode("to").alias("id"), "part").groupBy("id").agg((F.sum("part") / UNITS).alias("flow"))
        new = (1 - damping) + damping * F.coalesce("flow", F.lit(0.0))
        scores = saved(scores.join(flow, "id", "left").select("id", "out", new.alias("score"), (new != F.col("score")).alias("moved")), "scores", scores)
        if scores.filter("moved").isEmpty():
            break
    dropped(links)
    return scores.select(name(F.col("id")).alias("id"), "score")


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected links as src, dst in both directions, without self-loops."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """id, label: all at once take the commonest label among distinct neighbours, the least of equally common ones."""
    once, name = shortened(edges)
    links = saved(both_ways(once), "links", once)
    # a node's neighbours are one row, which is smaller to shuffle than a row each; a hub's are cut into pieces
    piece = F.pmod(F.xxhash64("src"), F.lit(256))
    links = saved(links.groupBy("dst", piece.alias("piece")).agg(F.collect_list("src").alias("around")).select("dst", "around"), "around", links)
    labels, held = links.select(F.col("dst").alias("id")).distinct().withColumn("label", F.col("id")), None
    for i in range(iterations):
        told = links.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.explode("around").alias("id"), "label")
        # dealt by node, so that neither sum needs a shuffle of its own
        n = told.repartition("id").groupBy("id", "label").agg(F.count("*").alias("n"))
        labels = held = saved(n.groupBy("id").agg(F.min(F.struct(-F.col("n"), "label")).alias("best")).select("id", F.col("best.label").alias("label")), "labels", held)
    return labels.select(name(F.col("id")).alias("id"), name(F.col("label")).alias("label"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (its least id) of every node that has an edge.

    Each round a node is put under the least of itself and its neighbours, and edges between those that nodes stand under
    are the next round's, so that they soon become few; then the names go back through the rounds.
    """
    links, name = shortened(edges.select("src", "dst").dropna().distinct())
    rounds = []
    for _ in range(most_rounds):
        ends = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        under = saved(ends.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("top")), "under")
        rounds.append(under)
        a, b = under.select(F.col("id").alias("src"), F.col("top").alias("s")), under.select(F.col("id").alias("dst"), F.col("top").alias("d"))
        links = saved(links.join(a, "src").join(b, "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "links", links)
        # a top may itself stand under another node only by a link between tops, so it comes up in the next round
        if links.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    dropped(links)
    found = rounds[-1].withColumnRenamed("top", "component")
    for under in rounds[-2::-1]:
        further = found.select(F.col("id").alias("top"), "component")
        found = under.join(further, "top", "left").select("id", F.coalesce("component", "top").alias("component"))
    found = saved(found.select(name(F.col("id")).alias("id"), name(F.col("component")).alias("component")), "components")
    for under in rounds:
        dropped(under)
    return found


def neighbour_similarity(edges: DataFrame, left: str, right: str) -> DataFrame:
    """common, jaccard and cosine of the neighbour sets of two nodes; 0 where they have none."""
    n = edges.select("src", "dst").filter(F.col("src").isin(left, right)).distinct()
    per = n.groupBy("dst").agg(F.bool_or(F.col("src") == left).alias("l"), F.bool_or(F.col("src") == right).alias("r"))
    s = per.agg(F.count_if(F.col("l") & F.col("r")).alias("common"), F.count_if("l").alias("a"), F.count_if("r").alias("b"))
    either = F.col("a") + F.col("b") - F.col("common")
    return s.select("common", F.round(F.coalesce(F.try_divide("common", either), F.lit(0.0)), 6).alias("jaccard"), F.round(F.coalesce(F.try_divide("common", F.sqrt(F.col("a") * F.col("b"))), F.lit(0.0)), 6).alias("cosine"))


def two_step_betweenness(edges: DataFrame) -> DataFrame:
    """id, score: each pair of nodes two steps apart gives 1 to what lies between, in equal shares.

    Paths of two steps go over a node's in- and out-links, so rows are bounded by the sum of their products.
    """
    e = edges.select("src", "dst").distinct()
    p = e.select(F.col("src").alias("s"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("t")), "m").filter("s <> t")
    p = p.join(e.select(F.col("src").alias("s"), F.col("dst").alias("t")), ["s", "t"], "left_anti")
    ways = p.groupBy("s", "t").agg(F.count("*").alias("ways"))
    return p.join(ways, ["s", "t"]).groupBy(F.col("m").alias("id")).agg(F.sum(1.0 / F.col("ways")).alias("score"))


#: Rows of first links that a block of two_step_pairs() has on average, and of second links at most, roughly; pairs worked out at once.
BLOCK_ROWS, BLOCK_ENDS, PAIRS_AT_ONCE = 400_000, 2_000_000, 4_000_000


def two_step_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """pairs: how many different (src, dst) a first link (src, mid) and a second one (mid, dst) lead to; one row.

    Pairs aren't listed or shuffled, as they may be a thousand times the links. Ranges of src are blocks, and a block gets the
    second links of each mid that it uses once; where those are too many for a task, ends are dealt to slices by a hash, and each
    slice of a block is counted apart. What is shuffled goes with blocks times the second links that they use: near the input where
    neighbours in the order of src share mids, and never more than the pairs.
    """
    first, second = first.select("src", "mid").dropna(subset=["mid"]).distinct(), second.select("mid", "dst").dropna(subset=["mid"]).distinct()
    names = ranked(second.select("dst").distinct(), ["dst"]).select(F.col("dst").alias("_dst"), F.col("rank").alias("end"))
    second = saved(second.join(names, F.col("dst").eqNullSafe(F.col("_dst"))).select("mid", "end"), "second")
    first = saved(first.join(second.select("mid").distinct(), "mid", "left_semi").select("src", "mid"), "first")
    blocks = max(1, math.ceil(first.count() / BLOCK_ROWS))
    dealt = saved(first.repartitionByRange(blocks, "src").withColumn("block", F.spark_partition_id()), "dealt", first)
    need = dealt.select("block", "mid").distinct()
    lengths = second.groupBy("mid").agg(F.count("*").alias("n"))
    most = need.join(lengths, "mid").groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, math.ceil(most / BLOCK_ENDS))
    ends = need.join(second, "mid").select("block", F.pmod(F.xxhash64("end"), F.lit(slices)).cast("int").alias("slice"), F.col("mid").alias("mid"), F.col("end").alias("end"))
    starts = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def count(own: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ends.empty:
            return pd.DataFrame({"pairs": [0]})
        mids, names = pd.factorize(ends["mid"])
        order = np.argsort(mids, kind="stable")
        end = pd.factorize(ends["end"])[0][order]
        size = np.bincount(mids, minlength=len(names))
        begin = np.cumsum(size) - size
        src = pd.factorize(own["src"], use_na_sentinel=False)[0]
        mid = pd.Index(names).get_indexer(own["mid"])
        src, mid = src[mid >= 0], mid[mid >= 0]
        order = np.argsort(src, kind="stable")
        src, mid = src[order], mid[order]
        upto = np.cumsum(size[mid])
        pairs, i, width = 0, 0, int(end.max()) + 1
        while i < len(src):
            done = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
            # whole nodes at once: back to where the last one began, or on to where the first one ends
            if j < len(src):
                k = int(np.searchsorted(src, src[j]))
                j = k if k > i else int(np.searchsorted(src, src[i], "right"))
            n = size[mid[i:j]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[mid[i:j]], n)
            key = np.sort(np.repeat(src[i:j], n) * width + end[at])
            pairs += int((np.diff(key) != 0).sum()) + (len(key) > 0)
            i = j
        return pd.DataFrame({"pairs": [pairs]})

    starts = starts.select(*[F.col(c).alias(c) for c in ("block", "slice", "src", "mid")])
    tasks = blocks * slices
    both = starts.repartition(tasks, "block", "slice").groupBy("block", "slice").cogroup(ends.repartition(tasks, "block", "slice").groupBy("block", "slice"))
    return both.applyInPandas(count, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


#: Sources whose paths are counted at once; links of a block on average, and so few that a block more isn't worth it; links in one row of a block.
SOURCES_AT_ONCE, BLOCK_LINKS, LEAST_LINKS, PIECE_LINKS = 16, 4_000_000, 50_000, 1_000_000


def _in_blocks(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst: long), each once and one way, as blocks for _told(): (block, nodes, a, b), and where nodes are: (node, blocks).

    A link goes to the block of that end which has fewer links. So most nodes are in one block, hubs in many, and no node brings
    more than about the square root of twice all links into its block: each of them leads to a node with no fewer links.
    """
    spark, n = links.sparkSession, links.count()
    blocks = max(math.ceil(n / BLOCK_LINKS), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_LINKS)))
    degree = saved(links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "degrees")
    s, d = degree.select(F.col("node").alias("src"), F.col("n").alias("m")), degree.select(F.col("node").alias("dst"), "n")
    own = F.when(F.col("m") <= F.col("n"), F.col("src")).otherwise(F.col("dst"))
    dealt = links.join(s, "src").join(d, "dst").select(F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int").alias("block"), "src", "dst")
    piece_links = PIECE_LINKS

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(own[["src", "dst"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2).astype("int32")
        pieces = [at[i : i + piece_links] for i in range(0, len(at), piece_links)]
        return pd.DataFrame({"block": own["block"].iloc[0], "nodes": [nodes, *[nodes[:0]] * (len(pieces) - 1)], "a": [p[:, 0] for p in pieces], "b": [p[:, 1] for p in pieces]})

    # several partitions for a block, as the hashes of so few numbers would often meet in one
    grouped = dealt.repartition(4 * blocks, "block").groupBy("block")
    held = saved(grouped.applyInPandas(packed, "block int, nodes array<bigint>, a array<int>, b array<int>"), "blocks")
    held._lattica_blocks = blocks
    at = held.select("block", F.explode("nodes").alias("node")).groupBy("node").agg(F.collect_list("block").alias("blocks"))
    at = saved(at, "places")
    dropped(degree)
    return held, at


def _told(blocks: DataFrame, at: DataFrame, rows: DataFrame) -> DataFrame:
    """Each node's sums of its neighbours' numbers: rows (node, and numbers), at most one a node; nodes whose sums are all 0 may be left out.

    blocks and at are as _in_blocks() gives them. A node's numbers go once to each block it is in, and one row of sums comes back.
    """
    names = [c for c in rows.columns if c != "node"]

    def passed(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if own.empty or sent.empty:
            return pd.DataFrame({"node": pd.Series(dtype="int64")} | {c: pd.Series(dtype="float64") for c in names})
        nodes = np.concatenate(own["nodes"].to_list())
        place = np.searchsorted(nodes, sent["node"].to_numpy())
        live = np.zeros(len(nodes), bool)
        live[place] = True
        numbers, sums = np.zeros((len(names), len(nodes))), np.zeros((len(names), len(nodes)))
        for i, c in enumerate(names):
            numbers[i, place] = sent[c].to_numpy()
        for one, other in zip(own["a"], own["b"]):
            for to, of in ((one, other), (other, one)):
                keep = live[of]
                t, o = to[keep], of[keep]
                if len(t):
                    least = int(t.min())
                    for i in range(len(names)):
                        some = np.bincount(t - least, numbers[i, o])
                        sums[i, least : least + len(some)] += some
        some = sums.any(axis=0)
        return pd.DataFrame({"node": nodes[some]} | {c: sums[i, some] for i, c in enumerate(names)})

    parts = 4 * blocks._lattica_blocks
    sent = rows.join(at, "node").select(F.explode("blocks").alias("block"), "node", *names)
    both = blocks.repartition(parts, "block").groupBy("block").cogroup(sent.repartition(parts, "block").groupBy("block"))
    sums = both.applyInPandas(passed, "node bigint, " + ", ".join(f"{c} double" for c in names))
    return sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in names])


def betweenness(edges: DataFrame, sources: DataFrame, longest: int = 5) -> DataFrame:
    """id, score: over undirected shortest paths of up to so many steps from each source (id), the shares that lead over a node.

    Of the shortest paths between a source and a node, each gives its share to the nodes between. With all nodes as
    sources every pair counts twice. Paths are counted level by level, and shares go back the same way, in blocks of links. A node
    of a level is one row, with a column for each of SOURCES_AT_ONCE sources; more sources take several turns, so they are to be a
    bounded sample. Nodes that nothing leads over have no row.
    """
    once, name = shortened(edges)
    return _betweenness(once, name, sources.select("id"), longest)


def _betweenness(once: DataFrame, name: Callable[[Column], Column], sources: DataFrame, longest: int) -> DataFrame:
    """betweenness() over edges as shortened() gives them; deletes their table."""
    links = once.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    nothing = once.filter("false").select(name(F.col("src")).alias("id"), F.lit(0.0).alias("score"))
    ranks = None
    if dict(once.dtypes)["src"] != "bigint":
        ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        ranks = saved(ranked(ids, ["id"]).select("id", F.col("rank").alias("node")), "ranks")
        a, b = ranks.select(F.col("id").alias("src"), F.col("node").alias("s")), ranks.select(F.col("id").alias("dst"), F.col("node").alias("d"))
        links = links.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    links = saved(links, "links")
    if links.isEmpty():
        return nothing
    blocks, at = _in_blocks(links)
    dropped(links)
    known = ranks if ranks is not None else at.select(name(F.col("node")).alias("id"), "node")
    starts = saved(ranked(known.join(sources.distinct(), "id", "left_semi").select("node"), ["node"], 8).select("node", "rank"), "sources")
    n, nodes = starts.count(), at.count()
    if not n:
        return nothing
    scores = []
    for first in range(0, n, SOURCES_AT_ONCE):
        ways = [f"w{i}" for i in range(min(SOURCES_AT_ONCE, n - first))]
        own = starts.filter(F.col("rank").between(first, first + len(ways) - 1))
        levels = [saved(own.select("node", *[(F.col("rank") == first + i).cast("double").alias(c) for i, c in enumerate(ways)]), "level")]
        reached = len(ways)
        while len(levels) <= longest and reached < nodes * len(ways):
            step = _told(blocks, at, levels[-1])
            # a neighbour of this level's nodes lies on it, on the one before, or is new
            for before in levels[-2:]:
                before = before.select("node", *[F.col(c).alias(f"_{c}") for c in ways])
                step = step.join(before, "node", "left").select("node", *[F.when(F.col(f"_{c}") > 0, 0.0).otherwise(F.col(c)).alias(c) for c in ways])
            level = saved(step.filter(F.greatest(*ways, F.lit(0.0)) > 0), "level")
            new = sum(level.agg(*[F.count_if(F.col(c) > 0) for c in ways]).first())
            if not new:
                dropped(level)
                break
            levels.append(level)
            reached += new
        shares = []
        for far, near in zip(levels[:1:-1], levels[-2:0:-1]):
            if shares:
                far = far.join(shares[-1], "node", "left")
            share = [F.coalesce(F.col(f"_{c}"), F.lit(0.0)) if shares else F.lit(0.0) for c in ways]
            back = _told(blocks, at, far.select("node", *[F.when(F.col(c) > 0, (1 + s) / F.col(c)).otherwise(0.0).alias(c) for c, s in zip(ways, share)]))
            back = back.select("node", *[F.col(c).alias(f"_{c}") for c in ways])
            share = near.join(back, "node").select("node", *[(F.col(c) * F.col(f"_{c}")).alias(f"_{c}") for c in ways])
            shares.append(saved(share.filter(F.greatest(*[f"_{c}" for c in ways], F.lit(0.0)) > 0), "share"))
        for share in shares:
            scores.append(saved(share.select("node", sum(F.col(f"_{c}") for c in ways).alias("score")), "score", share))
        for level in levels:
            dropped(level)
    dropped(blocks)
    if not scores:
        return nothing
    score = scores[0]
    for more in scores[1:]:
        score = score.unionByName(more)
    score = score.groupBy("node").agg(F.sum("score").alias("score"))
    score = score.join(ranks, "node") if ranks is not None else score.withColumn("id", name(F.col("node")))
    found = saved(score.select("id", "score"), "betweenness")
    for table in [*scores, starts, at, once, *([ranks] if ranks is not None else [])]:
        dropped(table)
    return found


def sampled_betweenness(edges: DataFrame, sample_size: int = 1000, longest: int = 5, seed: int = 42) -> DataFrame:
    """betweenness() from so many nodes, those whose ids hash lowest."""
    once, name = shortened(edges)
    nodes = once.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(name(F.col("id")).alias("id"))
    return _betweenness(once, name, nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_size), longest)


def _gains(around: DataFrame, own: DataFrame, total: float, asked: Column) -> DataFrame:
    """id, move: the neighbouring community that raises modularity most, if any does; of equal ones the least.

    around: dst, and links (src, w) of its neighbours; own: id, k (sum of its links) and community; asked: which ids may move. Nodes
    tell their community with its size, and what they tell is dealt by the node told, so links are shuffled twice and no more.
    """
    placed = own.join(own.groupBy("community").agg(F.sum("k").alias("size")), "community")
    told = around.join(placed.select(F.col("id").alias("dst"), "community", "size"), "dst").select(F.explode("around").alias("v"), "community", "size")
    to = told.select(F.col("v.src").alias("id"), "community", F.col("v.w").alias("w"), "size").filter(asked)
    # links into the own community may be none, so that its term must come from the node itself
    inside = placed.filter(asked).select("id", "community", F.lit(0.0).alias("w"), "size")
    mine = own.filter(asked).select("id", F.col("community").alias("at"), "k")
    scored = to.unionByName(inside).repartition("id").groupBy("id", "community").agg(F.sum("w").alias("w"), F.max("size").alias("size")).join(mine, "id")
    rest = F.col("size") - F.when(F.col("community") == F.col("at"), F.col("k")).otherwise(F.lit(0.0))
    scored = scored.withColumn("gain", F.col("w") - F.col("k") * rest / total)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("community").alias("c"))).alias("b"), F.max(F.when(F.col("community") == F.col("at"), F.col("gain"))).alias("now"))
    return best.filter(-F.col("b.g") > F.col("now") + 1e-9).select("id", F.col("b.c").alias("move"))


def communities(edges: DataFrame, levels: int = 3, rounds: int = 6, settled: float = 0.02, seed: int = 42) -> DataFrame:
    """id, community by greedy modularity in levels: nodes move, then each community becomes one node of the next level.

    In a round only the nodes of one half, dealt anew by a hash, move, so that neighbours seldom swap places; a level ends
    after two rounds running in which no more than a share of its nodes moved. Parallel and opposite edges are one link,
    and self-loops don't count. A level without a move ends it. A community is named after one of its nodes. Memory is
    that of joins by node; only counts come to the driver.
    """
    once, name = shortened(edges)
    links = saved(both_ways(once).withColumn("w", F.lit(1.0)), "links", once)
    member = links.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    total = float(links.count())
    # a node's neighbours are one row, which is smaller to shuffle than a row each; a hub's are cut into pieces
    piece = F.pmod(F.xxhash64("src"), F.lit(256))
    for level in range(levels if total else 0):
        own = saved(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("community", F.col("id")), "communities")
        around = saved(links.filter("src <> dst").groupBy("dst", piece.alias("piece")).agg(F.collect_list(F.struct("src", "w")).alias("around")).select("dst", "around"), "around")
        nodes, moved, quiet = own.count(), 0, 0
        for i in range(rounds):
            half = F.pmod(F.xxhash64(name(F.col("id")), F.lit(seed + level * rounds + i)), F.lit(2)) == 0
            moves = saved(_gains(around, own, total, half), "moves")
            n = moves.count()
            if n:
                own = saved(own.join(moves, "id", "left").select("id", "k", F.coalesce("move", "community").alias("community")), "communities", own)
            dropped(moves)
            moved, quiet = moved + n, quiet + 1 if n <= settled * nodes else 0
            if quiet == 2:
                break
        dropped(around)
        if not moved:
            dropped(own)
            break
        before = member if level else None
        member = saved(member.withColumnRenamed("community", "_c").join(own.select(F.col("id").alias("_c"), "community"), "_c").select("id", "community"), "members", before)
        a, b = own.select(F.col("id").alias("src"), F.col("community").alias("s")), own.select(F.col("id").alias("dst"), F.col("community").alias("t"))
        links = saved(links.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("w").alias("w")), "links", links)
        dropped(own)
    return member.select(name(F.col("id")).alias("id"), name(F.col("community")).alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: the modularity of communities (id, community) over the undirected links."""
    links = both_ways(edges)
    of = lambda name, c: member.select(F.col("id").alias(name), F.col("community").alias(c))
    both = links.join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    per = both.groupBy("a").agg(F.count("*").alias("k"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    # shares of the whole, which a window without groups would gather in one task, come from sums of sums
    whole = per.agg(F.sum("k").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("k").cast("double") * F.col("k")).alias("q"))
    return whole.select((F.col("i") / F.col("m") - F.col("q") / (F.col("m") * F.col("m"))).alias("modularity"))
