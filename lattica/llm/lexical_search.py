"""Ranked lexical search for a set of items over all documents, by trees of documents that share frequent terms.

Documents are reduced to the terms that any item has, with how often each occurs, most frequent terms (by number of
documents) first. Each task puts its documents, block by block, into a tree: documents whose vectors begin alike share a
path, and a subtree knows the most that each term occurs in one of its documents and the least length factor m. These bound
every score in the subtree, so a depth-first walk for an item leaves out subtrees that can't reach its list. What is in all
lists of all tasks is ranked once more.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lattica.llm.tables import written
from lattica.llm.textvec import LOWER, buffers, hashes, slices, spans

#: Bytes of items that are searched for at once; more items take several turns over the documents' vectors.
ITEM_BYTES = 8 << 20
#: Documents and entries of their vectors in one tree, and documents in a subtree that isn't divided further.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS = 16384, 2_000_000, 48
#: All ASCII bytes but letters and digits end a term.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Terms:
    """The items' terms, found again in texts by their hashes and then by their bytes."""

    def __init__(self, names: list[bytes]):
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
        starts = np.concatenate(([0], ends[:-1])) if len(names) else ends
        keys = hashes(data, starts, ends)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order, self.data, self.starts, self.sizes = keys[order], order, data, starts, ends - starts
        self.twins = bool(len(keys) > 1 and (self.keys[1:] == self.keys[:-1]).any())

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word data[start:end], A-Z in lower case, the number of the term that it is, or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.keys) or not len(start):
            return out
        h = hashes(data, start, end)
        for shift in (0, 1) if self.twins else (0,):
            i = np.minimum(np.searchsorted(self.keys, h) + shift, len(self.keys) - 1)
            term = self.order[i]
            at = np.flatnonzero((self.keys[i] == h) & (self.sizes[term] == end - start) & (out < 0))
            left, j = at, 0
            while len(left):  # byte by byte, as long as they agree
                more = self.sizes[term[left]] > j
                out[left[~more]] = term[left[~more]]
                left = left[more]
                left = left[LOWER[data[start[left] + j]] == self.data[self.starts[term[left]] + j]]
                j += 1
        return out


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of a text in order."""
    data, at = buffers(pa.array([text], pa.string()))
    _, start, end = spans(data, at, NO_TERM)
    low = LOWER[data].tobytes()
    return list(dict.fromkeys(low[i:j] for i, j in zip(start.tolist(), end.tolist())))


def vectors(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the named terms that occur), tfs (how often each does)."""
    held = docs.sparkSession.sparkContext.broadcast(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = Terms(held.value), max(len(held.value), 1)
        for b in batches:
            column = b["text"]
            _, all_at = buffers(column)
            for i, j in slices(all_at):
                data, at = buffers(column.slice(i, j - i))
                row, start, end = spans(data, at, NO_TERM)
                n = np.bincount(row, minlength=j - i)
                term = known.find(data, start, end)
                hit = term >= 0
                key, tf = np.unique(row[hit] * size + term[hit], return_counts=True) if hit.any() else (np.zeros(0, np.int64),) * 2
                of = key // size
                offsets = pa.array(np.searchsorted(of, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((key % size, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Tree:
    """Documents' vectors, as a tree of shared beginnings.

    Documents stand in the order of a depth-first walk, so a subtree is a range of them. A node holds its range and the
    parent's number; `maxima` is, for each term, the nodes below which it occurs and the most that it does in one document.
    """

    def __init__(self, m: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        length = np.diff(at)
        order: list[np.ndarray] = []
        nodes: list[tuple[int, int, int, int]] = []  # parent, first document, end, whether it is a leaf
        stack, done = [(-1, np.arange(len(m)), 0)], 0
        while stack:
            parent, docs, depth = stack.pop()
            while True:  # down a path that all documents share
                ended = length[docs] <= depth
                if len(docs) <= LEAF_DOCS or ended.all():
                    groups: list[np.ndarray] = []
                    break
                going = docs[~ended]
                step = terms[at[going] + depth]
                depth += 1
                if ended.any() or (step != step[0]).any():
                    by = np.argsort(step, kind="stable")
                    cuts = np.flatnonzero(np.diff(step[by])) + 1
                    groups = [docs[ended]] * bool(ended.any()) + np.split(going[by], cuts)
                    break
            me = len(nodes)
            nodes.append((parent, done, done + len(docs), not groups))
            if groups:
                # few documents with different next terms stay together in leaves of their parent
                small = [g for g in groups if len(g) <= LEAF_DOCS]
                merged, held = [], 0
                for g in small:
                    if not merged or held + len(g) > LEAF_DOCS:
                        merged.append([])
                        held = 0
                    merged[-1].append(g)
                    held += len(g)
                stack += [(me, np.concatenate(g), depth) for g in merged]
                stack += [(me, g, depth) for g in groups if len(g) > LEAF_DOCS]
            else:
                order.append(docs)
                done += len(docs)
        self.order = np.concatenate(order)
        self.parent, self.first, self.end, leaf = (np.array(x) for x in zip(*nodes))
        self.leaf = leaf.astype(bool)
        self.m = m[self.order]
        size = length[self.order]
        self.at = np.concatenate(([0], np.cumsum(size)))
        pick = np.repeat(at[self.order] - self.at[:-1], size) + np.arange(self.at[-1])
        self.terms, self.tfs = terms[pick], tfs[pick]
        self.least_m = np.full(len(nodes), np.iinfo(np.int64).max)
        for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
            self.least_m[k] = min(self.least_m[k], self.m[self.first[k] : self.end[k]].min()) if self.leaf[k] else self.least_m[k]
            if self.parent[k] >= 0:
                self.least_m[self.parent[k]] = min(self.least_m[self.parent[k]], self.least_m[k])
        leaves = np.flatnonzero(self.leaf)
        leaf_of = np.repeat(leaves, self.end[leaves] - self.first[leaves])
        node, term, tf = np.repeat(leaf_of, size), self.terms, self.tfs
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(node):
            node, term, tf = _maxima(node, term, tf)
            kept.append((node, term, tf))
            up = self.parent[node]
            node, term, tf = up[up >= 0], term[up >= 0], tf[up >= 0]
        if kept:
            node, term, tf = _maxima(*map(np.concatenate, zip(*kept)))
        by = np.argsort(term, kind="stable")
        self.node, self.most = node[by], tf[by]
        self.term_at = np.searchsorted(term[by], np.arange(int(term.max()) + 2 if len(term) else 1))
        self.children: dict[int, list[int]] = {}
        for k, p in enumerate(self.parent.tolist()):
            self.children.setdefault(p, []).append(k)

    def bounds(self, item: list[tuple[int, int]]) -> np.ndarray:
        """For each node, a score that none of its documents exceeds: item has (term, weight) pairs."""
        out = np.zeros(len(self.parent), np.int64)
        for term, w in item:
            if term + 1 < len(self.term_at):
                part = slice(self.term_at[term], self.term_at[term + 1])
                node, tf = self.node[part], self.most[part]
                out[node] += w * (1_000_000_000 * tf // (1000 * tf + 8 * self.least_m[node]))
        return out

    def scores(self, first: int, end: int, weights: np.ndarray) -> np.ndarray:
        """The scores of a range of documents; weights: of each term, 0 where the item lacks it."""
        part = slice(self.at[first], self.at[end])
        w = weights[self.terms[part]]
        hit = np.flatnonzero(w)
        doc = np.searchsorted(self.at[first : end + 1], hit + self.at[first], "right") - 1
        tf = self.tfs[part][hit]
        out = np.zeros(end - first, np.int64)
        np.add.at(out, doc, w[hit] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[first + doc])))
        return out

    def search(self, item: list[tuple[int, int]], weights: np.ndarray, least: int, keep) -> int:
        """Walks depth-first, likeliest children first, into subtrees whose bound reaches the least score that still counts.

        keep(order numbers, scores) takes documents in and returns that least score from then on. Returns how many were scored.
        """
        bound, scored = self.bounds(item), 0
        stack = [0]
        while stack:
            k = stack.pop()
            if bound[k] < least:
                continue
            if self.leaf[k]:
                a, b = int(self.first[k]), int(self.end[k])
                found = self.scores(a, b, weights)
                scored += b - a
                good = np.flatnonzero(found >= least)
                if len(good):
                    least = keep(self.order[a + good], found[good])
            else:
                stack += sorted(self.children[k], key=lambda c: bound[c])
        return scored


def _maxima(node: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest tf of each node and term."""
    by = np.lexsort((term, node))
    node, term, tf = node[by], term[by], tf[by]
    new = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (term[1:] != term[:-1]))))
    return node[new], term[new], np.maximum.reduceat(tf, new)


def _no_id(x) -> tuple:
    """Ascending, nulls last."""
    return (x is None, x or 0)


class Lists:
    """Each item's k best documents so far."""

    def __init__(self, items: dict[object, list[tuple[int, int]]], n_terms: int, k: int):
        self.items, self.k = items, k
        self.best: dict[object, list] = {i: [] for i in items}
        self.weights = np.zeros(n_terms, np.int64)

    def add(self, tree: Tree, ids: list) -> int:
        scored = 0
        for name, item in self.items.items():
            best = self.best[name]
            for term, w in item:
                self.weights[term] = w

            def keep(order: np.ndarray, found: np.ndarray, best=best) -> int:
                best += [(int(s), ids[o]) for s, o in zip(found, order.tolist())]
                best[:] = heapq.nsmallest(self.k, best, key=lambda x: (-x[0], _no_id(x[1])))
                return best[-1][0] if len(best) == self.k else 1

            scored += tree.search(item, self.weights, best[-1][0] if len(best) == self.k else 1, keep)
            for term, _ in item:
                self.weights[term] = 0
        return scored


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A term that df of N
    documents with terms have weighs floor(1000 ln((2N + 2) / (2df + 1))); a document with n of all L terms has
    m = 10 + 90nN div L; its score sums weight * (10**9 tf div (1000 tf + 8m)) over the item's distinct terms. Equal
    scores go by ascending doc_id, null last. Rows that repeat are documents of their own; null and empty texts have no
    terms; items without terms have no rows, and rows of one item_id (null too) are one item. No documents or items give none.

    Items are taken to the driver, some ITEM_BYTES at once (their rows are dealt to turns by hash). A turn reads all texts
    once, and the vectors that it writes in the shared folder twice: for counts, and for the trees.
    """
    spark = docs.sparkSession
    schema = f"item_id {dict(items.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    items = items.select("item_id", "text")
    turns = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES
    found = None
    for turn in range(turns):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn) if turns > 1 else items
        named: dict[object, dict[bytes, None]] = {}
        for item, text in mine.toLocalIterator():
            named.setdefault(item, {}).update(dict.fromkeys(terms_of(text)))
        part = _turn(docs, named, schema, k)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _turn(docs: DataFrame, named: dict, schema: str, k: int) -> DataFrame:
    """item_id, doc_id, score: the best of every task's documents for some items."""
    spark = docs.sparkSession
    names = sorted({t for terms in named.values() for t in terms})
    table = written(vectors(docs, names), "vectors")
    # the counts of at most ITEM_BYTES of terms, and two sums
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = n
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(names))
    number = {t: i for i, t in enumerate(names)}
    weighed = {item: [(int(rank[number[t]]), weight(n_docs, int(df[number[t]]))) for t in terms if df[number[t]]] for item, terms in named.items()}
    held = spark.sparkContext.broadcast(({i: t for i, t in weighed.items() if t}, rank))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank = held.value
        lists = Lists(items, len(rank), k)
        for ids, n, at, terms, tfs in _blocks(batches, rank):
            lists.add(Tree(10 + 90 * n * n_docs // n_terms, at, terms, tfs), ids)
        rows = [(i, d, s) for i, best in lists.best.items() for s, d in best]
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows[i : i + 4096]), kinds)], ["item_id", "doc_id", "score"])

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return table.filter(F.size("terms") > 0).mapInArrow(work, schema)


def _blocks(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[tuple]:
    """ids, n, and the vectors with terms by rank, of so many documents at once as make up a tree."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        lists, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
        at = lists.offsets.to_numpy().astype(np.int64)
        terms = rank[lists.values.to_numpy()[at[0] : at[-1]]]
        tfs_at = tfs.offsets.to_numpy()
        tfs = tfs.values.to_numpy()[tfs_at[0] : tfs_at[-1]]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        by = np.lexsort((terms, row))
        return t["doc_id"].to_pylist(), t["n"].to_numpy().astype(np.int64), at - at[0], terms[by], tfs[by]

    for b in batches:
        for i in range(0, b.num_rows, 1024):
            held.append(b.slice(i, 1024))
            rows, entries = rows + held[-1].num_rows, entries + len(held[-1]["terms"].flatten())
            if rows >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield block()
                held, rows, entries = [], 0, 0
    if held:
        yield block()
