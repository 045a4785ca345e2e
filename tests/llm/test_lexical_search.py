import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in counts:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TREE_DOCS", 40)
    monkeypatch.setattr(lexical_search, "LEAF_DOCS", 3)
    words = ["the", "The", "of", "and", "Äpfel", "äpfel", "x1", "Rare", "zug", "中文", "a_b", "don't", "nu\x00l"]
    r = np.random.default_rng(5)
    docs = [(int(i), " ".join(words[min(int(w), 12)] for w in r.exponential(3, int(r.integers(0, 40))))) for i in range(300)]
    docs += [(1000 + i, "the same copies of rare and zug") for i in range(30)] + [(7, None), (8, ""), (None, "rare rare zug"), (None, "rare rare zug"), (5, "rare"), (5, "rare"), (2000, "the zug " * 20_000)]
    items = [(1, "The RARE zug, and x1"), (2, "nothing here matches? qqq"), (3, None), (4, ""), (5, "äpfel don't"), (5, "中文"), (None, "of of the"), (6, "the")]
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "2 AS terms", "3 AS score", "4 AS item_id", "5 AS rank").repartition(3)
    found = lexical_search.ranked(table, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id"))
    assert plain(found.collect()) == plain(by_hand(docs, items))
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 20)  # several turns
    assert plain(lexical_search.ranked(table, spark.createDataFrame(items, ITEMS), 3).collect()) == plain(by_hand(docs, items, 3))


def test_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    none, blank = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, None), (2, "..")], DOCS)
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(blank, items).count() == 0
    assert lexical_search.ranked(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert [tuple(r) for r in lexical_search.ranked(docs, items).collect()] == by_hand([(1, "a")], [(1, "a")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), max_size=6), min_size=1, max_size=60), st.integers(1, 5), st.randoms(use_true_random=False))
def test_bounds_hold_and_prune(vectors, leaf, r):
    vectors = [sorted(set(v)) for v in vectors]
    at = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    flat = np.array([t for v in vectors for t in v], np.int64)
    tfs = np.array([r.randint(1, 9) for _ in flat], np.int64)
    m = np.array([r.randint(10, 200) for _ in vectors], np.int64)
    before, lexical_search.LEAF_DOCS = lexical_search.LEAF_DOCS, leaf
    try:
        tree = lexical_search.Tree(m, at, flat, tfs)
    finally:
        lexical_search.LEAF_DOCS = before
    item = [(t, r.randint(0, 50)) for t in range(8) if r.random() < 0.5]
    weights = np.zeros(9, np.int64)
    for t, w in item:
        weights[t] = w
    scores = np.array([sum(weights[t] * (1_000_000_000 * f // (1000 * f + 8 * m[d])) for t, f in zip(flat[at[d] : at[d + 1]].tolist(), tfs[at[d] : at[d + 1]].tolist())) for d in range(len(m))])
    assert sorted(tree.order.tolist()) == list(range(len(m)))
    assert (tree.scores(0, len(m), weights) == scores[tree.order]).all()
    bound = tree.bounds(item)
    for k in range(len(bound)):
        assert bound[k] >= scores[tree.order[tree.first[k] : tree.end[k]]].max()


def test_walk_leaves_subtrees_out():
    n = 4000
    vectors = [[d % 40, 40 + d // 40 % 100] for d in range(n)]
    at, flat = np.arange(0, 2 * n + 1, 2), np.array(vectors).ravel()
    tree = lexical_search.Tree(np.full(n, 100), at, flat, np.ones(2 * n, np.int64))
    lists = lexical_search.Lists({"x": [(3, 500)]}, 200, 10)
    assert lists.add(tree, list(range(n))) < n / 10
    assert [d % 40 for _, d in lists.best["x"]] == [3] * 10


@pytest.mark.parametrize("same", [False, True])
def test_terms_are_confirmed_by_bytes(monkeypatch, same):
    if same:  # all hashes alike: two names share one, other words too
        monkeypatch.setattr(lexical_search, "hashes", lambda data, start, end: (end - start).astype(np.uint64) * 0)
    names = [b"abc", b"abd"]
    data = np.frombuffer(b"ABC abd abe ab abcd", np.uint8)
    found = lexical_search.Terms(names).find(data, np.array([0, 4, 8, 12, 15]), np.array([3, 7, 11, 14, 19]))
    assert found.tolist() == [0, 1, -1, -1, -1]
