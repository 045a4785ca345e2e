import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import exact_dedup, golomb, ngram_jaccard
from lattica.llm import textvec as tv
from lattica.llm.components import components, rooted

DOCS = "doc_id long, text string"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def norm(text):
    return (text or "").encode().translate(LOW)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True), st.integers(0, 40))
def test_golomb_round_trip(values, bits):
    values = np.array(sorted(values), np.uint64)
    bits = max(bits, golomb.rice_bits(2**64, max(len(values), 1)) - 3)
    assert golomb.decode(golomb.encode(values, 0, bits), len(values), 0, bits).tolist() == values.tolist()


ROWS = [
    (1, "Same text"), (9, "same TEXT"), (4, "same text"), (2, "Émile"), (3, "émile"), (5, None), (6, ""), (7, " "), (8, "x" * 300_000), (10, "X" * 300_000),
    (None, "same text"), (9, "same TEXT"), (11, "alone"), (11, "alone"), (None, None), (12, "\x00"), (13, "ſ"),
]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[norm(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(map(repr, out)), {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_groups(spark, parts):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(parts).selectExpr("doc_id", "text", "'a' AS norm", "1 AS block")
    found = exact_dedup.exact_groups(docs, owners=3).collect()
    want, stay = exact_by_hand(ROWS)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(stay)
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, stay.values()))


def test_deduplicated(spark):
    docs = spark.createDataFrame(ROWS, DOCS).selectExpr("*", "'z' AS sha", "doc_id AS group_size")
    left = exact_dedup.deduplicated(docs, owners=3)
    assert left.columns == docs.columns
    _, stay = exact_by_hand(ROWS)
    assert sorted(repr((r.doc_id, norm(r.text))) for r in left.collect()) == sorted(repr((i, t)) for t, i in stay.items())


def test_exact_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(docs, owners=2).count() == 0
    assert exact_dedup.deduplicated(docs, owners=2).count() == 0


def shingle_set(text, k):
    words = norm(text).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def groups_by_hand(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted(repr((d, len(sets[i]), d if not sets[i] else min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 5, 8, 12, 20, 60, 150]))] for _ in range(12)]
    common = [rnd.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        text = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        if rnd.random() < 0.2:
            text += common
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "\t "]).join(text)))
    return rows + [(2, None), (5, ""), (8, " \n"), (11, "one"), (14, "ONE"), (17, "one two three"), (17, "one two three"), (20, "a b a b"), (23, "B" * 100_000)]


@pytest.mark.parametrize(("k", "num", "den", "chunk"), [(4, 85, 100, 1024), (5, 80, 100, 1024), (4, 85, 100, 5), (2, 60, 100, 4)])
def test_jaccard_groups(spark, k, num, den, chunk):
    rows = corpus(k * chunk)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS set_id", "'q' AS component")
    found = ngram_jaccard.jaccard_groups(docs, k, num, den, chunk_sets=chunk)
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found.collect()) == groups_by_hand(rows, k, num, den)


def test_one_of_each(spark):
    rows = corpus(7, 60)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS lang")
    left = ngram_jaccard.one_of_each(docs, 5, 80, 100)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.collect())
    want = sorted({eval(x)[2] for x in groups_by_hand(rows, 5, 80, 100)})
    assert ids == want


def test_one_of_each_by_id_and_text(spark):
    a, b, c, d, e = ("alpha beta gamma delta epsilon zeta " * 3, "one two three four five six seven", "red green blue white black grey", "north east south west up down", "sun moon star sky rain snow")
    rows = [
        (1, a), (7, a.upper()), (7, b),  # one of 7's texts has a smaller copy, the other none
        (8, c), (8, d), (8, d),  # unrelated texts of one id, one of them repeated
        (None, e), (None, "quite another text with no id at all"), (None, c.upper()), (None, "never linked to any other text here"), (None, "never linked to any other text here"),
        (9, None), (9, ""), (8, None), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    left = [tuple(r) for r in ngram_jaccard.one_of_each(docs).collect()]
    gone = [(7, a.upper()), (None, c.upper()), (8, d), (None, "never linked to any other text here")]
    for row in gone:
        rows.remove(row)
    assert sorted(map(repr, left)) == sorted(map(repr, rows))


def test_jaccard_empty(spark):
    assert ngram_jaccard.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert ngram_jaccard.jaccard_groups(spark.createDataFrame([(1, None), (2, "")], DOCS)).count() == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(85, 100), (80, 100), (1, 2)]))
def test_linked_sets_meet_in_lists(seed, at):
    rnd = np.random.default_rng(seed)
    num, den = at
    a = rnd.choice(2**60, rnd.integers(1, 120), replace=False)
    b = a.copy()
    for _ in range(rnd.integers(0, 12)):
        if rnd.random() < 0.5 and len(b) > 1:
            b = np.delete(b, rnd.integers(len(b)))
        else:
            b = np.append(b, rnd.integers(2**60))
    c = rnd.choice(2**60, rnd.integers(1, 120), replace=False)
    sets = [np.unique(x).astype(np.uint64) for x in (a, b, c, a[: len(a) // 2 + 1], np.append(a, c[:3]))]
    size = np.array([len(x) for x in sets])
    row, token = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    row, token, bound = ngram_jaccard.prefixes(row, token, size, (token % np.uint64(7)).astype(np.int64), num, den)
    order, link, other, keep = ngram_jaccard.listed(token, size[row], bound)
    row = row[order]
    root = rooted(len(sets), row[link], row[other[link]])
    # the entries that are kept, met by those of one set alone, connect it as all entries do
    linked = lambda x, y: den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))
    for i in range(len(sets)):
        for j in range(i):
            assert not linked(sets[i], sets[j]) or root[i] == root[j]
    first = np.flatnonzero(keep)
    token, bound = token[order], bound[order]
    x, y = first, np.arange(len(token))
    meets = (token[x][:, None] == token[y]) & (size[row[x]][:, None] <= bound[y]) & (size[row[y]] <= bound[x][:, None])
    u, v = np.nonzero(meets)
    assert (rooted(len(sets), row[x[u]], row[y[v]]) == root).all()


@pytest.mark.parametrize("seed", range(3))
def test_join_within_a_component(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.choice(10**6, 300, replace=False)
    sets = [np.unique(np.where(rnd.random(300) < rnd.choice([0.01, 0.05, 0.08]), rnd.choice(10**6, 300), base)).astype(np.uint64) for _ in range(400)]
    common = [len(np.intersect1d(a, b)) for a in sets for b in sets]
    size = np.array([len(x) for x in sets])
    linked = 100 * np.array(common).reshape(400, 400) >= 85 * (size[:, None] + size - np.array(common).reshape(400, 400))
    assert (ngram_jaccard.Joined(sets, 85, 100, block=8).join() == rooted(400, *np.nonzero(linked))).all()


def test_a_group_over_one_chunk(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(1300):
        text = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            text[rnd.randrange(40)] = f"x{rnd.randrange(60)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = ngram_jaccard.jaccard_groups(docs, 4, 85, 100)
    want = groups_by_hand(rows, 4, 85, 100)
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found.collect()) == want
    assert 1 < len({x.rsplit(",")[2] for x in want}) < 1300


def test_words_and_shingles():
    column = pa.array(["A b  c", None, "", "a B c a b c a", "é\x0b\x1cx"])
    data, at = tv.buffers(column)
    row, word = tv.words(data, at)
    assert np.bincount(row, minlength=5).tolist() == [len(norm(t).split(None)) if t else 0 for t in column.to_pylist()][:4] + [2]
    assert word[0] == word[3] == word[6]
    row, _ = tv.shingles(row, word, 3, 5)
    assert np.bincount(row, minlength=5).tolist() == [1, 0, 0, 3, 1]
    sliced = column.slice(3, 1)
    data, at = tv.buffers(sliced)
    assert len(data) == at[-1] == 13


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(120)] + [(500, 500), (7, None)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_places_are_not_broadcast(spark, monkeypatch):
    """In a large component each set has many places; they are made after the join, so a broadcast has one row a set."""
    half = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(61)]
    docs = spark.createDataFrame([(i, f"{half[i]} {half[i + 1]}") for i in range(60)], "doc_id long, text string")
    plans, real = [], ngram_jaccard.written

    def kept(df, name, *more):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(ngram_jaccard, "written", kept)
    found = ngram_jaccard.jaccard_groups(docs, chunk_sets=4).collect()
    assert len(plans) == 2 and all(p.index("Generate explode") < p.index("Join Inner") for p in plans)
    assert sorted((x.doc_id, x.component_id) for x in found) == [(i, i) for i in range(60)]
