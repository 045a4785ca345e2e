import hashlib
import random
import zlib

import pytest

from lattica.llm import conversation_trie as trie

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, totals = {}, {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        totals[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children.get(p, [])), *totals[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p in members
    )


def found(df):
    assert df.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r)[:8] for r in df.collect()), key=lambda r: r[:2])


def made(seed):
    r = random.Random(seed)
    texts = ["", None, "a", "bb", "ccc", "é", "long " * 50]
    rows = [(r.randrange(60), r.choice([None, *range(9)]), r.choice(["user", "assistant", None, ""]), r.choice(texts)) for _ in range(250)]
    rows += [(200 + 5 * k + j, t, "user", f"{'same' if k % 3 else 'other'} {t}") for k in range(40) for j in range(3) for t in range(2 + k % 4)]  # copies, shared beginnings
    rows += [(401, t, "user", f"turn {t % 7}") for t in range(400)] + [(402, t, "user", f"turn {t % 7}") for t in range(380)]  # long ones
    rows += [(None, 1, "user", "no id"), (500, None, None, None), (500, None, None, None), (501, 3, "user", "x"), (501, 3, "user", "x"), (501, 3, "assistant", "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_below, shards, block", [(100_000, 4096, 8192), (20, 10**9, 16), (3, 10**9, 7)])
def test_by_hand(spark, monkeypatch, rows_below, shards, block):
    for name, value in (("SHARD_ROWS", rows_below), ("SHARDS", shards), ("BLOCK", block), ("SEGMENT", block)):
        monkeypatch.setattr(trie, name, value)
    rows = made(rows_below)
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS n", "'x' AS ends_sha256", "3 AS shard", "4 AS i", "5 AS part").repartition(3)
    assert found(trie.prefix_trie(table)) == by_hand(rows)


def test_small_and_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).count() == 0
    for rows in ([(3, 0, "user", "a")], [(c, 0, "user", "a") for c in range(12)]):  # conversations without turns, all alike
        assert found(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == by_hand(rows)


def test_many_ends(spark):
    rows = [(5 * c, t, "user", "same") for c in range(3000) for t in range(2)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == by_hand(rows)


def test_inbox_spills():
    r = random.Random(3)
    keys = sorted({(-r.randrange(50), r.randrange(30)) for _ in range(400)})
    inbox, expected = trie.Inbox(7), {}
    waiting = [(k, r.randrange(5), r.randrange(1000)) for k in keys for _ in range(r.randrange(4))]
    early, late = waiting[::2], waiting[1::2]
    for (level, name), a, b in r.sample(early, len(early)):
        inbox.put(-level, name, a, b)
    for (level, name), a, b in waiting:
        x, y = expected.get((level, name), (0, 0))
        expected[level, name] = (x + a, y + b)
    late = sorted(late)
    for i, (level, name) in enumerate(keys):
        if i == 0:
            for (k, n), a, b in late:
                inbox.put(-k, n, a, b)
        assert inbox.take(-level, name) == expected.get((level, name), (0, 0))
    assert not inbox.heap and not inbox.runs
