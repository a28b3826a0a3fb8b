"""The conversation trie against rebuilding every conversation whole."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from lexigraph.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, depth long, low string"


def brute(rows):
    stored = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            stored[conv].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [t[2:] for t in sorted(v)] for c, v in stored.items()}
    members = defaultdict(list)
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = stored.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]  # the remainder as in SQL
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    if not members:
        return []
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c, ends_here in members[node] if ends_here)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(c for c, _ in members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def check(spark, rows, partitions=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).repartition(partitions)
    got = trie.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = brute(rows)
    assert got == want
    return want


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(0, 40), *range(100, 160), *range(205, 220), 1234567]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 2)))
    nodes = check(spark, rows)
    assert max(n[1] for n in nodes) >= 6 and any(n[4] > 2 for n in nodes)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, None, "é\U0001f600"), (7, None, "user", None), (7, 3, "", ""),
        (None, 0, "user", "lost"), (301, 0, "user", "absent base"), (302, 0, "user", "x" * 100_000), (302, 1, "user", "x" * 100_000),
        (-5, 0, "user", "negative"), (9, 0, "us", "era"), (9, 1, "use", "ra"),
    ]
    check(spark, rows)


def test_one_conversation_over_many_ranges(spark):
    """A third of all rows in one conversation, and its copies; ranges are crossed many times."""
    rows = [(c, t, "user", "w" * (t % 7)) for c in (100, 101, 102) for t in range(400)] + [(c, 0, "user", "same") for c in range(200, 300)]
    check(spark, rows, 8)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(df).count() == 0


def test_fingerprints_are_a_monoid():
    turns = [trie.element("user", str(i)) for i in range(9)]

    def whole(values):
        h = 0
        for v in values:
            h = trie.product(h, v, 1)
        return h

    a, b = whole(turns[:4]), whole(turns[4:])
    assert trie.product(a, b, 5) == whole(turns)
    assert trie.quotient(whole(turns), a, 5) == b
    assert trie._value(*trie._pack(a)) == a
    assert trie.element("ab", "c") != trie.element("a", "bc")


def test_collisions_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(trie, "_lift", lambda role, text: (1, 0, 0, 0, 0))
    rows = [(200, 0, "user", "a"), (300, 0, "user", "b"), (400, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(RuntimeError, match="fingerprint"):
        trie.trie(df)
