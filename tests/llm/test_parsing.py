"""Removal of repeated byte strings by prefix-free parsing, against brute force over all starts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import parsing


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start)
            at = len(r) if at < 0 else at
            spans.append((start, at))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), tuple(spans), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length, **options):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long, key string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["removed"]), r["kept_sha256"]) for r in parsing.repeats(docs, length, **options).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert got == want
    return sum(bool(x[1]) for x in want.values())


def made_up(seed, alphabet="abcdefgh é"):
    """Texts with planted passages of every length around the least one, in varied surroundings, and odd rows."""
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    shared = [some(rng.randint(20, 90)) for _ in range(8)]
    texts = [None, "", "a" * 200, "ab" * 150, "a" * 39, some(10), some(300)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(shared)
            i = rng.randint(0, 15)
            parts += [some(rng.randint(0, 40)), p[i : len(p) - rng.randint(0, 15)]]
        texts.append("".join(parts))
    return texts + texts[10:14] + [texts[20] + "x", "y" + texts[21]]


@pytest.mark.parametrize("options", [
    dict(window=4, modulus=5),
    dict(window=4, modulus=5, most_contexts=1, shard_bytes=500),
    dict(window=2, modulus=3, shard_bytes=2000),
    dict(window=8, modulus=40),
])
def test_equals_brute_force(spark, options):
    assert check(spark, made_up(1), 40, **options) > 20


def test_small_alphabet_has_periods_and_long_runs(spark):
    assert check(spark, made_up(2, "ab"), 40, window=4, modulus=3) > 20


def test_corpus_at_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    assert check(spark, [r[0] for r in docs.collect()], 400) > 0


def test_hot_passage_between_different_neighbours(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij") for _ in range(60))
    texts = ["".join(rng.choice("klmnopqrst") for _ in range(50)) + passage + "".join(rng.choice("klmnopqrst") for _ in range(50)) for _ in range(300)]
    for most in (10, 100_000):
        assert check(spark, texts, 40, window=4, modulus=5, most_contexts=most) == 300


def test_order_of_a_shard_finds_what_is_equal():
    """Strings as ``starts`` makes them: all starts in the first phrase, the next phrase inside."""
    rng = random.Random(3)
    length, window, modulus = 40, 4, 5
    strings = set()
    for text in made_up(7):
        raw = (text or "").encode()
        if len(raw) < length:
            continue
        start, stop = parsing.phrases(raw, window, modulus)
        low, high, phrase = parsing.starts(len(raw), start, stop, [True] * len(start), length)
        strings |= {raw[i : j + length - 1] for i, j, p in zip(low, high, phrase) if p >= 0}
    strings = sorted(strings)
    rng.shuffle(strings)
    times = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = {(n, i) for n, s in enumerate(strings) for i in range(len(s) - length + 1) if times[s[i : i + length]] > 1}
    got = parsing.repeated_starts(strings, length, window, modulus)
    assert set(zip(*(x.tolist() for x in got))) == want and want


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "q" * 500), (None, "q" * 500), (1, None)], "doc_id long, text string")
    assert parsing.repeats(docs.filter("doc_id = 0")).count() == 0
    rows = sorted((r["n_bytes"], len(r["removed"])) for r in parsing.repeats(docs).collect())
    assert rows == [(0, 0), (500, 1), (500, 1)]


def test_long_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, text + text[5000:6000])], "doc_id long, text string")
    row = parsing.repeats(docs).first()
    assert [(s["start"], s["stop"]) for s in row["removed"]] == [(5000, 6000), (1_000_000, 1_001_000)]


def test_short_ways_agree_with_long_ones():
    """Hashes read at once, thin starts told without the others, and seven bytes to begin the doubling with."""
    draw = random.Random(11)
    for _ in range(300):
        raw = bytes(draw.choices(b"ab" if draw.random() < 0.5 else range(256), k=draw.randint(0, 300)))
        plain = np.array([int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3)], dtype=np.uint64)
        mixed = parsing.grams(np.frombuffer(raw, dtype=np.uint8), 4)
        assert len(np.unique(plain)) == len(np.unique(mixed)) and len(mixed) == len(plain)
        assert parsing.triggers(mixed, 8).tolist() == [i for i, x in enumerate(mixed.tolist()) if x % 8 == 0]
        assert parsing.triggers(mixed, 7).tolist() == [i for i, x in enumerate(mixed.tolist()) if x % 7 == 0]
        if len(raw) >= 40:
            start, stop = parsing.phrases(raw, 4, 8)
            thin = parsing.starts(len(raw), start, stop, np.zeros(len(start), dtype=bool), 40)[2] < 0
            assert parsing.has_thin(len(raw), start, stop, 40) == thin.any()
        if raw:
            letters, end = np.frombuffer(raw, dtype=np.uint8), np.full(len(raw), len(raw))
            packed, known = parsing._packed(letters, end)
            suffixes = sorted({raw[i:] for i in range(len(raw))})
            assert known == 7
            assert parsing.ranks(packed, end, known).tolist() == [suffixes.index(raw[i:]) + 1 for i in range(len(raw))]
