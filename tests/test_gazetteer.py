"""The dictionary tagger against scanning every place for every name."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lexigraph.functions import entities as E
from lexigraph.operators import entities as O, gazetteer as G, graph

NAMES = [
    ("United States", "LOC"), ("United States Senate", "ORG"), ("Senate", "ORG"), ("New York", "LOC"), ("York", "LOC"), ("new-york", "LOC"),
    ("York Senate", "ORG"), ("Österreich", "LOC"), ("A", "ORG"), ("a a", "LOC"), ("...", "LOC"), (None, "LOC"), ("", "ORG"), ("Senate", "LOC"),
]


def brute(text, names):
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
    known = {}
    for name, kind in names:
        key = tuple(m.group().lower() for m in re.finditer(r"[^\W_]+", name or ""))
        if key:
            known[key] = min(kind, known.get(key, kind))
    hits = [(i, len(k), t) for i in range(len(words)) for k, t in known.items() if tuple(w for w, _, _ in words[i : i + len(k)]) == k]
    kept = []
    for at, n, kind in hits:
        rivals = [(m, -b) for b, m, _ in hits if b < at + n and at < b + m]
        if all(max(r for r in rivals if -r[1] <= w < -r[1] + r[0]) == (n, -at) for w in range(at, at + n)):
            kept.append((text[words[at][1] : words[at + n - 1][2]], kind, words[at][1], words[at + n - 1][2]))
    return sorted(kept)


def tagged(spark, texts, names):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = G.gazetteer_mentions(docs, spark.createDataFrame(names, "name string, type string")).collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r["doc_id"]].append((r["text"], r["type"], r["start"], r["end"]))
    return {i: sorted(v) for i, v in out.items()}


def test_longest_names_win(spark):
    texts = ["The United States Senate in New York.", "new\nYORK senate", "österreich und a a a", None, "", "none of them", "United, States; united states' senates"]
    got = tagged(spark, texts, NAMES)
    assert got == {i: brute(t, NAMES) for i, t in enumerate(texts)}
    assert got[0] == [("New York", "LOC", 28, 36), ("United States Senate", "ORG", 4, 24)]


def test_agrees_with_scanning_on_random_texts(spark):
    draw = random.Random(6)
    names = [(" ".join(draw.choice("abcde") for _ in range(draw.randint(1, 4))), draw.choice(["LOC", "ORG"])) for _ in range(60)]
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 40))) for _ in range(80)]
    got = tagged(spark, texts, names)
    assert got == {i: brute(t, names) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 300


def test_mentions_feed_other_operators(spark):
    docs = spark.createDataFrame([(1, "Ana Maria met the United States Senate in New York in 2019."), (2, None), (3, "nothing")], "episode_id long, content string")
    names = spark.createDataFrame(NAMES[:5], "name string, type string")
    rows = {r["episode_id"]: [(m["text"], m["type"]) for m in r["mentions"]] for r in G.with_mentions(docs, names, "episode_id", "content").collect()}
    assert rows[1] == [("United States Senate", "ORG"), ("New York", "LOC"), ("Ana Maria", "PER"), ("2019", "DATE")]
    assert rows[2] == [] and rows[3] == []
    timed = G.with_mentions(docs, names, "episode_id", "content").withColumn("reference_time", F.lit("2024-01-01").cast("timestamp"))
    nodes, _ = graph.build(timed, extract=lambda text: F.col("mentions"))
    assert {"ORG", "LOC", "PER", "DATE"} <= {label for r in nodes.collect() for label in r["labels"]}


def test_a_pandas_udf_is_an_extractor(spark):
    @F.pandas_udf(f"array<{E.MENTION}>")
    def capitals(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": m.group(), "type": "ORG", "start": m.start(), "end": m.end(), "label": "ORG"} for m in re.finditer(r"[A-Z]{2,}", t or "")])

    docs = spark.createDataFrame([(1, "the UN and NATO met the UN")], "doc_id long, text string")
    assert [r.keyword for r in O.entity_keywords(docs, extract=capitals).collect()] == ["UN", "NATO"]
    episodes = docs.select(F.col("doc_id").alias("episode_id"), F.col("text").alias("content"), F.lit("text").alias("type"))
    assert O.enrich(episodes, extract=capitals).first()["entities_by_type"] == {"ORG": ["UN", "NATO"]}


def test_no_names_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    names = spark.createDataFrame(NAMES, "name string, type string")
    assert G.gazetteer_mentions(docs, names.limit(0)).count() == 0
    assert G.gazetteer_mentions(docs.limit(0), names).count() == 0


def test_names_of_one_first_word_are_met_by_all_their_words(spark):
    names = spark.createDataFrame([(f"Supplier#{i:05d}", "ORG") for i in range(400)] + [("Supplier", "ORG")], "name string, type string")
    docs = spark.createDataFrame([(i, f"by Supplier#{i:05d} and supplier") for i in range(300)], "doc_id long, text string")
    found = G.gazetteer_mentions(docs, names)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted(x for i in range(300) for x in ((i, f"Supplier#{i:05d}"), (i, "supplier")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "first" not in joins[0] and "words" in joins[0]
