"""Block search against scoring every posting."""

import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import lexical_index, ranking as R
from lexigraph.operators.lexical_index import LexicalIndex
from lexigraph.session import materialize


def corpus(spark, nodes=600, seed=2):
    """Words with a skewed distribution; one stands in every node."""
    draw = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for n in range(nodes):
        words = ["common"] * draw.randint(1, 6) + [vocabulary[min(199, int(draw.expovariate(0.04)))] for _ in range(draw.randint(1, 60))]
        draw.shuffle(words)
        rows.append((f"n{n:04d}", " ".join(words)))
    return spark.createDataFrame(rows + [("empty", ""), ("null", None)], "uuid string, text string").repartition(3)


def asked(spark):
    texts = ["common wordaa wordjf", "common", "wordab wordzc wordac common", "absentword", "", "wordrh wordqh", "common common wordba"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["uuid"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("block,limit", [(4, 3), (16, 10), (128, 700)])
def test_same_rows_as_every_posting(spark, tmp_path, block, limit):
    nodes = corpus(spark)
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=block)
    want = rows(R.bm25(asked(spark), R.lexical_postings(nodes, F.col("text")), limit))
    assert rows(index.search(asked(spark), limit)) == want
    assert len({q for q, *_ in want}) == 5


def test_most_postings_of_common_words_stay_closed(spark, tmp_path):
    nodes = corpus(spark)
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=8)
    open_, shut, _ = index.opened(asked(spark), 5)
    count = lambda blocks: index._gains(blocks.select("query_id", "token", "number", "idf")).count()
    read, left = count(open_), count(shut)
    assert read < 0.5 * (read + left)
    postings = R.lexical_postings(nodes, F.col("text"))
    words = asked(spark).select("query_id", F.explode(F.array_distinct(F.split("query", " "))).alias("token"))
    assert read + left == postings.join(words, "token").count()


def test_index_keeps_its_statistics(spark, tmp_path):
    nodes = corpus(spark, 50)
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=7)
    postings = R.lexical_postings(nodes, F.col("text"))
    df = {r["token"]: r["n"] for r in postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["token"]: r["df"] for r in index.tokens().collect()} == df
    assert index.facts()["size"] == 50
    blocks = index.blocks().collect()
    assert all(b["most"] == b["impacts"][0] and list(b["impacts"]) == sorted(b["impacts"], reverse=True) and len(b["uuids"]) <= 7 for b in blocks)
    assert len({b["number"] for b in blocks}) == len(blocks)


def test_ties_at_the_threshold(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i:03d}", "same text here") for i in range(100)], "uuid string, text string")
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=3)
    found = rows(index.search(spark.createDataFrame([(1, "same text")], "query_id long, query string"), 7))
    assert [r[2] for r in found] == [f"n{i:03d}" for i in range(7)]


def test_empty_index(spark, tmp_path):
    index = LexicalIndex.build(corpus(spark).limit(0), F.col("text"), str(tmp_path / "index"))
    assert index.search(asked(spark), 3).count() == 0


def test_segments_of_a_word(spark, tmp_path):
    """A word's postings are cut in bounded segments, from lists that are shorter than a row for each posting."""
    nodes = corpus(spark, 300)
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=8, segment=50)
    postings = R.lexical_postings(nodes, F.col("text"))
    assert rows(index.search(asked(spark), 9)) == rows(R.bm25(asked(spark), postings, 9))
    held = index.blocks().filter("token = 'common'").select(F.explode("uuids").alias("uuid"))
    assert held.count() == held.distinct().count() == 300


def test_sums_of_open_blocks_leave_few_candidates(spark, tmp_path, monkeypatch):
    written = {}

    def keep(df, name):
        written[name] = materialize(df, name)
        return written[name]

    monkeypatch.setattr(lexical_index, "materialize", keep)
    nodes = corpus(spark)
    index = LexicalIndex.build(nodes, F.col("text"), str(tmp_path / "index"), block=8)
    assert written["index-postings"].count() < R.lexical_postings(nodes, F.col("text")).count() / 4
    one = spark.createDataFrame([(0, "wordaa wordba wordca wordda wordea wordfa wordga common")], "query_id long, query string")
    want = rows(R.bm25(one, R.lexical_postings(nodes, F.col("text")), 5))
    assert rows(index.search(one, 5)) == want
    open_, _, threshold = index.opened(one, 5)
    met = index._gains(open_).groupBy("uuid").agg(F.sum("gain").alias("partial"))
    fifth = met.orderBy(F.desc("partial")).limit(5).agg(F.min("partial")).first()[0]
    candidates = written["candidates"]
    assert fifth > threshold.first()["threshold"]
    assert candidates.filter(F.col("partial") + F.col("more") < fifth - 1e-6).count() == 0
    assert 5 <= candidates.count() <= met.count()
