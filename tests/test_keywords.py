import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import keywords as K
from lexigraph.operators.sketch import sketch
from test_text import words_by_hand

TEXTS = [
    "MACHINE LEARNING\nMachine learning changes software. Software learning needs data! Data changes machine learning?",
    "# Gardens\nRoses bloom early. Tulips bloom late, roses bloom again.",
    "single sentence about nothing special",
    "   ",
    "machine data machine data. learning machine data",
]
OPTIONS = K.KeywordOptions()


@pytest.fixture(scope="module")
def docs(spark):
    # A third of all rows are copies of one text.
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, TEXTS[4]) for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def scores(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, {})[r.keyword] = r.score
    return out


def near(a, b):
    assert a.keys() == b.keys()
    for doc in a:
        assert a[doc].keys() == b[doc].keys(), doc
        for word in a[doc]:
            assert a[doc][word] == pytest.approx(b[doc][word]), (doc, word)


def textrank_by_hand(text):
    sentences = [s.strip() for s in re.split(r"[.!?]+", text) if s.strip()]
    if len(sentences) < 2:
        return {w: float(n) for w, n in Counter(words_by_hand(text)).items()}
    degree, count = Counter(), Counter()
    for sentence in sentences:
        tokens = words_by_hand(sentence)
        count.update(tokens)
        for a in set(tokens):
            degree[a] += len(set(tokens)) - 1
    return {w: degree[w] / (count[w] + 1) for w in count}


def tfidf_by_hand(text, frequencies, size):
    weights = {w: n * math.log2(size / frequencies[w]) for w, n in Counter(words_by_hand(text)).items()}
    weights = {w: x for w, x in weights.items() if abs(x) > 1e-12}
    norm = math.sqrt(sum(x * x for x in weights.values()))
    return {w: x / norm for w, x in weights.items()}


def test_counts_and_textrank(docs):
    texts = texts_of(docs)
    near(scores(K.word_freq(docs)), {d: dict(Counter(words_by_hand(t))) for d, t in texts.items() if words_by_hand(t)})
    near(scores(K.textrank(docs)), {d: textrank_by_hand(t) for d, t in texts.items() if words_by_hand(t)})


def test_tfidf_against_itself_and_a_corpus(spark, docs):
    texts = texts_of(docs)
    df = Counter(w for t in texts.values() for w in set(words_by_hand(t)))
    expected = {d: tfidf_by_hand(t, df, len(texts)) for d, t in texts.items()}
    near(scores(K.tfidf(docs)), {d: s for d, s in expected.items() if s})
    corpus = ["machine data", "roses", ""]
    grown = Counter(w for t in corpus for w in set(words_by_hand(t)))
    expected = {}
    for d, t in texts.items():
        own = Counter({w: grown[w] + 1 for w in words_by_hand(t)})
        expected[d] = tfidf_by_hand(t, own, len(corpus) + 1)
    table = spark.createDataFrame([(t,) for t in corpus], "text string")
    near(scores(K.tfidf(docs, corpus=table)), {d: s for d, s in expected.items() if s})


def test_tfidf_without_a_corpus_falls_back_to_counts(spark, docs):
    empty = spark.createDataFrame([], "text string")
    assert K.tfidf(docs, corpus=empty).count() == 0
    alone = K.extract(docs, options=OPTIONS).collect()
    counted = K.extract(docs, options=replace(OPTIONS, method="word_freq")).collect()
    unknown = K.extract(docs, options=replace(OPTIONS, method="no such method")).collect()
    assert alone == counted == unknown
    assert K.extract(docs, corpus=empty, options=OPTIONS).collect() == alone
    combined = replace(OPTIONS, method="combined")
    assert K.extract(docs, corpus=empty, options=combined).collect() == K.extract(docs, options=combined).collect() != []
    assert {r.doc_id for r in alone} == {d for d, t in texts_of(docs).items() if t.strip()}


def test_extract_and_tfidf_agree_on_the_corpus(docs):
    plain = scores(K.tfidf(docs))
    top = scores(K.extract(docs, self_corpus=True, options=replace(OPTIONS, num_keywords=100, enable_ngrams=False)))
    near(top, plain)


def test_combined_score(docs):
    found = scores(K.combined(docs, use_corpus=False))[0]
    rank = textrank_by_hand(TEXTS[0])
    count = Counter(words_by_hand(TEXTS[0]))
    base = 0.5 * rank["machine"] + 0.3 * count["machine"] / max(count.values())
    assert found["machine"] == pytest.approx(base * (1 + 0.2 * (1.5 * 2.0 - 1)))
    base = 0.5 * rank["data"] + 0.3 * count["data"] / max(count.values())
    assert found["data"] == pytest.approx(base)


def test_words_that_only_a_sentence_shows_count_for_no_df(spark):
    texts = ["alpha beta.gamma delta. alpha", "gamma words here. more words", "other text. words"]  # a text reads betagamma
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    only = replace(OPTIONS, textrank_weight=0.0, word_freq_weight=0.0, position_weight=0.0)
    near(scores(K.combined(docs, options=only)), scores(K.tfidf(docs)))


def test_extract_ranks_phrases_and_words(docs):
    rows = [r for r in K.extract(docs, options=replace(OPTIONS, method="word_freq", num_keywords=4)).collect() if r.doc_id == 4]
    assert [(r.rank, r.keyword, r.type) for r in rows] == [
        (1, "machine data", "2-gram"), (2, "data", "unigram"), (3, "machine", "unigram"), (4, "data learning", "2-gram"),
    ]
    assert [r.score for r in rows] == pytest.approx([3.6, 3.0, 3.0, 1.2])
    words = K.extract(docs, options=replace(OPTIONS, method="textrank", enable_ngrams=False))
    assert {r.type for r in words.collect()} == {"unigram"}
    lists = {r.doc_id: r.keywords for r in K.keyword_lists(K.extract(docs, options=replace(OPTIONS, num_keywords=2))).collect()}
    assert lists[4] == ["machine data", "data"]


def test_result_does_not_depend_on_row_order(docs):
    options = replace(OPTIONS, method="combined", num_keywords=5)
    a = sorted(K.extract(docs, self_corpus=True, options=options).collect())
    b = sorted(K.extract(docs.orderBy(F.desc("doc_id")).repartition(3), self_corpus=True, options=options).collect())
    assert a == b


def test_local_methods_do_not_shuffle(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a text about words. more words").alias("text"))
    for method in ("tfidf", "textrank", "word_freq", "combined"):
        plan = K.extract(docs, options=replace(OPTIONS, method=method))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


@pytest.mark.parametrize("bad", [{"num_keywords": 0}, {"num_keywords": 101}, {"max_ngram": 5}, {"tfidf_weight": -1.0}, {"min_word_length": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        K.KeywordOptions(**bad)


def test_ngram_sizes():
    assert K.KeywordOptions(min_ngram=1).sizes == [2, 3, 4]
    assert K.KeywordOptions(min_ngram=4, max_ngram=2).sizes == [2, 3, 4]
    assert K.KeywordOptions(min_ngram=3, max_ngram=3).sizes == [3]
    assert K.KeywordOptions(enable_ngrams=False).sizes == []


def test_a_word_of_every_document_is_split_over_tasks(spark):
    """Broadcasts off and small skew limits: the join with the counts must be one that can be split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("everywhere word"), "id").alias("text")).repartition(8)
        scored = K.tfidf(docs)
        assert scored.count() >= 0
        scored.write.format("noop").mode("overwrite").save()
        plan = scored._jdf.queryExecution()
        rows = scored.collect()
        assert "skew=true" in plan.executedPlan().toString() and rows is not None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sketch_never_calls_a_repeated_key_single(spark):
    keys = [draw * 7919 for draw in (*range(300), *range(100, 150), 7, 7, 7, -3, -3, -(2**49))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    for slots, few in ((8, False), (1 << 16, True)):
        known = sketch(rows, slots)
        asked = spark.createDataFrame([(k,) for k in {*keys, *range(10**9, 10**9 + 200)}], "k long")
        looked = asked.select("k", known.may_occur(F.col("k"), spark).alias("occurs"), known.may_repeat(F.col("k"), spark).alias("repeats")).collect()
        for r in looked:
            n = keys.count(r["k"])
            assert (r["occurs"] or n == 0) and (r["repeats"] or n < 2)
        if few:  # and it tells most of what it could
            assert sum(r["repeats"] for r in looked) < 80 and sum(r["occurs"] for r in looked) < 350
    empty = sketch(rows.limit(0), 8)
    assert not rows.filter(empty.may_occur(F.col("k"), spark)).count()


def test_phrases_of_one_document_are_not_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    corpus = docs.filter("doc_id % 2 = 0")
    plain = lambda df: sorted((r["doc_id"], r["n"], r["keyword"], round(r["score"], 9)) for r in df.collect())
    rows = K.ngram_freq(docs).withColumnRenamed("score", "tf")
    for against in (None, corpus):
        told = plain(K.ngram_tfidf(docs, corpus=against))
        with monkeypatch.context() as patch:  # a sketch that says nothing: every phrase is joined
            patch.setattr(K, "sketch", lambda keys, slots: sketch(keys, 8))
            assert plain(K.ngram_tfidf(docs, corpus=against)) == told
    shared, counted, alone = K.shared_phrases(rows, rows, True)
    moved, left = shared.count(), alone.count()
    assert moved + left == rows.count() and moved < 0.6 * (moved + left) and counted is shared
    single = rows.groupBy("n", "keyword").count().filter("count = 1").count()
    assert left > 0.9 * single


def test_phrases_are_those_of_the_column_rules(spark):
    """Counts, the most frequent and TF-IDF against the plain expressions, also for signs that sort before a blank and several runs of rows."""
    odd = ["alpha\x01 beta alpha beta gamma alpha\x01 beta", "alpha beta alpha\x02 beta", None, "", "one", "new the old car their car " * 30, "Ünï çödé wörd wörd " * 9]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).repartition(3).cache()
    plain = K.KeywordOptions(stemmer=lambda words: words, num_keywords=7)  # a stemmer takes the expressions
    fast = replace(plain, stemmer=None)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    rounded = lambda df: df.withColumn("score", F.round("score", 9))
    assert rows(K.ngram_freq(docs, options=fast)) == rows(K.ngram_freq(docs, options=plain))
    for corpus in (None, docs.filter("doc_id % 3 = 0")):
        assert rows(rounded(K.ngram_tfidf(docs, corpus=corpus, options=fast))) == rows(rounded(K.ngram_tfidf(docs, corpus=corpus, options=plain)))
        own = dict(self_corpus=corpus is None, corpus=corpus)
        for method in ("tfidf", "combined", "word_freq"):
            a, b = (rounded(K.extract(docs, options=replace(o, method=method), **own)) for o in (fast, plain))
            assert rows(a) == rows(b), method


def test_phrases_do_not_move_as_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = K.ngram_tfidf(docs)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("keyword" in line for line in moved)


ODD_TEXTS = [
    "One river meets a bridge. The bridge meets the tower! River, tower, river? A <b>tag <i.nside</b> is gone > here.",
    "single sentence river river bridge", "", "...", None, "river\x02bridge. tower river.", "Ünïcode ΟΔΟΣ. Σίσυφος ΟΔΟΣ! naïve 12 ab",
    "a. b. c.", "river. . \x1c tower\x1driver. river",
]


@pytest.mark.parametrize("shortest", [1, 3])
def test_word_scores_of_a_batch_are_those_of_the_row(spark, shortest):
    options = K.KeywordOptions(min_word_length=shortest)
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id int, text string")
    text = F.col("text")
    rows = docs.select(
        K.textrank_entries(text, options).alias("batch"), K._textrank_in_row(text, options).alias("row"),
        K._frequent_entries(options.tokens(text), options).alias("frequent"), K.freq_entries(options.tokens(text)).alias("counts"),
    ).collect()
    for r in rows:
        assert r["batch"] == r["row"]
        words = sorted((e for e in r["frequent"] or [] if e["type"] == "unigram"), key=lambda e: e["item"])
        assert [(e["item"], e["score"]) for e in words] == [tuple(e) for e in r["counts"] or []][: len(words)] and len(words) == min(10, len(r["counts"] or []))


@pytest.mark.parametrize("method, batches", [("textrank", 2), ("combined", 2), ("word_freq", 1)])
def test_words_are_counted_in_batches_without_an_exchange(spark, method, batches):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id int, text string")
    plan = K.extract(docs, options=replace(K.KeywordOptions(), method=method))._jdf.queryExecution().optimizedPlan().toString()
    evaluated = plan.split("ArrowEvalPython [")[1].split("pythonUDF0")[0]
    assert evaluated.count("read(") == batches
    assert method != "word_freq" or "sequence(" not in plan


def test_hashes_of_phrases_are_gone_before_phrases_are_weighed(spark):
    docs = spark.createDataFrame([(1, "green apples fall slowly"), (1, "green apples fall slowly"), (1, "red apples fall slowly"), (2, None)], "doc_id long, text string")
    scored = K.ngram_tfidf(docs)
    assert "Window" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.n, r.keyword, round(r.score, 6)) for r in scored.collect())
    # of four rows three have the last two bigrams, two the first trigram; each size has unit length in its row
    idf = [math.log2(4 / df) for df in (2, 3, 3)]
    norm = math.sqrt(sum(w * w for w in idf))
    want = [(2, "green apples", idf[0] / norm), (2, "apples fall", idf[1] / norm), (2, "fall slowly", idf[2] / norm)]
    assert [r for r in rows if r[0] == 2 and "red" not in r[1]].count((2, "green apples", round(want[0][2], 6))) == 2
    alone = [math.log2(4 / df) for df in (1, 3, 3)]
    norm_alone = math.sqrt(sum(w * w for w in alone))
    assert (2, "red apples", round(alone[0] / norm_alone, 6)) in rows and (2, "apples fall", round(alone[1] / norm_alone, 6)) in rows
    assert {(n, p) for n, p, _ in rows} >= {(3, "green apples fall"), (3, "apples fall slowly"), (4, "red apples fall slowly")}
