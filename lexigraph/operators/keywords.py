"""Keyword statistics over a table of documents ``(id, text)``.

Counts, co-occurrence and position scores of one document are row-local.
Only corpus statistics (TF-IDF) shuffle: one combined count per term, one join
on the term and one exchange by document for the norm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.functions import text as T
from lexigraph.functions.arrays import let, sum_by_item, tally
from lexigraph.operators import phrases as P
from lexigraph.operators.sketch import SLOTS, sketch
from lexigraph.session import materialize, temporary

EPSILON = 1e-12
RANK_DIGITS = 9


@dataclass(frozen=True)
class KeywordOptions:
    """Settings of a keyword run; invalid values are refused here, on the driver."""

    method: str = "tfidf"
    num_keywords: int = 10
    min_word_length: int = 3
    max_word_length: int = 50
    custom_stopwords: Iterable[str] = ()
    tfidf_weight: float = 1.0
    textrank_weight: float = 0.5
    word_freq_weight: float = 0.3
    position_weight: float = 0.2
    title_weight: float = 2.0
    first_sentence_weight: float = 1.5
    enable_ngrams: bool = True
    min_ngram: int = 2
    max_ngram: int = 4
    ngram_weight: float = 1.2
    stemmer: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "custom_stopwords", tuple(self.custom_stopwords))
        bounds = {
            "num_keywords": (1, 100),
            "min_word_length": (1, 50),
            "max_word_length": (1, 100),
            "min_ngram": (1, 4),
            "max_ngram": (2, 4),
        }
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie within {low}..{high}")
        weights = [
            "tfidf_weight", "textrank_weight", "word_freq_weight", "position_weight",
            "title_weight", "first_sentence_weight", "ngram_weight",
        ]
        for name in weights:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")

    @property
    def sizes(self) -> list[int]:
        """N-gram sizes; a minimum of 1 only says that single words count too."""
        low = 2 if self.min_ngram == 1 else max(2, min(self.min_ngram, 4))
        high = max(2, min(self.max_ngram, 4))
        low, high = min(low, high), max(low, high)
        return list(range(low, high + 1)) if self.enable_ngrams else []

    def tokens(self, text: Column) -> Column:
        return T.tokenize(text, self.min_word_length, self.max_word_length, self.custom_stopwords, self.stemmer)

    def grams(self, tokens: Column, n: int) -> Column:
        """N-grams of :meth:`tokens`, which hold stopwords only where a stemmer made them."""
        stopwords = T.stopword_set(self.custom_stopwords) if self.stemmer else []
        return T.ngrams(tokens, n, self.min_word_length, self.max_word_length, stopwords, self.stemmer is None)

    @property
    def rules(self) -> P.Rules:
        return P.Rules(tuple(self.sizes), self.min_word_length, self.max_word_length)


# -- row-local statistics: Column -> Column -----------------------------------


def freq_entries(tokens: Column) -> Column:
    """array<struct<item, score>> of word counts."""
    return F.transform(tally(tokens), lambda e: F.struct(e["item"].alias("item"), e["n"].cast("double").alias("score")))


def _sentence_entries(sentences: Column, options: KeywordOptions) -> Column:
    """Per sentence and distinct token: its count and how many other tokens it meets."""
    return F.flatten(
        F.transform(
            sentences,
            lambda s: let(
                tally(options.tokens(s)),
                lambda counts: F.transform(
                    counts,
                    lambda e: F.struct(
                        e["item"].alias("item"), e["n"].alias("n"), (F.size(counts) - 1).alias("met")
                    ),
                ),
            ),
        )
    )


def _word_scores(text: Column, options: KeywordOptions, tokens: Column | None = None) -> Column:
    """:func:`phrases.word_scores` of a text; ``tokens`` are left out of texts of two sentences and more if not given.

    Null for texts that hold the sign put between sentences.
    """
    odd = F.contains(text, F.lit(T.SENTENCE_END))
    sentences = T.sentences(text)
    several = ~odd & (F.size(sentences) >= 2)
    cut = F.when(several, T.sentence_words(sentences, options.min_word_length, options.max_word_length, options.custom_stopwords))
    whole = F.when(~odd & ~several, options.tokens(text)) if tokens is None else tokens
    return F.when(~odd, P.word_scores(whole, cut, T.SENTENCE_END))


def textrank_entries(text: Column, options: KeywordOptions) -> Column:
    """array<struct<item, score>>: co-occurrence degree over (count + 1).

    A token gains one per other distinct token of a sentence, so the degree
    is a sum of set sizes and no pair is ever formed.
    """
    in_row = _textrank_in_row(text, options)
    if options.stemmer is not None:
        return in_row
    entry = lambda e: F.struct(e["item"].alias("item"), e["tr"].alias("score"))
    return F.coalesce(F.transform(_word_scores(text, options), entry), in_row)


def _textrank_in_row(text: Column, options: KeywordOptions) -> Column:
    """:func:`textrank_entries` by column expressions, for any stemmer and any sign in the text."""
    return let(
        T.sentences(text),
        lambda sentences: F.when(
            F.size(sentences) < 2, freq_entries(options.tokens(text))
        ).otherwise(
            F.transform(
                sum_by_item(_sentence_entries(sentences, options), ["n", "met"]),
                lambda e: F.struct(e["item"].alias("item"), (e["met"] / (e["n"] + 1)).alias("score")),
            )
        ),
    )


def position_factor(keyword: Column, first_sentence: Column, titles: Column, options: KeywordOptions) -> Column:
    """Multiplier for keywords in the first sentence and in a heading line."""
    lowered = F.lower(keyword)
    in_first = F.when(F.contains(first_sentence, lowered), options.first_sentence_weight).otherwise(1.0)
    in_title = F.when(F.exists(titles, lambda t: F.contains(t, lowered)), options.title_weight).otherwise(1.0)
    return in_first * in_title


def _local_terms(text: Column, options: KeywordOptions) -> Column:
    """Everything about single words that one document decides alone.

    array<struct<item, tf, base, boost>>: raw count, weighted textrank plus
    frequency, and the position multiplier of the combined score.
    """
    def tagged(entries: Column, field: str) -> Column:
        return F.transform(
            entries,
            lambda e: F.struct(
                e["item"].alias("item"),
                (e["score"] if field == "tf" else F.lit(0.0)).alias("tf"),
                (e["score"] if field == "tr" else F.lit(0.0)).alias("tr"),
            ),
        )

    def score(merged: Column, opening: Column, titles: Column, top: Column) -> Column:
        def one(e: Column) -> Column:
            factor = F.when(opening.isNotNull(), position_factor(e["item"], opening, titles, options)).otherwise(1.0)
            share = e["tf"] / F.greatest(top, F.lit(1.0))
            return F.struct(
                e["item"].alias("item"),
                e["tf"].alias("tf"),
                (options.textrank_weight * e["tr"] + options.word_freq_weight * share).alias("base"),
                (1.0 + options.position_weight * (factor - 1.0)).alias("boost"),
            )

        return F.transform(merged, one)

    merged = sum_by_item(
        F.concat(tagged(freq_entries(options.tokens(text)), "tf"), tagged(_textrank_in_row(text, options), "tr")),
        ["tf", "tr"],
    )
    if options.stemmer is None:
        merged = F.coalesce(_word_scores(text, options, options.tokens(text)), merged)
    opening = F.lower(F.get(T.sentences(text), F.lit(0)))
    return let(
        merged,
        lambda m: let(
            opening,
            lambda o: let(
                T.title_lines(text),
                lambda t: let(F.array_max(F.transform(m, lambda e: e["tf"])), lambda top: score(m, o, t, top)),
            ),
        ),
    )


def _most_frequent(counts: Column, k: int) -> Column:
    """The k most frequent of a :func:`tally`, ties by item.

    A tally comes in item order and most phrases occur once, so those only need
    to be cut off; just the repeated ones are sorted.
    """
    repeated = lambda c: F.transform(
        F.sort_array(F.transform(F.filter(c, lambda e: e["n"] > 1), lambda e: F.struct((-e["n"]).alias("order"), e["item"].alias("item")))),
        lambda e: F.struct(e["item"].alias("item"), (-e["order"]).alias("n")),
    )
    return let(counts, lambda c: F.slice(F.concat(repeated(c), F.slice(F.filter(c, lambda e: e["n"] == 1), 1, k)), 1, k))


def _frequent_entries(tokens: Column, options: KeywordOptions) -> Column:
    """array<struct<item, score, type>>: the word and weighted n-gram counts that can reach the top k, per size."""
    if options.stemmer is None:
        rules = P.Rules((1, *options.sizes), options.min_word_length, options.max_word_length)
        return P.most_frequent(tokens, rules, options.num_keywords, options.ngram_weight)
    words = F.transform(freq_entries(tokens), lambda e: F.struct(e["item"].alias("item"), e["score"].alias("score"), F.lit("unigram").alias("type")))
    return F.concat(words, _gram_entries(tokens, options))


def _gram_entries(tokens: Column, options: KeywordOptions) -> Column:
    """array<struct<item, score, type>>: the weighted n-gram counts that can reach the top k, per size."""
    if options.sizes and options.stemmer is None:
        return P.most_frequent(tokens, options.rules, options.num_keywords, options.ngram_weight)

    def of_size(n: int) -> Column:
        return F.transform(
            _most_frequent(tally(options.grams(tokens, n)), options.num_keywords),
            lambda e: F.struct(
                e["item"].alias("item"),
                (e["n"] * options.ngram_weight).alias("score"),
                F.lit(f"{n}-gram").alias("type"),
            ),
        )

    kinds = [of_size(n) for n in options.sizes]
    return F.concat(*kinds) if kinds else F.expr("cast(array() as array<struct<item:string,score:double,type:string>>)")


def _top(entries: Column, k: int) -> Column:
    """The k best of array<struct<item, score, type>>: score down, then keyword up."""
    ordered = F.sort_array(
        F.transform(
            entries,
            lambda e: F.struct(
                (-F.round(e["score"], RANK_DIGITS)).alias("order"),
                e["item"].alias("item"),
                e["score"].alias("score"),
                e["type"].alias("type"),
            ),
        )
    )
    return F.slice(ordered, 1, k)


# -- table operators -----------------------------------------------------------


def word_freq(docs: DataFrame, key: str = "doc_id", text: str = "text", options: KeywordOptions = KeywordOptions()) -> DataFrame:
    """(key, keyword, score): token counts per document."""
    entries = freq_entries(options.tokens(F.col(text)))
    return docs.select(key, F.inline(entries).alias("keyword", "score"))


def textrank(docs: DataFrame, key: str = "doc_id", text: str = "text", options: KeywordOptions = KeywordOptions()) -> DataFrame:
    """(key, keyword, score): co-occurrence degree per document."""
    return docs.select(key, F.inline(textrank_entries(F.col(text), options)).alias("keyword", "score"))


def position(docs: DataFrame, key: str = "doc_id", text: str = "text", options: KeywordOptions = KeywordOptions()) -> DataFrame:
    """(key, keyword, factor) for the words of every document that has a sentence."""

    def factors(opening: Column) -> Column:
        return let(
            T.title_lines(F.col(text)),
            lambda titles: F.transform(
                F.array_distinct(options.tokens(F.col(text))),
                lambda w: F.struct(
                    w.alias("keyword"), position_factor(w, opening, titles, options).alias("factor")
                ),
            ),
        )

    opening = F.lower(F.get(T.sentences(F.col(text)), F.lit(0)))
    return docs.select(key, F.inline(let(opening, lambda o: F.when(o.isNotNull(), factors(o)))))


def ngram_freq(docs: DataFrame, key: str = "doc_id", text: str = "text", options: KeywordOptions = KeywordOptions()) -> DataFrame:
    """(key, n, keyword, score): n-gram counts per document and size."""

    def of_size(n: int) -> Column:
        return F.transform(
            tally(options.grams(F.col("tokens"), n)),
            lambda e: F.struct(F.lit(n).alias("n"), e["item"].alias("keyword"), e["n"].cast("double").alias("score")),
        )

    tokens = docs.select(key, options.tokens(F.col(text)).alias("tokens"))
    if options.stemmer is None:
        return P.counts(tokens, key, options.rules).select(key, "n", "keyword", F.col("tf").cast("double").alias("score"))
    return tokens.select(key, F.inline(F.concat(*[of_size(n) for n in options.sizes])))


def inverse_frequency(
    occurrences: DataFrame, docs: DataFrame, corpus: DataFrame | None, terms: list[str]
) -> tuple[DataFrame, Column]:
    """Per-term document counts and the idf Column for rows that carry ``df``.

    ``occurrences`` has one row per corpus document and distinct term. Without
    ``corpus`` the table itself is the corpus. Otherwise every document is scored
    against the corpus plus itself, so both counts grow by one. The counts are
    written: a join with a table that was read can be split by adaptive
    execution where a term is hot, one with an aggregate cannot.
    """
    counts = materialize(occurrences.groupBy(*terms).agg(F.count(F.lit(1)).alias("df")), "term-counts")
    size = (docs if corpus is None else corpus).agg(F.count(F.lit(1))).scalar()
    if corpus is None:
        return counts, F.log2(size / F.col("df"))
    return counts, F.log2((size + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1))


def _weigh(
    postings: DataFrame, counts: DataFrame, idf: Column, key: str, terms: list[str], groups: list[str], alone: DataFrame | None = None
) -> DataFrame:
    """Attach L2-normalised tf·idf as ``score``; rows of near-zero weight get null.

    Term keys can be hot, so this is a plain equi-join of two tables: adaptive
    execution turns it into a broadcast when the counts prove small and splits
    skewed partitions otherwise. ``alone`` are postings that carry their ``df``
    and need no join. The norm then needs one exchange by document.
    """
    per_doc = Window.partitionBy(key, *groups)
    known = postings.join(counts, terms, "left")
    known = known if alone is None else known.unionByName(alone)
    weighted = known.withColumn("w", F.col("tf") * idf)
    live = F.when(F.abs(F.col("w")) > EPSILON, F.col("w"))
    normed = live / F.sqrt(F.sum(live * live).over(per_doc))
    return weighted.withColumn("score", F.when(F.abs(normed) > EPSILON, normed)).drop("w", "df")


def shared_phrases(
    rows: DataFrame, distinct: DataFrame, self_corpus: bool, most_slots: int = SLOTS, h: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to join, corpus rows to count, rows with their df): phrases of one document are told by a sketch and stay where they are.

    Most phrases occur once. In a table that is its own corpus such a phrase has
    df 1; against another corpus one that the corpus lacks has none. Both are known
    without a join; what the sketch cannot tell is counted and joined, so the
    result is exact.
    """
    spark, h = rows.sparkSession, F.xxhash64("n", "keyword") if h is None else h
    slots = min(most_slots, 1 << max(13, (8 * distinct.count()).bit_length()))  # a small table has a small sketch
    known = sketch(distinct.select(h.alias("h")), slots)
    if self_corpus:
        met = rows.withColumn("_met", known.may_repeat(h, spark))
        shared, counted = met.filter("_met").drop("_met"), None
    else:
        met = rows.withColumn("_met", known.may_occur(h, spark))
        shared, counted = met.filter("_met").drop("_met"), distinct
    alone = met.filter("not _met").drop("_met").withColumn("df", F.lit(1 if self_corpus else 0).cast("long"))
    return shared, shared if counted is None else counted, alone


def tfidf(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    corpus: DataFrame | None = None,
    corpus_text: str = "text",
    options: KeywordOptions = KeywordOptions(),
) -> DataFrame:
    """(key, keyword, score): log2 TF-IDF with unit length per document."""

    rows = docs.select(key, F.inline(tally(options.tokens(F.col(text)))).alias("keyword", "tf"))
    if corpus is None:  # a row is one word of one document, so the words are found once and counted from there
        distinct = rows = materialize(rows, "word-postings")
    else:
        distinct = corpus.select(F.explode(F.array_distinct(options.tokens(F.col(corpus_text)))).alias("keyword"))
    counts, idf = inverse_frequency(distinct, docs, corpus, ["keyword"])
    scored = _weigh(rows, counts, idf, key, ["keyword"], [])
    return scored.where(F.col("score").isNotNull()).select(key, "keyword", "score")


def ngram_tfidf(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    corpus: DataFrame | None = None,
    corpus_text: str = "text",
    options: KeywordOptions = KeywordOptions(),
) -> DataFrame:
    """(key, n, keyword, score): TF-IDF of n-grams, each size for itself."""
    if options.stemmer is None:
        return _phrase_scores(docs, key, text, corpus, corpus_text, options)
    rows = ngram_freq(docs, key, text, options).withColumnRenamed("score", "tf")

    def of_size(n: int) -> Column:
        return F.transform(
            F.array_distinct(options.grams(F.col("tokens"), n)), lambda g: F.struct(F.lit(n).alias("n"), g.alias("keyword"))
        )

    rows = materialize(rows, "phrase-postings")
    if corpus is None:
        distinct = rows
    else:
        tokens = corpus.select(options.tokens(F.col(corpus_text)).alias("tokens"))
        distinct = materialize(tokens.select(F.inline(F.concat(*[of_size(n) for n in options.sizes]))), "corpus-phrases")
    shared, counted, alone = shared_phrases(rows, distinct, corpus is None)
    counts, idf = inverse_frequency(counted, docs, corpus, ["n", "keyword"])
    scored = _weigh(shared, counts, idf, key, ["n", "keyword"], ["n"], alone)
    return scored.where(F.col("score").isNotNull()).select(key, "n", "keyword", "score")


def _phrase_scores(
    docs: DataFrame, key: str, text: str, corpus: DataFrame | None, corpus_text: str, options: KeywordOptions, k: int | None = None, weight: float = 1.0
) -> DataFrame:
    """:func:`ngram_tfidf` without moving a phrase: the k best of each size, if ``k`` is given, and scores times ``weight``.

    What moves are 64-bit hashes of phrases, each with its row and its number there. One size is counted after the other, so
    the disk holds the hashes of one size at a time; of those that count the number and df are written, as one list per row and size,
    and come back to their rows, where the phrases are made again and weighed. A row is a document, whatever its key.
    """
    rows = docs.select(key, options.tokens(F.col(text)).alias("tokens"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "phrase-tokens")
    size = (docs if corpus is None else corpus).agg(F.count(F.lit(1))).scalar()
    lists = []
    for n in options.sizes:
        rules = replace(options.rules, sizes=(n,))
        places = P.places(rows, "_row", rules)
        if corpus is None:
            met = places.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1")
        else:
            theirs = corpus.select(F.lit(0).alias("_row"), options.tokens(F.col(corpus_text)).alias("tokens"))
            theirs = materialize(P.places(theirs, "_row", rules).select("h"), "corpus-phrases")
            shared, counted, _ = shared_phrases(places, theirs, False, h=F.col("h"))
            met = shared.join(materialize(counted.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "term-counts"), "h")
        met = met.select("_row", "at", "df").repartition("_row").groupBy("_row").agg(F.collect_list("at").alias("at"), F.collect_list("df").alias("df"))
        lists.append(materialize(met.select("_row", F.lit(n).alias("n"), "at", "df"), "phrase-counts"))
    met = reduce(DataFrame.unionAll, lists).repartition("_row").groupBy("_row").agg(F.collect_list(F.struct("n", "at", "df")).alias("met"))
    joined = rows.join(met, "_row", "left").select(key, "tokens", "met", size.alias("size"))
    return P.weighed(joined, key, options.rules, corpus is None, EPSILON, k, weight)


def combined(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    corpus: DataFrame | None = None,
    use_corpus: bool = True,
    corpus_text: str = "text",
    options: KeywordOptions = KeywordOptions(),
) -> DataFrame:
    """(key, keyword, score): weighted TF-IDF, textrank and frequency with position boost.

    The local factors travel inside the postings, so the three statistics need
    no join among each other.
    """
    rows = docs.select(key, F.inline(_local_terms(F.col(text), options)).alias("keyword", "tf", "base", "boost"))
    if use_corpus:
        if corpus is None:  # a word that only a sentence shows (tf 0) is none of the text's words and counts for no df
            rows = materialize(rows, "local-terms")
            distinct = rows.where(F.col("tf") > 0)
        else:
            distinct = corpus.select(F.explode(F.array_distinct(options.tokens(F.col(corpus_text)))).alias("keyword"))
        counts, idf = inverse_frequency(distinct, docs, corpus, ["keyword"])
        rows = _weigh(rows, counts, idf, key, ["keyword"], [])
        total = options.tfidf_weight * F.coalesce(F.col("score"), F.lit(0.0)) + F.col("base")
    else:
        total = F.col("base")
    return rows.select(key, "keyword", (total * F.col("boost")).alias("score")).where(F.col("score") > 0)


def _ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    best_first = Window.partitionBy(key).orderBy(F.round("score", RANK_DIGITS).desc(), "keyword")
    return rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select(
        key, "rank", "keyword", "score", "type"
    )


def extract(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    corpus: DataFrame | None = None,
    self_corpus: bool = False,
    corpus_text: str = "text",
    options: KeywordOptions = KeywordOptions(),
) -> DataFrame:
    """(key, rank, keyword, score, type): the best words and phrases per document.

    Without a corpus every method is row-local and the whole job is a map:
    TF-IDF against the document alone is zero everywhere and falls back to
    counts; so does an empty corpus. With a corpus, phrases are cut to the top k inside the row wherever
    their score is final there, so at most k phrases per document are shuffled.
    """
    if corpus is not None and corpus.isEmpty():
        corpus = None  # an empty corpus is none: counts stand in for TF-IDF
    docs = docs.select(key, text)  # a blank text yields no rows but counts as a document of its own corpus
    method = options.method.lower()
    against_corpus = (corpus is not None or self_corpus) and method in ("tfidf", "combined")
    unigram = lambda entries, field="score": F.transform(
        entries, lambda e: F.struct(e["item"].alias("item"), e[field].alias("score"), F.lit("unigram").alias("type"))
    )
    shape = ["rank", "keyword", "score", "type"]

    if not against_corpus:
        if method == "textrank":
            words = unigram(textrank_entries(F.col(text), options))
        elif method == "combined":
            words = F.filter(
                F.transform(
                    _local_terms(F.col(text), options),
                    lambda e: F.struct(
                        e["item"].alias("item"),
                        (e["base"] * e["boost"]).alias("score"),
                        F.lit("unigram").alias("type"),
                    ),
                ),
                lambda e: e["score"] > 0,
            )
            fallback = unigram(freq_entries(F.col("tokens")))
            words = let(words, lambda w: F.when(F.size(w) > 0, w).otherwise(fallback))
        else:
            words = None
        entries = _frequent_entries(F.col("tokens"), options) if words is None else F.concat(words, _gram_entries(F.col("tokens"), options))
        return (
            docs.select(key, text, options.tokens(F.col(text)).alias("tokens"))
            .select(key, F.posexplode(_top(entries, options.num_keywords)))
            .select(key, (F.col("pos") + 1).alias("rank"), F.col("col.item").alias("keyword"), "col.score", "col.type")
            .select(key, *shape)
        )

    if method == "combined":
        words = combined(docs, key, text, corpus, True, corpus_text, options)
        phrases = docs.select(
            key, F.inline(_top(_gram_entries(options.tokens(F.col(text)), options), options.num_keywords))
        ).select(key, F.col("item").alias("keyword"), "score", "type")
    else:
        with temporary(docs.sparkSession):  # the best words are written, so nothing reads postings or shuffles of words again while phrases are counted
            words = tfidf(docs, key, text, corpus, corpus_text, options)
            words = materialize(_ranked(words.withColumn("type", F.lit("unigram")), key, options.num_keywords).drop("rank"), "best-words", stays=True)
        phrases = None
        if options.sizes and options.stemmer is None:
            phrases = _phrase_scores(docs, key, text, corpus, corpus_text, options, options.num_keywords, options.ngram_weight)
            phrases = phrases.select(key, "keyword", "score", F.format_string("%d-gram", "n").alias("type"))
        elif options.sizes:
            phrases = ngram_tfidf(docs, key, text, corpus, corpus_text, options).select(
                key,
                "keyword",
                (F.col("score") * options.ngram_weight).alias("score"),
                F.format_string("%d-gram", "n").alias("type"),
            )
    # Words are cut to k while they still lie together by document, so the last exchange carries few rows.
    best = _ranked(words.select(key, "keyword", "score", F.lit("unigram").alias("type")), key, options.num_keywords)
    if phrases is None:
        return best
    return _ranked(best.drop("rank").unionByName(phrases), key, options.num_keywords)


def keyword_lists(keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, keywords): the keyword strings of :func:`extract` in rank order."""
    return keywords.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda e: e["keyword"]).alias("keywords")
    )
