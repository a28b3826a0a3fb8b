"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and these further after each word whose hash is the
least of WINDOW words in a row. That depends on the words alone, so a passage is
cut alike wherever it stands, and of any WINDOW words one ends a part: a passage
of 2 * WINDOW + 24 words or more is found and loses all but WINDOW words at
either end. Runs of several consecutive sentences are hashed, all runs are
joined globally, and the sentences of a run that is not the first of its kind
go. What is cut is put together again unchanged, so a text without repeated
runs stays as it was, byte for byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexigraph.llm.common import BATCH_ROWS, batches_of, each, materialize
from lexigraph.llm.jaccard import WORD_CACHE

PIECE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
CLOSERS = "\"')]}»”’"
WINDOW = 8  # a power of two


class Words(dict):
    """word -> 64-bit hash whose lowest bit says that a sentence ends after the word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        last = word.decode("utf-8", "surrogatepass").rstrip(CLOSERS)[-1:]
        value = self[word] = value | 1 if last in (".", "!", "?") else value & ~1
        return value


def least(x: np.ndarray) -> np.ndarray:
    """Which values are the least of some WINDOW values in a row, by sliding minima and the sliding maxima of these."""
    if len(x) < WINDOW:
        return np.zeros(len(x), dtype=bool)
    low, step = x, 1
    while step < WINDOW:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    none = np.zeros(WINDOW - 1, dtype=x.dtype)
    high, step = np.concatenate([none, low, none]), 1
    while step < WINDOW:
        high, step = np.maximum(high[:-step], high[step:]), 2 * step
    return high == x


def sentences(text: str, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where sentences end (exclusive word positions) and word hashes; a line ends a sentence too."""
    words: list[bytes] = []
    lines = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words += line.split()
        lines.append(len(words))
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    cut = np.append(False, (h & np.uint64(1)).astype(bool) | least(h >> np.uint64(1)))
    cut[lines] = True
    cut[0] = False
    return np.flatnonzero(cut), h


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
BASE = 0x9E3779B97F4A7C15


def _powers_to(n: int) -> list[np.ndarray]:
    """BASE ** i and its inverse modulo 2^64, for i below n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def runs(ends: np.ndarray, h: np.ndarray, least_sentences: int, least_words: int, closing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, sentence after the last): from each sentence the shortest run with so many sentences and words.

    With ``closing`` also the shortest run that ends with each sentence, where it
    is another. The hash of words i..j-1 is a difference of running sums, moved to i = 0.
    """
    first = np.arange(len(ends))
    start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    stop = np.maximum(first + least_sentences, np.searchsorted(ends, start + least_words, "left") + 1)
    whole = stop <= len(ends)
    if closing:
        last = first + 1
        opens = np.minimum(last - least_sentences, np.searchsorted(start, ends - least_words, "right") - 1)
        new = opens >= 0
        new[new] = stop[opens[new]] != last[new]
        first, stop = np.concatenate([first[whole], opens[new]]), np.concatenate([stop[whole], last[new]])
    else:
        first, stop = first[whole], stop[whole]
    start, end = start[first], ends[stop - 1]
    power, inverse = _powers_to(len(h) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    mixed = (total[end] - total[start]) * inverse[start]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64), first, stop


def spans(docs: DataFrame, least_sentences: int = 3, least_words: int = 16, closing: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_sentences, runs, twice): the distinct runs of every row's text, and those it has more than once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            counts, found, twice = [], [], []
            for text in each(batch.column("text")):
                ends, h = sentences(text, known) if text else ((), ())
                run, times = np.unique(runs(ends, h, least_sentences, least_words, closing)[0], return_counts=True) if text else ((), np.array([]))
                counts.append(len(ends))
                found.append(run)
                twice.append(run[times > 1] if (times > 1).any() else None)
            arrays = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], ["doc_id", "text_hash", "n_sentences", "runs", "twice"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(read, f"doc_id {kind}, text_hash long, n_sentences long, runs array<long>, twice array<long>")


def deduplicate(docs: DataFrame, least_sentences: int = 3, least_words: int = 16, closing: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated spans, n_sentences, n_removed.

    ``docs`` needs doc_id and text; other columns are ignored. Of equal runs the
    one with the smallest id, then text hash, then place, stays. A null text stays
    null, an empty one empty, both with no sentences; very long texts are read
    whole. With ``closing`` the shortest runs that end with a sentence count too,
    so the end of a passage goes like its start. Rows with equal id and text share
    their fate. The runs of a text are found once and written; those of a hot
    passage are combined before they are shuffled, the joins with the repeated runs
    are ones that adaptive execution can split, and only texts that lose something
    are cut again.
    """
    plain = docs.select("doc_id", "text")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        read = materialize(spans(plain, least_sentences, least_words, closing), "runs")
    row = F.struct("doc_id", "text_hash")
    found = read.select(F.explode("runs").alias("run"), "doc_id", "text_hash")
    twice = read.filter("twice is not null").select(F.explode("twice").alias("run"), "doc_id", "text_hash")
    several = found.groupBy("run").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("run")
    repeated = materialize(several.unionAll(twice.select("run")).distinct(), "repeated-runs")
    hits = materialize(found.join(repeated, "run"), "repeated-places")
    # min over structs puts a null id first, so equality has to be null-safe as well
    keep = materialize(hits.groupBy("run").agg(F.min(row).alias("keep")), "first-places")
    later = hits.join(keep, "run").filter(~row.eqNullSafe(F.col("keep")))
    again = twice.join(keep, "run").filter(row.eqNullSafe(F.col("keep")))
    # of its own runs that stand in it once a row keeps all, so only the others are told
    gone = later.select("doc_id", "text_hash", "run", F.lit(False).alias("first_stays")).unionAll(again.select("doc_id", "text_hash", "run", F.lit(True)))
    told = gone.select("doc_id", "text_hash", F.struct("run", "first_stays").alias("gone"), F.lit(None).cast("long").alias("n_sentences"))
    told = told.unionByName(read.select("doc_id", "text_hash", F.lit(None).cast("struct<run:long,first_stays:boolean>").alias("gone"), "n_sentences"))
    told = told.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("gone").alias("gone"), F.max("n_sentences").alias("n_sentences"))
    hashed = plain.withColumn("text_hash", F.xxhash64("text"))
    joined = hashed.join(told, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text", "gone", "n_sentences")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            lists = batch.column("gone")
            hit = [i for i, n in enumerate(pc.list_value_length(lists).to_pylist()) if n]
            texts, removed = batch.column("text"), np.zeros(batch.num_rows, dtype=np.int64)
            if hit:
                left = {}
                for i in hit:
                    left[i], removed[i] = without(texts[i].as_py(), lists[i].as_py(), known, least_sentences, least_words, closing)
                texts = pa.array((left[i] if i in left else t.as_py() for i, t in enumerate(texts)), pa.string(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("n_sentences"), pa.array(removed)], ["doc_id", "text", "n_sentences", "n_removed"])

    return joined.mapInArrow(cut, f"doc_id {kind}, text string, n_sentences long, n_removed long")


def without(text: str, gone: list[dict], known: Words, least_sentences: int, least_words: int, closing: bool) -> tuple[str, int]:
    """(text without the given runs, sentences removed); of a run whose first place stays, only the later ones go."""
    ends, h = sentences(text, known)
    run, first, stop = runs(ends, h, least_sentences, least_words, closing)
    stays = {g["run"]: g["first_stays"] for g in gone}
    out = np.zeros(len(ends), dtype=bool)
    at = np.flatnonzero(np.isin(run, np.array(list(stays), dtype=np.int64)))
    for i in at[np.lexsort((stop[at], first[at]))].tolist():
        if stays[int(run[i])]:
            stays[int(run[i])] = False
        else:
            out[first[i] : stop[i]] = True
    pieces = PIECE.findall(text)
    lead = text[: len(text) - sum(map(len, pieces))]
    starts = [0, *ends[:-1].tolist()]
    return lead + "".join("".join(pieces[a:b]) for a, b, o in zip(starts, ends.tolist(), out) if not o), int(out.sum())
