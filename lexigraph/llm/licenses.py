"""License scans by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the places where
the same k-gram stands in a license template. A hit votes for its diagonal, the
place in the text less the place in the template: a template that stands in a
text puts all its votes on one diagonal, or on neighbouring ones where words
were put in or left out. Neighbouring diagonals are merged and the hits of each
span are checked in order.

Texts are read once: a batch's words are numbered, hashed by number, and of all
rolling k-grams those go on to the join that some template has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lexigraph.llm.common import BATCH_ROWS, batches_of, materialize
from lexigraph.llm.jaccard import _WordHashes

# Phrases that count wherever they stand.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Opening or reference sentences of public licenses, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
K = 3
DRIFT = 3
SHORT = 12
MOST_BYTES = 4_000_000  # of the texts that are read together

# A-Z fold, other ASCII letters and digits stay, all other ASCII separates; what is not ASCII belongs to words.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def grams(words: list[bytes], hashes: dict, k: int = K) -> np.ndarray:
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total = (total ^ h[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word number) of every word of the texts in order, and the words by number."""
    folded = pa.array([t.translate(FOLD) if t else b"" for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
    split = pc.ascii_split_whitespace(folded.view(pa.string()))
    numbers = split.flatten().dictionary_encode()
    known = numbers.dictionary.view(pa.binary())
    code = numbers.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    blank = known.index(pa.scalar(b"", pa.binary())).as_py()  # before and after a blank at an edge
    return row[code != blank], code[code != blank], known


def rolling(row: np.ndarray, h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, hash) of every k-gram that lies in one row."""
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    total = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        total = (total ^ h[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return at, total.view(np.int64)


def base_places(code: np.ndarray, row: np.ndarray, known: pa.Array) -> dict[str, np.ndarray]:
    """label -> places of the phrase among all words."""
    out = {}
    for label, phrase in PHRASES.items():
        numbers = [known.index(pa.scalar(w, pa.binary())).as_py() for w in phrase.encode().split()]
        n = max(0, len(code) - len(numbers) + 1)
        here = row[:n] == row[len(row) - n :]
        for j, number in enumerate(numbers):
            here &= code[j : j + n] == number  # -1, a word that no text has, is met nowhere
        out[label] = np.flatnonzero(here)
    return out


def read(texts: pa.Array, wanted: np.ndarray) -> dict[str, pa.Array]:
    """n_words, n_base, first_word, last_word, base and hits of every text; hits are the k-grams that ``wanted``, sorted, has."""
    import xxhash

    n = len(texts)
    row, code, known = coded(texts)
    words = np.bincount(row, minlength=n)
    start = np.cumsum(words) - words
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), dtype=np.uint64, count=len(known))
    at, grams_of = rolling(row, of_word[code])
    kept = wanted[np.minimum(np.searchsorted(wanted, grams_of), len(wanted) - 1)] == grams_of
    at, grams_of = at[kept], grams_of[kept]
    hits = pa.StructArray.from_arrays([pa.array(at - start[row[at]], pa.int32()), pa.array(grams_of)], ["pos", "hash"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=n))])

    n_base = np.zeros(n, dtype=np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[list[str]] = [[] for _ in range(n)]
    for label, places in sorted(base_places(code, row, known).items()):
        owner = row[places]
        place = places - start[owner]
        n_base += np.bincount(owner, minlength=n)
        np.minimum.at(first, owner, place)
        np.maximum.at(last, owner, place)
        for r in np.unique(owner).tolist():
            labels[r].append(label)
    none = n_base == 0
    return {
        "n_words": pa.array(words.astype(np.int64)),
        "n_base": pa.array(n_base),
        "first_word": pa.array(first, mask=none),
        "last_word": pa.array(last, mask=none),
        "base": pa.array(labels, pa.list_(pa.string())),
        "hits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits),
    }


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) of texts that are read together; a longer text is one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + MOST_BYTES, "right")))
        yield first, last
        first = last


def template_places(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(hash, template, label, at, grams): a row per k-gram of a template, so its size is fixed by the list above."""
    hashes = _WordHashes()
    rows = []
    for number, (label, text) in enumerate(templates):
        values = grams(words_of(text), hashes, k).tolist()
        rows += [(h, number, label, at, len(values)) for at, h in enumerate(values)]
    return spark.createDataFrame(rows, "hash long, template int, label string, at int, grams int")


def spans(keyed: DataFrame, coverage: float = 0.75, templates=TEMPLATES, k: int = K, drift: int = DRIFT) -> DataFrame:
    """(doc_id, text_hash, label, template, start, stop, score) from rows with ``hits``, (pos, hash) of the rolling k-grams of a text.

    start and stop are word positions. Score is the part of the template's
    k-grams that stand in the span in order; spans below ``coverage`` go, and so
    do incomplete ones of short templates, which differ by a word from others.
    """
    places = template_places(keyed.sparkSession, templates, k)
    rows = keyed.select("doc_id", "text_hash", F.inline("hits"))
    hits = rows.join(F.broadcast(places), "hash")
    key = ["doc_id", "text_hash", "template"]
    diagonals = hits.groupBy(*key, "label", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.struct("pos", "at")).alias("hits")
    )
    along = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True)).cast("int")
    merged = (
        diagonals.withColumn("_new", gap)
        .withColumn("_band", F.sum("_new").over(along))
        .groupBy(*key, "label", "grams", "_band")
        .agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))

    def step(state, hit):
        onward = hit["at"] > state["last"]
        return F.struct((state["n"] + onward.cast("int")).alias("n"), F.when(onward, hit["at"]).otherwise(state["last"]).alias("last"))

    in_order = F.aggregate("hits", start, step, lambda s: s["n"])
    return (
        merged.withColumn("score", F.least(F.lit(1.0), in_order / F.col("grams")))
        .filter(F.col("score") >= F.when(F.col("grams") < SHORT, 1.0).otherwise(coverage))
        .select("doc_id", "text_hash", "label", "template", F.array_min("hits")["pos"].alias("start"), (F.array_max("hits")["pos"] + k).alias("stop"), "score")
    )


def scan(docs: DataFrame, coverage: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is an
    empty one: no words, no labels, score 0. Score is 1 where a base phrase
    stands, else that of the best span. Rows with equal id and text get equal
    results; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    wanted = np.unique(np.concatenate([grams(words_of(text), _WordHashes()) for _, text in TEMPLATES]))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in runs(batch.column("text")):
                part = batch.slice(first, last - first)
                made = read(part.column("text"), wanted)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), **made})

    columns = f"doc_id {kind}, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<pos:int,hash:long>>"
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        keyed = materialize(texts.mapInArrow(facts, columns), "license-facts")
    found = materialize(spans(keyed, coverage), "license-spans")
    best = found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best")
    )
    joined = keyed.drop("hits").join(best, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
