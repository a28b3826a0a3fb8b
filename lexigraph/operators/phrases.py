"""Phrases of many texts at once: counted as numbers, spelled at the end.

The tokens of a batch are numbered in the order of their bytes, a phrase is a
tuple of numbers, and equal phrases of a text are neighbours after one sort.
The rules are those of ``functions.text.ngrams`` for lower-case tokens that are
free of stopwords and white space; texts that a stemmer has changed take that way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.functions import constants as C

MOST_TOKENS = 200_000  # of the texts that are counted together; a longer text is one alone
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    sizes: tuple[int, ...]
    shortest: int
    longest: int


@dataclass(frozen=True)
class Counted:
    """The distinct phrases of one size, by row and then by words."""

    n: int
    row: np.ndarray
    words: list[np.ndarray]  # numbers of the first, second, ... token
    times: np.ndarray


def _numbered(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each token, tokens by number), numbers in the order of bytes."""
    coded = tokens.cast(pa.string()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def count(lists: pa.ListArray, rules: Rules) -> Iterator[tuple[pa.Array, list[Counted]]]:
    """(tokens by number, phrases of every size) for runs of rows; ``row`` counts from the first of all."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lists):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
        part, sizes = lists.slice(first, last - first), lengths[first:last]
        code, known = _numbered(part.flatten())
        row = np.repeat(np.arange(first, last), sizes)
        yield known, [_of_size(n, code, known, row, first, rules) for n in rules.sizes]
        first = last


def _of_size(n: int, code: np.ndarray, known: pa.Array, row: np.ndarray, first: int, rules: Rules) -> Counted:
    many = len(code) - n + 1
    if many <= 0:
        none = np.empty(0, dtype=np.int64)
        return Counted(n, none, [none] * n, none)
    length = pc.utf8_length(known).to_numpy().astype(np.int64)
    spelled = sum(length[code[j : j + many]] for j in range(n)) + n - 1
    good = (row[:many] == row[n - 1 :]) & (spelled >= rules.shortest * n) & (spelled <= rules.longest * n)
    if n == 2:
        common = pc.is_in(known, pa.array(C.BIGRAM_COMMON_WORDS, pa.string())).to_numpy(zero_copy_only=False)
        a, b = code[:many], code[1:]
        good &= (length[a] >= 3) & (length[b] >= 3) & ~common[b] & ~(common[a] & (length[b] <= 4))
    at = np.flatnonzero(good)
    # numbers of pairs keep their order, so keys of three and four words stay small
    wide = len(known)
    if n == 1:
        key, span = code[at], wide
    elif n == 2:
        key, span = code[at] * wide + code[at + 1], wide * wide
    else:
        pair = np.unique(code[:-1] * wide + code[1:], return_inverse=True)[1].astype(np.int64)
        pairs = int(pair.max()) + 1
        key, span = (pair[at] * wide + code[at + 2], pairs * wide) if n == 3 else (pair[at] * pairs + pair[at + 2], pairs * pairs)
    _, place, times = np.unique((row[at] - first) * span + key, return_index=True, return_counts=True)
    at = at[place]
    return Counted(n, row[at], [code[at + j] for j in range(n)], times)


def spell(known: pa.Array, found: Counted, which: np.ndarray | slice = slice(None)) -> pa.Array:
    return pc.binary_join_element_wise(*[known.take(pa.array(w[which])) for w in found.words], " ")


def _order(known: pa.Array, found: Counted) -> np.ndarray:
    """Rank of every phrase as a string; that of its words, but where a word holds a sign before the blank."""
    if not pc.any(pc.match_substring_regex(known, r"[\x00-\x1f]")).as_py():
        return np.arange(len(found.row))
    rank = np.empty(len(found.row), dtype=np.int64)
    rank[pc.array_sort_indices(spell(known, found)).to_numpy()] = np.arange(len(found.row))
    return rank


def _best(found: Counted, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties by rank."""
    order = np.lexsort((rank, -score, found.row))
    row = found.row[order]
    return order[np.arange(len(order)) - np.searchsorted(row, row) < k]


def prints(known: pa.Array, found: Counted) -> np.ndarray:
    """64-bit hash of every phrase and its size."""
    import xxhash

    word = np.array([xxhash.xxh3_64_intdigest(w) for w in known.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    h = np.full(len(found.row), found.n, dtype=np.uint64)
    for numbers in found.words:
        h = (h ^ word[numbers]) * MIX
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


# -- table steps -------------------------------------------------------------------------


def counts(lists: DataFrame, key: str, rules: Rules) -> DataFrame:
    """(key, n, keyword, tf) from (key, tokens): the phrases of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, sizes in count(batch.column("tokens"), rules):
                for found in sizes:
                    size = pa.array(np.full(len(found.row), found.n, dtype=np.int32))
                    arrays = [batch.column(key).take(pa.array(found.row)), size, spell(known, found), pa.array(found.times.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, [key, "n", "keyword", "tf"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.select(key, "tokens").mapInArrow(read, f"`{key}` {kind}, n int, keyword string, tf long")


def most_frequent(tokens: Column, rules: Rules, k: int, weight: float) -> Column:
    """array<struct<item, score, type>>: the k most frequent phrases of each size, ties by spelling; score is the weighted count, the count itself of words (size 1)."""
    kind = "array<struct<item:string,score:double,type:string>>"

    @F.arrow_udf(kind)
    def read(lists: pa.Array) -> pa.Array:
        rows, items, scores, types = [], [], [], []
        for known, sizes in count(lists, rules):
            for found in sizes:
                best = _best(found, found.times, _order(known, found), k)
                rows.append(found.row[best])
                items.append(spell(known, found, best))
                scores.append(found.times[best] * (weight if found.n > 1 else 1.0))
                types.append(np.full(len(best), found.n))
        row = np.concatenate([*rows, np.empty(0, dtype=np.int64)])
        order = np.argsort(row, kind="stable")
        at = pa.array(order)
        item = pa.chunked_array(items, pa.string()).combine_chunks().take(at)
        score = pa.array(np.concatenate([*scores, np.empty(0)])[order], pa.float64())
        size = pa.array([f"{n}-gram" if n > 1 else "unigram" for n in np.concatenate([*types, np.empty(0, dtype=np.int64)])[order].tolist()], pa.string())
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))])
        values = pa.StructArray.from_arrays([item, score, size], ["item", "score", "type"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return read(tokens)


def _runs(lists: list[pa.ListArray]) -> Iterator[tuple[int, int]]:
    """(first, last) of rows that are counted together."""
    ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
        yield first, last
        first = last


def _degrees(code: np.ndarray, row: np.ndarray, end: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(row and word as one key, score): words met in the same sentences over the count and one; sentences end at the number ``end``."""
    ends = code == end
    sentence = (row + np.cumsum(ends))[~ends]
    word, row = code[~ends], row[~ends]
    pair, place, times = np.unique(sentence * wide + word, return_index=True, return_counts=True)
    of_pair = sentence[place]
    met = np.bincount(of_pair, minlength=1)[of_pair] - 1
    key, group = np.unique(row[place] * wide + word[place], return_inverse=True)
    n, degree = np.bincount(group, times, len(key)), np.bincount(group, met, len(key))
    return key, degree / (n + 1)


def word_scores(tokens: Column, sentences: Column, end: str) -> Column:
    """array<struct<item, tf, tr>> in order of item: counts in ``tokens`` and co-occurrence scores in ``sentences``, a list with ``end`` between two.

    Without ``sentences`` the count is the score; a word that only one of the lists has is 0.0 in the other's field.
    """
    kind = "array<struct<item:string,tf:double,tr:double>>"

    @F.arrow_udf(kind)
    def read(whole: pa.Array, cut: pa.Array) -> pa.Array:
        rows, items, tfs, trs = [], [], [], []
        for first, last in _runs([whole, cut]):
            a, b = whole.slice(first, last - first), cut.slice(first, last - first)
            many_a, many_b = (pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (a, b))
            code, known = _numbered(pa.concat_arrays([a.flatten().cast(pa.string()), b.flatten().cast(pa.string()), pa.array([end])]))
            wide, stop, here = len(known), int(code[-1]), np.arange(last - first)
            row_a, row_b = np.repeat(here, many_a), np.repeat(here, many_b)
            key_a, times = np.unique(row_a * wide + code[: len(row_a)], return_counts=True)
            key_b, score = _degrees(code[len(row_a) : -1], row_b, stop, wide)
            alone = np.flatnonzero(b.is_null().to_numpy(zero_copy_only=False)[key_a // wide])
            key = np.union1d(key_a, key_b)
            tf, tr = np.zeros(len(key)), np.zeros(len(key))
            tf[np.searchsorted(key, key_a)] = times
            tr[np.searchsorted(key, key_b)] = score
            tr[np.searchsorted(key, key_a[alone])] = times[alone]
            rows.append(key // wide + first)
            items.append(known.take(pa.array(key % wide)))
            tfs.append(tf)
            trs.append(tr)
        row = np.concatenate([*rows, np.empty(0, dtype=np.int64)])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(whole)))])
        numbers = [pa.array(np.concatenate([*x, np.empty(0)]), pa.float64()) for x in (tfs, trs)]
        values = pa.StructArray.from_arrays([pa.chunked_array(items, pa.string()).combine_chunks(), *numbers], ["item", "tf", "tr"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return read(tokens, sentences)


def places(lists: DataFrame, key: str, rules: Rules) -> DataFrame:
    """(key, at, h) from (key, tokens): number and hash of every distinct phrase of every row; a size's phrases are numbered in the order of their words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, sizes in count(batch.column("tokens"), rules):
                for found in sizes:
                    at = np.arange(len(found.row)) - np.searchsorted(found.row, found.row)
                    arrays = [batch.column(key).take(pa.array(found.row)), pa.array(at, pa.int32()), pa.array(prints(known, found))]
                    yield pa.RecordBatch.from_arrays(arrays, [key, "at", "h"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.select(key, "tokens").mapInArrow(read, f"`{key}` {kind}, at int, h long")


def _known(met: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Size -> (row, number of the phrase in it, df) of a column of (n, at, df), by row."""
    lists = met.flatten()
    row = np.repeat(np.arange(len(met)), pc.fill_null(pc.list_value_length(met), 0).to_numpy())
    n, at, df = (lists.field(i) for i in range(3))
    times = pc.list_value_length(at).to_numpy()
    row, n = np.repeat(row, times), np.repeat(n.to_numpy(), times)
    at, df = at.flatten().to_numpy(), df.flatten().to_numpy()
    return {size: (row[n == size], at[n == size], df[n == size]) for size in np.unique(n).tolist()}


def _frequencies(found: Counted, known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], own: int) -> np.ndarray:
    """df of every phrase of a size; that of one which is not ``known`` is ``own``."""
    out = np.full(len(found.row), own, dtype=np.int64)
    if found.n in known and len(out):
        row, at, df = known[found.n]
        here = slice(np.searchsorted(row, found.row[0]), np.searchsorted(row, found.row[-1], "right"))
        out[np.searchsorted(found.row, row[here]) + at[here]] = df[here]
    return out


def weighed(lists: DataFrame, key: str, rules: Rules, self_corpus: bool, least: float, k: int | None = None, weight: float = 1.0) -> DataFrame:
    """(key, n, keyword, score) from (key, tokens, met, size): TF-IDF of unit length per row and size, at most the ``k`` best of each size.

    ``met`` are (n, at, df), lists of :func:`places` of a size and of their df, and ``size`` is the number of documents; all other phrases have df 1
    in their own corpus and none in another. Scores are multiplied by ``weight``, weights and scores up to ``least`` are none.
    """

    def score(found: Counted, df: np.ndarray, size: int, rows: int) -> np.ndarray:
        w = found.times * (np.log2(size / df) if self_corpus else np.log2((size + 1) / (df + 1)))
        w[np.abs(w) <= least] = 0.0
        norm = np.sqrt(np.bincount(found.row, w * w, minlength=rows))[found.row]
        out = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
        out[np.abs(out) <= least] = 0.0
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, size = _known(batch.column("met")), batch.column("size")
            for known, sizes in count(batch.column("tokens"), rules):
                for found in sizes:
                    value = score(found, _frequencies(found, met, 1 if self_corpus else 0), size[0].as_py(), batch.num_rows) * weight
                    # one that is nothing comes after all others
                    which = np.arange(len(value)) if k is None else _best(found, np.where(value == 0, -np.inf, np.round(value, 9)), _order(known, found), k)
                    which = which[value[which] != 0]
                    number = pa.array(np.full(len(which), found.n, dtype=np.int32))
                    arrays = [batch.column(key).take(pa.array(found.row[which])), number, spell(known, found, which), pa.array(value[which], pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, [key, "n", "keyword", "score"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.select(key, "tokens", "met", "size").mapInArrow(read, f"`{key}` {kind}, n int, keyword string, score double")
