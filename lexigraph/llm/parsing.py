"""Exact removal of repeated substrings by prefix-free parsing.

A byte 400-gram that starts at two places of the corpus is repeated. Texts are
parsed into phrases that end at triggers: places whose rolling hash over WINDOW
bytes is 0 modulo MODULUS. Phrases overlap by one trigger, so what a place's
suffix is compared by is the rest of its phrase and then the phrases that follow,
and equal substrings are parsed alike.

1. Pairs of neighbouring phrases are counted over the corpus. A substring that
   contains a pair that occurs once cannot be repeated, which leaves few starts.
   Those that begin in one phrase and hold the next two form a context.
2. Equal contexts are one; a context that occurs twice is repeated as a whole.
3. Distinct contexts meet by the pair after their first phrase (the anchor). In
   bounded shards the suffix array of the shard's dictionary of phrases orders what is
   left of a first phrase, the suffix array of the parse orders what follows, and
   both together give the order of all starts; equal substrings are neighbours.
4. Starts with fewer than three triggers in reach, and those of an anchor with more
   contexts than a shard should hold, are counted by the hash of their substring
   over all tasks: the same result without one task for a hot anchor.

Equal texts are parsed once; of them everything is repeated anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigraph.llm.common import BATCH_ROWS, batches_of, each, materialize

LENGTH = 400
WINDOW = 8  # a power of two up to 8
MODULUS = 32
MOST_CONTEXTS = 1024  # of one anchor in a shard
SHARD_BYTES = 1 << 20


def grams(raw: np.ndarray, window: int) -> np.ndarray:
    """Rolling hash of every ``window`` bytes, read as one number from each place."""
    many = len(raw) - window + 1
    if many <= 0:
        return np.empty(0, dtype=np.uint64)
    x = np.ndarray(many, f"<u{window}", np.ascontiguousarray(raw), strides=(1,)).astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def triggers(mixed: np.ndarray, modulus: int) -> np.ndarray:
    """Places whose rolling hash is 0 modulo ``modulus``."""
    rest = mixed % np.uint64(modulus) if modulus & (modulus - 1) else mixed & np.uint64(modulus - 1)
    return np.flatnonzero(rest == 0)


def cuts(raw: bytes, window: int, modulus: int) -> np.ndarray:
    """Where triggers start, the start of the text excluded."""
    if len(raw) <= window:
        return np.empty(0, dtype=np.int64)
    found = triggers(grams(np.frombuffer(raw, dtype=np.uint8), window), modulus)
    return found[found > 0]


def phrases(raw: bytes, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of every phrase; the first starts with the text and the last ends with it."""
    inner = cuts(raw, window, modulus)
    return np.concatenate([[0], inner]), np.append(inner + window, len(raw))


def pairs(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each phrase with the one after it, where both have a trigger at either end; 0 for the others."""
    import xxhash

    out = np.zeros(len(start), dtype=np.uint64)
    if len(start) > 3:
        out[1:-2] = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(start[1:-2].tolist(), stop[2:-1].tolist())]
    return out.view(np.int64)


def _reach(n: int, start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair_stop, upto, thick) of every phrase: where its pair ends, its starts end, and those begin that hold the next two phrases."""
    last = max(len(start) - 2, 0)  # pairs from here on are open
    pair_stop = np.append(stop[1:], n + length)
    upto = np.minimum(np.append(start[1:], n), n - length + 1)
    thick = np.full(len(start), n, dtype=np.int64)
    bounded = max(last - 1, 0)
    thick[:bounded] = np.maximum(start[:bounded], pair_stop[1 : bounded + 1] - length)
    return pair_stop, upto, np.maximum(start, thick)


def has_thin(n: int, start: np.ndarray, stop: np.ndarray, length: int) -> bool:
    """Whether a text has thin starts, see :func:`starts`."""
    _, upto, thick = _reach(n, start, stop, length)
    return bool((start < np.minimum(upto, thick)).any())


def starts(n: int, start: np.ndarray, stop: np.ndarray, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of substrings that may be repeated: (context from, to, phrase) and, as rows of ``from`` and ``to`` with phrase -1, thin ones.

    ``repeated`` says of each phrase whether it and the next one stand together
    twice; the first and the last two have no trigger at one end and are never
    asked. A start is thin when its substring does not hold the two next phrases.
    """
    many = len(start)
    last = max(many - 2, 0)
    pair_stop, upto, thick = _reach(n, start, stop, length)
    after = np.arange(1, many + 1)
    bounded = after < last
    once = np.where(repeated, last, np.arange(many))
    once[last:] = last
    once = np.minimum.accumulate(once[::-1])[::-1]
    bad = once[np.minimum(after, many - 1)]  # the first pair from the next phrase on that occurs once
    end = np.minimum(upto, np.where(bad < last, pair_stop[bad] - length, n))
    whole = np.flatnonzero(bounded & (thick < end))
    thin = np.minimum(upto, thick)
    loose = np.flatnonzero(start < thin)
    return (
        np.concatenate([thick[whole], start[loose]]),
        np.concatenate([end[whole], thin[loose]]),
        np.concatenate([whole, np.full(len(loose), -1, dtype=np.int64)]),
    )


# -- order of a shard ------------------------------------------------------------------


def ranks(first: np.ndarray, end: np.ndarray, known: int = 1) -> np.ndarray:
    """Rank of every suffix that ends at ``end`` of its place, by doubling; equal suffixes have equal ranks from 1 on.

    ``first`` orders the suffixes by their first ``known`` items.
    """
    _, rank = np.unique(first, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    at, step, classes = np.arange(len(first)), known, 0
    longest = int((end - at).max(initial=0))
    while step < longest:
        follows = at + step
        then = np.where(follows < end, rank[np.minimum(follows, len(first) - 1)], 0)
        _, rank = np.unique(rank * (len(first) + 1) + then, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        now = int(rank.max())
        if now == classes:
            break
        step, classes = 2 * step, now
    return rank


def _packed(raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """Up to seven bytes from each place in one number (9 bits each, 0 past the end), so doubling starts there."""
    letter, left = raw.astype(np.int64) + 1, end - np.arange(len(raw))
    x = letter.copy()
    for step in range(1, 7):
        x <<= 9
        x[:-step] |= np.where(left[:-step] > step, letter[step:], 0)
    return x, 7


def repeated_starts(strings: list[bytes], length: int, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every start whose ``length`` bytes also start elsewhere in ``strings``.

    All starts of a string lie in its first phrase. The order of the starts is
    that of the rest of this phrase (suffix array of the dictionary), then of the
    phrases after it (suffix array of the parse).
    """
    import xxhash

    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    joined = b"".join(strings)
    raw = np.frombuffer(joined, dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    mixed = grams(raw, window)
    trigger = triggers(mixed, modulus)
    home = np.searchsorted(off, trigger, "right") - 1
    trigger = trigger[(trigger > off[home]) & (trigger + window <= off[home + 1])]
    # the parse: phrases of all strings in order, and the string of each
    start = np.sort(np.concatenate([off[:-1], trigger]))
    of = np.searchsorted(off, start, "right") - 1
    last = np.append(of[1:] != of[:-1], True)
    stop = np.where(last, off[of + 1], np.append(start[1:], 0) + window)
    names = np.array([xxhash.xxh3_64_intdigest(joined[i:j]) for i, j in zip(start.tolist(), stop.tolist())], dtype=np.uint64)
    _, which, word = np.unique(names, return_index=True, return_inverse=True)
    # the dictionary: each phrase once, and the rank of each of its suffixes
    in_word = stop[which] - start[which]
    base = np.concatenate([[0], np.cumsum(in_word)])
    inside = np.arange(base[-1]) - np.repeat(base[:-1], in_word)
    letters = raw[np.repeat(start[which], in_word) + inside]
    end = np.repeat(base[1:], in_word)
    packed, known = _packed(letters, end)
    suffix = ranks(packed, end, known)
    # the parse as ranks of whole phrases, and the rank of each of its suffixes
    parse = suffix[base[:-1]][word]
    first_of = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    parse_end = np.append(first_of[1:], len(of))[of]
    after = ranks(parse, parse_end)
    # both together order the starts
    counts = sizes - length + 1
    string = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = suffix[base[:-1][word[first_of]][string] + offset]
    follows = after[np.minimum(first_of + 1, len(after) - 1)][string]
    order = np.lexsort((follows, rest))
    prints = _prints(mixed, off[string] + offset, length, window)
    p, r = prints[order], rest[order]
    same = (p[1:] == p[:-1]) & (r[1:] == r[:-1])
    hit = np.zeros(len(order), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return string[hit], offset[hit]


BASE = 0x9E3779B97F4A7C15


def _prints(mixed: np.ndarray, at: np.ndarray, length: int, window: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place: a polynomial over the rolling hashes inside."""
    power = np.ones(len(mixed) + 1, dtype=np.uint64)
    power[1:] = np.uint64(BASE)
    inverse = np.ones(len(mixed) + 1, dtype=np.uint64)
    inverse[1:] = np.uint64(pow(BASE, -1, 1 << 64))
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)])
    return (total[at + length - window + 1] - total[at]) * inverse[at]


# -- the corpus --------------------------------------------------------------------------


class _Seen(set):
    """What a task has sent already; forgets everything when it has grown too large."""

    def new(self, key: bytes) -> bool:
        if key in self:
            return False
        if len(self) >= 200_000:
            self.clear()
        self.add(key)
        return True


def _key(raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(raw)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _parsed(docs: DataFrame, length: int, window: int, modulus: int) -> DataFrame:
    """(doc_id, n_bytes, sha256, key, k, thin, pairs, twice) per row; pairs of a text once per task."""
    fields = "n_bytes long, sha256 string, key binary, k long, thin boolean, pairs array<long>, twice array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        empty = np.empty(0, dtype=np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in each(batch.column("text")):
                raw = _raw(text)
                key, found, twice, thin = _key(raw), empty, empty, False
                if len(raw) >= length and seen.new(key):
                    start, stop = phrases(raw, window, modulus)
                    thin = has_thin(len(raw), start, stop, length)
                    found, times = np.unique(pairs(raw, start, stop)[1:-2], return_counts=True)
                    twice = found[times > 1]
                for column, value in zip(columns, (len(raw), hashlib.sha256(raw).hexdigest(), key, _short(key), thin, found, twice)):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "n_bytes", "sha256", "key", "k", "thin", "pairs", "twice"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, {fields}")


def _flagged(parsed: DataFrame) -> DataFrame:
    """(k, repeated): the repeated pairs of each text that has any, and texts with thin starts."""
    each_pair = parsed.select("k", F.explode("pairs").alias("pair"))
    counted = each_pair.groupBy("pair").agg(F.min("k").alias("least"), F.max("k").alias("most")).filter("least <> most").select("pair")
    twice = parsed.select(F.explode("twice").alias("pair"))
    repeated = materialize(counted.unionAll(twice).distinct(), "repeated-pairs")
    found = each_pair.join(repeated, "pair").select("k", "pair")
    thin = parsed.filter("thin").select("k", F.lit(None).cast("long").alias("pair"))
    return materialize(found.unionAll(thin).groupBy("k").agg(F.collect_set("pair").alias("repeated")), "pairs-of-texts")


def _thin(raw: bytes, low: np.ndarray, high: np.ndarray, length: int) -> list[tuple]:
    """Rows of thin starts: (start, 1, None, hash of the substring, None), each substring of a text once.

    What a text repeats itself (a long run of one letter has a single substring)
    comes as runs (start, number of starts, None, None, None), and tells other
    texts of itself by a row that counts twice and has no start.
    """
    import xxhash

    if not len(low):
        return []
    at = np.concatenate([np.arange(i, j) for i, j in zip(low.tolist(), high.tolist())])
    spelled = np.array([xxhash.xxh3_64_intdigest(raw[x : x + length]) for x in at.tolist()], dtype=np.uint64).view(np.int64)
    hashes, which, times = np.unique(spelled, return_inverse=True, return_counts=True)
    once = times[which] == 1
    rows = [(x, 1, None, h, None) for x, h in zip(at[once].tolist(), hashes[which[once]].tolist())]
    again = at[~once]
    if len(again):
        begin = np.flatnonzero(np.append(True, again[1:] != again[:-1] + 1))
        rows += [(x, n, None, None, None) for x, n in zip(again[begin].tolist(), np.diff(np.append(begin, len(again))).tolist())]
        rows += [(None, 2, None, h, None) for h in hashes[times > 1].tolist()]
    return rows


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which names are known."""
    if not len(known):
        return np.zeros(len(names), dtype=bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def _contexts(docs: DataFrame, flagged: DataFrame, length: int, window: int, modulus: int) -> DataFrame:
    """(key, text, found): texts with starts that may be repeated, each once.

    found: first start, number of starts, context (128-bit hash), anchor, the bytes where the task has not sent them
    before; thin starts (see ``_thin``) have no context and the hash of their substring in ``anchor``.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            keys, texts = [], []
            for text in each(batch.column("text")):
                raw = _raw(text)
                if len(raw) >= length and seen.new(key := _key(raw)):
                    keys.append(key)
                    texts.append(raw)
            arrays = [pa.array([_short(k) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "key", "raw"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        item = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("context", pa.binary()), ("anchor", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            keys, texts, ends, all_found = [], [], [0], []
            for key, raw, known in zip(batch.column("key").to_pylist(), each(batch.column("raw")), each(batch.column("repeated"))):
                start, stop = phrases(raw, window, modulus)
                names = pairs(raw, start, stop)
                low, high, phrase = starts(len(raw), start, stop, _among(names, np.array(known, dtype=np.int64)), length)
                loose = phrase < 0
                found = _thin(raw, low[loose], high[loose], length)
                for i, j, p in zip(low[~loose].tolist(), high[~loose].tolist(), phrase[~loose].tolist()):
                    part = raw[i : j + length - 1]
                    context = _key(part)
                    found.append((i, j - i, context, int(names[p + 1]), part if seen.new(context) else None))
                if found:
                    keys.append(key)
                    texts.append(raw)
                    all_found += found
                    ends.append(len(all_found))
            columns = [pa.array(c, kind.type) for c, kind in zip(zip(*all_found) if all_found else [[]] * len(item), item)]
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), places], ["key", "raw", "found"])

    texts = docs.select("text").mapInArrow(once, "k long, key binary, raw binary")
    matched = texts.join(flagged, "k").dropDuplicates(["k", "key"]).select("key", "raw", "repeated")
    kind = "array<struct<at:long,n:long,context:binary,anchor:long,bytes:binary>>"
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return materialize(matched.mapInArrow(read, f"key binary, raw binary, found {kind}"), "contexts")


def _by_order(contexts: DataFrame, shards: int, length: int, window: int, modulus: int) -> DataFrame:
    """(context, first, n): runs of repeated starts in contexts that occur once, from the order of bounded shards."""

    def run(table: pa.Table) -> pa.Table:
        strings = [x.as_py() for x in table.column("bytes")]
        single = np.array([n == 1 for n in table.column("n").to_pylist()])
        string, offset = repeated_starts(strings, length, window, modulus)
        keep = single[string]
        string, offset = string[keep], offset[keep]
        begin = np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(string) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(begin)
        names = table.column("context").take(pa.array(string[at]))
        return pa.table({"context": names, "first": pa.array(offset[at], pa.int64()), "n": pa.array(np.diff(np.append(at, len(string))), pa.int64())})

    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "context binary, first long, n long")


def _by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """The same for contexts of hot anchors: each start counts by the hash of its substring."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, raw, n in zip(batch.column("context").to_pylist(), each(batch.column("bytes")), batch.column("n").to_pylist()):
                many = len(raw) - length + 1
                hashes = pa.array([_short(_key(raw[x : x + length])) for x in range(many)], pa.int64())
                arrays = [hashes, pa.array([context] * many, pa.binary()), pa.array(range(many), pa.int64()), pa.array([n] * many, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["hash", "context", "first", "times"])

    spelled = materialize(contexts.select("context", "bytes", "n").mapInArrow(spell, "hash long, context binary, first long, times long"), "hot-starts")
    often = materialize(spelled.groupBy("hash").agg(F.sum("times").alias("times")).filter("times > 1").select("hash"), "hot-repeats")
    return spelled.filter("times = 1").join(often, "hash").select("context", "first", F.lit(1).cast("long").alias("n"))


def _hits(texts: DataFrame, length: int, window: int, modulus: int, most_contexts: int, shard_bytes: int) -> DataFrame:
    """(key, at, n): runs of repeated starts of texts."""
    places = texts.select("key", F.explode("found").alias("x")).select("key", "x.*")
    thin = places.filter("context is null and anchor is not null").select("key", "at", F.col("anchor").alias("hash"), "n")
    often = materialize(thin.groupBy("hash").agg(F.sum("n").alias("times")).filter("times > 1").select("hash"), "thin-repeats")
    thin = thin.filter("at is not null").join(often, "hash").select("key", "at", "n")
    thin = thin.unionAll(places.filter("context is null and anchor is null").select("key", "at", "n"))
    whole = places.filter("context is not null")
    contexts = whole.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"), F.max("n").alias("starts"))
    contexts = materialize(contexts, "distinct-contexts")
    # an anchor needs a second context for one that occurs once to be repeated in part
    anchors = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 and least = 1")
    open_ = materialize(contexts.join(materialize(anchors, "anchors"), "anchor").select("context", "anchor", "n", "starts", "contexts"), "open-contexts")
    spelled = whole.filter("bytes is not null").select("context", "bytes")
    few, many = (open_.filter(F.col("contexts") <= most_contexts), open_.filter(F.col("contexts") > most_contexts))
    total = few.agg(F.sum(F.col("starts") + length - 1)).first()[0] or 0
    few, many = (x.select("context", "anchor", "n").join(spelled, "context").dropDuplicates(["context"]) for x in (few, many))
    part = _by_order(few, max(1, -(-total // shard_bytes)), length, window, modulus).unionAll(_by_hash(many, length))
    occurs = whole.select("key", "at", F.col("n").alias("of"), "context")
    full = occurs.join(contexts.filter("n > 1").select("context"), "context").select("key", "at", F.col("of").alias("n"))
    partly = occurs.drop("of").join(part, "context").select("key", (F.col("at") + F.col("first")).alias("at"), "n")
    return materialize(thin.unionAll(full).unionAll(partly), "repeated-starts")


def merge(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Runs (first start, number of starts) -> maximal covered spans."""
    out: list[list[int]] = []
    for at, n in sorted(runs):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + n - 1 + length)
        else:
            out.append([at, at + n - 1 + length])
    return [(a, b) for a, b in out]


def repeats(
    docs: DataFrame,
    length: int = LENGTH,
    window: int = WINDOW,
    modulus: int = MODULUS,
    most_contexts: int = MOST_CONTEXTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (spans start, stop in bytes), kept_sha256.

    ``docs`` needs doc_id and text; other columns, whatever their names, are
    ignored. ``removed`` are the maximal runs of bytes of the UTF-8 text that lie
    in a ``length``-byte string that also starts elsewhere, in this or another
    row, overlaps included. A null text is empty; a text shorter than ``length``
    has nothing to remove; repeated rows repeat each other whole. Ids are only
    carried. Long texts are read whole. An empty table gives no rows.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        parsed = materialize(_parsed(docs, length, window, modulus), "parsed-texts")
    texts = _contexts(docs, _flagged(parsed), length, window, modulus)
    hits = _hits(texts, length, window, modulus, most_contexts, shard_bytes)
    runs = hits.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    span = "array<struct<start:long,stop:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            removed, digests = [], []
            for raw, found in zip(each(batch.column("raw")), each(batch.column("runs"))):
                spans = merge([(x["at"], x["n"]) for x in found], length)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                digests.append(hashlib.sha256(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))).hexdigest())
                removed.append([{"start": i, "stop": j} for i, j in spans])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, kind), pa.array(digests, pa.string())], ["key", "spans", "kept"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        per_text = materialize(texts.select("key", "raw").join(runs, "key").mapInArrow(cut, f"key binary, spans {span}, kept string"), "cut-texts")
    copies = materialize(parsed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copied-texts")
    facts = parsed.select("doc_id", "n_bytes", "sha256", "key")
    joined = facts.join(per_text, "key", "left").join(copies, "key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copied, everything).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {span})"))).alias("removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )
