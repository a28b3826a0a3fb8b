"""Alignment of the tokens of two tokenizers by whitespace-token anchors.

Both tokenizers read the whole text. Where both have a token that ends at the
same byte and the next token of both starts with a space, the text is split:
between two such anchors stands a window, a tuple of ids of the first tokenizer
beside a tuple of ids of the second. Windows repeat all over a corpus, so windows
with equal id tuples are one kind, and its alignment (groups and linked id pairs)
is worked out once in a chunk.

A task reads its texts in chunks of bounded size and writes for each text the
kinds of its windows, for each chunk its kinds and how often each id pair is
linked. Counts of the corpus are sums of these small tables, and come
back to the chunks by a join of chunk and pair, never of text and pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigraph.llm.common import BATCH_ROWS, batches_of, each, materialize

CHUNK_TOKENS = 1_500_000  # of the first tokenizer, in a chunk; one longer text is a chunk of its own
CHUNK_TEXTS = 20_000
SHIFT = 1 << 24  # pair = first id * SHIFT + second id; a vocabulary has fewer ids than this


class Coders:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, ranks_file: str, pieces_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(ranks_file), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces_file))
        a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            a[rank] = token
        b = [self._bytes(i) for i in range(self.second.vocab_size())]
        self.bytes = b
        self.sizes = [np.array([len(x) for x in v], dtype=np.int64) for v in (a, b)]
        self.spaced = [np.array([x[:1] == b" " for x in v]) for v in (a, b)]
        signs = ((",", "|"), (",", ";"))  # inside a group, at its end
        self.names = [np.array([f"{i}{sign}" for i in range(len(v)) for sign in s], dtype=object) for v, s in zip((a, b), signs)]

    def _bytes(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both, or None where one of them does not give the text back byte for byte."""
        spaced = " " + text
        a, b = self.first.encode_ordinary(spaced), self.second.encode(text)
        raw = spaced.encode()
        if self.first.decode_bytes(a) != raw or b"".join(map(self.bytes.__getitem__, b)) != raw:
            return None
        return a, b


_coders: dict[tuple[str, str], Coders] = {}


def coders(ranks_file: str, pieces_file: str) -> Coders:
    """Loaded once per Python worker."""
    key = (ranks_file, pieces_file)
    if key not in _coders:
        _coders[key] = Coders(*key)
    return _coders[key]


def align_windows(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, coder: Coders) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(groups as text, number of groups, linked pairs, where a window's pairs end) of windows laid one behind the other.

    Every byte where either sequence has an end closes a link of the two tokens that cover it; where both have, a group ends.
    """
    end_a, end_b = np.cumsum(coder.sizes[0][a]), np.cumsum(coder.sizes[1][b])
    ends = np.zeros(end_a[-1] + 1, dtype=np.uint8)
    ends[end_a] = 1
    ends[end_b] += 1
    closed = np.flatnonzero(ends)
    pairs = a[np.searchsorted(end_a, closed)].astype(np.int64) * SHIFT + b[np.searchsorted(end_b, closed)]
    upto = np.searchsorted(closed, end_a[stop_a - 1], "right")
    last_a, last_b = ends[end_a] > 1, ends[end_b] > 1
    per_window = np.diff(np.cumsum(last_a)[stop_a - 1], prepend=0)
    # the text: of each group the first tokens, then the second ones, each name with the sign that follows it
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    names = np.empty(len(a) + len(b), dtype=object)
    names[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = coder.names[0][2 * a + last_a]
    names[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = coder.names[1][2 * b + last_b]
    parts, cut = names.tolist(), (stop_a + stop_b).tolist()
    texts = ["".join(parts[i:j])[:-1] for i, j in zip([0, *cut], cut)]
    return texts, per_window, pairs, upto


def windows(a: np.ndarray, b: np.ndarray, coder: Coders, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows end in both id sequences; ``last`` has the byte ends of the texts, which always split."""
    end_a, end_b = np.cumsum(coder.sizes[0][a]), np.cumsum(coder.sizes[1][b])
    ends = np.zeros(end_a[-1] + 1, dtype=np.uint8)
    ends[end_a] = 1
    ends[end_b] += 1
    ends[last] += 1  # a text ends in both sequences
    at_a, at_b = np.flatnonzero(ends[end_a] > 1), np.flatnonzero(ends[end_b] > 1)
    spaced = np.append(coder.spaced[0][a[at_a[:-1] + 1]] & coder.spaced[1][b[at_b[:-1] + 1]], True) | (ends[end_a[at_a]] > 2)
    return at_a[spaced] + 1, at_b[spaced] + 1


def distinct(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each kind, kind of every window): windows with equal ids are of one kind, compared id by id."""
    start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
    in_a, in_b = stop_a - start_a, stop_b - start_b
    from_a, from_b = np.arange(len(a)) - np.repeat(start_a, in_a), np.arange(len(b)) - np.repeat(start_b, in_b)
    seed = 1
    while True:
        prints = np.add.reduceat(_mix(a, from_a, 2 * seed), start_a) + np.add.reduceat(_mix(b, from_b, 2 * seed + 1), start_b) * np.uint64(3)
        _, first, kind = np.unique(prints, return_index=True, return_inverse=True)
        like = first[kind]
        if (in_a == in_a[like]).all() and (in_b == in_b[like]).all():
            same_a = a == a[np.repeat(start_a[like], in_a) + from_a]
            if same_a.all() and (b == b[np.repeat(start_b[like], in_b) + from_b]).all():
                return first, kind
        seed += 1  # two kinds had one print: take another


def _mix(ids: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _by_frequency(first: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent kinds get small numbers, which compress well."""
    order = np.argsort(-np.bincount(kind, minlength=len(first)), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[kind]


def _picked(ids: np.ndarray, stop: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the chosen windows one behind the other, where each ends)."""
    start = np.concatenate([[0], stop[:-1]])[chosen]
    size = stop[chosen] - start
    cut = np.cumsum(size)
    return ids[np.repeat(start - (cut - size), size) + np.arange(cut[-1])], cut


def _packed(numbers: np.ndarray) -> bytes:
    """Window numbers of a text, compressed: they are the bulk of what is written and moved."""
    return pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), dtype="<i4") if n else np.empty(0, dtype=np.int32)


NO_WINDOWS = b""


class Chunk:
    """Texts of one chunk, and the rows they give."""

    def __init__(self, number: int, coder: Coders, digest: bool):
        self.number, self.coder, self.digest = number, coder, digest
        self.docs: list = []
        self.ids: list[tuple[np.ndarray, np.ndarray] | None] = []
        self.tokens = 0

    def add(self, doc, text: str | None) -> None:
        ids = self.coder.encode(text) if text else None
        self.docs.append(doc)
        self.ids.append(ids and (np.array(ids[0], dtype=np.int32), np.array(ids[1], dtype=np.int32)))
        self.tokens += len(ids[0]) if ids else 0

    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS or len(self.docs) >= CHUNK_TEXTS

    def rows(self) -> list[dict]:
        read = [n for n, x in enumerate(self.ids) if x]
        out = [{"chunk": self.number, "doc_id": d, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_windows": 0, "groups": "", "windows": NO_WINDOWS} for d in self.docs]
        if not read:
            return out
        a, b = (np.concatenate([self.ids[n][k] for n in read]) for k in (0, 1))
        upto = np.cumsum([len(self.ids[n][0]) for n in read])
        stop_a, stop_b = windows(a, b, self.coder, np.cumsum(self.coder.sizes[0][a])[upto - 1])
        first, kind = _by_frequency(*distinct(a, b, stop_a, stop_b))
        # one window of each kind stands for all
        (own_a, cut_a), (own_b, cut_b) = (_picked(x, stop, first) for x, stop in ((a, stop_a), (b, stop_b)))
        texts, groups, links, ends = align_windows(own_a, own_b, cut_a, cut_b, self.coder)
        pairs, link = np.unique(links, return_inverse=True)
        times = np.repeat(np.bincount(kind, minlength=len(first)), np.diff(ends, prepend=0))
        counts = np.bincount(link, weights=times, minlength=len(pairs)).astype(np.int64)
        cut = np.searchsorted(stop_a, upto, "left") + 1
        per_window = np.concatenate([[0], np.cumsum(groups[kind])])
        start = 0
        for n, stop in zip(read, cut.tolist()):
            mine = kind[start:stop]
            text = ";".join(map(texts.__getitem__, mine.tolist()))
            n_a, n_b = (len(x) for x in self.ids[n])
            n_groups = int(per_window[stop] - per_window[start])
            out[n] |= {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "n_windows": stop - start, "windows": _packed(mine)}
            out[n]["groups"] = hashlib.sha256(text.encode()).hexdigest() if self.digest else text
            start = stop
        out.append({"chunk": self.number, "pairs": pairs, "counts": counts, "ends": ends.astype(np.int32), "link": link.astype(np.int32)})
        return out


def _schema(doc_id: T.DataType) -> T.StructType:
    numbers = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_windows")]
    arrays = [("pairs", T.LongType()), ("counts", T.LongType()), ("ends", T.IntegerType()), ("link", T.IntegerType())]
    return T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("doc_id", doc_id), *numbers, T.StructField("groups", T.StringType()), T.StructField("windows", T.BinaryType())]
        + [T.StructField(c, T.ArrayType(t)) for c, t in arrays]
    )


def aligned(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", pieces_file: str = "piece_bpe_32k.model", digest: bool = False) -> DataFrame:
    """A written table with a row per text (its windows by number) and, for each chunk, one with the chunk's windows and pairs."""
    schema = _schema(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(ranks_file, pieces_file)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number, coder, digest)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), each(batch.column("text"))):
                chunk.add(doc, text)
                if chunk.full():
                    yield _batch(chunk.rows(), arrow)
                    number += 1
                    chunk = Chunk(number, coder, digest)
        if chunk.docs:
            yield _batch(chunk.rows(), arrow)

    with batches_of(docs.sparkSession, BATCH_ROWS):
        return materialize(docs.select("doc_id", "text").mapInArrow(read, schema), "aligned")


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _chunk_pairs(parts: DataFrame) -> DataFrame:
    tables = parts.filter("pairs is not null")
    return tables.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, is_best): links of each id pair in the corpus, and whether none of its second id has more."""
    counts = _chunk_pairs(parts).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select("pair", F.shiftright("pair", 24).alias("a_id"), F.pmod("pair", F.lit(SHIFT)).alias("b_id"), "n"), "pair-sums")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return materialize(counts.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("is_best")), "pair-counts")


def align(docs: DataFrame, digest: bool = False, **files: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``docs`` needs doc_id and text; other columns, whatever their names, are
    ignored. ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids, or with ``digest`` its
    lower-case SHA-256. A null or empty text, and one that a tokenizer does not
    give back byte for byte, has zeros and empty groups. A null id is a value like
    any other; repeated rows are counted and returned as often as they occur. Texts
    are read whole: one longer than a chunk is a chunk of its own. Ties for the
    highest count all count as best. An empty table gives no rows.
    """
    parts = aligned(docs, digest=digest, **files)
    found = _chunk_pairs(parts).select("chunk", "pair").join(pair_counts(parts).select("pair", "n", "is_best"), "pair").select(F.col("chunk").alias("of_chunk"), "pair", "n", "is_best")
    schema = T.StructType(
        [parts.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], parts.schema["groups"]]
    )

    def add(rows: pa.Table, totals: pa.Table) -> pa.Table:
        texts = rows.filter(pc.is_null(rows.column("pairs")))
        best = count = np.zeros(0, dtype=np.int64)
        if totals.num_rows:
            totals = totals.sort_by("pair")
            table = rows.filter(pc.is_valid(rows.column("pairs")))
            link, ends = (np.asarray(table.column(c)[0].values) for c in ("link", "ends"))
            starts = np.concatenate([[0], ends[:-1]])
            count = np.add.reduceat(totals.column("n").to_numpy()[link], starts)
            best = np.add.reduceat(totals.column("is_best").to_numpy().astype(np.int64)[link], starts)
        many = texts.column("n_windows").to_pylist()
        kind = np.concatenate([np.empty(0, dtype=np.int32), *map(_unpacked, texts.column("windows").to_pylist(), many)])
        upto = np.cumsum([0, *many])
        sums = {}
        for name, value in (("n_best", best), ("count_sum", count)):
            running = np.concatenate([[0], np.cumsum(value[kind])]).astype(np.int64)
            sums[name] = pa.array(running[upto[1:]] - running[upto[:-1]])
        return pa.table([sums[f.name] if f.name in sums else texts.column(f.name) for f in schema], names=[f.name for f in schema])

    return parts.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(add, schema)
