"""Best-fit packing of documents into fixed-length sequences, improved by swaps.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by
position into groups of bounded size; each group is packed by best fit, largest
first, and then improved by local search: a piece moves to, or is exchanged one
for one or two for one with, an emptier bin whenever that raises the sum of
squared fills, so fills drift apart until the emptiest bins are empty. A group
wastes part of one bin, so with ``group_size`` pieces in a group the loss by
grouping is below one bin in a thousand.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigraph.llm.common import BATCH_ROWS, batches_of, each, materialize

CAPACITY = 2048
SPECIAL = "<|endoftext|>"

_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def _encoder(ranks_file: str, tokenizer_file: str):
    """text -> token ids; loaded once per Python worker.

    Both files hold one vocabulary. The rank form is three times as fast; a text
    that spells the special token goes through the other one, which knows it.
    """
    key = (ranks_file, tokenizer_file)
    if key not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks_file), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        del ranks
        _encoders[key] = lambda text: _full(tokenizer_file)(text) if SPECIAL in text else fast.encode_ordinary(text)
    return _encoders[key]


@lru_cache
def _full(tokenizer_file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(tokenizer_file))
    return lambda text: coder.encode(text, add_special_tokens=False).ids


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    ranks_file: str = "byte_bpe_50k.tiktoken",
    tokenizer_file: str = "byte_bpe_50k.json",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes).

    A document is its token ids and a closing 0; a null or empty text is the 0
    alone. Longer ones are cut so that all pieces but the first are full; a text of
    any length is read whole. ``docs`` needs doc_id and text; other columns are
    ignored, whatever they are called.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_file, tokenizer_file)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column("doc_id").to_pylist(), each(batch.column("text"))):
                ids = encode(text) if text else []
                ids.append(0)
                raw = np.asarray(ids, dtype="<u4").tobytes()
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = raw[4 * a : 4 * b]
                    for column, value in zip(columns, (doc, number, a, b - a, zlib.crc32(part), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set where some bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        left = room - size
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins


class _Rooms:
    """Bins that are not full, by room; of each room the sizes that its bins can give back, single pieces and pairs."""

    def __init__(self, sizes: list[int], bins: list[list[int]], fill: list[int], capacity: int):
        self.sizes, self.bins, self.fill, self.capacity = sizes, bins, fill, capacity
        self.rooms: list[int] = []
        self.back: dict[int, dict[int, set[int]]] = {}  # room -> size given back (0: nothing) -> bins
        self.sums: dict[int, list[int]] = {}  # room -> the same sizes in order
        for number in range(len(bins)):
            self.add(number)

    def _gives(self, number: int) -> set[int]:
        held = sorted(self.sizes[i] for i in self.bins[number])
        twice = {2 * x for x, y in zip(held, held[1:]) if x == y}
        kinds = sorted(set(held))
        return {0} | set(kinds) | twice | {x + y for n, x in enumerate(kinds) for y in kinds[:n]}

    def add(self, number: int) -> None:
        room = self.capacity - self.fill[number]
        if not room or not self.bins[number]:
            return
        if room not in self.back:
            insort(self.rooms, room)
            self.back[room], self.sums[room] = {}, []
        for size in self._gives(number):
            if size not in self.back[room]:
                self.back[room][size] = set()
                insort(self.sums[room], size)
            self.back[room][size].add(number)

    def drop(self, number: int) -> None:
        room = self.capacity - self.fill[number]
        if not room or not self.bins[number]:
            return
        back, sums = self.back[room], self.sums[room]
        for size in self._gives(number):
            back[size].discard(number)
            if not back[size]:
                del back[size]
                del sums[bisect_right(sums, size) - 1]
        if not back:
            del self.back[room], self.sums[room]
            del self.rooms[bisect_right(self.rooms, room) - 1]

    def taker(self, giver: int, size: int) -> tuple[int, int] | None:
        """(bin, size it gives back) of the fullest other bin, no emptier than the giver, that gains by taking a piece; it gives as little as it can."""
        most = self.capacity - self.fill[giver]
        for room in self.rooms:
            if room > most:
                return None
            sums = self.sums[room]
            for at in range(bisect_right(sums, size - room - 1), len(sums)):
                if sums[at] >= size:
                    break
                others = self.back[room][sums[at]]
                if len(others) > (giver in others):
                    return min(n for n in others if n != giver), sums[at]
        return None


def improve(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Moves and swaps between underfull bins that raise the sum of squared fills, until none does or no fewer bins can hold all.

    The emptiest bins give: each of their pieces goes to the fullest bin that can
    take it, take it for a smaller piece, or for two smaller pieces. Every step
    moves fill from a bin to one that is no emptier, so the search ends.
    """
    bins = [b for b in bins if b]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least, used = -(-sum(fill) // capacity), len(bins)
    if used <= least:
        return bins
    rooms = _Rooms(sizes, bins, fill, capacity)
    changed = True
    while changed and used > least:
        changed = False
        for giver in sorted((n for n in range(len(bins)) if bins[n] and fill[n] < capacity), key=lambda n: (fill[n], n)):
            for item in sorted(bins[giver], key=lambda i: (-sizes[i], i)):
                if item not in bins[giver] or fill[giver] == capacity:
                    continue
                found = rooms.taker(giver, sizes[item])
                if found is None:
                    continue
                taker, given = found
                rooms.drop(giver)
                rooms.drop(taker)
                back = _returned(sizes, bins[taker], given)
                bins[giver] = [i for i in bins[giver] if i != item] + back
                bins[taker] = [i for i in bins[taker] if i not in back] + [item]
                fill[giver] -= sizes[item] - given
                fill[taker] += sizes[item] - given
                used -= not bins[giver]
                rooms.add(giver)
                rooms.add(taker)
                changed = True
            if used <= least:
                break
    return [b for b in bins if b]


def _returned(sizes: list[int], held: list[int], total: int) -> list[int]:
    """No piece, one or two of a bin that have this size together."""
    if not total:
        return []
    seen: dict[int, int] = {}
    pair = None
    for item in held:
        if sizes[item] == total:
            return [item]
        if total - sizes[item] in seen:
            pair = pair or [seen[total - sizes[item]], item]
        seen.setdefault(sizes[item], item)
    return pair


def pack(parts: DataFrame, capacity: int = CAPACITY, group_size: int = 20000) -> DataFrame:
    """``parts`` (any columns, with ``length``) plus sequence_id and offset.

    Parts are packed in groups of about ``group_size``, dealt by their position
    in the written table, so equal rows are spread like any others. Repeated rows
    are packed as often as they occur, a null id like any other. A column named
    sequence_id or offset is replaced. An empty table gives an empty table.
    """
    with batches_of(parts.sparkSession, BATCH_ROWS):
        parts = materialize(parts.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-parts.count() // group_size))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(group: pa.Table) -> pa.Table:
        number = group.column("_group")[0].as_py()
        group = group.drop_columns(["_group"]).sort_by([(c, "ascending") for c in ("length", "doc_id", "piece")])
        sizes = group.column("length").to_pylist()
        sequence = np.zeros(len(sizes), dtype=np.int64)
        offset = np.zeros(len(sizes), dtype=np.int64)
        for at, held in enumerate(improve(sizes, best_fit(sizes, capacity), capacity)):
            place = 0
            for item in held:
                sequence[item], offset[item] = number * (1 << 32) + at, place
                place += sizes[item]
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fill, schema)
