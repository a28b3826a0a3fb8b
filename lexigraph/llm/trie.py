"""Prefix trie of conversations that are rebuilt from the head of a base and an own suffix.

A turn sequence has a fingerprint in the monoid of pairs (BASE^n, h) modulo a
Mersenne prime: the product of two sequences' pairs is the pair of their
concatenation. The fingerprints of all prefixes of a stored conversation are
running products; a rebuilt prefix is the product of a prefix of the base and a
quotient of two prefixes of the conversation itself. So no rebuilt text is ever
made: a prefix is a fingerprint and a reference to the stored turn it ends with.
Prefixes with equal fingerprints are one node; that their last turns are equal is
checked on the stored turns their references name.

Sums over a subtree are taken along conversations: what a node contributes is
charged to its smallest member, summed from each depth to the end of that
conversation, and added up per node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexigraph.llm.common import each, materialize

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1CE4E5B9D6E8FEB86659FD9 % PRIME
HEADS = 6  # a head has fewer turns than this
GROUP = 100
PIECE = 4096  # ids in a piece of a list that is hashed


def element(role: str, text: str) -> int:
    """The value of a turn; lengths keep role and text apart."""
    raw = role.encode("utf-8", "surrogatepass")
    data = len(raw).to_bytes(8, "little") + raw + text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=16).digest(), "little") % PRIME


def _pack(h: int) -> tuple[int, int]:
    """Two signed longs; grouping by longs stays in hash tables."""
    low, high = h & (1 << 64) - 1, h >> 64
    return low - (low >> 63 << 64), high


def _value(low: int, high: int) -> int:
    return (low & (1 << 64) - 1) | high << 64


_powers = [1]


def power(n: int) -> int:
    """BASE ** n modulo the prime."""
    if n >= 4096:
        return pow(BASE, n, PRIME)
    while len(_powers) <= n:
        _powers.append(_powers[-1] * BASE % PRIME)
    return _powers[n]


def product(h: int, other: int, n: int) -> int:
    """Fingerprint of a sequence with another one of ``n`` turns behind it."""
    return (h * power(n) + other) % PRIME


def quotient(whole: int, head: int, n: int) -> int:
    """Fingerprint of the last ``n`` turns of a sequence whose other turns give ``head``."""
    return (whole - head * power(n)) % PRIME


def head_length(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


INVERSE = pow(BASE, -1, PRIME)


# -- running values along sorted rows ----------------------------------------------------

State = tuple[int, ...]


def scan(rows: DataFrame, order: list[Column], reads: list[str], names: list[str], lift: Callable[..., State], combine: Callable[[State, State], State], name: str) -> DataFrame:
    """``rows`` without ``reads`` and, as longs ``names``, the product of a conversation's elements up to each row in ``order``.

    ``order`` starts with conv_id; ``lift`` makes an element of the values of
    ``reads``. Rows are laid out by a range exchange, so a conversation of any
    length is spread over tasks. Each task multiplies its own stretch; what goes
    on from one range to the next is at most one row a range.
    """
    kept = [f for f in rows.schema.fields if f.name not in reads]
    results = [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([*kept, *results])
    open_end = T.StructType([*results, T.StructField("part", T.LongType()), T.StructField("is_last", T.BooleanType())])

    def columns(batch: pa.RecordBatch, states: list[State]) -> list[pa.Array]:
        return [*(batch.column(f.name) for f in kept), *(pa.array([s[k] for s in states], pa.int64()) for k in range(len(names)))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, state, held = TaskContext.get().partitionId(), None, (), None
        every = [f.name for f in (*kept, *open_end)]

        def done(arrays: list[pa.Array], last: bool) -> pa.RecordBatch:
            n = len(arrays[0])
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int64()), pa.array([False] * (n - 1) + [last])], every)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield done(held, False)
            states = []
            for c, *values in zip(batch.column("conv_id").to_pylist(), *(each(batch.column(x)) for x in reads)):
                state = combine(state, lift(*values)) if c == conv else lift(*values)
                conv = c
                states.append(state)
            held = columns(batch, states)
        if held:
            yield done(held, True)

    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = materialize(laid.mapInArrow(local, T.StructType([*kept, *open_end])), name)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, state = [], None, ()
        for batch in batches:
            for part, c, *total in zip(*(batch.column(k).to_pylist() for k in ("part", "conv_id", *names))):
                if conv is not None:
                    out.append((part, conv, *state))  # it may end inside this range
                state = combine(state, tuple(total)) if c == conv else tuple(total)
                conv = c
        arrays = [pa.array([r[k] for r in out], pa.int64()) for k in range(2 + len(names))]
        yield pa.RecordBatch.from_arrays(arrays, ["in_part", "of_conv", *fronts])

    fronts = [f"front_{n}" for n in names]
    ends = stretches.filter("is_last").select("part", "conv_id", *names).repartition(1).sortWithinPartitions("part")
    fields = ", ".join(f"{c} long" for c in ("in_part", "of_conv", *fronts))
    carried = materialize(ends.mapInArrow(go_on, fields), f"{name}-carried")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = zip(*(batch.column(c).to_pylist() for c in names))
            front = zip(*(batch.column(c).to_pylist() for c in fronts))
            states = [s if f[0] is None else combine(f, s) for f, s in zip(front, mine)]
            yield pa.RecordBatch.from_arrays(columns(batch, states), schema.names)

    met = stretches.join(F.broadcast(carried), (F.col("part") == F.col("in_part")) & (F.col("conv_id") == F.col("of_conv")), "left")
    return materialize(met.drop("part", "is_last", "in_part", "of_conv").mapInArrow(put, schema), f"{name}-running")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, chars, pos, low, high, v_low, v_high): turns in order, pos from 1, with the fingerprint of all up to each and its own value."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), role.alias("role"), text.alias("text"), F.length(text).cast("long").alias("chars"), "turn"
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.withColumns({"_role": F.col("role"), "_text": F.col("text")})
    return scan(rows, order, ["_role", "_text"], ["pos", "low", "high", "v_low", "v_high"], _lift, _combine, "turns").drop("turn")


def _lift(role: str, text: str) -> State:
    value = _pack(element(role, text))
    return (1, *value, *value)


def _combine(a: State, b: State) -> State:
    """Lengths add up, fingerprints multiply, the last value is the second one's."""
    return (a[0] + b[0], *_pack(product(_value(*a[1:3]), _value(*b[1:3]), b[0])), *b[3:])


# -- rebuilt conversations -----------------------------------------------------------------

NODE = ["depth", "low", "high"]
MEMBER = ["conv_id", *NODE, "up_low", "up_high", "ref_conv", "ref_pos", "chars", "n"]


def members(stored: DataFrame) -> DataFrame:
    """MEMBER columns: every prefix of every rebuilt conversation, the empty one included.

    low and high are the prefix's fingerprint, up_low and up_high that of the
    prefix one turn shorter; the reference names the stored turn a prefix ends
    with, and n is the length of the rebuilt conversation.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    heads = stored.filter(F.col("pos") < HEADS).groupBy("conv_id")
    heads = materialize(heads.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high", "chars"))).alias("head")), "heads")
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    known = stored.groupBy("conv_id").agg(F.max("pos").alias("own")).join(heads, "conv_id")
    known = known.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    known = known.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left")
    taken = F.coalesce(F.filter("base_head", lambda x: x["pos"] <= F.col("h")), F.slice("head", 1, 0))
    cut = F.when(F.col("h") > 0, F.try_element_at("head", F.greatest(F.col("h"), F.lit(1)).cast("int")))
    known = known.select("conv_id", "base", "h", "own", taken.alias("taken"), cut.alias("cut"))
    known = known.withColumn("front", F.try_element_at("taken", F.lit(-1))).withColumn("first", F.size("taken").cast("long"))
    known = materialize(known.withColumn("n", F.col("first") + F.greatest(F.col("own") - F.col("h"), zero)), "rebuilt")

    root = known.select("conv_id", *[zero.alias(c) for c in NODE], *[none.alias(c) for c in MEMBER[4:8]], zero.alias("chars"), "n")
    # prefixes inside the head are prefixes of the base
    inside = known.select("conv_id", "n", "base", "taken", F.posexplode("taken").alias("at", "t"))
    before = F.when(F.col("at") > 0, F.try_element_at("taken", F.greatest(F.col("at"), F.lit(1))))
    inside = inside.select(
        "conv_id", F.col("t.pos").alias("depth"), "t.low", "t.high", F.coalesce(before["low"], zero).alias("up_low"), F.coalesce(before["high"], zero).alias("up_high"),
        F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"), "t.chars", "n",
    )
    sides = [F.coalesce(F.col(side)[c], zero).alias(f"{side}_{c}") for side in ("cut", "front") for c in ("low", "high")]
    own = stored.select("conv_id", "pos", "low", "high", "v_low", "v_high", "chars").join(known.select("conv_id", "h", "first", "n", *sides), "conv_id")
    reads = ["pos", "h", "first", "low", "high", "v_low", "v_high", "cut_low", "cut_high", "front_low", "front_high"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, h, first, low, high, v_low, v_high, cut_low, cut_high, front_low, front_high in zip(*(batch.column(c).to_pylist() for c in reads)):
                own = quotient(_value(low, high), _value(cut_low, cut_high), pos - h)
                node = product(_value(front_low, front_high), own, pos - h)
                out.append((first + pos - h, *_pack(node), *_pack((node - _value(v_low, v_high)) * INVERSE % PRIME)))
            made = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made, *(batch.column(c) for c in ("conv_id", "pos", "chars", "n"))], MEMBER)

    behind = own.filter(F.col("pos") > F.col("h")).mapInArrow(multiply, ", ".join(f"{c} long" for c in MEMBER))
    return materialize(root.select(*MEMBER).unionAll(inside.select(*MEMBER)).unionAll(behind), "members")


def _verified(prefixes: DataFrame, stats: DataFrame, stored: DataFrame) -> DataFrame:
    """``stats``, once the stored turns that prefixes of one node refer to are found equal; otherwise an error."""
    several = stats.filter("least_conv <> most_conv or least_pos <> most_pos").select(*NODE)
    # written first: the distinct rows then move by all columns, not by node
    refs = materialize(prefixes.join(several, NODE).select(*NODE, "ref_conv", "ref_pos"), "references").distinct()
    turn = F.struct("role", "text")
    read = refs.join(stored.select(F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "role", "text"), ["ref_conv", "ref_pos"])
    differ = read.groupBy(*NODE).agg((F.min(turn) != F.max(turn)).alias("differ")).filter("differ")
    if not differ.isEmpty():
        raise RuntimeError("two different turn sequences have one fingerprint; choose another BASE")
    return stats


def _digests(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: their ids in order are joined in pieces, and the pieces hashed one after the other."""
    order = [*NODE, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if ids and (key != node or len(ids) >= PIECE):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(conv)
            yield _rows(out, kinds, names)
        if ids:
            yield _rows([(*node, ids[0], ",".join(map(str, ids)))], kinds, names)

    names, kinds = [*NODE, "first", "ids"], [pa.int64()] * 4 + [pa.string()]
    ends = prefixes.filter("depth = n").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    listed = materialize(ends.mapInArrow(pieces, "depth long, low long, high long, first long, ids string"), "end-lists")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in NODE), each(batch.column("ids"))):
                if key == node:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
            yield _rows(out, [pa.int64()] * 3 + [pa.string()], [*NODE, "ends_sha256"])
        if sha:
            yield _rows([(*node, sha.hexdigest())], [pa.int64()] * 3 + [pa.string()], [*NODE, "ends_sha256"])

    laid = listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return laid.mapInArrow(hashed, "depth long, low long, high long, ends_sha256 string")


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` needs conv_id, turn, role and text; other columns, whatever
    their names, are ignored. Turns are ordered by turn (null first), ties by role
    and text; the base of a negative id is the one towards zero, as remainders in
    SQL. A null role or text is empty; rows with a null conv_id belong to no
    conversation. Repeated rows are turns of their own. A node is named by its
    smallest member; the root has no parent. An empty table gives no rows.
    """
    stored = turns(conversations)
    prefixes = members(stored)
    stats = prefixes.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("name"), F.max("n").alias("deepest"), F.min("up_low").alias("up_low"),
        F.min("up_high").alias("up_high"), F.min("chars").alias("node_chars"), *[f(f"ref_{c}").alias(f"{n}_{c}") for c in ("conv", "pos") for n, f in (("least", F.min), ("most", F.max))],
    )
    stats = _verified(prefixes, materialize(stats, "nodes"), stored)
    # a node's share goes to its smallest member, and from there to all prefixes of that member
    is_name = F.col("conv_id") == F.col("name")
    saved = F.when(is_name, (F.col("n_convs") - 1) * F.col("node_chars")).otherwise(F.lit(0))
    leaf = F.when(is_name & (F.col("deepest") == F.col("depth")), F.lit(1)).otherwise(F.lit(0))
    shares = prefixes.select("conv_id", *NODE).join(stats.select(*NODE, "name", "n_convs", "node_chars", "deepest"), NODE)
    shares = materialize(shares.select("conv_id", *NODE, saved.cast("long").alias("saved"), leaf.cast("long").alias("leaf")), "shares")
    order = [F.col("conv_id"), F.col("depth").desc()]
    onward = scan(shares, order, ["saved", "leaf"], ["saved_onward", "leaves_onward"], lambda s, f: (s, f), lambda a, b: (a[0] + b[0], a[1] + b[1]), "shares-laid")
    sums = onward.groupBy(*NODE).agg(F.sum("saved_onward").alias("saved_tokens"), F.sum("leaves_onward").alias("n_leaves"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_low").alias("low"), F.col("up_high").alias("high")]
    children = stats.filter("depth > 0").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    facts = materialize(stats.join(sums, NODE).join(children, NODE, "left").join(_digests(prefixes), NODE, "left"), "node-facts")
    parents = stats.select((F.col("depth") + 1).alias("depth"), F.col("low").alias("up_low"), F.col("high").alias("up_high"), F.col("name").alias("parent_conv_id"))
    named = facts.join(parents, ["depth", "up_low", "up_high"], "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return named.select(
        F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
