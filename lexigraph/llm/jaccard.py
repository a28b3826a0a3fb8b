"""Similarity join of documents on word shingles by T-occurrence search.

Two documents link when their sets of distinct 5-word shingles have a Jaccard
similarity of 0.75 or more. A linked pair shares at least 75 % of the larger
set, which is what every step below uses:

1. Equal sets form one class; a class is handled once.
2. Screen. In one global random order of the shingles the first
   ``s - need + l`` of a set of size s hold l shingles of any partner (need =
   75 % of s). Only those few are laid out as inverted lists. A class with
   fewer shared ones than l cannot link and is done; that is nearly all.
3. For the others, whole sets are laid out. A class whose sets are not 75 %
   covered by lists with a second member of a fitting size is done too.
4. What is left is grouped by its rarest shingles (a linked pair shares one of
   the ``s - need + 1`` rarest), and searched in blocks: each block holds an
   inverted index in memory, short lists are merged by counting, candidates
   that can still reach the overlap are probed in the long lists by binary
   search (DivideSkip), and the overlap is compared exactly.

A group larger than a block is searched block by block first; blocks whose
members already hang together need not meet again, all others do, so no link
between components is lost and no group is taken into one task. What a list says
of its members is counted by step of size before it moves, so a hot list is a few
rows, and comes back by a join that adaptive execution can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.llm.common import BATCH_ROWS, batches_of, each, materialize
from lexigraph.llm.components import components

WIDTH = 5
PERCENT = 75
BLOCK = 256
BROADCAST_ROWS = 1_000_000
WORD_CACHE = 100_000


class _WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    Bytes are lower-cased and split as ASCII only, which is the definition of a
    word here: A-Z fold, other letters stay, and only ASCII white space separates.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for j in range(span):
        total = (total ^ h[j : len(words) - span + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def need(size: int) -> int:
    """Shingles that a set of this size shares with any set it links to, at least."""
    return -(-PERCENT * size // 100)


def slack(size: int) -> int:
    """Shared shingles that the screen asks for."""
    return 1 + size // 20


def _need(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def _class(values: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, first): one row per row; equal sets have one class, an empty set has none.

    ``first`` are a set's first shingles in the global order, where a task meets
    the class for the first time; elsewhere it is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            sizes, names, firsts = [], [], []
            for text in each(batch.column("text")):
                values = shingle_set(text, hashes)
                n = len(values)
                name = _class(values) if n else None
                new = name is not None and name not in seen
                if new:
                    seen.add(name)
                sizes.append(n)
                names.append(name)
                firsts.append(values[: n - need(n) + slack(n)].view(np.int64) if new else None)
            made = [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "n_shingles", "cls", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(read, f"doc_id {kind}, text_hash long, n_shingles long, cls long, first array<long>")


def _whole_sets(docs: DataFrame) -> DataFrame:
    """(cls, n, hashes): whole sets; copies within a task once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            names, sizes, lists = [], [], []
            for text in each(batch.column("text")):
                values = shingle_set(text, hashes)
                if not len(values) or (name := _class(values)) in seen:
                    continue
                seen.add(name)
                names.append(name)
                sizes.append(len(values))
                lists.append(values.view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in lists])
            flat = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["cls", "n", "hashes"],
            )

    return docs.select("text").mapInArrow(read, "cls long, n long, hashes array<long>")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings (hash, cls, n) whose list has another class of a fitting size, with the list's length ``df``.

    Sizes fall into steps a little wider than the ratio of linked sizes, so a
    fitting partner is in the same step or the next one. A list is a few dozen
    steps, counted before they move; no list's members meet in one task.
    """
    step = F.floor(F.log("n") / math.log(1.34)).cast("int")
    stepped = postings.withColumn("step", step)
    steps = stepped.groupBy("hash", "step").agg(
        F.count(F.lit(1)).alias("members"), F.min("cls").alias("a"), F.max("cls").alias("b"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    whole = Window.partitionBy("hash")
    along = whole.orderBy("step")
    above = F.when(F.lead("step").over(along) == F.col("step") + 1, F.lead("low").over(along))
    below = F.when(F.lag("step").over(along) == F.col("step") - 1, F.lag("high").over(along))
    several = F.col("a") != F.col("b")
    met = F.coalesce(F.col("high") * 100 >= F.col("above") * PERCENT, F.lit(False)) | F.coalesce(F.col("below") * 100 >= F.col("low") * PERCENT, F.lit(False))
    steps = steps.withColumn("df", F.sum("members").over(whole)).withColumn("above", above).withColumn("below", below).filter(several | met)
    steps = materialize(steps.select("hash", "step", "df", several.alias("several"), "above", "below"), "list-steps")
    fits = F.col("several") | F.coalesce(F.col("n") * 100 >= F.col("above") * PERCENT, F.lit(False)) | F.coalesce(F.col("below") * 100 >= F.col("n") * PERCENT, F.lit(False))
    return stepped.join(steps, ["hash", "step"]).filter(fits).select("hash", "cls", "n", "df")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the table is known to be small; otherwise Spark joins as it sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _survivors(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, n, hashes) of the classes that may link to another one: steps 2 and 3."""
    postings = known.filter("first is not null").select(F.explode("first").alias("hash"), "cls")
    sizes = known.groupBy("cls").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    # most lists have one class and go here; copies in different tasks give equal postings
    lists = postings.groupBy("hash").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("hash")
    kept = postings.join(materialize(lists, "shared-lists"), "hash").distinct()
    kept = materialize(kept.join(sizes.select("cls", "n"), "cls").select("hash", "cls", "n"), "shared-postings")
    asked = 1 + F.floor(_need(F.col("n")) / 20)  # what the smallest partner still guarantees
    first = _shared(kept).groupBy("cls", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= asked)
    first = first.join(sizes, "cls").select("cls", "doc_id")
    first = materialize(first, "screened")
    rows = first.count()
    chosen = first.select(F.col("doc_id").alias("chosen")).distinct()
    texts = docs.join(_bounded(chosen, rows), F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text")
    whole = _whole_sets(texts).join(_bounded(first.select("cls"), rows), "cls", "left_semi")
    whole = materialize(whole.groupBy("cls").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "whole-sets")
    lists = _shared(whole.select("cls", "n", F.explode("hashes").alias("hash")))
    covered = lists.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= _need(F.col("n")))
    covered = materialize(covered.select("cls"), "covered")
    return materialize(whole.join(_bounded(covered, covered.count()), "cls", "left_semi"), "survivors")


def _groups(survivors: DataFrame) -> DataFrame:
    """(cls, grp): classes that share one of their rarest shingles, directly or through others."""
    lists = _shared(survivors.select("cls", "n", F.explode("hashes").alias("hash")))
    rarest = Window.partitionBy("cls").orderBy("df", "hash")
    # shingles without a fitting partner come first in the order and are only counted
    unshared = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cls"))
    kept = lists.withColumn("at", F.row_number().over(rarest) + unshared).filter(F.col("at") <= F.col("n") - _need(F.col("n")) + 1)
    kept = materialize(kept.select("hash", "cls"), "rarest-postings")
    least = materialize(kept.groupBy("hash").agg(F.min("cls").alias("b")), "list-heads")
    links = kept.join(least, "hash").select(F.col("cls").alias("a"), "b")
    return components(links).select(F.col("id").alias("cls"), F.col("component").alias("grp"))


# -- search within a block -----------------------------------------------------------


class _Union:
    def __init__(self, labels: list[int]):
        self.parent = {x: x for x in labels}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def t_occurrence(sets: list[np.ndarray], queries: list[int], index: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Pairs (query, member) that link, enough of them to join what is joined; equal labels count as joined.

    DivideSkip: of a query's lists the longest are set aside; the short ones are
    merged, and a member seen ``need - long`` times there is probed in the long
    ones by binary search.
    """
    hashes = np.concatenate([sets[i] for i in index])
    members = np.repeat(np.arange(len(index)), [len(sets[i]) for i in index])
    order = np.argsort(hashes, kind="stable")
    hashes, members = hashes[order], members[order]
    place = np.array(index)
    union = _Union(labels)
    out = []
    for q in queries:
        mine = sets[q]
        start, stop = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
        length = stop - start
        least = need(len(mine))
        found = np.flatnonzero(length)
        if len(found) < least:
            continue
        found = found[np.argsort(length[found], kind="stable")]
        longest = int(length[found[-1]])
        aside = min(least - 1, int(least / (0.02 * math.log2(longest + 1) + 1)))
        short, long = found[: len(found) - aside], found[len(found) - aside :]
        merged = np.concatenate([members[start[k] : stop[k]] for k in short])
        times = np.bincount(merged, minlength=len(index))
        probes = np.sort(mine[long])
        for m in np.flatnonzero(times >= least - aside):
            other = int(place[m])
            if other == q or union.find(labels[q]) == union.find(labels[other]):
                continue
            theirs = sets[other]
            at = np.searchsorted(theirs, probes)
            at[at == len(theirs)] = 0
            both = int(times[m]) + int((theirs[at] == probes).sum())
            if 100 * both >= PERCENT * (len(mine) + len(theirs) - both):
                union.join(labels[q], labels[other])
                out.append((q, other))
    return out


def _search(members: DataFrame) -> DataFrame:
    """(task, side, cls, label, hashes) -> links (a, b); side 0 is searched among side 1, or all of a task without sides."""

    def run(table: pa.Table) -> pa.Table:
        names, sides, labels = (table.column(c).to_pylist() for c in ("cls", "side", "label"))
        column = table.column("hashes").combine_chunks()
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
        index = [i for i, s in enumerate(sides) if s in (1, 2)]
        queries = [i for i, s in enumerate(sides) if s in (0, 2)]
        pairs = t_occurrence(sets, queries, index, labels) if index and queries else []
        return pa.table({"a": pa.array([names[i] for i, _ in pairs], pa.int64()), "b": pa.array([names[j] for _, j in pairs], pa.int64())})

    return members.select("task", "side", "cls", "label", "hashes").groupBy("task").applyInArrow(run, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("id").alias("cls"), F.col("component").alias("label"))
    return members.drop("label").join(found, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def class_links(survivors: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes that connect exactly what is connected."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    blocks = groups.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("members") / block))
    part = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    blocks = materialize(blocks.select("cls", "grp", "blocks"), "group-blocks")
    members = materialize(survivors.join(_bounded(blocks, blocks.count()), "cls").withColumn("label", F.col("cls")).select("cls", "grp", "blocks", "label", "hashes"), "members")
    inside = members.withColumn("task", F.xxhash64("grp", part)).withColumn("side", F.lit(2))
    links = materialize(_search(inside), "links-inside")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return links
    # blocks of a group hang together where their leaders do: try the leaders, level by level
    labels = materialize(_labelled(large.select("cls", "grp"), links), "labels")
    leaders = labels.filter("cls = label")
    for _ in range(8):
        crowded = materialize(leaders.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("grp"))).filter("many > 1"), "leaders")
        if crowded.isEmpty():
            break
        some = F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("many") / block))
        tried = large.select("cls", "hashes").join(crowded, "cls").withColumn("task", F.xxhash64("grp", some)).withColumn("side", F.lit(2))
        more = materialize(_search(tried), "links-leaders")
        if more.isEmpty():
            break
        links = links.unionAll(more)
        labels = materialize(_labelled(labels.select("cls", "grp"), links), "labels")
        leaders = labels.filter("cls = label")
    return links.unionAll(_across(large, labels, block))


def _across(large: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Search of every block against every other block of its group that holds another label.

    A label with many members has blocks of its own, which do not meet each
    other; the members of small labels share blocks, which meet all.
    """
    per_label = labels.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("own"))
    per_group = per_label.groupBy("grp").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("own") < block, F.col("own")).otherwise(0)).alias("loose"))
    spread = labels.join(per_label, ["grp", "label"]).join(per_group.filter("labels > 1"), "grp")
    single = F.col("own") >= block
    # a block is named by its home (a large label, or 0 for the shared ones) and a number
    home = F.when(single, F.col("label")).otherwise(F.lit(None).cast("long"))
    number = F.pmod(F.xxhash64("cls", F.lit(2)), F.greatest(F.lit(1), F.ceil(F.when(single, F.col("own")).otherwise(F.col("loose")) / block)))
    placed = materialize(spread.select("cls", "grp", "label", home.alias("home"), number.alias("number")), "blocks")
    names = placed.select("grp", "home", "number").distinct().withColumn("name", F.xxhash64("grp", "home", "number"))
    left, right = names.toDF("grp", "h1", "k1", "x"), names.toDF("grp", "h2", "k2", "y")
    meet = left.join(right, "grp").filter("x <= y and not (h1 is not null and h1 <=> h2)")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("name"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("name"), F.lit(0).alias("side")), F.struct(F.col("y").alias("name"), F.lit(1).alias("side")))
    )
    tasks = meet.withColumn("task", F.xxhash64("x", "y")).select("task", F.explode(sides).alias("s")).select("task", "s.name", "s.side")
    at = placed.withColumn("name", F.xxhash64("grp", "home", "number")).select("cls", "label", "name")
    return _search(large.select("cls", "hashes").join(at, "cls").join(tasks, "name"))


def join(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    A null, empty or blank text has an empty set and links to nothing: its
    component is its own id. Repeated rows and ids are handled row by row; rows
    with equal sets are in one component. A component is named by its smallest
    id; rows with a null id join components but never name one unless alone.
    Texts are read whole, however long. An empty table gives no rows.
    """
    return groups(docs, block).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``join`` with text_hash (of the row's text) and grp, which tells components apart even where ids repeat.

    An empty set has a null grp.
    """
    plain = docs.select("doc_id", "text")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        known = materialize(facts(plain), "shingle-facts")
    with_set = known.filter("cls is not null")
    survivors = _survivors(plain, with_set)
    links = class_links(survivors, materialize(_groups(survivors), "groups"), block)
    parts = components(links).select(F.col("id").alias("cls"), F.col("component").alias("part"))
    named = with_set.groupBy("cls").agg(F.min("doc_id").alias("first_id")).join(parts, "cls", "left")
    least = named.filter("part is not null").groupBy("part").agg(F.min("first_id").alias("least"))
    named = named.join(least, "part", "left").select("cls", F.coalesce("least", "first_id").alias("component_id"), F.coalesce("part", "cls").alias("grp"))
    joined = known.drop("first").join(named, "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "grp")
