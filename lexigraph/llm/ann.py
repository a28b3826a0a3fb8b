"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt by hash into shards of bounded size. Each shard builds a graph
by insertion: a greedy search from the entry point proposes neighbours for a
point, relaxed distance pruning keeps those that no kept one is much closer to
(``alpha`` above 1 keeps some longer edges), and the edges are also put in the
other direction, pruned again where a point has too many. A query runs a beam
search in every shard; scores are computed anew in double precision on the
vectors as given.

Equal vectors are one point of a graph with the smallest of their ids, as many
as an answer can show, so a vector that occurs very often costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexigraph.llm.common import materialize

DEGREE = 32
BUILD_BEAM = 64
SHARD = 4000
QUERY_BLOCK = 512


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` best found per query, nearest first; -1 where fewer were reached.

    ``points`` are unit vectors, ``graph`` holds neighbours padded with -1. All
    queries take a step together: each expands its nearest open candidate.
    """
    rows = np.arange(len(queries))
    ids = np.full((len(queries), beam), -1, dtype=np.int64)
    far = np.full((len(queries), beam), np.inf, dtype=np.float32)
    done = np.ones((len(queries), beam), dtype=bool)
    seen = np.zeros((len(queries), len(points) + 1), dtype=bool)
    seen[:, -1] = True  # where padding points
    ids[:, 0], far[:, 0], done[:, 0] = entry, 1 - queries @ points[entry], False
    seen[:, entry] = True
    active = rows
    while len(active):
        pick = np.where(done[active], np.inf, far[active]).argmin(axis=1)
        done[active, pick] = True
        near = graph[ids[active, pick]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        distance = 1 - np.einsum("bd,brd->br", queries[active], points[near])
        distance[~fresh] = np.inf
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_far = np.concatenate([far[active], distance], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(active))[:, None]
        ids[active], far[active], done[active] = all_ids[at, order], all_far[at, order], all_done[at, order]
        active = active[~done[active].all(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, point: int, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Of ``pool`` the nearest, then the nearest that no kept one is ``alpha`` times closer to, and so on."""
    pool = np.unique(pool)
    pool = pool[(pool >= 0) & (pool != point)]
    far = 1 - points[pool] @ points[point]
    order = np.argsort(far, kind="stable")
    pool, far = pool[order], far[order]
    between = 1 - points[pool] @ points[pool].T
    alive = np.ones(len(pool), dtype=bool)
    kept: list[int] = []
    for i in range(len(pool)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > far
    return pool[kept]


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = 1.2, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph padded with -1, entry point) over unit vectors; points go in by batches that double."""
    n = len(points)
    # room for some edges more, so that a popular point is pruned now and then and not each time
    room = degree + degree // 2
    graph = np.full((n, room), -1, dtype=np.int64)
    size = np.zeros(n, dtype=np.int64)
    middle = points.mean(axis=0)
    entry = int((points @ middle).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, batch = 1, 1
    while at < n:
        new = order[at : at + batch]
        found, _ = beam_search(points, graph, entry, points[new], beam)
        for point, pool in zip(new, found):
            kept = robust_prune(points, point, pool, alpha, degree)
            graph[point, : len(kept)], size[point] = kept, len(kept)
        for point in new:
            for other in graph[point, : size[point]]:
                if point in graph[other, : size[other]]:
                    continue
                if size[other] == room:
                    kept = robust_prune(points, other, np.append(graph[other], point), alpha, degree)
                    graph[other] = -1
                    graph[other, : len(kept)], size[other] = kept, len(kept)
                else:
                    graph[other, size[other]] = point
                    size[other] += 1
        at += len(new)
        batch = min(2 * batch, 256)
    return graph, entry


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles): without nulls, null or non-finite components and zero vectors; repeated rows once."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.filter(F.coalesce(fine, F.lit(False))).distinct()


def index(rows: DataFrame, k: int = 5, shard_size: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[DataFrame, int]:
    """(shard, dim, n, points, graph, entry, members) with a row per shard, and the number of shards.

    members are the k + 1 smallest ids of each point: no answer of k can show more.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k + 1)
    points = materialize(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "points")
    shards = max(1, -(-points.count() // shard_size))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort([m[0] for m in table.column("members").to_pylist()], kind="stable")))
        raw = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        unit = (raw / np.abs(raw).max(axis=1, keepdims=True)).astype(np.float64)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        graph, entry = build(unit, degree, beam)
        one = {
            "shard": [table.column("shard")[0].as_py()],
            "dim": [raw.shape[1]],
            "points": [raw.tobytes()],
            "graph": [graph.astype(np.int32).tobytes()],
            "entry": [entry],
            "members": [table.column("members").to_pylist()],
        }
        return pa.table(one, schema=pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("points", pa.binary()), ("graph", pa.binary()), ("entry", pa.int32()), ("members", pa.list_(pa.list_(pa.int64())))]))

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn("dim", F.size("vector"))
    built = dealt.groupBy("shard", "dim").applyInArrow(run, "shard long, dim int, points binary, graph binary, entry int, members array<array<long>>")
    return materialize(built, "graphs"), shards


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 96, shard_size: int = SHARD, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that the search finds for each query among all other rows.

    Both tables have vec_id and the vector column; other columns are ignored.
    Rows without a usable vector take no part, a vector meets those of its own
    length only, and equal scores go to the smaller id. An empty table gives no rows.
    """
    rows = usable(vectors, column)
    graphs, shards = index(rows, k, shard_size)
    asked = materialize(usable(queries, column), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("block", F.size("vector").alias("dim"))
        .agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("query_vectors"))
    )
    visits = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    columns = ["query_ids", "query_vectors", "dim", "points", "graph", "entry", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in columns}
                dim = one["dim"].as_py()
                names = np.asarray(one["query_ids"].values)
                asked = np.asarray(one["query_vectors"].values).reshape(len(names), dim)
                raw = np.frombuffer(one["points"].as_buffer(), dtype=np.float64).reshape(-1, dim)
                graph = np.frombuffer(one["graph"].as_buffer(), dtype=np.int32).reshape(len(raw), -1)
                yield _answer(names, asked, raw, graph, one["entry"].as_py(), one["members"].as_py(), k, beam)

    # a few queries look small until they are there once per shard: Spark would collect all of that to broadcast it
    found = visits.hint("merge").join(graphs, ["shard", "dim"]).select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answer(names, asked, raw, graph, entry, members, k, beam) -> pa.RecordBatch:
    def unit(x: np.ndarray) -> np.ndarray:
        scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)

    points, queries = unit(raw), unit(asked)
    found, _ = beam_search(points.astype(np.float32), graph.astype(np.int64), entry, queries.astype(np.float32), beam)
    out: list[tuple[int, int, float]] = []
    for name, query, ids in zip(names.tolist(), queries, found):
        ids = ids[ids >= 0]
        scores = points[ids] @ query
        rows = [(-s, m, name) for i, s in zip(ids.tolist(), scores.tolist()) for m in members[i] if m != name]
        rows.sort()
        out += [(n, m, -s) for s, m, n in rows[:k]]
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
        ["query_id", "vec_id", "score"],
    )
