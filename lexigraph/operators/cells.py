"""A persisted cell index for vector search.

Coarse centroids cut the space of directions into cells. The index is a folder:
``centroids`` (cell, centroid) and ``cells``, the vectors laid out by cell. A
question visits the cells of its nearest centroids only; with all of them the
answer is that of the exact scan. Which cells are read is a partition filter, so
the others are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigraph.operators.ranking import SHARED_BYTES, _best, _trim, _unit_rows, top_k

SAMPLE_ROWS = 20_000  # centroids are fitted on so many vectors at most, those with the least hash of their id
ROWS_PER_CELL = 1000
MOST_CELLS = 2048  # also a bound on what is broadcast: centroids, and the list of cells to read
FILE_ROWS = 100_000
PROBES = 8
RESULT = "query_id long, uuid string, score double"


def fit(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors: k-means by cosine; an empty cell moves to the vector that its own centroid serves worst."""
    draw = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centroids = sample[draw.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        near, served = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(served, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine) of the nearest centroid of each vector."""
    cell, served = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors))
    for at in range(0, len(vectors), block):
        scores = vectors[at : at + block] @ centroids.T
        cell[at : at + block] = scores.argmax(axis=1)
        served[at : at + block] = scores.max(axis=1)
    return cell, served


class CellIndex:
    """The index in ``folder``; ``centroids`` are unit rows, one per cell."""

    def __init__(self, spark: SparkSession, folder: str, centroids: np.ndarray):
        self.spark, self.folder, self.centroids = spark, folder.rstrip("/"), centroids

    @classmethod
    def build(cls, nodes: DataFrame, folder: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> CellIndex:
        """Index ``nodes`` (uuid, embedding) in a new folder; nodes without a vector are left out.

        Every vector is assigned to a cell. Only the centroids come from a
        sample, drawn from all rows by the hash of their id.
        """
        spark = nodes.sparkSession
        held = nodes.select("uuid", "embedding").where(F.col("embedding").isNotNull())
        count = held.count()
        drawn = held.orderBy(F.xxhash64("uuid"), "uuid").limit(sample_rows).toArrow()
        sample = _unit_rows(drawn["embedding"]) if len(drawn) else np.zeros((0, 1))
        wanted = cells or min(MOST_CELLS, max(1, round(count / ROWS_PER_CELL)))
        centroids = fit(sample, min(wanted, MOST_CELLS)) if len(sample) else np.zeros((1, 1))
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/centroids")
        index = cls(spark, folder, centroids)
        index.add(held)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CellIndex:
        rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{folder}/centroids").orderBy("cell").collect()
        return cls(spark, folder, np.array([r["centroid"] for r in rows]))

    def add(self, nodes: DataFrame) -> None:
        """Append vectors to the cells of the centroids that stand. A cell with many rows is written by several tasks."""
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = nearest(_unit_rows(batch.column("embedding")), shared.value)[0] if batch.num_rows else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["uuid", "embedding", "cell"])

        held = nodes.select("uuid", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())
        placed = held.mapInArrow(assign, "uuid string, embedding array<double>, cell int")
        share = F.pmod(F.xxhash64("uuid"), F.lit(max(1, -(-held.count() // FILE_ROWS))))
        dealt = placed.withColumn("_share", share).repartition("cell", "_share").drop("_share")
        dealt.write.mode("append").partitionBy("cell").parquet(f"{self.folder}/cells")

    def read(self, cells: list[int] | None = None) -> DataFrame:
        """(uuid, embedding, cell), of the given cells only."""
        rows = self.spark.read.schema("uuid string, embedding array<double>, cell int").parquet(f"{self.folder}/cells")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def probes(self, questions: DataFrame, n: int) -> DataFrame:
        """(query_id, vector, cell): each question with each of its ``n`` nearest cells."""
        shared = self.spark.sparkContext.broadcast(self.centroids)
        n = min(n, len(self.centroids))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = _unit_rows(batch.column("vector")) @ shared.value.T
                cells = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                take = pa.array(np.repeat(np.arange(len(cells)), n))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cells.ravel(), pa.int32())], ["query_id", "vector", "cell"])

        asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
        return asked.mapInArrow(choose, "query_id long, vector array<double>, cell int")

    def search(self, questions: DataFrame, k: int, probes: int = PROBES, shared_bytes: int = SHARED_BYTES) -> DataFrame:
        """(query_id, uuid, score, rank): the k nearest of each question (query_id, vector) in the cells it visits.

        Questions of up to ``shared_bytes`` go to the vectors where they lie.
        More are dealt by cell and meet slices of each cell, with the same result.
        """
        asked = self.probes(questions, probes)
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim"), F.sort_array(F.collect_set("cell")).alias("cells")).first()
        if not size["n"]:
            return self.spark.createDataFrame([], RESULT + ", rank int")
        rows = self.read(size["cells"])
        if size["n"] * 8 * size["dim"] <= shared_bytes:
            return top_k(self._visit(asked, rows, k), k)
        most = max(1, shared_bytes // (8 * size["dim"]))
        counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("slices"))
        blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
        plan = F.broadcast(counts.join(blocks, "cell"))  # a row a cell, MOST_CELLS at most
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", spread("slices"))
        right = rows.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("uuid"), "slices").cast("int")).withColumn("block", spread("blocks"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if len(a) == 0 or len(b) == 0:
                return pa.table({"query_id": pa.array([], pa.int64()), "uuid": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
            return _trim(_best(a["query_id"].to_numpy(), _unit_rows(a["vector"]), b, k), k)

        keys = ["cell", "block", "part"]
        met = left.select("query_id", "vector", *keys).groupBy(*keys).cogroup(right.select("uuid", "embedding", *keys).groupBy(*keys))
        return top_k(met.applyInArrow(meet, RESULT), k)

    def _visit(self, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        local = asked.toArrow()
        cells = local["cell"].to_numpy()
        by_cell = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
        shared = self.spark.sparkContext.broadcast((local["query_id"].to_numpy(), _unit_rows(local["vector"]), by_cell))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, visitors = shared.value
            kept: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table, of = pa.Table.from_batches([batch]), batch.column("cell").to_numpy()
                for cell in np.unique(of):
                    mine = visitors[int(cell)]
                    fresh = _best(ids[mine], matrix[mine], table.filter(pa.array(of == cell)), k)
                    kept = _trim(fresh if kept is None else pa.concat_tables([kept, fresh]), k)
            if kept is not None:
                yield from kept.to_batches()

        return rows.select("uuid", "embedding", "cell").mapInArrow(scan, RESULT)
