"""The cell index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import ranking as R
from lexigraph.operators.cells import CellIndex, fit, nearest


@pytest.fixture(scope="module")
def vectors(spark_module):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 24))
    rows = centres[draw.integers(0, 40, 6000)] + 0.6 * draw.normal(size=(6000, 24))
    data = [(f"n{i}", v.tolist()) for i, v in enumerate(rows)] + [("zero", [0.0] * 24), ("none", None)]
    return spark_module.createDataFrame(data, "uuid string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def spark_module():
    from lexigraph.session import local_session

    return local_session("8", 8)


@pytest.fixture(scope="module")
def index(spark_module, vectors, tmp_path_factory):
    return CellIndex.build(vectors, str(tmp_path_factory.mktemp("cells") / "index"), cells=50)


def questions(vectors, n=60):
    rows = vectors.where("uuid like 'n%' and embedding is not null").orderBy(F.xxhash64("uuid", F.lit(5))).limit(n)
    return rows.select(F.substring("uuid", 2, 9).cast("long").alias("query_id"), F.transform("embedding", lambda x: x * 1.5 + 0.1).alias("vector"))


def rows(df):
    return sorted(((r["query_id"], r["rank"], r["uuid"], r["score"]) for r in df.collect()))


def test_all_cells_give_the_exact_scan(spark, vectors, index):
    asked = questions(vectors)
    want = rows(R.vector_top_k(asked, vectors, 10))
    assert rows(index.search(asked, 10, probes=50)) == want
    assert rows(index.search(asked, 10, probes=50, shared_bytes=8 * 24 * 20)) == want  # dealt by cell, slices and blocks
    again = CellIndex.open(spark, index.folder)
    assert rows(again.search(asked, 10, probes=10**6)) == want


def test_recall_at_the_default(vectors, index):
    asked = questions(vectors)
    exact = {(q, u) for q, _, u, _ in rows(R.vector_top_k(asked, vectors, 10))}
    found = {(q, u) for q, _, u, _ in rows(index.search(asked, 10))}
    assert len(exact & found) >= 0.9 * len(exact)
    few = {(q, u) for q, _, u, _ in rows(index.search(asked, 10, probes=1))}
    assert len(exact & few) < len(exact & found) <= len(exact)
    assert rows(index.search(asked, 10)) == rows(index.search(asked, 10, shared_bytes=8 * 24 * 20))


def test_only_visited_cells_are_read(vectors, index):
    asked = questions(vectors, 1)
    plan = index.search(asked, 3, probes=2)._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "cell" in line]
    assert filters and "cell#" in filters[0] and " IN (" in filters[0]
    cells = {r["cell"] for r in index.probes(asked, 2).collect()}
    read = index.read(sorted(cells))
    pruned = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in pruned and f"IN ({min(cells)},{max(cells)})" in pruned and "PushedFilters: []" in pruned
    assert {r["cell"] for r in read.select("cell").distinct().collect()} == cells and read.count() < index.read().count() / 4


def test_vectors_are_added_to_the_cells_that_stand(spark, vectors, tmp_path):
    first, rest = vectors.where(F.xxhash64("uuid") % 3 == 0), vectors.where(F.xxhash64("uuid") % 3 != 0)
    index = CellIndex.build(first, str(tmp_path / "index"), cells=10)
    index.add(rest)
    asked = questions(vectors, 10)
    assert rows(index.search(asked, 5, probes=10)) == rows(R.vector_top_k(asked, vectors, 5))


def test_empty_and_equal_vectors(spark, tmp_path):
    schema = "uuid string, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    empty = CellIndex.build(spark.createDataFrame([], schema), str(tmp_path / "empty"))
    assert empty.search(asked.where("query_id = 2"), 3).count() == 0
    same = spark.createDataFrame([(f"u{i}", [2.0, 0.0]) for i in range(50)], schema)
    index = CellIndex.build(same, str(tmp_path / "same"), cells=4)
    assert [r[2] for r in rows(index.search(asked, 3, probes=4))] == ["u0", "u1", "u10"]


def test_centroids_serve_every_cell():
    draw = np.random.default_rng(1)
    sample = draw.normal(size=(500, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = fit(sample, 20)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert (np.bincount(nearest(sample, centroids)[0], minlength=20) > 0).sum() >= 18
