"""Connected components of a table of links, without moving a component to one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.llm.common import materialize

FEW = 200_000  # links that one task settles; more are contracted round by round first


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of links in memory: roots are lowered to the least of both ends and jumped until nothing changes."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return ids, ids[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(v, to): every vertex of at most FEW links with the least vertex it hangs together with."""

    def run(table: pa.Table) -> pa.Table:
        ids, root = settled(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.table({"v": pa.array(ids, pa.int64()), "to": pa.array(root, pa.int64())})

    return edges.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, "v long, to long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (id, component), the smallest id reachable; only linked ids have rows.

    Every round each vertex moves to the neighbour with the least random
    priority, itself included. Only local minima stay, about a third of the
    vertices, whatever the shape of the graph; hubs are combined before the
    exchange. Once no more than FEW links are left, a size that does not grow
    with the data, one task settles them. Each round is written, so nothing is
    computed twice or lost with an executor.
    """
    edges = materialize(links.select("a", "b").filter("a <> b and a is not null and b is not null").distinct(), "links")
    places = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("at"))
    for number in range(most_rounds):
        left_over = edges.count()
        if not left_over:
            break
        moves = materialize(_in_one_task(edges) if left_over <= FEW else _moves(edges, number), "moves")
        places = materialize(
            places.join(moves, F.col("at") == F.col("v"), "left").select("id", F.coalesce("to", "at").alias("at")), "places"
        )
        if left_over <= FEW:
            break
        left, right = moves.toDF("a", "a_to"), moves.toDF("b", "b_to")
        edges = materialize(
            edges.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct(), "links"
        )
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    least = places.groupBy("at").agg(F.min("id").alias("component"))
    return places.join(least, "at").select("id", "component")


def _moves(edges: DataFrame, number: int) -> DataFrame:
    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(number), F.col(c)).alias("p"), F.col(c).alias("v"))

    both = edges.select("a", "b").union(edges.select("b", "a"))
    best = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("other"))
    return best.select("v", F.least("other", rank("v"))["v"].alias("to"))
