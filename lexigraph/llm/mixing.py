"""Mix sources to target weights by systematic sampling.

Every source has a target number of words. Within a source each document is
expected ``target / source_size`` times; the expectations are summed along the
documents, one random offset per source is added, and a document is emitted
once for each integer its interval crosses.

Order of the sum: by size, every second document from the front and the others
from the back. Neighbours then have similar sizes, and what the offset takes
from the rising half it gives back on the falling one, so the words taken stay
close to the target for any offset.

The order is laid out by a range exchange on (source, size, id), so a source
that holds most rows is spread over many tasks; ranks come from row numbers
inside the ranges plus one offset per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.llm.common import materialize, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Water filling: (source, source_size, n) -> the same with weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn. Together
    they get ``share`` of all words; a source gets ``most`` times its own size at
    most, and what it leaves is shared by weight among the others.
    """
    everything = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(w) for w in weights])
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    filling = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    level = (
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        / F.sum("weight").over(onward)
    )
    return (
        sizes.withColumn("_at", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("_at") % len(weights) + 1).cast("int")))
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_level", F.max("_fits").over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("_level") * F.col("weight"), cap.cast("double")), cap.cast("double")))
        .withColumn("_from", F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("source", "source_size", "n", "weight", "target", "_from")
    )


RESULTS = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies).

    ``docs`` needs doc_id, text and source; other columns pass through, those
    named like a result are replaced, and ``keep`` names those to carry (all).
    Options: weights, share, most (see ``targets``), seed, offsets, size (a
    column in place of the number of words).

    A null text has size 0, a null source is a source of its own, repeated rows
    count as rows. An empty table gives no rows. A source's random offset is the
    one of ``offsets`` draws that comes nearest to its target; draws depend on
    ``seed`` and the name, so reruns agree.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    mixed = _mixed(docs, carried, **options)
    return mixed.select(*[F.col("_row")[c].alias(c) for c in carried], *RESULTS)


def resample(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; its columns are unchanged, whatever they are called."""
    taken = _mixed(docs, docs.columns, **options).filter(F.col("copies") > 0)
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _mixed(
    docs: DataFrame,
    carried: list[str],
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    offsets: int = 32,
    size: Column | None = None,
) -> DataFrame:
    """The carried columns as one struct ``_row``, with the results beside it."""
    words = word_count(F.col("text")) if size is None else size
    sized = docs.select(F.struct(*carried).alias("_row"), "doc_id", "source", words.alias("size"))
    per_source = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most
    )
    per_source = materialize(per_source, "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    placed = materialize(
        sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        "mix-order",
    )
    ranges = placed.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark knows how small they are: the texts then stay where they are in both joins
    ranges = materialize(ranges.select("_range", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_before")), "mix-ranges")
    facts = per_source.withColumnRenamed("source", "_source")
    joined = (
        placed.withColumn("_range", F.shiftright("_place", 33))
        .join(ranges, "_range")
        .join(facts, F.col("source").eqNullSafe(F.col("_source")))
    )
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("_from")
    half = F.shiftright("_rank", 1)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    along = (
        joined.withColumn("_rank", rank)
        .withColumn("_at", F.when(F.col("_rank") % 2 == 0, half).otherwise(F.col("n") - 1 - half))
        .withColumn("_each", each)
    )
    draws = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("source")), F.lit(1 << 20)) / F.lit(float(1 << 20)) for k in range(offsets)]
    tried = along.groupBy("source", "target").agg(*[F.sum(_crossed(u) * F.col("size")).alias(f"_{k}") for k, u in enumerate(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")), F.lit(k), u.alias("u")) for k, u in enumerate(draws)]))
    chosen = materialize(tried.select(F.col("source").alias("_named"), best["u"].alias("_offset")), "mix-offsets")
    return (
        along.join(chosen, F.col("source").eqNullSafe(F.col("_named")))
        .withColumn("copies", _crossed(F.col("_offset")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_row", *RESULTS)
    )


def _crossed(offset: Column) -> Column:
    """Integers between the running sum before a document and after it."""
    return F.floor(F.col("_each") * (F.col("_at") + 1) + offset) - F.floor(F.col("_each") * F.col("_at") + offset)
