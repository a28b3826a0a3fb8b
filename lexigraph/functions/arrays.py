"""Row-local array helpers.

A document is one row, so anything that depends on one document alone is
computed inside that row: no explode, no shuffle, no state to lose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(items: Column, first: Column, last: Column) -> Column:
    """Elements first..last (1-based, first <= last).

    Inside a lambda ``slice`` copies the whole array on every call; reading by
    position keeps a pass over all parts linear.
    """
    return F.transform(F.sequence(first, last), lambda i: F.element_at(items, i))


def _run_starts(ordered: Column, item: Callable[[Column], Column]) -> Column:
    """1-based positions at which a new item begins in a sorted array."""
    return F.filter(
        F.sequence(F.lit(1), F.size(ordered)),
        lambda i: (i == 1)
        | (item(F.element_at(ordered, i)) != item(F.element_at(ordered, F.greatest(i - 1, F.lit(1))))),
    )


def tally(items: Column) -> Column:
    """array<string> -> array<struct<item, n>>, one entry per distinct item."""

    def runs(ordered: Column) -> Column:
        length = F.size(ordered)
        return let(
            _run_starts(ordered, lambda x: x),
            lambda starts: F.transform(
                starts,
                lambda p, j: F.struct(
                    F.element_at(ordered, p).alias("item"),
                    (F.coalesce(F.get(starts, j + 1), length + 1) - p).alias("n"),
                ),
            ),
        )

    empty = F.expr("cast(array() as array<struct<item:string,n:int>>)")
    return let(F.sort_array(items), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(empty))


def sum_by_item(entries: Column, fields: list[str]) -> Column:
    """array<struct<item, f1, f2, ...>> -> the same, with the fields summed per item."""

    def runs(ordered: Column) -> Column:
        length = F.size(ordered)

        def total(starts: Column, p: Column, j: Column, field: str) -> Column:
            stop = F.coalesce(F.get(starts, j + 1), length + 1)
            return F.aggregate(
                F.sequence(p, stop - 1),
                F.lit(0.0),
                lambda acc, i: acc + F.element_at(ordered, i)[field].cast("double"),
            ).alias(field)

        return let(
            _run_starts(ordered, lambda x: x["item"]),
            lambda starts: F.transform(
                starts,
                lambda p, j: F.struct(
                    F.element_at(ordered, p)["item"].alias("item"),
                    *[total(starts, p, j, field) for field in fields],
                ),
            ),
        )

    schema = ",".join(["item:string"] + [f"{field}:double" for field in fields])
    empty = F.expr(f"cast(array() as array<struct<{schema}>>)")
    return let(F.sort_array(entries), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(empty))


def merge_mentions(entries: Column) -> Column:
    """Group array<struct<item, ord, text, type, weight, sentence_index, ...>> by item.

    One entry per item: the first ``text`` and ``type`` by ``ord``, the summed
    ``weight``, the sorted sentence indices and the grouped entries themselves.
    """

    def runs(ordered: Column) -> Column:
        length = F.size(ordered)

        def entry(members: Column) -> Column:
            first = F.element_at(members, 1)
            return F.struct(
                first["item"].alias("item"),
                first["ord"].alias("ord"),
                first["text"].alias("text"),
                first["type"].alias("type"),
                F.aggregate(members, F.lit(0.0), lambda acc, x: acc + x["weight"]).alias("weight"),
                F.sort_array(F.array_distinct(F.transform(members, lambda x: x["sentence_index"]))).alias("sentence_indices"),
                members.alias("members"),
            )

        return let(
            _run_starts(ordered, lambda x: x["item"]),
            lambda starts: F.transform(
                starts,
                lambda p, j: let(part(ordered, p, F.coalesce(F.get(starts, j + 1), length + 1) - 1), entry),
            ),
        )

    return let(F.sort_array(entries), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)))


def running_total(lengths: Column) -> Column:
    """Inclusive prefix sums of array<int>, in blocks so that long arrays stay cheap."""

    def total(values: Column, first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(0), lambda acc, i: acc + F.get(values, i))

    def blocked(values: Column, width: Column) -> Column:
        size = F.size(values)
        sums = F.transform(
            F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")),
            lambda b: total(values, b * width, F.least((b + 1) * width, size) - 1),
        )
        before = let(
            sums,
            lambda block: F.transform(
                block, lambda _, b: F.when(b > 0, total(block, F.lit(0), b - 1)).otherwise(F.lit(0))
            ),
        )
        return let(
            before,
            lambda offset: F.transform(
                values, lambda _, i: F.get(offset, F.floor(i / width).cast("int")) + total(values, i - i % width, i)
            ),
        )

    return let(
        lengths,
        lambda values: F.when(
            F.size(values).between(1, 8), F.transform(values, lambda _, i: total(values, F.lit(0), i))
        ).when(
            F.size(values) > 0,
            let(F.ceil(F.sqrt(F.size(values))).cast("int"), lambda width: blocked(values, width)),
        ).otherwise(F.expr("cast(array() as array<int>)")),
    )
