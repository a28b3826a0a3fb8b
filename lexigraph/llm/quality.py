"""Quality rules with risk-controlled thresholds.

A rule compares a measure of a text with a cutoff and rejects above it (or
below it). Cutoffs come from labelled documents: per stratum and rule the
candidates are tried from the mildest on, and each must pass an exact binomial
test that it rejects less than ``alpha / rules`` of the good documents. The
tests of one rule stop at its first failure (a fixed sequence, so the order
costs nothing), and ``delta`` is divided among all strata and rules
(Bonferroni). With probability 1 - delta, then, no stratum loses more than
``alpha`` of its good documents to the learnt rules.

The exact test is the tail of a binomial law, P(Bin(n, a) <= k) <= d, which is
the same as the Clopper-Pearson upper bound of k in n at level d being below a.

All of it is column expressions: measures are row-local, counts are one
aggregate over the labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.llm.common import BLANKS, let, materialize, words

SYMBOLS = "#*$%&|<>"
POSITION_BITS = 20


@dataclass(frozen=True)
class Rule:
    """Reject where the measure is above the cutoff; cutoffs go from mild to strict."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2)),
    Rule("shouting", "n_marks / greatest(n_words, 1)", (2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3)),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0)),
    Rule("short_words", "2 - word_chars / greatest(n_words, 1)", (0.8, 0.6, 0.4, 0.2, 0.0)),
)


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are hashed, and the position takes the low bits of the hash, so one
    sort of plain numbers brings equal windows together. Neighbours that agree
    in the high bits are compared word by word. Texts too long for the position
    bits, or with two different windows under one hash, go the slower exact way.
    """
    n = F.size(w)
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def same(p: Column, q: Column) -> Column:
        return (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def by_hash(keys: Column, slow: Column) -> Column:
        high = lambda x: F.shiftright(x, POSITION_BITS)
        twins = F.filter(
            keys,
            lambda x, i: F.coalesce(high(x) == high(F.get(keys, i + 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(keys, i - 1)), F.lit(False)),
        )
        return let(
            twins,
            lambda t: F.when(F.size(t) == 0, F.lit(0))
            .when(
                F.exists(F.sequence(F.lit(1), F.size(t) - 1), lambda i: (high(F.get(t, i)) == high(F.get(t, i - 1))) & ~same(place(F.get(t, i)), place(F.get(t, i - 1)))),
                slow,
            )
            .otherwise(let(F.sort_array(F.transform(t, place)), covered)),
        )

    starts = F.sequence(F.lit(0), n - 3)
    windows = F.transform(starts, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
    exact = let(
        F.sort_array(windows),
        lambda s: let(
            F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(same(x["i"], F.get(s, i + 1)["i"]), F.lit(False)) | F.coalesce(same(x["i"], F.get(s, i - 1)["i"]), F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
            covered,
        ),
    )
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-(1 << POSITION_BITS)).cast("long")))
    keyed = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseOR(i.cast("long")))), lambda k: by_hash(k, exact))
        ),
    )
    return F.when(n < 3, F.lit(0)).when(n > (1 << POSITION_BITS), exact).otherwise(keyed)


def measures(text: Column) -> dict[str, Column]:
    """Row-local counts of a text, all long; a null or empty text has zeros."""
    t = F.coalesce(text, F.lit(""))
    w = words(text)
    with_word = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(w, lambda x: F.struct(F.size(x).alias("n"), _repeated(x).alias("r")))
    lines = let(with_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return {
        "_words": facts,
        "_lines": lines,
        "word_chars": F.length(F.regexp_replace(t, BLANKS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_marks": F.length(t) - F.length(F.translate(t, "!?", "")),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, the base measures and ``base_failed``: one row per row of ``docs``."""
    m = measures(F.col("text"))
    base = docs.select("doc_id", F.col("stratum"), *[c.alias(n) for n, c in m.items()])
    counted = base.select(
        "doc_id",
        "stratum",
        F.col("_words.n").cast("long").alias("n_words"),
        *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_marks", "n_upper")],
        F.col("_lines.n").cast("long").alias("n_lines"),
        F.col("_lines.d").cast("long").alias("n_dup_lines"),
        F.col("_words.r").cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms from the first term on; 1 where k is at the mean or above it."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i) + F.lit(odds)
        top = F.greatest(state["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(state["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda s: s["total"])))


def thresholds(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, tried, rejected, good, p_value): the strictest cutoff that each rule may use.

    ``labelled`` has measures, stratum and quality (1: good). Rules without a
    safe cutoff in a stratum (too few labels, say) have no row there. Only good
    documents that pass the base rules count, as only those can still be lost.
    """
    good = labelled.filter((F.col("quality") == 1) & ~F.col("base_failed"))
    sums = [F.sum(F.when(F.expr(r.measure) > c, 1).otherwise(0)).alias(f"{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *sums)
    tries = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("tried"), F.lit(c).alias("cutoff"), F.col(f"{r.name}_{i}").alias("rejected"))
            for r in rules
            for i, c in enumerate(r.cutoffs)
        ]
    )
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rows = counts.withColumn("_strata", strata).select("stratum", "good", "_strata", F.explode(tries).alias("t")).select("stratum", "good", "_strata", "t.*")
    tested = rows.withColumn("p_value", binomial_tail(F.col("rejected"), F.col("good"), alpha / len(rules)))
    passed = F.col("p_value") <= F.lit(delta) / (F.col("_strata") * len(rules))
    so_far = Window.partitionBy("stratum", "rule").orderBy("tried")
    last = Window.partitionBy("stratum", "rule").orderBy(F.col("tried").desc())
    return (
        tested.withColumn("_holds", F.min(passed.cast("int")).over(so_far) == 1)
        .filter("_holds")
        .withColumn("_rank", F.row_number().over(last))
        .filter("_rank = 1")
        .select("stratum", "rule", "cutoff", "tried", "rejected", "good", "p_value")
    )


def apply(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, alpha: float = 0.05, delta: float = 0.05
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, failed (names of learnt rules) and kept.

    ``docs`` needs doc_id, text and the stratum column (null is a stratum);
    ``labels`` needs doc_id and quality, null qualities count for nothing, and
    of several labels of an id the worst counts. Null and empty texts fail the
    base rules. Other columns of either table are ignored. Without labels only
    the base rules decide; an empty table gives no rows.
    """
    facts = materialize(measured(docs.select("doc_id", "text", F.col(stratum).alias("stratum"))), "measures")
    known = labels.select("doc_id", "quality").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = thresholds(facts.join(known, "doc_id"), rules, alpha, delta)
    chosen = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    failed = F.filter(
        F.array(*[F.when(F.expr(r.measure) > F.element_at("_cutoffs", F.lit(r.name)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return (
        facts.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .drop("_stratum", "_cutoffs")
    )
