"""A dictionary tagger: names of a table found in texts by their words.

gazetteer(name, type). A name stands where its words follow each other, whatever
separates them and in either case. Texts give the runs of words that are as long as
some name and begin like one, and meet the names by all their words. Where found
names overlap, a longer one wins over a shorter one, and of equally long ones the
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.functions import entities as E, text as T
from lexigraph.functions.arrays import let
from lexigraph.operators.sketch import SLOTS, sketch
from lexigraph.session import materialize

WORD = r"[\p{L}\p{N}]+"
NO_MENTIONS = f"cast(array() as array<{E.MENTION}>)"


def entries(gazetteer: DataFrame) -> DataFrame:
    """(first, words, n, type): one row per distinct sequence of words; of several types the first by name stands."""
    words = F.regexp_extract_all(F.lower("name"), F.lit(f"(?U){WORD}"), F.lit(0))
    rows = gazetteer.select(words.alias("words"), "type").where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.min("type").alias("type")).select(F.get("words", F.lit(0)).alias("first"), "words", F.size("words").alias("n"), "type")


def gazetteer_mentions(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, type, start, end): the names found in every text, overlaps settled.

    A sketch of the names' first words (16 MB at most) keeps all other words of a
    text where they are; what is left is cut to every length a name has, and a
    second sketch keeps the runs that are no name. The others meet the names by all
    their words, so a first word that many names share costs no more than another.
    Null texts and names hold nothing; a text of any length is split by places, not
    held whole.
    """
    spark = docs.sparkSession
    names = materialize(entries(gazetteer), "gazetteer")
    longest = names.agg(F.max("n")).first()[0] or 1
    slots = min(SLOTS, 1 << max(13, (8 * names.count()).bit_length()))
    first, whole = (sketch(names.select(F.xxhash64(c).alias("h")), slots) for c in ("first", "words"))
    lengths = sorted(r["n"] for r in names.select("n").distinct().collect())

    def begins(words: Column) -> Column:
        return F.transform(
            words,
            lambda w, i: F.struct(
                i.alias("at"), F.lower(w["text"]).alias("first"), F.transform(F.slice(words, i + 1, F.lit(longest)), lambda x: F.lower(x["text"])).alias("behind"),
                w["start"].alias("start"), F.transform(F.slice(words, i + 1, F.lit(longest)), lambda x: x["end"]).alias("ends"),
            ),
        )

    places = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.inline(let(T.spans(F.col(text), WORD), begins)))
    places = places.where(first.may_occur(F.xxhash64("first"), spark))
    around = F.substring(F.col("_text"), F.col("start") + 1, F.element_at("ends", -1) - F.col("start"))
    places = places.select("_key", "at", "behind", "start", "ends", around.alias("_text"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("behind"))
    runs = places.select("*", F.explode(fits).alias("n")).withColumn("words", F.slice("behind", F.lit(1), F.col("n")))
    runs = runs.where(whole.may_occur(F.xxhash64("words"), spark))
    stop = F.get("ends", F.col("n") - 1)
    shown = F.substring(F.col("_text"), F.lit(1), stop - F.col("start"))
    runs = runs.select("_key", "at", "n", "words", shown.alias("text"), "start", stop.alias("end"))
    found = runs.join(names.select("words", "type"), "words").drop("words")
    # a name stays where it is the longest at each of its words
    best = F.struct(F.col("n"), -F.col("at"))
    each = found.select("*", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word"))
    top = F.max(best).over(Window.partitionBy("_key", "word"))
    judged = each.withColumn("wins", best == top).groupBy("_key", "at", "n", "text", "type", "start", "end").agg(F.bool_and("wins").alias("stays"))
    return judged.where("stays").select(F.col("_key").alias(key), "text", "type", "start", "end")


def with_mentions(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text", extract: E.Extractor | None = E.pattern_mentions) -> DataFrame:
    """``docs`` plus ``mentions``: those of the dictionary by place, then those of ``extract`` that overlap none of them.

    An operator that takes an extractor takes them as ``lambda text: F.col("mentions")``.
    ``key`` names a text; rows that repeat a key should repeat its text.
    """
    found = gazetteer_mentions(docs.select(key, text).distinct(), gazetteer, key, text)
    mention = F.struct("text", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("type").alias("label"))
    lists = found.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", mention.alias("m"))).alias("_found"))
    named = F.coalesce(F.transform(F.array_sort("_found"), lambda x: x["m"]), F.expr(NO_MENTIONS))
    joined = docs.join(lists, docs[key].eqNullSafe(F.col("_key")), "left").withColumn("_named", named)
    mentions = F.col("_named")
    if extract is not None:
        clear = lambda m: ~F.exists("_named", lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]))
        mentions = F.concat("_named", F.coalesce(F.filter(extract(F.col(text)), clear), F.expr(NO_MENTIONS)))
    return joined.withColumn("mentions", mentions).select(*docs.columns, "mentions")
