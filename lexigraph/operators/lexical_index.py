"""A lexical index of impact-ordered posting blocks, searched with upper bounds.

The index is a folder: ``blocks`` (token, number, held, most, uuids, impacts), the
postings of each segment of a token in falling order of impact and cut into blocks
of ``held`` postings; ``tokens``
(token, df, most); ``facts``, the size and mean length of the index. The impact of
a posting is its part of the BM25 gain that no question changes, so a block's
largest impact bounds what any of its nodes can gain from the word.

A search reads the first blocks of each question's words and takes the k-th sum
found there as a threshold. Words that stay below it together, and blocks that
cannot lift a node to it even if the node stood first in the lists of all other
words, are left closed; open blocks give the candidates, and only those that
closed ones can still lift to the k-th sum of open blocks are looked up there. The result is that of scoring every posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexigraph.functions import text as T
from lexigraph.operators import phrases
from lexigraph.operators.ranking import RANK_DIGITS, top_k
from lexigraph.session import materialize

BLOCK = 128
SEGMENT = 1 << 18
LISTED = "token string, nodes long, words long, uuids array<string>, tfs array<int>, lengths array<int>"
BLOCKS = "token string, number long, most double, uuids array<string>, impacts array<double>"
TOKENS = "token string, df long, most double"
BLOCKS_AT_ONCE = 4096
WORDS = phrases.Rules((1,), 0, 1 << 30)  # every word, alone
FACTS = "size long, mean double, k1 double, b double"
SLACK = 10.0 ** (1 - RANK_DIGITS)  # scores are compared after rounding, and sums are not taken in one order


def _listed(tokens: DataFrame) -> DataFrame:
    """(token, nodes, words, uuids, tfs, lengths) from (uuid, tokens): the postings of each word in some neighbouring rows.

    ``words`` is the sum of ``tfs``; ``nodes`` counts the rows that have any word, once among the lists of these rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int32)
            for known, (found,) in phrases.count(batch.column("tokens"), WORDS):
                if not len(found.row):
                    continue
                order = np.argsort(found.words[0], kind="stable")
                row, word, tf = found.row[order], found.words[0][order], found.times[order]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(known)))]), pa.int32())
                nodes = np.zeros(len(known), dtype=np.int64)
                nodes[0] = len(np.unique(row))
                words = np.bincount(word, tf, len(known)).astype(np.int64)
                lists = [pa.ListArray.from_arrays(ends, x) for x in (batch.column("uuid").take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row]))]
                yield pa.RecordBatch.from_arrays([known, pa.array(nodes), pa.array(words), *lists], ["token", "nodes", "words", "uuids", "tfs", "lengths"])

    return tokens.mapInArrow(read, LISTED)


def _cut(batches: Iterator[pa.RecordBatch], block: int, mean: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Blocks (token, held, most, uuids, impacts) of lists that come by (token, segment), each segment in falling order of impact."""

    def cut(part: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = pc.list_value_length(part["uuids"]).to_numpy()
        of = np.repeat(group, many)
        tf, length = (pc.list_flatten(part[c]).to_numpy() for c in ("tfs", "lengths"))
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        order = np.lexsort((-impact, of))
        of, impact = of[order], impact[order]
        starts = np.flatnonzero((np.arange(len(of)) - np.searchsorted(of, of)) % block == 0)
        ends = np.append(starts, len(of))
        token = part["token"].take(pa.array(np.searchsorted(group, of[starts]))).combine_chunks()
        uuids = pc.list_flatten(part["uuids"]).take(pa.array(order)).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (uuids, pa.array(impact))]
        arrays = [token, pa.array(np.diff(ends)), pa.array(impact[starts]), *lists]
        yield from pa.Table.from_arrays(arrays, ["token", "held", "most", "uuids", "impacts"]).to_batches(max_chunksize=BLOCKS_AT_ONCE)

    waiting: list[pa.RecordBatch] = []  # lists of the segment that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([*waiting, batch])
        token, segment = part["token"].combine_chunks(), part["segment"].to_numpy()
        new = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (segment[1:] != segment[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield from cut(part.slice(0, whole), group[:whole])
        waiting = part.slice(whole).to_batches()
    if waiting:
        part = pa.Table.from_batches(waiting)
        yield from cut(part, np.zeros(len(part), dtype=np.int64))


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, nodes: DataFrame, text: Column, folder: str, key: str = "uuid", block: int = BLOCK, k1: float = 1.2, b: float = 0.75, segment: int = SEGMENT) -> LexicalIndex:
        """Index ``text`` of every node in a new folder.

        Tasks turn their nodes into short lists, one per word. A word's lists meet in
        segments of about ``segment`` postings at most, so a word that every node has is
        spread over tasks, and each segment is put in order and cut into blocks.
        """
        spark = nodes.sparkSession
        lists = materialize(_listed(nodes.select(F.col(key).alias("uuid"), T.tokenize(text).alias("tokens"))), "index-postings")
        facts = lists.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("size"), F.sum("words").alias("words")).first()
        size, mean = facts["size"], (facts["words"] or 0) / (facts["size"] or 1)
        spark.createDataFrame([(size, float(mean), k1, b)], FACTS).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/facts")
        dealt = lists.select("token", F.pmod(F.xxhash64(F.get("uuids", F.lit(0))), F.lit(max(1, -(-size // segment)))).alias("segment"), "uuids", "tfs", "lengths")
        laid = dealt.repartition("token", "segment").sortWithinPartitions("token", "segment")
        cuts = laid.mapInArrow(lambda batches: _cut(batches, block, mean or 1.0, k1, b), "token string, held long, most double, uuids array<string>, impacts array<double>")
        numbered = cuts.select("token", F.monotonically_increasing_id().alias("number"), "held", "most", "uuids", "impacts")
        numbered.write.mode("errorifexists").parquet(f"{folder}/blocks")
        index = cls(spark, folder)
        words = spark.read.schema("token string, held long, most double").parquet(f"{folder}/blocks").groupBy("token").agg(F.sum("held").alias("df"), F.max("most").alias("most"))
        words.write.mode("errorifexists").parquet(f"{folder}/tokens")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/blocks")

    def tokens(self) -> DataFrame:
        return self.spark.read.schema(TOKENS).parquet(f"{self.folder}/tokens")

    def facts(self):
        """Size, mean length and the two constants of the index."""
        return self.spark.read.schema(FACTS).parquet(f"{self.folder}/facts").first()

    def weighted(self, questions: DataFrame) -> DataFrame:
        """(query_id, token, idf, gain): the words of each question that the index has; gain is the most a node can get from one."""
        facts = self.facts()
        words = questions.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("token"))
        idf = F.log(1 + (F.lit(facts["size"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = words.join(self.tokens(), "token").select("query_id", "token", idf.alias("idf"), (idf * F.col("most")).alias("gain"))
        return materialize(found, "question-weights")

    def opened(self, questions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(open, shut, threshold): blocks of each question (query_id, token, number, idf) and what a node needs.

        A block is open when its best node could reach the threshold and its word is
        not one of those that stay below it together.
        """
        weights = self.weighted(questions)
        asked = materialize(weights.select("token").distinct(), "question-words")
        heads = self.blocks().select("token", "number", "most").join(asked, "token")
        heads = materialize(heads.join(weights, "token").select("query_id", "token", "number", "most", "idf", "gain"), "question-blocks")
        best = Window.partitionBy("query_id", "token").orderBy(F.desc("most"), "number")
        first = heads.withColumn("_at", F.row_number().over(best)).filter("_at = 1").select("query_id", "token", "number", "idf")
        seen = self._gains(first).groupBy("query_id", "uuid").agg(F.sum("gain").alias("score"))
        kth = top_k(seen, limit).filter(F.col("rank") == limit).select("query_id", F.col("score").alias("threshold"))
        threshold = materialize(weights.groupBy("query_id").agg(F.sum("gain").alias("all")).join(kth, "query_id", "left").select("query_id", "all", F.coalesce("threshold", F.lit(0.0)).alias("threshold")), "thresholds")
        # words that cannot reach the threshold together, however often a node has them, open no block
        upward = Window.partitionBy("query_id").orderBy("gain", "token")
        able = weights.withColumn("_upto", F.sum("gain").over(upward)).join(threshold, "query_id").filter(F.col("_upto") >= F.col("threshold") - SLACK)
        able = materialize(able.select("query_id", "token", "all", "threshold"), "question-able-words")
        reach = F.col("all") - F.col("gain") + F.col("idf") * F.col("most")
        judged = heads.join(able, ["query_id", "token"], "left").withColumn("open", F.coalesce(reach >= F.col("threshold") - SLACK, F.lit(False)))
        judged = materialize(judged.select("query_id", "token", "number", "idf", "most", "open"), "judged-blocks")
        return judged.filter("open"), judged.filter("not open"), threshold

    def _gains(self, wanted: DataFrame) -> DataFrame:
        """(query_id, token, uuid, gain) of the postings in the wanted blocks (query_id, token, number, idf)."""
        met = self.blocks().select("number", "uuids", "impacts").join(wanted, "number")
        pairs = met.select("query_id", "token", "idf", F.explode(F.arrays_zip("uuids", "impacts")).alias("x"))
        return pairs.select("query_id", "token", F.col("x.uuids").alias("uuid"), (F.col("idf") * F.col("x.impacts")).alias("gain"))

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        """(query_id, uuid, score, rank): the ``limit`` best nodes of each question (query_id, query) by BM25."""
        open_, shut, threshold = self.opened(questions, limit)
        partial = materialize(self._gains(open_).groupBy("query_id", "uuid").agg(F.sum("gain").alias("partial")), "partial-scores")
        # the k-th sum of open blocks is a threshold too, and mostly a higher one
        kth = top_k(partial, limit, score="partial").filter(F.col("rank") == limit).select("query_id", F.col("partial").alias("found"))
        # what closed blocks can still add, a word once
        rest = shut.groupBy("query_id", "token").agg(F.max(F.col("idf") * F.col("most")).alias("more")).groupBy("query_id").agg(F.sum("more").alias("more"))
        bound = threshold.join(rest, "query_id", "left").join(kth, "query_id", "left")
        bound = bound.select("query_id", F.greatest("threshold", "found").alias("threshold"), F.coalesce("more", F.lit(0.0)).alias("more"))
        able = partial.join(materialize(bound, "bounds"), "query_id").filter(F.col("partial") + F.col("more") >= F.col("threshold") - SLACK)
        able = materialize(able.select("query_id", "uuid", "partial", "more"), "candidates")
        # closed blocks are read once, however many questions share them, and keep the candidates' postings only
        asked = materialize(shut.select("query_id", "token", "number", "idf"), "closed-blocks")
        looked_for = able.filter("more > 0").select("query_id", "uuid").join(asked.select("query_id", "token", "idf").distinct(), "query_id")
        closed = self.blocks().join(asked.select("number").distinct(), "number").select("token", "number", F.explode(F.arrays_zip("uuids", "impacts")).alias("x"))
        closed = closed.select("token", "number", F.col("x.uuids").alias("uuid"), F.col("x.impacts").alias("impact"))
        late = closed.join(looked_for, ["token", "uuid"]).join(asked.select("query_id", "number"), ["query_id", "number"])
        late = late.select("query_id", "uuid", (F.col("idf") * F.col("impact")).alias("partial"))
        scored = able.select("query_id", "uuid", "partial").unionAll(late).groupBy("query_id", "uuid").agg(F.sum("partial").alias("score"))
        return top_k(scored, limit)
