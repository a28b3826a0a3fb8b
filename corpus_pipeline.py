"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of its docs. All
but the last return the columns of docs; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigraph.llm import jaccard, mixing, packing, secrets, toxicity
from lexigraph.llm.common import free_name, materialize
from lexigraph.session import temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the scorer learns from the labelled ones that are not held out.

    Null and empty texts are scored like others and stay; repeated rows share a
    score. An empty table gives an empty table.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the row with the smallest id, of rows with one id the one whose text has the least hash.

    A row without an id stays only where its group has no other. Null, empty and
    blank texts are in no group; rows that are equal in id and text stay once.
    """
    stays, text_hash, number = (free_name(docs, c) for c in ("_stays", "_text_hash", "_number"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash"))
    with temporary(spark):  # once the chosen rows are written, nothing reads the sets and postings again
        found = jaccard.groups(docs)
        first = found.filter("grp is not null").groupBy("grp").agg(best.alias("best")).select(F.col("best.id").alias(stays), F.col("best.text_hash").alias(text_hash))
        alone = found.filter("grp is null").select(F.col("doc_id").alias(stays), F.col("text_hash").alias(text_hash)).distinct()
        chosen = materialize(first.unionAll(alone), "chosen-rows", stays=True)
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(stays)) & (F.xxhash64("text") == F.col(text_hash)), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return kept.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked. Null and empty texts, repeated rows and other columns stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words (null ones too) have no size and are taken at their
    source's rate; of a source without any words nothing is taken. A null source is
    a source of its own, repeated rows are rows. An empty table gives an empty table.
    """
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and the place in it; a null or empty text is one closing token, a repeated row is packed again."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A fitted model, components, tokens and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
