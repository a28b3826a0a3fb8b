"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Every query runs to completion into a sink that discards rows: once to warm up,
then BENCH_RUNS times (default 2), of which the best counts. The search index
is built and timed apart. Scratch tables of a run are removed after it.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import QUERIES, search as S  # noqa: E402
from catalog.common import documents, table  # noqa: E402
from lexigraph.operators import ranking as R  # noqa: E402
from lexigraph.session import local_session  # noqa: E402

HEADLINE = [
    "tokenize",
    "kw_word_freq",
    "kw_tfidf_top",
    "kw_textrank",
    "kw_extract_single",
    "kw_extract",
    "ner_keywords",
    "q_detect",
    "graph_degree",
    "graph_neighbours",
    "rank_lexical",
    "rank_vector",
    "search_standard",
    "search_question_aware",
]
TEXT_QUERIES = [q for q in HEADLINE if q.startswith(("tok", "kw", "ner"))]


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(scratch: str, build, runs: int) -> float:
    """Seconds of the best of ``runs`` after one run that warms up; what a run writes is removed after it."""
    seconds, kept = [], set(os.listdir(scratch))
    for _ in range(runs + 1):
        seconds.append(timed(build))
        for name in set(os.listdir(scratch)) - kept:
            shutil.rmtree(os.path.join(scratch, name), ignore_errors=True)
    return round(min(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = local_session(cpus, max(8, int(cpus) if cpus.isdigit() else 8), scratch)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds = {name: best(scratch, lambda n=name: QUERIES[n](spark, sf_dir), runs) for name in HEADLINE}

    nodes = documents(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uuid"), "text")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    apart = {"index_build": best(scratch, lambda: R.lexical_postings(nodes, F.col("text")), runs)}
    postings = S.document_postings(spark, sf_dir)
    apart["lexical_search_alone"] = best(scratch, lambda: R.bm25(passages, postings, 20), runs)

    count = documents(spark, sf_dir).count()
    rate = {f"{q}_docs_per_sec": round(count / seconds[q], 1) for q in TEXT_QUERIES}
    asked, vectors = S.label_questions(spark, sf_dir).count(), table(spark, sf_dir, "embeddings").count()
    rate["rank_vector_pairs_per_sec"] = round(asked * vectors / seconds["rank_vector"], 1)
    rate["rank_lexical_pairs_per_sec"] = round(passages.count() * count / seconds["rank_lexical"], 1)
    star = S.star_questions(spark, sf_dir).count() * S.star_nodes(spark, sf_dir).count()
    rate["search_question_aware_pairs_per_sec"] = round(star / seconds["search_question_aware"], 1)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "apart": apart,
                "throughput": rate,
            }
        )
    )
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
