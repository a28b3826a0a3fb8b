"""From sources to keywords in one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from lexigraph.operators import entities, keywords as K

CHAINED = K.KeywordOptions(method="combined", num_keywords=20)


def keywords_of(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    method: str = "combined",
    num_keywords: int = 20,
    deep: bool = False,
    corpus: DataFrame | None = None,
    options: K.KeywordOptions = CHAINED,
) -> DataFrame:
    """(key, rank, keyword, score, type) of any table with a text column.

    ``method`` is one of the statistical methods or ``ner``.
    """
    if method == "ner":
        return entities.entity_keywords(docs, key, text, num_keywords, deep)
    return K.extract(docs, key, text, corpus, options=replace(options, method=method, num_keywords=num_keywords))
