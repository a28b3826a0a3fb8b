"""Registry and the SQL fragments the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigraph.functions import constants as C
from lexigraph.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL fragments ---------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


STOP = sql_list(list(dict.fromkeys(C.KEYWORD_STOPWORDS)))
PUNCT = quoted(C.PUNCTUATION)


def bare(column: str) -> str:
    """Lower-case text without tags, punctuation and digits."""
    return rf"regexp_replace(translate(regexp_replace(lower({column}), '<[^>]+>', '', 'g'), {PUNCT}, ''), '\d+', '', 'g')"


def tok(column: str) -> str:
    return (
        rf"list_filter(string_split_regex({bare(column)}, '\s+'), "
        f"lambda w: length(w) between 3 and 50 and w not in ({STOP}))"
    )


def sents(column: str) -> str:
    return f"list_filter(list_transform(string_split_regex({column}, '[.!?]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


WS = "' ' || chr(9) || chr(10) || chr(13)"


def sentence_cte(source: str, key: str, column: str) -> str:
    """CTEs ending in ``sent(key, idx, text, start, stop)`` with offsets into the text.

    A marker goes before and after the white space that follows . ! or ?, so
    odd pieces are separators and offsets are running lengths.
    """
    return rf"""
    pieces as (
      select {key}, unnest(p) as piece, generate_subscripts(p, 1) as pos
      from (select {key}, string_split(regexp_replace({column}, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) as p from {source})
    ),
    offs as (
      select *, coalesce(sum(length(piece)) over (partition by {key} order by pos rows between unbounded preceding and 1 preceding), 0) as off
      from pieces
    ),
    sent as (
      select {key}, (pos - 1) // 2 as idx, trim(piece, {WS}) as text,
             off + length(piece) - length(ltrim(piece, {WS})) as start,
             off + length(piece) - length(ltrim(piece, {WS})) + length(trim(piece, {WS})) as stop
      from offs where pos % 2 = 1 and trim(piece, {WS}) <> ''
    )"""


NON_ASCII_LETTERS = "[À-ÖØ-öø-ÿ]"
NAME_SQL = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
DATE_SQL = C.DATE_PATTERN
YEAR_SQL = C.YEAR_PATTERN


def mention_cte(source: str, key: str, column: str, name: str = "mention") -> str:
    """CTEs ending in ``mention(key, pass, n, text, type, start, stop)``.

    Letters beyond ASCII become ``_`` first: word boundaries are ASCII in the
    checking engine and the patterns only match ASCII letters and digits.
    """
    passes = []
    for number, (pattern, kind) in enumerate([(NAME_SQL, "PER"), (DATE_SQL, "DATE"), (YEAR_SQL, "DATE")], 1):
        passes.append(
            rf"""select {key}, {number} as pass, '{kind}' as type, p from (
              select {key}, string_split(regexp_replace(regexp_replace({column}, '{NON_ASCII_LETTERS}', '_', 'g'),
                     '({pattern})', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from {source})"""
        )
    return f"""
    {name}_cut as ({' union all '.join(passes)}),
    {name}_piece as (
      select {key}, pass, type, unnest(p) as piece, generate_subscripts(p, 1) as pos from {name}_cut
    ),
    {name} as (
      select {key}, pass, pos // 2 as n, piece as text, type, off as start, off + length(piece) as stop
      from (
        select *, coalesce(sum(length(piece)) over (partition by {key}, pass order by pos rows between unbounded preceding and 1 preceding), 0) as off
        from {name}_piece
      ) where pos % 2 = 0
    )"""


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *extra))
