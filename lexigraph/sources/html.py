"""HTML pages to text, metadata, links and sections; fetching is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns of HTML.
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
QUOTED = r"""(["'])((?:(?!\%d).)*)\%d"""  # up to the quote that opened it
HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*" + QUOTED % (1, 1)
HEADING_START = r"(?i)(?=<h[1-6][\s>])"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible(html: Column, remove_scripts: bool = True) -> Column:
    """Text between tags with white space collapsed."""
    if remove_scripts:
        html = F.regexp_replace(html, HIDDEN, " ")
    bare = F.regexp_replace(F.regexp_replace(html, COMMENT, " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag, null where there is none."""
    found = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\bname\s*=\s*["']{name}["'][^>]*?\bcontent\s*=\s*""" + QUOTED % (1, 1), 2)
    return F.nullif(found, F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(2))


def sections(html: Column, remove_scripts: bool = True) -> Column:
    """Visible text per heading section; what precedes the first heading is a section too."""
    body = F.regexp_replace(html, HIDDEN, " ") if remove_scripts else html
    parts = F.transform(F.split(body, HEADING_START, -1), lambda p: visible(p, False))
    return F.filter(parts, lambda p: p != "")


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", remove_scripts: bool = True) -> DataFrame:
    """Pages plus text, metadata (url, title, description, keywords, links) and sections."""
    page = F.col(html)
    body = F.regexp_replace(page, r"(?is)<head\b.*?</head\s*>", " ")
    return (
        pages.withColumn("text", visible(body, remove_scripts))
        .withColumn(
            "metadata",
            F.struct(
                F.col(url).alias("url"),
                F.trim(F.regexp_replace(unescape(F.regexp_extract(page, TITLE, 1)), r"\s+", " ")).alias("title"),
                meta(page, "description").alias("description"),
                meta(page, "keywords").alias("keywords"),
                links(page).alias("links"),
            ),
        )
        .withColumn("pages", sections(body, remove_scripts))
    )
