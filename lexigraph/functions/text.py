"""Text scalars as Column expressions; none of them moves a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from lexigraph.functions import constants as C
from lexigraph.functions.arrays import let, part, running_total

# Whitespace as str.split() understands it, which includes the separators 1c-1f.
SPACES = r"(?U)[\s\x1c-\x1f]+"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_GAP = r"(?U)(?<=[.!?])(?=\s)"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_punct(text: Column) -> Column:
    return F.translate(text, C.PUNCTUATION, "")


def strip_numeric(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "")


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty strings."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def stopword_set(custom: Iterable[str] = ()) -> list[str]:
    return list(dict.fromkeys([*C.KEYWORD_STOPWORDS, *(w.lower() for w in custom)]))


def drop_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    return F.filter(tokens, lambda w: ~F.lower(w).isin(*stopwords))


def keep_lengths(tokens: Column, shortest: int = 3, longest: int = 50) -> Column:
    return F.filter(tokens, lambda w: F.length(w).between(shortest, longest))


def bare_text(text: Column) -> Column:
    """Lower-case text without tags, punctuation and digits: what :func:`tokenize` cuts into words."""
    lowered = F.lower(text)
    untagged = F.when(F.contains(lowered, F.lit("<")), strip_tags(lowered)).otherwise(lowered)
    return _plain(untagged)


def _plain(untagged: Column) -> Column:
    return F.regexp_replace(untagged, r"[\p{Punct}\p{Nd}]+", "")  # strip_punct and strip_numeric in one pass


def tokenize(
    text: Column,
    shortest: int = 3,
    longest: int = 50,
    custom_stopwords: Iterable[str] = (),
    stemmer: Callable[[Column], Column] | None = None,
) -> Column:
    """Lower-case words of a text without tags, punctuation, digits and stopwords.

    ``stemmer`` maps array<string> to array<string>, e.g. a pandas UDF.
    """
    return bare_words(bare_text(text), shortest, longest, custom_stopwords, stemmer)


def bare_words(
    bare: Column,
    shortest: int = 3,
    longest: int = 50,
    custom_stopwords: Iterable[str] = (),
    stemmer: Callable[[Column], Column] | None = None,
) -> Column:
    """The words of a :func:`bare_text`."""
    stopwords = stopword_set(custom_stopwords)
    kept = F.filter(
        F.split(bare, SPACES),
        lambda w: (F.length(w) >= max(shortest, 1)) & (F.length(w) <= longest) & ~w.isin(*stopwords),
    )
    if stemmer is None:
        return kept
    return keep_lengths(stemmer(kept), shortest, longest)


SENTENCE_END = "\x02"


def sentence_words(sentences: Column, shortest: int = 3, longest: int = 50, custom_stopwords: Iterable[str] = ()) -> Column:
    """The :func:`tokenize` words of all sentences in one list, ``SENTENCE_END`` between two sentences.

    Tags are taken out sentence by sentence, the rest is done once. For sentences without that sign.
    """
    stopwords = stopword_set(custom_stopwords)
    untagged = F.transform(sentences, lambda s: F.when(F.contains(s, F.lit("<")), strip_tags(F.lower(s))).otherwise(F.lower(s)))
    pieces = F.split(_plain(F.array_join(untagged, f" {SENTENCE_END} ")), SPACES)
    return F.filter(
        pieces, lambda w: (w == SENTENCE_END) | ((F.length(w) >= max(shortest, 1)) & (F.length(w) <= longest) & ~w.isin(*stopwords))
    )


def ngrams(
    tokens: Column,
    n: int,
    shortest: int = 3,
    longest: int = 50,
    stopwords: Iterable[str] = tuple(C.KEYWORD_STOPWORDS),
    lowered: bool = False,
) -> Column:
    """Contiguous n-grams (as strings) that pass the phrase rules.

    Tokens known to be free of stopwords need none here, and ``lowered`` says
    that they are lower-case already.
    """
    stop, common = list(stopwords), C.BIGRAM_COMMON_WORDS

    def plain(word: Column) -> Column:
        return word if lowered else F.lower(word)

    def refusals(word: Callable[[int], Column]) -> list[Column]:
        if n > 2:
            return [plain(word(j)).isin(*stop) for j in range(1, n - 1)] if stop else []
        first, second = word(0), word(1)
        rules = [
            F.length(first) < 3,
            F.length(second) < 3,
            plain(second).isin(*common),
            plain(first).isin(*common) & (F.length(second) <= 4),
        ]
        return rules + ([plain(first).isin(*stop) & plain(second).isin(*stop)] if stop else [])

    def windows(toks: Column) -> Column:
        at = lambda i: lambda j: F.get(toks, i + j)
        starts = F.sequence(F.lit(0), F.size(toks) - n)
        if n == 2 or stop:
            starts = F.filter(starts, lambda i: ~reduce(lambda x, y: x | y, refusals(at(i))))
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[at(i)(j) for j in range(n)]))
        return F.filter(grams, lambda g: F.length(g).between(shortest * n, longest * n))

    return let(
        tokens,
        lambda toks: F.when(F.size(toks) >= n, windows(toks)).otherwise(F.expr("cast(array() as array<string>)")),
    )


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """Non-empty pieces between runs of . ! ? — the split the keyword scores use."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), trimmed), lambda s: s != "")


def indexed_sentences(text: Column) -> Column:
    """array<struct<text, index, start, end>> with offsets into the text.

    Splitting at the empty position before the white space keeps every
    character in some part, so offsets are running part lengths.
    """

    def place(parts: Column) -> Column:
        ends = running_total(F.transform(parts, F.length))
        located = let(
            ends,
            lambda stop: F.transform(
                parts,
                lambda p, i: F.struct(
                    trimmed(p).alias("text"),
                    i.alias("index"),
                    (
                        F.get(stop, i)
                        - F.length(F.ltrim(p, F.lit(WHITE)))
                    ).alias("start"),
                ),
            ),
        )
        return F.transform(
            F.filter(located, lambda s: s["text"] != ""),
            lambda s: F.struct(
                s["text"].alias("text"),
                s["index"].alias("index"),
                s["start"].alias("start"),
                (s["start"] + F.length(s["text"])).alias("end"),
            ),
        )

    def parts(whole: Column) -> Column:  # the pattern is compiled once here, and for every row where it splits
        marked = F.split(F.regexp_replace(whole, SENTENCE_GAP, MARK), MARK, -1)
        return F.when(F.contains(whole, F.lit(MARK)), F.split(whole, SENTENCE_GAP, -1)).otherwise(marked)

    return let(let(text, parts), place)


def sentence_blocks(located: Column, blocksize: int = 1) -> Column:
    """Group indexed sentences by ``blocksize``: text, indices, start, end, block_index."""
    size = max(int(blocksize), 1)
    return let(
        located,
        lambda s: F.when(
            F.size(s) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")),
                lambda b: let(
                    part(s, b * size + 1, F.least((b + 1) * size, F.size(s))),
                    lambda block: F.struct(
                        F.array_join(F.transform(block, lambda x: x["text"]), " ").alias("text"),
                        F.transform(block, lambda x: x["index"]).alias("indices"),
                        F.element_at(block, 1)["start"].alias("start"),
                        F.element_at(block, -1)["end"].alias("end"),
                        b.alias("block_index"),
                    ),
                ),
            ),
        ).otherwise(
            F.expr("cast(array() as array<struct<text:string,indices:array<int>,start:int,end:int,block_index:int>>)")
        ),
    )


MARK = "\x01"  # put around matches; a text that holds one is cut by the pattern itself
FEW = 8


def spans(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """array<struct<text, start, end>> of all matches of a pattern without groups, or what ``make`` does with the three.

    One pass of the pattern marks the matches, so that a plain split tells them
    from the gaps. Few matches count their offsets in the marked text, many by
    running lengths.
    """
    unicode_pattern = f"(?U){pattern}"
    make = make or (lambda found, start, end: F.struct(found.alias("text"), start.alias("start"), end.alias("end")))

    def placed(found: Column, stops: Column) -> Column:
        return F.zip_with(found, stops, lambda m, stop: make(m, stop - F.length(m), stop))

    def by_pattern(whole: Column) -> Column:
        gaps = F.split(whole, unicode_pattern, -1)
        return let(
            F.regexp_extract_all(whole, F.lit(unicode_pattern), F.lit(0)),
            lambda found: placed(
                found, running_total(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
            ),
        )

    def by_marks(marked: Column, pieces: Column) -> Column:
        matches = F.filter(pieces, lambda _, i: i % 2 == 1)

        def few(m: Column, i: Column) -> Column:
            start = F.length(F.call_function("substring_index", marked, F.lit(MARK), 2 * i + 1)) - 2 * i
            return make(m, start, start + F.length(m))

        stops = F.filter(running_total(F.transform(pieces, F.length)), lambda _, i: i % 2 == 1)
        return F.when(F.size(pieces) <= 2 * FEW + 1, F.transform(matches, few)).otherwise(placed(matches, stops))

    def all_of(whole: Column) -> Column:
        marked = F.regexp_replace(whole, unicode_pattern, f"{MARK}$0{MARK}")
        cut = let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), let(F.split(m, MARK, -1), lambda pieces: by_marks(m, pieces))))
        return F.when(F.contains(whole, F.lit(MARK)), by_pattern(whole)).otherwise(cut)

    none = F.filter(F.array(make(F.lit(""), F.lit(0), F.lit(0))), lambda _: F.lit(False))
    return F.coalesce(let(text, all_of), none)


def chunk_text(text: Column, page_size: int = C.PAGE_SIZE) -> Column:
    """Pack blank-line paragraphs greedily into pages; a long paragraph stays whole."""
    gap = "\n\n"

    def pack(state: Column, paragraph: Column) -> Column:
        fits = F.length(state["open"]) + F.length(paragraph) <= page_size
        closes = ~fits & (state["open"] != "")
        return F.struct(
            F.when(closes, F.concat(state["pages"], F.array(trimmed(state["open"])))).otherwise(state["pages"]).alias("pages"),
            F.when(fits, F.concat(state["open"], paragraph, F.lit(gap))).otherwise(F.concat(paragraph, F.lit(gap))).alias("open"),
        )

    packed = F.aggregate(
        F.split(text, gap, -1),
        F.struct(F.expr("cast(array() as array<string>)").alias("pages"), F.lit("").alias("open")),
        pack,
        lambda state: F.concat(state["pages"], F.array(trimmed(state["open"]))),
    )
    return F.when(F.length(text) <= page_size, F.array(text)).otherwise(packed)


def json_to_text(content: Column) -> Column:
    """Space-joined values of a JSON object, without null, false, zero and empty ones."""

    def shown(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        as_text = v.cast("string")
        empty = (
            (kind == "VOID")
            | ((kind == "BOOLEAN") & (as_text == "false"))
            | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (as_text.try_cast("double") == 0))
            | as_text.isin("", "[]", "{}")
        )
        return F.when(empty, None).when(kind == "BOOLEAN", F.initcap(as_text)).otherwise(as_text)

    values = F.transform(F.map_values(F.from_json(content, "map<string,variant>")), shown)
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), " ")


def title_lines(text: Column) -> Column:
    """Lower-cased heading-like lines among the first three."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, 3), trimmed)
    shouting = lambda line: (F.upper(line) == line) & (F.lower(line) != line)
    return F.transform(
        F.filter(
            lines,
            lambda line: (line != "")
            & (F.length(line) < C.TITLE_MAX_CHARS)
            & (shouting(line) | line.startswith("#")),
        ),
        F.lower,
    )


def snippet(text: Column, size: int = C.SNIPPET_CHARS) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


# Fixed patterns for links and file mentions.
URL_PATTERN = r"""https?://[^\s<>"{}|\\^`\[\]]+"""
_EXT = "(?:" + "|".join(C.FILE_EXTENSIONS) + ")"
QUOTED_PATH_PATTERN = rf"""["']([^"']+\.{_EXT})["']"""
# A plain name starts where a run of non-space characters starts, so each run is tried once.
ABSOLUTE_PATH_PATTERN = rf"""(?<![^\s,=(\[{{<:|"'`])(/[^\s,/][^\s,]*\.{_EXT})"""
PLAIN_PATH_PATTERN = rf"""(?<![^\s,])([^\s,]+\.{_EXT})"""


def extract_links(text: Column) -> Column:
    """Distinct URLs, then quoted, absolute and relative file names found in a text."""

    def tidy(found: Column) -> Column:
        return F.transform(found, lambda x: F.rtrim(x, F.lit(".,;")))

    urls = F.regexp_extract_all(text, F.lit(f"(?U){URL_PATTERN}"), F.lit(0))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(f"(?U){QUOTED_PATH_PATTERN}"), F.lit(1)), F.trim)
    plain = F.filter(
        F.regexp_extract_all(text, F.lit(f"(?U){PLAIN_PATH_PATTERN}"), F.lit(1)),
        lambda x: ~x.contains("://") & ~x.startswith("http"),
    )
    absolute = F.regexp_extract_all(text, F.lit(f"(?U){ABSOLUTE_PATH_PATTERN}"), F.lit(1))
    return F.array_distinct(F.concat(urls, quoted, tidy(absolute), tidy(plain)))


def parser_kind(path: Column) -> Column:
    """url / pdf / txt / csv / spreadsheet, or null where no parser fits."""
    is_url = path.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    by_extension = F.create_map(*[F.lit(x) for pair in C.PARSER_BY_EXTENSION.items() for x in pair])
    return F.when(is_url, F.lit("url")).otherwise(F.try_element_at(by_extension, extension))
