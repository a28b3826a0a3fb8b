import re
import string

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import arrays as A, constants as C, text as T

SAMPLE = "The <b>Quick</b> brown-fox, 42 times; TIME will tell.  Ünïcode naïve café 3٣ x!"


def words_by_hand(text, stop=frozenset(C.KEYWORD_STOPWORDS), low=3, high=50):
    text = re.sub(r"<[^>]+>", "", text.lower())
    text = re.sub(r"\d+", "", text.translate(str.maketrans("", "", string.punctuation)))
    return [w for w in text.split() if w not in stop and low <= len(w) <= high]


def test_tokenize_by_hand(one):
    assert one(SAMPLE, T.tokenize) == words_by_hand(SAMPLE)
    assert one("", T.tokenize) == []
    assert one("Alpha beta", lambda c: T.tokenize(c, custom_stopwords=["ALPHA"])) == ["beta"]
    assert one("aa bbbb", lambda c: T.tokenize(c, shortest=1, longest=3)) == ["aa"]


def test_tokenize_stemmer_slot(one):
    stem = lambda tokens: F.transform(tokens, lambda w: F.regexp_replace(w, "s$", ""))
    assert one("cats dogs ass", lambda c: T.tokenize(c, stemmer=stem)) == ["cat", "dog"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZ .,!?<>1٣\n\té"), max_size=60), min_size=20, max_size=20))
def test_text_properties(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "t", T.tokenize(F.col("t")).alias("k"), T.indexed_sentences(F.col("t")).alias("s"), A.tally(T.words(F.col("t"))).alias("n"),
        T.sentences(F.col("t")).alias("p"), T.strip_tags(F.col("t")).alias("g"), T.strip_numeric(F.col("t")).alias("d"),
    )
    for r in rows.collect():
        assert r.k == words_by_hand(r.t)
        assert r.g == re.sub(r"<[^>]+>", "", r.t)
        assert r.d == re.sub(r"\d+", "", r.t)
        assert r.p == [s.strip() for s in re.split(r"[.!?]+", r.t) if s.strip()]
        assert {e["item"]: e["n"] for e in r.n} == {w: r.t.split().count(w) for w in set(r.t.split())}
        parts = re.split(r"(?<=[.!?])\s+", r.t)
        assert [(s["text"], s["index"]) for s in r.s] == [(p.strip(), i) for i, p in enumerate(parts) if p.strip()]
        assert all(r.t[s["start"] : s["end"]] == s["text"] for s in r.s)


@pytest.mark.parametrize("size", [0, 1, 2, 9, 10, 100])
def test_running_total(spark, size):
    df = spark.range(1).select(A.running_total(F.array(*[F.lit(i) for i in range(size)]).cast("array<int>")).alias("x"))
    assert df.first()["x"] == [sum(range(i + 1)) for i in range(size)]


def test_ngrams_phrase_rules(spark):
    tokens = "can run being fast should matter the end of time was good".split()
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    stop, common = set(C.KEYWORD_STOPWORDS), set(C.BIGRAM_COMMON_WORDS)
    pairs = []
    for a, b in zip(tokens, tokens[1:]):
        if not 6 <= len(f"{a} {b}") <= 100 or (a in stop and b in stop) or (a in common and len(b) <= 4):
            continue
        if b in common or len(a) < 3 or len(b) < 3:
            continue
        pairs.append(f"{a} {b}")
    assert df.select(T.ngrams(F.col("t"), 2)).first()[0] == pairs
    triples = [" ".join(t) for t in zip(tokens, tokens[1:], tokens[2:]) if t[1] not in stop and 9 <= len(" ".join(t)) <= 150]
    assert df.select(T.ngrams(F.col("t"), 3)).first()[0] == triples


def test_chunk_text(one):
    assert one("short", lambda c: T.chunk_text(c)) == ["short"]
    assert one("a" * 5000, lambda c: T.chunk_text(c)) == ["a" * 5000]
    text = "\n\n".join(["one one", "two two", "a very long paragraph", "x", "y"])
    assert one(text, lambda c: T.chunk_text(c, 18)) == ["one one\n\ntwo two", "a very long paragraph", "x\n\ny"]


def test_json_to_text(one):
    assert one('{"a":"x","b":true,"c":false,"d":0,"e":5,"f":"0","g":null,"h":"","i":2.5}', T.json_to_text) == "x True 5 0 2.5"


def test_title_lines_and_snippet(one):
    assert one("BIG NEWS\n# note\nplain\nLATE", T.title_lines) == ["big news", "# note"]
    assert one("123\n" + "A" * 100, T.title_lines) == []
    assert one("x" * 101, T.snippet) == "x" * 100 + "..."
    assert one("x" * 100, T.snippet) == "x" * 100


def test_links_and_routes(one):
    found = one('see https://a.b/c?x=1 and "my file.pdf" or /tmp/x.csv, rel/y.txt;', T.extract_links)
    assert found == ["https://a.b/c?x=1", "my file.pdf", "/tmp/x.csv", "file.pdf", "rel/y.txt"]
    found = one("path=/data/x.csv (/data/y.txt http://h/z.pdf a/b.csv", T.extract_links)
    assert [x for x in found if x.startswith("/")] == ["/data/x.csv", "/data/y.txt"]
    expected = {
        "https://e.com/a.pdf": "url", "http://e.com": "url", "a/b.TXT": "txt", "f.text": "txt", "x.csv": "csv", "x.pdf": "pdf",
        "x.xlsx": "spreadsheet", "x.xlsm": "spreadsheet", "x.ods": "spreadsheet", ".txt": None, "noext": None, "a.doc": None,
    }
    for path, kind in expected.items():
        assert one(path, T.parser_kind) == kind


def test_spans_come_from_one_pass_of_the_pattern(spark):
    texts = ["", "no year", "1999", "in 1999, 2001.", "a \x01 1999 b 2001", "é 1999 " * 40, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    year = r"\b(?:19|20)\d{2}\b"
    rows = df.select("i", T.spans(F.col("t"), year).alias("x")).collect()
    for row in rows:
        expected = [(m.group(), m.start(), m.end()) for m in re.finditer(year, texts[row["i"]] or "")]
        assert [tuple(x) for x in row["x"]] == expected
    ends = df.select(T.spans(F.col("t"), year, lambda found, start, end: end).alias("x")).collect()
    assert [r["x"] for r in ends] == [[x["end"] for x in r["x"]] for r in rows]
