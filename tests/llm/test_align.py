"""Cross-tokenizer alignment against a plain re-computation, text by text and link by link."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigraph.llm import align

FILES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")


def brute(texts):
    import base64

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    with open(P.path(FILES[0]), "rb") as lines:
        a_bytes = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    second = sentencepiece.SentencePieceProcessor(model_file=P.path(FILES[1]))

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if b"".join(a_bytes[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
                a, b = [], []
        ranges = []
        for ids, value in ((a, a_bytes.__getitem__), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(value(i)), i))
                at += len(value(i))
            ranges.append(out)
        for s, e, x in ranges[0]:
            links += [(x, y) for t, f, y in ranges[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        start = 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in ranges))
            start = cut
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
        count.update(links)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text)
        for n_a, n_b, g, links, text in docs
    ]


ODD = [
    None, "", " ", "\n", "  two  spaces ", "plain words and plain words", "plain words and plain words", "<|endoftext|> and <s> </s> <unk>",
    "café naïve 日本語 \U0001f600\U0001f600", "tab\tand\r\nline", "under▁mark", "x" * 300, " hard space", "a" + " " * 40 + "b",
    "ﬁ ligature ①", "é combining", "\x00 control \x07", "12345 67,890.12 (a-b)_c",
]


@pytest.mark.parametrize("tokens", [1_500_000, 10])
def test_equals_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(align, "CHUNK_TOKENS", tokens)
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(ODD)] + [(5, ODD[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, pairs int").repartition(3)
    got = align.align(docs).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert Counter(tuple(r) for r in got) == want
    digests = Counter((r["doc_id"], r["groups"]) for r in align.align(docs, digest=True).collect())
    assert digests == Counter((r["doc_id"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)


def test_corpus_sample_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") < 600)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(docs).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows]))}
    assert any(v[0] for v in got.values())


def test_long_text_and_empty_table(spark):
    text = "word " * 200_000 + "z" * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = align.align(docs, digest=True).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] and row["n_a"] > 200_000
    assert align.align(docs.filter("doc_id = 0")).count() == 0


def test_pair_counts_are_links_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "doc_id long, text string")
    parts = align.aligned(docs)
    links = align.align(docs).agg(F.sum("n_links")).first()[0]
    assert align.pair_counts(parts).agg(F.sum("n")).first()[0] == links


def test_equal_prints_do_not_join_different_windows(monkeypatch):
    """The first print is made useless; windows must still be told apart by their ids."""
    import numpy as np

    real = align._mix
    monkeypatch.setattr(align, "_mix", lambda ids, at, seed: real(ids, at, seed) if seed > 3 else np.zeros(len(ids), dtype=np.uint64))
    a, b = np.array([1, 2, 3, 1, 2]), np.array([7, 8, 7])
    first, kind = align.distinct(a, b, np.array([2, 3, 5]), np.array([1, 2, 3]))
    assert kind[0] == kind[2] != kind[1] and sorted(first.tolist()) == [0, 1]
