"""Jaccard join, toxicity, HTML extraction, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexigraph.llm import ann, components as component_module, html, jaccard, queries, toxicity
from lexigraph.llm.components import components
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# -- Jaccard join -----------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(texts):
    """id -> (set size, smallest id reachable), all pairs compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def answers(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, families, copies, words, edits, shared=0):
    """Families of edited copies; ``shared`` words stand in all of them."""
    draw = random.Random(seed)
    common = [f"common{i}" for i in range(shared)]
    texts, number = {}, 0
    for family in range(families):
        base = [f"f{family}w{draw.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            mine = list(base)
            for _ in range(draw.randrange(edits + 1)):
                mine[draw.randrange(len(mine))] = f"e{draw.random()}"
            texts[number] = " ".join(common + mine)
            number += 1
    return texts


def test_join_agrees_with_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert answers(jaccard.join(documents(spark))) == brute_components(texts)


@pytest.mark.parametrize("block", [4, 16, 256])
def test_join_of_large_groups_in_small_blocks(spark, block):
    """Groups of many blocks, borderline links, and a passage that most texts share."""
    texts = near_copies(5, families=4, copies=30, words=60, edits=6, shared=30)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    expected = brute_components(texts)
    assert len({c for _, c in expected.values()}) > 4
    assert answers(jaccard.join(docs, block=block)) == expected


def test_nothing_is_broadcast_by_size(spark, monkeypatch):
    texts = near_copies(9, families=3, copies=8, words=40, edits=2, shared=20)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert answers(jaccard.join(docs)) == brute_components(texts)


def test_shared_postings_have_a_fitting_partner(spark):
    """Against every pair of a list, sizes at and around the limit ratio."""
    draw = random.Random(3)
    rows = {(h, draw.randrange(40), n) for h in range(30) for n in draw.sample(range(1, 140), draw.randrange(1, 9))}
    rows = sorted({(h, c + 1000 * n, n) for h, c, n in rows})
    want = set()
    for h, c, n in rows:
        others = [m for g, d, m in rows if g == h and d != c]
        if any(100 * min(m, n) >= 75 * max(m, n) for m in others):
            want.add((h, c, n, len(others) + 1))
    got = {tuple(r) for r in jaccard._shared(spark.createDataFrame(rows, "hash long, cls long, n long")).collect()}
    assert want <= got
    # what is more shares a step of sizes with another class, a little beyond the ratio
    for h, c, n, _ in got - want:
        assert any(d != c and max(m, n) <= 1.34 * min(m, n) for g, d, m in rows if g == h)


def test_join_odd_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two"), (7, "É x"), (8, "é x"),
        (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (10, "b c d e f g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine")).withColumn("n_shingles", F.lit(-1))
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect())
    assert found == [(0, 2, 9), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 2, 9), (9, 2, 9), (10, 2, 10)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_t_occurrence_finds_each_link():
    draw = random.Random(3)
    base = [draw.getrandbits(63) for _ in range(200)]
    sets = [np.unique(np.array(draw.sample(base, 200 - draw.randrange(40)) + [draw.getrandbits(63) for _ in range(draw.randrange(20))], dtype=np.uint64)) for _ in range(60)]
    found = set()
    everyone = list(range(60))
    for q in everyone:  # one query at a time, so nothing is joined before
        found |= {(q, m) for _, m in jaccard.t_occurrence(sets, [q], everyone, everyone)}
    linked = {(a, b) for a in everyone for b in everyone if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert found == linked and 100 < len(linked) < 3540


@pytest.mark.parametrize("few", [0, 500, 10**6])
def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(component_module, "FEW", few)
    chain = [(i, i + 1) for i in range(100, 300)]
    hub = [(7, i) for i in range(1000, 1200)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long")).collect()}
    assert {found[i] for i in range(100, 301)} == {100} and {found[i] for i in range(1000, 1200)} == {7} and 5 not in found


# -- toxicity ---------------------------------------------------------------------------


def toxic_corpus(spark, n=1500):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for word in draw.sample(["idiot", "scum", "snargle", "blorfed", "worthless"], 2):
                words.insert(draw.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    assert "snargle" in model.learnt and "blorfed" in model.learnt
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 200 and sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored) / len(scored) > 0.97


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = toxic_corpus(spark)
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, wrong)


def test_label_model_weighs_copied_voters_less():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.3
    voter = lambda right: np.where(draw.random(4000) < right, truth, ~truth)
    good, fair, poor = voter(0.95), voter(0.8), voter(0.6)
    said = np.stack([good, fair, poor, poor, poor], axis=1).astype(int)
    patterns, at = np.unique(np.where(said == 1, toxicity.TOXIC, toxicity.CLEAN), axis=0, return_inverse=True)
    # labels say nothing here: half of the rows of each pattern carry either
    both = np.concatenate([patterns, patterns])
    counts = np.tile(np.bincount(at.ravel(), minlength=len(patterns)), 2).astype(float)
    labels = np.repeat([1, 0], len(patterns))
    agree = np.array([counts[i] for i in range(len(both))])
    weight = np.array([(truth[at.ravel() == i % len(patterns)] == labels[i]).mean() for i in range(len(both))])
    posterior = toxicity.label_model(both, agree * weight, labels)
    judged = np.zeros(len(patterns))
    for i in range(len(patterns)):
        judged[i] = np.average([posterior[i], posterior[i + len(patterns)]], weights=[weight[i] + 1e-9, weight[i + len(patterns)] + 1e-9])
    assert ((judged[at.ravel()] >= 0.5) == truth).mean() > 0.9


def test_toxicity_odd_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (3, "x " * 50000), (3, "x " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([(9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    scores = {r["text"]: r["score"] for r in toxicity.score(docs.withColumn("extra", F.lit(1)), model).collect()}
    assert scores[None] == scores[""] < 0.5 < scores["you idiot"]
    assert toxicity.score(docs.limit(0), model).count() == 0


# -- HTML -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>a  b\n c<p>d<b>e</b></article>", "a b c\nde"),
        ("<body><nav>menu</nav><p>x</p><footer>f</footer><script>var t='</p>';</script>", "x"),
        ("<article><h1>T</h1><p>one<div class='ad box'>buy</div>two</p><section id=comments>hi</section></article>", "T\none\ntwo"),
        ("<p title='a>b'>in</p><!-- <p>no</p> --><p>out", "in\nout"),
        ("<main><header><h1>T</h1></header><p>x &lt;b&gt; &#233;</p></main><div>outside</div>", "T\nx <b> é"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<div class='loading shadow'>kept</div><div class=site-menu>gone</div><div hidden>gone</div>", "kept"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>e<br>f", "a\nb\nc\nd\ne\nf"),
        ("<style>p{}</style><title>t</title><form>q<input></form><p>z", "z"),
    ],
)
def test_blocks_of_a_page(page, text):
    assert html.choose(html.blocks(page)) == text


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-sidebar-wrap", "comments-open", "layout sidebar"])
def test_a_name_around_an_article_does_not_take_it(name):
    assert html.choose(html.blocks(f"<div class='{name}'><div class=menu>m</div><article><p>x</p><p class=ad>y</p></article><p>z</p></div>")) == "x"


def test_names_around_other_blocks():
    assert html.choose(html.blocks("<body><div class='has-sidebar comments-open'><p>x</p><div class=left-sidebar>s</div><div id=widget-2>w</div></div>")) == "x"
    assert html.choose(html.blocks("<article>x</article><div class=related><article>teaser</article></div>")) == "x"


def host_pages():
    """Pages without an article mark: own text, a notice all share, a run two of them share."""
    own = {i: " ".join(f"p{i}w{j}" for j in range(30)) for i in range(6)}
    notice = "this site uses words that stand on every page of it for all readers"
    quote = "only two pages of the host carry this line of ten words"
    return [(i, f"http://h.example.com/{i}", f"<div>{notice}</div><p>{own[i]}</p>" + (f"<p>{quote}</p>" if i < 2 else "")) for i in range(6)], own


@pytest.mark.parametrize("most", [4_000_000, 1])
def test_host_repeats_go_and_own_text_stays(spark, most):
    rows, own = host_pages()
    rows += [(10, "http://other.example.com/", rows[0][2]), (11, "http://other.example.com/", rows[0][2]), (12, None, rows[0][2])]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most_tokens=most).collect()}
    assert {i: found[i] for i in range(6)} == own
    assert found[10] == found[11] == found[12] and own[0] in found[10] and "this site" in found[10]


@pytest.mark.parametrize("most", [4_000_000, 1])
def test_a_page_under_two_addresses_keeps_its_text(spark, most):
    rows, own = host_pages()
    rows += [(20 + i, f"{url}?ref=x", page) for i, url, page in rows[2:4]]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most_tokens=most).collect()}
    assert found == own | {22: own[2], 23: own[3]}


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_a_notice_inside_marked_articles_goes_and_quotes_and_copies_stay(spark, most):
    own = lambda i, n=20: " ".join(f"w{i}x{k}" for k in range(n))
    notice, quote, shared = (" ".join(f"{name}{k}" for k in range(12)) for name in ("notice", "quote", "shared"))
    page = lambda *texts: "<nav>menu</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    rows, want = [], {}

    def add(host, texts, kept):
        i = len(rows)
        rows.append((i, f"http://{host}/{i}", page(*texts)))
        want[i] = "\n".join(kept)

    for i in range(12):  # the notice stands on all pages, the quote on a third
        texts = [own(i), *([quote] if i % 3 == 0 else []), own(i + 100, 9)]
        add("large.org", [texts[0], notice, *texts[1:]], texts)
    for i in range(4):  # too few pages to tell
        add("small.org", [own(i + 200), notice], [own(i + 200), notice])
    for i in range(9):  # near copies of one article among pages of their own
        add("copies.org", [own(300, 40), shared, own(i + 400)], [own(300, 40), shared, own(i + 400)])
    for i in range(3):
        add("copies.org", [own(i + 500)], [own(i + 500)])
    add("large.org", [notice], [notice])  # nothing else is left of this one
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), most_tokens=most).collect()}
    assert found == want


def test_covered_tokens_on_enough_pages():
    tokens = np.array([1, 2, 3, -1, 1, 2, 4, -2, 1, 2, 3, -3, 1, 2, 3, -4])
    pages = np.array([0] * 4 + [1] * 4 + [2] * 8)
    held = lambda least: np.flatnonzero(html.covered_tokens(tokens, pages, 2, least)).tolist()
    assert held(3) == [0, 1, 4, 5, 8, 9, 12, 13]
    assert held(2) == [0, 1, 2, 4, 5, 8, 9, 10, 12, 13, 14] and held(4) == []


def test_covered_tokens_agree_with_brute_force():
    draw = random.Random(2)
    for _ in range(20):
        pages = [[draw.randrange(4) for _ in range(draw.randrange(1, 40))] for _ in range(4)]
        depth = draw.randrange(2, 7)
        where = defaultdict(set)
        for p, words in enumerate(pages):
            for i in range(len(words) - depth + 1):
                where[tuple(words[i : i + depth])].add(p)
        expected = []
        for words in pages:
            marks = [False] * len(words)
            for i in range(len(words) - depth + 1):
                if len(where[tuple(words[i : i + depth])]) > 1:
                    marks[i : i + depth] = [True] * depth
            expected += marks + [False]
        flat = np.concatenate([np.array(w + [-1 - p]) for p, w in enumerate(pages)])
        names = np.concatenate([np.full(len(w) + 1, p) for p, w in enumerate(pages)])
        assert html.covered_tokens(flat, names, depth).tolist() == expected


def test_pages_agree_with_their_articles(spark):
    import html as entities

    for r in html.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in re.split(r"<[^>]*>", re.sub(r"</?b>", "", body))]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_html_odd_cases(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://x", "<p>y"), (2, "", "<p>" + "z " * 100000)], "page_id long, url string, html string")
    pages = pages.withColumn("text", F.lit("mine")).withColumn("host", F.lit("mine"))
    assert sorted(r["n_chars"] for r in html.extract(pages).collect()) == [0, 0, 1, 199999]
    assert html.extract(pages.limit(0)).count() == 0


# -- nearest neighbours -------------------------------------------------------------------


def brute_neighbours(ids, vectors, query, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit[ids.index(query)]
    ranked = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != query)
    return [(i, -s) for s, i in ranked[:k]]


def test_recall_over_several_shards(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = df.collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)
    found = defaultdict(list)
    for r in ann.neighbours(df, df.filter("vec_id % 50 = 0"), shard_size=150).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    hits = total = 0
    for query in (i for i in ids if i % 50 == 0):
        best = brute_neighbours(ids, vectors, query)
        total += 5
        hits += len({i for i, _ in best} & {i for i, _ in found[query]})
        for i, s in found[query]:
            a, b = vectors[ids.index(i)], vectors[ids.index(query)]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert hits / total >= 0.9


def test_copies_of_queries_for_every_shard_are_not_broadcast(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = ann.neighbours(df, df.filter("vec_id % 50 = 0"), shard_size=150)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(40)] + [(2000, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine")).withColumn("vector", F.lit(0))
    found = defaultdict(list)
    for r in ann.neighbours(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert found[0] == [7, 50, 1000, 1001, 1002] and found[50] == [0, 7, 1000, 1001, 1002]
    assert found[1000] == [0, 7, 50, 1001, 1002] and found[2000] == [0, 7, 50, 1000, 1001] and 100 not in found
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0


# -- pipeline and registry ------------------------------------------------------------------


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    docs = documents(spark)
    copy = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10000)
    secret = docs.limit(1).withColumn("doc_id", F.lit(20000).cast("long")).withColumn("text", F.concat("text", F.lit(" changed password=abcdef123")))
    rude = docs.limit(1).withColumn("doc_id", F.lit(30000).cast("long")).withColumn("text", F.lit("you worthless idiot, pathetic stupid scum " * 3))
    docs = docs.unionAll(copy).unionAll(secret).unionAll(rude).withColumn("_row", F.lit(1)).withColumn("copies", F.lit("mine"))
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert docs.columns == columns
            docs = corpus_pipeline.materialize(docs, name)
            held.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean, single, masked, mixed = held
    assert 30000 not in clean and len(clean) > 150
    assert set(single) == {i for i, (_, c) in brute_components(clean).items() if i == c} and not {10000, 10001, 10002} & set(single)
    assert set(masked) == set(single)
    assert all(masked[i] == single[i] or "[secret]" in masked[i] for i in single)
    assert set(mixed) <= set(masked)
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(mixed) and max(r["offset"] + r["length"] for r in pieces) <= 2048


def test_pipeline_on_empty_and_null_rows(spark):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], documents(spark).schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), name)
        ids = sorted(r["doc_id"] or 0 for r in docs.collect())
        # a source without words has a target of none, so the mix takes nothing of it
        assert ids == {"toxicity": [0, 1, 1], "near_duplicates": [0, 1], "secrets": [0, 1]}.get(name, [])


@pytest.mark.parametrize("rows,stay", [
    ([(None, 1), (None, 2), (5, 1)], [(5, 1), (None, 2)]),
    ([(9, 1), (9, 2), (5, 2)], [(9, 1), (5, 2)]),
    ([(3, 1), (3, 1), (None, 1), (None, 0), (4, 0), (4, 0)], [(3, 1), (None, 0), (4, 0)]),
])
def test_one_row_of_each_group_whatever_the_ids(spark, rows, stay):
    texts = {0: "", 1: " ".join(f"one{i}" for i in range(60)), 2: " ".join(f"two{i}" for i in range(60))}
    docs = spark.createDataFrame([(i, texts[t], "en", "s", 1) for i, t in rows], documents(spark).schema)
    kept = [(r["doc_id"], next(t for t in texts if texts[t] == r["text"])) for r in corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()]
    assert sorted(kept, key=str) == sorted(stay, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


def test_every_operator_and_the_pipeline_are_registered(spark):
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names
    assert queries.QUERIES.keys() <= names.keys()
