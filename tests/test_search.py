import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.functions import scores as S
from lexigraph.operators import graph as G, ranking as R
from lexigraph.plans import search
from lexigraph.sources.sinks import results_envelope

NODE_SCHEMA = (
    "uuid string, name string, summary string, labels array<string>, attributes map<string,string>, "
    "created_at timestamp, valid_at timestamp, invalid_at timestamp"
)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        ("a", "Kamala Harris", "Attorney General of California", ["Entity", "PER"], {"term_start": "January 3, 2011", "name_embedding": "0.1"}, None, None, None),
        ("b", "California", "A state", ["Entity", "LOC"], {"kind": "state"}, None, None, None),
        ("c", "Senate", "Chamber of California Attorney people", ["Entity", "ORG"], {}, None, None, None),
        ("d", "", "California general attorney", ["Entity"], {}, None, None, None),
    ] + [(f"h{i}", f"Hub Guest {i}", "guest", ["Entity", "PER"], {}, None, None, None) for i in range(30)]
    edges = [("a", "b", "LIVES_IN"), ("a", "c", "WORKS_AT"), ("c", "b", "PART_OF"), ("a", "a", "SELF"), ("a", "b", "LIVES_IN")]
    edges += [(f"h{i}", "b", "VISITS") for i in range(30)]
    return spark.createDataFrame(nodes, NODE_SCHEMA).cache(), spark.createDataFrame(edges, G.EDGE_SCHEMA).cache()


def test_degree_neighbours_and_types(graph):
    nodes, edges = graph
    degree = {r.uuid: r.degree for r in G.degree(nodes, edges).collect()}
    assert (degree["a"], degree["b"], degree["c"], degree["d"]) == (4, 33, 2, 0)
    pairs = {(r.uuid, r.neighbour) for r in G.neighbours(nodes, edges).collect()}
    assert {n for u, n in pairs if u == "a"} == {"a", "b", "c"}
    assert len({n for u, n in pairs if u == "b"}) == 32
    types = {r.uuid: r.relationship_types for r in G.relationship_types(edges).collect()}
    assert types["a"] == ["LIVES_IN", "SELF", "WORKS_AT"]
    assert G.stats(nodes, edges).first().asDict() == {"nodes": 34, "relationships": 35}


def test_clear_twice(spark, graph, tmp_path):
    nodes, edges = graph
    G.write(nodes, edges, str(tmp_path))
    G.write(nodes, edges, str(tmp_path))
    assert G.clear(spark, str(tmp_path), nodes.schema) == {"nodes": 68, "relationships": 70, "remaining": 0}
    assert G.clear(spark, str(tmp_path), nodes.schema)["nodes"] == 0


def test_build_links_neighbouring_mentions(spark):
    rows = [(1, "Ana Maria met John Smith. Rosa Luna came.", None), (2, "ana Ana Maria again", None)]
    nodes, edges = G.build(spark.createDataFrame(rows, "episode_id long, content string, reference_time timestamp"))
    names = {r.uuid: r.name for r in nodes.collect()}
    linked = {(names[e.src], names[e.dst], e.rel_type) for e in edges.collect()}
    assert ("Ana Maria", "John Smith", "CO_MENTION") in linked
    assert {x for x in linked if x[2] == "PART_OF" and x[0] == "Ana Maria"} == {
        ("Ana Maria", "Episode 1", "PART_OF"), ("Ana Maria", "Episode 2", "PART_OF"),
    }
    assert not any(x[:2] == ("John Smith", "Rosa Luna") for x in linked)


@pytest.mark.parametrize(
    "year, attributes, valid, invalid, expected",
    [
        (None, {}, None, None, 1.0),
        (2015, {"term_start": "2011-2017"}, None, None, 1.0),
        (2015, {"term_start": "in 2015"}, None, None, 1.0),
        (2019, {"term_start": "2011-2017"}, None, None, 0.5),
        (2015, {"other": "2015"}, None, None, 0.5),
        (2020, {}, "2011-01-03", "2017-01-03", 0.3),
        (2015, {}, "2011-01-03", "2017-01-03", 1.0),
        (2020, {}, "2011-01-03", None, 0.8),
        (2000, {}, "2011-01-03", None, 0.5),
        (2020, {"date": "x-y"}, None, None, 0.5),
    ],
)
def test_temporal_score(spark, year, attributes, valid, invalid, expected):
    df = spark.createDataFrame([(year, attributes, valid, invalid)], "y int, a map<string,string>, v string, i string")
    cast = lambda c: F.col(c).cast("timestamp")
    assert df.select(S.temporal_score(F.col("y"), F.col("a"), cast("v"), cast("i"))).first()[0] == expected


def test_entity_type_score(one):
    who = {"PER": 2.0, "ORG": 0.5, "LOC": 0.3, "DATE": 0.8}
    weights = F.create_map(*[F.lit(x) for p in who.items() for x in p])
    entry = lambda t, n: F.struct(F.lit(t).alias("type"), F.lit(n).alias("n"))
    score = lambda *e: one("x", lambda c: S.entity_type_score(weights, F.array(*e)))
    assert score(entry("PER", 1), entry("LOC", 1)) == pytest.approx(1.15)
    assert score(entry("LOC", 3)) == 0.5
    assert score(entry("FAC", 2)) == 1.0
    none = F.expr("cast(map() as map<string,double>)")
    assert one("x", lambda c: S.entity_type_score(none, F.array(entry("PER", 1)))) == 1.0


def test_names_are_matched_through_trigrams(spark):
    """Against every pair: short terms, terms without a trigram in any name, repeated grams and non-ASCII."""
    names = ["order 1", "orders of banana", "ab", "", None, "ananan", "café crème", "x y z", "aaa", "customer#00001", "😀 smile"]
    terms = ["order", "an", "a", "anan", "fé", "zzz", "crème", "y", "aaaa", "customer#00001", "😀 ", "order", ""]
    rows = spark.createDataFrame([(f"n{i}", n) for i, n in enumerate(names)], "uuid string, name string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted(tuple(r) for r in R.name_matches(rows, asked).distinct().collect())
    assert got == sorted({(f"n{i}", t) for i, n in enumerate(names) if n for t in terms if t and t in n})
    assert R.name_matches(rows, asked.where("term = ''")).count() == 0


def test_hub_with_many_neighbours_and_terms(spark):
    """10^5 neighbours and 10^3 terms: what is tried is what shares a rare trigram, far from every pair."""
    n, m = 100_000, 1000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("uuid"), F.concat(F.lit("Name#"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"))
    nodes = nodes.unionByName(spark.createDataFrame([("hub", "Hub")], "uuid string, name string"))
    edges = spark.range(n).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"))
    terms = [f"{7 * i:07d}" for i in range(m - 2)] + ["absent", "name#"]
    questions = spark.createDataFrame([(1, terms), (2, ["hub", "9999999"])], "query_id long, important_terms array<string>")
    candidates = spark.createDataFrame([(1, "hub"), (2, "hub"), (2, "5")], "query_id long, uuid string")
    hits = {(r["query_id"], r["uuid"]): r["neighbour_hits"] for r in R.neighbour_hits(candidates, questions, nodes, edges).collect()}
    assert hits == {(1, "hub"): m - 1, (2, "5"): 1}


def walked(edges, source, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, front = {source: 0}, {source}
    for h in range(1, most + 1):
        front = {o for u in front for o in near.get(u, ())} - set(hops)
        hops.update(dict.fromkeys(front, h))
    return hops


def test_distances_along_a_chain_and_past_a_hub(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)]
    hub = [("hub", f"leaf{i:05d}") for i in range(3000)] + [("c3", "hub"), ("leaf00000", "far"), ("c1", "c1"), ("c5", "c3")]
    edges = spark.createDataFrame([(a, b, "x") for a, b in chain + hub], "src string, dst string, rel_type string")
    centers = spark.createDataFrame([(1, "c0"), (2, "c3"), (3, "c0"), (4, "nowhere"), (5, None)], "query_id long, center string")
    for most in (1, 4, 50):
        got = {}
        for r in G.distances(centers, edges, most).collect():
            assert r["uuid"] not in got.setdefault(r["query_id"], {})
            got[r["query_id"]][r["uuid"]] = r["hops"]
        assert got == {q: walked(chain + hub, c, most) for q, c in ((1, "c0"), (2, "c3"), (3, "c0"), (4, "nowhere"))}


def test_rank_by_distance_from_the_center(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("e", "f", "x")], "src string, dst string, rel_type string")
    found = spark.createDataFrame([(1, "b", 0.9), (1, "c", 0.1), (1, "d", 0.2), (1, "e", 0.8), (1, "a", 0.05), (2, "e", 0.3), (2, "zz", 0.4)], "query_id long, uuid string, score double")
    rows = sorted((r["query_id"], r["rank"], r["uuid"], r["hops"]) for r in search.by_distance(found, edges, 2).collect())
    # the best-scored edge of the first question comes from a; the second has no edge into a hit
    assert rows == [(1, 1, "a", 0), (1, 2, "b", 1), (1, 3, "c", 2), (1, 4, "e", None), (1, 5, "d", None), (2, 1, "zz", None), (2, 2, "e", None)]


def test_weights_are_checked():
    assert R.Weights().semantic == pytest.approx(0.30)
    with pytest.raises(ValueError):
        R.Weights(0.5, 0.5, 0.2, 0.0)
    with pytest.raises(ValueError):
        R.Weights(connection=-0.1)


def test_final_score_formula(spark):
    df = spark.createDataFrame([(0.8, 0.6, 1.0, 0.7, 2.0)], "original_score double, connection_score double, temporal_score double, query_match_score double, entity_type_score double")
    base, final = R.final_score(R.Weights())
    assert df.select(base, final).first()[:] == pytest.approx((0.67, 0.7705))


def test_question_aware_search(graph, spark):
    nodes, edges = graph
    questions = spark.createDataFrame([(1, "Who was the California Attorney General in 2011?"), (2, "hub guest")], "query_id long, query string")
    postings = R.lexical_postings(nodes, F.concat_ws(" ", "name", "summary"))
    rows = search.answer(questions, postings, nodes, edges)
    by_query = {}
    for r in rows.collect():
        by_query.setdefault(r.query_id, []).append(r)
    found = {r.uuid: r for r in by_query[1]}
    assert set(found) == {"a", "b", "c", "d"}
    assert found["b"].connection_score == 1.0 and found["d"].connection_score == 0.0
    # a: terms california, attorney, general: none in the name, all in the summary, california among neighbours.
    assert found["a"].query_match_score == pytest.approx((0 + 0 + 1.5 + 1 / 3 + 0 + 0) / 9)
    assert found["b"].query_match_score == pytest.approx((3 + 2 + 0 + 0 + 0 + 0) / 9)
    assert found["d"].query_match_score == pytest.approx(1.5 / 9)  # an empty name matches nothing
    assert found["a"].temporal_score == 1.0 and found["b"].temporal_score == 0.5
    # a: two runs of capitalised words ("Kamala Harris Attorney General", "California January") and two dates.
    assert found["a"].entity_type_score == pytest.approx((2.0 * 2 + 0.8 * 2) / 4)
    assert len(by_query[2]) == 20  # the candidate limit
    ranked = sorted(by_query[1], key=lambda r: r["rank"])
    assert [r.final_score for r in ranked] == sorted((r.final_score for r in ranked), reverse=True)

    answer = {r.uuid: r for r in search.response(rows, 3).collect() if r.query_id == 1}
    assert len(answer) == 3 and "name_embedding" not in (answer["a"].attributes if "a" in answer else {})
    with pytest.raises(ValueError):
        search.response(rows, 101)
    envelope = {r.query_id: r for r in results_envelope(rows, "question-aware").collect()}
    assert envelope[1].total_results == 4 and [x["rank"] for x in envelope[1].results] == [1, 2, 3, 4]
    pages = search.connection_pages(rows, G.neighbours(nodes, edges), G.degree(nodes, edges), page_size=10).collect()
    hub = [p for p in pages if p.uuid == "b"]
    assert len(hub) > 1 and sum(len(p.entities) for p in hub) == 32


def test_connection_search(spark, graph):
    candidates = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.8), (2, "d", None)], "query_id long, uuid string, score double")
    rows = {r.uuid: r for r in search.by_connection(candidates.withColumn("rank", F.lit(1)), graph[1], 0.3).collect()}
    assert rows["b"].final_score == pytest.approx(0.7 * 0.8 + 0.3)
    assert rows["a"].final_score == pytest.approx(0.7 * 0.8 + 0.3 * 4 / 33)
    assert rows["d"].final_score == pytest.approx(0.7)


def test_bm25_by_hand(spark):
    texts = {"x": "red apple red", "y": "green apple", "z": "blue sky over green hills"}
    nodes = spark.createDataFrame(list(texts.items()), "uuid string, text string")
    questions = spark.createDataFrame([(1, "red green apple apple")], "query_id long, query string")
    found = {r.uuid: r.score for r in R.bm25(questions, R.lexical_postings(nodes, F.col("text"))).collect()}
    tokens = {u: t.split() for u, t in texts.items()}
    mean = sum(map(len, tokens.values())) / 3
    for uuid, toks in tokens.items():
        total = 0.0
        for word in ("red", "green", "apple"):
            df, tf = sum(word in t for t in tokens.values()), toks.count(word)
            total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))
        assert found[uuid] == pytest.approx(total)


@pytest.mark.parametrize("limit", [16_384, 3])
def test_vector_top_k_is_exact(spark, limit):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(200)]
    vectors[50:120] = [vectors[50]] * 70  # a third of the nodes are copies
    asked = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(7)] + [vectors[50]]
    nodes = spark.createDataFrame([(f"n{i:03d}", v) for i, v in enumerate(vectors)], "uuid string, embedding array<float>").repartition(5)
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<double>")
    found = {}
    for r in R.vector_top_k(questions, nodes, 10, limit).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.uuid))
    held = np.array(vectors, dtype="float32").astype("float64")
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    for i, q in enumerate(asked):
        score = np.round(held @ (np.array(q) / np.linalg.norm(q)), 9)
        order = sorted(range(200), key=lambda j: (-score[j], j))[:10]
        assert sorted(found[i]) == [(k + 1, f"n{j:03d}") for k, j in enumerate(order)]


def test_fusion(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, uuid string, rank int")
    rows = R.fuse([ranked([(1, "a", 1), (1, "b", 2)]), ranked([(1, "b", 1), (1, "c", 2)])], 2).orderBy("rank").collect()
    assert [(r.uuid, r["rank"]) for r in rows] == [("b", 1), ("a", 2)]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62)


def small_index(spark):
    words = ["apple", "pear", "plum", "fig", "quince"]
    nodes = [(f"n{i:02d}", " ".join(words[j % 5] for j in range(i, i + 3)) + f" own{i}") for i in range(40)]
    df = spark.createDataFrame(nodes, "uuid string, text string")
    return df, R.lexical_postings(df, F.col("text"))


def test_a_shorter_answer_is_the_start_of_a_longer_one(spark):
    nodes, postings = small_index(spark)
    vectors = nodes.select("uuid", F.array(*[F.pmod(F.xxhash64("uuid", F.lit(i)), F.lit(100)).cast("double") for i in range(4)]).alias("embedding"))
    asked = spark.createDataFrame([(1, "apple plum", [1.0, 2.0, 3.0, 4.0]), (2, "fig", None)], "query_id long, query string, vector array<double>")
    deep = search.hybrid(asked, postings, vectors, limit=20).orderBy("query_id", "rank").collect()
    short = search.standard(asked, postings, vectors, limit=5).orderBy("query_id", "rank").collect()
    assert short == [r for r in deep if r["rank"] <= 5] and len(short) == 10
    with pytest.raises(ValueError):
        search.hybrid(asked, postings, limit=20, depth=5)


def test_score_blocks_stay_within_their_budget():
    for queries in (1, 100, 16384, 1 << 20):
        blocks = R.score_blocks(queries, 10_000)
        assert sum(len(b) for b in blocks) == 10_000
        assert max(8 * queries * len(b) for b in blocks) <= max(R.SCORE_BYTES, 8 * queries)


def test_vectors_in_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "SCORE_BYTES", 8 * 3 * 7)
    nodes = [(f"n{i:03d}", [float((i * k) % 17 - 8) for k in (1, 2, 3)]) for i in range(1, 120)]
    asked = [(q, [1.0, float(q), 2.0]) for q in range(3)]
    import numpy as np

    unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit([v for _, v in asked]) @ unit([v for _, v in nodes]).T, 9)
    expected = {q: [nodes[i][0] for i in sorted(range(len(nodes)), key=lambda i: (-scores[q, i], nodes[i][0]))[:6]] for q, _ in asked}
    frames = spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(nodes, "uuid string, embedding array<double>")
    for shared in (R.SHARED_BYTES, 2 * 8 * 3):
        found = {}
        for r in R.vector_top_k(*frames, 6, shared_bytes=shared).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["uuid"])
        assert found == expected


def test_hub_neighbours_are_matched(spark):
    nodes = spark.createDataFrame([("hub", "Hub")] + [(f"n{i}", f"Leaf {i}") for i in range(200)], "uuid string, name string")
    edges = spark.createDataFrame([("hub", f"n{i}", "x") for i in range(200)] + [("n0", "n1", "x")], "src string, dst string, rel_type string")
    asked = spark.createDataFrame([(1, ["leaf 19", "nothing", "hub"]), (2, ["hub"])], "query_id long, important_terms array<string>")
    found = spark.createDataFrame([(1, "hub"), (2, "n5"), (2, "hub")], "query_id long, uuid string")
    hits = {(r["query_id"], r["uuid"]): r["neighbour_hits"] for r in R.neighbour_hits(found, asked, nodes, edges).collect()}
    assert hits == {(1, "hub"): 1, (2, "n5"): 1}
    degrees = {r["uuid"]: r["degree"] for r in R.candidate_degree(found, edges).collect()}
    assert degrees == {"hub": 200, "n5": 1}


def test_shared_postings_give_the_rows_of_plain_ones(spark):
    texts = ["Order %d with priority low", "Order %d with status late", "customer %d of the late order", "<b>Part</b> %d, of 7 orders", "%d"]
    rows = [(f"n{i:03d}", texts[i % 5] % i) for i in range(120)] + [("m", None), ("z", "late late order"), ("a", "late late order")]
    nodes = spark.createDataFrame(rows, "uuid string, text string")
    questions = spark.createDataFrame([(1, "late order"), (2, "priority customer"), (3, "nothing here"), (4, "part")], "query_id long, query string")
    shared = R.shared_postings(nodes, F.col("text"), 30)
    found = lambda p, limit: {(r.query_id, r["rank"], r.uuid, round(r.score, 9)) for r in R.bm25(questions, p, limit).collect()}
    for limit in (1, 7, 30):
        assert found(shared, limit) == found(R.lexical_postings(nodes, F.col("text")), limit)
    assert shared.table.select("profile").distinct().count() == 5  # a text is scored once, whatever its copies
    assert shared.members.groupBy("profile").count().agg(F.max("count")).first()[0] <= 30
    with pytest.raises(ValueError):
        R.bm25(questions, shared, 31)


@pytest.mark.parametrize("few", [200_000, 0])
def test_ends_and_distances_of_wanted_nodes(spark, monkeypatch, few):
    monkeypatch.setattr(G, "SHARED_IDS", few)
    pairs = [("a", "b"), ("a", "b"), ("b", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), (None, "b"), ("b", None), ("x", "y")]
    pairs += [("hub", f"l{i}") for i in range(50)] + [("c", "hub")]
    edges = spark.createDataFrame([(a, b, f"k{i % 3}") for i, (a, b) in enumerate(pairs)], G.EDGE_SCHEMA)
    wanted = spark.createDataFrame([("b",), ("hub",), ("none",)], "uuid string")
    every = {(r.uuid, r.other, r.rel_type) for r in G._ends(edges).collect() if r.uuid in ("b", "hub")}
    rows = [(r.uuid, r.other, r.rel_type) for r in G.ends(edges, wanted).collect()]
    assert set(rows) == every and len(rows) == 57
    kinds = lambda df: {(r.uuid, tuple(r.relationship_types)) for r in df.collect()}
    assert kinds(G.relationship_types(edges, wanted)) == {k for k in kinds(G.relationship_types(edges)) if k[0] in ("b", "hub")}
    centers = spark.createDataFrame([(1, "a"), (2, "e"), (3, None), (4, "l7")], "query_id long, center string")
    targets = spark.createDataFrame([(1, "d"), (1, "a"), (1, "hub"), (1, "f"), (2, "b"), (2, "f"), (3, "a"), (4, "l9"), (4, "d"), (4, "x")], "query_id long, uuid string")
    asked = {tuple(r) for r in targets.collect()}
    for most in (1, 2, 3):
        whole = {(r.query_id, r.uuid, r.hops) for r in G.distances(centers, edges, most).collect()}
        near = [(r.query_id, r.uuid, r.hops) for r in G.distances(centers, edges, most, targets).collect()]
        assert set(near) == {r for r in whole if r[:2] in asked} and len(near) == len(set(near))
    assert {r for r in whole if r[0] == 1} >= {(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (1, "hub", 3)}
