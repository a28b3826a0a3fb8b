import json

from pyspark.sql import functions as F

from lexigraph.functions import entities as E
from lexigraph.operators import verify as V
from lexigraph.plans.extract import keywords_of
from lexigraph.session import scratch_dir
from lexigraph.sources import files, sinks
from lexigraph.sources.html import parse_pages
from lexigraph.operators.keywords import KeywordOptions
from lexigraph.streaming import ingest as stream

EPISODES = [
    {"content": "Kamala Harris met Ana Maria.", "type": "text", "description": "speech"},
    {"content": {"name": "Gavin Newsom", "state": "California", "start_date": "2019-01-07"}, "type": "json", "description": "profile"},
    {"content": "no type"},
    {"content": "odd type", "type": "audio"},
]


def test_episodes_and_stream_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "episodes.json").write_text(json.dumps(EPISODES))
    rows = files.episodes(spark, str(tmp_path / "in")).collect()
    assert [r.type for r in rows] == ["text", "json", "text", "text"]
    assert json.loads(rows[1].content)["name"] == "Gavin Newsom"
    assert rows[2].description == "No description"
    stream.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("reference_time").collect()
    batch = stream.prepared(files.episodes(spark, str(tmp_path / "in"))).drop("reference_time").collect()
    assert sorted(streamed, key=str) == sorted(batch, key=str)
    bodies = {r.body for r in streamed}
    assert "Kamala Harris met Ana Maria.\n\n[ENTITIES: PER: Kamala Harris, Ana Maria]" in bodies


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"line one\r\n\r\nline three\nlast")
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte\n")
    rows = {r.metadata.filename: r for r in files.text_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "line one\n\nline three\nlast"
    assert (rows["a.txt"].metadata.line_count, rows["a.txt"].metadata.file_size) == (4, 27)
    assert rows["b.txt"].text == "bad � byte\n" and rows["b.txt"].metadata.line_count == 1
    cut = {r.metadata.filename: r.text for r in files.text_files(spark, str(tmp_path), max_length=4).collect()}
    assert cut["a.txt"] == "line"
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "c.txt").write_bytes("café".encode("latin-1"))
    assert files.text_files(spark, str(tmp_path / "latin"), encoding="iso-8859-1").first().text == "café"


def test_validation(spark, tmp_path):
    (tmp_path / "full.txt").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    paths = spark.createDataFrame([(f"{tmp_path}/{n}.txt",) for n in ("full", "empty", "missing")], "path string")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.validate(spark, str(tmp_path), paths).collect()}
    assert rows["full.txt"].valid and rows["full.txt"].error is None and rows["full.txt"].length == 1
    for name in ("empty.txt", "missing.txt"):
        assert not rows[name].valid and name in rows[name].error


def test_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('Name;Age;City\nAnn;30;"New; York"\nBob;;Rome\n')
    rows = files.csv_rows(spark, str(path), delimiter=";")
    lines = [r.line for r in files.csv_lines(rows, include_headers=False).orderBy("pos").collect()]
    assert lines == ["Ann | 30 | New; York", "Bob |  | Rome"]
    assert files.csv_lines(rows).count() == 3
    table = files.csv_tables(rows, delimiter=";").first()
    assert (table.headers, table.row_count, table.column_count, table.delimiter, table.has_headers) == (["Name", "Age", "City"], 2, 3, ";", True)


def test_csv_files_keep_their_own_headers_and_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Age\nAnn,30\nBob,31,extra\n")
    (tmp_path / "b.csv").write_bytes(b"City,Zip,Land\r\nRome\r\n,00100,\r\n")
    (tmp_path / "c.csv").write_text("Only,Header\n")
    rows = files.csv_rows(spark, str(tmp_path))
    found = sorted((r._source, r.header, r.cells) for r in rows.collect())
    assert found == [
        ("a.csv", False, ["Ann", "30"]), ("a.csv", False, ["Bob", "31", "extra"]), ("a.csv", True, ["Name", "Age"]),
        ("b.csv", False, ["", "00100", ""]), ("b.csv", False, ["Rome"]), ("b.csv", True, ["City", "Zip", "Land"]),
        ("c.csv", True, ["Only", "Header"]),
    ]
    tables = {r._source: (r.headers, r.row_count, r.column_count) for r in files.csv_tables(rows).collect()}
    assert tables == {"a.csv": (["Name", "Age"], 2, 2), "b.csv": (["City", "Zip", "Land"], 2, 3), "c.csv": (["Only", "Header"], 0, 2)}
    capped = files.csv_tables(files.csv_rows(spark, str(tmp_path), max_rows=2)).collect()
    assert sorted((r._source, r.row_count) for r in capped) == [("a.csv", 1), ("b.csv", 1), ("c.csv", 0)]
    bare = files.csv_tables(files.csv_rows(spark, str(tmp_path), has_headers=False)).collect()
    assert sorted((r._source, r.row_count, r.headers, r.has_headers) for r in bare) == [
        ("a.csv", 3, None, False), ("b.csv", 3, None, False), ("c.csv", 1, None, False)
    ]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('k,v\n1,"two\nlines"\n2,"said ""no"""\n3,""\n,x\n')
    rows = files.csv_rows(spark, str(path), multi_line=True)
    assert [r.cells for r in rows.orderBy("pos").collect()] == [["k", "v"], ["1", "two\nlines"], ["2", 'said "no"'], ["3", ""], ["", "x"]]


def test_broken_episode_files_become_error_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps([{"episode_id": 1, "content": "Ann met Bob Stone.", "type": "text"}]))
    (folder / "bad.json").write_text('[{"episode_id": 2, "content": "x"}, {"episode_id": ')
    rows = files.episodes(spark, str(folder)).collect()
    assert sorted((r.content or "", r.error is None) for r in rows if r.content != "x") == [("", False), ("Ann met Bob Stone.", True)]
    stream.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert any(r.error is None and "Ann" in r.body for r in stored) and any(r.error is not None for r in stored)


def test_attributes_end_at_the_quote_that_opened_them(spark):
    page = """<html><head><meta name="description" content="Bob's shop"></head><a href="it's.html">x</a><a href='say "hi"'>y</a></html>"""
    row = parse_pages(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert row.metadata.description == "Bob's shop" and row.metadata.links == ["it's.html", 'say "hi"']


def test_sheets_in_pages_are_the_whole_sheet(spark):
    cells = spark.createDataFrame(
        [("f", "S1", i, [str(i), None if i == 1 else "x"]) for i in range(5)] + [("f", "S2", 0, ["9", "y"])],
        "source string, sheet string, row_idx int, cells array<string>",
    )
    whole = "\n\n".join(r.text for r in files.render_tables(cells, ["a", "b"]).orderBy("sheet", "page").collect())
    assert whole.startswith("=== Sheet: S1 ===\na | b\n" + "-" * 80 + "\n0 | x\n1 | \n2 | x")
    assert "\n\n=== Sheet: S2 ===\n" in whole
    paged = files.render_tables(cells, ["a", "b"], sheets=["S1"], rows_per_page=2).orderBy("page").collect()
    assert len(paged) == 3 and "\n".join(p.text for p in paged) == whole.split("\n\n")[0]
    assert files.render_tables(cells, max_rows_per_sheet=1).where("sheet = 'S1'").first().text == "=== Sheet: S1 ===\n0 | x"


def test_corpus(spark, tmp_path):
    texts = ['roses "bloom"', "tulips\nlate", ""]
    (tmp_path / "list.json").write_text(json.dumps(texts, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(t) for t in texts) + "\n")
    assert [r.text for r in files.corpus(spark, str(tmp_path / "list.json")).collect()] == texts
    assert [r.text for r in files.corpus(spark, str(tmp_path / "lines.json"), lines=True).collect()] == texts


def test_html(spark):
    html = (
        '<html><head><title>A &amp; B</title><meta name="description" content="about"><style>p{}</style></head><body><script>x()</script>'
        '<p>Intro</p><h1>One</h1><p>First <a href="/x">link</a></p><h2>Two</h2>Second<!-- no --></body></html>'
    )
    row = parse_pages(spark.createDataFrame([(1, "http://e.com", html)], "page_id long, url string, html string")).first()
    assert row.text == "Intro One First link Two Second"
    assert (row.metadata.title, row.metadata.description, row.metadata.keywords, row.metadata.links) == ("A & B", "about", None, ["/x"])
    assert row.pages == ["Intro", "One First link", "Two Second"]
    kept = parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), remove_scripts=False).first()
    assert "x()" in kept.text


def test_keyword_chain_and_sink(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ana Maria writes software. Software helps Ana Maria.")], "doc_id long, text string")
    assert keywords_of(docs, method="ner").first().keyword == "Ana Maria"
    options = KeywordOptions(method="combined", num_keywords=20)
    out = sinks.keywords_envelope(keywords_of(docs), options, verified=True)
    sinks.write_json(out, str(tmp_path / "kw"))
    row = json.loads(spark.read.text(str(tmp_path / "kw")).first().value)
    assert row["method"] == "combined" and row["num_keywords"] == len(row["keywords"]) and row["verified"] is True
    assert row["parameters"]["num_keywords"] == 20 and row["keywords"][0]["rank"] == 1


ANSWER_TEXT = "Ana Maria met John Smith in 1999."


def test_json_answers(one):
    answer = 'Sure:\n[ {"text": "Ana Maria", "type": "PER", "reasoning": "a person"},\n {"entity": "1999", "type": "REMOVE", "verified": false}, ]'
    got = [(v["text"], v["type"], v["verified"], v["reasoning"]) for v in one(answer, V.json_verdicts)]
    assert got == [("Ana Maria", "PER", True, "a person"), ("1999", "REMOVE", False, "")]
    assert one("nothing", V.json_verdicts) is None


def test_markdown_answers(spark):
    answer = "**Organizations (ORG)**\n*   Smith (works)\n- Elastic Search\nnot a bullet\n\n**People/Entities (PER)**\n• ana maria\n"
    df = spark.createDataFrame([(1, ANSWER_TEXT, answer)], "doc_id long, text string, response string")
    rows = V.parse_responses(df.withColumn("entities", E.pattern_mentions(F.col("text")))).collect()
    assert [(r.text, r.type, r.confidence) for r in rows] == [("John Smith", "ORG", 1.0), ("Elastic Search", "ORG", 0.8), ("Ana Maria", "PER", 1.0)]


def test_apply_verdicts(spark):
    docs = spark.createDataFrame([(1, ANSWER_TEXT), (2, ANSWER_TEXT)], "doc_id long, text string")
    answer = '[{"text":"ana  maria","type":"ORG","reasoning":"a firm"},{"text":"1999","type":"REMOVE"},{"text":"Smith","type":"PER"}]'
    answers = spark.createDataFrame([(1, answer)], "doc_id long, r string").select("doc_id", V.json_verdicts(F.col("r")).alias("verdicts"))
    rows = {(r.doc_id, r.keyword): r for r in V.apply_verdicts(docs, answers, model="M").collect()}
    assert (rows[1, "Ana Maria"].type, rows[1, "Ana Maria"].status, rows[1, "Ana Maria"].reasoning) == ("ORG", "verified", "a firm")
    assert (rows[1, "John Smith"].status, rows[1, "John Smith"].reasoning) == ("verified", "Verified as PER by LLM model M")
    assert rows[1, "1999"].status == "Not verified"
    assert rows[2, "Ana Maria"].reasoning == "Verification unavailable - using original classification"
    dropped = V.apply_verdicts(docs, answers, drop_removed=True).where("doc_id = 1").collect()
    assert {r.keyword for r in dropped} == {"Ana Maria", "John Smith"}


def test_requests(spark):
    docs = spark.createDataFrame([(1, "Ana Maria left. Nothing here. In 1999 she came.")], "doc_id long, text string")
    rows = V.requests(docs, blocksize=2).orderBy("block_index").collect()
    assert [r.block_index for r in rows] == [0, 1]
    assert json.loads(rows[0].entities_json) == [{"text": "Ana Maria", "type": "PER", "sent": "Ana Maria left.", "verified": False}]
    assert rows[1].definitions.endswith("- DATE: Dates indicate absolute or relative dates or periods.")
    assert rows[0].block_text == "Ana Maria left. Nothing here." and rows[0].request.count("\n\n") == 3


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark) == scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_temporary_tables_go_and_those_that_stay_stay(spark):
    from lexigraph.session import exists, materialize, temporary

    rows = spark.range(5)
    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    with temporary(spark):
        outer = path(materialize(rows, "outer"))
        with temporary(spark):
            inner, kept = path(materialize(rows, "inner")), materialize(rows, "kept", stays=True)
            held = path(kept)
        assert not exists(spark, inner) and exists(spark, outer) and kept.count() == 5
        last = materialize(rows, "last", stays=True)
    assert not exists(spark, outer) and not exists(spark, held) and last.count() == 5

