"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import ORACLES, QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert compare(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "rank", "keyword", "score", "type"]


def test_every_query_is_checked():
    assert QUERIES.keys() == ORACLES.keys()


def test_titles_hold_any_entity(spark, tmp_path):
    page = "<html><head><title>a &quot;b&quot; &#39;c&#39;&nbsp;&amp; &lt;d&gt;</title></head><body>x</body></html>"
    spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    here = connect_folder(tmp_path, "pages")
    df = entry.queries()["src_pages_html"](spark, str(tmp_path))
    assert df.first()["title"] == "a \"b\" 'c' & <d>" and compare(df, here, entry.oracle_sql()["src_pages_html"]) is None


def test_an_answer_that_lists_an_entity_twice_has_two_verdicts(spark, tmp_path):
    orders = "select 7L as o_orderkey, 1996L as o_custkey, timestamp'1995-03-04 00:00:00' as o_orderdate"  # customer 1996, due in 1996
    spark.sql(orders).write.parquet(str(tmp_path / "orders.parquet"))
    here = connect_folder(tmp_path, "orders")
    df = entry.queries()["verify_parse_markdown"](spark, str(tmp_path))
    assert [r.text for r in df.collect()].count("1996") == 2 and compare(df, here, entry.oracle_sql()["verify_parse_markdown"]) is None


def connect_folder(folder, name):
    here = duckdb.connect()
    here.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return here


def test_episodes_beyond_the_year_9999(spark, tmp_path):
    rows = [(5, "Ana Maria met Gavin Newsom.", "web"), (3_080_000, "Gavin Newsom left.", "web"), (3_080_001, "Bea Lopez left.", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    here = connect_folder(tmp_path, "documents")
    for name in ("graph_build_nodes", "graph_upkeep_nodes"):
        df = entry.queries()[name](spark, str(tmp_path))
        assert compare(df, here, entry.oracle_sql()[name]) is None
