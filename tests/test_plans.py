"""Plans that the operators rely on: pruned scans, pushed filters, no Python where none is needed."""

import build as B
from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.operators import paging as P
from lodestack.operators import references as R
from lodestack.operators import search as Q
from lodestack.sources.facts import Facts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_search_prunes_and_pushes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(Q.counts(docs, "doc_id", "text", "the"))
    assert "StringContains(text,the)" in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_matches_filter_before_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(Q.matches(docs, "doc_id", "text", "the"))
    assert "StringContains(text,the)" in text and text.index("MapInArrow") < text.index("Filter")


def test_lookup_is_a_semi_join_on_a_filtered_pool(spark, small):
    pool = spark.read.parquet(f"{small}/part.parquet").withColumnRenamed("p_partkey", "l_partkey")
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_partkey")
    text = plan(R.holding(lines, pool, ["l_partkey"], F.col("p_size") > 40))
    assert "LeftSemi" in text and "GreaterThan(p_size,40)" in text and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_a_page_is_a_top_k(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id")
    assert "TakeOrderedAndProject(limit=30" in plan(P.page(docs, ["doc_id"], 10, 20))


def test_numbering_has_no_task_for_all_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id")
    text = plan(P.positions(docs, ["doc_id"]))
    assert "windowspecdefinition(_range" in text


def test_traversal_lineage_is_cut(spark):
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(6)], "source string, target string")
    text = plan(G.walk(edges, spark.createDataFrame([("0",)], "root string"), "callees", 6))
    assert text.count("Scan parquet") >= 1 and "Join" not in text


def test_fact_tables_prune_and_push(spark, tmp_path):
    (tmp_path / "a.dex").write_bytes(B.navigation())
    wide = Facts(spark, str(tmp_path)).table("dex_instruction")
    rows = wide.where("opcode = 110").select("method_id", "pc")
    text = plan(rows)
    assert "ReadSchema: struct<dex_instruction:struct<method_id:string,pc:bigint,opcode:bigint>>" in text
    assert "EqualTo(dex_instruction.opcode,110)" in text and "PartitionFilters" in text and "fact" in text and "Python" not in text
    assert 0 < rows.count() < wide.count()
