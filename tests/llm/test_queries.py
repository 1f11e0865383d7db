"""The registered queries of the training-data operators and the pipeline over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from lexiline.llm import queries
from tools_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    out = entry_module.queries()[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    if name.split("_")[0] in ("op2", "op4", "op5", "op6", "op8", "op10", "op12"):
        assert out.count() == n
    elif name.startswith("op9"):
        assert out.count() == duckdb.sql(f"select count(*) from '{SF}/embeddings.parquet'").fetchall()[0][0]
    else:
        assert out.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_one_query_per_operator():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.run(spark, SF).count() == before
