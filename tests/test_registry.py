"""Registered queries against their SQL twins on the smallest tables, and streaming state across batches."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lexiline.registry import fixtures
from lexiline.streaming import streams
from tools_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["a3_parse_timed_lines", "c8_uncovered_words", "d9_flag_terms", "e5_merge_passes", "f4_fill_gaps_aligned", "h3_censor_regions_mixed", "k1_apply_edits", "s4_stream_quota_gate"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cur = con.execute(entry_module.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def _feed(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_compounds_across_micro_batches(spark, tmp_path):
    schema = "track_id long, pos long, word string"
    src = _feed(spark, str(tmp_path / "in"), schema, [(1, 0, "oh"), (1, 1, "God"), (2, 0, "god"), (2, 1, "uh")], [(1, 2, "damn!"), (1, 3, "stu"), (1, 4, "pid"), (2, 2, "damn")])
    lexicon = fixtures.lexicon(spark)
    found = streams.stream_compounds(src, [("god", "damn")], ["uh"], lexicon)
    out = {tuple(r) for r in streams.run_to_table(found).collect()}
    assert out == {(1, 1, "adjacent"), (1, 2, "adjacent"), (2, 0, "gapped"), (2, 1, "gapped"), (2, 2, "gapped"), (1, 3, "joined"), (1, 4, "joined")}


def test_streams_go_on_after_a_restart(spark, tmp_path):
    schema = "sub_id long, customer_id long, status string, period_end timestamp, cancel_at_period_end boolean, seq long"
    folder, path = str(tmp_path / "subs"), str(tmp_path / "out")
    first = [(1, 7, "active", None, False, 1), (2, 8, "active", None, False, 1)]
    assert streams.stream_reconcile(_feed(spark, folder, schema, first), path).count() == 2
    again = streams.stream_reconcile(_feed(spark, folder, schema, [(2, 8, "canceled", None, False, 2), (3, 9, "active", None, False, 2)]), path)
    assert {(r.customer_id, r.status) for r in again.collect()} == {(7, "active"), (8, "canceled"), (9, "active")}
    counts = streams.run_to_table(_feed(spark, str(tmp_path / "n"), "k long", [(1,), (2,)]).groupBy("k").count(), "update", str(tmp_path / "c"), keys=["k"])
    assert {tuple(r) for r in counts.collect()} == {(1, 1), (2, 1)}
    counts = streams.run_to_table(_feed(spark, str(tmp_path / "n"), "k long", [(2,), (3,)]).groupBy("k").count(), "update", str(tmp_path / "c"), keys=["k"])
    assert {tuple(r) for r in counts.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_every_document_has_a_reference(spark):
    from pyspark.sql import functions as F

    from lexiline.registry import fixtures, jobs

    sf = "/root/testdata/sf0.001"
    lines = fixtures.timed_lines(spark, sf).filter("track_id % 4 <> 0").select("track_id")
    given = lines.unionAll(jobs._plain(spark, sf).select("track_id"))
    assert fixtures.table(spark, sf, "documents").join(given, given["track_id"] == F.col("doc_id"), "left_anti").count() == 0
