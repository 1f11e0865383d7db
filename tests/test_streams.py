"""Streams over several batches, restarts and repeated batches."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from lexiline.streaming import streams

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
SUB = "sub_id long, customer_id long, status string, period_end timestamp, cancel_at_period_end boolean, seq long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _feed(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _forget_last_commit(path):
    """As if the driver had been lost after the batch's work and before its commit."""
    commits = f"{path}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")


def _at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.mark.parametrize("width, slide", [(3600, 900), (3600, 2400), (1800, 1800), (600, 1800)])
def test_sliding_windows_are_counts_over_all_events(spark, tmp_path, width, slide):
    rng = random.Random(width + slide)
    events = [(i, _at(rng.randrange(0, 600)) + timedelta(microseconds=rng.randrange(10**6)), rng.choice([1, 2]), "view", float(i % 5)) for i in range(200)]
    events.sort(key=lambda e: e[1])
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    streams.stream_sliding_counters(_feed(spark, folder, EVENT, events[:50], events[50:120]), width, slide, path=path)
    out = streams.stream_sliding_counters(_feed(spark, folder, EVENT, events[120:]), width, slide, path=path)
    want = {}
    for _, ts, user, _, value in events:
        first = int(ts.timestamp()) // slide * slide
        while first > ts.timestamp() - width:
            n, total = want.get((first, user), (0, 0.0))
            want[first, user] = (n + 1, total + value)
            first -= slide
    got = {(r.s, r.user_id): (r.n, r.total) for r in out.selectExpr("unix_seconds(window_start) AS s", "user_id", "n", "total").collect()}
    assert got == want


def test_late_rows_are_kept_apart(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *at: [(i, None if m is None else _at(m), 1, "view", 1.0) for i, m in at]
    out = streams.split_late(_feed(spark, folder, EVENT, rows((1, 0), (2, 300), (3, 10))), path=path)
    assert {(r.event_id, r.is_late) for r in out.collect()} == {(1, False), (2, False), (3, False)}
    late = {4: False, 5: True, 6: False, 7: False, 8: True, 9: False}
    feed = _feed(spark, folder, EVENT, rows((4, 240), (5, 239), (6, None), (7, 900)), rows((8, 839), (9, 840)))
    streams.split_late(feed, path=path)
    _forget_last_commit(path)
    out = streams.split_late(_feed(spark, folder, EVENT), path=path)
    got = [(r.event_id, r.is_late) for r in out.collect()]
    assert len(got) == 9 and {k: v for k, v in got if k > 3} == late
    assert streams.split_late(_feed(spark, str(tmp_path / "none"), EVENT, [])).count() == 0


def test_reconciling_rewrites_touched_buckets_only(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, i // 2, "active", None, False, i) for i in range(400)]
    streams.stream_reconcile(_feed(spark, folder, SUB, rows), path, buckets=32)
    table = lambda version: spark.read.parquet(f"{path}/table/version={version}")
    assert table(0).count() == 400 and table(0).select("bucket").distinct().count() == 32
    changes = [(7, 3, "canceled", None, False, 1000), (900, 450, "past_due", None, False, 1001), (8, 4, "canceled", None, False, 1)]
    feed = _feed(spark, folder, SUB, changes[:1], changes[1:])
    out = streams.stream_reconcile(feed, path, buckets=32)
    assert table(1).select("bucket").distinct().count() == 1 and table(1).count() < 50
    assert table(2).select("bucket").distinct().count() <= 2
    want = {(c, "active", 2) for c in range(200) if c != 3} | {(3, "active", 1), (450, "past_due", 1)}
    state = lambda df: {(r.customer_id, r.status, r.billable_count) for r in df.collect()}
    assert state(out) == want
    _forget_last_commit(path)
    assert state(streams.stream_reconcile(_feed(spark, folder, SUB), path, buckets=32)) == want
    streams.stream_reconcile(_feed(spark, folder, SUB, [(7, 3, "active", None, False, 1002)], [(7, 3, "active", None, False, 1003)]), path, buckets=32)
    left = sorted(d for d in os.listdir(f"{path}/manifests") if d.startswith("batch") and d != "batch=-1")  # that one is empty
    assert left == ["batch=3", "batch=4"]
    live = spark.read.parquet(f"{path}/table").filter("sub_id = 7").select("version", "seq").collect()
    assert sorted(tuple(r) for r in live) == [(3, 1002), (4, 1003)]
