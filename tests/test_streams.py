"""Streamed catalogues and progress over batches, repeats and restarts."""

import datetime as dt
import random
import time
import uuid
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from shutterlake.streaming import catalogue as streaming
from shutterlake.streaming import places
from shutterlake.streaming.progress import ProgressTable, scan_progress


def batch(spark, *names, at="2024-01-01 00:00:00"):
    return spark.createDataFrame([(n, 1, at) for n in names], "path string, length long, modificationTime string").selectExpr("path", "length", "CAST(modificationTime AS TIMESTAMP) AS modificationTime")


def test_a_batch_rewrites_its_own_folders(spark, tmp_path, monkeypatch):
    puts = []
    monkeypatch.setattr("pyspark.sql.streaming.readwriter.DataStreamWriter.foreachBatch", lambda self, f: puts.append(f))
    table = str(tmp_path / "table")
    source = spark.readStream.format("rate").load()
    streaming.stream_into_catalog(source, table, 64)
    put = puts[0]
    put(batch(spark, *[f"/a/{i}.jpg" for i in range(400)]), 0)
    put(batch(spark, "/a/7.jpg", "/a/new.png", at="2025-06-01 00:00:00"), 1)
    again = batch(spark, "/a/7.jpg", "/a/x.mp4", "/a/x.mp4", at="2026-01-01 00:00:00")
    for _ in range(2):  # a repeated batch replaces itself
        put(again, 2)
        rows = {r.file_path: r for r in streaming.catalogue_rows(spark, table).collect()}
        assert len(rows) == 402 == streaming.catalogue_rows(spark, table).count()
        assert rows["/a/7.jpg"].created_at.year == 2026 and rows["/a/new.png"].created_at.year == 2025 and rows["/a/8.jpg"].created_at.year == 2024
    assert len(list((tmp_path / "table" / "batch=0").glob("folder=*"))) > 50
    assert all(1 <= len(list((tmp_path / "table" / f"batch={n}").glob("folder=*"))) <= 2 for n in (1, 2))
    put(batch(spark), 3)  # empty
    assert streaming.catalogue_rows(spark, table).count() == 402


def test_totals_outlive_what_a_query_remembers(spark, tmp_path):
    for i in range(6):
        batch(spark, *[f"/b/{i}-{k}.jpg" for k in range(i + 1)]).coalesce(1).write.parquet(str(tmp_path / f"new/{i}"))
    source = spark.readStream.schema("path string, length long, modificationTime timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    listener = ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        for n, want in ((6, 21), (7, 121)):
            if n == 7:
                batch(spark, *[f"/b/late-{k}.jpg" for k in range(100)]).coalesce(1).write.parquet(str(tmp_path / "new/6"))
            stream = source.parquet(str(tmp_path / "new")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            stream.awaitTermination()
            for _ in range(100):  # listeners hear of batches a little later
                got = scan_progress(spark, str(tmp_path / "progress"), 150).collect() if (tmp_path / "progress").exists() else []
                if got and got[0].n == want:
                    break
                time.sleep(0.3)
            assert [(r.n, r.batches, r.left) for r in got] == [(want, n, 150 - want)] and got[0].per_s > 0
            assert len(stream.recentProgress) <= 2
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_session_ends():
    assert places.session_ends(np.array([5, 1, 30, 31]), 10, None) == ([5, 31], False)
    assert places.session_ends(np.array([40, 70]), 10, 31) == ([40, 70], True)
    assert places.session_ends(np.array([70]), 10, 31) == ([70], False)
    assert places.session_ends(np.array([25, 5]), 10, 31) == ([5], False)


def sessions_filled(rows, gap=100):
    out, by_key = {}, {}
    for k, t, i, p in rows:
        by_key.setdefault(k, []).append((t, i, p))
    for k, own in by_key.items():
        own.sort()
        parts = [[own[0]]]
        for a, b in zip(own, own[1:], strict=False):
            parts[-1].append(b) if b[0] - a[0] <= gap else parts.append([b])
        for part in parts:
            known = [p for _, _, p in part if p]
            best = min(known, key=lambda p: (-known.count(p), min(t for t, _, q in part if q == p), p)) if known else None
            out.update({(k, i): p or best for _, i, p in part})
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_places_fill_over_batches(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check_places(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def check_places(spark, tmp_path):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), rng.randrange(4000), i, rng.choice(["x", "y", None, None])) for i in range(300)]
    rows += [("hot", 5 * i, 1000 + i, "z" if i % 7 == 0 else None) for i in range(300)]
    rows.sort(key=lambda r: r[1] + rng.randrange(60))  # a little out of order, across batches too
    frame = lambda part: spark.createDataFrame([(k, start + dt.timedelta(seconds=t), i, p) for k, t, i, p in part], "k string, ts timestamp, id long, place string")
    folder, sink = str(tmp_path / "in"), f"places_{uuid.uuid4().hex[:8]}"
    with places.list_state(spark):
        for n in range(4):
            frame(rows[n * 150 : n * 150 + 150]).coalesce(1).write.mode("append").parquet(folder)
            if n == 3:  # long after all others
                frame([("end", 10**6, 9999, None)]).coalesce(1).write.mode("append").parquet(folder)
            source = spark.readStream.schema(frame([]).schema).parquet(folder)
            out = places.stream_propagated(source, "k", gap_s=100, delay="2 minutes")
            out.writeStream.format("parquet").option("path", str(tmp_path / sink)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = [((r.k, r.id), r.place) for r in spark.read.schema("k string, id long, place string").parquet(str(tmp_path / sink)).collect()]
    assert len(got) == 600 and dict(got) == sessions_filled(rows)


class Timers:
    """A key's list, value and timers, as a stateful processor gets them."""

    def __init__(self):
        self.rows, self.timers, self.value = [], set(), None

    def getListState(self, name, schema):
        return SimpleNamespace(get=lambda: iter(self.rows), put=lambda x: setattr(self, "rows", list(x)), appendList=self.rows.extend, clear=lambda: setattr(self, "rows", []))

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, exists=lambda: self.value is not None, update=lambda x: setattr(self, "value", x), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_a_key_of_many_sessions_holds_one_timer_and_closes_them_at_once():
    handle, own, at = Timers(), places.OpenSessions("k", 100), np.arange(50) * 1_000_000_000
    own.init(handle)
    list(own.handleInputRows(("x",), iter([pd.DataFrame({"epoch_micros_of_row": at, "id": range(50), "place": ["p", None] * 25})]), None))
    assert handle.timers == {100_001}
    out = pd.concat(own.handleExpiredTimer(("x",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 30_000_000), None))
    assert out["id"].tolist() == list(range(30)) and out["place"].tolist() == ["p", None] * 15  # each row is a session
    assert len(handle.rows) == 20 and max(handle.timers) == 30_100_001 and handle.value == (30_000_000_000, 49_000_000_000)


def test_sessions_end_by_microseconds():
    handle, own = Timers(), places.OpenSessions("k", 100)
    own.init(handle)
    rows = pd.DataFrame({"epoch_micros_of_row": [100_000, 100_900_000, 200_900_000], "id": [1, 2, 3], "place": ["p", None, "q"]})
    list(own.handleInputRows(("x",), iter([rows]), None))
    out = pd.concat(own.handleExpiredTimer(("x",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), None))
    assert out["place"].tolist() == ["p", "q", "q"]  # 100.8 seconds apart, though 100 whole ones; then 100 exactly


def test_a_session_that_goes_on_takes_its_timer_along():
    handle, own = Timers(), places.OpenSessions("k", 100)
    own.init(handle)
    for t in (0, 90, 60, 180):
        list(own.handleInputRows(("x",), iter([pd.DataFrame({"epoch_micros_of_row": [t * 1_000_000], "id": [t], "place": [None]})]), None))
    assert handle.timers == {280_001}


def test_batches_of_fingerprints_link_to_what_all_rows_link_to(spark, tmp_path):
    from test_operators import groups_of, mixed_pictures, pictures

    from shutterlake.operators import duplicates as dup

    fp = pictures(spark, mixed_pictures(200))
    keys, links, folder = (str(tmp_path / x) for x in ("keys", "links", "in"))
    for n in range(3):
        fp.filter(f"id % 3 = {n}").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(fp.schema).parquet(folder)
        streaming.stream_links(source, keys, links).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("a long, b long, batch int").parquet(links)
    assert got.select("batch").distinct().count() == 3
    assert groups_of(got.select("a", "b")) == groups_of(dup.complete_links(fp))
