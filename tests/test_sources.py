"""The report reader, and keyed tables as sorted runs."""

import os
import random

from pyspark.sql import functions as F

from gridlume.sources import keyed, landing, reports, runs


def test_a_row_for_every_file(spark, tmp_path):
    for place, body in (("01001", b'{"a": 1}'), ("01002", b"{bad"), ("01003", b"\xff\xfe"), ("01004", b"7"), ("01005", b""), ("01006", b'{"a": "' + b"x" * 500 + b'"}')):
        folder = tmp_path / f"insee={place}"
        folder.mkdir()
        (folder / "part-0.txt").write_bytes(body)
        (folder / "_SUCCESS").write_bytes(b"")
        (folder / ".part-0.txt.crc").write_bytes(b"x")
    (tmp_path / "2A004.json").write_bytes(b"[]")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = {r["insee"]: (r["value"], r["error"]) for r in reports.report_files(spark, str(tmp_path), partitions=3, most_bytes=400).collect()}
    bad = (None, "invalid response")
    assert got == {"01001": ('{"a": 1}', None), "01002": bad, "01003": bad, "01004": bad, "01005": bad, "01006": (None, "response too large"), "2A004": ("[]", None)}
    found = {r["insee"]: r for r in landing.report_landing(spark, f"file://{tmp_path}").collect()}
    assert found["01001"]["error"] is None and found["01002"]["error"] == "invalid response" and found["01001"]["report"] is not None


def test_no_files(spark, tmp_path):
    assert reports.report_files(spark, str(tmp_path)).count() == 0


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, written_ms long, expires_ms long")


def test_runs_hold_the_last_entry_of_each_key(spark, tmp_path):
    rng = random.Random(7)
    store, want, writes = runs.RunStore(spark, f"file://{tmp_path}/store", buckets=3), {}, 0
    assert store.read().count() == 0 and store.merge() == []
    for k in range(7):
        rows = [(rng.choice(["a", "b", "c", "d", f"k{rng.randrange(40)}"]), f"v{k}.{i}", rng.randrange(1000), 10_000) for i in range(20)]
        for key, value, at, until in rows:
            want[key] = max(want.get(key, (-1, 0, "")), (at, until, value))
        store.add(entries(spark, rows))
        before = sum(r.rows for r in store.runs())
        store.merge()
        writes += before
        got = {r["key"]: (r["written_ms"], r["expires_ms"], r["value"]) for r in store.read().collect()}
        assert got == want
    live = store.runs()
    assert len(live) < 4 and live[0].first == 1 and live[-1].last == 7
    asked = store.get(spark.createDataFrame([("a",), ("no",), ("b",)], "key string")).collect()
    assert {r["key"]: r["value"] for r in asked} == {"a": want["a"][2], "no": None, "b": want["b"][2]}


def test_a_reader_outlives_a_merge(spark, tmp_path):
    store = runs.RunStore(spark, f"file://{tmp_path}/store")
    store.add(entries(spark, [("a", "1", 1, 9)]))
    store.add(entries(spark, [("b", "2", 2, 9)]))
    reader = store.read()
    store.merge()
    assert reader.count() == 2 and len(store.runs()) == 1
    assert len([n for n in os.listdir(tmp_path / "store") if n.startswith("run-")]) == 3
    store.merge()
    assert len([n for n in os.listdir(tmp_path / "store") if n.startswith("run-")]) == 1


def test_expired_entries_go_only_with_the_oldest_run(spark, tmp_path):
    store = runs.RunStore(spark, f"file://{tmp_path}/store")
    store.add(entries(spark, [(f"k{i}", "old", 1, 1000) for i in range(50)]))
    store.add(entries(spark, [("k1", "new", 2, 5)]))
    store.merge(F.lit(10))
    assert len(store.runs()) == 2 and store.get(spark.createDataFrame([("k1",)], "key string")).first()["value"] == "new"
    store.add(entries(spark, [(f"k{i}", "newer", 3, 8 if i < 25 else 99) for i in range(40)]))
    store.merge(F.lit(10))
    assert len(store.runs()) == 1 and store.read().count() == 50 - 25


def test_freshness_of_what_was_found(spark):
    rows = spark.createDataFrame([("hit", "v", 100, 50), ("stale", "v", 100, 20), ("gone", "v", 30, 20), ("none", None, None, None)], "key string, value string, expires_ms long, fresh long")
    got = {r["key"]: (r["cache"], r["value"]) for r in runs.freshness(rows, F.lit(30), F.col("fresh")).collect()}
    assert got == {"hit": ("HIT", "v"), "stale": ("STALE", "v"), "gone": ("MISS", None), "none": ("MISS", None)}
    assert keyed.LEAST_TTL_S == 60
