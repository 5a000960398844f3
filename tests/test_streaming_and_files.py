from datetime import datetime, timedelta

import pytest

from marginalia.sources import files
from marginalia.streaming.events import TERMINAL, life_cycles, publish, read_events, run_available, windowed_counts


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), i % 5, ["view", "click", "purchase"][i % 7 % 3], float(i)) for i in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20] + rows[part * 20 : part * 20 + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path)


def test_windows_equal_the_batch_answer(spark, events):
    rows, path = events
    got = run_available(windowed_counts(read_events(spark, f"{path}/in"), late="60 days"), "windows", f"{path}/c1", "complete")
    want = {}
    for _, ts, _, kind, v in rows:
        k = (ts.date(), kind)
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0.0))[1] + v)
    assert {(r.start.date(), r.event_type): (r.n, r.value) for r in got.collect()} == want


def test_life_cycles_and_publishing(spark, events):
    rows, path = events
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = read_events(spark, f"{path}/in").dropDuplicates(["event_id"])
    got = run_available(life_cycles(stream), "cycles", f"{path}/c2", "update").collect()
    final = {}
    for r in got:
        if r.user_id not in final or r.events >= final[r.user_id][0]:
            final[r.user_id] = (r.events, r.closed)
    assert set(final) == {r[2] for r in rows} and all(closed == any(x[3] in TERMINAL for x in rows if x[2] == u) for u, (_, closed) in final.items())
    publish(read_events(spark, f"{path}/in"), f"{path}/out", f"{path}/c3", "event_id")
    assert spark.read.parquet(f"{path}/out").select("event_id").distinct().count() == 60


def test_files(spark, tmp_path):
    p = str(tmp_path)
    pages = spark.createDataFrame([("b", 2, "ii", 1, "c", "s", "text", False, False, False, ["front_matter_or_cover"]), ("b", 1, "1", 1, "c", "s", "text", False, False, False, None), ("b", 3, "3", 1, "c", "s", " \n", False, False, False, [])], files.PAGE_SCHEMA)
    files.write_jsonl(pages, f"{p}/pages", ["pdf_page_number"], gzip=True)
    back = files.read_jsonl(spark, f"{p}/pages", files.PAGE_SCHEMA)
    assert files.fingerprint(back, *back.columns) == files.fingerprint(pages, *pages.columns)
    assert [r.pdf_page_number for r in files.searchable_pages(back).collect()] == [1]
    pages.write.parquet(f"{p}/t")
    assert files.read_pinned(spark, f"{p}/t", "pdf_page_number", 3).count() == 3
    for bad in ({"key": "book_id"}, {"key": "pdf_page_number", "rows": 4}):
        with pytest.raises(ValueError):
            files.read_pinned(spark, f"{p}/t", **bad)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    assert files.hashed_files(spark, f"{p}/f").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "bad.jsonl").write_text('{"book_id": 1')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{p}/bad.jsonl", files.PAGE_SCHEMA).collect()
    files.write_leaderboard(spark.createDataFrame([("r1", None, 0.5, None), ("r2", 0.9, 0.1, 3.0)], "run_id string, required_point_coverage double, citation_validity double, p95_latency_seconds double"), f"{p}/csv")
    assert [r.run_id for r in spark.read.csv(f"{p}/csv", header=True).collect()] == ["r2", "r1"]
