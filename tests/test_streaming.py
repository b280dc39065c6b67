"""Replays of streams: rows, state and offsets stay in the shared folder."""

import pytest
from pyspark.sql import functions as F

from risklake.sources.lineage import shared_dir
from risklake.streaming import operators as st


def stream(spark, folder, rows=6):
    schema = "ts timestamp, route string, n long"
    for k in range(rows):
        spark.createDataFrame([(k, f"r{k % 2}")], "n long, route string").select(F.timestamp_seconds(F.col("n") * 60).alias("ts"), "route", "n").coalesce(1).write.mode("append").parquet(folder)
    if not rows:
        spark.createDataFrame([], schema).write.parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)


@pytest.mark.parametrize("mode", ["append", "complete", "update"])
def test_replay_writes_to_the_shared_folder(spark, tmp_path, mode):
    source = stream(spark, str(tmp_path / "in"))
    out = st.replay(source.select("route", "n") if mode == "append" else st.lifecycle(source), mode)
    got = sorted(map(tuple, out.collect()))
    if mode == "update":  # each batch's counts so far
        assert max(n for r, n in got if r == "r0") == max(n for r, n in got if r == "r1") == 3
    else:
        assert got == ([(f"r{k % 2}", k) for k in (0, 2, 4, 1, 3, 5)] if mode == "append" else [("r0", 3), ("r1", 3)])
    shared = shared_dir(spark).removeprefix("file:")
    assert out.inputFiles() and all(f.removeprefix("file:").replace("///", "/").startswith(shared) for f in out.inputFiles())


def test_replay_of_nothing(spark, tmp_path):
    source = stream(spark, str(tmp_path / "in"), 0)
    assert st.replay(source.select("route", "n"), "append").count() == 0
    assert st.replay(st.lifecycle(source), "complete").count() == 0


def first_hits(events, limits, until):
    """events(key, minute, route), limits(name, route, minutes, most): windows from a key's first event on that close by `until`."""
    out = []
    for name, route, minutes, most in limits:
        for key in {k for k, *_ in events}:
            times, start, n = sorted(t for k, t, r in events if k == key and route in (None, r)), None, 0
            for t in [*times, 10**9]:
                if start is not None and t >= start + minutes:
                    if n > most and start + minutes <= until:
                        out.append((name, key, start, n))
                    start = None
                if start is None:
                    start, n = t, 0
                n += 1
    return sorted(out)


@pytest.mark.parametrize("per_batch", [1, 3, 50])
def test_windows_open_at_the_first_hit_in_whatever_order_events_come(spark, tmp_path, per_batch):
    import random

    rng = random.Random(6)
    events = [(k, rng.randrange(0, 400), rng.choice(["login", "scan"])) for k in (1, 2, 3) for _ in range(60)]
    events.sort(key=lambda e: e[1] + rng.randrange(0, 25))
    schema = "scan_id long, minute long, route string"
    for k in range(0, len(events), 40):
        part = spark.createDataFrame(events[k : k + 40], schema)
        part.select("scan_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "route").coalesce(1).write.parquet(str(tmp_path / f"in/{k:04d}"))
    limits = [("global", None, 30, 4), ("auth", "login", 60, 3)]
    source = spark.readStream.schema("scan_id long, ts timestamp, route string").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = st.replay(st.rate_violations(source, spark.createDataFrame(limits, "limit string, route string, minutes int, most int"), "60 minutes"), "append")
    got = sorted((r["limit"], r["scan_id"], int(r["start"].timestamp()) // 60, r["n"]) for r in out.collect())
    assert got == first_hits(events, limits, max(t for _, t, _ in events) - 60) and got


def test_the_four_limits():
    assert st.LIMITS == (("global", 15, 200), ("auth", 15, 20), ("scans", 60, 30), ("otp", 10, 5))


def minutes(at):
    return int(at.timestamp()) // 60


@pytest.mark.parametrize("shape", ["file", "folder"])
def test_bursts_still_open_at_the_end_are_there(spark, tmp_path, shape):
    """The last burst of scan 1 and that of scan 2 are open when the events end; 30 minutes part bursts; events without a time or a scan count."""
    import duckdb

    from risklake import registry

    events = [(1, 0), (1, 29), (1, 59), (1, 400), (2, 390), (2, 419), (None, 5), (3, None), (3, None), (3, 100)]
    db, to = duckdb.connect(), tmp_path / "events.parquet"
    db.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO e VALUES (?, TIMESTAMP '2024-01-01' + to_minutes(?), ?, 'view', 1.0, '{}')", [(i, m, k) for i, (k, m) in enumerate(events)])
    if shape == "folder":
        to.mkdir()
    for part in range(2 if shape == "folder" else 1):
        db.execute(f"COPY (SELECT * FROM e {f'WHERE event_id % 2 = {part}' if shape == 'folder' else ''}) TO '{to / f'part-{part}.parquet' if shape == 'folder' else to}' (FORMAT parquet)")
    db.execute("CREATE VIEW events AS SELECT * FROM e")
    sql = registry.oracle_sql()["st_session_gap"]
    expected = sorted(map(str, db.execute(f'SELECT scan_id, start, "end", events FROM ({sql})').fetchall()))
    rows = registry.queries()["st_session_gap"](spark, str(tmp_path)).select("scan_id", "start", "end", "events").collect()
    assert sorted(str(tuple(r)) for r in rows) == expected
    first = minutes(min(r["start"] for r in rows if r["start"]))
    got = sorted((repr(r["scan_id"]), minutes(r["start"]) - first, minutes(r["end"]) - first, r["events"]) for r in rows if r["start"])
    assert got == [("1", 0, 59, 2), ("1", 59, 89, 1), ("1", 400, 430, 1), ("2", 390, 449, 2), ("3", 100, 130, 1), ("None", 5, 35, 1)]
    assert sum(r["events"] for r in rows) == len(events)


@pytest.mark.parametrize("per_batch", [1, 3])
def test_bursts_over_many_batches_come_once(spark, tmp_path, per_batch):
    for k, part in enumerate([[(1, 0), (2, 10)], [(1, 20), (2, 100)], [(1, 45), (2, 125)], [(1, 300)], [(1, 320), (2, 330)]]):
        spark.createDataFrame(part, "scan_id long, minute long").select("scan_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("scan_id long, ts timestamp").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted((r["scan_id"], minutes(r["start"]), minutes(r["end"]), r["events"]) for r in st.replay_sessions(source).collect())
    assert got == [(1, 0, 75, 3), (1, 300, 350, 2), (2, 10, 40, 1), (2, 100, 155, 2), (2, 330, 360, 1)]


def test_bursts_of_nothing(spark, tmp_path):
    stream(spark, str(tmp_path / "in"), 0)
    (tmp_path / "none").mkdir()
    for folder in ("in", "none"):
        source = spark.readStream.schema("ts timestamp, scan_id long").parquet(str(tmp_path / folder))
        assert st.replay_sessions(source).collect() == []
