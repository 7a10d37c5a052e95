"""Streams whose rows come out of order: results by event time, late rows, state of idle keys."""

import datetime as dt

from skerry.streaming import jobs

LOGS = "event_id long, user_id string, search_time_ms int, created_at timestamp"
SEEN = "document_id string, seen_at timestamp, status string"


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def told(spark, tmp_path, schema, deliveries, job):
    """What the stream has told after all deliveries, each run to its end before the next."""
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_late_searches_take_the_place_of_their_time(spark, tmp_path):
    deliveries = [[(1, "a", 100, at(0)), (10, "c", 10, at(5)), (11, "c", None, at(5)), (12, "c", 7, None), (30, None, 9000, at(4))],
                  [(9, "c", 20, at(3)), (2, "b", 6000, at(100)), (8, "c", 30, at(3))],
                  [(13, "c", 999, at(50)), (3, "a", 300, at(200)), (4, "b", 2000, at(400))]]
    rows = told(spark, tmp_path, LOGS, deliveries, lambda s: jobs.ordered_latency_alerts(s, "10 seconds", idle_ms=60_000))
    # 8 and 9 come after 10 and belong before it; 13 is behind the watermark; a is idle for so long that it starts anew; 4 still waits
    assert {r.event_id: (r.user_id, r.mean_ms, r.level) for r in rows} == {
        1: ("a", 100.0, "ok"), 8: ("c", 30.0, "ok"), 9: ("c", 25.0, "ok"), 10: ("c", 20.0, "ok"), 2: ("b", 6000.0, "error"), 3: ("a", 300.0, "ok"), 30: (None, 9000.0, "error")}
    assert len(rows) == 7


def test_late_snapshots_of_a_status(spark, tmp_path):
    deliveries = [[("d", at(5), "error"), ("e", at(1), None)], [("d", at(2), "indexed"), ("d", at(7), "indexed"), ("e", at(6), "indexed")], [("f", at(100), "pending")]]
    rows = told(spark, tmp_path, SEEN, deliveries, lambda s: jobs.ordered_status_transitions(s, "10 seconds"))
    assert sorted((r.document_id, r.status, r.seen_at) for r in rows) == [(d, s, at(t).replace(tzinfo=None)) for d, s, t in (("d", "error", 5), ("d", "indexed", 2), ("e", "indexed", 6))]


def test_keys_share_states_and_stay_apart(spark, tmp_path):
    """Many keys in a few states: each key's counts are its own, also after it was idle, and a null key is a key."""
    def step(memory, micros, event):
        return (memory[0] + 1,), [(event, memory[0] + 1)]

    keys = [None, *(f"k{i}" for i in range(39))]
    deliveries = [[(100 * n + i, k, 1, at(40 * n + i % 7)) for i, k in enumerate(keys) if k != "k5" or n != 1] for n in range(4)] + [[(999, "z", 1, at(1000))]]
    states = []

    def told_states(rows):
        spark.createDataFrame(rows, LOGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.in_event_order(spark.readStream.schema(LOGS).parquet(str(tmp_path / "in")), "user_id", "created_at", ["event_id"], "n long", (0,), step,
                                     "user_id string, event_id long, n long", "10 seconds", 60_000, buckets=4)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))

    for rows in deliveries:
        told_states(rows)
    got = {(r.user_id, r.event_id): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(k, 100 * n + i): n + 1 if k != "k5" else {0: 1, 2: 1, 3: 2}[n] for i, k in enumerate(keys) for n in range(4) if k != "k5" or n != 1}
    assert got == want and max(states) <= 4
