"""Keyed streams: the folds of `steps`, states that go, promotions that end by themselves."""

import json
import os

from brindle.streaming import keyed, steps


def run(spark, tmp_path, make, rows, schema, files):
    """The stream over `files` lists of rows, one micro-batch each; its rows and its numbers of states by batch."""
    for i, part in enumerate(files):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(rows, r, strict=True))) for r in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1e9 + i, 1e9 + i))  # files come by time
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    name = f"out_{tmp_path.name}".replace("-", "_")
    q = make(events).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.table(name).collect(), states


def test_rate_limit_equals_the_fold_and_forgets(spark, tmp_path):
    files = [[(1, 1, 0.5), (1, 2, 1.0), (1, 3, 2.0), (2, 4, 2.0)], [(1, 5, 30.0), (3, 6, 31.0)], [(4, 7, 5000.0)], [(4, 8, 5001.0)]]
    rows, states = run(spark, tmp_path, lambda e: keyed.rate_limit(e, 2, 60, late="10 seconds"), ("user_id", "event_id", "at"), "user_id long, event_id long, at double", files)
    want, held = {}, {}
    for user, event, at in sorted((r for f in files for r in f), key=lambda r: (r[2], r[1])):
        held[user], result = steps.bucket(held.get(user), at, 2, 60)
        want[event] = result
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in rows} == want
    assert max(states) > states[-1]  # the three old buckets are gone, the last user's is held


def test_claims_are_forgotten(spark, tmp_path):
    files = [[(i, i, 1.0) for i in range(20)], [(1, 100, 50.0)], [(50, 101, 9000.0)], [(50, 102, 9001.0), (1, 103, 9002.0)]]
    rows, states = run(spark, tmp_path, lambda e: keyed.dedup_ttl(e, 100, late="1 second"), ("user_id", "event_id", "at"), "user_id long, event_id long, at double", files)
    assert {r.event_id: r.claimed for r in rows if r.event_id >= 100} == {100: False, 101: True, 102: False, 103: True}
    assert states[0] >= 20 and states[-1] < 10


def test_breaker_holds_failures_only(spark, tmp_path):
    files = [[(i, i, 1.0, True) for i in range(30)] + [(99, 200, 1.0, False), (99, 201, 2.0, False)], [(99, 202, 3.0, True), (99, 203, 400.0, True)]]
    rows, states = run(spark, tmp_path, lambda e: keyed.circuit_breaker(e, 2, 300, late="1 hour"), ("user_id", "event_id", "at", "ok"), "user_id long, event_id long, at double, ok boolean", files)
    assert {r.event_id: r.state for r in rows if r.event_id >= 200} == {200: "closed", 201: "closed", 202: "open", 203: "half_open"}
    assert states[0] == 1 and states[-1] == 0


def test_spacing(spark, tmp_path):
    files = [[("h", "/a", 1, 0.5), ("h", "/a", 2, 1.0), ("h", "/b", 3, 1.5)], [("h", "/b", 4, 5.0), ("i", "/a", 5, 5.0)]]
    rows, _ = run(spark, tmp_path, lambda e: keyed.request_spacing(e, 60, 2), ("host", "url", "event_id", "at"), "host string, url string, event_id long, at double", files)
    assert {r.event_id: r.code for r in rows} == {1: None, 2: "DUPLICATE_REQUEST", 3: "RATE_LIMITED", 4: None, 5: None}


def test_promotion_ends_without_a_further_event(spark, tmp_path):
    columns, schema = ("listing", "event_id", "at", "seen", "price", "expires"), "listing string, event_id long, at double, seen boolean, price double, expires double"
    files = [[("a", 1, 10.0, True, 5.0, 100.0), ("b", 2, 10.0, True, 6.0, 9000.0), ("c", 3, 11.0, True, 7.0, 50.0)], [("c", 4, 60.0, False, None, None)], [("d", 5, 500.0, False, None, None)], [("d", 6, 501.0, False, None, None)]]
    rows, states = run(spark, tmp_path, lambda e: keyed.promotions(e, late="5 seconds"), columns, schema, files)
    told = sorted(((r.listing, r.event_id, r.at, r.events) for r in rows if r.events), key=lambda r: (r[0], r[2]))
    assert told == [("a", 1, 10.0, "promotion_activated"), ("a", None, 100.0, "promotion_expired"), ("b", 2, 10.0, "promotion_activated"), ("c", 3, 11.0, "promotion_activated"), ("c", 4, 60.0, "promotion_expired")]
    assert sum(r.events == "promotion_expired" for r in rows) == 2
    assert states[-1] < max(states)
