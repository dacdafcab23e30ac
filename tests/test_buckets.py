"""Tables of latest rows by bucket: only touched buckets are rewritten, repeats change nothing."""

import json
import os

import pytest

from brindle.streaming import buckets

SCHEMA = "k long, at long, v string"


def folders(path):
    return {(v, b) for v in os.listdir(path) if v.startswith("v=") for b in os.listdir(path / v) if b.startswith(buckets.BUCKET)}


def table(spark, path):
    return sorted(((r.k, r.at, r.v) for r in buckets.latest_rows(spark, str(path), spark.createDataFrame([], SCHEMA).schema).collect()), key=str)


def test_batches_rewrite_what_they_touch(spark, tmp_path):
    path = tmp_path / "t"
    batches = [[(k, 1, "a") for k in range(200)] + [(None, 1, "n")], [(7, 2, "b"), (7, 3, "c"), (8, 0, "late"), (None, 2, "m")], [], [(500, 1, "x"), (7, 3, "again")]]
    assert table(spark, path) == []
    want = {}
    for n, rows in enumerate(batches):
        before = folders(path) if path.exists() else set()
        for _ in range(2):  # a repeat after a failure
            buckets.merge_batch(spark.createDataFrame(rows, SCHEMA), n, str(path), ["k"], ["at"], 16)
        for k, at, v in rows:
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)
        new = folders(path) - before
        assert {v for v, _ in new} <= {f"v={n}"} and len(new) <= (16 if n == 0 else len({r[0] for r in rows}))
        assert table(spark, path) == sorted(((k, *x) for k, x in want.items()), key=str)
    # rows of a batch that didn't reach its manifest aren't there
    spark.createDataFrame([(1, 99, "lost")], SCHEMA).selectExpr("*", f"0 as {buckets.BUCKET}").write.partitionBy(buckets.BUCKET).parquet(str(path / "v=4"))
    assert table(spark, path) == sorted(((k, *x) for k, x in want.items()), key=str)


def test_lost_history_and_other_buckets_fail(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    with pytest.raises(ValueError, match="missing"):
        buckets.merge_batch(d, 3, str(tmp_path / "t"), ["k"], ["at"], 4)
    buckets.merge_batch(d, 0, str(tmp_path / "t"), ["k"], ["at"], 4)
    with pytest.raises(ValueError, match="4 buckets"):
        buckets.merge_batch(d, 1, str(tmp_path / "t"), ["k"], ["at"], 8)
    with pytest.raises(ValueError, match="folders"):
        buckets.merge_batch(d.selectExpr("*", f"1 as {buckets.BUCKET}"), 1, str(tmp_path / "t"), ["k"], ["at"], 4)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(2, 2, "c")], [(1, 0, "old"), (3, 5, "d")]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("k", "at", "v"), r, strict=True))) for r in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1e9 + i, 1e9 + i))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = buckets.latest_into_buckets(events, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["at"], 8).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert table(spark, tmp_path / "t") == [(1, 1, "a"), (2, 2, "c"), (3, 5, "d")]
