"""Payloads as VARIANT against plain Python on nested values."""

import json

from pyspark.sql import functions as F

from brindle.operators import payloads


def bounded(x, depth=0):
    if depth > 3:
        return None
    if isinstance(x, dict):
        first = sorted(x.items())[:80]
        return {k[:128]: bounded(v, depth + 1) for k, v in first if not any(s in k.lower() for s in payloads.SENSITIVE)}
    if isinstance(x, list):
        return [bounded(v, depth + 1) for v in x[:40]]
    return x[:2048] if isinstance(x, str) else x


VALUES = [
    {"a": {"b": {"c": {"d": {"e": 1}}}}, "n": None, "t": "x", "l": [1, [2, {"z": 1.5}], None, [[[3]]]], "Token_x": "q"},
    {f"k{i:03}": i for i in range(100)},
    {"k" * 200: 1, "k" * 199 + "z": 2, "l": list(range(100)), "s": "é" * 5000, "e": {}, "f": []},
    [{"password": 1, "ok": True}, "[1]", '{"a":1}', 10**14, -2.25, False],
    "text",
    5,
    None,
    {},
    [],
]


def test_bounds(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(90, "no json {"), (91, None), (92, '{"a":1,"a":2}')]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, j string").select("i", F.to_json(payloads.plain(F.try_parse_json("j"))).alias("p")).collect()}
    assert got.pop(90) is got.pop(91) is got.pop(92) is None
    assert {i: json.loads(p) for i, p in got.items()} == {i: bounded(v) for i, v in enumerate(VALUES)}


def test_merge_keeps_explicit_nulls(spark):
    pairs = [({"a": 1, "b": {"x": [1]}}, {"b": None, "c": {"y": None}}), ({"a": 1}, {}), ({}, {"a": None})]
    d = spark.createDataFrame([(json.dumps(a), json.dumps(b)) for a, b in pairs] + [("[1]", '{"a": 2}'), (None, '{"a": 2}')], "a string, b string")
    got = [json.loads(r.m) for r in d.select(F.to_json(payloads.merged(F.try_parse_json("a"), F.try_parse_json("b"))).alias("m")).collect()]
    assert got == [{**a, **b} for a, b in pairs] + [{"a": 2}, {"a": 2}]


def test_staging_round_trip(spark):
    deep = {"size": {"a": {"b": {"c": {"d": 1}}}}, "color": "blue", "other": 1, "ram": None}
    rows = [(json.dumps({"title": "T", "price": "1.50"}), json.dumps(deep)), (json.dumps({"title": "x" * 70000}), "{}"), (json.dumps({"title": None}), None)]
    d = spark.createDataFrame(rows, "p string, m string").select(payloads.staged(F.try_parse_json("p"), F.try_parse_json("m"), F.parse_json(F.lit('{"score":0.5}'))).alias("s")).select("s.*")
    a, b, c = d.select("refused", payloads.restored(F.col("payload")).alias("r")).select(F.col("refused").alias("why"), "r.refused", *(F.to_json(f"r.{x}").alias(x) for x in ("product", "metadata", "hit"))).collect()
    want = {"size": bounded(deep["size"]), "color": "blue", "ram": None}
    assert a.why is a.refused is None and json.loads(a.product) == {"title": "T", "price": "1.50", "metadata": want} and json.loads(a.metadata) == want and json.loads(a.hit) == {"score": 0.5}
    assert (b.why, b.refused, b.product) == ("too_large", "unreadable", None)
    assert json.loads(c.product) == {"title": None, "metadata": {}}
    bad = spark.createDataFrame([('{"version":2,"product":{}}',), ("[]",), ("x",), (None,)], "t string").select(payloads.restored(F.col("t"))["refused"].alias("r"))
    assert [r.r for r in bad.collect()] == ["version", "unreadable", "unreadable", "unreadable"]


def test_snapshots(spark):
    d = spark.createDataFrame([("12.50", None, "used", None, "verizon"), ("1", "shop", "unknown", "premium", ""), (None, "s", None, None, None)], "price string, seller string, cond string, grade string, carrier string")
    s = payloads.snapshot({"price": F.col("price").cast("decimal(18,2)"), "seller": F.col("seller"), "available": F.lit(True), "scraped_at": F.lit("2024-01-02T03:04:05+00:00")}, F.parse_json(F.lit('{"title":"t","x":null}')), F.col("cond"), F.col("grade"), F.col("carrier"))
    rows = d.select(F.to_json(s).alias("j"), payloads.snapshot_view(s).alias("v")).collect()
    base = dict.fromkeys(payloads.SNAPSHOT) | {"available": True, "scraped_at": "2024-01-02T03:04:05+00:00", "metadata": {"title": "t", "x": None}}
    assert [json.loads(r.j) for r in rows] == [base | {"price": "12.50", "condition": "used", "carrier": "verizon"}, base | {"price": "1.00", "seller": "shop"}, base | {"seller": "s"}]
    assert str(rows[0].v.price) == "12.5000" and rows[0].v.available is True and rows[0].v.scraped_at.year == 2024 and rows[2].v.price is None
    odd = spark.createDataFrame([('{"price":"x","scraped_at":"soon","available":"maybe"}',)], "t string").select(payloads.snapshot_view(F.parse_json("t")).alias("v")).first().v
    assert (odd.price, odd.scraped_at, odd.available) == (None, None, None)
