"""Functions and operators on small hand-made cases."""

import unicodedata
from datetime import UTC, datetime, timedelta, timezone
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions import values as vx
from brindle.operators import cdc, fx, matching, tables
from brindle.sources import pages
from brindle.streaming import keyed, steps


def one(spark, data, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*columns).collect()]


def test_text(spark):
    c = F.col("s")
    assert one(spark, [("ÉCLAIR Straße ",), (None,)], "s string", tx.fold(c)) == [("eclair strasse",), (None,)]
    assert one(spark, [("L'Oréal!",), ("N/A",), ("Outros",), ("",)], "s string", tx.normalize_brand(c), tx.normalize_code(c))[0] == ("l oreal", "loreal")
    assert one(spark, [("N/A",), ("",)], "s string", tx.normalize_brand(c)) == [(None,), (None,)]
    urls = [("HTTPS://Shop.COM/a/b//?utm_source=x&Q=1&empty=&gad_z=2#f",), ("http://h",), ("http://h/?ref=1",)]
    assert one(spark, urls, "s string", tx.canonical_url(c)) == [("https://shop.com/a/b?Q=1",), ("http://h/",), ("http://h/",)]
    hints = [("https://s/placa-de-video_x/p/99/?a=1",), ("https://s/123456789.html",), ("https://s/long-product-name",), ("https://s/short",), ("https://s/",), (None,)]
    assert one(spark, hints, "s string", tx.title_hint(c)) == [("placa de video x",), (None,), ("long product name",), (None,), (None,), (None,)]
    assert one(spark, [("Bearer abc.def!x x://u:p@h",)], "s string", tx.redact(c)) == [("Bearer *** x://u:***@h",)]
    assert one(spark, [("ﬁne e\u0301t ①Ａ",)], "s string", tx.fold(c)) == [("fine et 1a",)]
    assert one(spark, [("https://s/A+B-caf%C3%A9/p/1",)], "s string", tx.title_hint(c)) == [("A+B café",)]
    pair = one(spark, [("SSD 128 GB Azul", "ssd 128gb"), ("", "a")], "s string, t string", tx.token_ratio(tx.title_tokens(c), tx.title_tokens(F.col("t"))))
    assert pair == [(pytest.approx(2 / 3),), (0.0,)]
    assert one(spark, [({"b": "2", "a": "1"},), ({},)], "s map<string,string>", tx.variant_key(c)) == [("a=1|b=2",), (None,)]
    with pytest.raises(ValueError):
        tx.search_terms("a b c d e f g h i")


def test_fold_equals_decomposition_and_case_folding(spark):
    """Every assigned character, alone and between letters, and texts that mix them."""

    def want(x):
        return "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)).casefold().strip()

    assigned = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    mixed = ["한국어 ½ ΌΣΟΣ Straße", "\u3000ﬃ\u0085", "ı İ ﷺ 𝔄𝕭 e\u0301\u0345", "", "\x1c\tA\n", None]
    texts = assigned + [f"A{c}b" for c in assigned] + mixed
    rows = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "s": texts})).repartition(4).select("i", tx.fold(F.col("s")).alias("f")).collect()
    wrong = [(texts[r.i], r.f) for r in rows if r.f != (None if texts[r.i] is None else want(texts[r.i]))]
    assert len(rows) == len(texts) and not wrong, wrong[:20]


def test_search_windows(spark):
    a, b = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=timezone(timedelta(hours=-3)))
    for start, end in [(datetime(2024, 1, 1), None), (None, datetime(2024, 1, 1)), (b, a), (a, a)]:
        with pytest.raises(ValueError):
            tx.search_window(start, end)
    d = spark.createDataFrame([(x,) for x in ("2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-02 02:59:59", "2024-01-02 03:00:00", None)], "s string").withColumn("at", F.col("s").cast("timestamp"))
    got = lambda *w: [r.s for r in d.where(tx.within(F.col("at"), *w)).collect()]
    assert got(a, b) == ["2024-01-01 00:00:00", "2024-01-02 02:59:59"]
    assert got(None, a) == ["2023-12-31 23:59:59"] and len(got(a, None)) == 3 and len(got(None, None)) == 5


def test_literal_search(spark):
    terms = tx.search_terms("100% Café")
    d = spark.createDataFrame([("so 100% fine", "CAFE"), ("1000 cafe", None)], "a string, b string")
    assert [r.a for r in d.where(tx.matches_all(terms, [F.col("a"), F.col("b")])).collect()] == ["so 100% fine"]


def test_fingerprints_ignore_scale(spark):
    d = spark.createDataFrame([("1",), ("1.00",)], "p string").select(tx.offer_fingerprint(F.col("p").cast("decimal(18,4)"), F.lit('U"S'), F.lit(" Shop "), F.lit(None).cast("string"), F.lit(None).cast("decimal(18,4)")).alias("f"))
    assert d.distinct().count() == 1


def test_values(spark):
    c = F.col("s")
    assert one(spark, [("789199101086",)], "s string", vx.gtin_check_digit(c)) == [(3,)]
    gtins = [("7891991010863",), ("7891991010864",), ("036000291452",), ("96385074",), ("12",), (None,), ("",)]
    assert one(spark, gtins, "s string", vx.normalize_gtin(c)) == [("7891991010863",), (None,), ("0036000291452",), ("96385074",), (None,), (None,), (None,)]
    money = [("R$ 1.234,50", "BRL"), ("US$ 12,5", "USD"), ("1,234.50", "USD"), ("-3", "USD"), ("x", "BRL"), (None, "BRL")]
    assert one(spark, money, "s string, c string", vx.parse_money(c, F.col("c"))) == [(Decimal("1234.5000"),), (Decimal("12.5000"),), (None,), (None,), (None,), (None,)]
    assert one(spark, [("5.948,28",), ("1.234.567",), ("5.3",), ("",)], "s string", vx.parse_local_decimal(c)) == [(Decimal("5948.28"),), (Decimal("1234567"),), (Decimal("5.3"),), (None,)]
    assert one(spark, [('{"k": "1e3"}',), ('{"k": 2.50}',), ("{}",)], "s string", vx.json_amount(c, "k")) == [(None,), (Decimal("2.5000"),), (None,)]
    assert one(spark, [("NVMe 1,5tb 6000mhz 850W 360MM",)], "s string", vx.capacity(c), vx.frequency(c), vx.wattage(c), vx.length_mm(c)) == [("1.5 TB", "6000 MHz", "850 W", "360 mm")]
    assert one(spark, [([1.0, 0.0], [2.0, 0.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "s array<double>, t array<double>", vx.cosine(c, F.col("t"))) == [(1.0,), (None,), (None,)]
    assert one(spark, [(1,), (4,), (40,)], "s int", vx.retry_delay(c)) == [(300,), (2400,), (3600,)]
    when = [(datetime(2024, 1, 2), datetime(2024, 1, 1, 12), datetime(2024, 1, 1)), (datetime(2024, 1, 2), datetime(2023, 1, 1), datetime(2024, 1, 1)), (datetime(2024, 1, 2), None, datetime(2024, 1, 1))]
    got = one(spark, when, "r timestamp, p timestamp, n timestamp", vx.next_check(F.col("r"), F.col("p"), F.col("n")))
    assert got == [(datetime(2024, 1, 1, 12, 1),), (datetime(2024, 1, 1),), (datetime(2024, 1, 2),)]


def test_change_events(spark):
    data = [("a", 1, "1.00", "S", "available", "f1"), ("a", 2, "1.0", "s ", "available", "f1"), ("a", 3, "2", "t", "out_of_stock", "f2"), ("a", 4, "2", "t", "out_of_stock", "f3"), ("b", 1, None, None, None, None)]
    d = spark.createDataFrame(data, "k string, n int, p string, seller string, availability string, fingerprint string").withColumn("price", F.col("p").cast("decimal(18,4)"))
    got = {(r.k, r.n): r.events for r in cdc.change_events(d, ["k"], ["n"]).collect()}
    assert got == {("a", 1): ["new_offer"], ("a", 2): ["unchanged"], ("a", 3): ["price_changed", "seller_changed", "availability_changed", "out_of_stock"], ("a", 4): ["price_changed"], ("b", 1): ["new_offer"]}


def test_as_of_ties(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 0, "y"), (2, 5, "z")], "k int, t int, l string")
    right = spark.createDataFrame([(1, 5, "b", 2), (1, 5, "a", 1), (1, 3, "c", 9), (2, 6, "late", 1)], "k int, t int, v string, i int")
    assert {r.l: r.as_of for r in cdc.as_of(left, right, ["k"], "t", "v", "i").collect()} == {"x": "b", "y": None, "z": None}


def test_steps():
    state, got = None, []
    for at in (0.0, 1.0, 2.0, 2.5, 30.0, 31.0):
        state, (allowed, left, wait) = steps.bucket(state, at, 2, 8)
        got.append((allowed, left, wait))
    assert got == [(True, 1, 0), (True, 0, 0), (False, 0, 2), (False, 0, 2), (True, 1, 0), (True, 0, 0)]
    state, got = None, []
    for at in (0.0, 29.0, 30.0, 31.0):
        state, claimed = steps.claim(state, at, 30)
        got.append(claimed)
    assert got == [True, False, True, False]
    state, got = None, []
    for at, ok in ((0.0, False), (1.0, False), (2.0, True), (25.0, False), (26.0, True), (50.0, True), (51.0, True)):
        state, now = steps.breaker(state, at, ok, 2, 20)
        got.append(now)
    assert got == ["closed", "closed", "open", "half_open", "open", "half_open", "closed"]
    state, got = None, []
    for at, url in ((0.0, "a"), (1.0, "b"), (3.0, "a"), (3.0, "b"), (70.0, "a")):
        state, (code, wait) = steps.cooldown(state, at, url, 60, 2)
        got.append((code, wait))
    assert got == [(None, 0), ("RATE_LIMITED", 1), ("DUPLICATE_REQUEST", 57), (None, 0), (None, 0)]
    state, got = None, []
    for at, seen, expires, same in ((0.0, True, 10.0, True), (1.0, True, 10.0, True), (2.0, True, 20.0, True), (3.0, True, 1.0, False), (30.0, False, None, True), (31.0, True, 40.0, True), (50.0, True, 45.0, True)):
        state, events = steps.promotion(state, at, seen, 1.0, expires, same)
        got.append(",".join(events))
    assert got == ["promotion_activated", "", "promotion_updated", "", "promotion_expired", "promotion_activated", "promotion_expired"]


def test_sorted_fold_takes_keys_one_by_one(spark):
    d = spark.createDataFrame([(k, i) for i in range(300) for k in ("a", "b", None)], "k string, i int").repartition(5)
    out = cdc.sorted_fold(d.withColumn("o", F.col("i")), ["k"], ["o"], lambda: 0, lambda s, r: (s + r[0], (r[0], s + r[0])), ["i"], "i int, total long").collect()
    assert len(out) == 900 and {(r.k, r.total) for r in out if r.i == 299} == {(k, 44850) for k in ("a", "b", None)}
    assert cdc.sorted_fold(d.limit(0).withColumn("o", F.col("i")), ["k"], ["o"], lambda: 0, lambda s, r: (s, None), ["i"], "i int").count() == 0


def test_early_best(spark):
    data = [("s", 1, 0.5, False), ("s", 2, 0.8, True), ("s", 3, 0.99, True), ("u", 1, 0.5, False), ("u", 2, 0.5, False)]
    d = spark.createDataFrame(data, "g string, o int, c double, f boolean")
    assert {(r.g, r.o) for r in cdc.early_best(d, "g", "o", "c", F.col("f")).collect()} == {("s", 2), ("u", 1)}


def test_tables(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string")
    assert sorted(tuple(r) for r in tables.upsert_latest(old, new, ["k"], ["t"]).collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]
    assert tables.insert_missing(old, new, ["k"]).count() == 3
    assert sorted(tuple(r) for r in tables.enrich(old, new.withColumn("v", F.when(F.col("k") == 1, F.col("v"))), ["k"], ["v"]).collect()) == [(1, "c"), (2, "b"), (3, None)]
    assert tables.decode_cursor(tables.encode_cursor("2024-01-01", "k1")) == ("2024-01-01", "k1")
    with pytest.raises(ValueError):
        tables.decode_cursor("nonsense")
    pages_ = spark.range(5).selectExpr("id as t", "id as k")
    assert [r.t for r in tables.page(pages_, "t", "k", 1, (3, 3)).collect()] == [2, 1]


def test_suppression_hashes_on_the_key(spark):
    e = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 3)], "k int, t int, id int")
    out = tables.suppress(e, ["k"], F.expr("p.t = e.t"), F.expr("p.id > e.id"))
    assert {r.id for r in out.collect()} == {2, 3}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_fx(spark):
    rate = "base string, quote string, rate_type string, rate string, source string, status string"
    rates = spark.createDataFrame([("USD", "BRL", "market", "5", "m", "stale"), ("USD", "BRL", "ptax_buy", "6", "p", "fresh"), ("EUR", "BRL", "odd", "7", "o", "fresh")], rate).withColumn("rate", F.col("rate").cast("decimal(24,12)"))
    amounts = spark.createDataFrame([(1, "10.005", "USD"), (2, "1", "EUR"), (3, "2", "BRL"), (4, "1", "GBP")], "id int, a string, currency string").select("id", F.col("a").cast("decimal(18,4)").alias("amount"), "currency", F.lit("BRL").alias("target"))
    got = {r.id: (r.converted, r.rate_type, r.reason) for r in fx.convert(amounts, rates).collect()}
    assert got == {1: (Decimal("60.03"), "ptax_buy", None), 2: (Decimal("7"), "odd", None), 3: (Decimal("2"), "official", None), 4: (None, None, "no_rate")}
    assert [r.rate for r in fx.inverse(rates, "EUR", "BRL").collect()] == [Decimal("0.142857142857")]
    assert {r.source for r in fx.prefer_source(rates, ("p", "m")).collect()} == {"m", "p", "o"}


def test_pages(spark):
    html = '<title>T</title><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Product","name":"N &amp; M","sku":"1","offers":{"price":"9.5","priceCurrency":"BRL"}}</script><h1 class="x"> A&nbsp;<b>B</b> </h1>'
    d = spark.createDataFrame([(1, html), (2, "<h1>X</h1>"), (3, ""), (4, None)], "page_id int, html string")
    got = {r.page_id: r for r in pages.parse_pages(d).collect()}
    assert (got[1].sku, got[1].price, got[1].outcome) == ("1", "9.5", "product") and got[2].title == "X"
    assert [got[i].outcome for i in (2, 3, 4)] == ["no_product", "empty", "empty"]
    assert one(spark, [(html,)], "html string", pages.element(F.col("html"), "h1")) == [("A B",)]
    assert one(spark, [(["/a.png", "//c/d", None, "http://x/a", "/a.png"],)], "u array<string>", pages.gallery(F.col("u"), F.lit("https://h/p")))[0][0] == ["https://h/a.png", "https://c/d", "http://x/a"]
    feed = '{"value":[{"cotacaoCompra":5.1,"cotacaoVenda":5.2,"dataHoraCotacao":"t"},{"cotacaoCompra":1}]}'
    assert [r["rate"] for r in one(spark, [(feed,)], "b string", pages.rate_feed(F.col("b")))[0][0]] == [Decimal("5.1"), Decimal("5.2")]


def test_labelled_pairs(spark, tmp_path):
    line = '{"schema_version":%d,"sample_id":"%s","group_id":"%s","split":"%s","label":"same_product","category":"gpu","reference_language":"pt","candidate_language":"en"}'
    (tmp_path / "p.jsonl").write_text("\n".join([line % (1, "a", "g1", "train"), line % (1, "b", "g2", "train"), line % (1, "b", "g2", "train"), line % (2, "c", "g3", "train"), line % (1, "d", "g4", "holdout"), line % (1, "e", "g4", "train"), "{bad"]))
    ok, bad = pages.labelled_pairs(spark, str(tmp_path / "p.jsonl"))
    assert {(r.sample_id, r.rule) for r in bad.collect()} == {("b", "repeated"), ("c", "schema_version"), ("d", "crosses_splits"), ("e", "crosses_splits"), (None, "unreadable")}


def test_batches_of_claims_and_inserts(spark):
    held = spark.createDataFrame([(1, 10)], "o int, v int")
    claims = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 30), (4, 30), (5, 50), (5, 51), (5, 50)], "o int, v int")
    got = {(r.o, r.v): r.outcome for r in tables.attach(claims, held, "o", "v").collect()}
    assert got == {(1, 10): "kept", (1, 11): "refused", (2, 10): "refused", (3, 30): "attached", (4, 30): "refused", (5, 50): "attached", (5, 51): "refused"}
    new = spark.createDataFrame([(2, "x"), (2, "y"), (None, "z"), (None, "z")], "k int, v string")
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    once = tables.insert_missing(old, new, ["k"])
    assert once.count() == 3 and tables.insert_missing(once, new, ["k"]).count() == 3
    hits = tables.first_hit(spark.createDataFrame([(1,)], "k int"), [spark.createDataFrame([(1, "b"), (1, "a")], "k int, found string")], [["k"]], "found")
    assert [r.found for r in hits.collect()] == ["a"]


def test_sanitized_values():
    assert tables.sanitized({"a": {"b": {"c": {"d": {"e": 1}}}}, 2: {3}}) == {"a": {"b": {"c": {"d": "{'e': 1}"}}}, "2": [3]}


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE_ROWS", 3)
    rows = [(i, sorted({"all", f"g{i % 4}"})) for i in range(20)]
    d = spark.createDataFrame(rows, "id int, keys array<string>")
    pairs = [(r.a.id, r.b.id) for r in matching.block(d, d).collect()]
    assert sorted(pairs) == [(i, j) for i in range(20) for j in range(20)]


def test_matching(spark):
    ddl = "id long, title string, brand string, gtin string, price decimal(18,4), currency string, store string, product_id string"
    row = lambda i, title, brand="Acme", gtin=None, price=10, store="s": (i, title, brand, gtin, Decimal(price), "USD", store, str(i))
    refs = spark.createDataFrame([row(1, "Acme Monitor XB27q 27\" QHD", gtin="7891991010863", store="r")], ddl)
    cands = spark.createDataFrame([row(10, "ACME monitor XB27q 27\""), row(11, "Acme monitor XB27Z 27\"", gtin="7891991010863"), row(12, "Other", gtin="7891991010863", store="t"), row(13, "Other", brand="Zed", gtin="7891991010863"), row(14, "Acme monitor XB27Q usado", price=99)], ddl)
    got = {r.r: (r.decision, r.reason) for r in matching.match(refs, cands).collect()}
    assert got == {10: ("auto_match", "monitor_model_code_exact"), 11: ("reject", "monitor_model_code_conflict"), 12: ("auto_match", "gtin_exact"), 13: ("review", "gtin_brand_conflict"), 14: ("reject", "condition_reject")}


def test_streams(spark, tmp_path):
    rows = [(1, i, float(t)) for i, t in enumerate([1, 2, 3, 4, 101])]
    spark.createDataFrame(rows, "user_id long, event_id long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("user_id long, event_id long, at double").parquet(str(tmp_path / "in"))
    q = keyed.rate_limit(events, 2, 100).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, False, True]
    w = keyed.latest_into(events, str(tmp_path / "t"), str(tmp_path / "c2"), ["user_id"], ["at"]).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=0")).collect()] == [(1, 4, 101.0)]


def test_a_missing_version_is_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    found = []

    class Events:
        class writeStream:
            @staticmethod
            def foreachBatch(write):
                found.append(write)
                return Events.writeStream

            @staticmethod
            def option(*_):
                return None

    keyed.latest_into(Events, str(tmp_path / "t"), "c", ["k"], ["k"])
    with pytest.raises(AnalysisException):
        found[0](spark.range(1).withColumnRenamed("id", "k"), 5)
