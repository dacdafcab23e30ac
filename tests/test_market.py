"""Sweeps, learning in rounds and search by facets on small tables; jitter and titles."""

from pyspark.sql import functions as F

from brindle.functions import reading, text, titles, values
from brindle.operators import cdc, facets, matching

OLD = "key long, at long, price int, seller string, availability string, fingerprint string"


def test_sweep_tells_every_outcome(spark):
    before = spark.createDataFrame([(k, 10, 5, "a", "available", "f") for k in range(1, 12)] + [(1, 3, 1, "z", "available", "old")], OLD)
    rows = [
        (1, 20, 5, "a", "available", "f", "ok"), (2, 20, 6, "a", "available", "g", "ok"), (3, 20, 5, " B ", "available", "g", "ok"), (4, 20, 5, "a", "out_of_stock", "g", "ok"), (5, 20, None, None, None, None, "failed"), (6, 20, None, None, None, None, "removed"),
        (7, 9, 6, "a", "available", "g", "ok"), (8, 20, 5, " A", "available", "g", "ok"), (9, 19, 9, "x", "available", "h", "ok"), (9, 20, 5, "a", "available", "f", "ok"), (20, 20, 1, "a", "available", "n", "ok"), (21, 20, None, None, None, None, "failed"),
    ]
    sweep = spark.createDataFrame(rows, OLD + ", status string")
    got = {r.key: (r.status, list(r.events), r.refresh, r.previous_fingerprint, r.current_fingerprint) for r in cdc.sweep_diff(before, sweep, ["key"], ["at"]).collect()}
    assert got == {
        1: ("ok", ["unchanged"], "unchanged", "f", "f"),
        2: ("ok", ["price_changed"], "changed", "f", "g"),
        3: ("ok", ["seller_changed"], "changed", "f", "g"),
        4: ("ok", ["availability_changed", "out_of_stock"], "out_of_stock", "f", "g"),
        5: ("failed", ["scrape_failed"], "scrape_failed", "f", None),
        6: ("removed", ["offer_removed"], "offer_removed", "f", None),
        7: ("late", [], None, None, None),
        8: ("ok", ["price_changed"], "changed", "f", "g"),  # the fingerprint alone
        9: ("ok", ["unchanged"], "unchanged", "f", "f"),
        10: ("missing", ["scrape_failed"], "scrape_failed", None, None),
        11: ("missing", ["scrape_failed"], "scrape_failed", None, None),
        20: ("ok", ["new_offer"], "new_offer", None, "n"),
        21: ("failed", ["scrape_failed"], "scrape_failed", None, None),
    }
    after = {r.key: (r["at"], r.price) for r in cdc.after_sweep(before, sweep, ["key"], ["at"]).collect()}
    assert after == {1: (20, 5), 2: (20, 6), 3: (20, 5), 4: (20, 5), 5: (10, 5), 7: (10, 5), 8: (20, 5), 9: (20, 5), 10: (10, 5), 11: (10, 5), 20: (20, 1)}


LISTING = "id long, title string, brand string, gtin string, price int, currency string, store string, product_id string"


def listings(spark, rows):
    return spark.createDataFrame([(i, t, b, g, 100, "BRL", f"s{i}", str(i)) for i, t, b, g in rows], LISTING).withColumn("price", F.col("price").cast("decimal(18,4)"))


def test_learned_gtins_enter_the_next_round(spark):
    good, other, bad = "4006381333931", "7891991010863", "4006381333932"
    d = listings(spark, [(1, "peca MZ-V0000001", None, good), (2, "peca MZ-V0000001 MZ-V0000002", None, bad), (3, "peca MZ-V0000002 MZ-V0000003", "Acme", None), (4, "peca MZ-V0000003", "Zed", None), (5, "outra", None, good), (6, "peca MZ-V0000009", None, good), (7, "peca MZ-V0000009", None, other), (8, "peca MZ-V0000009", None, None)])
    pairs = matching.settled(matching.match(d, d))
    learned = matching.learn_gtins(d, pairs)
    got = {r.id: (r.gtin, r.source, r.round) for r in learned.gtins.collect()}
    # 4 has another brand than the one that it would hear of; 8 hears of two
    assert got == {1: (good, "own", 0), 2: (good, "auto_match:1", 1), 3: (good, "auto_match:2", 2), 5: (good, "own", 0), 6: (good, "own", 0), 7: (other, "own", 0)}
    assert learned.rounds >= 2
    again = {(r.l, r.r): r.reason for r in matching.rematch(d, pairs, learned).collect()}
    assert again[3, 5] == "gtin_exact" and again[2, 6] == "gtin_exact" and (3, 5) not in {(r.l, r.r) for r in pairs.collect()}
    assert (1, 1) in again and (7, 8) in again


def test_facets_are_read_one_by_one(spark, tmp_path):
    rows = [(1, "Apple iPhone 16 Pro 256GB Black", None), (2, "Apple iPhone 16 Pro 1TB Black", None), (3, "MSI GeForce RTX 5070 12GB GDDR7", None), (4, None, None), (5, "Caneca azul", "cor: Azul"), (5, "Caneca azul", "cor: Azul"), (None, "Apple iPhone 16 Pro 256GB", None)]
    d = spark.createDataFrame(rows, "id long, title string, variant string")
    facets.facet_index(d, "id", "title", variant="variant").write.partitionBy("facet").parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    ids = lambda **asked: [r.id for r in facets.facet_search(index, "id", asked).collect()]
    assert ids(category="smartphone", brand=" APPLE ", storage="256gb") == [1]
    assert ids(model="iphone 16 pro", category="smartphone") == [1, 2] and ids(capacity="1 TB") == [2] and ids(chipset="rtx 5070", vram="12 gb", memory_type="gddr7") == [3]
    assert ids(variant="color=azul") == [5] and ids(category="cpu") == []
    plan = facets.facet_search(index, "id", {"brand": "apple", "storage": "256gb"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and "facet" in plan.split("PartitionFilters: [")[1]
    assert facets.facet_index(d.limit(0), "id", "title").count() == 0


def test_jitter_stays_in_its_bounds_and_falls_alike(spark):
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    key = F.col("id")
    d = spark.range(2000).select((F.unix_timestamp(values.regular_check(now, key)) - F.unix_timestamp(now)).alias("regular"), values.full_jitter(key % 10, key).alias("jitter"), F.pow(F.lit(2.0), key % 10).alias("most"))
    first, second = d.collect(), d.collect()
    assert first == second
    assert all(43200 <= r.regular <= 43800 and 0 <= r.jitter < min(60, r.most) for r in first)
    assert len({r.regular for r in first}) > 300 and len({r.jitter for r in first if r.most >= 64}) > 300
    due = spark.range(1).select(*(values.rates_due(F.timestamp_seconds(F.unix_timestamp(now) - s), F.lit(1), now).alias(f"s{s}") for s in (3599, 3960))).first()
    assert (due.s3599, due.s3960) == (False, True)


def test_reading_of_titles(spark):
    rows = {
        "Notebook Lenovo 512GB SSD 8GB RAM": ("notebook", None, {"ram": "8", "storage": "512"}),
        "Processador Intel Core Ultra 7 265K": ("cpu", "coreultra7-265k", {"processor": "coreultra7-265k"}),
        "Samsung Galaxy Z Fold 6 512GB": ("smartphone", "galaxy zfold6", {"phone": "galaxyzfold6", "storage": "512"}),
        "Galaxy S24+ 256 GB": ("smartphone", "galaxy s24 plus", {"phone": "galaxys24plus", "storage": "256"}),
        "Samsung SSD 970 EVO Plus 1TB": ("ssd", "970 evo plus", {"series": "970evoplus", "storage": "1024"}),
        None: (None, None, {}),
        "": (None, None, {}),
    }
    d = spark.createDataFrame([(t,) for t in rows] * 3, "t string").select("t", reading.read(text.fold(F.col("t"))).alias("r"))
    for r in d.collect():
        category, model, attributes = rows[r.t]
        assert (r.r.category, r.r.model) == (category, model) and attributes.items() <= r.r.attributes.items(), r


def test_registered_categories_are_read(spark, monkeypatch):
    monkeypatch.setattr(titles, "CATEGORIES", titles.CATEGORIES)
    monkeypatch.setattr(titles, "CATEGORY_ATTRIBUTES", dict(titles.CATEGORY_ATTRIBUTES))
    titles.register_category("drone", ("drone",), ("color",), before="notebook")
    got = spark.createDataFrame([("drone notebook preto",)], "t string").select(reading.read(F.col("t")).alias("r")).first().r
    assert got.category == "drone" and got.attributes == {"color": "black"}
