"""Blocking and classes of listings, against all pairs."""

import random

from pyspark.sql import functions as F

from brindle.operators import matching

SCHEMA = "id long, title string, brand string, gtin string, price decimal(18,4), currency string, store string, product_id string"


def listings(spark, rows):
    return spark.createDataFrame([(i, t, b, g, p, "BRL", s, pid) for i, (t, b, g, p, s, pid) in enumerate(rows)], "id long, title string, brand string, gtin string, price int, currency string, store string, product_id string").withColumn("price", F.col("price").cast("decimal(18,4)"))


def composed():
    rng = random.Random(9)
    names = [
        ("AMD Ryzen 7 7800X3D AM5", "AMD"), ("Processador Ryzen 7 7800X3D", "Zed"), ("Apple iPhone 15 128GB", "Apple"), ("iPhone 15 Pro Max 256GB azul", "Apple Inc"), ("Galaxy S24 Ultra 256GB", "Samsung"), ("Galaxy S24 Ultra 512GB", "Samsung Electronics"),
        ("Placa de Video RTX 4070 Ti Super", "Gigabyte"), ("GeForce RTX 4070 Ti Super Windforce OC", "Gigabyte"), ("SSD 990 PRO 2TB NVMe", "Samsung"), ("Samsung SSD 990 Pro NVMe 2TB", None), ('Monitor 27" QHD 165Hz IPS', "Dell"), ('Monitor Dell 27" 165Hz IPS slim', "Dell"),
        ('Monitor 27" QHD 165Hz IPS', None), ("Placa mae ASUS B650E-I WiFi", "ASUS"), ("Placa mae ASUS B650E WiFi", "ASUS"), ("Console PlayStation 5 Digital", "Sony"), ("PS5 Slim disc edition", "Sony"), ("Cadeira gamer preta", None), ("Mesa de vidro", None), ("Luva de couro", None), ("Monitor LG UltraGear 27GP850", "LG"), ("Telefone A3519", "Acme"), ("SSD MZ-V9P2T0BW", "Acme Corp"), ("Water cooler Corsair iCUE H150i 360mm", "Corsair"),
    ]
    gtins = [None, None, "7891234567895", "4006381333931"]
    out = []
    for title, brand in names * 4:
        title = title + rng.choice(["", "", " usado", " preto", " bundle", " 2TB"])
        out.append((title, rng.choice([brand, brand, None]), rng.choice(gtins), rng.choice([100, 110, 900]), rng.choice(["s1", "s2"]), str(rng.randrange(30))))
    return out


def test_no_accepted_pair_is_lost(spark):
    """Of all pairs, those that a rule accepts by content are found with the same decision; told inside blocks only are
    reviews of an unclear variant."""
    d = listings(spark, composed())
    ident = matching.settled(matching.identity(d, "title", "brand", "gtin").select("id", "store", "product_id", "price", "currency", *matching.IDENTITY))
    every = ident.select(F.struct("*").alias("a")).crossJoin(ident.select(F.struct("*").alias("b")))
    want = {(r.l, r.r): (r.decision, r.confidence, r.reason) for r in matching.decide(every).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), "decision", "confidence", "reason").collect()}
    got = {(r.l, r.r): (r.decision, r.confidence, r.reason) for r in matching.match(d, d).collect()}
    assert all(want[k] == v for k, v in got.items())
    accepted = {k for k, v in want.items() if v[0] != "reject" and v[2] != "variant_semantic_uncertain"}
    assert accepted <= set(got) and len({v[2] for k, v in want.items() if k in accepted}) >= 8
    assert len(got) < len(want) / 2


def test_listings_that_say_nothing_meet_nothing(spark):
    words = ["Cadeira gamer preta", "Mesa de vidro", "Luva de couro"]
    d = listings(spark, [(f"{words[i % 3]} {i}", None, None, 10, "s", str(i)) for i in range(3000)])
    found = matching.match_classes(d, d)
    assert found.pairs.where("a <> b").count() == 0 and found.pairs.count() == 3000


def test_equal_listings_are_one_class(spark):
    d = listings(spark, [("Apple iPhone 15 128GB", "Apple", None, 10 + i % 7, "s", str(i)) for i in range(10_000)])
    found = matching.match_classes(d, d)
    pair = found.pairs.collect()
    assert len(pair) == 1 and found.left.count() == 10_000
    assert (pair[0].near.decision, pair[0].far.decision) == ("auto_match", "review")


def test_price_and_listing_are_told_of_each_pair(spark):
    d = listings(spark, [("Apple iPhone 15 128GB", "Apple", None, 100, "s", "1"), ("Apple iPhone 15 128GB", "Apple", None, 900, "s", "2"), ("Outro nome", None, None, 100, "s", "1")])
    got = {(r.l, r.r): r.reason for r in matching.match(d, d).collect()}
    assert got == {(0, 0): "same_store_product_id", (1, 1): "same_store_product_id", (2, 2): "same_store_product_id", (0, 1): "price_deviation", (1, 0): "price_deviation", (0, 2): "same_store_product_id", (2, 0): "same_store_product_id"}


def test_brand_roots(spark):
    d = spark.createDataFrame([("lg",), ("lg electronics",), ("lg display",), ("algo",), (None,)], "brand string")
    assert {r.brand: set(r.roots) for r in matching.brand_roots(d).collect()} == {"lg": {"lg"}, "lg electronics": {"lg", "lg electronics"}, "lg display": {"lg", "lg display"}, "algo": {"algo"}}
