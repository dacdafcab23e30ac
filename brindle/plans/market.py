"""Queries of sweeps over listings, of learning between them, and of search by facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.values import gtin_check_digit
from ..operators import cdc, facets, matching
from . import titles
from .registry import dealt, query, t

_SWEEP = """o AS (SELECT c_custkey AS key, CAST(o_orderdate AS DATE) AS seen, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,4)) AS price, o_orderpriority AS seller, CASE WHEN o_orderstatus = 'O' THEN 'available' ELSE 'out_of_stock' END AS stock, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'removed' ELSE 'ok' END AS status FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT * FROM o WHERE seen < CAST('1995-06-01' AS DATE) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) = 1),
w AS (SELECT key, seen, id, price, seller, stock, status FROM o WHERE seen >= CAST('1995-06-01' AS DATE) AND id % 3 = 0 UNION ALL SELECT key, seen, id, price, seller, stock, 'ok' FROM b WHERE key % 5 = 0 UNION ALL SELECT key, CAST('1996-01-01' AS DATE), id, price, seller, stock, 'ok' FROM b WHERE key % 5 = 1),
s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) = 1)"""


def _sweep(spark, sf_dir):
    """What is known of each customer's last order before a day, and a sweep after it: some of the later orders, some
    of the known ones again at their own time, and some unchanged at a later one."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    price, stock = F.col("o_totalprice").cast("decimal(18,4)"), F.when(F.col("o_orderstatus") == "O", "available").otherwise("out_of_stock")
    status = F.when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderkey") % 7 == 1, "removed").otherwise("ok")
    print_ = tx.offer_fingerprint(price, F.lit("USD"), F.col("o_orderpriority"), stock, F.lit(None).cast("decimal(18,4)"))
    o = o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("seen"), F.col("o_orderkey").alias("id"), price.alias("price"), F.col("o_orderpriority").alias("seller"), stock.alias("availability"), print_.alias("fingerprint"), status.alias("status"))
    day = F.lit("1995-06-01").cast("date")
    before = cdc.latest(o.where(F.col("seen") < day), ["key"], ["seen", "id"])
    again = before.where("key % 5 < 2").withColumns({"status": F.lit("ok"), "seen": F.when(F.col("key") % 5 == 0, F.col("seen")).otherwise(F.lit("1996-01-01").cast("date"))})
    return before.drop("status"), o.where((F.col("seen") >= day) & (F.col("id") % 3 == 0)).unionByName(again)


@query(f"""WITH {_SWEEP}, d AS (SELECT coalesce(b.key, s.key) AS key, b.key IS NULL AS fresh, CASE WHEN s.key IS NULL THEN 'missing' WHEN b.key IS NOT NULL AND (s.seen, s.id) <= (b.seen, b.id) THEN 'late' ELSE s.status END AS status, b.price AS bp, b.seller AS bs, b.stock AS ba, s.price AS sp, s.seller AS ss, s.stock AS sa FROM b FULL JOIN s ON b.key = s.key),
e AS (SELECT *, CASE WHEN status = 'late' THEN '' WHEN status IN ('missing', 'failed') THEN 'scrape_failed' WHEN status = 'removed' THEN 'offer_removed' WHEN fresh THEN 'new_offer' WHEN bp = sp AND bs = ss AND ba = sa THEN 'unchanged'
 ELSE array_to_string(list_filter([CASE WHEN bp <> sp THEN 'price_changed' END, CASE WHEN bs <> ss THEN 'seller_changed' END, CASE WHEN ba <> sa THEN 'availability_changed' END, CASE WHEN ba <> sa AND sa = 'out_of_stock' THEN 'out_of_stock' END], lambda x: x IS NOT NULL), ',') END AS events FROM d)
SELECT key, status, events, CASE WHEN events = '' THEN NULL WHEN contains(events, 'offer_removed') THEN 'offer_removed' WHEN contains(events, 'scrape_failed') THEN 'scrape_failed' WHEN contains(events, 'out_of_stock') THEN 'out_of_stock' WHEN events = 'unchanged' THEN 'unchanged' WHEN events = 'new_offer' THEN 'new_offer' ELSE 'changed' END AS refresh, status IN ('failed', 'removed', 'ok') AND NOT fresh AS had, status = 'ok' AS has FROM e""")
def sweep_events(spark, sf_dir):
    """A sweep's listings against the known ones: all outcomes, failed, removed, missing and late ones among them."""
    d = cdc.sweep_diff(*_sweep(spark, sf_dir), ["key"], ["seen", "id"])
    return d.select("key", "status", F.array_join("events", ",").alias("events"), "refresh", F.col("previous_fingerprint").isNotNull().alias("had"), F.col("current_fingerprint").isNotNull().alias("has"))


@query(f"""WITH {_SWEEP}, x AS (SELECT key, seen, id, price, NULL AS status, 1 AS turn FROM b UNION ALL SELECT key, seen, id, price, status, 0 FROM w WHERE status IN ('ok', 'removed')),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC, turn DESC) = 1) SELECT key, CAST(seen AS VARCHAR) AS seen, id, price FROM l WHERE status IS NULL OR status <> 'removed'""")
def sweep_snapshot(spark, sf_dir):
    """What is known after the sweep."""
    return cdc.after_sweep(*_sweep(spark, sf_dir), ["key"], ["seen", "id"]).select("key", F.col("seen").cast("string").alias("seen"), "id", "price")


_ASKED = ({"category": "smartphone", "brand": "Apple", "model": "iPhone 16 Pro", "storage": "256 GB"}, {"category": "gpu", "memory_type": "GDDR7", "vram": "12GB", "chipset": "RTX5070"}, {"refresh_rate": "165", "panel": "IPS", "brand": "lg"}, {"capacity": "2 TB"}, {"brand": "Samsung", "storage": "1tb"})
_HELD = ((6,), (1,), (16,), (8,), ())


@query(f"""SELECT q, p_partkey FROM part JOIN (VALUES {",".join(f"({q},{v})" for q, held in enumerate(_HELD) for v in held)}) k(q, v) ON k.v = p_partkey % {len(titles.KNOWN)}""")
def facet_searches(spark, sf_dir):
    """Listings by brand, model, category and attributes that their titles state."""
    index = matching.settled(facets.facet_index(titles.listings(spark, sf_dir), "p_partkey", "title"))
    found = [facets.facet_search(index, "p_partkey", asked).select(F.lit(q).alias("q"), "p_partkey") for q, asked in enumerate(_ASKED)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 5 AS chain, p_partkey % 5 AS place, CASE WHEN p_partkey % 5 = 0 THEN 'a' WHEN p_partkey % 5 = 4 AND p_partkey // 5 % 2 = 0 THEN 'b' END AS gtin FROM part),
s AS (SELECT chain, place, place AS origin, gtin, 0 AS step FROM p WHERE gtin IS NOT NULL UNION SELECT s.chain, p.place, s.origin, s.gtin, s.step + 1 FROM s JOIN p ON p.chain = s.chain AND abs(p.place - s.place) = 1 AND p.gtin IS NULL AND s.step < 4),
n AS (SELECT chain, place, min(step) AS step FROM s GROUP BY ALL),
k AS (SELECT s.chain, s.place, n.step, count(DISTINCT s.gtin) AS kinds, min(s.gtin) AS gtin FROM s JOIN n ON n.chain = s.chain AND n.place = s.place AND n.step = s.step GROUP BY ALL)
SELECT p.id, k.gtin, k.step AS round FROM p JOIN k USING (chain, place) WHERE k.kinds = 1""")
def gtin_rounds(spark, sf_dir):
    """GTINs that go from listing to listing along part numbers of two at a time, five in a row: from its first, in
    every other row also from its last, where those in the middle hear of two and learn none."""
    key = F.col("p_partkey")
    chain, place = F.floor(key / 5).cast("long"), key % 5
    part = lambda i: F.concat(F.lit("MZ-V"), F.lpad((chain * 10 + i).cast("string"), 7, "0"))
    title = F.concat_ws(" ", F.lit("peca"), part(place), part(place + 1))
    code = lambda kind: F.concat(F.lpad((chain * 2 + kind).cast("string"), 12, "0"))
    gtin = lambda kind: F.concat(code(kind), gtin_check_digit(code(kind)).cast("string"))
    own = F.when(place == 0, gtin(0)).when((place == 4) & (chain % 2 == 0), gtin(1))
    none = F.lit(None).cast("string")
    d = dealt(spark, sf_dir, "part").select(key.alias("id"), title.alias("title"), none.alias("brand"), own.alias("gtin"), F.lit(100).cast("decimal(18,4)").alias("price"), F.lit("BRL").alias("currency"), F.concat(F.lit("s"), place.cast("string")).alias("store"), key.cast("string").alias("product_id"))
    found = matching.learn_gtins(d, matching.match(d, d))
    kind = F.when(F.substring("gtin", 1, 12).cast("long") % 2 == 0, "a").otherwise("b")
    return found.gtins.select("id", kind.alias("gtin"), "round")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, p_partkey // 5 % 2 = 0 AS whole, p_brand, p_size FROM part)
SELECT k, CASE WHEN kind = 4 THEN 'no_product' ELSE 'ok' END AS outcome, CASE kind WHEN 0 THEN CASE WHEN whole THEN 'State ' || k ELSE 'Named ' || k END WHEN 1 THEN 'Heading ' || k WHEN 2 THEN 'Widget ' || k WHEN 3 THEN 'Base ' || k END AS title,
CASE WHEN kind = 4 THEN NULL WHEN kind = 2 THEN 'MLB' || k WHEN kind = 3 THEN 'SKU' || k ELSE CAST(k AS VARCHAR) END AS product_id, CASE WHEN kind = 0 AND whole THEN p_brand WHEN kind = 3 THEN p_brand END AS brand,
CAST(CASE kind WHEN 0 THEN CASE WHEN whole THEN 1000 + p_size ELSE p_size END WHEN 1 THEN CASE WHEN whole THEN 1200 + p_size / 100 ELSE 1100 + p_size / 100 END WHEN 2 THEN 900 + p_size WHEN 3 THEN CASE WHEN whole THEN 500 + p_size ELSE 1234.5 END END AS DECIMAL(18,4)) AS price,
CAST(CASE WHEN kind = 0 AND whole THEN 900 + p_size WHEN kind = 1 THEN 1100 + p_size / 100 END AS DECIMAL(18,4)) AS pix_price, CAST(CASE WHEN kind = 0 AND whole THEN 2000 WHEN kind = 1 THEN 1500 WHEN kind = 2 THEN 1999.9 END AS DECIMAL(18,4)) AS original_price,
CASE WHEN kind = 0 AND whole THEN 10 WHEN kind = 1 THEN 12 WHEN kind = 2 THEN 6 END AS installment_count FROM p""")
def store_product_pages(spark, sf_dir):
    """Product pages of four kinds of stores, with and without what they say first, and a page of none."""
    from ..sources.products import read_products
    from .landing import _concat, _of

    key = F.col("p_partkey")
    k, size = key.cast("string"), F.col("p_size").cast("string")
    whole = F.floor(key / 5) % 2 == 0
    cents = F.lpad(size, 2, "0")
    state = _concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"product":{"title":"State ', k, '","id":', k, ',"brands":{"name":"', F.col("p_brand"), '"},"price":', (F.col("p_size") + 1000).cast("string"), ',"prices":{"priceWithDiscount":', (F.col("p_size") + 900).cast("string"), ',"oldPrice":2000},"installment":{"installment":10,"amount":99.5}}}}}</script>')
    named = _concat('<script type="application/ld+json">{"@type":"Product","name":"Named ', k, '","offers":{"price":', size, "}}</script>")
    card = F.when(whole, _concat('<span id="valParc">R$ 1.200,', cents, "</span>")).otherwise("")
    forms = [
        F.when(whole, state).otherwise(named),
        _concat("<h1>Heading <b>", k, '</b></h1><div class="info-price"><p class="precode">De: <del>R$ 1.500,00</del></p>', card, '<p class="valVista" id="valVista">R$ 1.100,', cents, '</p><span id="nParc">12x</span><span id="Parc">R$ 100,00</span></div><del>R$ 9.999,00</del>'),
        _concat('<h1 class="ui-pdp-title">Widget ', k, '</h1><meta itemprop="price" content="1"><div class="box ui-pdp-price"><span><meta itemprop="price" content="', (F.col("p_size") + 900).cast("string"), '"></span><s class="ui-pdp-price__original-value" aria-label="Antes: 1999.9 reais"></s></div><p id="pricing_price_subtitle">em <b>6</b> x sem juros</p>'),
        _concat('<h1 class="page-title"><span class="base">Base ', k, '</span></h1><a class="amshopby-brand-title-link">Other</a><div class="product-info-main"><a class="amshopby-brand-title-link">', F.col("p_brand"), '</a><div itemprop="sku">SKU', k, "</div>", F.when(whole, _concat('<span data-price-amount="', (F.col("p_size") + 500).cast("string"), '">', "</span>")).otherwise('<span class="price">US$ 1234,5</span>'), "</div>"),
        _concat("<p>nothing ", k, "</p>"),
    ]
    name = _of(["script state", "numbered ids", "price widget", "shop template", "script state"], key)
    url = F.concat(F.lit("https://h.example"), F.when(key % 5 == 2, _concat("/p/MLB", k)).when(key % 5 == 4, _concat("/x/", k)).otherwise(_concat("/produto/", k, "/x")))
    pages = dealt(spark, sf_dir, "part").select(url.alias("url"), name.alias("format"), _concat("<html><body>", _of(forms, key), "</body></html>").alias("html"))
    d = read_products(pages)
    return d.select(F.regexp_extract("url", r"(\d+)(?:/x)?$", 1).cast("long").alias("k"), "outcome", "title", "product_id", "brand", "price", "pix_price", "original_price", "installment_count")
