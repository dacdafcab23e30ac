"""Queries of sources: pages and feeds made from the tables in the forms that sources publish."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reading
from ..functions import text as tx
from ..functions import values as vx
from ..sources import pages as pg
from ..sources import rates as rt
from ..sources import stores
from .registry import dealt, query, sql_values, t


def _of(texts, key, n=None):
    """One of several texts by key."""
    return F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in texts)), (key % (n or len(texts)) + 1).cast("int"))


def _concat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'Part ' || p_partkey END AS name, CASE WHEN p_partkey % 5 < 4 THEN 'S' || p_partkey END AS sku, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand END AS brand, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.50' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '7' END AS price, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'BRL' END AS currency, CASE WHEN p_partkey % 5 = 0 THEN 'InStock' END AS availability FROM part""")
def json_ld_products(spark, sf_dir):
    """Products of JSON-LD in its usual shapes: alone, in a graph, in an array with a list of types, after a broken script, none."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    k = key.cast("string")
    script = lambda *parts: _concat('<script type="application/ld+json">', *parts, "</script>")
    head = ['"name":"Part ', k, '","sku":"S', k, '"']
    shapes = [
        script('{"@type":"Product",', *head, ',"brand":{"name":"', F.col("p_brand"), '"},"offers":{"price":"', size, '.50","priceCurrency":"BRL","availability":"https://schema.org/InStock"}}'),
        script('{"@context":"x","@graph":[{"@type":"WebPage","name":"w"},{"@type":"Product",', *head, ',"brand":"', F.col("p_brand"), '","offers":[{"price":', size, ',"priceCurrency":"BRL"},{"price":1}]}]}'),
        script('[{"@type":"Organization"},{"@type":["Thing","Product"],', *head, ',"offers":{"lowPrice":7}}]'),
        _concat(script("{broken"), script('{"@type":"Product",', *head, "}")),
        script('{"@type":"BreadcrumbList","name":"no"}'),
    ]
    product = pg.json_ld_product(_concat("<html><h1>t</h1>", _of(shapes, key), "</html>"))
    return dealt(spark, sf_dir, "part").select("p_partkey", *(F.when(product[c] != "", product[c]).alias(c) for c in ("name", "sku", "brand", "price", "currency", "availability")))


#: An element's text as the SQL of the queries states it: tags as blanks, the common entities, white space as one blank.
def _text_sql(tag: str) -> str:
    text = f"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:[ \\t\\n\\x0B\\f\\r][^>]*)?>(.*?)</{tag}[ \\t\\n\\x0B\\f\\r]*>', 1), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"nullif(trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')"


@query(f"""SELECT page_id, coalesce({_text_sql("h1")}, {_text_sql("title")}) AS title, CAST(NULL AS VARCHAR) AS sku, CASE WHEN coalesce(length(trim(html)), 0) = 0 THEN 'empty' ELSE 'no_product' END AS outcome FROM pages""")
def page_products(spark, sf_dir):
    """Landed pages without JSON-LD: the heading is the title."""
    return pg.parse_pages(t(spark, sf_dir, "pages")).select("page_id", "title", "sku", "outcome")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, trim(regexp_replace(replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS ad FROM pages""")
def page_selectors(spark, sf_dir):
    """First elements by class, attribute and tag, with fallbacks."""
    html = F.col("html")
    return t(spark, sf_dir, "pages").select("page_id", pg.selected(html, ["main[lang]", "html[lang]"]).alias("lang"), F.coalesce(pg.selected(html, ["p.nothing", "div.ad"]), F.lit("")).alias("ad"))


@query("""SELECT p_partkey, 'https://h/a' || p_partkey || '.jpg,https://c/d.png,https://h/b.webp' AS images, 3 AS n FROM part""")
def gallery_images(spark, sf_dir):
    """Image addresses of nested JSON, absolute, once each, in order."""
    raw = _concat('{"main":"/a', F.col("p_partkey").cast("string"), '.jpg","more":[{"url":"//c/d.png","w":3},["/b.webp","/a', F.col("p_partkey").cast("string"), '.jpg"]],"alt":"no image"}')
    images = pg.gallery(pg.image_addresses(raw), F.lit("https://h/p/1"))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.array_join(images, ",").alias("images"), F.size(images).alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS url, CASE WHEN p_partkey % 2 = 0 THEN 'o' ELSE 'd' END || p_partkey AS sku, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 > 0 THEN 'a=offer|b=details' ELSE 'a=offer' END AS metadata, CASE WHEN p_partkey % 3 > 0 THEN 'x=details|y=offer' ELSE 'x=offer|y=offer' END AS sources FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 > 0""")
def composed_items(spark, sf_dir):
    """Items of offers and details: the offer's metadata wins, and of the sources the details'."""
    key = F.col("p_partkey")
    url = key.cast("string")
    map_ = lambda *kv: F.create_map(*map(F.lit, kv))
    none = F.lit(None).cast("string")
    p = dealt(spark, sf_dir, "part")
    offers = p.select(url.alias("url"), none.alias("gtin"), F.when(key % 2 == 0, _concat("o", url)).alias("sku"), url.alias("product_id"), F.lit("t").alias("title"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"), map_("a", "offer").alias("metadata"), map_("x", "offer", "y", "offer").alias("sources"))
    details = p.where("p_partkey % 3 > 0").select(url.alias("url"), none.alias("gtin"), _concat("d", url).alias("sku"), none.alias("product_id"), none.alias("title"), F.col("p_brand").alias("brand"), none.alias("model"), map_("a", "details", "b", "details").alias("metadata"), map_("x", "details").alias("sources"))
    items = pg.compose_items(offers, details)
    told = pg.offer_of(items).select("url", "sku", "metadata").join(items.select("url", "brand", "sources"), "url").where("sku is not null")
    return told.select("url", "sku", "brand", tx.variant_key(F.col("metadata")).alias("metadata"), tx.variant_key(F.col("sources")).alias("sources"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'found' WHEN 1 THEN 'found' WHEN 2 THEN 'genuine_empty' WHEN 3 THEN 'parse_error' WHEN 4 THEN 'incomplete' ELSE 'unknown' END AS outcome, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE p_partkey % 6 WHEN 0 THEN 'https://www.next.example/produto/' || p_partkey || '/' || replace(p_name, ' ', '-') WHEN 1 THEN 'https://www.next.example/produto/' || p_partkey || '/x?q=1' END AS first_url FROM part""")
def store_search_pages(spark, sf_dir):
    """Search pages of a store: its script, its links where there is no script, and what pages without listings mean."""
    key = F.col("p_partkey")
    k = key.cast("string")
    state = lambda items: _concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"catalogServer":{"data":[', items, "]}}}}}</script>")
    forms = [
        state(_concat('{"code":', k, ',"name":"', F.col("p_name"), '","price":9},{"code":"","name":"no"},{"code":', k, ',"name":"', F.col("p_name"), '"},{"code":"77x","name":"Other","friendlyName":"other-one"}')),
        _concat('<a class="c" href="/produto/', k, '/x?q=1">A <b>thing</b></a><a href="/produto/', k, '/x?q=1&utm_source=z">again</a><a href="/help">help</a>'),
        _concat("<p>Nenhum produto encontrado para ", k, "</p>"),
        state(F.lit("")),
        F.lit('<script id="__NEXT_DATA__">{"props":'),
        _concat("<p>hello ", k, "</p>"),
    ]
    pages = dealt(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("next").alias("store"), _of(forms, key).alias("html"))
    d = stores.search_results(pages)
    return d.groupBy(F.col("page_id").alias("p_partkey")).agg(F.first("outcome").alias("outcome"), F.count("url").cast("int").alias("n"), F.min_by("url", "position").alias("first_url"))


_RATES = (
    ("settlement", "<table><tr><th>Data</th></tr><tr><td>22/09/2026</td><td>a</td><td>b</td><td>c</td><td><b>0,000{n}</b></td></tr><tr><td>21/09/2026</td><td>a</td><td>b</td><td>c</td><td>9</td></tr></table>"),
    ("central_bank", "<table id=\"cotizacion-interbancaria\" class=x><tr><td>Dolar</td><td>USD</td><td>1</td><td>5.9{n},01</td></tr><tr><td>Real</td><td>brl</td><td>5</td><td>1.1{n},50</td></tr></table>"),
    ("newspaper", "<table><tr><td>Dólar Comercial</td><td>5,1</td><td>5,2</td><td>22/09/2026 15:30</td></tr><tr><td>Dólar Turismo</td><td>5,1{n}</td><td>5,3{n}</td><td>22/09/2026 15:30</td></tr></table>"),
    ("newspaper", "<div data-symbol=\"USDBRLT_VALR\" class=t><span class=\"ticker__item__value up\"> R$ 5,4{n} </span></div>"),
    ("converter", "<script>Converter({{quotes: {{\"body\":{{\"USDBRL_BCBR\":{{\"name\":\"x\",\"lastQuote\":\"5,0{n}\"}}}}}}}})</script>"),
    ("central_bank", "<table><tr><td>none</td></tr></table>"),
)


@query("""WITH x AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k, CAST(10 + s_suppkey % 90 AS VARCHAR) AS n FROM supplier),
r AS (SELECT id, 'PYG' AS base, 'BRL' AS quote, 'official' AS rate_type, '0.000' || n AS rate FROM x WHERE k=0 UNION ALL SELECT id, 'USD', 'PYG', 'official', '59' || n || '.01' FROM x WHERE k=1 UNION ALL SELECT id, 'USD', 'BRL', 'ptax_buy', '5.1' FROM x WHERE k=2 UNION ALL SELECT id, 'USD', 'BRL', 'ptax_sell', '5.2' FROM x WHERE k=2 UNION ALL SELECT id, 'USD', 'BRL', 'tourism_buy', '5.1' || n FROM x WHERE k=2 UNION ALL SELECT id, 'USD', 'BRL', 'tourism_sell', '5.3' || n FROM x WHERE k=2 UNION ALL SELECT id, 'USD', 'BRL', 'tourism_sell', '5.4' || n FROM x WHERE k=3 UNION ALL SELECT id, 'USD', 'BRL', 'ptax_buy', '5.0' || n FROM x WHERE k=4 UNION ALL SELECT id, 'USD', 'BRL', 'ptax_sell', '5.0' || n FROM x WHERE k=4)
SELECT id, base, quote, rate_type, CAST(CAST(rate AS DECIMAL(24,12)) AS VARCHAR) AS rate, 'parsed' AS outcome FROM r UNION ALL SELECT id, 'PYG', 'BRL', 'official', NULL, 'parsed' FROM x WHERE k=1 UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'no_rates' FROM x WHERE k=5""")
def rate_pages(spark, sf_dir):
    """Rates of four sources' pages; of the derived inverse only that it is there."""
    key = F.col("s_suppkey")
    n = (F.lit(10) + key % 90).cast("string")
    bodies = []
    for _, body in _RATES:
        first, *rest = body.replace("{{", "\0").replace("}}", "\1").split("{n}")
        clean = lambda x: x.replace("\0", "{").replace("\1", "}")
        parts = [F.lit(clean(first))]
        for r in rest:
            parts += [n, F.lit(clean(r))]
        bodies.append(F.concat(*parts))
    d = dealt(spark, sf_dir, "supplier").select(key.alias("id"), _of([s for s, _ in _RATES], key).alias("of"), _of(bodies, key).alias("body"))
    rows = rt.read_rates(d.withColumnRenamed("of", "source"), keep=["id"])
    derived = (F.col("base") == "PYG") & (F.col("source") == "central_bank")
    return rows.select("id", "base", "quote", "rate_type", F.when(~derived | derived.isNull(), F.col("rate").cast("string")).alias("rate"), "outcome")


@query("""SELECT s_suppkey AS id, round(1 / CAST(1000 + s_suppkey AS DOUBLE), 12) AS rate FROM supplier""")
def rate_inverse(spark, sf_dir):
    """The guarani's rate is one over the guaranies to the real, to twelve places."""
    key = F.col("s_suppkey")
    body = _concat('<table id="cotizacion-interbancaria"><tr><td>a</td><td>USD</td><td>1</td><td>7.000</td></tr><tr><td>b</td><td>BRL</td><td>1</td><td>', (1000 + key).cast("string"), ",00</td></tr></table>")
    rows = rt.read_rates(dealt(spark, sf_dir, "supplier").select(key.alias("id"), F.lit("central_bank").alias("source"), body.alias("body")), keep=["id"]).where("base = 'PYG'")
    return rows.select("id", F.col("rate").cast("double").alias("rate"))


@query("""SELECT base, quote, rate_type, source, rate FROM (SELECT CAST(s_nationkey AS VARCHAR) AS base, 'BRL' AS quote, 'official' AS rate_type, 's' || (s_suppkey % 3) AS source, CAST(s_acctbal AS DECIMAL(24,12)) AS rate, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey DESC) = 1) QUALIFY row_number() OVER (PARTITION BY base ORDER BY CASE source WHEN 's2' THEN 1 WHEN 's0' THEN 2 ELSE 3 END) = 1""")
def rate_fallback(spark, sf_dir):
    """Each pair's rate from the preferred source that has one."""
    from ..operators import cdc, fx

    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("base"), F.lit("BRL").alias("quote"), F.lit("official").alias("rate_type"), _concat("s", (F.col("s_suppkey") % 3).cast("string")).alias("source"), F.col("s_acctbal").cast("decimal(24,12)").alias("rate"), F.col("s_suppkey").alias("at"))
    return fx.prefer_source(cdc.latest(s, ["base", "source"], ["at"]).drop("at"), ("s2", "s0"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'flash_sale' WHEN 1 THEN 'lightning_deal' ELSE 'campaign_countdown' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 1790000000 + s_suppkey WHEN 1 THEN epoch(TIMESTAMP '2026-09-28 10:00:00')::BIGINT + s_suppkey % 60 ELSE CASE WHEN s_suppkey % 2 = 0 THEN epoch(TIMESTAMP '2026-09-28 13:00:59')::BIGINT ELSE epoch(TIMESTAMP '2026-09-29 02:59:59')::BIGINT END END AS ends FROM supplier""")
def timed_promotions(spark, sf_dir):
    """Ends of flash sales, lightning deals and countdowns from their pages."""
    key = F.col("s_suppkey")
    sale = _concat('{"price":1,"product_price":{"flash_sale":{"x":1},"deep_discount":{"end_time":', (1790000000 + key).cast("string"), "}}}")
    second = F.lpad((key % 60).cast("string"), 2, "0")
    deal = _concat('"MLB9":{"a":1,"lightning_deal_configuration":{"finish_date":"2020-01-01T00:00:00Z"}},"MLB', key.cast("string"), '":{"lightning_deal_configuration":{"finish_date":"2026-09-28T10:00:', second, 'Z"}}')
    countdown = F.when(key % 2 == 0, "<script>$('#x').countdown('2026/09/28 10:00:59')</script>").otherwise('{"priceValidUntil":"2026-09-28"}')
    ends = lambda c: c["expires_at"]
    kinds = [(stores.flash_sale(sale), 0), (stores.lightning_deal(deal, _concat("MLB-", key.cast("string"))), 1), (stores.campaign_countdown(countdown), 2)]
    told = F.lit(None).cast("struct<type:string,expires_at:timestamp>")
    for found, k in kinds:
        told = F.when(key % 3 == k, found).otherwise(told)
    return dealt(spark, sf_dir, "supplier").select(key.alias("id"), told["type"].alias("kind"), F.unix_timestamp(ends(told)).alias("ends"))


_UNITS = (("capacity", "kit 1,5tb ", "1.5 TB"), ("frequency", "6000mhz", "6000 MHz"), ("refresh_rate", "240HZ", "240 Hz"), ("radiator_size", "360MM", "360 mm"), ("screen_size", "27,5 polegadas", '27.5"'), ("wattage", "850w", "850 W"), ("memory_type", "ddr 5", "DDR5"), ("memory_type", "gddr6x", "GDDR6X"), ("pcie", "pcie 4", "PCIe 4.0"), ("efficiency", "80+ gold", "80 Plus Gold"), ("efficiency", "80 plus", "80 Plus"), ("kit_configuration", "2 X 16", "2x16 GB"), ("gpu", "rtx4070ti", "RTX 4070 Ti"), ("gpu_model", "RX7900XTX", "RX 7900 XTX"), ("color", " azul ", "azul"), ("color", " ", None))


@query(f"""SELECT p_partkey, value FROM part JOIN (VALUES {sql_values([(i, u[2]) for i, u in enumerate(_UNITS)])}) v(v, value) ON v.v = p_partkey % {len(_UNITS)}""")
def attribute_values(spark, sf_dir):
    """Values in the usual form of their keys."""
    known = F.broadcast(spark.createDataFrame([(i, u[0], u[1]) for i, u in enumerate(_UNITS)], "v int, k string, raw string"))
    d = dealt(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_UNITS)).cast("int").alias("v")).join(known, "v")
    return d.select("p_partkey", vx.attribute_value(F.col("k"), F.col("raw")).alias("value"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET x Bearer *** ok' WHEN 1 THEN 'db postgres://user:***@host/x' WHEN 2 THEN 'plain ' || event_id ELSE 'bearer ***' END AS line, 'id=' || event_id || '|note=Bearer ***|' || CASE event_id % 2 WHEN 0 THEN 'user_password' ELSE 'x-api-key' END || '=***' AS fields FROM events""")
def redacted_lines(spark, sf_dir):
    """Log lines and fields without secrets."""
    key = F.col("event_id")
    k = key.cast("string")
    lines = [_concat("GET x Bearer abc!def", k, " ok"), _concat("db postgres://user:p", k, "@host/x"), _concat("plain ", k), _concat("bearer tok.en~", k)]
    fields = F.create_map(F.lit("id"), k, F.lit("note"), _concat("Bearer !", k), F.when(key % 2 == 0, "user_password").otherwise("x-api-key"), _concat("secret", k))
    return dealt(spark, sf_dir, "events").select("event_id", tx.redact(_of(lines, key)).alias("line"), tx.variant_key(tx.redact_fields(fields)).alias("fields"))


@query("""SELECT page_id, trim(replace(replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '-', ' '), '_', ' ')) AS last, 'Wide Slug ' || page_id AS hint, 'https://shop.example/a/b?q=' || page_id || '&z=1+2' AS canonical, sha256('store|https://shop.example/a/b?q=' || page_id || '&z=1+2|' || page_id || '|') AS request FROM pages""")
def url_title_hints(spark, sf_dir):
    """Titles from addresses, and requests told apart by canonical address: escapes are decoded before keys are judged."""
    k = F.col("page_id").cast("string")
    slug = _concat("https://shop.example/Wide-Slug_", k, "/p/9?x=1")
    url = _concat("HTTPS://Shop.example/a/b//?%72ef=1&q=", k, "&utm_source=2&z=1%202&empty=#top")
    tail = F.trim(F.translate(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)$", 1), "-_", "  "))
    return t(spark, sf_dir, "pages").select("page_id", tail.alias("last"), tx.title_hint(slug).alias("hint"), tx.canonical_url(url).alias("canonical"), tx.request_fingerprint(F.lit("store"), url, k, F.lit(None).cast("string")).alias("request"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a=1|b=2' WHEN p_partkey % 3 = 1 THEN 'a=1|b=9' ELSE 'b=9' END AS filled, CASE WHEN p_partkey % 3 = 2 THEN 'cond=used' ELSE 'carrier=verizon|cond=renewed|grade=premium' END AS enriched FROM part""")
def specification_gaps(spark, sf_dir):
    """Maps filled up where a key is missing, and metadata with what the title tells of condition and carrier."""
    from ..functions import titles as tt
    from ..operators import tables

    key = F.col("p_partkey")
    first = F.when(key % 3 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).when(key % 3 == 1, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    filled = tables.fill_gaps(first, F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit(None).cast("string")))
    title = F.when(key % 3 == 2, "Phone").otherwise("Phone Renewed Premium Verizon")
    stated = F.when(key % 3 == 2, "used")
    told = tt.condition(tx.fold(title), stated)
    own = F.map_filter(F.create_map(F.lit("cond"), told["code"], F.lit("grade"), told["grade"], F.lit("carrier"), reading.read(tx.fold(title))["carrier"]), lambda k, v: v.isNotNull())
    return dealt(spark, sf_dir, "part").select("p_partkey", tx.variant_key(filled).alias("filled"), tx.variant_key(own).alias("enriched"))


@query("""SELECT p_partkey, 'Blue ' || p_size || ' GB' AS shown FROM part""")
def variant_formatting(spark, sf_dir):
    from ..functions import titles as tt

    attributes = F.create_map(F.lit("storage"), _concat(F.col("p_size").cast("string"), "gb"), F.lit("color"), F.lit("blue"))
    return dealt(spark, sf_dir, "part").select("p_partkey", tt.public_variant(attributes).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'auto_match' ELSE 'review' END AS decision, CAST(CASE WHEN event_id % 4 = 3 THEN 0.9 ELSE 0.8 END AS DECIMAL(5,4)) AS confidence FROM events""")
def evidence_gate(spark, sf_dir):
    """A review becomes a match only where an unclear variant, near vectors and no price deviation meet."""
    from ..operators import matching

    n = F.col("event_id") % 4
    g = matching.evidence_gate(F.lit("review"), F.lit(0.8), n != 0, F.when(n == 1, 0.5).otherwise(0.95), n == 2)
    return t(spark, sf_dir, "events").select("event_id", g.alias("g")).select("event_id", "g.*")
