"""Queries of the change feed, over events with payloads made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed as fd
from ..operators import tables
from .registry import dealt, query, t

_P1, _P2 = "(100 + event_id % 50)", "(100 + event_id % 47)"


def made_events(spark, sf_dir):
    """Six kinds of events in turn, with payloads as stores write them: sparse, with nulls, promotions and both prices."""
    e = dealt(spark, sf_dir, "events").select("event_id")
    n = F.col("event_id")
    p1, p2 = (F.lit(100) + n % 50).cast("string"), (F.lit(100) + n % 47).cast("string")
    pix = F.when(n % 2 == 0, ',"pix_price":90').otherwise("")
    j = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    kinds = [
        ("price_changed", j('{"price":"', p1, '","currency":" brl "', pix, "}"), j('{"price":', p2, '.00,"currency":"BRL"', pix, "}"), None),
        ("offer_created", F.lit(None), j('{"availability":"available","seller":null}'), j('{"price":', p1, ',"currency":"USD","seller":"shop"}')),
        ("promotion_activated", j('{"price":', p1, "}"), j('{"promotion_payload":{"promotion_price":"', p2, '","expires_at":"2024-05-01T10:00:00-03:00"}}'), j('{"price":', p1, ',"currency":"USD"}')),
        ("promotion_expired", j("{}"), j('{"price":', p2, "}"), j('{"promotion_price":', p1, ',"currency":"USD"}')),
        ("out_of_stock", j('{"price":', p1, ',"currency":"usd"}'), j('{"price":', p2, ',"availability":"out_of_stock"}'), None),
        ("weird", j('{"price":', p1, "}"), j('{"price":"1e3","original_price":', p2, "}"), None),
    ]
    pick = lambda i: F.element_at(F.array(*((x if not (x is None or isinstance(x, str)) else F.lit(x)).cast("string") for x in (k[i] for k in kinds))), (n % 6 + 1).cast("int"))
    return e.select("event_id", pick(0).alias("event_type"), pick(1).alias("before"), pick(2).alias("after"), pick(3).alias("snapshot"))


@query(f"""WITH m AS (SELECT event_id, event_id % 6 AS k, CAST({_P1} AS DECIMAL(18,4)) AS p1, CAST({_P2} AS DECIMAL(18,4)) AS p2, event_id % 2 = 0 AS pix FROM events),
x AS (SELECT event_id, k, CASE k WHEN 0 THEN 'price_changed' WHEN 1 THEN 'new_offer' WHEN 2 THEN 'promotion_activated' WHEN 3 THEN 'promotion_expired' WHEN 4 THEN 'out_of_stock' ELSE 'other' END AS shown_type,
 CASE WHEN k=0 AND pix AND p1=p2 THEN 90 WHEN k IN (0,2,3,4,5) THEN p1 END AS old_price, CASE WHEN k=0 AND pix AND p1=p2 THEN 90 WHEN k=1 THEN p1 WHEN k IN (0,2,5) THEN p2 END AS new_price,
 CASE WHEN k=0 AND pix AND p1=p2 THEN 'pix' WHEN k=3 THEN 'promotion' WHEN k<>1 THEN 'regular' END AS old_price_kind, CASE WHEN k=0 AND pix AND p1=p2 THEN 'pix' WHEN k=2 THEN 'promotion' WHEN k IN (0,1,5) THEN 'regular' END AS new_price_kind,
 CASE k WHEN 0 THEN 'BRL' WHEN 1 THEN 'USD' WHEN 2 THEN 'USD' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD' END AS currency, CASE k WHEN 0 THEN 'BRL' WHEN 2 THEN 'USD' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD' END AS old_currency,
 CASE k WHEN 1 THEN 'available' WHEN 4 THEN 'out_of_stock' END AS availability, CASE WHEN k=2 THEN 1714568400 END AS promotion_ends FROM m)
SELECT event_id, shown_type, CAST(old_price AS DECIMAL(18,4)) AS old_price, CAST(new_price AS DECIMAL(18,4)) AS new_price, old_price_kind, new_price_kind, old_currency, currency, CASE WHEN k<>0 THEN NULL WHEN new_price<old_price THEN 'decreased' WHEN new_price>old_price THEN 'increased' ELSE 'unchanged' END AS price_direction, availability, promotion_ends FROM x""")
def feed_projection(spark, sf_dir):
    d = fd.project(made_events(spark, sf_dir))
    return d.select("event_id", "shown_type", "old_price", "new_price", "old_price_kind", "new_price_kind", "old_currency", "currency", "price_direction", "availability", F.unix_timestamp("promotion_expires_at").alias("promotion_ends"))


_TYPE = "CASE event_type WHEN 'view' THEN 'availability_changed' WHEN 'click' THEN 'price_changed' WHEN 'purchase' THEN 'promotion_updated' WHEN 'error' THEN 'out_of_stock' ELSE 'new_offer' END"


def observed_events(spark, sf_dir):
    """Events as changes of a user's listing, of which several lie in one observation: some tell the hour of their
    scrape, promotions of odd number only that of the one before, and every seventh price changes its scale only."""
    e = t(spark, sf_dir, "events")
    n, hour = F.col("event_id"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    odd_promotion = (F.col("event_type") == "purchase") & (n % 2 == 1)
    scraped = lambda c: F.concat(F.lit(',"scraped_at":"'), c, F.lit('"'))
    before = F.concat(F.lit('{"price":"171","currency":"USD"'), scraped(F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit(" "), F.substring(hour, 1, 12))), F.lit("}"))
    price = F.when(n % 7 == 0, "171.00").otherwise((F.lit(172) + n % 9).cast("string"))
    after = F.concat(F.lit('{"price":"'), price, F.lit('","currency":"usd"'), F.when(odd_promotion, ',"promotion_status":"active"').when(n % 3 > 0, scraped(hour)).otherwise(""), F.lit("}"))
    return e.select(n.alias("id"), F.col("user_id").alias("listing"), F.expr(_TYPE).alias("event_type"), F.date_trunc("minute", "ts").alias("detected_at"), before.alias("before"), after.alias("after"))


@query(f"""WITH x AS (SELECT event_id AS id, user_id, {_TYPE} AS kind, date_trunc('minute', ts) AS detected, CASE WHEN event_type='purchase' AND event_id%2=1 THEN NULL WHEN event_id%3>0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%d %H') END AS after_at, strftime(date_trunc('hour', ts), '%Y-%m-%d %H')[1:12] AS before_at, event_type='purchase' AND event_id%2=1 AS old_style FROM events)
SELECT e.id, e.kind AS event_type FROM x e WHERE NOT (e.kind='price_changed' AND e.id%7=0) AND NOT EXISTS (SELECT 1 FROM x p WHERE p.user_id=e.user_id AND (p.detected=e.detected OR (p.after_at IS NULL AND p.old_style AND p.before_at=e.before_at) OR (e.after_at IS NOT NULL AND p.after_at=e.after_at))
 AND ((e.kind='availability_changed' AND p.kind='out_of_stock') OR (e.kind='price_changed' AND p.kind='promotion_updated') OR (e.kind='new_offer' AND p.kind='new_offer' AND p.id>e.id)))""")
def feed_summary(spark, sf_dir):
    return fd.summarize(observed_events(spark, sf_dir)).select("id", "event_type")


@query("""WITH f AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events WHERE event_type='purchase'),
c AS (SELECT seen, id FROM f ORDER BY seen DESC, id DESC LIMIT 1 OFFSET 9) SELECT f.id, f.seen FROM f, c WHERE f.seen < c.seen OR (f.seen = c.seen AND f.id < c.id) ORDER BY f.seen DESC, f.id DESC LIMIT 11""")
def feed_second_page(spark, sf_dir):
    """The page behind a first one of ten: its cursor is encoded, decoded and compared as a key."""
    d = t(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))
    last = tables.page(d, "seen", "id", 10).limit(10).orderBy("seen", "id").first()
    if last is None:
        return d.limit(0)
    at, id_ = tables.decode_cursor(tables.encode_cursor(last["seen"], str(last["id"])))
    return tables.page(d, "seen", "id", 10, (at, int(id_)))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'new_offer' WHEN 'click' THEN 'price_changed' WHEN 'purchase' THEN 'product_added' ELSE 'other' END AS shown FROM events""")
def event_type_remap(spark, sf_dir):
    raw = F.when(F.col("event_type") == "view", "offer_created").when(F.col("event_type") == "click", "price_changed").when(F.col("event_type") == "purchase", None).otherwise(F.col("event_type"))
    return t(spark, sf_dir, "events").select("event_id", fd.shown_type(raw).alias("shown"))
