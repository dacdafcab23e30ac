"""The change feed: what stands for one observation, the prices to tell, and the types of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import aware_time, json_amount, plain_amount

#: Types that a feed shows; any other is told as "other".
TYPES = ("product_added", "new_offer", "price_changed", "availability_changed", "offer_removed", "out_of_stock", "promotion_activated", "promotion_expired", "promotion_updated", "seller_changed", "gtin_learned", "scrape_failed", "unchanged")
PROMOTIONS = ("promotion_activated", "promotion_expired", "promotion_updated")


def shown_type(kind: Column) -> Column:
    """An event's type in the feed; a product without an event was added."""
    named = F.when(kind == "offer_created", "new_offer").otherwise(F.coalesce(kind, F.lit("product_added")))
    return F.when(named.isin(*TYPES), named).otherwise("other")


def text(payload: Column, *path: str) -> Column:
    return F.get_json_object(payload, "$." + ".".join(path))


def currency(payload: Column) -> Column:
    return F.nullif(F.upper(F.trim(text(payload, "currency"))), F.lit(""))


def commercial_price(payload: Column) -> Column:
    """What a buyer pays without a promotion: the instant-payment price, else the regular, else the original one."""
    return F.coalesce(*(json_amount(payload, k) for k in ("pix_price", "price", "original_price")))


#: Fields of a payload that a price is told from, and the places of a promotion.
PRICES = ("pix_price", "price", "original_price")
PROMO = (("promotion_payload",), ("metadata", "promotion"))


def with_told_prices(d: DataFrame, sides: dict[str, Column], promotional: Column) -> DataFrame:
    """Columns `_<side>_amount` and `_<side>_kind` of the payloads (JSON): in a promotion its price from three places, else the
    commercial price. Each field is read once a row: texts, amounts and choices are columns of projections that follow
    each other, not structs, which the optimizer would work out anew at every use."""
    sure = F.coalesce(promotional, F.lit(False))
    d = d.withColumns({f"_{n}_promo": F.when(sure, F.coalesce(*(text(p, *path) for path in PROMO))) for n, p in sides.items()})
    texts = {f"_{n}_{k}_text": text(p, k) for n, p in sides.items() for k in PRICES}
    for n, p in sides.items():
        promo = F.col(f"_{n}_promo")
        texts |= {f"_{n}_promo0_text": F.when(sure, text(p, "promotion_price")), f"_{n}_promo1_text": F.when(sure, text(promo, "promotion_price")), f"_{n}_promo2_text": F.when(sure, text(promo, "price"))}
    d = d.withColumns(texts)
    order = {"promo0": "promotion", "promo1": "promotion", "promo2": "promotion", "pix_price": "pix", "price": "regular", "original_price": "regular"}
    plain = {f"_{n}_{k}": plain_amount(F.col(f"_{n}_{k}_text")) for n in sides for k in order}
    d = d.withColumns(plain)
    out = {}
    for n in sides:
        kind = F.lit(None).cast("string")
        for k, name in reversed(order.items()):
            kind = F.when(F.col(f"_{n}_{k}").isNotNull(), name).otherwise(kind)
        out |= {f"_{n}_amount": F.coalesce(*(F.col(f"_{n}_{k}") for k in order)), f"_{n}_kind": kind}
    return d.withColumns(out)


def over(first: Column, second: Column, use: Column) -> Column:
    """Two JSON objects as one, where asked for: of a key in both the second's value holds, even a null."""
    merged = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.when(use, F.to_json(merged(fields(first), fields(second)), {"ignoreNullFields": "false"})).otherwise(second)


def project(events: DataFrame) -> DataFrame:
    """Events (event_type, before, after, snapshot as JSON) with what the feed tells of them: prices, their kinds,
    currencies, direction, availability, sellers and the promotion's end. A creation or promotion that tells too
    little is filled up from the snapshot; what is gone has no new price."""
    kind = F.col("event_type")
    promotional = F.coalesce(kind.startswith("promotion_"), F.lit(False))
    created, ended = kind.isin("offer_created", "new_offer"), kind == "promotion_expired"
    d = events.withColumn("_after", over(F.col("snapshot"), F.col("after"), F.coalesce(created | (promotional & ~ended), F.lit(False)))).withColumn("_before", over(F.col("snapshot"), F.col("before"), F.coalesce(ended, F.lit(False))))
    d = with_told_prices(d, {"old": F.col("_before"), "new": F.col("_after")}, promotional)
    # where the instant-payment price stayed, the regular one is what changed; a price change is never filled up, so its price is its own
    changed = F.coalesce(kind == "price_changed", F.lit(False))
    regular = changed & F.coalesce(F.col("_old_amount").eqNullSafe(F.col("_new_amount")) & (F.col("_old_price") != F.col("_new_price")), F.lit(False))
    told = {f"_{n}_amount": F.when(regular, F.col(f"_{n}_price")).otherwise(F.col(f"_{n}_amount")) for n in ("old", "new")}
    d = d.withColumns(told | {f"_{n}_kind": F.when(regular, "regular").otherwise(F.col(f"_{n}_kind")) for n in ("old", "new")})
    from_snapshot = F.when(promotional, currency(F.col("snapshot")))
    old_currency, new_currency = F.coalesce(currency(F.col("_before")), from_snapshot), F.coalesce(currency(F.col("_after")), from_snapshot)
    d = d.withColumns({"_old_currency": old_currency, "_new_currency": new_currency})
    old_currency, new_currency = F.col("_old_currency"), F.col("_new_currency")
    gone = F.coalesce(kind.isin("offer_removed", "out_of_stock", "promotion_expired"), F.lit(False))
    d = d.withColumn("old_currency", old_currency).withColumn("currency", F.when(gone, F.coalesce(new_currency, old_currency)).otherwise(new_currency))
    d = d.withColumn("old_price", F.col("_old_amount")).withColumn("new_price", F.when(~gone, F.col("_new_amount"))).withColumn("old_price_kind", F.col("_old_kind")).withColumn("new_price_kind", F.when(~gone, F.col("_new_kind")))
    comparable = (kind == "price_changed") & (F.col("old_currency") == F.col("currency"))
    step = F.when(F.col("new_price") < F.col("old_price"), "decreased").when(F.col("new_price") > F.col("old_price"), "increased").when(F.col("new_price") == F.col("old_price"), "unchanged")
    d = d.withColumn("_ends", F.coalesce(text(F.col("_after"), "promotion_expires_at"), text(text(F.col("_after"), "promotion_payload"), "expires_at")))
    end = aware_time(F.col("_ends"))
    return d.select(
        *events.columns,
        shown_type(kind).alias("shown_type"),
        "old_currency",
        "currency",
        "old_price",
        "new_price",
        "old_price_kind",
        "new_price_kind",
        F.when(comparable, step).alias("price_direction"),
        text(F.col("_before"), "availability").alias("old_availability"),
        text(F.col("_after"), "availability").alias("availability"),
        text(F.col("_before"), "seller").alias("old_seller"),
        text(F.col("_after"), "seller").alias("seller"),
        end.alias("promotion_expires_at"),
    )


def same_price(before: Column, after: Column) -> Column:
    """A price change that changes no price: equal amounts in one currency, the regular ones too."""
    old, new = commercial_price(before), commercial_price(after)
    return F.coalesce((old == new) & (currency(before) == currency(after)) & json_amount(before, "price").eqNullSafe(json_amount(after, "price")), F.lit(False))


def observation_keys(events: DataFrame) -> DataFrame:
    """Events with the keys by which two of a listing are of one observation: the time of detection, the time
    of the scrape after, and, of promotions that lack it, the time of the scrape before."""
    after, before = text(F.col("after"), "scraped_at"), text(F.col("before"), "scraped_at")
    old_style = after.isNull() & before.isNotNull() & text(F.col("after"), "promotion_status").isNotNull() & text(F.col("after"), "source").isNull()
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), c))
    mine = F.array_compact(F.array(tag("d:", F.col("detected_at").cast("string")), tag("a:", after), tag("b:", before)))
    gives = F.array_compact(F.array(tag("d:", F.col("detected_at").cast("string")), tag("a:", after), F.when(old_style, tag("b:", before))))
    return events.withColumn("_mine", mine).withColumn("_gives", gives)


def summarize(events: DataFrame) -> DataFrame:
    """The feed without price changes that change nothing and without events that another one of the same observation
    stands for: availability by a removal or lack of stock, a price by a promotion, a new offer by a later one.

    Observations are told apart by equal keys, so each event's keys are joined with what outranks it there; a listing with
    many events is never joined with itself as a whole. Takes id, listing, event_type, detected_at, before, after (JSON)."""
    kind = F.col("event_type")
    d = observation_keys(events.where((kind != "price_changed") | ~same_price(F.col("before"), F.col("after"))))
    peers = observation_keys(events).select("listing", F.explode("_gives").alias("key"), "event_type", "id")
    # per observation: whether something outranks an availability or a price, and the last new offer
    is_ = lambda *names: F.col("event_type").isin(*names)
    peers = peers.groupBy("listing", "key").agg(F.max(is_("out_of_stock", "offer_removed")).alias("gone"), F.max(is_(*PROMOTIONS)).alias("promoted"), F.max(F.when(is_("new_offer", "offer_created"), F.col("id"))).alias("newest"))
    asked = d.where(kind.isin("availability_changed", "price_changed", "new_offer", "offer_created")).select("id", "listing", "event_type", F.explode("_mine").alias("key"))
    beaten = ((kind == "availability_changed") & F.col("gone")) | ((kind == "price_changed") & F.col("promoted")) | (kind.isin("new_offer", "offer_created") & (F.col("newest") > F.col("id")))
    out = asked.join(peers, ["listing", "key"]).where(beaten).select("id").distinct()
    return d.drop("_mine", "_gives").join(out, "id", "left_anti")
