"""Monitoring of listings: promotions, schedules, due rows and leases, checks and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import aware_time, next_check, promotion_active, regular_check, retry_delay

CONDITIONS = ("pix", "coupon", "prime", "choice", "app", "membership", "seller_coupon")


def _field(payload: Column, *names: str) -> Column:
    """The first of some fields of a JSON object that holds more than an empty text."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names))


def observe_promotion(metadata: Column, now: Column, price: Column, original: Column, sku: Column, product_id: Column) -> Column:
    """A listing's promotion as its metadata (JSON) states it: a struct, null without a start and an end.

    Times without an offset are of the promotion's own zone, which must be UTC here unless they are epochs.
    What the promotion leaves out comes from the offer."""
    promo = F.coalesce(F.get_json_object(metadata, "$.promotion"), F.get_json_object(metadata, "$.timed_promotion"))
    promo = F.when(promo.startswith("{"), promo)
    expires, starts = aware_time(_field(promo, "expires_at", "end_time", "finish_date")), aware_time(_field(promo, "starts_at", "start_time", "start_date"))
    amount = lambda *names: _field(promo, *names).try_cast("decimal(18,4)")
    stated = [F.struct(F.lit(k).alias("key"), F.coalesce(F.get_json_object(promo, f"$.conditions.{k}"), F.get_json_object(promo, f"$.{k}")).alias("value")) for k in CONDITIONS]
    conditions = F.map_from_entries(F.filter(F.array(*stated), lambda e: e["value"].isNotNull()))
    found = F.struct(
        F.when(expires <= now, "expired").otherwise("active").alias("status"),
        F.coalesce(_field(promo, "type", "promotion_type"), F.lit("timed")).alias("promotion_type"),
        starts.alias("starts_at"),
        expires.alias("expires_at"),
        F.coalesce(amount("promotion_price", "price"), price).alias("promotion_price"),
        F.coalesce(amount("original_price"), original).alias("original_price"),
        conditions.alias("conditions"),
        F.coalesce(_field(promo, "source"), F.lit("metadata.promotion")).alias("source"),
        F.coalesce(_field(promo, "sku"), sku).alias("sku"),
        F.coalesce(_field(promo, "product_id"), product_id).alias("product_id"),
    )
    return F.when(expires.isNotNull() | starts.isNotNull(), found)


def of_same_item(seen: Column, sku: Column, product_id: Column) -> Column:
    """Whether an observation is of the listing's own variant: both codes agree where both are known."""
    other = lambda a, b: F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & (F.trim(a) != F.trim(b)), F.lit(False))
    return ~other(seen["sku"], sku) & ~F.coalesce(seen["product_id"] != product_id, F.lit(False))


def apply_promotion(listings: DataFrame, seen: str = "seen") -> DataFrame:
    """Listings after one observation each (null: none), with promotion_events.

    Takes now, sku, product_id, promotion_status, promotion_price, promotion_expires_at and the observation."""
    s, status, old = F.col(seen), F.col("promotion_status"), F.col("promotion_expires_at")
    counts = s.isNotNull() & of_same_item(s, F.col("sku"), F.col("product_id"))
    ran_out = s.isNull() & (status == "active") & (old <= F.col("now"))
    after = F.when(s["expires_at"] <= F.col("now"), "expired").otherwise(s["status"])
    active = F.coalesce(status == "active", F.lit(False))
    events = F.array_compact(
        F.array(
            F.when(counts & ~active & (after == "active"), "promotion_activated"),
            F.when((counts & active & (after == "expired")) | ran_out, "promotion_expired"),
            F.when(counts & active & (after == "active") & s["expires_at"].isNotNull() & ~s["expires_at"].eqNullSafe(old), "promotion_updated"),
        )
    )
    take = lambda name, own: F.when(counts, s[name]).otherwise(F.col(own))
    new_status = F.when(counts, after).when(ran_out, "expired").otherwise(status)
    return listings.withColumns({"promotion_events": events, "promotion_status": new_status, "promotion_price": take("promotion_price", "promotion_price"), "promotion_expires_at": take("expires_at", "promotion_expires_at")})


def expire_promotions(listings: DataFrame) -> DataFrame:
    """Listings with active promotions whose end has come set to expired; expired tells which."""
    over = F.coalesce((F.col("promotion_status") == "active") & (F.col("promotion_expires_at") <= F.col("now")), F.lit(False))
    return listings.withColumn("expired", over).withColumn("promotion_status", F.when(over, "expired").otherwise(F.col("promotion_status")))


def after_success(listings: DataFrame) -> DataFrame:
    """A check that went well: counters cleared, change times from the events, the next check set, the lease free.
    A removed listing is checked no more. Takes id, now, status, events (array) and promotion columns."""
    removed = F.col("status") == "removed"
    has = lambda *names: F.arrays_overlap("events", F.array(*map(F.lit, names)))
    live = F.when(promotion_active(F.col("promotion_status"), F.col("promotion_expires_at"), F.col("now")), F.col("promotion_expires_at"))
    regular = regular_check(F.col("now"), F.col("id"))
    nothing = F.lit(None).cast("timestamp")
    return listings.withColumns(
        {
            "last_checked_at": F.col("now"),
            "consecutive_failures": F.lit(0),
            "last_check_error": F.lit(None).cast("string"),
            "last_price_changed_at": F.when(~removed & has("price_changed"), F.col("now")).otherwise(F.col("last_price_changed_at")),
            "last_availability_changed_at": F.when(~removed & has("availability_changed", "out_of_stock"), F.col("now")).otherwise(F.col("last_availability_changed_at")),
            "monitoring_enabled": ~removed,
            "next_check_at": F.when(~removed, next_check(regular, live, F.col("now"))),
            "claim_expires_at": nothing,
        }
    )


def after_failure(listings: DataFrame) -> DataFrame:
    """A check that failed: one failure more, the error's first 2000 characters, a doubled delay, the lease free."""
    failures = F.coalesce("consecutive_failures", F.lit(0)) + 1
    return listings.withColumns(
        {
            "last_checked_at": F.col("now"),
            "consecutive_failures": failures,
            "last_check_error": F.substring(F.coalesce("error", F.lit("")), 1, 2000),
            "next_check_at": F.timestamp_seconds(F.unix_timestamp("now") + retry_delay(failures)),
            "claim_expires_at": F.lit(None).cast("timestamp"),
        }
    )


def lease_free(expires: Column, now: Column) -> Column:
    return expires.isNull() | (expires <= now)


def due_listings(listings: DataFrame) -> DataFrame:
    """Listings to be checked, with urgency: a promotion over (1), a retry (2), the regular check (3)."""
    now, status, ends = F.col("now"), F.col("promotion_status"), F.col("promotion_expires_at")
    over = F.coalesce((status == "active") & (ends <= now), F.lit(False))
    due = F.coalesce(F.col("next_check_at") <= now, F.lit(False)) | over
    urgent = over | F.coalesce((status == "expired") & ends.isNotNull(), F.lit(False))
    d = listings.where(F.col("monitoring_enabled") & (F.col("status") == "active") & lease_free(F.col("claim_expires_at"), now) & due)
    return d.withColumn("urgency", F.when(urgent, 1).when(F.col("consecutive_failures") > 0, 2).otherwise(3))


def effective_due(next_at: Column, promotion_status: Column, promotion_ends: Column, now: Column) -> Column:
    """When a listing is really due: at once if its promotion is over."""
    return F.least(next_at, F.when((promotion_status == "active") & (promotion_ends <= now), now))


def due_runs(runs: DataFrame) -> DataFrame:
    """Runs that wait, or whose worker's lease is over."""
    return runs.where(F.lower("status").isin("pending", "running") & lease_free(F.col("claim_expires_at"), F.col("now")))


def due_images(images: DataFrame) -> DataFrame:
    """Images to be worked on: the original is on its way or stored, and the work waits or its lease is over."""
    free = lease_free(F.col("claim_expires_at"), F.col("now"))
    original = F.col("original_status").isin("pending", "downloading") | ((F.col("original_status") == "ready") & F.col("file_id").isNotNull())
    waits = (F.col("optimized_status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.col("now"))) & free
    return images.where(original & (waits | ((F.col("optimized_status") == "processing") & free)))


def claim(due: DataFrame, order: list[Column], limit: int, worker: str, lease_seconds: int) -> DataFrame:
    """The first `limit` due rows with their new lease: worker, claim_expires_at, attempts, and whether it was
    taken from another worker. Rows are not locked: two claims of one table must not run side by side."""
    reclaimed = (F.lower("status") == "running") & (F.coalesce("attempts", F.lit(0)) > 0)
    d = due.orderBy(*order).limit(limit)
    return d.withColumns({"reclaimed": F.coalesce(reclaimed, F.lit(False)), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "status": F.lit("running"), "worker": F.lit(worker), "claim_expires_at": F.timestamp_seconds(F.unix_timestamp("now") + lease_seconds)})


def attempt_budget(attempts: DataFrame, key: list[str], order: list[str], budgets: dict[str, int]) -> DataFrame:
    """Attempts with whether each is inside its kind's budget, and the first budget of the key that ran out.
    Takes kind; attempts of a kind without a budget are inside."""
    limit = F.lit(1 << 62)
    for kind, n in budgets.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    w = Window.partitionBy(*key, "kind").orderBy(*order)
    d = attempts.withColumn("within", F.row_number().over(w) <= limit)
    first = Window.partitionBy(*key)
    place = F.struct(*order)
    stopped = F.min_by(F.when(~F.col("within"), F.concat("kind", F.lit("_budget"))), F.when(~F.col("within"), place)).over(first)
    return d.withColumn("stopped_reason", stopped)


def stage_totals(stages: DataFrame, key: str) -> DataFrame:
    """Summed times of a run's stages, of its retries apart, and how many there were."""
    retry = F.col("attempt") > 1
    return stages.groupBy(key).agg(F.sum("ms").alias("total_ms"), F.coalesce(F.sum(F.when(retry, F.col("ms"))), F.lit(0)).alias("retry_ms"), F.count_if(retry).alias("retries"))


def oldest_delay(due: DataFrame) -> DataFrame:
    """Seconds by which the longest due row is late."""
    return due.agg(F.greatest(F.lit(0), F.max(F.unix_timestamp("now") - F.unix_timestamp("next_check_at"))).alias("delay_s"))
