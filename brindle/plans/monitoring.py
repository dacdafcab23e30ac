"""Queries of monitoring: orders stand for monitored listings, runs and images, whose state is made from their columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as vx
from ..operators import fx, monitoring, tables
from .registry import query, seconds_exact, t

NOW = "1997-06-01 00:00:00"
_ENDS = "CASE WHEN o_orderkey % 5 < 2 THEN o_orderdate + (o_orderkey % 9 - 4) * INTERVAL 1 DAY END"
_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'expired' END"
_CLAIM = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END"


def listings(spark, sf_dir):
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    days = lambda c: F.make_dt_interval(c)
    return t(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(F.col("o_orderstatus") == "F", "removed").otherwise("active").alias("status"),
        (key % 11 > 0).alias("monitoring_enabled"),
        date.alias("next_check_at"),
        F.when(key % 3 == 0, date + days(F.lit(30))).alias("claim_expires_at"),
        F.when(key % 5 == 0, "active").when(key % 5 == 1, "expired").alias("promotion_status"),
        F.when(key % 5 < 2, date + days((key % 9 - 4).cast("int"))).alias("promotion_expires_at"),
        F.lit(None).cast("decimal(18,4)").alias("promotion_price"),
        (key % 4).cast("int").alias("consecutive_failures"),
        F.lit(NOW).cast("timestamp").alias("now"),
        F.concat(F.lit("k"), (key % 2).cast("string")).alias("sku"),
        F.lit("p").alias("product_id"),
    )


_DUE = f"""SELECT o_orderkey AS id, CASE WHEN ({_STATUS} = 'active' AND {_ENDS} <= TIMESTAMP '{NOW}') OR ({_STATUS} = 'expired' AND {_ENDS} IS NOT NULL) THEN 1 WHEN o_orderkey % 4 > 0 THEN 2 ELSE 3 END AS urgency, o_orderdate FROM orders
WHERE o_orderstatus <> 'F' AND o_orderkey % 11 > 0 AND ({_CLAIM} IS NULL OR {_CLAIM} <= TIMESTAMP '{NOW}') AND (o_orderdate <= TIMESTAMP '{NOW}' OR coalesce({_STATUS} = 'active' AND {_ENDS} <= TIMESTAMP '{NOW}', false))"""


@query(f"SELECT id, urgency FROM ({_DUE})")
def due_listings(spark, sf_dir):
    return monitoring.due_listings(listings(spark, sf_dir)).select("id", "urgency")


@query(f"SELECT id, urgency, 1 AS attempts, false AS reclaimed, epoch(TIMESTAMP '{NOW}')::BIGINT + 300 AS until FROM ({_DUE}) ORDER BY urgency, o_orderdate NULLS LAST, id LIMIT 200")
def claim_listings(spark, sf_dir):
    """The first 200 due listings, most urgent first, with a worker's lease."""
    due = monitoring.due_listings(listings(spark, sf_dir)).withColumn("attempts", F.lit(None).cast("int"))
    order = [F.col("urgency"), F.col("next_check_at").asc_nulls_last(), F.col("id")]
    return monitoring.claim(due, order, 200, "w1", 300).select("id", "urgency", "attempts", "reclaimed", F.unix_timestamp("claim_expires_at").alias("until"))


@query(f"SELECT o_orderkey AS id, epoch(least(o_orderdate, coalesce(CASE WHEN {_STATUS} = 'active' AND {_ENDS} <= TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' END, o_orderdate)))::BIGINT AS due FROM orders")
def effective_due(spark, sf_dir):
    d = listings(spark, sf_dir)
    due = monitoring.effective_due(F.col("next_check_at"), F.col("promotion_status"), F.col("promotion_expires_at"), F.col("now"))
    return d.select("id", F.unix_timestamp(due).alias("due"))


@query(f"SELECT greatest(0, epoch(TIMESTAMP '{NOW}')::BIGINT - min(epoch(o_orderdate))::BIGINT) AS delay_s FROM ({_DUE})")
def due_delay(spark, sf_dir):
    """How late the longest due listing is."""
    return monitoring.oldest_delay(monitoring.due_listings(listings(spark, sf_dir)))


@query(f"""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'running' END AS status FROM orders WHERE o_orderstatus IN ('P', 'O') AND ({_CLAIM} IS NULL OR {_CLAIM} <= TIMESTAMP '{NOW}')""")
def due_match_runs(spark, sf_dir):
    """Runs that wait or whose worker is lost."""
    runs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    d = runs.join(listings(spark, sf_dir).select("id", "claim_expires_at", "now"), "id")
    return monitoring.due_runs(d).select("id", "status")


@query(f"""SELECT o_orderkey AS id, o_orderkey % 6 > 0 AND o_orderkey % 4 > 0 AS reclaimed, CAST(o_orderkey % 6 + 1 AS INT) AS attempts FROM orders WHERE {_CLAIM} IS NULL OR {_CLAIM} <= TIMESTAMP '{NOW}' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def reclaim_runs(spark, sf_dir):
    """The hundred oldest due runs with a new lease; those that ran before are taken over."""
    d = listings(spark, sf_dir).withColumn("status", F.when(F.col("id") % 4 == 0, "pending").otherwise("running")).withColumn("attempts", (F.col("id") % 6).cast("int"))
    return monitoring.claim(monitoring.due_runs(d), [F.col("next_check_at"), F.col("id")], 100, "w2", 120).select("id", "reclaimed", "attempts")


@query(f"""SELECT o_orderkey AS id FROM orders WHERE (o_orderkey % 4 IN (0, 1) OR (o_orderkey % 4 = 2 AND o_orderkey % 7 > 0)) AND ((o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 AND o_orderdate <= TIMESTAMP '{NOW}') OR (o_orderkey % 3 = 0 AND {_CLAIM} <= TIMESTAMP '{NOW}' AND o_orderkey % 2 = 0 AND o_orderdate <= TIMESTAMP '{NOW}') OR (o_orderkey % 2 = 1 AND ({_CLAIM} IS NULL OR {_CLAIM} <= TIMESTAMP '{NOW}')))""")
def due_images(spark, sf_dir):
    key = F.col("id")
    original = F.element_at(F.array(*map(F.lit, ("pending", "downloading", "ready", "failed"))), (key % 4 + 1).cast("int"))
    d = listings(spark, sf_dir).select("id", original.alias("original_status"), F.when(key % 7 > 0, "f").alias("file_id"), F.when(key % 2 == 0, "pending").otherwise("processing").alias("optimized_status"), F.col("next_check_at").alias("next_attempt_at"), "claim_expires_at", "now")
    return monitoring.due_images(d).select("id")


@query(f"""WITH l AS (SELECT o_orderkey AS id, {_STATUS} AS status, {_ENDS} AS ends, o_orderkey % 4 AS k, o_orderdate + (o_orderkey % 7) * INTERVAL 1 DAY AS new_ends FROM orders),
s AS (SELECT *, k = 0 AS none, k = 1 AND id % 2 = 0 AS other, CASE WHEN new_ends <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS new_status FROM l)
SELECT id, CASE WHEN none THEN CASE WHEN status = 'active' AND ends <= TIMESTAMP '{NOW}' THEN 'promotion_expired' ELSE '' END WHEN other THEN '' WHEN new_status = 'active' AND status IS DISTINCT FROM 'active' THEN 'promotion_activated' WHEN new_status = 'expired' AND status = 'active' THEN 'promotion_expired' WHEN status = 'active' AND new_status = 'active' AND new_ends <> ends THEN 'promotion_updated' ELSE '' END AS events,
 CASE WHEN none THEN CASE WHEN status = 'active' AND ends <= TIMESTAMP '{NOW}' THEN 'expired' ELSE status END WHEN other THEN status ELSE new_status END AS status FROM s""")
def promotion_observations(spark, sf_dir):
    """One observation of each listing's promotion from its metadata: none, of another variant, or with an end."""
    d = listings(spark, sf_dir)
    ends = F.unix_timestamp(F.col("next_check_at") + F.make_dt_interval((F.col("id") % 7).cast("int"))).cast("string")
    sku = F.when(F.col("id") % 4 == 1, '"k1"').otherwise("null")
    meta = F.when(F.col("id") % 4 == 0, '{"promotion":{"type":"x"}}').otherwise(F.concat(F.lit('{"promotion":{"expires_at":'), ends, F.lit(',"sku":'), sku, F.lit(',"promotion_price":"9.90"}}')))
    nothing = F.lit(None).cast("decimal(18,4)")
    seen = monitoring.observe_promotion(meta, F.col("now"), nothing, nothing, F.lit(None).cast("string"), F.lit("p"))
    # listings of even number hold another variant than the k1 that every fourth observation is of
    d = d.withColumn("seen", seen).withColumn("sku", F.when(F.col("id") % 2 == 0, "k0").otherwise("k1"))
    return monitoring.apply_promotion(d).select("id", F.array_join("promotion_events", ",").alias("events"), F.col("promotion_status").alias("status"))


@query(f"""SELECT o_orderkey AS id, coalesce({_STATUS} = 'active' AND {_ENDS} <= TIMESTAMP '{NOW}', false) AS expired, CASE WHEN {_STATUS} = 'active' AND {_ENDS} <= TIMESTAMP '{NOW}' THEN 'expired' ELSE {_STATUS} END AS status FROM orders""")
def promotion_expiry(spark, sf_dir):
    return monitoring.expire_promotions(listings(spark, sf_dir)).select("id", "expired", F.col("promotion_status").alias("status"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN {_STATUS} = 'active' AND {_ENDS} > TIMESTAMP '{NOW}' AND epoch({_ENDS})::BIGINT + 60 < epoch(TIMESTAMP '{NOW}')::BIGINT + 43200 THEN 'promotion' ELSE 'regular' END AS next, o_orderstatus <> 'F' AND o_orderkey % 2 = 0 AS price, o_orderstatus <> 'F' AS enabled FROM orders""")
def check_success(spark, sf_dir):
    """Checks that went well: what decides the next one, and whether a price change was noted."""
    d = listings(spark, sf_dir).withColumn("events", F.when(F.col("id") % 2 == 0, F.array(F.lit("price_changed"))).otherwise(F.array(F.lit("unchanged"))))
    never = F.lit(None).cast("timestamp")
    d = monitoring.after_success(d.withColumn("last_price_changed_at", never).withColumn("last_availability_changed_at", never))
    soon = F.unix_timestamp("next_check_at") < F.unix_timestamp("now") + 43200
    return d.select("id", F.when(F.col("next_check_at").isNull(), None).when(soon, "promotion").otherwise("regular").alias("next"), F.col("last_price_changed_at").isNotNull().alias("price"), F.col("monitoring_enabled").alias("enabled"))


@query(f"""SELECT o_orderkey AS id, CAST(o_orderkey % 4 + 1 AS INT) AS failures, epoch(TIMESTAMP '{NOW}')::BIGINT + CAST(least(3600, 300 * pow(2, o_orderkey % 4)) AS BIGINT) AS next, 2000 AS kept FROM orders""")
def check_failure(spark, sf_dir):
    d = monitoring.after_failure(listings(spark, sf_dir).withColumn("error", F.repeat(F.lit("x"), 2500)))
    return d.select("id", F.col("consecutive_failures").alias("failures"), F.unix_timestamp("next_check_at").alias("next"), F.length("last_check_error").alias("kept"))


@query("""WITH x AS (SELECT user_id, event_id, event_type AS kind, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 12 WHEN 'purchase' THEN 8 END AS budget, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, ts FROM events), o AS (SELECT user_id, kind FROM x WHERE n > budget QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT x.event_id, budget IS NULL OR n <= budget AS within, o.kind || '_budget' AS stopped_reason FROM x LEFT JOIN o USING (user_id)""")
def attempt_budgets(spark, sf_dir):
    """Three budgets of each user, and the first that ran out."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), "ts")
    return monitoring.attempt_budget(e, ["user_id"], ["ts", "event_id"], {"view": 5, "click": 12, "purchase": 8}).select("event_id", "within", "stopped_reason")


@query("""SELECT l_orderkey AS run, CAST(sum(l_quantity) AS BIGINT) AS total_ms, CAST(coalesce(sum(l_quantity) FILTER (l_linenumber > 1), 0) AS BIGINT) AS retry_ms, count(*) FILTER (l_linenumber > 1) AS retries FROM lineitem GROUP BY 1""")
def stage_totals(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("long").alias("ms"), F.col("l_linenumber").alias("attempt"))
    return monitoring.stage_totals(d, "run")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT WHEN 2 THEN epoch(date_trunc('minute', ts))::BIGINT + 10800 WHEN 3 THEN epoch(date_trunc('second', ts))::BIGINT + 7200 WHEN 4 THEN epoch(date_trunc('second', ts))::BIGINT END AS at FROM events""")
def aware_times(spark, sf_dir):
    """Points in time from the forms that stores write: epochs in seconds and milliseconds, local, with an offset, without one."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    whole = F.floor(seconds_exact("ts"))
    text = F.when(n == 0, whole.cast("string")).when(n == 1, (whole * 1000 + 17).cast("string")).when(n == 2, F.date_format(ts, "yyyy/MM/dd HH:mm")).when(n == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-02:00"))).when(n == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return t(spark, sf_dir, "events").select("event_id", F.unix_timestamp(vx.aware_time(text)).alias("at"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 500 WHEN 1 THEN greatest(0, epoch(date_trunc('second', ts))::BIGINT - 1704067200) END AS wait FROM events""")
def retry_after(spark, sf_dir):
    n = F.col("event_id") % 3
    header = F.when(n == 0, (F.col("event_id") % 500).cast("string")).when(n == 1, F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("later")
    return t(spark, sf_dir, "events").select("event_id", F.when(n < 2, vx.retry_after(header, F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("wait"))


@query("""SELECT event_id, true AS regular, true AS jittered, true AS rates, CASE WHEN event_id % 3 = 0 THEN true ELSE ts <= TIMESTAMP '2024-01-05' END AS crawl FROM events""")
def schedule_bounds(spark, sf_dir):
    """Regular checks, full jitter and the fetching of rates stay inside their bounds; a crawl is due when its time has come
    or it was never scheduled."""
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    key, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    regular = F.unix_timestamp(vx.regular_check(now, key)) - F.unix_timestamp(now)
    jitter = vx.full_jitter(key % 10, key)
    late = vx.rates_due(F.timestamp_seconds(F.unix_timestamp(now) - 3960), key, now) & ~vx.rates_due(F.timestamp_seconds(F.unix_timestamp(now) - 3599), key, now)
    return t(spark, sf_dir, "events").select("event_id", regular.between(43200, 43800).alias("regular"), ((jitter >= 0) & (jitter < 60) & (jitter < F.pow(F.lit(2.0), key % 10))).alias("jittered"), late.alias("rates"), vx.crawl_due(F.when(key % 3 > 0, ts), now).alias("crawl"))


@query("""SELECT CAST(r AS VARCHAR) AS base, 'BRL' AS quote, 'ptax_agreement' AS "check", count(*) AS n FROM (SELECT user_id AS r, 500 + event_id % 10 AS a, 500 + event_id % 7 AS b FROM events) WHERE abs(a - b) * 100 > b * 0.5 GROUP BY 1 UNION ALL SELECT CAST(user_id AS VARCHAR), 'BRL', 'tourism_premium', count(*) FROM events WHERE NOT (event_id % 80 >= event_id % 7 AND (500 + event_id % 80) * 100 <= (500 + event_id % 7) * 112) GROUP BY 1""")
def rate_cross_checks(spark, sf_dir):
    """Rates of several sources against each other, source by source: agreement and the tourists' premium."""
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"))
    base = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("n").cast("string"))
    rate = lambda c, kind, source: e.select(base.alias("base"), F.lit("BRL").alias("quote"), F.lit(kind).alias("rate_type"), (c / 100).cast("decimal(24,12)").alias("rate"), F.lit(source).alias("source"))
    bank = rate(500 + F.col("n") % 7, "ptax_sell", "bank")
    paper = rate(500 + F.col("n") % 10, "ptax_sell", "paper")
    tourism = rate(500 + F.col("n") % 80, "tourism_sell", "paper")
    agreement = fx.cross_checks(bank.unionByName(paper)).where("check = 'ptax_agreement'")
    premium = fx.cross_checks(rate(500 + F.col("n") % 7, "ptax_sell", "bank").unionByName(tourism)).where("check = 'tourism_premium'")
    d = agreement.unionByName(premium)
    return d.groupBy(F.substring_index("base", "/", 1).alias("base"), "quote", "check").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '1997-05-31' THEN 'stale' ELSE 'fresh' END AS status FROM orders""")
def stale_rates(spark, sf_dir):
    d = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"))
    return fx.mark_stale(d, NOW).select("id", "status")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * CAST('5.3034' AS DECIMAL(19,12)), 2) AS DECIMAL(38,12)) WHEN 1 THEN CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 2) AS DECIMAL(38,12)) END AS converted_price, CASE o_orderkey % 3 WHEN 0 THEN 'tourism_sell' WHEN 1 THEN 'official' END AS rate_type, CASE WHEN o_orderkey % 3 = 2 THEN 'no_rate' END AS reason FROM orders""")
def attached_conversion(spark, sf_dir):
    from .catalog import rates

    code = F.element_at(F.array(*map(F.lit, (" usd", "BRL", "XXX"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    d = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), code.alias("currency"))
    return fx.attach(d, rates(spark)).select("id", "converted_price", "rate_type", "reason")


@query("""SELECT s_suppkey, s_name, 'own' AS branch FROM supplier WHERE s_acctbal > 0""")
def empty_branch(spark, sf_dir):
    """Two branches of which the filters rule one out: only the other's table is read."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    other = t(spark, sf_dir, "customer").where(F.lit(False)).select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    both = s.withColumn("branch", F.lit("own")).unionByName(other.withColumn("branch", F.lit("none")))
    return both.where("s_acctbal > 0").select("s_suppkey", "s_name", "branch")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS parent, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AS refused FROM customer UNION ALL SELECT c_custkey + 1000000, c_nationkey, 'new', false FROM customer WHERE c_custkey % 10 = 0""")
def listing_upsert(spark, sf_dir):
    """An upsert by key in which no listing is moved to another product; those of no product yet take the new one."""
    c = t(spark, sf_dir, "customer")
    key, parent = F.col("c_custkey"), F.col("c_nationkey")
    old = c.select("c_custkey", F.when(key % 3 > 0, parent).alias("parent"), "c_mktsegment")
    same = c.select("c_custkey", F.when((key % 2 == 0) | (key % 3 == 0), parent + 100).alias("parent"), F.when(key % 2 == 0, "new").alias("c_mktsegment"))
    more = c.where(key % 10 == 0).select((key + 1000000).alias("c_custkey"), parent.alias("parent"), F.lit("new").alias("c_mktsegment"))
    return tables.reparent(old, same.unionByName(more), ["c_custkey"], "parent", ["c_mktsegment"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def set_based_update(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return tables.update_where(c, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("OVERDRAWN"), "c_acctbal": F.lit(0.0)})


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2)""")
def point_lookups(spark, sf_dir):
    """A row by its key, and rows by other columns."""
    c = t(spark, sf_dir, "customer")
    return tables.lookup(c, c_custkey=7).unionByName(tables.lookup(c, c_mktsegment="BUILDING", c_nationkey=[1, 2])).select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 100""")
def clamped_page(spark, sf_dir):
    """A page that asks for too much, from before the start."""
    return tables.bounded_page(t(spark, sf_dir, "customer"), [F.col("c_name"), F.col("c_custkey")], 5000, -3).select("c_custkey")


@query("""SELECT user_id, count(*) AS unread, max(event_id) AS newest FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT min(event_id) FROM events WHERE event_type = 'purchase' GROUP BY user_id) GROUP BY user_id""")
def unread_notifications(spark, sf_dir):
    """Notifications, made once for each purchase, of which each user has read the first."""
    e = t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    once = tables.insert_missing(e.limit(0), e.unionByName(e), ["user_id", "event_id"])
    first = Window.partitionBy("user_id").orderBy("event_id")
    read = once.withColumn("read", F.row_number().over(first) == 1)
    return read.where(~F.col("read")).groupBy("user_id").agg(F.count("*").alias("unread"), F.max("event_id").alias("newest"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'Renamed' ELSE p_name END AS p_name, CASE WHEN p_partkey % 10 = 4 THEN 'approved' WHEN p_partkey % 10 = 3 THEN 'edited' ELSE 'listed' END AS state FROM part WHERE p_partkey % 10 <> 5 UNION ALL SELECT p_partkey + 10000000, 'Registered', 'listed' FROM part WHERE p_partkey % 100 = 1""")
def catalogue_changes(spark, sf_dir):
    """Registering, editing, approving and deleting as table rewrites: inserts of new keys, updates, an anti join."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit("listed").alias("state"))
    new = p.where("p_partkey % 100 = 1").select((F.col("p_partkey") + 10000000).alias("p_partkey"), F.lit("Registered").alias("p_name"), "state")
    d = tables.insert_missing(p, new, ["p_partkey"])
    small = F.col("p_partkey") < 10000000
    d = tables.update_where(d, small & (F.col("p_partkey") % 10 == 3), {"p_name": F.lit("Renamed"), "state": F.lit("edited")})
    d = tables.update_where(d, small & (F.col("p_partkey") % 10 == 4), {"state": F.lit("approved")})
    gone = p.where("p_partkey % 10 = 5").select("p_partkey")
    return d.join(gone, "p_partkey", "left_anti")
