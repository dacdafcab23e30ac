"""Queries of keyed state over ordered events, with recursive SQL as their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cdc
from ..streaming import steps
from .registry import query, seconds_exact, t

#: A user's events in order, as SQL.
ORDERED = "e AS (SELECT user_id, event_id, event_type, round(value) AS value, epoch_us(ts) / 1000000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def ordered(spark, sf_dir):
    return t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value").alias("value"), seconds_exact("ts").alias("at"))


@query(f"""WITH RECURSIVE {ORDERED}, s AS (SELECT user_id, event_id, rn, tm + 3600 AS until, true AS claimed FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN s.until > e.tm THEN s.until ELSE e.tm + 3600 END, NOT s.until > e.tm FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, event_id, claimed FROM s""")
def ttl_deduplication(spark, sf_dir):
    """Which events claim their user, who then stays claimed for an hour."""

    def step(state, row):
        state, claimed = steps.claim(state, row[1], 3600)
        return state, (row[0], claimed)

    return cdc.sorted_fold(ordered(spark, sf_dir).withColumns({"o": F.col("at"), "i": F.col("event_id")}), ["user_id"], ["o", "i"], lambda: None, step, ["event_id", "at"], "event_id long, claimed boolean")


@query(f"""WITH RECURSIVE {ORDERED}, s AS (SELECT user_id, event_id, rn, tm, CAST(2 AS DOUBLE) AS level, true AS allowed FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, tm, CASE WHEN now < 1 - 1e-9 THEN now ELSE greatest(0, now - 1) END, NOT now < 1 - 1e-9 FROM (SELECT e.user_id, e.event_id, e.rn, e.tm, least(3, s.level + (3 / 3600) * greatest(0, e.tm - s.tm)) AS now FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT user_id, event_id, allowed FROM s""")
def token_bucket(spark, sf_dir):
    """Three events an hour, in a bucket that fills steadily."""

    def step(state, row):
        state, (allowed, _, _) = steps.bucket(state, row[1], 3, 3600)
        return state, (row[0], allowed)

    return cdc.sorted_fold(ordered(spark, sf_dir).withColumns({"o": F.col("at"), "i": F.col("event_id")}), ["user_id"], ["o", "i"], lambda: None, step, ["event_id", "at"], "event_id long, allowed boolean")


@query(f"""WITH RECURSIVE {ORDERED}, f AS (SELECT *, event_type <> 'error' AS ok FROM e),
s AS (SELECT user_id, event_id, rn, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(-1 AS DOUBLE) AS opened FROM f WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, now, CASE WHEN now = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN now = 'open' THEN opened WHEN NOT ok AND (failures + 1 >= 2 OR now = 'half_open') THEN tm ELSE -1 END
 FROM (SELECT f.user_id, f.event_id, f.rn, f.tm, f.ok, s.failures, s.opened, CASE WHEN s.opened < 0 THEN 'closed' WHEN f.tm >= s.opened + 300 THEN 'half_open' ELSE 'open' END AS now FROM s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1))
SELECT user_id, event_id, state FROM s""")
def circuit_breaker(spark, sf_dir):
    """The breaker's state before each event: two errors in a row open it for five minutes."""

    def step(state, row):
        state, now = steps.breaker(state, row[1], row[2] != "error", 2, 300)
        return state, (row[0], now)

    return cdc.sorted_fold(ordered(spark, sf_dir).withColumns({"o": F.col("at"), "i": F.col("event_id")}), ["user_id"], ["o", "i"], lambda: None, step, ["event_id", "at", "event_type"], "event_id long, state string")


@query(f"""WITH RECURSIVE {ORDERED}, o AS (SELECT *, event_type = 'purchase' AS seen, CASE WHEN event_type = 'purchase' THEN tm + 60 * (event_id % 120) - 600 END AS expires FROM e),
s AS (SELECT user_id, event_id, rn, tm, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS DOUBLE) AS was, CASE WHEN NOT seen THEN NULL WHEN expires <= tm THEN 'expired' ELSE 'active' END AS status, expires, seen FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.rn, o.tm, s.status, s.expires, CASE WHEN o.seen THEN CASE WHEN o.expires <= o.tm THEN 'expired' ELSE 'active' END WHEN s.status = 'active' AND s.expires <= o.tm THEN 'expired' ELSE s.status END, CASE WHEN o.seen THEN o.expires ELSE s.expires END, o.seen FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)
SELECT user_id, event_id, CASE WHEN status = 'active' AND before IS DISTINCT FROM 'active' THEN 'promotion_activated' WHEN status = 'expired' AND before = 'active' THEN 'promotion_expired' WHEN seen AND status = 'active' AND before = 'active' AND was IS DISTINCT FROM expires THEN 'promotion_updated' ELSE '' END AS events FROM s""")
def promotion_lifecycle(spark, sf_dir):
    """Events of each user's promotion: purchases observe one with an end, other events let only the clock count."""

    def step(state, row):
        event_id, at, kind, value = row
        seen = kind == "purchase"
        state, events = steps.promotion(state, at, seen, value if seen else None, at + 60 * (event_id % 120) - 600 if seen else None)
        return state, (event_id, ",".join(events))

    return cdc.sorted_fold(ordered(spark, sf_dir).withColumns({"o": F.col("at"), "i": F.col("event_id")}), ["user_id"], ["o", "i"], lambda: None, step, ["event_id", "at", "event_type", "value"], "event_id long, events string")


@query(f"""WITH RECURSIVE {ORDERED}, r AS (SELECT *, event_id % 3 AS url FROM e),
s AS (SELECT user_id, event_id, rn, CAST(NULL AS VARCHAR) AS code, tm + 20 AS host, CASE WHEN url = 0 THEN tm + 900 ELSE 0 END AS u0, CASE WHEN url = 1 THEN tm + 900 ELSE 0 END AS u1, CASE WHEN url = 2 THEN tm + 900 ELSE 0 END AS u2 FROM r WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, code, CASE WHEN code IS NULL THEN tm + 20 ELSE host END, CASE WHEN code IS NULL AND url = 0 THEN tm + 900 ELSE u0 END, CASE WHEN code IS NULL AND url = 1 THEN tm + 900 ELSE u1 END, CASE WHEN code IS NULL AND url = 2 THEN tm + 900 ELSE u2 END
 FROM (SELECT r.user_id, r.event_id, r.rn, r.tm, r.url, s.host, s.u0, s.u1, s.u2, CASE WHEN (CASE r.url WHEN 0 THEN s.u0 WHEN 1 THEN s.u1 ELSE s.u2 END) > r.tm THEN 'DUPLICATE_REQUEST' WHEN s.host > r.tm THEN 'RATE_LIMITED' END AS code FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1))
SELECT user_id, event_id, code FROM s""")
def request_cooldown(spark, sf_dir):
    """Which requests are refused: an address for fifteen minutes, its host for twenty seconds."""

    def step(state, row):
        state, (code, _) = steps.cooldown(state, row[1], str(row[0] % 3), 900, 20)
        return state, (row[0], code)

    return cdc.sorted_fold(ordered(spark, sf_dir).withColumns({"o": F.col("at"), "i": F.col("event_id")}), ["user_id"], ["o", "i"], lambda: None, step, ["event_id", "at"], "event_id long, code string")
