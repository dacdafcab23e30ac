"""Keyed state over event streams: the transitions of `steps`, the same on tables and streams.

State is typed, and goes when it no longer differs from that of a key never seen: timers on event time
remove it once the watermark has passed the time that `steps` names, so no clock decides, and a run over
what is available ends. Sessions that run these streams keep state in RocksDB:
spark.sql.streaming.stateStore.providerClass names
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from . import steps


class Fold(StatefulProcessor):
    """One key's events in order of time within each micro-batch, one result row each.

    `step` takes the state (None for a new key) and an event and gives both state and results; `until`
    says from which time on a state is as good as none, or None if it is for good; `ended` gives the
    results that the end itself brings, without an event.
    """

    def __init__(self, names: list[str], schema: StructType, step: Callable[[Any, Any], tuple[Any, tuple]], until: Callable[[Any], float | None], ended: Callable[[Any], tuple | None]):
        self.names, self.schema, self.step, self.until, self.ended = names, schema, step, until, ended

    def _row(self, *values: Any) -> Row:
        return Row(**dict(zip(self.names, values, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def _keep(self, state: Any) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        end = self.until(state)
        if end == float("-inf"):
            self.state.clear()
            return
        self.state.update(tuple(state))
        if end is not None:
            self.handle.registerTimer(max(0, int(-(-end * 1000 // 1))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else None
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            now, result = self.step(now, row)
            yield self._row(key[0], row.event_id, row.at, *result)
        self._keep(now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        state = tuple(self.state.get())
        result = self.ended(state)
        self.state.clear()
        if result is not None:
            yield self._row(key[0], None, expiredTimerInfo.getExpiryTimeInMs() / 1000, *result)

    def close(self) -> None:
        pass


NEVER = float("-inf")


def _keyed(df: DataFrame, key: str, out: str, state: str, step: Callable[[Any, Any], tuple[Any, tuple]], until: Callable[[Any], float | None], late: str, ended: Callable[[Any], tuple | None] = lambda state: None) -> DataFrame:
    """Fold events (key, event_id, at in seconds); events over `late` behind the newest are dropped."""
    schema = _parse_datatype_string(f"{key} {dict(df.dtypes)[key]}, event_id long, at double, {out}")
    timed = df.withColumn("at", F.col("at").cast("double")).withColumn("event_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithState(Fold(schema.names, _parse_datatype_string(state), step, until, ended), schema, "append", "EventTime")


def rate_limit(events: DataFrame, limit: int = 5, window: int = 60, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Token bucket per key over (key, event_id, at in seconds). A bucket that is left alone for `window` seconds is
    full, so its state goes then."""

    def step(state, row):
        return steps.bucket(state, row.at, limit, window)

    return _keyed(events, key, "allowed boolean, remaining int, retry_after int", "level double, at double", step, lambda s: s[1] + window, late)


def dedup_ttl(events: DataFrame, ttl: int = 3600, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Whether each event claims its key, which stays claimed for `ttl` seconds; then its state goes."""

    def step(state, row):
        state, claimed = steps.claim(state, row.at, ttl)
        return state, (claimed,)

    return _keyed(events, key, "claimed boolean", "until double", step, lambda s: s[0], late)


def circuit_breaker(events: DataFrame, threshold: int = 5, cooldown: int = 300, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Breaker state before each event; events carry ok. A closed breaker without failures needs no state; failures
    are remembered until a success."""

    def step(state, row):
        state, now = steps.breaker(state, row.at, bool(row.ok), threshold, cooldown)
        return state, (now,)

    return _keyed(events, key, "state string", "failures int, opened double", step, lambda s: NEVER if s == (0, -1.0) else None, late)


def request_spacing(events: DataFrame, url_ttl: int = 60, host_ttl: int = 2, late: str = "10 minutes") -> DataFrame:
    """Whether each request (host, url, event_id, at) may go out: code of the refusal, or null, and seconds to wait.
    A host's state goes when none of its blocks is left."""

    def step(state, row):
        held = state and (state[0], tuple(state[1].items()))
        (host, urls), result = steps.cooldown(held, row.at, row.url, url_ttl, host_ttl)
        return (host, dict(urls)), result

    return _keyed(events, "host", "code string, retry_after int", "host double, urls map<string,double>", step, lambda s: max(s[0], *s[1].values(), s[0]), late)


def promotions(observations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each listing's promotion from (listing, event_id, at, seen, price, expires).

    A promotion that nobody mentions again still ends: when the watermark passes its end, a row
    without event_id tells `promotion_expired`, at that end. State is held of active promotions only.
    """

    def step(state, row):
        number = lambda x: None if x is None else float(x)
        state, events = steps.promotion(state, row.at, bool(row.seen), number(row.price), number(row.expires))
        return state, (",".join(events),)

    return _keyed(observations, "listing", "events string", "status string, price double, expires double", step, lambda s: s[2] if s[0] == "active" else NEVER, late, lambda s: ("promotion_expired",))


def latest_into(events: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]):
    """Keep the latest row of each key in a parquet table, batch by batch. A batch writes a new version
    under its own number, so that one that is repeated after a failure gives the same table.

    Batch 0 starts the table; a later batch whose version before is missing fails, as its history is lost.
    """
    from ..operators.tables import upsert_latest

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        upsert_latest(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
