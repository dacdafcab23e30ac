"""Change capture on observations, and the state that is folded from ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def previous(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row's own columns and those of the key's row before it, as prev_<name>; seen tells if there is one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns), (F.row_number().over(w) > 1).alias("seen"))


def change_events(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Typed events of (price, seller, availability, fingerprint) against the row before: new_offer,
    unchanged, or what changed; an unexplained change of fingerprint is a price change."""
    d = previous(df, key, order, ["price", "seller", "availability", "fingerprint"])
    name = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    differs = lambda a, b: ~a.eqNullSafe(b)
    availability = differs(F.col("availability"), F.col("prev_availability"))
    found = F.array_compact(
        F.array(
            F.when(differs(F.col("price"), F.col("prev_price")), "price_changed"),
            F.when(differs(name("seller"), name("prev_seller")), "seller_changed"),
            F.when(availability, "availability_changed"),
            F.when(availability & (F.col("availability") == "out_of_stock"), "out_of_stock"),
        )
    )
    events = F.when(~F.col("seen"), F.array(F.lit("new_offer"))).when(F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint")), F.array(F.lit("unchanged"))).when(F.size(found) == 0, F.array(F.lit("price_changed"))).otherwise(found)
    return d.withColumn("events", events)


def sweep_diff(before: DataFrame, sweep: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What a sweep over listings says against what was known: (key, status, events, refresh, previous and current
    fingerprint), one row of each key of either side.

    Both have key, order, price, seller, availability and fingerprint; a row of the sweep also has a status: ok,
    failed (the page could not be read) or removed (the store no longer has it). Of rows that repeat a key the last in
    order counts; a sweep's row that is no later than what is known is late and not heard of, and tells nothing
    (status late). A listing that the sweep has no row of is missing, which tells a failed scrape without any
    fingerprint. A failure or a removal keeps the known fingerprint.
    """
    values = [*order, "price", "seller", "availability", "fingerprint"]
    old = latest(before, key, order).select(*key, F.struct(*values).alias("old"))
    new = latest(sweep, key, order).select(*key, F.struct(*values, "status").alias("new"))
    d = old.join(new, key, "full_outer")
    old_, new_ = F.col("old"), F.col("new")
    at = lambda side: F.struct(*(side[c] for c in order))
    status = F.when(new_.isNull(), "missing").when(old_.isNotNull() & (at(new_) <= at(old_)), "late").otherwise(new_["status"])
    name = lambda side: F.nullif(F.lower(F.trim(side["seller"])), F.lit(""))
    differs = lambda a, b: ~a.eqNullSafe(b)
    stock = differs(old_["availability"], new_["availability"])
    told = F.array_compact(F.array(F.when(differs(old_["price"], new_["price"]), "price_changed"), F.when(differs(name(old_), name(new_)), "seller_changed"), F.when(stock, "availability_changed"), F.when(stock & (new_["availability"] == "out_of_stock"), "out_of_stock")))
    one = lambda e: F.array(F.lit(e))
    s = F.col("status")
    events = (
        F.when(s == "late", F.array().cast("array<string>"))
        .when(s.isin("missing", "failed"), one("scrape_failed"))
        .when(s == "removed", one("offer_removed"))
        .when(old_.isNull(), one("new_offer"))
        .when(old_["fingerprint"].eqNullSafe(new_["fingerprint"]), one("unchanged"))
        .when(F.size(told) == 0, one("price_changed"))
        .otherwise(told)
    )
    d = d.withColumn("status", status).withColumn("events", events)
    previous = F.when(s.isin("failed", "removed", "ok"), old_["fingerprint"])
    return d.select(*key, "status", "events", F.when(F.size("events") > 0, refresh_status(F.col("events"))).alias("refresh"), previous.alias("previous_fingerprint"), F.when(s == "ok", new_["fingerprint"]).alias("current_fingerprint"))


def after_sweep(before: DataFrame, sweep: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What is known after a sweep: what it read takes the place of what was known, what it found removed
    goes, and failed, missing and late listings stay as they were. Columns of `before`."""
    seen = sweep.where(F.col("status").isin("ok", "removed"))
    gone = F.coalesce(F.col("status") == "removed", F.lit(False))
    both = before.withColumns({"status": F.lit(None).cast("string"), "_turn": F.lit(1)}).unionByName(seen.select(*before.columns, "status").withColumn("_turn", F.lit(0)))
    # of equal times what was known stays
    return latest(both, key, [*order, "_turn"]).where(~gone).select(*before.columns)


def refresh_status(events: Column) -> Column:
    """One status of an event list, the most telling first."""
    out = F.lit("changed")
    for name in ("new_offer", "unchanged", "out_of_stock", "scrape_failed", "offer_removed"):
        out = F.when(F.array_contains(events, name), name).otherwise(out)
    return out


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The key's last row in the given total order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def run_lengths(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """How many rows in a row, up to this one, hold the same value."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("island", F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("run", F.row_number().over(Window.partitionBy(*key, "island").orderBy(*order))).drop("island")


def as_of(left: DataFrame, right: DataFrame, key: list[str], time: str, value: str, tie: str) -> DataFrame:
    """The right side's last value at or before each left row's time.

    One sort of both sides together instead of a join: the right rows of a time come before
    the left ones, and the last value seen is carried on. `tie` orders right rows of one time.
    """
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    other = right.select(*key, time, F.lit(0).alias("_side"), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    w = Window.partitionBy(*key).orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.unionByName(other, allowMissingColumns=True).withColumn("as_of", F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True).over(w)["_value"])
    return carried.where("_side = 1").drop("_side", "_value", "_tie")


def early_best(df: DataFrame, group: str, order: str, score: str, final: Column) -> DataFrame:
    """Best row of each group up to and with the first final one; a later row must be better."""
    w = Window.partitionBy(group)
    d = df.withColumn("_stop", F.min(F.when(final, F.col(order))).over(w)).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
    return d.withColumn("_rn", F.row_number().over(w.orderBy(F.col(score).desc(), order))).where("_rn = 1").drop("_rn", "_stop")


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]], columns: list[str], out: str) -> DataFrame:
    """A state machine per key over its rows in order.

    Rows are dealt to tasks by key and sorted inside, and a task walks them batch by batch with the
    state of one key at a time: nothing of a key is collected, and time is linear. `step` takes the state and the
    values of `columns`, and gives the new state and a result row (keys come before it), or None.
    """
    dealt = df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    names, n, skip = out, len(keys), len(keys) + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, None, to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != at:
                    at, state = row[:n], start()
                state, result = step(state, row[skip:])
                if result is not None:
                    rows.append((*at, *result))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    schema = df.select(*keys).schema
    for f in StructType.fromDDL(names):
        schema = schema.add(f)
    return dealt.mapInArrow(run, schema)
