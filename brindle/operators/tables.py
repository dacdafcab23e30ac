"""Keyed table rewrites: upserts, guarded inserts, audits, paging, and metrics."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column is so named."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last of both in `order`; of equal ones the new side's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows, and of the new ones those whose key is not there, one of each key; a null is a key like others."""
    a, b = new.dropDuplicates(key).alias("n"), old.select(*key).distinct().alias("o")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return old.unionByName(a.join(b, same, "left_anti"))


def enrich(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full outer by key; a new value that isn't null wins. Maps are merged, of a key in both the new value unless it is null."""
    kinds = dict(old.dtypes)
    a, b = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in columns)), new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in columns))

    def one(c: str) -> Column:
        if not kinds[c].startswith("map<"):
            return F.coalesce(f"_n_{c}", f"_o_{c}").alias(c)
        none = F.create_map().cast(kinds[c])
        mine = F.map_filter(F.coalesce(f"_n_{c}", none), lambda k, v: v.isNotNull())
        return merge_maps(F.coalesce(f"_o_{c}", none), mine).alias(c)

    return a.join(b, key, "full").select(*key, *map(one, columns))


def attach(claims: DataFrame, held: DataFrame, owner: str, value: str) -> DataFrame:
    """Claims (owner, value) with what becomes of them: attached, kept (held already), or refused, if the owner
    holds another value or another owner holds the value. Of new claims that would refuse each other the
    one with the smallest owner and value is attached first; each claim is judged once."""
    mine = held.groupBy(owner).agg(F.min(value).alias("_mine"))
    theirs = held.groupBy(value).agg(F.min(owner).alias("_theirs"))
    d = claims.dropDuplicates([owner, value]).join(mine, owner, "left").join(theirs, value, "left")
    kept = (F.col("_mine") == F.col(value)) & (F.col("_theirs") == F.col(owner))
    free = F.col("_mine").isNull() & F.col("_theirs").isNull()
    # a value goes to its first free claim, and an owner takes the first value that it got
    first = F.row_number().over(Window.partitionBy(value, free).orderBy(owner)) == 1
    d = d.withColumn("_got", free & first)
    only = F.row_number().over(Window.partitionBy(owner, "_got").orderBy(value)) == 1
    return d.select(owner, value, F.when(kept, "kept").when(F.col("_got") & only, "attached").otherwise("refused").alias("outcome"))


def reparent(old: DataFrame, new: DataFrame, key: list[str], parent: str, columns: list[str], allow: bool = False) -> DataFrame:
    """Listings after an upsert by key: new values that aren't null win, and new keys come in; a listing keeps its
    parent, unless moving it is allowed. refused tells whose new parent was not taken."""
    a, b = old.select(*key, F.col(parent).alias("_op"), *(F.col(c).alias(f"_o_{c}") for c in columns)), new.select(*key, F.col(parent).alias("_np"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    moved = F.col("_op").isNotNull() & F.col("_np").isNotNull() & (F.col("_op") != F.col("_np"))
    chosen = F.coalesce("_np", "_op") if allow else F.coalesce("_op", "_np")
    return a.join(b, key, "full").select(*key, chosen.alias(parent), *(F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns), (moved & F.lit(not allow)).alias("refused"))


def update_where(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition holds; elsewhere, and where it is null, as they are."""
    yes = F.coalesce(when, F.lit(False))
    return df.select(*(F.when(yes, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def settled(df: DataFrame) -> DataFrame:
    """The table as it is now, computed once: a reliable checkpoint in the session's spark.checkpoint.dir. Only
    on a local master without one, as in tests, the folder is temporary and goes with the session."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Add rows to a parquet table; rows that are written twice are there twice."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns hold these values; a list is any of its values."""
    for c, v in keys.items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with their children as an ordered array of structs: one pass instead of a lookup each. A
    parent's children must fit in a row."""
    columns = [c for c in children.columns if c not in (key, *order)]
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias(name))
    kind = grouped.schema[name].dataType
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def bounded_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page by place, with the limit held to 1 to 100 and the offset to 0 and more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def sanitized(value: object, depth: int = 4) -> object:
    """A value as plain JSON: deeper levels and other kinds of values become text, keys are text."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if depth <= 0:
        return str(value)
    if isinstance(value, dict):
        return {str(k): sanitized(v, depth - 1) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [sanitized(v, depth - 1) for v in value]
    return str(value)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row holds: the audit of a uniqueness rule."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_hit(df: DataFrame, lookups: list[DataFrame], keys: list[list[str]], value: str) -> DataFrame:
    """The value of the first lookup that knows the row, in order of the lookups."""
    for i, (lookup, key) in enumerate(zip(lookups, keys, strict=True)):
        one = lookup.groupBy(*key).agg(F.min(value).alias(f"_hit{i}"))  # a key that repeats gives one row all the same
        df = df.join(one, key, "left")
    return df.withColumn(value, F.coalesce(*(F.col(f"_hit{i}") for i in range(len(lookups))))).drop(*(f"_hit{i}" for i in range(len(lookups))))


def suppress(df: DataFrame, key: list[str], same: Column, outranks: Column) -> DataFrame:
    """Rows without a peer of their key that is the same observation and outranks them.

    `same` and `outranks` are written over the aliases e (the row) and p (the peer). The key
    is an equality of its own, so that the anti join hashes on it."""
    cond = same & outranks
    for k in key:
        cond = (F.col(f"e.{k}") == F.col(f"p.{k}")) & cond
    return df.alias("e").join(df.alias("p"), cond, "left_anti")


def page(df: DataFrame, time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Newest first, ties by key; after a cursor (time, key); one row more than the limit shows that there is a next page."""
    if cursor is not None:
        df = df.where(F.struct(F.col(time), F.col(key)) < F.struct(F.lit(cursor[0]).cast(df.schema[time].dataType).alias(time), F.lit(cursor[1]).alias(key)))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit + 1)


def union_page(parts: list[DataFrame], time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The page of several branches, each cut to a page before they meet."""
    out = page(parts[0], time, key, limit, cursor)
    for p in parts[1:]:
        out = out.unionByName(page(p, time, key, limit, cursor))
    return out.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit + 1)


def encode_cursor(time: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([1, time, key], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        version, time, key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if version != 1:
        raise ValueError("not a cursor of this version")
    return time, key


def confusion(label: Column, predicted: Column) -> list[Column]:
    return [F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"), F.count_if(~label & ~predicted).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of tp, fp, fn, tn; null without a denominator, F1 0 where both are 0."""
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    d = df.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("fpr", ratio("fp", F.col("fp") + F.col("tn")))
    total = F.col("precision") + F.col("recall")
    return d.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def resolve(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first source's value that isn't blank, and the source's name."""
    value, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, c in reversed(sources):
        there = F.coalesce(F.trim(c) != "", F.lit(False))
        value, name = F.when(there, c).otherwise(value), F.when(there, label).otherwise(name)
    return value, name


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; of a key in both the second's, even if it is null there."""
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def fill_gaps(first: Column, second: Column) -> Column:
    """The first map with what only the second has."""
    return merge_maps(F.map_filter(second, lambda k, v: v.isNotNull()), F.map_filter(first, lambda k, v: v.isNotNull()))
