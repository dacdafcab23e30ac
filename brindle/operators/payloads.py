"""Nested payloads as VARIANT: bounded plain values, merges with explicit nulls, staging, and offer snapshots.

Nothing is unrolled into columns and no Python runs; the fields of an object come in the order of their
names. Text that is no JSON, or that names a field of one object twice, is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: Parts of the names of fields that are not staged.
SENSITIVE = ("token", "cookie", "password", "secret", "authorization", "proxy")
#: Metadata that is staged.
METADATA = ("identity_only", "specifications", "color", "storage", "ram", "size", "capacity", "vram", "edition", "network_lock", "timed_promotion", "category", "mpn", "socket", "promotion", "promotion_expires_at", "promotion_status", "promotion_source", "promotion_verified")
#: Fixed value: bytes of a staged payload at most.
LARGEST = 65536
VERSION = 1


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def fields(v: Column) -> Column:
    """An object's fields as a map; null where it is none."""
    return v.try_cast("map<string,variant>")


def items(v: Column) -> Column:
    return v.try_cast("array<variant>")


def variant_null() -> Column:
    return F.parse_json(F.lit("null"))


def _last_of_each(names: Column, cut: Callable[[Column], Column]) -> Column:
    """Names without those that are cut to the same as a later one."""
    both = F.struct(names.alias("all"), F.reverse(F.transform(names, cut)).alias("cut"))
    return _bound(both, lambda b: F.filter(b["all"], lambda k, i: F.array_position(b["cut"], cut(k)) == F.size(b["cut"]) - i))


def plain(v: Column, depth: int = 4, entries: int = 80, most: int = 40, key_length: int = 128, text_length: int = 2048, sensitive: tuple[str, ...] = SENSITIVE) -> Column:
    """A value held to bounds: `depth` levels, below which values are null; `entries` fields of an object, by name, and
    `most` items of an array; keys and texts cut to their lengths. Fields with a sensitive name are left out
    after counting. Of keys that are equal once cut the last stands."""
    if depth <= 0:
        return F.when(v.isNotNull(), variant_null())
    deeper = lambda x: plain(x, depth - 1, entries, most, key_length, text_length, sensitive)
    secret = "(?i)" + "|".join(sensitive)

    cut = lambda k: F.left(k, F.lit(key_length))

    def inner(b: Column) -> Column:
        """Fields, or items under a null key, with their values as they are; null for other values."""
        names = F.filter(F.slice(F.array_sort(F.map_keys(b["m"])), 1, entries), lambda k: ~k.rlike(secret))
        of_object = F.transform(_last_of_each(names, cut), lambda k: F.struct(cut(k).alias("key"), b["m"][k].alias("value")))
        of_array = F.transform(F.slice(b["a"], 1, most), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
        return F.when(b["m"].isNotNull(), of_object).when(b["a"].isNotNull(), of_array)

    def of_value(x: Column) -> Column:
        is_text = F.schema_of_variant(x) == "STRING"
        return F.when(is_text, F.left(x.try_cast("string"), F.lit(text_length)).cast("variant")).otherwise(x)

    def of_any(b: Column) -> Column:
        held = F.transform(inner(b), lambda e: F.struct(e["key"].alias("key"), deeper(e["value"]).alias("value")))
        whole = lambda h: F.when(b["m"].isNotNull(), F.to_variant_object(F.map_from_entries(h))).when(b["a"].isNotNull(), F.to_variant_object(F.transform(h, lambda e: e["value"])))
        return _bound(held, whole)

    def of(x: Column) -> Column:
        nested = _bound(F.struct(fields(x).alias("m"), items(x).alias("a")), of_any)
        return F.when(fields(x).isNull() & items(x).isNull(), of_value(x)).otherwise(nested)  # most values are plain

    return _bound(v, of)


def merged(first: Column, second: Column) -> Column:
    """Both objects' fields; of a field in both the second's, a null that stands there too. A side that is no object adds none."""
    none = F.create_map().cast("map<string,variant>")
    both = F.struct(F.coalesce(fields(first), none).alias("a"), F.coalesce(fields(second), none).alias("b"))
    return _bound(both, lambda x: F.to_variant_object(tables.merge_maps(x["a"], x["b"])))


def variant_of(columns: dict[str, Column]) -> Column:
    """An object of columns; a null is a null field."""
    return F.to_variant_object(F.struct(*(c.alias(k) for k, c in columns.items())))


def staged(product: Column, metadata: Column, hit: Column | None = None, largest: int = LARGEST) -> Column:
    """A struct of the staged text of a product (object), with its allowed metadata in bounds and what else is known of
    the hit, and of why it was refused: `too_large`, or null. One of the two is null."""
    allowed = F.map_filter(fields(metadata), lambda k, x: k.isin(*METADATA))
    kept = F.map_from_entries(F.transform(F.map_entries(allowed), lambda e: F.struct(e["key"].alias("key"), plain(e["value"]).alias("value"))))
    whole = merged(product, F.to_variant_object(F.create_map(F.lit("metadata"), F.to_variant_object(F.coalesce(kept, F.create_map().cast("map<string,variant>"))))))
    parts = [F.lit("version"), F.lit(VERSION).cast("variant"), F.lit("product"), whole]
    text = F.to_json(F.to_variant_object(F.create_map(*parts, *([] if hit is None else [F.lit("hit"), hit]))))
    return _bound(text, lambda s: F.struct(F.when(F.octet_length(s) <= largest, s).alias("payload"), F.when(F.octet_length(s) > largest, "too_large").alias("refused")))


def restored(payload: Column) -> Column:
    """A struct of product, metadata and hit (objects) of a staged text and of why it was refused: `unreadable` or `version`."""

    def of(v: Column) -> Column:
        fine = F.coalesce(F.try_variant_get(v, "$.version", "int") == VERSION, F.lit(False))
        part = lambda path: F.when(fine, F.try_variant_get(v, path, "variant"))
        refused = F.when(fields(v).isNull(), "unreadable").when(~fine, "version")
        return F.struct(part("$.product").alias("product"), part("$.product.metadata").alias("metadata"), part("$.hit").alias("hit"), refused.alias("refused"))

    return _bound(F.try_parse_json(payload), of)


#: Fields of a snapshot; amounts are decimal text, the time ISO text.
SNAPSHOT = ("price", "currency", "seller", "availability", "available", "pix_price", "original_price", "scraped_at", "product_id", "sku", "url", "canonical_url", "store", "country")
AMOUNTS = ("price", "pix_price", "original_price")


def snapshot(offer: dict[str, Column], metadata: Column, condition: Column, grade: Column, carrier: Column) -> Column:
    """What is kept of an offer at a time: every field of SNAPSHOT, null ones too, and the metadata; condition, its grade and
    the carrier only where they are known. A grade without a condition isn't told."""
    unknown = set(offer) - set(SNAPSHOT)
    if unknown:
        raise ValueError(f"no fields of a snapshot: {sorted(unknown)}")
    text = lambda k: offer[k].cast("string") if k in AMOUNTS else offer[k]
    known = F.coalesce(condition != "unknown", F.lit(False))
    told = {"condition": F.when(known, condition), "condition_grade": F.when(known, F.nullif(grade, F.lit(""))), "carrier": F.nullif(carrier, F.lit(""))}
    # the names are all different, so entries are put together once; merging objects would take them apart again and again
    entry = lambda k, x: F.array(F.struct(F.lit(k).alias("key"), x.cast("variant").alias("value")))
    none = F.array().cast("array<struct<key:string,value:variant>>")
    base = [entry(k, text(k) if k in offer else F.lit(None).cast("string")) for k in SNAPSHOT]
    meta = entry("metadata", F.coalesce(metadata, F.parse_json(F.lit("{}"))))
    extra = [F.when(x.isNotNull(), entry(k, x)).otherwise(none) for k, x in told.items()]
    return F.to_variant_object(F.map_from_entries(F.concat(*base, meta, *extra)))


def snapshot_view(payload: Column) -> Column:
    """What a comparison needs of a snapshot, typed; a field of another kind and a time that is none are null."""
    get = lambda k, kind: F.try_variant_get(payload, f"$.{k}", kind)
    return F.struct(
        get("price", "decimal(18,4)").alias("price"),
        *(get(k, "string").alias(k) for k in ("currency", "seller", "availability")),
        get("available", "boolean").alias("available"),
        F.try_to_timestamp(get("scraped_at", "string")).alias("scraped_at"),
    )
