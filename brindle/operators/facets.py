"""Catalogue search by facets over an inverted table of what listings state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reading
from ..functions import titles as tt
from ..functions.text import fold, normalize_brand, normalize_code, variant_key
from ..functions.values import compact_size

#: What callers may filter by, and the attributes that it stands for.
FILTERS = {"vram": ("vram",), "memory_type": ("memory_type",), "capacity": ("ram", "storage"), "frequency": ("frequency",), "chipset": ("board", "gpu_model"), "socket": ("socket",), "storage": ("storage",), "refresh_rate": ("refresh_rate",), "wattage": ("wattage", "small_wattage"), "panel": ("panel",)}


def facet_value(name: str, value: Column) -> Column:
    """A value in the form that facets of its name are compared in."""
    if name == "brand":
        return normalize_brand(value)
    if name == "model":
        return normalize_code(value)
    if name in ("storage", "ram", "capacity"):
        return compact_size(value)
    return F.nullif(F.regexp_replace(fold(value), r"\s+", ""), F.lit(""))


def facet_index(listings: DataFrame, key: str, title: str, brand: str | None = None, variant: str | None = None) -> DataFrame:
    """(facet, value, key): one row for each thing that a listing states: category, brand, model, each of its
    variant's attributes, the whole variant, and each attribute of its category that the title has.

    Written with `partitionBy("facet")`, a search reads the facets that it asks for only. Listings that state
    nothing have no row; a listing of several rows states what any of them does.
    """
    d = listings.withColumn("_t", fold(F.col(title)))
    d = d.withColumn("_said", reading.read(F.col("_t")))
    lead = F.get(F.filter(F.split("_t", r"\s+"), lambda w: w.isin(*tt.BRANDS)), 0)
    own = F.coalesce(normalize_brand(F.col(brand)), lead) if brand else lead
    stated = tt.parse_variant(F.col(variant)) if variant else F.create_map().cast("map<string,string>")
    row = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    fixed = F.array(row("category", F.col("_said.category")), row("brand", normalize_brand(own)), row("model", normalize_code(F.col("_said.model"))), row("variant", F.nullif(variant_key(stated), F.lit(""))))
    plain = lambda k, v: F.when(k.isin("storage", "ram", "capacity"), compact_size(v)).otherwise(F.regexp_replace(fold(v), r"\s+", ""))
    pairs = F.transform(F.map_entries("_said.attributes"), lambda e: F.struct(e["key"].alias("facet"), plain(e["key"], e["value"]).alias("value")))
    more = F.transform(F.map_entries(stated), lambda e: F.struct(e["key"].alias("facet"), plain(e["key"], e["value"]).alias("value")))
    return d.select(key, F.explode(F.concat(fixed, pairs, more)).alias("f")).where("f.value IS NOT NULL").select("f.facet", "f.value", key).distinct()


def facet_search(index: DataFrame, key: str, asked: dict[str, str], limit: int | None = None) -> DataFrame:
    """Keys, ascending, of the listings that state all that is asked: brand, model, variant, category, and any of FILTERS.

    A model or brand is the whole code or name; a filter that stands for several attributes holds if one
    does. One pass counts the rows of each condition; the rarest is then read first and the others
    only keep what it leaves. Nothing asked is an error, as that is no search.
    """
    if not asked:
        raise ValueError("ask for at least one facet")
    value = {name: facet_value(name, F.lit(v)) for name, v in asked.items()}
    holds = {name: F.col("facet").isin(*FILTERS.get(name, (name,))) & (F.col("value") == v) for name, v in value.items()}
    counts = index.where(F.col("facet").isin(*{f for name in asked for f in FILTERS.get(name, (name,))})).agg(*(F.count(F.when(c, 1)).alias(name) for name, c in holds.items())).first()
    rarest, *others = sorted(asked, key=lambda name: (counts[name], name))
    found = index.where(holds[rarest]).select(key).distinct()
    for name in others:
        found = found.join(index.where(holds[name]).select(key), key, "left_semi")
    found = found.orderBy(key)
    return found if limit is None else found.limit(min(100, max(1, limit)))
