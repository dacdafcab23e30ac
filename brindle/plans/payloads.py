"""Queries of nested payloads: bounds, staging and back, snapshots of offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import payloads as pl
from .registry import dealt, query, t


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _listed(n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("string")), ",")


@query("""SELECT event_id, '{"a":{"b":{"c":{"d":null}}},"l":[' || array_to_string(range(0, least(40, event_id % 60 + 1)), ',') || '],"n":null,"s":"' || left(repeat('é', CAST(event_id % 3000 AS INT)), 2048) || '","t":"' || event_type || '"}' AS held FROM events""")
def payload_bounds(spark, sf_dir):
    """Payloads of five levels, with long lists and texts and with secrets, held to bounds."""
    made = _text('{"t":"', F.col("event_type"), '","n":null,"api_Token":"x","a":{"b":{"c":{"d":{"e":', F.col("event_id"), '}}}},"l":[', _listed(F.col("event_id") % 60), '],"s":"', F.expr("repeat('é', int(event_id % 3000))"), '"}')
    return dealt(spark, sf_dir, "events").select("event_id", F.to_json(pl.plain(F.try_parse_json(made))).alias("held"))


@query("""SELECT p_partkey, p_partkey % 50 <> 0 AS staged, CASE WHEN p_partkey % 50 <> 0 AND p_partkey % 7 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 50 <> 0 AND p_partkey % 7 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,4)) END AS price,
CASE WHEN p_partkey % 50 <> 0 AND p_partkey % 7 <> 0 THEN '{"specifications":{"deep":{"x":{"y":{"z":null}}},"size":' || p_size || '}' || CASE WHEN p_partkey % 2 = 0 THEN ',"storage":null}' ELSE ',"storage":"' || p_size || ' GB"}' END END AS metadata,
CASE WHEN p_partkey % 50 = 0 THEN 'too_large' WHEN p_partkey % 7 = 0 THEN 'version' END AS refused FROM part""")
def payload_staging(spark, sf_dir):
    """Products with nested metadata staged as text and restored; every fiftieth is too large, every seventh of another version."""
    key = F.col("p_partkey")
    product = pl.variant_of({"title": F.when(key % 50 == 0, F.expr("repeat(p_name, 20000)")).otherwise(F.col("p_name")), "price": F.col("p_retailprice").cast("decimal(18,4)").cast("string")})
    metadata = F.try_parse_json(_text('{"specifications":{"size":', F.col("p_size"), ',"deep":{"x":{"y":{"z":1}}}},"colour":"red","storage":', F.when(key % 2 == 0, "null").otherwise(_text('"', F.col("p_size"), ' GB"')), "}"))
    s = dealt(spark, sf_dir, "part").select(key, pl.staged(product, metadata).alias("s"))
    payload = F.when(key % 7 == 0, F.replace("s.payload", F.lit('"version":1'), F.lit('"version":2'))).otherwise(F.col("s.payload"))
    r = s.select(key, "s", pl.restored(payload).alias("r"))
    refused = F.coalesce("s.refused", "r.refused")
    return r.select(key, F.col("s.payload").isNotNull().alias("staged"), F.try_variant_get("r.product", "$.title", "string").alias("title"), F.try_variant_get("r.product", "$.price", "decimal(18,4)").alias("price"), F.to_json("r.metadata").alias("metadata"), refused.alias("refused"))


@query("""SELECT l_orderkey, l_linenumber, '{"availability":"' || CASE WHEN l_linestatus = 'O' THEN 'available' ELSE 'out_of_stock' END || '","available":' || (l_linestatus = 'O') || ',"canonical_url":null' || CASE WHEN l_returnflag = 'R' THEN ',"condition":"renewed"' || CASE WHEN l_linenumber % 2 = 0 THEN ',"condition_grade":"premium"' ELSE '' END ELSE '' END
|| ',"country":null,"currency":"USD","metadata":{"kind":null,"part":' || l_partkey || ',"size":2},"original_price":null,"pix_price":' || CASE WHEN l_discount > 0.05 THEN '"' || CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR) || '"' ELSE 'null' END || ',"price":"' || CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR) || '","product_id":"' || l_partkey || '","scraped_at":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '","seller":' || CASE WHEN l_linenumber = 1 THEN 'null' ELSE '"' || l_suppkey || '"' END || ',"sku":null,"store":null,"url":null}' AS snapshot,
CAST(l_extendedprice AS DECIMAL(18,4)) AS price, CASE WHEN l_linenumber <> 1 THEN CAST(l_suppkey AS VARCHAR) END AS seller, CAST(epoch(l_shipdate) AS BIGINT) AS seen FROM lineitem""")
def offer_snapshots(spark, sf_dir):
    """Offers as snapshot objects with explicit nulls, and what a comparison reads back from them."""
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    open_ = F.col("l_linestatus") == "O"
    offer = {
        "price": price,
        "pix_price": F.when(F.col("l_discount") > 0.05, price),
        "currency": F.lit("USD"),
        "seller": F.when(F.col("l_linenumber") != 1, F.col("l_suppkey").cast("string")),
        "availability": F.when(open_, "available").otherwise("out_of_stock"),
        "available": open_,
        "product_id": F.col("l_partkey").cast("string"),
        "scraped_at": F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    metadata = pl.merged(F.parse_json(F.lit('{"kind":"x","size":2}')), pl.variant_of({"part": F.col("l_partkey"), "kind": F.lit(None).cast("string")}))
    renewed = F.col("l_returnflag") == "R"
    made = pl.snapshot(offer, metadata, F.when(renewed, "renewed").otherwise("unknown"), F.when(F.col("l_linenumber") % 2 == 0, "premium"), F.lit(None).cast("string"))
    d = dealt(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("s"))
    v = pl.snapshot_view(F.col("s"))
    return d.select("l_orderkey", "l_linenumber", F.to_json("s").alias("snapshot"), v["price"].alias("price"), v["seller"].alias("seller"), F.unix_timestamp(v["scraped_at"]).alias("seen"))
