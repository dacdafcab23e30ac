"""Landed pages and files as rows: HTML fields, JSON-LD products, rate feeds, labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "schema_version int, sample_id string, group_id string, split string, label string, category string, reference_language string, candidate_language string, reference string, candidate string, _corrupt_record string"
SPLITS = ("development", "train", "calibration", "validation", "holdout")
LABELS = ("same_product", "different_product", "uncertain")


def plain_text(html: Column) -> Column:
    """Text without tags and with the common entities resolved, spaces collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def element(html: Column, tag: str) -> Column:
    """Text of the first element of a tag, or null."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(plain_text(inner), F.lit(""))


def first_of(html: Column, tags: list[str]) -> Column:
    """The first tag that has text."""
    return F.coalesce(*(element(html, t) for t in tags))


def json_ld_product(html: Column) -> Column:
    """The first JSON-LD object that is a Product, as a struct: a script of its own, one of an array, or one of
    a graph. Types may be lists, brands plain names and offers lists; scripts that don't parse are passed over."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    texts = "array<string>"
    objects = F.transform(scripts, lambda s: F.when(F.trim(s).startswith("["), F.from_json(s, texts)).otherwise(F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), texts), F.array(F.trim(s)))))
    product = F.get(F.filter(F.flatten(F.filter(objects, lambda o: o.isNotNull())), lambda o: F.coalesce(F.get_json_object(o, "$.@type").rlike(r'^Product$|^\[.*"Product".*\]$'), F.lit(False))), 0)
    field = lambda *paths: F.coalesce(*(F.nullif(F.trim(F.get_json_object(product, f"$.{p}")), F.lit("")) for p in paths))
    brand = field("brand.name", "brand")
    found = F.struct(
        field("name").alias("name"),
        field("sku", "productID").alias("sku"),
        field("gtin13", "gtin", "gtin14", "gtin8", "gtin12").alias("gtin"),
        field("mpn").alias("mpn"),
        F.when(~brand.startswith("{"), brand).alias("brand"),
        field("description").alias("description"),
        field("offers.price", "offers[0].price", "offers.lowPrice").alias("price"),
        field("offers.priceCurrency", "offers[0].priceCurrency").alias("currency"),
        F.regexp_extract(field("offers.availability", "offers[0].availability"), "([A-Za-z]+)$", 1).alias("availability"),
        field("offers.seller.name", "offers[0].seller.name").alias("seller"),
        field("image").alias("image"),
    )
    return F.when(product.isNotNull(), found)


def selected(html: Column, selectors: list[str]) -> Column:
    """Text of the first element that one of the selectors finds, in their order; a selector is a tag, a class
    (.name), an id (#name), both (tag.name) or an attribute of a tag (tag[name])."""
    import re

    found = []
    for selector in selectors:
        tag, mark, name = re.fullmatch(r"([A-Za-z0-9]*)([.#\[]?)([^\]]*)\]?", selector).groups()
        tag = tag or r"[a-z][a-z0-9]*"
        if mark == "[":
            found.append(F.nullif(plain_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*?\s{re.escape(name)}=[\"']([^\"']*)[\"']", 1)), F.lit("")))
        elif mark:
            attribute = "class" if mark == "." else "id"
            found.append(F.nullif(plain_text(F.regexp_extract(html, rf"(?is)<({tag})\b[^>]*?\s{attribute}=[\"'](?:[^\"']*\s)?{re.escape(name)}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>", 2)), F.lit("")))
        else:
            found.append(element(html, tag))
    return F.coalesce(*found)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Product fields of pages: JSON-LD first, then headings; outcome tells empty pages from those without a product."""
    p = pages.withColumn("product", json_ld_product(F.col("html")))
    outcome = F.when(F.coalesce(F.length(F.trim("html")), F.lit(0)) == 0, "empty").when(F.col("product").isNotNull(), "product").otherwise("no_product")
    return p.select("page_id", F.coalesce("product.name", first_of(F.col("html"), ["h1", "title"])).alias("title"), F.col("product.sku").alias("sku"), F.col("product.gtin").alias("gtin"), F.col("product.brand").alias("brand"), F.col("product.price").alias("price"), F.col("product.currency").alias("currency"), outcome.alias("outcome"))


def image_addresses(raw: Column) -> Column:
    """Addresses in JSON of any depth: texts themselves, and url, src, contentUrl or large fields of objects, in order."""
    strings = F.regexp_extract_all(raw, F.lit(r'"((?:https?:)?//[^"\\s]+|/[^"\\s]*\.(?:jpe?g|png|webp|avif|gif)[^"\\s]*)"'), F.lit(1))
    return F.when(F.trim(raw).rlike(r"^[\[{]"), F.transform(strings, lambda u: F.replace(u, F.lit("\\/"), F.lit("/")))).otherwise(F.array(F.trim(raw)))


def gallery(urls: Column, base: Column) -> Column:
    """Image addresses flattened, made absolute, without repeats, in order."""
    absolute = F.transform(F.filter(urls, lambda u: u.isNotNull() & (F.trim(u) != "")), lambda u: F.when(u.rlike("^[a-z]+://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.concat(F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1), F.lit("/"), F.regexp_replace(u, "^/+", ""))))
    return F.array_distinct(absolute)


def compose_items(offers: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """An item from an offer and the details of its page: identifiers of the first that has them, of metadata in
    both the offer's, but of the map of sources the details'. Takes key, gtin, sku, product_id, title, metadata
    and sources (maps) of both; price and currency of the offer, brand and model of the details."""
    from ..operators.tables import merge_maps

    both = offers.alias("o").join(details.alias("d"), F.col(f"o.{key}") == F.col(f"d.{key}"), "left")
    none = F.create_map().cast("map<string,string>")
    first = [F.coalesce(F.col(f"o.{c}"), F.col(f"d.{c}")).alias(c) for c in ("gtin", "sku", "product_id", "title")]
    maps = lambda name: (F.coalesce(F.col(f"o.{name}"), none), F.coalesce(F.col(f"d.{name}"), none))
    mine, theirs = maps("metadata")
    from_offer, from_details = maps("sources")
    return both.select(F.col(f"o.{key}"), *first, "o.price", "o.currency", "d.brand", "d.model", merge_maps(theirs, mine).alias("metadata"), merge_maps(from_offer, from_details).alias("sources"))


def offer_of(items: DataFrame, key: str = "url") -> DataFrame:
    """The offer's part of an item."""
    return items.select(key, "sku", "product_id", "title", "price", "currency", "metadata")


def rate_feed(body: Column) -> Column:
    """Buy and sell rows of a JSON feed whose first element is the newest."""
    first = F.get(F.from_json(body, "value array<struct<cotacaoCompra:decimal(24,12),cotacaoVenda:decimal(24,12),dataHoraCotacao:string>>")["value"], 0)
    return F.array(F.struct(F.lit("ptax_buy").alias("rate_type"), first["cotacaoCompra"].alias("rate"), first["dataHoraCotacao"].alias("at")), F.struct(F.lit("ptax_sell").alias("rate_type"), first["cotacaoVenda"].alias("rate"), first["dataHoraCotacao"].alias("at")))


PAIR_FIELDS = ("schema_version", "sample_id", "group_id", "split", "label", "category", "reference_language", "candidate_language", "reference", "candidate")
SIDE = "title string, brand string, model string, gtin string, price decimal(18,4), currency string"


def labelled_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs of a JSON-lines file, and the rows that break a rule with the rule's name: unreadable, fields
    that no schema has, wrong schema version, unknown split or label, blank fields, sides that are no objects,
    repeated sample ids, and groups that stand in two splits. Both sides come parsed, amounts as exact decimals."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", PAIR, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), F.json_object_keys("value").alias("keys")).select("r.*", "keys")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    some = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        (F.col("_corrupt_record").isNotNull() | F.col("keys").isNull(), "unreadable"),
        (F.size(F.array_except("keys", F.array(*map(F.lit, PAIR_FIELDS)))) > 0, "unknown_field"),
        (~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version"),
        (~some(F.col("split").isin(*SPLITS)), "split"),
        (~some(F.col("label").isin(*LABELS)), "label"),
        (blank("sample_id") | blank("group_id") | blank("category") | blank("reference_language") | blank("candidate_language"), "blank"),
        (some(~F.col("reference").startswith("{")) | some(~F.col("candidate").startswith("{")), "side"),
    ]
    rule = F.lit(None).cast("string")
    for when, name in reversed(rules):
        rule = F.when(when, name).otherwise(rule)
    marked = rows.withColumn("rule", rule)
    repeated = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id")
    crossing = rows.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("group_id")
    fine = marked.where("rule is null")
    bad = marked.where("rule is not null").unionByName(fine.join(repeated, "sample_id", "left_semi").withColumn("rule", F.lit("repeated"))).unionByName(fine.join(crossing, "group_id", "left_semi").withColumn("rule", F.lit("crosses_splits")))
    parsed = fine.withColumn("reference", F.from_json("reference", SIDE)).withColumn("candidate", F.from_json("candidate", SIDE))
    return parsed.drop("rule", "keys", "_corrupt_record"), bad.select("sample_id", "group_id", "rule")
