"""Products from stores' pages, by formats that are data: for each field, where it may stand, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from ..functions.values import parse_money
from ..operators.tables import settled
from .elements import compound, elements, select, steps
from .pages import json_ld_product

MONEY = ("price", "pix_price", "original_price", "installment_price")
FIELDS = ("title", "product_id", "sku", "gtin", "brand", "seller", *MONEY, "installment_count")


@dataclass(frozen=True)
class At:
    """A place: kind state (path of the state's JSON), ld (field of the JSON-LD product), css (selector, with an
    attribute or the text), url (pattern, whose first group counts) or fixed (a text). `pattern` takes a part of what stands there."""

    kind: str
    where: str
    attribute: str | None = None
    pattern: str | None = None


def state(*paths: str) -> tuple[At, ...]:
    return tuple(At("state", p) for p in paths)


def ld(field: str) -> tuple[At, ...]:
    return (At("ld", field),)


def css(*selectors: str, attribute: str | None = None, pattern: str | None = None) -> tuple[At, ...]:
    return tuple(At("css", s, attribute, pattern) for s in selectors)


@dataclass(frozen=True)
class Format:
    """`script` is the id of the script that holds the page's state, `root` the product's path in it."""

    name: str
    currency: str
    fields: dict[str, tuple[At, ...]]
    script: str | None = None
    root: str = "$"


#: Where four kinds of stores keep a product's fields.
FORMATS = {
    f.name: f
    for f in (
        Format(
            "script state",
            "BRL",
            {
                "title": (*state("title"), *ld("name"), *css("h1", "title")),
                "product_id": (*state("id"), *ld("sku"), At("url", r"/produto/(\d+)")),
                "sku": state("sku", "productSku", "reference"),
                "gtin": (*state("gtin", "ean", "gtin13"), *ld("gtin")),
                "brand": (*state("brands.name"), *ld("brand")),
                "seller": state("sellerName", "marketplace.sellerName"),
                "price": (*state("price", "prices.price"), *ld("price")),
                "pix_price": state("prices.priceWithDiscount", "prime.priceWithDiscount"),
                "original_price": state("prices.oldPrice"),
                "installment_price": state("installment.amount"),
                "installment_count": state("installment.installment"),
            },
            script="__NEXT_DATA__",
            root="$.props.pageProps.product",
        ),
        Format(
            "numbered ids",
            "BRL",
            {
                "title": (*ld("name"), *css("h1", "title")),
                "product_id": (At("url", r"/produto/(\d+)"), *ld("sku")),
                "sku": ld("sku"),
                "gtin": ld("gtin"),
                "brand": ld("brand"),
                "price": (*css("#valParc", "span.valParc"), *css("#valVista", "p.valVista"), *ld("price")),
                "pix_price": (*css("#valVista", "p.valVista"), *ld("price")),
                "original_price": css("p.precode del", ".precode del", "#topopreco del", ".info-price del"),
                "installment_price": css("#Parc"),
                "installment_count": css("#nParc", pattern=r"(\d+)"),
            },
        ),
        Format(
            "price widget",
            "BRL",
            {
                "title": (*ld("name"), *css("h1.ui-pdp-title", "h1", "title")),
                "product_id": (*ld("sku"), At("url", r"/p/([A-Z]{3}\d+)"), At("url", r"/([A-Z]{3}-?\d+)")),
                "sku": ld("sku"),
                "gtin": ld("gtin"),
                "brand": ld("brand"),
                "price": (*css(".ui-pdp-price [itemprop='price']", "[itemprop='price']", attribute="content"), *ld("price")),
                "original_price": css(".ui-pdp-price__original-value", "s.ui-pdp-price__original-value", attribute="aria-label", pattern=r"([\d.,]+)"),
                "installment_count": css("#pricing_price_subtitle", pattern=r"(\d+)\s*x"),
            },
        ),
        Format(
            "shop template",
            "USD",
            {
                "title": (*ld("name"), *css("h1 .base", "h1", "title")),
                "product_id": (*css("[itemprop='sku']", attribute="content"), *css("[itemprop='sku']"), *css("form[data-product-sku]", attribute="data-product-sku"), *ld("sku")),
                "sku": (*css("[itemprop='sku']", attribute="content"), *css("[itemprop='sku']"), *css("form[data-product-sku]", attribute="data-product-sku")),
                "gtin": ld("gtin"),
                "brand": (*css(".product-info-main .amshopby-brand-title-link"), *ld("brand")),
                "price": (*ld("price"), *css("[itemprop='price']", attribute="content"), *css("[data-price-amount]", attribute="data-price-amount"), *css(".price")),
            },
        ),
    )
}


def register_format(added: Format) -> None:
    FORMATS[added.name] = added


def read_products(pages: DataFrame, formats: dict[str, Format] | None = None) -> DataFrame:
    """One row a page of (url, format, html): url, format, canonical_url, currency, each field of FIELDS, sources (which place gave
    which field), and outcome: ok, no_product (neither title nor price) or unknown_format.

    Of a field's places the first that holds something counts. Amounts of states, JSON-LD and attributes are
    plain numbers, those of texts written the local way; an original price that isn't above the price is
    none. Pages are known by url and format; repeated ones give one row. An empty page has no product.
    """
    formats = formats or FORMATS
    pages = settled(pages.select("url", "format", "html").dropDuplicates(["url", "format"]))
    table = settled(elements(pages))
    places = [(f.name, field, rank, at) for f in formats.values() for field, each in f.fields.items() for rank, at in enumerate(each)]
    row = lambda name, field, rank, at, value: F.when((F.col("format") == name) & (F.trim(value) != ""), F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), F.trim(value).alias("value"), F.lit(at.kind if at.attribute is None else "attribute").alias("kind"), F.lit(f"{at.kind}:{at.where}").alias("source")))

    def part(value, at):
        return F.regexp_extract(value, at.pattern, 1) if at.pattern else value

    # the places of one compound are all asked in one pass; those within others are joins
    held = lambda at: F.element_at("attributes", F.lit(at.attribute)) if at.attribute else F.col("text")
    one = [F.when(compound(at.where), row(n, f, r, at, part(held(at), at))) for n, f, r, at in places if at.kind == "css" and len(steps(at.where)) == 1]
    found = [table.select("url", "format", "node", F.explode(F.array_compact(F.array(*one))).alias("p"))]
    for n, f, r, at in places:
        if at.kind == "css" and len(steps(at.where)) > 1:
            hits = select(table.where(F.col("format") == n), at.where, ["url", "format"])
            found.append(hits.select("url", "format", "node", F.explode(F.array_compact(F.array(row(n, f, r, at, part(held(at), at))))).alias("p")))
    said = pages.withColumn("ld", json_ld_product(F.col("html"))).select("url", "format", "ld")
    scripts = {f.script for f in formats.values() if f.script}
    states = table.where((F.col("tag") == "script") & F.col("id").isin(*scripts)).groupBy("url", "format").agg(F.min_by("text", "node").alias("state"))
    said = said.join(states, [said[c].eqNullSafe(states[c]) for c in ("url", "format")], "left").select(said["url"], said["format"], "ld", "state")
    of = {"state": lambda n, at: F.get_json_object("state", f"{formats[n].root}.{at.where}"), "ld": lambda n, at: F.col("ld")[at.where], "url": lambda n, at: F.regexp_extract("url", at.where, 1), "fixed": lambda n, at: F.lit(at.where)}
    more = [row(n, f, r, at, part(of[at.kind](n, at), at)) for n, f, r, at in places if at.kind in of]
    found.append(said.select("url", "format", F.lit(0).alias("node"), F.explode(F.array_compact(F.array(*more))).alias("p")))
    rows = found[0]
    for each in found[1:]:
        rows = rows.unionByName(each)
    first = rows.groupBy("url", "format", "p.field").agg(F.min_by("p", F.struct("p.rank", "node")).alias("p"))
    pick = lambda field: F.max(F.when(F.col("field") == field, F.col("p"))).alias(field)
    wide = first.groupBy("url", "format").agg(*(pick(f) for f in FIELDS), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "p.source")))).alias("sources"))
    currency = F.element_at(F.create_map(*(F.lit(x) for f in formats.values() for x in (f.name, f.currency))), F.col("format"))
    amount = lambda f: F.when(F.col(f)["kind"] == "css", parse_money(F.col(f)["value"], currency)).otherwise(F.col(f)["value"].try_cast("decimal(18,4)"))
    both = pages.join(wide, [pages[c].eqNullSafe(wide[c]) for c in ("url", "format")], "left").drop(wide["url"], wide["format"])
    both = both.select("url", "format", canonical_url(F.col("url")).alias("canonical_url"), currency.alias("currency"), *(amount(f).alias(f) if f in MONEY else F.col(f)["value"].try_cast("int").alias(f) if f == "installment_count" else F.col(f)["value"].alias(f) for f in FIELDS), "sources")
    both = both.withColumn("original_price", F.when(F.col("original_price") > F.col("price"), F.col("original_price")))
    known = F.coalesce(F.col("format").isin(*formats), F.lit(False))
    return both.withColumn("outcome", F.when(~known, "unknown_format").when(F.col("title").isNull() & F.col("price").isNull(), "no_product").otherwise("ok"))
