"""Stores' search and product pages as rows, by a declarative adapter per page format.

An adapter names where a format keeps its listings: a path of JSON in a script of the page, or links of a
shape, and the fields of a listing. A new store is a new entry, not a parser. What a page without listings
means is told, so that a blocked page is never taken for a search without results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from ..functions.values import aware_time
from .pages import plain_text



@dataclass(frozen=True)
class Adapter:
    """script and path: the id of a JSON script and the path of its array of listings, with the fields of id, title,
    slug, price and a pattern that makes the address of id and slug. link: a pattern of product addresses, the
    first group the product's id. empty: words of a page that really found nothing."""

    store: str
    base: str
    script: str | None = None
    path: str = "$"
    product_id: str = "id"
    title: str = "name"
    slug: str = "slug"
    price: str = "price"
    address: str = "/produto/{id}/{slug}"
    link: str | None = None
    empty: tuple[str, ...] = ()


ADAPTERS: dict[str, Adapter] = {
    a.store: a
    for a in (
        Adapter("next", "https://www.next.example", script="__NEXT_DATA__", path="$.props.pageProps.data.catalogServer.data", product_id="code", slug="friendlyName", link=r"/produto/(\d+)", empty=("nenhum produto encontrado",)),
        Adapter("state", "https://www.state.example", script="__PRELOADED_STATE__", path="$.search.items", product_id="sku", title="title", slug="url_key", price="final_price", address="/p/{slug}/{id}", empty=("0 resultados",)),
        Adapter("magento", "https://magento.example", link=r"/(?:py|br)/([a-z0-9][a-z0-9-]{2,})(?:\.html|/)?$", empty=("no se encontraron productos",)),
        Adapter("links", "https://links.example", link=r"/(?:dp|item|product)/([A-Za-z0-9]{6,})", empty=("no results for", "did not match any products")),
    )
}


def register_adapter(adapter: Adapter) -> None:
    ADAPTERS[adapter.store] = adapter


CANDIDATES = "array<struct<url:string,title:string,product_id:string,price:string>>"


def _from_script(html: Column, a: Adapter) -> Column:
    body = F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{a.script}[\"'][^>]*>(.*?)</script>", 1)
    items = F.from_json(F.get_json_object(body, a.path), "array<string>")
    # an array of objects comes as texts of JSON
    field = lambda x, name: F.nullif(F.trim(F.get_json_object(x, f"$.{name}")), F.lit(""))

    def one(x):
        id_ = field(x, a.product_id)
        slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(field(x, a.slug), field(x, a.title), id_)), r"\s+", "-"), "[^a-z0-9-]+", "")
        before, _, rest = a.address.partition("{")
        pieces, text = [F.lit(a.base + before)], "{" + rest
        while text:
            name, _, text = text[1:].partition("}")
            pieces.append(id_ if name == "id" else slug)
            plain, sign, more = text.partition("{")
            pieces.append(F.lit(plain))
            text = sign + more
        return F.struct(F.concat(*pieces).alias("url"), field(x, a.title).alias("title"), id_.alias("product_id"), field(x, a.price).alias("price"))

    return F.filter(F.transform(items, one), lambda c: c["product_id"].isNotNull())


def _from_links(html: Column, a: Adapter) -> Column:
    links = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))

    def one(x):
        href = F.regexp_extract(x, r"(?is)href=[\"']([^\"']+)[\"']", 1)
        url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(a.base), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))
        path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]*", "")
        return F.struct(url.alias("url"), F.nullif(plain_text(x), F.lit("")).alias("title"), F.nullif(F.regexp_extract(path, a.link, 1), F.lit("")).alias("product_id"), F.lit(None).cast("string").alias("price"))

    return F.filter(F.transform(links, one), lambda c: c["product_id"].isNotNull())


def candidates(html: Column, adapter: Adapter, most: int | None = None) -> Column:
    """The page's listings by canonical address, each once, in its order, the first `most` if that is given: from
    the script, else from links."""
    found = F.array().cast(CANDIDATES)
    if adapter.script:
        found = F.coalesce(_from_script(html, adapter), found)
    if adapter.link:
        found = F.when(F.size(found) > 0, found).otherwise(F.coalesce(_from_links(html, adapter), F.array().cast(CANDIDATES)))
    keys = F.transform(found, lambda c: canonical_url(c["url"]))
    each = F.filter(found, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return each if most is None else F.slice(each, 1, most)


def outcome(html: Column, found: Column, adapter: Adapter) -> Column:
    """found, genuine_empty, incomplete (no page, or its script is cut off), parse_error (a script without listings), unknown."""
    text = F.lower(plain_text(F.regexp_replace(html, r"(?is)<script.*?</script>", " ")))
    nothing = F.lit(False)
    for words in adapter.empty:
        nothing = nothing | F.contains(text, F.lit(words))
    incomplete = F.coalesce(F.length(F.trim(html)), F.lit(0)) == 0
    broken = F.lit(False)
    if adapter.script:
        marked = F.contains(html, F.lit(adapter.script))
        incomplete = incomplete | (marked & ~html.rlike(rf"(?is){adapter.script}.*?</script>"))
        broken = marked
    return F.when(F.size(found) > 0, "found").when(incomplete, "incomplete").when(nothing, "genuine_empty").when(broken, "parse_error").otherwise("unknown")


def search_results(pages: DataFrame) -> DataFrame:
    """Listings of landed search pages (page_id, store, html): position, url, title, product_id, price, and the page's
    outcome; a page without listings has one row that tells why."""
    found, told = F.lit(None).cast(CANDIDATES), F.lit("unknown")
    for name, a in ADAPTERS.items():
        here = candidates(F.col("html"), a)
        found = F.when(F.col("store") == name, here).otherwise(found)
        told = F.when(F.col("store") == name, outcome(F.col("html"), here, a)).otherwise(told)
    d = pages.select("page_id", "store", found.alias("found"), told.alias("outcome"))
    return d.select("page_id", "store", "outcome", F.posexplode_outer("found").alias("position", "c")).select("page_id", "store", "outcome", "position", "c.*")


def flash_sale(payload: Column) -> Column:
    """End of the first flash sale or deep discount of a product's JSON that has one."""
    places = [f"{p}{b}" for p in ("", "product_price.", "item.", "promo_exclusive_prices.") for b in ("flash_sale", "flash_sale_preview", "deep_discount")]
    ends = [F.get_json_object(payload, f"$.{p}.{k}") for p in places for k in ("end_time", "end_timestamp", "flash_sale_end_time", "end")]
    return _timed("flash_sale", F.coalesce(*(aware_time(e) for e in ends)))


def lightning_deal(html: Column, item: Column) -> Column:
    """End of a lightning deal: that of the item, else any of the page, else the end of the day that its price is valid until."""
    any_ = F.nullif(F.regexp_extract(html, r'(?is)lightning_deal_configuration"\s*:\s*\{\s*"finish_date"\s*:\s*"([^"]+)"', 1), F.lit(""))
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)("[A-Z]+\d+"\s*:\s*\{[^{}]*?lightning_deal_configuration"\s*:\s*\{\s*"finish_date"\s*:\s*"[^"]+")'), F.lit(1))
    mine = F.get(F.filter(blocks, lambda b: F.contains(b, F.concat(F.lit('"'), F.upper(F.replace(item, F.lit("-"), F.lit(""))), F.lit('"')))), 0)
    finish = F.coalesce(F.nullif(F.regexp_extract(mine, r'"finish_date"\s*:\s*"([^"]+)"', 1), F.lit("")), any_)
    valid = F.nullif(F.regexp_extract(html, r'(?i)"priceValidUntil"\s*:\s*"(\d{4}-\d{2}-\d{2})"', 1), F.lit(""))
    return _timed("lightning_deal", F.coalesce(aware_time(finish), aware_time(F.concat(valid, F.lit("T23:59:59Z")))))


def campaign_countdown(html: Column) -> Column:
    """End of a countdown in the store's time, else the end of the day, there, that its price is valid until."""
    shown = F.nullif(F.regexp_extract(html, r"(?is)countdown\(\s*[\"'](\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(?::\d{2})?)[\"']", 1), F.lit(""))
    valid = F.nullif(F.regexp_extract(html, r'(?i)"priceValidUntil"\s*:\s*"(\d{4}-\d{2}-\d{2})"', 1), F.lit(""))
    return _timed("campaign_countdown", F.coalesce(aware_time(shown), aware_time(F.concat(F.replace(valid, F.lit("-"), F.lit("/")), F.lit(" 23:59:59")))))


def _timed(kind: str, expires: Column) -> Column:
    return F.when(expires.isNotNull(), F.struct(F.lit(kind).alias("type"), expires.alias("expires_at")))
