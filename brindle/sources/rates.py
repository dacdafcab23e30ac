"""Exchange rates from landed pages and feeds, as rows: base, quote, rate_type, rate, at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_local_decimal
from .pages import plain_text

RATES = "array<struct<base:string,quote:string,rate_type:string,rate:decimal(24,12),at:timestamp>>"


def _rate(base: str, quote: str, kind: str, rate: Column, at: Column | None = None) -> Column:
    return F.struct(F.lit(base).alias("base"), F.lit(quote).alias("quote"), F.lit(kind).alias("rate_type"), rate.cast("decimal(24,12)").alias("rate"), (at if at is not None else F.lit(None)).cast("timestamp").alias("at"))


def rows_of(html: Column) -> Column:
    """The cells' texts of every table row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: plain_text(c)))


def day(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("dd/MM/yyyy"))


def local_settlement(html: Column) -> Column:
    """The newest guarani rate: the first row whose first cell is a date; its fifth cell is the rate."""
    row = F.get(F.filter(rows_of(html), lambda r: F.get(r, 0).rlike(r"\d{2}/\d{2}/\d{4}")), 0)
    rate = parse_local_decimal(F.get(row, 4))
    return F.filter(F.array(_rate("PYG", "BRL", "official", rate, day(F.get(row, 0)))), lambda r: r["rate"] > 0)


def central_bank_table(html: Column) -> Column:
    """Guaranies to the dollar, and reals to the guarani as one over guaranies to the real; nothing without both rows
    or where one is zero. Rows hold name, symbol, dollars to the unit, guaranies to the unit."""
    table = F.regexp_extract(html, r"(?is)<table[^>]+id=[\"']?cotizacion-interbancaria[\"']?(.*?)</table>", 1)
    value = lambda symbol: parse_local_decimal(F.get(F.get(F.filter(rows_of(table), lambda r: F.upper(F.get(r, 1)) == symbol), 0), 3))
    dollar, real = value("USD"), value("BRL")
    inverse = F.round(F.lit(1).cast("decimal(1,0)") / F.nullif(real.cast("decimal(19,6)"), F.lit(0).cast("decimal(19,6)")), 12)
    both = (dollar > 0) & (real > 0)
    return F.when(F.coalesce(both, F.lit(False)), F.array(_rate("USD", "PYG", "official", dollar), _rate("PYG", "BRL", "official", inverse))).otherwise(F.array().cast(RATES))


def newspaper_table(html: Column) -> Column:
    """Buying and selling rates of the dollar by kind: tourism and commercial rows of name, buy, sell, time."""
    rows = rows_of(html)
    row = lambda word: F.get(F.filter(rows, lambda r: F.translate(F.lower(F.get(r, 0)), "áãâéóô", "aaaeoo").rlike(f"dolar.*{word}")), 0)
    time = lambda r: F.try_to_timestamp(F.regexp_extract(F.get(r, 3), r"(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2})", 1), F.lit("dd/MM/yyyy HH:mm"))
    tourism, commercial = row("turismo"), row("comercial")
    pair = lambda r, buy, sell: [_rate("USD", "BRL", buy, parse_local_decimal(F.get(r, 1)), time(r)), _rate("USD", "BRL", sell, parse_local_decimal(F.get(r, 2)), time(r))]
    found = F.array(*pair(tourism, "tourism_buy", "tourism_sell"), *pair(commercial, "ptax_buy", "ptax_sell"))
    # without the tourism row the page is not the one it should be
    return F.filter(found, lambda r: r["rate"].isNotNull() & tourism.isNotNull())


def tourism_ticker(html: Column) -> Column:
    """The selling rate of tourism dollars in a ticker."""
    value = F.regexp_extract(html, r"(?is)data-symbol=[\"']USDBRLT_VALR[\"'][^>]*>.*?ticker__item__value[^>]*>\s*R\$\s*([0-9.,]+)\s*<", 1)
    return F.filter(F.array(_rate("USD", "BRL", "tourism_sell", parse_local_decimal(value))), lambda r: r["rate"].isNotNull())


def embedded_converter(html: Column) -> Column:
    """The reference rate in a page's converter, which is told for both sides."""
    value = F.regexp_extract(html, r"(?is)Converter\(\{quotes:.*?\"USDBRL_BCBR\"\s*:\s*\{[^{}]*?\"lastQuote\"\s*:\s*\"?([0-9.,]+)", 1)
    rate = parse_local_decimal(value)
    return F.filter(F.array(_rate("USD", "BRL", "ptax_buy", rate), _rate("USD", "BRL", "ptax_sell", rate)), lambda r: r["rate"].isNotNull())


#: Readers by source, each tried in order until one finds rates.
READERS = {"settlement": (local_settlement,), "central_bank": (central_bank_table,), "newspaper": (newspaper_table, tourism_ticker), "converter": (embedded_converter,)}


def read_rates(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rates of landed pages (source, body and columns to keep), with outcome parsed or, for a page that tells none, no_rates."""
    found = F.lit(None).cast(RATES)
    for source, readers in READERS.items():
        first = found
        for reader in reversed(readers):
            rates = reader(F.col("body"))
            first = F.when(F.size(rates) > 0, rates).otherwise(first)
        found = F.when(F.col("source") == source, first).otherwise(found)
    rows = pages.select(*(keep or []), "source", F.explode_outer(F.when(F.size(found) > 0, found)).alias("r"))
    return rows.select(*(keep or []), "source", "r.*", F.when(F.col("r").isNull(), "no_rates").otherwise("parsed").alias("outcome"))
