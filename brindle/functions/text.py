"""Text, URL and hashing functions, as Column expressions."""

from __future__ import annotations

import functools
import unicodedata
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that search folds, and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"
#: Query keys and prefixes that say where a visit came from, not what it shows.
TRACKING_KEYS = ("fbclid", "gclid", "gbraid", "wbraid", "gad_source", "gad_campaignid", "ref", "ref_", "source", "from", "sp_atk", "utm_campaign", "utm_medium", "utm_source", "utm_term", "utm_content", "xptdk", "spm", "algo_pvid", "algo_exp_id", "pdp_ext_f", "pdp_npi", "curpageloguid", "utparam-url", "tblci", "aff_fcid", "aff_fsk", "aff_platform", "aff_trace_key", "terminal_id", "af", "dp")
TRACKING_PREFIXES = ("matt_", "cq_", "gad_")
#: Brands that say nothing.
NO_BRANDS = ("outros", "other", "others", "generico", "n a", "na", "amazon renewed store", "amazon renewed", "renewed")


def search_fold(text: Column) -> Column:
    """Fold the accents of both cases, then lower."""
    return F.lower(F.translate(text, ACCENTED + ACCENTED.upper(), PLAIN + PLAIN))


#: Where characters stand that folding changes, but for Hangul syllables: the planes without the ideographs, and the compatibility ideographs.
_FOLDING = (range(0x41, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20))
#: What Python's strip removes at both ends.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Hangul syllables are in the order of their first, middle and last letters; a syllable may lack the last.
_SYLLABLE, _FIRST, _MIDDLE, _LAST = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A8, 27)


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one or to none (these last), what the former fold to, and characters that fold to several."""
    single, gone, several = {}, [], {}
    for c in (chr(n) for places in _FOLDING for n in places if not 0xD800 <= n < 0xE000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if not plain:
            gone.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            single[c] = plain
    return "".join(single) + "".join(gone), "".join(single.values()), several


@functools.cache
def _spelled_class() -> str:
    """A class of the characters that fold to several, as ranges."""
    points = sorted(map(ord, _folding()[2]))
    starts = [p for p in points if p - 1 not in set(points)]
    ends = [p for p in points if p + 1 not in set(points)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "\\x{ac00}-\\x{d7a3}]"


def _spelled(c: Column) -> Column:
    """A character that folds to several, spelled out."""
    several = _folding()[2]
    at = F.position(c, F.lit("".join(several)))
    listed = F.get(F.split(F.lit("\n".join(several.values())), "\n"), at - 1)
    letter = lambda kind, n: F.substring(F.lit("".join(chr(kind[0] + i) for i in range(kind[1]))), n + 1, F.lit(1))
    n = F.ascii(c) - _SYLLABLE
    last = n % (_LAST[1] + 1)
    first = F.floor(n / ((_LAST[1] + 1) * _MIDDLE[1])).cast("int")
    middle = F.floor(n / (_LAST[1] + 1)).cast("int") % _MIDDLE[1]
    syllable = F.concat(letter(_FIRST, first), letter(_MIDDLE, middle), F.when(last > 0, letter(_LAST, last - 1)).otherwise(""))
    return F.when(n.between(0, 11171), syllable).when(at > 0, listed).otherwise(c)


def fold(text: Column) -> Column:
    """Compatibility decomposition without combining marks, case-folded and stripped, for every character.

    Plain ASCII takes the short way. A table folds characters to one character or none; only texts that
    hold one which folds to several are taken apart."""
    many, one, _ = _folding()
    single = F.translate(text, many, one)
    spelled = F.array_join(F.transform(F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0)), _spelled), "")
    wide = F.when(single.rlike(_spelled_class()), spelled).otherwise(single)
    return F.trim(F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(wide), F.lit(BLANKS))


def search_terms(query: str) -> tuple[str, ...]:
    """Distinct folded terms of a query, in order; over 200 characters or 8 terms is an error."""
    folded = query.translate(str.maketrans(ACCENTED + ACCENTED.upper(), PLAIN + PLAIN)).lower()
    terms = tuple(dict.fromkeys(folded.split()))
    if len(query) > 200 or len(terms) > 8:
        raise ValueError("a query has at most 200 characters and 8 terms")
    return terms


def search_window(start: datetime | None, end: datetime | None) -> tuple[datetime | None, datetime | None]:
    """A half-open window of a query, either end open; times without a zone, and an end that isn't after the start, are errors."""
    if any(x is not None and x.utcoffset() is None for x in (start, end)):
        raise ValueError("a window's times have a zone")
    if start is not None and end is not None and start >= end:
        raise ValueError("a window ends after its start")
    return start, end


def within(at: Column, start: datetime | None, end: datetime | None) -> Column:
    """Whether a timestamp is in a window that search_window takes; a null time is in none that has an end."""
    start, end = search_window(start, end)
    out = F.lit(True)
    if start is not None:
        out = out & (at >= F.lit(start))
    if end is not None:
        out = out & (at < F.lit(end))
    return F.coalesce(out, F.lit(False))


def matches_all(terms: tuple[str, ...], fields: list[Column]) -> Column:
    """Every term stands literally in at least one folded field."""
    out = F.lit(True)
    for term in terms:
        some = F.lit(False)
        for field in fields:
            some = some | F.coalesce(F.contains(search_fold(field), F.lit(term)), F.lit(False))
        out = out & some
    return out


def normalize_brand(raw: Column) -> Column:
    clean = F.trim(F.regexp_replace(fold(raw), "[^a-z0-9]+", " "))
    return F.when((clean != "") & ~clean.isin(*NO_BRANDS), clean)


def normalize_code(raw: Column) -> Column:
    """Models and part numbers: folded letters and digits only."""
    return F.nullif(F.regexp_replace(fold(raw), "[^a-z0-9]+", ""), F.lit(""))


def query_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")


def title_tokens(title: Column) -> Column:
    """Distinct folded tokens, with capacity units joined to their numbers."""
    joined = F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"\b(\d+)\s*(gb|tb|mb)\b", "$1$2")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(joined, r"[^a-z0-9\s]+", " "), r"\s+"), lambda t: t != ""))


def token_ratio(a: Column, b: Column) -> Column:
    """Common tokens over those of the larger set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, no fragment, no tracking or blank parameters.

    Parameters are decoded before they are judged, and encoded anew in their order.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    origin, path = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1), F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(path, "/+$", "")
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+")), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(p.substr(F.locate("=", p) + 1, F.length(p))).alias("v")))
    keep = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"))
    kept = F.array_join(F.transform(keep, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    return F.concat(F.lower(origin), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def title_hint(url: Column) -> Column:
    """The words of a page's slug: the part before /p/, or the last part if it is long and no number."""
    path = F.trim(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, F.lit("p"))
    leaf = F.get(parts, F.size(parts) - 1)
    plain = F.regexp_replace(leaf, r"\.html?$", "")
    slug = F.when(at > 1, F.get(parts, (at - 2).cast("int"))).when(plain.rlike("^[0-9]{9,}$"), None).when((F.length(leaf) > 8) & ~F.lower(leaf).isin("dp", "gp", "product"), leaf)
    return F.nullif(F.trim(F.regexp_replace(F.translate(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), "-_", "  "), " +", " ")), F.lit(""))


def request_fingerprint(store: Column, url: Column, product_id: Column, variant: Column) -> Column:
    return F.sha2(F.concat(store, F.lit("|"), canonical_url(url), F.lit("|"), product_id, F.lit("|"), F.coalesce(variant, F.lit(""))), 256)


def variant_key(attributes: Column) -> Column:
    """Sorted k=v of a map, joined by bars; null without entries."""
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(attributes) > 0, F.array_join(pairs, "|"))


def redact(text: Column) -> Column:
    """Mask bearer tokens and passwords in URLs."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(bearer\s+)\S+", "$1***"), r"://([^:/@]+):[^@/]+@", "://$1:***@")


#: Fixed value: names of fields that hold secrets.
SECRET_KEYS = r"(?i)(password|passwd|secret|token|authorization|cookie|api[_-]?key|service[_-]?role|private[_-]?key|refresh[_-]?token|access[_-]?token|database_url|proxy|credential|connection.?string)"


def redact_fields(fields: Column) -> Column:
    """A map of text fields: secret ones masked whole, the others as redact does."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET_KEYS), "***").otherwise(redact(v)))


def _json_text(value: Column) -> Column:
    """A JSON string, or null; text without anything to escape is only quoted."""
    plain = value.rlike(r"^[^\x00-\x1F\"\\\x7F]*$")
    escaped = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    return F.when(value.isNull(), "null").when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(escaped)


def offer_fingerprint(price: Column, currency: Column, seller: Column, availability: Column, pix_price: Column) -> Column:
    """SHA-256 of the offer's sorted JSON; amounts at four decimals, so that scale alone is no change."""
    money = lambda c: F.coalesce(F.concat(F.lit('"'), c.cast("decimal(18,4)").cast("string"), F.lit('"')), F.lit("null"))
    name = F.nullif(F.lower(F.trim(seller)), F.lit(""))
    text = _json_text
    return F.sha2(F.concat(F.lit('{"availability":'), text(availability), F.lit(',"currency":'), text(currency), F.lit(',"pix_price":'), money(pix_price), F.lit(',"price":'), money(price), F.lit(',"seller":'), text(name), F.lit("}")), 256)
