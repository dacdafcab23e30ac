"""Identifiers, money, units, times, vectors and severities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtin_check_digit(body: Column) -> Column:
    """Weights 3 and 1 from the right; the digit that fills the sum to ten. A body of up to 18 digits is
    weighed in plain arithmetic: longer ones have no check digit here."""
    n = body.try_cast("long")
    digit = lambda i: F.call_function("div", n, F.lit(10**i)) % 10
    total = sum((digit(i) * (3 if i % 2 == 0 else 1) for i in range(18)), F.lit(0))
    return F.when(body.rlike("^[0-9]{1,18}$"), ((10 - total % 10) % 10).cast("int"))


def normalize_gtin(raw: Column) -> Column:
    """Digits of a valid GTIN-8, -13 or -14; 12 digits get a leading zero; else null."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    digits = F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits)).otherwise(digits)
    n = F.length(digits)
    body = F.when(n.isin(8, 13, 14), digits.substr(F.lit(1), n - 1))
    return F.when(gtin_check_digit(body) == digits.substr(n, F.lit(1)).cast("int"), digits)


def parse_money(value: Column, currency: Column) -> Column:
    """Amount over zero, or null: in BRL and PYG dots part thousands and the comma is decimal; elsewhere one comma alone is decimal."""
    clean = F.regexp_replace(F.replace(value, F.lit("−"), F.lit("-")), r"[^0-9,.-]", "")
    local = F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    other = F.when(clean.rlike(r"^[^,.]*,[^,.]*$"), F.replace(clean, F.lit(","), F.lit("."))).otherwise(clean)
    text = F.when(currency.isin("BRL", "PYG"), local).otherwise(other)
    amount = F.when(text.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text.try_cast("decimal(18,4)"))
    return F.when(amount > 0, amount)


def parse_local_decimal(value: Column) -> Column:
    """With a comma, dots part thousands; without, several dots do."""
    clean = F.regexp_replace(F.trim(value), "[ ​]", "")
    text = F.when(F.contains(clean, F.lit(",")), F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(clean.rlike(r"\..*\."), F.replace(clean, F.lit("."), F.lit(""))).otherwise(clean)
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), text.try_cast("decimal(24,12)"))


def json_amount(payload: Column, key: str) -> Column:
    """A plain positive number of a JSON field, at four decimals; signs, exponents and blanks give null."""
    return plain_amount(F.get_json_object(payload, f"$.{key}"))


def plain_amount(text: Column) -> Column:
    """A plain positive number as text, at four decimals; signs, exponents and blanks give null."""
    amount = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("decimal(18,4)"))
    return F.when(amount > 0, amount)


def currency_code(value: Column) -> Column:
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def price_extreme(a: Column, b: Column, same_currency: Column) -> Column:
    return F.coalesce(same_currency & (F.least(a, b) > 0) & (F.greatest(a, b) >= 4 * F.least(a, b)), F.lit(False))


def capacity(value: Column) -> Column:
    m = F.regexp_extract(F.lower(value), r"(\d+(?:[.,]\d+)?)\s*(gb|tb|mb)\b", 0)
    return F.when(m != "", F.concat_ws(" ", F.replace(F.regexp_extract(m, r"([\d.,]+)", 1), F.lit(","), F.lit(".")), F.upper(F.regexp_extract(m, "([a-z]+)", 1))))


def frequency(value: Column) -> Column:
    m = F.regexp_extract(F.lower(value), r"(\d+(?:[.,]\d+)?)\s*(mhz|ghz|hz|mt/s)", 0)
    unit = F.regexp_extract(m, "([a-z/]+)$", 1)
    shown = F.when(unit == "mhz", "MHz").when(unit == "ghz", "GHz").when(unit == "hz", "Hz").otherwise("MT/s")
    return F.when(m != "", F.concat_ws(" ", F.floor(F.replace(F.regexp_extract(m, r"([\d.,]+)", 1), F.lit(","), F.lit(".")).cast("double")).cast("string"), shown))


def wattage(value: Column) -> Column:
    m = F.regexp_extract(F.upper(value), r"(\d+)\s*W\b", 1)
    return F.when(m != "", F.concat(m, F.lit(" W")))


def length_mm(value: Column) -> Column:
    m = F.regexp_extract(F.lower(value), r"(\d+)\s*mm\b", 1)
    return F.when(m != "", F.concat(m, F.lit(" mm")))


def kit(value: Column) -> Column:
    """2 x 16 gb as 2x16 GB; no kit is made up from a total."""
    p = r"(?i)\b(\d+)\s*x\s*(\d+)\s*(gb|tb|mb)?\b"
    unit = F.coalesce(F.nullif(F.upper(F.regexp_extract(value, p, 3)), F.lit("")), F.lit("GB"))
    return F.when(value.rlike(p), F.concat(F.regexp_extract(value, p, 1).cast("int").cast("string"), F.lit("x"), F.regexp_extract(value, p, 2).cast("int").cast("string"), F.lit(" "), unit))


def memory_type(value: Column) -> Column:
    """ddr 5 as DDR5, gddr6x as GDDR6X."""
    p = r"(?i)\b(g?ddr)\s*([2-7]x?)"
    return F.when(value.rlike(p), F.upper(F.concat(F.regexp_extract(value, p, 1), F.regexp_extract(value, p, 2))))


def pcie(value: Column) -> Column:
    """pcie 4 as PCIe 4.0."""
    g = F.nullif(F.regexp_extract(value, r"(?i)pci-?e(?:xpress)?\s*(?:gen\s*)?(\d(?:\.\d)?)", 1), F.lit(""))
    return F.when(g.isNotNull(), F.concat(F.lit("PCIe "), g, F.when(F.contains(g, F.lit(".")), "").otherwise(".0")))


def efficiency_class(value: Column) -> Column:
    """80+ gold as 80 Plus Gold; 80 Plus without a class."""
    tier = F.nullif(F.initcap(F.regexp_extract(value, r"(?i)\b(titanium|platinum|gold|silver|bronze|white)\b", 1)), F.lit(""))
    return F.when(value.rlike(r"(?i)80\s*(?:plus|\+)"), F.concat_ws(" ", F.lit("80 Plus"), tier))


def gpu_token(value: Column) -> Column:
    """rtx4070ti as RTX 4070 Ti."""
    p = r"(?i)\b(rtx|gtx|rx)\s*-?(\d{3,4})\s*(ti|super|xtx|xt)?\b"
    e = lambda i: F.nullif(F.regexp_extract(value, p, i), F.lit(""))
    suffix = F.when(F.lower(e(3)).isin("ti", "super"), F.initcap(e(3))).otherwise(F.upper(e(3)))
    return F.when(e(2).isNotNull(), F.concat_ws(" ", F.upper(e(1)), e(2), suffix))


def attribute_value(key: Column, value: Column) -> Column:
    """A value in its key's usual form; as it is where none is known."""
    text = F.trim(value)
    inches = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1)
    forms = [
        (("storage", "ram", "vram", "capacity", "total_capacity", "module_capacity"), capacity(text)),
        (("frequency", "refresh_rate"), frequency(text)),
        (("radiator_size", "fan_size", "cooler_height"), length_mm(text)),
        (("screen_size",), F.when(text.rlike(r"(?i)\d\s*(?:mm|cm)\b"), length_mm(text)).when(inches != "", F.concat(F.replace(inches, F.lit(","), F.lit(".")), F.lit('"')))),
        (("wattage", "power"), wattage(text)),
        (("memory_type", "ddr"), memory_type(text)),
        (("pcie_generation", "pcie"), pcie(text)),
        (("efficiency", "efficiency_rating"), efficiency_class(text)),
        (("kit_configuration", "module_count"), kit(text)),
        (("gpu_model", "gpu"), gpu_token(text)),
    ]
    out = text
    for keys, form in reversed(forms):
        out = F.when(F.lower(key).isin(*keys), F.coalesce(form, text)).otherwise(out)
    return F.when(text != "", out)


def aware_time(value: Column, zone: str | None = None) -> Column:
    """A point in time from text: epoch seconds, or milliseconds over 10**12; year/month/day in the store's zone, Sao
    Paulo without one; ISO with its own offset, or else in the zone given, UTC without one. The session's zone is UTC."""
    text = F.trim(value)
    n = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    epoch = F.timestamp_micros((F.when(n > 1e12, n / 1000).otherwise(n) * 1_000_000).cast("long"))
    slashed = F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(:\d{2})?$"), F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/M/d H:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy/M/d H:mm"))))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), text.try_cast("timestamp"))
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"T|:")
    return F.coalesce(epoch, F.to_utc_timestamp(slashed, zone or "America/Sao_Paulo"), F.when(offset, iso).otherwise(F.to_utc_timestamp(iso, zone or "UTC")))


def regular_check(now: Column, key: Column, hours: int = 12, jitter: int = 600) -> Column:
    """The next regular check: some hours on, and up to `jitter` seconds that the key decides."""
    return F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600 + F.pmod(F.xxhash64(key), F.lit(jitter + 1)))


def full_jitter(failures: Column, key: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds between none and the doubled delay, as the key decides."""
    most = F.least(F.lit(cap), base * F.pow(F.lit(2.0), failures))
    return most * F.pmod(F.xxhash64(key, failures), F.lit(1 << 20)) / float(1 << 20)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date of HTTP; never less than none."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(F.trim(header).rlike(r"^\d+$"), F.trim(header).try_cast("long")).otherwise(F.unix_timestamp(date) - F.unix_timestamp(now))
    return F.greatest(F.lit(0), seconds)


def crawl_due(next_at: Column, now: Column) -> Column:
    """Never scheduled, or its time has come."""
    return F.coalesce(next_at <= now, F.lit(True))


def rates_due(last: Column, key: Column, now: Column, interval: int = 3600) -> Column:
    """A source is due after its interval and up to a tenth of it more, as its key decides."""
    jitter = F.pmod(F.xxhash64(key), F.lit(interval // 10 + 1))
    return F.coalesce(F.unix_timestamp(last) + interval + jitter <= F.unix_timestamp(now), F.lit(True))


def promotion_active(status: Column, expires: Column, now: Column) -> Column:
    """Whether a promotion's price may be shown as current."""
    return F.coalesce((status == "active") & (expires > now), F.lit(False))


def retry_delay(failures: Column, base: int = 300, cap: int = 3600) -> Column:
    """Seconds: doubled for each failure after the first, up to the cap; none without a failure."""
    return F.when(failures < 1, F.lit(0).cast("long")).otherwise(F.least(F.lit(cap), (base * F.pow(F.lit(2), F.least(failures - 1, F.lit(30)))).cast("long")))


def adaptive_ttl(ttl: Column, changed: Column, available: Column, unchanged_runs: Column, failures: Column) -> Column:
    steady = F.least(F.lit(86400), F.greatest(F.lit(900), F.when(unchanged_runs >= 3, ttl * 2).otherwise(ttl)))
    return F.when(~available, F.when(failures < 3, 86400).otherwise(172800)).when(changed, F.greatest(F.lit(900), F.floor(ttl / 2))).otherwise(steady).cast("long")


def failure_ttl(ttl: Column, failures: Column) -> Column:
    return F.least(F.lit(86400), ttl * F.pow(F.lit(2), F.least(failures, F.lit(5)))).cast("long")


def next_check(regular: Column, promotion_expires: Column, now: Column, grace_seconds: int = 60) -> Column:
    """The regular check, or earlier shortly after a promotion ends; at once if it has ended."""
    after = F.when(promotion_expires <= now, now).otherwise(F.timestamp_seconds(F.unix_timestamp(promotion_expires) + grace_seconds))
    return F.least(regular, after)


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def cosine(a: Column, b: Column) -> Column:
    """Cosine held to -1 and 1; null for unlike lengths, empty or zero vectors and non-finite components."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / F.nullif(scale, F.lit(0.0))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


#: Milliseconds expected, and from which an operation counts as a warning, slow, critical.
BUDGETS = (("unit_test", 200, 500, 2000, 10000), ("integration_test", 1000, 2000, 10000, 60000), ("live_test", 15000, 30000, 120000, 600000), ("e2e", 30000, 60000, 300000, 900000), ("http_request", 1500, 3000, 15000, 60000), ("browser_navigation", 5000, 10000, 45000, 120000), ("browser_launch", 3000, 5000, 20000, 60000), ("crawler", 8000, 15000, 60000, 180000), ("product_search", 2000, 5000, 30000, 120000), ("product_match", 15000, 30000, 180000, 600000), ("database_query", 50, 200, 1000, 5000), ("migration", 2000, 5000, 30000, 120000), ("docker_build", 45000, 60000, 300000, 900000), ("ci_job", 180000, 300000, 900000, 1800000), ("agent_shell", 15000, 30000, 120000, 600000), ("agent_research", 60000, 120000, 600000, 1200000), ("external_tool", 5000, 15000, 60000, 300000))


def severity(ms: Column, warn: Column, slow: Column, critical: Column) -> Column:
    return F.when(ms >= critical, "critical").when(ms >= slow, "slow").when(ms >= warn, "warn").otherwise("normal")


def compact_size(value: Column) -> Column:
    """A size as whole gigabytes with their unit: 1 TB and 1024 are 1024gb; other text as it is, without blanks."""
    bare = F.regexp_replace(F.lower(value), r"\s+", "")
    n = F.regexp_extract(bare, r"^(\d+)(?:gb?|tb)?$", 1).try_cast("long")
    return F.when(n.isNotNull(), F.concat((n * F.when(bare.endswith("tb"), 1024).otherwise(1)).cast("string"), F.lit("gb"))).otherwise(F.nullif(bare, F.lit("")))
