"""Exchange rates: validation, latest values, and conversion in exact decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which rate types stand in, each pair's usual type, and each pair's plausible band.
PREFERENCE = ("tourism_sell", "official", "ptax_sell", "market", "tourism_buy", "ptax_buy")
USUAL = (("USD", "BRL", "tourism_sell"), ("PYG", "BRL", "official"), ("USD", "PYG", "official"))
BANDS = (("USD", "BRL", "2", "15"), ("PYG", "BRL", "0.00005", "0.01"), ("USD", "PYG", "500", "100000"))


def validate(rates: DataFrame, known: DataFrame, max_change: float = 15.0) -> DataFrame:
    """Rates (base, quote, rate_type, rate) with errors: not_positive, magnitude, change (against the last known rate)."""
    spark = rates.sparkSession
    bands = F.broadcast(spark.createDataFrame(list(BANDS), "base string, quote string, low string, high string"))
    # one last rate of each pair and type: that of the source which has it first by name
    last_known = known.groupBy("base", "quote", "rate_type").agg(F.min_by("rate", "source").alias("last"))
    d = rates.join(bands, ["base", "quote"], "left").join(last_known, ["base", "quote", "rate_type"], "left")
    rate, last = F.col("rate"), F.col("last")
    change = F.abs(rate - last) * 100 > last * F.lit(max_change).cast("decimal(5,2)")
    errors = F.array_compact(F.array(F.when(rate <= 0, "not_positive"), F.when(~rate.between(F.col("low").cast("decimal(24,12)"), F.col("high").cast("decimal(24,12)")), "magnitude"), F.when((last > 0) & change, "change")))
    return d.withColumn("errors", errors).drop("low", "high", "last")


def cross_checks(rates: DataFrame, most_premium: float = 12.0, agreement: float = 0.5) -> DataFrame:
    """Soft checks of a batch (base, quote, rate_type, rate, source): tourism rates are at or above the reference
    selling rate, by so many percent at most; two sources of one rate are so near. One row per
    failed check: base, quote, check, source, other, rate, other_rate."""
    pct = lambda x: F.lit(x).cast("decimal(8,4)")
    d = rates.select("base", "quote", "rate_type", F.col("rate").cast("decimal(24,12)").alias("rate"), "source")
    row = lambda name: ["base", "quote", F.lit(name).alias("check"), "t.source", F.col("p.source").alias("other"), "t.rate", F.col("p.rate").alias("other_rate")]
    tourism, reference = d.where("rate_type = 'tourism_sell'").alias("t"), d.where("rate_type = 'ptax_sell' and rate > 0").alias("p")
    high = tourism.join(reference, ["base", "quote"]).where(~((F.col("t.rate") >= F.col("p.rate")) & (F.col("t.rate") * 100 <= F.col("p.rate") * (100 + pct(most_premium)))))
    # each two sources of a pair and type, compared by source
    one, two = d.where("rate_type like 'ptax%'").alias("t"), d.where("rate_type like 'ptax%' and rate > 0").alias("p")
    apart = one.join(two, ["base", "quote", "rate_type"]).where((F.col("t.source") > F.col("p.source")) & (F.abs(F.col("t.rate") - F.col("p.rate")) * 100 > F.col("p.rate") * pct(agreement)))
    return high.select(*row("tourism_premium")).unionByName(apart.select(*row("ptax_agreement")))


def mark_stale(latest: DataFrame, now: str, max_age_seconds: int = 86400) -> DataFrame:
    """Latest rates (fetched_at) with status stale where they are older than that, else fresh."""
    old = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at") > max_age_seconds
    return latest.withColumn("status", F.when(old, "stale").otherwise("fresh"))


def attach(offers: DataFrame, rates: DataFrame, target: str = "BRL") -> DataFrame:
    """Offers (id, price, currency) with converted_price, rate_type and why there is none; an offer is never lost."""
    done = convert(offers.select("id", F.col("price").cast("decimal(18,4)").alias("amount"), F.upper(F.trim("currency")).alias("currency"), F.lit(target).alias("target")), rates)
    return offers.join(done.select("id", F.col("converted").alias("converted_price"), "rate_type", "reason"), "id", "left")


def convert(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """Amounts (id, amount decimal(18,4), currency) in target: the pair's usual rate type, else the
    first type by preference, of fresh rates before stale; one currency needs none. Rounded half up
    to cents where the target is BRL. Without a rate the result is null and reason says so."""
    spark = amounts.sparkSession
    usual = F.broadcast(spark.createDataFrame(list(USUAL), "base string, quote string, usual string"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("rate_type")), F.lit(0))
    ranked = rates.join(usual, ["base", "quote"], "left").withColumn("exact", F.coalesce(F.col("rate_type") == F.col("usual"), F.lit(False)))
    order = [F.col("exact").desc(), (F.col("status") == "fresh").desc(), F.when(rank == 0, 99).otherwise(rank), F.col("rate_type")]
    # a pair's rates are few; the best of each is a small table
    best = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("base", "quote").orderBy(*order))).where("rn = 1").select(F.col("base").alias("currency"), F.col("quote").alias("target"), "rate", "rate_type", "source")
    same = F.col("currency") == F.col("target")
    d = amounts.join(best, ["currency", "target"], "left")
    rate = F.when(same, F.lit(1)).otherwise(F.col("rate")).cast("decimal(19,12)")
    exact = F.col("amount").cast("decimal(18,4)") * rate
    value = F.when(F.col("target") == "BRL", F.round(exact, 2)).otherwise(exact).cast("decimal(38,12)")
    return d.select("id", "amount", "currency", "target", value.alias("converted"), F.when(same, "official").otherwise(F.col("rate_type")).alias("rate_type"), F.when(same, "identity").otherwise(F.col("source")).alias("source"), F.when(rate.isNull(), "no_rate").alias("reason"))


def prefer_source(rates: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Of each pair and type the first source that has it."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    w = Window.partitionBy("base", "quote", "rate_type").orderBy(F.when(rank == 0, 99).otherwise(rank), "source")
    return rates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def inverse(rates: DataFrame, base: str, quote: str) -> DataFrame:
    """The rate the other way, to 12 decimals; null from zero."""
    one = F.lit(1).cast("decimal(1,0)") / F.nullif(F.col("rate").cast("decimal(19,12)"), F.lit(0).cast("decimal(19,12)"))
    return rates.where((F.col("base") == base) & (F.col("quote") == quote)).select(F.col("quote").alias("base"), F.col("base").alias("quote"), "rate_type", F.round(one, 12).cast("decimal(24,12)").alias("rate"))
