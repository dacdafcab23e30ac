"""Product matching: identities from titles, blocked pairs, an ordered decision, the best per store."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reading
from ..functions import titles as tt
from ..functions.text import fold, normalize_brand, normalize_code, token_ratio
from ..functions.values import normalize_gtin, price_extreme
from .cdc import early_best
from .tables import settled, unused

#: Thresholds and weights of the score.
AUTO, REVIEW, TITLE_WEIGHT, MODEL_WEIGHT, BRAND_WEIGHT, TITLE_CAP, SOFT_TITLE = 0.92, 0.75, 0.35, 0.45, 0.25, 0.74, 0.75
SPEC_WEIGHT, SPECS = 0.11, ("screen_size", "resolution", "refresh_rate", "panel")
#: Rows of a blocking key that one tile holds from the left side.
TILE_ROWS = 1000
#: Up to so many keys are broadcast as a table of parts.
BROADCAST_KEYS = 200_000

IDENTITY = ["id_gtin", "id_brand", "id_model", "id_parts", "id_numbers", "id_code", "id_category", "id_variants", "id_specs", "id_signature", "id_socket", "id_condition", "id_lock", "id_accessory", "id_bundle", "id_system", "id_card", "id_words"]


def identity(df: DataFrame, title: str, brand: str | None = None, gtin: str | None = None, model: str | None = None, variant: str | None = None) -> DataFrame:
    """Add what the rules compare, as id_ columns: GTIN, brand, model, part numbers and other codes, category,
    variants, specifications, the signature that must not differ, condition, network lock, what kind of
    listing it is, and the title's words. What isn't given is read from the title."""
    given = F.col(model) if model else F.lit(None).cast("string")
    folded, said = unused(df.columns, "_folded", "_said")
    d = df.withColumn(folded, fold(F.col(title)))
    t, r = F.col(folded), F.col(said)
    d = d.withColumn(said, reading.read(t, fold(F.concat_ws(" ", given, F.col(title))) if model else None))
    stated = tt.parse_variant(F.col(variant)) if variant else F.create_map().cast("map<string,string>")
    d = d.withColumn("id_variants", stated)
    pick = F.map_filter(r["attributes"], lambda k, v: k.isin("color", "network_lock") & ~F.map_contains_key("id_variants", k))
    lead = F.nullif(F.get(F.filter(F.split(t, r"\s+"), lambda w: w.isin(*tt.BRANDS)), 0), F.lit(""))
    named = F.coalesce(normalize_brand(F.col(brand)), lead) if brand else lead
    return d.select(
        *df.columns,
        (normalize_gtin(F.col(gtin)) if gtin else F.lit(None).cast("string")).alias("id_gtin"),
        named.alias("id_brand"),
        normalize_code(F.coalesce(given, r["model"])).alias("id_model"),
        r["parts"].alias("id_parts"),
        r["numbers"].alias("id_numbers"),
        r["code"].alias("id_code"),
        r["category"].alias("id_category"),
        F.transform_values(F.map_concat("id_variants", pick), lambda k, v: tt.variant_value(k, v)).alias("id_variants"),
        F.map_filter(r["attributes"], lambda k, v: k.isin(*SPECS)).alias("id_specs"),
        r["signature"].alias("id_signature"),
        r["socket"].alias("id_socket"),
        tt.condition(t)["code"].alias("id_condition"),
        r["lock"].alias("id_lock"),
        *(r[c].alias(f"id_{c}") for c in ("accessory", "bundle", "system", "card")),
        tt.title_words(t).alias("id_words"),
    )


def brand_roots(brands: DataFrame) -> DataFrame:
    """(brand, roots): the known brands that stand in a brand as words, itself among them. Of two brands of which one
    holds the other so, that one is a root of both. Takes a column brand."""
    known = brands.select("brand").where("brand IS NOT NULL").distinct()
    words = F.split("brand", " ")
    runs = F.flatten(F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    held = known.select("brand", F.explode(F.array_distinct(runs)).alias("root"))
    return held.join(known.select(F.col("brand").alias("root")), "root", "left_semi").groupBy("brand").agg(F.collect_set("root").alias("roots"))


def _chosen_of(names: tuple[str, ...], size: int) -> list[tuple[str, ...]]:
    return list(itertools.combinations(names, size))


def blocking_keys(roots: Column) -> Column:
    """Keys of an identity, sorted, of which two that a rule accepts by what they say share one. `roots` are its brand's.

    Codes, part numbers, GTINs and processors stand alone; what is accepted only between brands that fit, the
    signature's kinds, models and displays, goes with each root of the brand. A display counts with three
    specifications, with two beside a GTIN, and without a brand with all four. No key is made of a brand alone or of
    nothing. Inside blocks only, that is of pairs that meet by another key, are told: the review of an unclear
    variant, and what rests on brands of which one holds the other as a part of a word. The rule of the same listing
    asks for no content; `match_classes` joins those by themselves. Keys that stand alone start with "!".
    """
    f = F.col
    kinds = F.array(*map(F.lit, ("gpu", "ssd", "phone", "motherboard", "cooler_model")))
    of_kind = F.transform(F.filter(kinds, lambda k: F.map_contains_key("id_signature", k)), lambda k: F.concat(k, F.lit(":"), f("id_signature")[k]))
    model = tt.compact_code(f("id_model"))
    tag = lambda name, *c: F.concat(F.lit(name), *c)
    shown = lambda names: [x for c in names for x in (F.lit("|"), f("id_specs")[c])]
    models = F.array(
        F.when(F.length(model) >= 10, tag("model:", F.substring(model, 1, 10))),
        # a last i says nothing of short models
        F.when((F.length(model) > 0) & (F.length(model) <= 11), tag("model=", F.regexp_replace(model, "i+$", ""))),
        F.when(F.contains(model, F.lit("playstation5")) | model.startswith("ps5"), F.lit("model=ps5")),
    )
    displays = F.array(*(tag("display:" + "+".join(names), *shown(names)) for names in _chosen_of(SPECS, 3)), *(F.when(f("id_gtin").isNotNull(), tag("coded display:" + "+".join(names), *shown(names))) for names in _chosen_of(SPECS, 2)))
    branded = F.array_compact(F.concat(of_kind, models, displays))
    branded = F.flatten(F.transform(F.coalesce(roots, F.array().cast("array<string>")), lambda r: F.transform(branded, lambda k: F.concat(k, F.lit("|"), r))))
    cpu = F.when(f("id_category") == "cpu", tag("cpu:", f("id_signature")["processor"]))
    alone = F.array_compact(F.array(tag("gtin:", f("id_gtin")), tag("code:", F.lower("id_code")), cpu, tag("display:", *shown(SPECS))))
    many = F.concat(F.transform("id_parts", lambda p: tag("part:", p)), F.transform("id_numbers", lambda p: tag("number:", p)))
    alone = F.transform(F.concat(alone, many), lambda k: F.concat(F.lit("!"), k))
    return F.array_sort(F.array_distinct(F.concat(alone, branded)))


def block(left: DataFrame, right: DataFrame, keys: str = "keys") -> DataFrame:
    """Pairs of rows that share a key, each once, as structs a and b.

    Both sides have an id and are read twice, so they are best settled; `keys` is a sorted array of each. A pair is taken at the first key that both have, so
    nothing is put together again afterwards. Keys of more than TILE_ROWS left rows are dealt to
    parts, which every right row of the key visits: no pair is lost, and no task holds them all.
    """
    # the outer form, as the inner one's filter on the keys would be pushed down with all that they are made of
    both = lambda d, side: d.select(F.struct("*").alias(side), F.explode_outer(keys).alias("key"))
    a, b = both(left, "a"), both(right, "b")
    parts = a.groupBy("key").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts
    a = a.join(parts, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a.id"), F.col("parts")).cast("int"))).drop("parts")
    b = b.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    first = F.get(F.array_intersect(F.col(f"a.{keys}"), F.col(f"b.{keys}")), 0) == F.col("key")
    return a.join(b, ["key", "part"]).where(first).select("a", "b")


def brands_fit(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or one unknown."""
    return F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(True))


def critical_conflict(a: Column, b: Column) -> Column:
    """The first thing that both say and that differs, or null; a and b are identities."""
    kinds = F.array(*map(F.lit, tt.SIGNATURES))
    other = F.get(F.filter(kinds, lambda k: a["id_signature"][k] != b["id_signature"][k]), 0)
    either = lambda name: (a["id_category"] == name) | (b["id_category"] == name)
    cpu = (a["id_signature"]["processor"].isNotNull() | b["id_signature"]["processor"].isNotNull()) & either("cpu")
    parts = either("psu") & (F.size(a["id_parts"]) > 0) & (F.size(b["id_parts"]) > 0) & ~F.arrays_overlap(a["id_parts"], b["id_parts"])
    return F.coalesce(other, tt.chosen([(cpu & (a["id_socket"] != b["id_socket"]), "socket"), (parts, "psu_part_number")]))


#: What behind a model's name makes another product, what says nothing, and makers' names for one line.
OTHER_PRODUCT = ("ti", "super", "oc", "pro", "plus", "max", "ultra")
SAME_PRODUCT = ("", "digital", "disc", "bluray", "slim", "ps5", "i", "air")
LINES = (("amd", "ryzen|amd"), ("intel", "intel|^corei"), ("ps5", "playstation5|^ps5"))
#: Letters that a model must have before what follows is looked at as its suffix.
WHOLE_MODEL = 10


def models_compatible(a: Column, b: Column) -> Column:
    """Whether two models are of one product line.

    What identifies a kind by itself says so alone: a part number of both, else the series, chip, phone or board
    where both state it. Else their codes are compared as a stem, of at least ten letters, and a rest: equal
    codes, or a rest that says nothing. A rest that is a number or of OTHER_PRODUCT is another product,
    and so are codes of two makers or two processors.
    """
    x, y = tt.compact_code(a["id_model"]), tt.compact_code(b["id_model"])
    stem, code = F.array_min(F.array(*(F.struct(F.length(c).alias("n"), c.alias("c")) for c in (x, y))))["c"], F.when(F.length(x) > F.length(y), x).otherwise(y)
    rest = F.when(code.startswith(stem), code.substr(F.length(stem) + 1, F.length(code)))
    line = lambda c, *names: tt.chosen([(c.rlike(p), n) for n, p in LINES if n in names])
    apart = F.coalesce(line(a["id_model"], "amd", "intel") != line(b["id_model"], "amd", "intel"), F.lit(False)) | F.coalesce(a["id_signature"]["processor"] != b["id_signature"]["processor"], F.lit(False))
    equal = (x == y) | (rest == "i") | (line(x, "ps5") == line(y, "ps5"))
    by_suffix = (F.length(stem) >= WHOLE_MODEL) & rest.isin(*SAME_PRODUCT) & ~rest.isin(*OTHER_PRODUCT)
    by_code = F.coalesce(~apart & (F.coalesce(equal, F.lit(False)) | by_suffix), F.lit(False))
    kinds = [a["id_signature"][k] == b["id_signature"][k] for k in ("ssd", "gpu", "phone", "motherboard")]
    return F.coalesce(F.when(F.coalesce(F.arrays_overlap(a["id_parts"], b["id_parts"]), F.lit(False)), True), *kinds, by_code)


def _far_apart(a: Column, b: Column) -> Column:
    return price_extreme(a["price"], b["price"], F.coalesce(a["currency"] == b["currency"], F.lit(True)))


#: Reasons of the rules that come before the one of the same listing.
BEFORE_SAME = ("monitor_model_code_conflict", "variant_mismatch", "critical_conflict", "accessory_reject", "bundle_reject", "form_factor_reject", "condition_reject", "carrier_lock_reject", "monitor_model_code_brand_conflict", "monitor_model_code_exact")


def decide(pairs: DataFrame, extreme: Column | None = None) -> DataFrame:
    """Pairs of identities (structs a, the reference, and b, the candidate) with decision, confidence decimal(5,4)
    and reason: what the rules ask for is told first, then the first rule that holds, in order, decides.
    `extreme` says that prices are far apart; else that is read from price and currency."""
    a, b = F.col("a"), F.col("b")
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    overlap = lambda f: F.coalesce(F.arrays_overlap(a[f], b[f]), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = lambda name: yes((a["id_category"] == name) & (b["id_category"] == name))
    agree = lambda k: yes(a["id_signature"][k] == b["id_signature"][k])
    shared = F.filter(F.map_keys(a["id_variants"]), lambda k: F.map_contains_key(b["id_variants"], k))
    variants = F.transform(shared, lambda k: F.struct(k.alias("k"), a["id_variants"][k].alias("x"), b["id_variants"][k].alias("y")))
    told = pairs.withColumn("_variants", F.transform(variants, lambda v: F.when(tt.canonical_equal(v["k"], v["x"], v["y"]), 0).when(tt.canonical_uncertain(v["k"], v["x"], v["y"]), 1).otherwise(2)))
    told = told.withColumns(
        {
            "_fits": brands_fit(a["id_brand"], b["id_brand"]),
            "_exact": yes(F.lower(a["id_code"]) == F.lower(b["id_code"])),
            "_critical": critical_conflict(a, b).isNotNull(),
            "_extreme": _far_apart(a, b) if extreme is None else extreme,
            "_cpu": kind("cpu") & agree("processor"),
            "_cooler": kind("cooler") & agree("cooler_model"),
            "_compatible": yes(models_compatible(a, b)),
            "_ratio": token_ratio(a["id_words"], b["id_words"]),
            "_specs": F.when(kind("monitor"), F.size(F.filter(F.array(*map(F.lit, SPECS)), lambda k: a["id_specs"][k] == b["id_specs"][k]))).otherwise(0),
        }
    )
    fits, exact, extreme, cpu, ratio, specs = (F.col(c) for c in ("_fits", "_exact", "_extreme", "_cpu", "_ratio", "_specs"))
    # sparse titles beside advertising ones are no doubt where the family's own marks agree
    exempt = cpu | F.col("_cooler") | kind("console") | (kind("gpu") & agree("gpu")) | (kind("motherboard") & agree("motherboard"))
    soft = both("id_brand") & fits & (F.col("_cooler") | F.col("_compatible")) & (a["id_model"].eqNullSafe(b["id_model"]) | (ratio >= SOFT_TITLE) | exempt)
    base = F.when(both("id_brand"), BRAND_WEIGHT).otherwise(0.0) + SPEC_WEIGHT * specs
    weak = base + F.bround(TITLE_WEIGHT * F.bround(ratio, 4), 4)
    weak = F.when(~both("id_gtin") & (specs < 3), F.least(weak, F.lit(TITLE_CAP))).otherwise(weak)
    told = told.withColumns({"_soft": yes(soft), "_strong": F.greatest(F.lit(AUTO), base + MODEL_WEIGHT), "_weak": weak})
    weak = F.least(F.when(extreme & (F.col("_weak") >= AUTO), REVIEW).otherwise(F.col("_weak")), F.lit(1.0))
    weak = F.bround(weak.cast("decimal(12,8)"), 4)
    # without a strong identifier nothing is certain
    told = told.withColumn("_score", F.when(weak >= AUTO, F.least(weak, F.lit(0.89).cast("decimal(5,4)"))).otherwise(weak))
    soft, strong, score = F.col("_soft"), F.col("_strong"), F.col("_score")
    differs, uncertain = F.array_contains("_variants", 2), F.array_contains("_variants", 1)
    old = b["id_condition"].isin("used", "open_box") & a["id_condition"].isin("new", "unknown")
    carrier = a["id_lock"].isNull() & (b["id_lock"] == "locked")
    same_gtin = both("id_gtin") & (a["id_gtin"] == b["id_gtin"])
    reject = lambda reason: ("reject", F.lit(0.0), reason)
    rules = [
        (both("id_code") & ~exact, *reject("monitor_model_code_conflict")),
        (~exact & differs, *reject("variant_mismatch")),
        (~exact & F.col("_critical"), *reject("critical_conflict")),
        (b["id_accessory"] & ~a["id_accessory"], *reject("accessory_reject")),
        (b["id_bundle"] & ~a["id_bundle"], *reject("bundle_reject")),
        ((a["id_card"] & b["id_system"]) | (a["id_system"] & b["id_card"]), *reject("form_factor_reject")),
        (old, *reject("condition_reject")),
        ((a["id_lock"] == "unlocked") & (b["id_lock"] == "locked"), *reject("carrier_lock_reject")),
        (exact & ~fits, "review", F.lit(0.85), "monitor_model_code_brand_conflict"),
        (exact, "auto_match", F.lit(0.99), "monitor_model_code_exact"),
        ((a["store"] == b["store"]) & (a["product_id"] == b["product_id"]), "auto_match", F.lit(1.0), "same_store_product_id"),
        (same_gtin & ~fits, "review", F.lit(0.85), "gtin_brand_conflict"),
        (same_gtin & carrier, "review", F.lit(0.88), "carrier_variant_uncertain"),
        (same_gtin, "auto_match", F.lit(0.99), "gtin_exact"),
        (overlap("id_parts") & ~fits, "review", F.lit(0.85), "mpn_brand_conflict"),
        (overlap("id_parts"), "auto_match", F.lit(0.98), "mpn_exact"),
        (overlap("id_numbers") & uncertain, "review", F.lit(0.85), "variant_semantic_uncertain"),
        (overlap("id_numbers") & ~fits, "review", F.lit(0.85), "model_number_brand_conflict"),
        (overlap("id_numbers"), "auto_match", F.lit(0.98), "model_number_exact"),
        (cpu & ~fits, "review", F.lit(0.85), "processor_brand_conflict"),
        (cpu, "auto_match", F.lit(0.98), "processor_model_exact"),
        (~fits, *reject("brand_mismatch")),
        (soft & uncertain, "review", F.least(strong, F.lit(0.89)), "variant_semantic_uncertain"),
        (soft & extreme, "review", F.lit(0.88), "price_deviation"),
        (soft & carrier, "review", F.lit(0.88), "carrier_variant_uncertain"),
        (soft, "auto_match", F.least(strong, F.lit(0.97)), "brand_model_exact"),
        (uncertain & (score < REVIEW), "review", F.lit(REVIEW), "variant_semantic_uncertain"),
        (score >= REVIEW, "review", score, "score"),
    ]
    result = lambda d, c, r: F.struct(F.lit(d).alias("decision"), c.cast("decimal(5,4)").alias("confidence"), F.lit(r).alias("reason"))
    out = result("reject", score, "score")
    for when, decision, confidence, reason in reversed(rules):
        out = F.when(yes(when), result(decision, confidence, reason)).otherwise(out)
    told = told.withColumn("_s", out)
    return told.select(*pairs.columns, "_s.decision", "_s.confidence", "_s.reason")


@dataclass
class Matches:
    """Listings of both sides with their class (listing: id, store, product_id, price, currency, gtin), and the
    pairs of classes: a and b, whether they share a key, and what is decided where prices are near (near) and
    far apart (far)."""

    left: DataFrame
    right: DataFrame
    pairs: DataFrame


def _listings(d: DataFrame) -> DataFrame:
    """Listings with their class: a digest of all that the rules compare but for price and listing."""
    known = identity(d, "title", "brand", "gtin")
    plain = [F.array_sort(F.map_entries(c)) if dict(known.dtypes)[c].startswith("map") else F.col(c) for c in IDENTITY]
    named = F.struct(*(c.alias(name) for c, name in zip(plain, IDENTITY, strict=True)))
    return settled(known.select("id", "price", "currency", "store", "product_id", *IDENTITY, F.md5(F.to_json(named)).alias("class")))


def _classes(listings: DataFrame) -> DataFrame:
    """One row of each class: id (the class), n listings, and the identity."""
    one = listings.groupBy(F.col("class").alias("id")).agg(F.count("*").alias("n"), F.first(F.struct(*IDENTITY)).alias("f"))
    return one.select("id", "n", "f.*")


def match_classes(references: DataFrame, candidates: DataFrame) -> Matches:
    """Matches of all listings, said of classes of equal identities: ten thousand listings of one title are one row
    a side. Both sides: id, title, brand, gtin, price, currency, store, product_id. Titles are read once a listing, keys and
    rules once a class. Pairs are those of classes that share a blocking key, or listings of one store's product."""
    left = _listings(references)
    right = left if candidates is references else _listings(candidates)
    one = _classes(left)
    two = one if right is left else _classes(right)
    roots = settled(brand_roots(one.unionByName(two).select(F.col("id_brand").alias("brand"))))

    def keyed(d: DataFrame) -> DataFrame:
        d = d.join(roots.withColumnRenamed("brand", "id_brand"), "id_brand", "left")
        return settled(d.withColumn("keys", blocking_keys(F.col("roots"))).drop("roots"))

    a = keyed(one)
    b = a if two is one else keyed(two)
    # two brands may share a root that is neither
    fits = F.coalesce((F.col("a.id_brand") == F.col("b.id_brand")) | brands_fit(F.col("a.id_brand"), F.col("b.id_brand")), F.lit(True))
    coded = F.get(F.array_intersect("a.keys", "b.keys"), 0).startswith("!")
    pairs = block(a, b).where(coded | fits).withColumn("blocked", F.lit(True))
    own = lambda d, c: d.where("store IS NOT NULL AND product_id IS NOT NULL").select("store", "product_id", F.col("class").alias(c)).distinct()
    same = own(left, "a_class").join(own(right, "b_class"), ["store", "product_id"]).select("a_class", "b_class").distinct()
    met = pairs.select(F.col("a.id").alias("a_class"), F.col("b.id").alias("b_class"))
    alone = same.join(met, ["a_class", "b_class"], "left_anti")
    whole = lambda d, name: d.select(F.col("id").alias(f"{name}_class"), F.struct("*").alias(name))
    alone = alone.join(whole(a, "a"), "a_class").join(whole(b, "b"), "b_class").select("a", "b", F.lit(False).alias("blocked"))
    none = F.lit(None).cast("string")
    both = pairs.unionByName(alone).withColumns({c: F.col(c).withField("store", none).withField("product_id", none) for c in ("a", "b")})
    told = decide(both.withColumn("far", F.explode(F.array(F.lit(False), F.lit(True)))), F.col("far"))
    said = F.struct("decision", "confidence", "reason")
    told = told.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "blocked").agg(F.max(F.when(~F.col("far"), said)).alias("near"), F.max(F.when(F.col("far"), said)).alias("far"))
    members = lambda d: d.select("class", F.struct("id", "store", "product_id", "price", "currency", F.col("id_gtin").alias("gtin")).alias("listing"))
    return Matches(members(left), members(right), told)


def match(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored candidate pairs (l, r, store, gtin, decision, confidence, reason) of listings: the classes' pairs, each
    spelt out. Where most listings are equal, `match_classes` says the same in fewer rows."""
    found = match_classes(references, candidates)
    side = lambda d, of, name: d.select(F.col("class").alias(of), F.col("listing").alias(name))
    pairs = found.pairs.join(side(found.left, "a", "x"), "a").join(side(found.right, "b", "y"), "b")
    x, y = F.col("x"), F.col("y")
    same = F.coalesce((x["store"] == y["store"]) & (x["product_id"] == y["product_id"]), F.lit(False))
    said = F.when(_far_apart(x, y), F.col("far")).otherwise(F.col("near"))
    sure = F.struct(F.lit("auto_match").alias("decision"), F.lit(1).cast("decimal(5,4)").alias("confidence"), F.lit("same_store_product_id").alias("reason"))
    told = F.when(same & ~said["reason"].isin(*BEFORE_SAME), sure).otherwise(said)
    pairs = pairs.where(F.col("blocked") | same)
    return pairs.select(F.col("x.id").alias("l"), F.col("y.id").alias("r"), F.col("y.store").alias("store"), F.col("y.gtin").alias("gtin"), told.alias("t")).select("l", "r", "store", "gtin", "t.*")


def prefilter(a: Column, b: Column) -> Column:
    """Why a candidate with no more than a title needn't be looked at, or null; without a title it must be."""
    title = F.size(b["id_words"]) > 0
    old = b["id_condition"].isin("used", "open_box") & a["id_condition"].isin("new", "unknown")
    form = (a["id_card"] & b["id_system"]) | (a["id_system"] & b["id_card"])
    reasons = [(b["id_accessory"] & ~a["id_accessory"], "accessory_reject"), (b["id_bundle"] & ~a["id_bundle"], "bundle_reject"), (old, "condition_mismatch"), (form, "form_factor_mismatch")]
    return F.when(title, F.coalesce(tt.chosen(reasons), critical_conflict(a, b), tt.chosen([(~brands_fit(a["id_brand"], b["id_brand"]), "brand_mismatch")])))


def relevance(query: Column, title: Column, path: Column) -> Column:
    """How well a found listing fits a query, as a struct that sorts descending: the whole query as one code,
    words of a variant, words, and the title's length up to 200."""
    words = lambda c: F.array_distinct(F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: w != ""))
    compact = lambda c: F.regexp_replace(fold(c), "[^a-z0-9]+", "")
    asked = F.filter(words(query), lambda w: F.length(w) >= 2)
    held = F.array_union(words(F.coalesce(title, F.lit(""))), words(F.coalesce(path, F.lit(""))))
    variants = F.filter(asked, lambda w: w.isin(*(x for x in (*tt.COLOR_OF, *tt.HUES) if " " not in x)) | w.rlike(r"^\d+(gb|tb)$"))
    q = compact(query)
    exact = (F.length(q) >= 8) & (F.contains(compact(F.coalesce(title, F.lit(""))), q) | F.contains(compact(F.coalesce(path, F.lit(""))), q))
    return F.struct(exact.cast("int").alias("exact"), F.size(F.array_intersect(variants, held)).alias("variant_hits"), F.size(F.array_intersect(asked, held)).alias("hits"), F.least(F.length(fold(F.coalesce(title, F.lit("")))), F.lit(200)).alias("length"))


def alignment(color: Column, storage: Column, title: Column) -> Column:
    """How often a title names the wanted colour, by any of its names, or storage: as words and inside the text."""
    hue = tt.canonical_color(fold(color))
    names = F.create_map(*(x for h, labels in tt.COLORS for x in (F.lit(h), F.array(*map(F.lit, labels)))))
    size = F.regexp_replace(fold(storage), r"\s+", "")
    wanted = F.array_distinct(F.filter(F.concat(F.array_compact(F.array(fold(color), size, fold(storage))), F.coalesce(F.split(hue, " "), F.array().cast("array<string>")), F.coalesce(F.element_at(names, hue), F.array().cast("array<string>"))), lambda w: F.length(w) >= 2))
    words = F.filter(F.split(fold(title), "[^a-z0-9]+"), lambda w: w != "")
    flat = F.regexp_replace(fold(title), "[^a-z0-9]+", "")
    return F.size(F.array_intersect(wanted, words)) + F.size(F.filter(wanted, lambda w: F.contains(flat, w)))


def ranked(df: DataFrame, group: str, score: Column, order: str) -> DataFrame:
    """Position, from 1, of each row of a group by score, best first; equal ones stay in their order."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), order)))


def choose_reference(listings: DataFrame, priority: DataFrame, default: int = 40) -> DataFrame:
    """The listing by which each product is looked up: made-up listings never, active ones before others, then by
    the store's priority and an address that lasts. Takes product, store, url, canonical_url, product_id, status, ord."""
    made_up = (F.lower("store") == "synthetic") & (F.lower("url").like("%://identity/%") | F.lower("product_id").like("identity:%"))
    d = listings.where(~F.coalesce(made_up, F.lit(False))).join(F.broadcast(priority.select(F.col("store").alias("_store"), "priority")), F.lower("store") == F.col("_store"), "left").drop("_store")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    score = F.coalesce("priority", F.lit(default)) + F.when(~blank("canonical_url"), 3).when(~blank("url"), 2).otherwise(0)
    active = F.lower("status") == "active"
    any_active = F.max(active.cast("int")).over(Window.partitionBy("product")) == 1
    d = d.withColumn("_pool", ~any_active | active).where("_pool").where(~(blank("canonical_url") & blank("url")))
    order = Window.partitionBy("product").orderBy(score.desc(), "ord")
    return d.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("product", "store", F.when(~blank("canonical_url"), F.trim("canonical_url")).otherwise(F.trim("url")).alias("url"))


def store_waves(stores: DataFrame, best_locale: int = 10, rich: int = 55) -> DataFrame:
    """Each store's wave and place: stores of the dominant locale with product codes (1), the others of that
    locale (2), all else (3). Takes key, store, locale_rank, code_rank; a key's dominant locale is the
    preferred one if it has a store of it, else the most frequent, the first met of equal ones (ord)."""
    counts = stores.groupBy("key", "locale_rank").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    usual = counts.groupBy("key").agg(F.max_by("locale_rank", F.struct(F.when(F.col("locale_rank") == best_locale, 1).otherwise(0).alias("best"), "n", (-F.col("first")).alias("f"))).alias("dominant"))
    d = stores.join(usual, "key")
    own, codes = F.col("locale_rank") == F.col("dominant"), F.col("code_rank") <= rich
    d = d.withColumn("wave", F.when(own & codes, 1).when(own, 2).otherwise(3))
    place = Window.partitionBy("key", "wave").orderBy("locale_rank", (~codes).cast("int"), "code_rank", "store")
    return d.select("key", "store", "wave", F.row_number().over(place).alias("place"))


def eligible(stores: DataFrame, adapters: tuple[str, ...]) -> DataFrame:
    """Stores that are built, switched on and have an adapter."""
    return stores.where(F.col("implemented") & F.col("match_enabled") & F.col("store").isin(*adapters))


def embedding_evidence(similarity: Column, place: Column, elapsed_ms: Column, text: Column, limit: int = 8, deadline_ms: int = 3000) -> Column:
    """Status and similarity, to six places, of a candidate's vector: skipped beyond the limit, after the deadline or
    without text, an error without a similarity."""
    status = F.when(place > limit, "skipped_limit").when(elapsed_ms > deadline_ms, "skipped_deadline").when(F.coalesce(F.trim(text), F.lit("")) == "", "skipped_empty").when(similarity.isNull(), "error").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", F.round(similarity, 6)).alias("similarity"))


def best_per_store(scored: DataFrame) -> DataFrame:
    """Of each reference and store the best candidate up to the first certain one."""
    d = scored.withColumn("g", F.concat_ws("|", "l", "store"))
    return early_best(d, "g", "r", "confidence", F.col("decision") == "auto_match").drop("g")


def learned_gtin(best: DataFrame) -> DataFrame:
    """A reference's GTIN, if its certain matches agree on one."""
    sure = best.where((F.col("decision") == "auto_match") & F.col("gtin").isNotNull())
    return sure.groupBy("l").agg(F.collect_set("gtin").alias("g")).where(F.size("g") == 1).select("l", F.col("g")[0].alias("gtin"))


def evidence_gate(decision: Column, confidence: Column, uncertain: Column, similarity: Column, price_off: Column, threshold: float = 0.8) -> Column:
    """A review that only an unclear variant keeps open becomes a match if the vectors are near."""
    opens = (decision == "review") & uncertain & ~price_off & (similarity >= threshold)
    return F.when(F.coalesce(opens, F.lit(False)), F.struct(F.lit("auto_match").alias("decision"), F.greatest(confidence, F.lit(0.9)).cast("decimal(5,4)").alias("confidence"))).otherwise(F.struct(decision.alias("decision"), confidence.cast("decimal(5,4)").alias("confidence")))


@dataclass
class Learned:
    """Listings with the GTIN that they have or learned (id, gtin, source, round: 0 is their own), and how many rounds it took."""

    gtins: DataFrame
    rounds: int


def learn_gtins(listings: DataFrame, pairs: DataFrame) -> Learned:
    """GTINs that listings learn from certain matches, in rounds to a fixpoint.

    `listings` have id, gtin and brand; `pairs` are matches among them (l, r, decision), as `match` gives.
    A listing without a valid GTIN learns one when the certain matches that have one by the last round, and
    whose brand fits, agree; where they don't, it learns none, in this round or later. Only listings
    that the last round's news reach are looked at again, so the work of a round is what it changes.
    """
    own = settled(listings.select("id", normalize_gtin(F.col("gtin")).alias("gtin"), normalize_brand(F.col("brand")).alias("brand")))
    sure = pairs.where("decision = 'auto_match' AND l <> r").select(F.col("l").alias("id"), F.col("r").alias("by")).distinct()
    brands = own.select(F.col("id").alias("by"), F.col("brand").alias("by_brand"))
    wanting = own.where("gtin IS NULL").select("id", "brand")
    heard = settled(sure.join(wanting, "id").join(brands, "by").where(brands_fit(F.col("brand"), F.col("by_brand"))).select("id", "by"))
    news = settled(own.where("gtin IS NOT NULL").select("id", "gtin", F.lit("own").alias("source"), F.lit(0).alias("round")))
    known, closed, rounds = [news], None, 0
    while True:
        told = heard.join(news.select(F.col("id").alias("by"), "gtin"), "by")
        said = told.groupBy("id").agg(F.min("gtin").alias("gtin"), F.max("gtin").alias("other"), F.min("by").alias("first"))
        if closed is not None:
            said = said.join(closed, "id", "left_anti")
        said = settled(said)
        if said.isEmpty():
            break
        rounds += 1
        closed = settled(said.select("id") if closed is None else closed.unionByName(said.select("id")))
        news = said.where("gtin = other").select("id", "gtin", F.concat(F.lit("auto_match:"), F.col("first").cast("string")).alias("source"), F.lit(rounds).alias("round"))
        known.append(news)
    return Learned(functools.reduce(DataFrame.unionByName, known), rounds)


def rematch(listings: DataFrame, pairs: DataFrame, learned: Learned) -> DataFrame:
    """The pairs after learning: references that learned a GTIN are matched again, with all that was learned; the
    others' pairs stay. The result has the columns of `match`."""
    changed = learned.gtins.where("round > 0")
    fresh = listings.drop("gtin").join(learned.gtins.select("id", "gtin"), "id", "left")
    again = match(fresh.join(changed.select("id"), "id", "left_semi"), fresh)
    return pairs.join(changed.select(F.col("id").alias("l")), "l", "left_anti").select(*again.columns).unionByName(again)
