"""The engine's queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vx
from ..operators import cdc, fx, matching, tables
from ..sources import pages as pg
from .registry import ORACLE_SQL, QUERIES, query, seconds_exact, t  # noqa: F401


def seconds(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as offer observations of a listing (part and supplier)."""
    li = t(spark, sf_dir, "lineitem")
    cols = [F.concat_ws("-", "l_partkey", "l_suppkey").alias("listing_id"), F.col("l_shipdate").cast("date").alias("seen_on"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id")]
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    availability = F.when(F.col("l_linestatus") == "O", "available").otherwise("out_of_stock")
    fp = tx.offer_fingerprint(price, F.lit("USD"), F.col("l_returnflag"), availability, F.lit(None).cast("decimal(18,4)"))
    return li.select(*cols, price.alias("price"), F.col("l_returnflag").alias("seller"), availability.alias("availability"), fp.alias("fingerprint"))


OBS = """SELECT l_partkey || '-' || l_suppkey AS listing_id, CAST(l_shipdate AS DATE) AS seen_on, l_orderkey*10+l_linenumber AS obs_id,
 CAST(l_extendedprice AS DECIMAL(18,4)) AS price, l_returnflag AS seller, CASE WHEN l_linestatus='O' THEN 'available' ELSE 'out_of_stock' END AS availability FROM lineitem"""


@query(f"""WITH o AS ({OBS}), p AS (SELECT *, lag(price) OVER w pp, lag(seller) OVER w ps, lag(availability) OVER w pa, row_number() OVER w rn FROM o WINDOW w AS (PARTITION BY listing_id ORDER BY seen_on, obs_id))
SELECT listing_id, obs_id, CASE WHEN rn=1 THEN 'new_offer' WHEN price=pp AND seller=ps AND availability=pa THEN 'unchanged' ELSE
 array_to_string(list_filter([CASE WHEN price<>pp THEN 'price_changed' END, CASE WHEN seller<>ps THEN 'seller_changed' END, CASE WHEN availability<>pa THEN 'availability_changed' END, CASE WHEN availability<>pa AND availability='out_of_stock' THEN 'out_of_stock' END], lambda x: x IS NOT NULL), ',') END AS events FROM p""")
def offer_change_events(spark, sf_dir):
    d = cdc.change_events(observations(spark, sf_dir), ["listing_id"], ["seen_on", "obs_id"])
    return d.select("listing_id", "obs_id", F.array_join("events", ",").alias("events"))


@query(f"""WITH o AS ({OBS}) SELECT listing_id, obs_id, price, CAST(seen_on AS VARCHAR) AS seen_on FROM o QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY seen_on DESC, obs_id DESC)=1""")
def latest_snapshot(spark, sf_dir):
    return cdc.latest(observations(spark, sf_dir), ["listing_id"], ["seen_on", "obs_id"]).select("listing_id", "obs_id", "price", F.col("seen_on").cast("string").alias("seen_on"))


@query("""SELECT e.event_id, (SELECT v.event_id FROM events v WHERE v.user_id=e.user_id AND v.event_type='view' AND v.ts<=e.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id FROM events e WHERE e.event_type='purchase'""")
def as_of_snapshot(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("event_id").alias("tie"))
    return cdc.as_of(left, right, ["user_id"], "ts", "view_id", "tie").select("event_id", F.col("as_of").alias("view_id"))


@query("""WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) THEN 0 ELSE 1 END f FROM events),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts,event_id) g FROM a) SELECT event_id, row_number() OVER (PARTITION BY user_id,g ORDER BY ts,event_id) AS run FROM b""")
def consecutive_runs(spark, sf_dir):
    d = cdc.run_lengths(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return d.select("event_id", F.col("run").cast("long").alias("run"))


@query("""WITH u AS ((SELECT o_orderkey AS id, 'order' AS kind, o_orderdate AS ts FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') UNION ALL (SELECT l_orderkey*10+l_linenumber, 'line', l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'))
SELECT id, kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM u WHERE (ts < TIMESTAMP '1998-06-01') ORDER BY ts DESC, id DESC LIMIT 51""")
def change_feed_page(spark, sf_dir):
    """Union of two branches, each cut to the page first, after a cursor."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    li = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("line").alias("kind"), F.col("l_shipdate").alias("at"))
    since = [d.where((F.col("at") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("at") < F.lit("1998-06-01").cast("timestamp_ntz"))) for d in (o, li)]
    return tables.union_page(since, "at", "id", 50).select("id", "kind", F.col("at").cast("date").cast("string").alias("day"))


@query("""SELECT event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id=e.user_id AND (p.ts=e.ts OR date_trunc('hour',p.ts)=date_trunc('hour',e.ts)) AND ((e.event_type='view' AND p.event_type IN ('click','purchase')) OR (e.event_type='click' AND p.event_type='purchase') OR (e.event_type=p.event_type AND p.event_id>e.event_id)))""")
def feed_suppression(spark, sf_dir):
    """Equal times lie in one hour, so the hour is a key beside the user and no user meets itself as a whole."""
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    outranks = F.expr("(e.event_type = 'view' and p.event_type in ('click', 'purchase')) or (e.event_type = 'click' and p.event_type = 'purchase') or (e.event_type = p.event_type and p.event_id > e.event_id)")
    return tables.suppress(e, ["user_id", "hour"], F.lit(True), outranks).select("event_id", "event_type")


@query("""SELECT event_id, CASE WHEN regexp_matches(props->>'$.k','^[0-9]+(\\.[0-9]+)?$') AND CAST(props->>'$.k' AS DECIMAL(18,4))>0 THEN CAST(props->>'$.k' AS DECIMAL(18,4)) END AS amount FROM events""")
def json_amounts(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", vx.json_amount(F.col("props"), "k").alias("amount"))


@query("""SELECT count(*) AS events, CAST(count(*) FILTER (event_type='error') AS BIGINT) AS failed, CAST(count(*) FILTER (value>50) AS BIGINT) AS large, CAST(count(*) FILTER (event_type IN ('purchase','signup') AND value<10) AS BIGINT) AS small_gains, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_at, CAST(floor(epoch(max(ts)))-floor(epoch(min(ts))) AS BIGINT) AS span_s FROM events""")
def monitor_diagnostics(spark, sf_dir):
    """All counters of the monitor in one pass."""
    return t(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("event_type").isin("purchase", "signup") & (F.col("value") < 10)).alias("small_gains"), F.min(seconds("ts")).alias("first_at"), (F.max(seconds("ts")) - F.min(seconds("ts"))).alias("span_s"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def duplicate_keys(spark, sf_dir):
    return tables.duplicate_keys(t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*)>=2 ORDER BY n DESC, user_id LIMIT 20")
def duplicate_work_top(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "user_id").limit(20)


@query("""WITH c AS (SELECT user_id, event_type, count(*) n, min(event_id) f FROM events GROUP BY ALL) SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f)=1""")
def dominant_value(spark, sf_dir):
    """The mode of each key; of equal ones the first seen."""
    c = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.col("f")).alias("f"))).alias("event_type"))


@query("""WITH x AS (SELECT l_suppkey, l_orderkey*10+l_linenumber AS ord, l_quantity, min(CASE WHEN l_quantity>=49 THEN l_orderkey*10+l_linenumber END) OVER (PARTITION BY l_suppkey) s FROM lineitem)
SELECT l_suppkey, ord, l_quantity FROM x WHERE s IS NULL OR ord<=s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, ord)=1""")
def best_per_store_early_stop(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_quantity")
    return cdc.early_best(d, "l_suppkey", "ord", "l_quantity", F.col("l_quantity") >= 49)


@query("SELECT l_partkey, l_suppkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_returnflag)=1")
def consensus_value(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.collect_set("l_returnflag").alias("s"))
    return g.where(F.size("s") == 1).select("l_partkey", "l_suppkey", F.col("s")[0].alias("flag"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(count(*) FILTER (o_orderstatus='F') AS BIGINT) AS done, CAST(count(*) FILTER (o_orderstatus='O') AS BIGINT) AS pending, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1""")
def run_rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.round(F.sum("o_totalprice")).cast("long").alias("total"))


@query("""WITH c AS (SELECT d.lang, d.source, count(*) FILTER (quality=1 AND toxic=0) tp, count(*) FILTER (quality<>1 AND toxic=0) fp, count(*) FILTER (quality=1 AND toxic<>0) fn, count(*) FILTER (quality<>1 AND toxic<>0) tn FROM labels l JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((),(lang),(source))),
r AS (SELECT *, tp/nullif(tp+fp,0) p, tp/nullif(tp+fn,0) r FROM c) SELECT lang, source, tp, fp, fn, tn, round(p,9) AS precision, round(r,9) AS recall, round(fp/nullif(fp+tn,0),9) AS fpr, round(CASE WHEN p+r=0 THEN 0 ELSE 2*p*r/nullif(p+r,0) END,9) AS f1 FROM r""")
def sliced_match_metrics(spark, sf_dir):
    d = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    c = d.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(*tables.confusion(F.col("quality") == 1, F.col("toxic") == 0))
    return tables.rates(c).select("lang", "source", "tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "fpr", "f1")))


@query("""SELECT event_type, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, max(value) AS top FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("top"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) rn, count(*) OVER (PARTITION BY event_type) n FROM events) SELECT event_type, max(CASE WHEN rn=1+CAST(floor(0.95*(n-1)) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY 1""")
def percentile_lower_index(spark, sf_dir):
    """The value at the lower index, by the counts of equal values: a group's rows are never in one task."""
    w = Window.partitionBy("event_type")
    c = t(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    d = c.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    place = 1 + F.floor(0.95 * (F.col("n") - 1))
    return d.where((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select("event_type", F.col("value").alias("p95"))


@query(f"""WITH o AS ({OBS}) SELECT listing_id, obs_id, sha256('{{"availability":"' || availability || '","currency":"USD","pix_price":null,"price":"' || CAST(price AS VARCHAR) || '","seller":"' || lower(seller) || '"}}') AS fingerprint FROM o""")
def offer_fingerprint(spark, sf_dir):
    return observations(spark, sf_dir).select("listing_id", "obs_id", "fingerprint")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)-1 AS position, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_main FROM lineitem")
def gallery_positions(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("position"), (F.first("l_linenumber").over(w) == F.col("l_linenumber")).alias("is_main"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) f FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f) AS place FROM f QUALIFY place<=3""")
def first_seen_capped(spark, sf_dir):
    """First occurrences in order, three a key."""
    f = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("f")).cast("long")).where("place <= 3").select("user_id", "event_type", "place")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderdate < TIMESTAMP '1998-01-01' ORDER BY rank, o_orderdate NULLS LAST, o_orderkey LIMIT 100""")
def due_queue(spark, sf_dir):
    """What is due, most urgent first: the rows that a worker would lease."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    d = t(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return d.select("o_orderkey", "o_orderdate", rank.alias("rank")).orderBy("rank", F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey", "rank")


TOKENS = """list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}),'[^a-z0-9\\s]+',' ','g'),'\\s+'), lambda x: x<>''))"""


@query(f"""WITH a AS (SELECT p_partkey, {TOKENS.format(c='p_name')} k FROM part) SELECT a.p_partkey, round(CASE WHEN len(a.k)>0 AND len(b.k)>0 THEN len(list_intersect(a.k,b.k))/greatest(len(a.k),len(b.k)) ELSE 0 END,9) AS ratio FROM a JOIN a b ON b.p_partkey=a.p_partkey+1""")
def title_token_ratio(spark, sf_dir):
    a = t(spark, sf_dir, "part").select("p_partkey", tx.title_tokens(F.col("p_name")).alias("k"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("k").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(tx.token_ratio(F.col("k"), F.col("other")), 9).alias("ratio"))


FOLDED = f"lower(translate(coalesce({{c}},''),'{tx.ACCENTED + tx.ACCENTED.upper()}','{tx.PLAIN + tx.PLAIN}'))"


@query(f"SELECT doc_id, md5({FOLDED.format(c='text')}) AS folded FROM documents")
def search_fold(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.search_fold(F.coalesce("text", F.lit(""))).cast("binary")).alias("folded"))


@query(f"SELECT doc_id, lang FROM documents WHERE contains({FOLDED.format(c='text')}, 'reation') AND (contains({FOLDED.format(c='text')}, 'the') OR contains(lower(source), 'the'))")
def accent_search(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.where(tx.matches_all(tx.search_terms("Réation the"), [F.col("text"), F.col("source")]) & F.contains(tx.search_fold(F.col("text")), F.lit("reation"))).select("doc_id", "lang")


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1""")
def change_window(spark, sf_dir):
    """Events of a validated half-open window whose ends are given in two zones."""
    start, end = datetime.fromisoformat("2024-01-05T00:00:00-03:00"), datetime.fromisoformat("2024-01-20T00:00:00+00:00")
    e = t(spark, sf_dir, "events")
    return e.where(tx.within(F.col("ts").cast("timestamp"), start, end)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT p_partkey, nullif(trim(regexp_replace(lower(p_brand),'[^a-z0-9]+',' ','g')),'') AS brand, nullif(regexp_replace(lower(p_type),'[^a-z0-9]+','','g'),'') AS model FROM part""")
def normalized_names(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", tx.normalize_brand(F.col("p_brand")).alias("brand"), tx.normalize_code(F.col("p_type")).alias("model"))


@query("""WITH s AS (SELECT page_id, regexp_replace(trim(url),'#.*$','') u FROM pages), h AS (SELECT page_id, regexp_extract(u,'^([^?]*)',1) head, regexp_extract(u,'\\?(.*)$',1) q FROM s),
p AS (SELECT page_id, lower(regexp_extract(head,'^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)',1)) o, regexp_replace(regexp_replace(head,'^[A-Za-z][A-Za-z0-9+.-]*://[^/]*',''),'/+$','') path, array_to_string(list_filter(string_split(q,'&'), lambda x: regexp_matches(x,'^[^=]*=.+') AND NOT regexp_matches(lower(x),'^(utm_[a-z]+|fbclid|gclid|ref|source|from|spm|af|dp)=') AND NOT regexp_matches(lower(x),'^(matt_|cq_|gad_)')),'&') k FROM h)
SELECT page_id, o || CASE WHEN path='' THEN '/' ELSE path END || CASE WHEN k<>'' THEN '?'||k ELSE '' END AS url FROM p""")
def canonical_urls(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html,'(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>',1),'<[^>]*>',' ','g'),'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&amp;','&'),'\\s+',' ','g')),'') AS h1 FROM pages""")
def page_headings(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", pg.element(F.col("html"), "h1").alias("h1"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 5 AS kind, lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), CASE (l_orderkey + l_linenumber) % 5 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 13 ELSE 12 END, '0') AS s FROM lineitem),
c AS (SELECT *, s || CAST((10 - list_sum([CAST(substr(s, i, 1) AS INT) * (CASE WHEN (length(s) - i) % 2 = 0 THEN 3 ELSE 1 END) FOR i IN range(1, length(s) + 1)]) % 10) % 10 AS VARCHAR) AS code FROM b)
SELECT l_orderkey, l_linenumber, CASE kind WHEN 4 THEN NULL WHEN 2 THEN '0' || code ELSE code END AS gtin FROM c""")
def gtin_normalisation(spark, sf_dir):
    """Codes of 8, 12, 13 and 14 digits, written with blanks and hyphens, and codes whose last digit is wrong."""
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    made = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), F.call_function("lpad", number.cast("string"), F.when(kind == 1, 7).when(kind == 2, 11).when(kind == 3, 13).otherwise(12), F.lit("0")).alias("body"))
    check = vx.gtin_check_digit(F.col("body"))
    raw = F.concat(F.lit(" "), F.substring("body", 1, 3), F.lit("-"), F.substring("body", 4, 20), ((check + F.when(F.col("kind") == 4, 1).otherwise(0)) % 10).cast("string"))
    return made.select("l_orderkey", "l_linenumber", vx.normalize_gtin(raw).alias("gtin"))


@query("""SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS brl, CAST(round(p_retailprice) AS DECIMAL(18,4)) AS usd FROM part""")
def money_parsing(spark, sf_dir):
    """Amounts written the Brazilian way and with a lone decimal comma, parsed back."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole = (cents - cents % 100) / 100
    brl = F.concat(F.lit("R$ "), F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    usd = F.concat(F.lit("US$ "), F.round("p_retailprice").cast("long").cast("string"), F.lit(",00"))
    return t(spark, sf_dir, "part").select("p_partkey", vx.parse_money(brl, F.lit("BRL")).alias("brl"), vx.parse_money(usd, F.lit("USD")).alias("usd"))


RATES = [("USD", "BRL", "ptax_sell", "5.1", "bcb", "fresh"), ("USD", "BRL", "tourism_sell", "5.303400000000", "valor", "stale"), ("PYG", "BRL", "market", "0.00071", "bcp", "fresh"), ("PYG", "BRL", "ptax_buy", "0.0007", "bcb", "fresh"), ("USD", "PYG", "official", "7300", "bcp", "fresh")]


def rates(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame(RATES, "base string, quote string, rate_type string, rate string, source string, status string")
    return d.withColumn("rate", F.col("rate").cast("decimal(24,12)"))


@query("""WITH a AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,4)) AS amount, CASE o_orderkey%4 WHEN 0 THEN 'USD' WHEN 1 THEN 'PYG' WHEN 2 THEN 'BRL' ELSE 'EUR' END AS currency FROM orders),
r AS (SELECT *, CASE currency WHEN 'USD' THEN CAST('5.3034' AS DECIMAL(19,12)) WHEN 'PYG' THEN CAST('0.00071' AS DECIMAL(19,12)) WHEN 'BRL' THEN CAST(1 AS DECIMAL(19,12)) END AS rate FROM a)
SELECT id, amount, currency, 'BRL' AS target, CAST(round(CAST(amount AS DECIMAL(18,4))*rate,2) AS DECIMAL(38,12)) AS converted, CASE currency WHEN 'USD' THEN 'tourism_sell' WHEN 'PYG' THEN 'market' WHEN 'BRL' THEN 'official' END AS rate_type, CASE currency WHEN 'USD' THEN 'valor' WHEN 'PYG' THEN 'bcp' WHEN 'BRL' THEN 'identity' END AS source, CASE WHEN rate IS NULL THEN 'no_rate' END AS reason FROM r""")
def currency_conversion(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("USD", "PYG", "BRL", "EUR"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    amounts = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,4)").alias("amount"), code.alias("currency"), F.lit("BRL").alias("target"))
    return fx.convert(amounts, rates(spark))


@query("""SELECT event_id, 'USD' AS base, 'BRL' AS quote, array_to_string(list_filter([CASE WHEN r<=0 THEN 'not_positive' END, CASE WHEN r<2 OR r>15 THEN 'magnitude' END, CASE WHEN abs(r-5.1)*100>5.1*15 THEN 'change' END], lambda x: x IS NOT NULL),',') AS errors FROM (SELECT event_id, CAST(round(value)/10 AS DECIMAL(10,4)) r FROM events)""")
def rate_validation(spark, sf_dir):
    r = t(spark, sf_dir, "events").select("event_id", F.lit("USD").alias("base"), F.lit("BRL").alias("quote"), F.lit("ptax_sell").alias("rate_type"), (F.round("value") / 10).cast("decimal(10,4)").cast("decimal(24,12)").alias("rate"))
    return fx.validate(r, rates(spark)).select("event_id", "base", "quote", F.array_join("errors", ",").alias("errors"))


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id,event_type ORDER BY ts DESC,event_id DESC)=1""")
def upsert_latest(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return tables.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT o_custkey+1000000000, 'new' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice>200000)""")
def insert_missing(spark, sf_dir):
    old = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = t(spark, sf_dir, "orders").where("o_totalprice > 200000").select((F.col("o_custkey") + 1000000000).alias("c_custkey"), F.lit("new").alias("c_name")).distinct()
    return tables.insert_missing(old, new.unionByName(old.limit(5)), ["c_custkey"])


@query("""SELECT coalesce(c.c_custkey,o.o_custkey) AS c_custkey, coalesce(o.seg, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus='P' THEN 'PENDING' END) seg FROM orders GROUP BY 1) o ON o.o_custkey=c.c_custkey""")
def upsert_enrich(spark, sf_dir):
    new = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "PENDING")).alias("c_mktsegment"))
    return tables.enrich(t(spark, sf_dir, "customer"), new, ["c_custkey"], ["c_mktsegment"])


@query("""WITH h AS (SELECT DISTINCT l_partkey o, l_suppkey v FROM lineitem WHERE l_linenumber=1), c AS (SELECT DISTINCT l_partkey o, l_suppkey v FROM lineitem WHERE l_linenumber=2), m AS (SELECT o, min(v) v FROM h GROUP BY 1), w AS (SELECT v, min(o) o FROM h GROUP BY 1)
SELECT c.o AS l_partkey, c.v AS l_suppkey, CASE WHEN m.v=c.v AND w.o=c.o THEN 'kept' WHEN m.v IS NOT NULL OR w.o IS NOT NULL THEN 'refused' ELSE 'attached' END AS outcome FROM c LEFT JOIN m ON m.o=c.o LEFT JOIN w ON w.v=c.v""")
def guarded_attach(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    pick = lambda n: li.where(F.col("l_linenumber") == n).select("l_partkey", "l_suppkey").distinct()
    return tables.attach(pick(2), pick(1), "l_partkey", "l_suppkey")


@query("""SELECT o.o_orderkey, coalesce(a.v,b.v,c.v) AS found FROM orders o LEFT JOIN (SELECT c_custkey k, 'customer' v FROM customer WHERE c_acctbal>5000) a ON a.k=o.o_custkey LEFT JOIN (SELECT p_partkey k, 'part' v FROM part WHERE p_size<10) b ON b.k=o.o_custkey LEFT JOIN (SELECT s_suppkey k, 'supplier' v FROM supplier) c ON c.k=o.o_custkey""")
def priority_lookup(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    hit = lambda d, key, v: d.select(F.col(key).alias("k"), F.lit(v).alias("found"))
    found = [hit(t(spark, sf_dir, "customer").where("c_acctbal > 5000"), "c_custkey", "customer"), hit(t(spark, sf_dir, "part").where("p_size < 10"), "p_partkey", "part"), hit(t(spark, sf_dir, "supplier"), "s_suppkey", "supplier")]
    return tables.first_hit(o, found, [["k"]] * 3, "found").select("o_orderkey", "found")


@query("""SELECT event_id, CAST(CASE WHEN event_id%8=0 THEN 0 ELSE least(3600,300*pow(2,least(event_id%8,30)-1)) END AS BIGINT) AS retry_s, CAST(CASE WHEN event_type='error' THEN (CASE WHEN event_id%5<3 THEN 86400 ELSE 172800 END) WHEN event_type='purchase' THEN greatest(900,floor((600+event_id%7000)/2)) ELSE least(86400,greatest(900,CASE WHEN event_id%5>=3 THEN (600+event_id%7000)*2 ELSE 600+event_id%7000 END)) END AS BIGINT) AS ttl, CAST(least(86400,(600+event_id%7000)*pow(2,least(event_id%9,5))) AS BIGINT) AS failure_ttl FROM events""")
def schedule_arithmetic(spark, sf_dir):
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    ttl = 600 + i % 7000
    return e.select("event_id", vx.retry_delay(i % 8).alias("retry_s"), vx.adaptive_ttl(ttl, F.col("event_type") == "purchase", F.col("event_type") != "error", i % 5, i % 5).alias("ttl"), vx.failure_ttl(ttl, i % 9).alias("failure_ttl"))


@query("""SELECT event_id, CASE WHEN value*30>=5000 THEN 'critical' WHEN value*30>=1000 THEN 'slow' WHEN value*30>=200 THEN 'warn' ELSE 'normal' END AS severity FROM events""")
def severity_levels(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("operation", F.lit("database_query"))
    budgets = F.broadcast(spark.createDataFrame(list(vx.BUDGETS), "operation string, expected int, warn int, slow int, critical int"))
    return e.join(budgets, "operation").select("event_id", vx.severity(F.col("value") * 30, F.col("warn"), F.col("slow"), F.col("critical")).alias("severity"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),CAST(b.embedding AS DOUBLE[])),6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""")
def pair_cosine(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""SELECT event_id, CAST(floor(epoch(ts)-epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts,event_id))) AS BIGINT) AS gap_s FROM events QUALIFY gap_s>3600""")
def hang_gaps(spark, sf_dir):
    """Steps that come more than an hour after the key's last one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = t(spark, sf_dir, "events").withColumn("gap_s", F.floor(seconds_exact("ts") - F.lag(seconds_exact("ts")).over(w)).cast("long"))
    return d.where("gap_s > 3600").select("event_id", "gap_s")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id,date_trunc('day',ts) ORDER BY ts,event_id)<=5 AS within FROM events""")
def attempt_budget(spark, sf_dir):
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return t(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) <= 5).alias("within"))


@query("""SELECT p_partkey, p_name FROM part WHERE nullif(trim(regexp_replace(lower(p_brand),'[^a-z0-9]+',' ','g')),'')='brand 13' AND p_size BETWEEN 5 AND 40""")
def faceted_search(spark, sf_dir):
    """Exact filters on normalised keys; no row cap before them."""
    p = t(spark, sf_dir, "part")
    return p.where((tx.normalize_brand(F.col("p_brand")) == "brand 13") & F.col("p_size").between(5, 40)).select("p_partkey", "p_name")


@query("""SELECT s.s_suppkey, n.n_name, coalesce(r.r_name,'Store') AS label FROM supplier s JOIN nation n ON n.n_nationkey=s.s_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey>0) r ON r.r_regionkey=n.n_regionkey WHERE (s.s_acctbal IS NULL OR s.s_acctbal>0)""")
def store_dimension(spark, sf_dir):
    """Inner and outer dimension joins with a label fallback, under a row-level scope."""
    s = t(spark, sf_dir, "supplier").where("s_acctbal is null or s_acctbal > 0")
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region").where("r_regionkey > 0")
    return s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("Store")).alias("label"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text,''),'(?i)(bearer\\s+)[A-Za-z0-9._~+/=-]+','\\1***','g'),'://([^:/@\\s]+):[^@/\\s]+@','://\\1:***@','g')) AS redacted FROM documents""")
def log_redaction(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redact(F.coalesce("text", F.lit(""))).cast("binary")).alias("redacted"))


@query("""SELECT o_orderkey, 'priority=' || o_orderpriority || '|status=' || o_orderstatus AS variant FROM orders""")
def variant_keys(spark, sf_dir):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return t(spark, sf_dir, "orders").select("o_orderkey", tx.variant_key(m).alias("variant"))


@query("""SELECT event_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events""")
def staging_round_trip(spark, sf_dir):
    """Rows staged as JSON text and restored with their types."""
    staged = t(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("staged"))
    return staged.select(F.from_json("staged", "event_id long, event_type string, value double, k long").alias("r")).select("r.*")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def extension_cube(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("qty"))


@query("""SELECT CAST(epoch(date_trunc('hour',ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2""")
def extension_tumbling(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.unix_timestamp(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"]).alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic=1)""")
def in_list_scan(spark, sf_dir):
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment='BUILDING' ORDER BY c_name, c_custkey LIMIT 25 OFFSET 10""")
def catalog_page(spark, sf_dir):
    return t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(10).limit(25)


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate>=TIMESTAMP '1997-01-01' AND o_orderdate<TIMESTAMP '1997-02-01' AND o_orderstatus IS NOT DISTINCT FROM 'O' AND o_orderpriority NOT IN ('1-URGENT')""")
def half_open_range(spark, sf_dir):
    o, day = t(spark, sf_dir, "orders"), lambda d: F.lit(d).cast("timestamp_ntz")
    return o.where((F.col("o_orderdate") >= day("1997-01-01")) & (F.col("o_orderdate") < day("1997-02-01")) & F.col("o_orderstatus").eqNullSafe("O") & ~F.col("o_orderpriority").isin("1-URGENT")).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size%3=0 THEN p_brand WHEN p_size%3=1 THEN p_type END AS value, CASE WHEN p_size%3=0 THEN 'variant' WHEN p_size%3=1 THEN 'specs' END AS source FROM part""")
def attribute_precedence(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    value, source = tables.resolve([("variant", F.when(size == 0, F.col("p_brand"))), ("specs", F.when(size == 1, F.col("p_type")).otherwise(" "))])
    return p.select("p_partkey", value.alias("value"), source.alias("source"))


@query("""SELECT p_partkey, 'brand=' || p_brand || CASE WHEN p_size%2=0 THEN '|kind=snapshot' ELSE '' END || '|size=' || p_size AS merged FROM part""")
def merged_metadata(spark, sf_dir):
    """A snapshot's entries under those of the change; a null of the change wins."""
    snapshot = F.create_map(F.lit("kind"), F.lit("snapshot"), F.lit("size"), F.lit("0"))
    after = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    after = F.when(F.col("p_size") % 2 == 0, after).otherwise(F.map_concat(after, F.create_map(F.lit("kind"), F.lit(None).cast("string"))))
    merged = F.map_filter(tables.merge_maps(snapshot, after), lambda k, v: v.isNotNull())
    return t(spark, sf_dir, "part").select("p_partkey", tx.variant_key(merged).alias("merged"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) || ' GB' AS capacity, CAST(p_size*100 AS VARCHAR) || ' MHz' AS frequency, CAST(p_size*10 AS VARCHAR) || ' W' AS wattage, CAST(p_size AS VARCHAR) || ' mm' AS length FROM part""")
def unit_normalisers(spark, sf_dir):
    n = lambda k: (F.col("p_size") * k).cast("string")
    title = F.concat(F.lit("kit "), n(1), F.lit("gb "), n(100), F.lit("mhz "), n(10), F.lit("W "), n(1), F.lit("MM"))
    return t(spark, sf_dir, "part").select("p_partkey", vx.capacity(title).alias("capacity"), vx.frequency(title).alias("frequency"), vx.wattage(title).alias("wattage"), vx.length_mm(title).alias("length"))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(max(l_quantity) AS BIGINT) AS top FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0) GROUP BY 1""")
def extension_distinct(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.max("l_quantity").cast("long").alias("top"))


@query("""SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size>25""")
def extension_intersect(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")))


@query("""SELECT l_suppkey, l_orderkey*10+l_linenumber AS id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS q FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
def extension_ranks(spark, sf_dir):
    """Ranks of a supplier's lines: one sort serves all three, and tasks stay small however few the session shuffles to."""
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy("l_suppkey").orderBy("l_quantity")
    v = Window.partitionBy("l_suppkey").orderBy("l_quantity", "l_orderkey", "l_linenumber")
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber").repartition(parts, "l_suppkey")
    quarters = li.select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.ntile(4).over(v).cast("long").alias("q"))
    return quarters.select("l_suppkey", "id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), "q")


from . import feed, keyed, landing, market, monitoring, payloads, titles  # noqa: E402, F401  (they add their queries)
