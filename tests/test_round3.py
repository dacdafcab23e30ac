"""Findings of the third round."""

import duckdb
import pyarrow as pa
import pytest

from brindle.llm import common, packing, queries
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"


def test_headings_by_sql(spark, tmp_path):
    """entities, tags, wide blanks, the title where no heading has text, and missing pages."""
    pages = ["<h1>a &quot;b&quot; &lt;i&gt; &amp;lt; it&#39;s</h1>", "<title>T</title><h1 class=x>one<br>two\t three&nbsp;</h1>", "<title> only &nbsp; title </title><h1><b></b></h1>", "<h1x>no</h1x>", "", "  ", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL["page_products"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["page_products"](spark, str(tmp_path)).collect())) == want
    assert [w[1] for w in want] == ['a "b" <i> &lt; it\'s', "one two three", "only title", None, None, None, None]
    assert [w[3] for w in want][-3:] == ["empty"] * 3

def test_schedule_bounds_are_all_checked(spark):
    """the bounds of regular checks, jitter and rates are columns again, as in the SQL, for every event."""
    d = catalog.QUERIES["schedule_bounds"](spark, SF)
    assert d.columns == ["event_id", "regular", "jittered", "rates", "crawl"]
    rows = d.collect()
    assert len(rows) == 1000 and all(r.regular and r.jittered and r.rates for r in rows) and {r.crawl for r in rows} == {True, False}


def test_workers_empty_what_other_operators_keep():
    """pipeline: the packer's words are dropped in a worker that goes on to another operator, and kept in its own tasks."""
    kept = {"path": "words"}
    common.KEPT.append(kept)
    common.give_back(kept)
    assert kept and packing._ENCODERS in common.KEPT
    common.give_back()
    common.KEPT.remove(kept)
    assert not kept


def test_small_arrow_batches_are_for_a_step_only(spark):
    """pipeline: texts come to the tokenizer in small batches, and the session's own number is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), lambda b: ([(x.num_rows) for x in b])
    sizes = lambda: spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [n]}) for n in seen(bs)), "n long")
    with common.arrow_rows(spark, packing.BATCH_TEXTS):
        assert max(r.n for r in sizes().collect()) <= packing.BATCH_TEXTS
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("name", ["search_ladder", "json_ld_products", "variant_parsing", "rate_inverse", "payload_staging"])
def test_short_rows_are_dealt_to_all_cores(spark, name):
    """F4, F6, F8 to F10: what is worked out of a table in one small file takes many tasks, not the file's one."""
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() > 4


def test_words_that_are_met_again_stay(monkeypatch):
    """pipeline: a worker's table of words turns over by generations; frequent words aren't learned again, and the ids stay the same."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    enc, whole, learned = packing.WordEncoder(queries.tokenizer_path()), packing.WordEncoder(queries.tokenizer_path()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (learned.extend(words), learn(words)))
    for i in range(40):
        texts = [f"the price, the Price of {'x' * (i % 7)}word{i}{j}".encode() for j in range(20)]
        assert enc.encode(texts) == [whole._one(t.decode()) for t in texts]
        assert len(enc.known) + len(enc.before) <= 2 * (50 + 3 * 25)
    assert learned.count(b"the") == learned.count(b"price,") == 1


def test_ranks_take_one_sort(spark):
    """the wider order serves the narrower one, and the lines are dealt to more tasks than the session shuffles to."""
    d = catalog.QUERIES["extension_ranks"](spark, SF)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "hashpartitioning(l_suppkey" in plan and plan.count("Exchange ") == 1
    assert d.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    assert sorted(map(tuple, d.collect())) == sorted(con.execute(catalog.ORACLE_SQL["extension_ranks"]).fetchall())


def _as_its_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, SF).select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_snapshots_are_put_together_once(spark):
    """fields of different names aren't merged object by object; rows are dealt; only what is told is read back."""
    d = catalog.QUERIES["offer_snapshots"](spark, SF)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_filter") == 1 and plan.count("variant_get") == 3
    assert d.rdd.getNumPartitions() > 4
    _as_its_sql(spark, "offer_snapshots", "lineitem")


def test_feed_reads_each_field_once(spark):
    """prices are told from texts that are read once a row; rows are dealt."""
    d = catalog.QUERIES["feed_projection"](spark, SF)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 40
    assert d.rdd.getNumPartitions() > 4
    _as_its_sql(spark, "feed_projection", "events")


def test_settled_words_go_to_the_model_at_once(monkeypatch):
    """op1_best_fit_packing: words of settled letters take none of the tokenizer's steps before its model, a distinct word
    of a slice is looked up once, and the ids are those of the whole tokenizer."""
    enc, whole = packing.WordEncoder(queries.tokenizer_path()), packing.WordEncoder(queries.tokenizer_path())
    letters = [chr(c) for c in range(0x180) if chr(c).isalpha()]
    texts = ["".join(letters), " ".join(letters), " ".join(f"Wor{c}d{c.upper()}s" for c in letters), "", " ", " \t\n", "\ufb01 \u4e2d\u6587, \u0416\u0443\u043a! e\u0301 J\u030c 7x"]
    assert enc.encode([t.encode() for t in texts]) == [whole._one(t) for t in texts]
    assert enc.encode([]) == [] and enc.encode([b"", b" "]) == [b"", b""]
    assert enc.encode(pa.array([b"skipped", b"a B", b"c"], pa.large_binary()).slice(1)) == [whole._one("a B"), whole._one("c")]
    looked = []
    look_up = enc._look_up
    monkeypatch.setattr(enc, "_look_up", lambda words: (looked.extend(words), look_up(words))[1])
    monkeypatch.setattr(enc, "tokenizer", None)
    texts = [" ".join(["Größe größe ÉTÉ été unheard"] * 50), "the same unheard größe"]
    assert enc.encode([t.encode() for t in texts]) == [whole._one(t) for t in texts]
    assert len(looked) == len(set(looked)) == 7


def test_slices_are_bounded_by_bytes():
    """op1_best_fit_packing: long texts are split few at a time, short ones many, and every row comes once."""
    sizes = [10, 0, packing.SLICE_BYTES * 3, 5, packing.SLICE_BYTES - 20, 30, 0, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([b"x" * n for n in sizes], pa.binary())], ["doc_id", "text"])
    slices = list(packing._slices(batch))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(len(sizes)))
    for s in slices:
        n = [len(t) for t in s.column(1).to_pylist()]
        assert sum(n) - max(n) < packing.SLICE_BYTES
    assert not list(packing._slices(batch.slice(0, 0)))
