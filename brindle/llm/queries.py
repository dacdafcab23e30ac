"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, chat, codes, hnsw, jaccard, kneserney, lattice, licenses, mixing, packing, quality, spelling, suffixarray
from .common import checkpointed, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1, payload="crc32").select("doc_id", "piece", "start", "length", "ids_crc32", *packing.PACKED)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "weak_label", "keep")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), share=1.5, most=2.0, weights=(3, 1, 2))
    # a document is taken once for every output shard that the tree has dealt it to
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda total, shard: total + F.col("size"))
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shards")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, share=85)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixarray.dedup_bytes(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"), shortest=5, least=3, period=97, times=2)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", kneserney.held_out(F.col("doc_id")).alias("held_out"))
    model = kneserney.train(docs, order=2, learns=~F.col("held_out"))
    found = kneserney.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
    found = checkpointed(found)  # a row a document; the model's arrays aren't needed any more
    model.delete()
    return found.drop("perplexity")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=16, rounds=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_substring_dedup, op4_quality_classifier, op5_embedding_near_dedup, op6_source_mixing, op7_ngram_jaccard_join, op8_nearest_neighbours, op9_chat_formatting, op10_suffix_array_dedup, op11_spelling_variants, op12_lm_scoring, op13_vector_codes)}
_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"



def _templates() -> str:
    """The license templates' word pairs as SQL values."""
    rows, at = [], 0
    for base, group in (("true", licenses.PHRASES), ("false", licenses.PASSAGES)):
        for label, text in group:
            w = text.split()
            rows += [f"({at},'{label}',{base},{len(w)},{i},'{w[i]}','{w[i + 1]}')" for i in range(len(w) - 1)]
            at += 1
    return ",".join(rows)

def _crc32(bytes_: str) -> str:
    """CRC-32 of a list of bytes: each byte, then eight shifts."""
    steps = f"flatten(list_transform({bytes_}, lambda y: [y, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda h, y: CASE WHEN y >= 0 THEN xor(h, y) ELSE xor(h >> 1, (h & 1) * 3988292384) END), 4294967295)"


def _discount(k: str, table_: str) -> str:
    """The discount of a count k from a table's counts of counts n1 to n4."""
    rule = lambda i: f"{i} - {i + 1} * ({table_}.n1 / ({table_}.n1 + 2 * {table_}.n2)) * {table_}.n{i + 1} / {table_}.n{i}"
    safe = lambda i, d: f"CASE WHEN {table_}.n1 > 0 AND {table_}.n2 > 0 AND {table_}.n3 > 0 AND {rule(i)} > 0 AND {rule(i)} < {i} THEN {rule(i)} ELSE {d} END"
    return f"CASE {k} WHEN 0 THEN 0 WHEN 1 THEN {safe(1, 0.5)} WHEN 2 THEN {safe(2, 1.0)} ELSE {safe(3, 1.5)} END"


def _code_rounds() -> str:
    """Codebooks and choices of op13: two rounds, then a last choice."""
    nearest = "SELECT vec_id, part, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT p.vec_id, p.part, c.e, CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{} c ON c.part = p.part) GROUP BY vec_id, part"
    moved = "SELECT c.part, c.e, coalesce(m.s, c.s) AS s FROM c{0} c LEFT JOIN (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY place) AS s FROM (SELECT part, e, place, sum(x) AS t, count(*) AS n FROM (SELECT p.part, a.e, unnest(p.s) AS x, unnest(range(len(p.s))) AS place FROM p JOIN a{0} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY part, e, place) GROUP BY part, e) m ON m.part = c.part AND m.e = c.e"
    return ", ".join([f"a0 AS ({nearest.format(0)})", f"c1 AS ({moved.format(0)})", f"a1 AS ({nearest.format(1)})", f"c2 AS ({moved.format(1)})", f"a2 AS ({nearest.format(2)})"])


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
p AS (SELECT doc_id, unnest(w[1:len(w)-1]) a, unnest(w[2:]) b, unnest(range(len(w)-1)) pos FROM d WHERE len(w) > 1),
t(template, label, base, size, place, w1, w2) AS (VALUES {_templates()}),
h AS (SELECT doc_id, template, label, base, size, place, pos, pos - place AS diagonal FROM p JOIN t ON a = w1 AND b = w2),
b AS (SELECT doc_id, label, diagonal FROM h WHERE base GROUP BY doc_id, template, label, size, diagonal HAVING count(*) = size - 1),
s AS (SELECT DISTINCT doc_id, template, label, size, diagonal FROM h WHERE NOT base),
r AS (SELECT s.doc_id, s.label, s.size, list({{'pos': h.pos, 'place': h.place}} ORDER BY h.pos, h.place DESC) hits FROM s JOIN h USING (doc_id, template) WHERE h.diagonal BETWEEN s.diagonal AND s.diagonal + floor(0.5 * s.size) GROUP BY s.doc_id, s.template, s.label, s.size, s.diagonal HAVING count(DISTINCT h.place) >= 0.8 * (s.size - 1)),
c AS (SELECT doc_id, label, list_reduce(hits, lambda best, x: list_transform(best, lambda old, i: CASE WHEN i > x.place + 1 AND old < best[x.place + 1] + 1 THEN best[x.place + 1] + 1 ELSE old END), list_transform(range(size), lambda z: 0))[size] / (size - 1) AS share FROM r),
f AS (SELECT doc_id, label, true AS base, diagonal, 1.0 AS share FROM b UNION ALL SELECT doc_id, label, false, NULL, share FROM c WHERE share >= 0.8)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (f.base) AS n_base, CAST(min(f.diagonal) AS BIGINT) AS first_word, CAST(max(f.diagonal) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels, CAST(coalesce(max(f.share), 0) AS DOUBLE) AS score FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text,'')")} w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') g FROM (SELECT *, unnest(range(1, len(w)-11)) i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) m FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i+13)) pos FROM p JOIN m USING (g) WHERE m < doc_id),
k AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w)+1)) pos FROM d)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(c.pos) AS n_removed, sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.pos) FILTER (c.pos IS NULL AND k.pos IS NOT NULL), '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos GROUP BY d.doc_id""",
    "op5_embedding_near_dedup": """WITH RECURSIVE l AS (SELECT a.vec_id a, b.vec_id b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.98),
r AS (SELECT vec_id a, vec_id b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id""",
    "op7_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') g FROM (SELECT *, unnest(range(1, greatest(len(w)-2, 2))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 85 * (x.n + y.n - o.c)),
r AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) h FROM documents),
e AS (SELECT doc_id, c, h[2*1000*c+1:2*1000*c+2*1049] h FROM (SELECT *, unnest(range(0, greatest(len(h)//2-49, 0)//1000+1)) c FROM d)),
p AS (SELECT doc_id, 1000*c+i AS i, h[2*i+1:2*i+100] g FROM (SELECT *, unnest(range(0, len(h)//2-49)) i FROM e WHERE len(h) >= 100)),
m AS (SELECT g, min(doc_id) m FROM p GROUP BY g),
c AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w, -51) + 50 AS fresh FROM p JOIN m USING (g) WHERE m < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) span FROM c),
s AS (SELECT doc_id, min(i) low, max(i) + 50 high FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) before FROM s),
x AS (SELECT doc_id, sum(high - low) gone, count(*) spans, max(high) top, string_agg(h[2*before+1:2*low], '' ORDER BY low) kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h)//2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || h[2*coalesce(top, 0)+1:])) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)""",
    "op11_spelling_variants": f"""WITH RECURSIVE r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, {_crc32("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))")} AS h FROM r),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
s AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
x AS (SELECT DISTINCT word, n, replace(k, '*', '') AS k FROM s),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.k = b.k AND a.word <> b.word UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON w.word = x.k UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON w.word = x.k),
b AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word, n),
f AS (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM b),
g AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT w.word, f.form, t.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w LEFT JOIN f USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM g GROUP BY word) t USING (word)""",
    "op12_lm_scoring": f"""WITH d AS (SELECT doc_id, coalesce({_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x))")} % 7 = 2, false) AS held_out, list_concat({_WORDS.format(text=_LOWER)}, [' ']) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(list_concat([''], w[1:len(w)-1])) AS v FROM d),
g AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
u AS (SELECT w, count(*) AS a, sum(c) AS c FROM g GROUP BY w),
x AS (SELECT v, sum(c) AS total, count(*) FILTER (c = 1) AS k1, count(*) FILTER (c = 2) AS k2, count(*) FILTER (c > 2) AS k3 FROM g GROUP BY v),
z AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v, sum(a) AS total, count(*) FILTER (a = 1) AS k1, count(*) FILTER (a = 2) AS k2, count(*) FILTER (a > 2) AS k3, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3, count(*) FILTER (a = 4) AS n4 FROM u),
y AS (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM g),
e AS (SELECT {", ".join(f"{_discount(str(k), 'z')} AS d{k}, {_discount(str(k), 'y')} AS b{k}" for k in (1, 2, 3))} FROM z, y),
o AS (SELECT t.*, coalesce(u.c, 0) AS seen, (greatest(coalesce(u.a, 0) - CASE WHEN u.a IS NULL THEN 0 WHEN u.a = 1 THEN d1 WHEN u.a = 2 THEN d2 ELSE d3 END, 0) + (d1 * z.k1 + d2 * z.k2 + d3 * z.k3) / (z.v + 1)) / z.total AS p1,
 coalesce(g.c, 0) AS c, x.total, b1 * x.k1 + b2 * x.k2 + b3 * x.k3 AS rest, CASE WHEN g.c IS NULL THEN 0 WHEN g.c = 1 THEN b1 WHEN g.c = 2 THEN b2 ELSE b3 END AS off, z.n, z.v AS distinct_ FROM t CROSS JOIN z CROSS JOIN e LEFT JOIN u ON u.w = t.w LEFT JOIN g ON g.v = t.v AND g.w = t.w LEFT JOIN x ON x.v = t.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (seen > 0) AS n_known, any_value(n) AS train_tokens, sum(log10((seen + 1) / (n + 1 * (distinct_ + 1)))) AS base_score, sum(log10(CASE WHEN total IS NULL THEN p1 ELSE (greatest(c - off, 0) + rest * p1) / total END)) AS score FROM o GROUP BY doc_id, held_out""",
    "op13_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS s FROM (SELECT *, unnest(range(16)) AS part FROM k)),
c0 AS (SELECT part, e, s FROM (SELECT part, s, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64), {_code_rounds()},
b AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, place)) AS codebooks_sha256 FROM (SELECT part, e, unnest(s) AS x, unnest(range(len(s))) AS place FROM c2)),
o AS (SELECT vec_id, string_agg(lower(right('0' || to_hex(e), 2)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT o.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM o JOIN k USING (vec_id) CROSS JOIN b""",
}
