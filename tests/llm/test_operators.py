"""The training-data operators against brute force, on tables with every odd row."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.llm import automaton, chat, hnsw, jaccard, lattice, licenses, mixing, packing, quality, queries, suffixarray, textscan
from brindle.llm.graph import components

SCHEMA = "doc_id long, text string, source string, id string, block int, row string, shards int, keep string, n_words int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(30)
    texts = [None, "", " \t\n", "one", "two words", base, base, base.replace(" ", "\n", 5), base + " Tail " + say(3), passage, say(40) + " " + passage + " " + say(50), passage + " " + say(9), "ha " * 200, say(3000), say(60) + " Licensed under the Apache-License, MIT license", "naïve Ünïcode " + "日本語 " * 30]
    near = base.split()
    for i in range(30):
        near[i] = "x%d" % i
        if i % 6 == 0:
            texts.append(" ".join(near))
    out = [(i * 3, t, ["a", None, "ß", "b"][i % 4]) for i, t in enumerate(texts)]
    out += [(15, base, "a"), (15, say(20), "b"), (None, passage, "a"), (None, None, None)]
    return [(*r, "x", 1, "r", 2, "k", 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return (1 << 63) - 1 if i is None else i


def covered(sequences, ids, window):
    least = {}
    cut = lambda s, i: s[i : i + window] if isinstance(s, bytes) else tuple(s[i : i + window])
    for s, d in zip(sequences, ids, strict=True):
        for i in range(len(s) - window + 1):
            least[cut(s, i)] = min(least.get(cut(s, i), 1 << 63), order(d))
    for s, d in zip(sequences, ids, strict=True):
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if least[cut(s, i)] < order(d):
                gone[i : i + window] = [True] * window
        yield gone


def test_substring_dedup(docs, empty):
    data = rows()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data]
    want = sorted(((r[0], len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for r, w, g in zip(data, words, covered(words, [r[0] for r in data], 13), strict=True)), key=str)
    got = automaton.dedup_substrings(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "text").collect()), key=str) == want
    assert "n_words" in got.columns and got.columns.count("n_words") == 1
    assert automaton.dedup_substrings(empty).count() == 0


def test_suffix_array_dedup(docs, empty):
    data = rows()
    texts = [(r[1] or "").encode() for r in data]
    want = []
    for r, s, g in zip(data, texts, covered(texts, [r[0] for r in data], 50), strict=True):
        runs = sum(b and not a for a, b in zip([False, *g], g, strict=False))
        want.append((r[0], len(s), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(s, g, strict=True) if not y)).hexdigest()))
    got = suffixarray.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert suffixarray.dedup_bytes(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60))
        assert suffixarray.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        o = suffixarray.suffix_array(s)
        common = suffixarray.permuted_common_prefixes(s, o, 5)
        for a, b in zip(o, o[1:], strict=False):
            n = 0
            while n < 5 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert common[b] == n


def test_suffix_arrays_recur(monkeypatch):
    rng, calls, inner = np.random.default_rng(3), [], suffixarray.suffix_array
    monkeypatch.setattr(suffixarray, "suffix_array", lambda s: calls.append(len(s)) or inner(s))
    words = [rng.integers(1, 2000, rng.integers(3, 9)) for _ in range(60)]
    s = np.concatenate([*(words[i] for i in rng.integers(0, 60, 4000)), rng.integers(1, 4, 3000), np.tile([5, 3, 7], 900)])
    order = suffixarray.suffix_array(s)
    data = s.astype(">u2").tobytes()
    assert order.tolist() == sorted(range(len(s)), key=lambda i: data[2 * i :])
    assert len(calls) >= 3 and all(b <= a / 2 for a, b in zip(calls, calls[1:], strict=False))


def test_jaccard(docs, empty):
    data, sets = rows(), []
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    top = {order(r[0]): order(r[0]) for r in data}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(order(data[i][0])), root(order(data[j][0]))
                top[max(x, y)] = min(x, y)
    want = sorted(((r[0], len(s), None if root(order(r[0])) == order(None) else root(order(r[0]))) for r, s in zip(data, sets, strict=True)), key=str)
    assert sorted((tuple(r) for r in jaccard.jaccard_components(docs).collect()), key=str) == want
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in want if d == c}


def test_jaccard_bands_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_DOCS", 6)
    rng = random.Random(12)
    word = [f"w{i}" for i in range(400)]
    data = []
    for i in range(120):  # prefixes of one text: sizes over many bands, linked to those of like size
        w = word[: rng.randint(20, 400)]
        data.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in data)]
    want = sorted((i, sum(100 * len(s & o) >= 85 * len(s | o) for o in sets) - 1) for i, s in enumerate(sets))
    got = jaccard.jaccard_links(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 4, 85)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == want


def test_jaccard_parts_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_DOCS", 4)
    words = [f"w{i}" for i in range(100)]
    data = [(k, " ".join(words[:k] + ["z%d" % k] + words[k + 1 :])) for k in range(3, 30)]
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85)
    assert {r.component_id for r in got.collect()} == {3}


@pytest.mark.parametrize("part, long", [(512, 8192), (4, 1)])
def test_jaccard_links_of_every_pair(spark, monkeypatch, part, long):
    monkeypatch.setattr(jaccard, "PART_DOCS", part)
    monkeypatch.setattr(jaccard, "LONG_SET", long)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(120), rng.choice((0, 1, 2, 3))):
            w[at] = f"z{i}"
        data.append((i if i % 9 else None, " ".join(w)))
    data += [(50, None), (51, "alone here with nobody else"), (3, "alone here with nobody else")]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in ((t or "").split() for _, t in data)]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted((str(d), len(s), sum(linked(s, o) for o in sets) - bool(s)) for (d, _), s in zip(data, sets, strict=True))
    assert max(n for *_, n in want) > 10 and len({n for *_, n in want}) > 5
    got = jaccard.jaccard_links(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 4, 85)
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got.collect()) == want


def test_rows_without_an_id_of_their_own_are_kept_one_by_one(spark):
    say = lambda c: " ".join(f"{c}{i}" for i in range(30))
    data = [(1, say("a")), (None, say("a") + " tail"), (None, say("b")), (None, say("c")), (None, say("c")), (None, None), (None, ""), (2, say("d")), (2, say("a")), (2, say("e")), (3, say("e")), (4, say("f")), (4, say("f"))]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, source string").repartition(3)
    kept = jaccard.keep_rows(docs)
    want = [(1, say("a")), (None, say("b")), (None, say("c")), (None, None), (None, ""), (2, say("d")), (2, say("e")), (4, say("f"))]
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (5, 5), (20, 21), (21, 20)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = []
    for r in rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want += [(r[0], i // 64, i, ids[i : i + 64]) for i in range(0, len(ids), 64)]
    got = packing.pack_documents(docs, path, 64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in got), key=str) == sorted(want, key=str)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(fill) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 1
    crc = packing.pack_documents(docs, path, 64, payload="crc32").collect()
    pack = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in crc) == sorted((str(w[0]), w[1], pack(w[3])) for w in want)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_rounds_meet_the_bound(spark):
    rng = np.random.default_rng(5)
    data = [(i, 0, 0, int(n)) for i, n in enumerate(rng.integers(1, 65, 3000))]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, piece int, start long, length long"), 64, group_pieces=500)
    n, total = got.select("sequence_id").distinct().count(), sum(d[3] for d in data)
    assert got.count() == 3000 and got.agg(F.sum("length")).first()[0] == total
    lengths = np.sort([d[3] for d in data])[::-1]
    whole = len(packing.best_fit_decreasing(lengths, 64)[2])  # all in one partition
    assert packing.lower_bound(lengths, 64) <= n <= 1.01 * whole + 1


def test_packing_certificates(spark):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 65, 2000)
    values, counts = np.unique(lengths, return_counts=True)
    assert packing.lower_bound(values, 64, counts) == packing.lower_bound(lengths, 64)
    data = [(i, 0, 0, int(n), "t", 1, True) for i, n in enumerate(lengths)]
    packed = packing.pack(spark.createDataFrame(data, "doc_id long, piece int, start long, length long, tie string, offset int, open boolean"), 64, group_pieces=400)
    assert {"tie", "open"} <= set(packed.columns) and packed.columns.count("offset") == 1
    whole = packing.certificate(packed, 64).first()
    assert whole.gap == whole.sequences - whole.bound and 0 <= whole.gap <= 0.02 * whole.bound
    for r in packed.select("round", "partition", "partition_bins", "partition_bound").distinct().collect():
        assert r.partition_bins >= r.partition_bound
    assert packing.certificate(packed.limit(0), 64).first().sequences == 0


def test_odd_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["It's we'LL O'Neil 'tis", "İstanbul ΣΑΣ ΣΑΣ. étude É <|endoftext|> a<|endoftext|>b", "x!!! a.b ...c 3,14 1a2    y \x1c q", "日本語、テキスト ﬁ ǅ ß"]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode([t.encode()])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(2)
    data = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 900), rng.choice(["a", "b", "c", "d", None], 900, p=[0.5, 0.2, 0.1, 0.1, 0.1]), strict=True))]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(2)
    plan = mixing.mix_plan(table)
    got = plan.collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert len(r.shards) <= 2
        by[r.source][0] += r.size
        by[r.source][1] += r.size * len(r.shards)
        by[r.source][2] = r.target
    assert sum(t for *_, t in by.values()) == pytest.approx(1.5 * sum(s for s, *_ in by.values()))
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 3
    # shares by weight where nothing is capped
    level = {s: by[s][2] / w for s, w in zip(["a", "b", "c", "d", None], (3, 1, 2, 3, 1), strict=True) if by[s][2] < 2 * by[s][0] - 1e-6}
    assert max(level.values()) == pytest.approx(min(level.values()))
    assert sorted((r.tie, r.shards) for r in mixing.mix_plan(table).collect()) == sorted((r.tie, r.shards) for r in got)
    mixed = mixing.mix(table)
    assert mixed.count() == sum(len(r.shards) for r in got)
    assert mixing.mix_plan(docs).count() == len(rows()) and mixing.mix(docs).select(docs.columns).count() > 0
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_fills_a_target_from_any_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    # long documents in nearly all blocks, and a few short ones anywhere
    sizes = [90 if i % 40 else 1 for i in range(400)]
    data = [(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)] + [(1000 + i, "w " * 10, "b") for i in range(20)]
    plan = mixing.mix_plan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    mine = [r for r in plan if r.source == "a"]
    left = mine[0].target - sum(r.size * len(r.shards) for r in mine)
    passes = int(mine[0].target // mine[0].source_size)
    # nothing fits any more, or the smallest was put on top
    assert left < min([r.size for r in mine if len(r.shards) == passes], default=1) and abs(left) <= 45


def test_mixing_shards_come_from_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "LEAVES", 4)
    data = [(i, "w " * (5 + i % 7), "abc"[i % 3], 1, "x") for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, number int, shards string").repartition(5)
    plan = mixing.mix_plan(docs).collect()
    taken = defaultdict(set)
    for r in plan:
        for shard in r.shards:
            taken[shard].add(r.doc_id)
    mixed = mixing.mix(docs)
    assert {"number", "shards"} <= set(mixed.columns)
    got = defaultdict(list)
    for r in mixed.collect():
        got[r.mix_shard].append(r)
    by_id = lambda rows: sorted(r.doc_id for r in rows)
    assert {s: by_id(r) for s, r in got.items()} == {s: sorted(d for r in plan for x in r.shards if x == s for d in [r.doc_id]) for s in taken}
    # even shards: at most SHARD_BLOCKS blocks of about 50 words each
    words = [sum(len(r.text.split()) for r in rows) for rows in got.values()]
    assert len(got) > 20 and max(words) < 1.6 * mixing.SHARD_BLOCKS * 50


def test_licenses(docs, empty):
    got = licenses.scan_licenses(docs)
    for r in got.where("n_base > 0").collect():
        assert (r.n_base, r.base_labels, r.score) == (2, "apache,mit", 1.0) and r.last_word == r.n_words - 2
    assert got.where("n_base > 0").count() == 1 and got.count() == len(rows())
    words = {str(r[0]) + str(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER)))) for r in rows()}
    assert {str(r.doc_id) + str(r.n_words) for r in got.collect()} == words
    assert licenses.scan_licenses(empty).count() == 0


def test_license_readings(spark):
    bsd = dict(licenses.PASSAGES)["bsd"]
    broken = bsd.replace("source and binary", "source, also binary").replace("are permitted", "are hereby permitted")
    data = [(1, "x " * 50 + broken.upper()), (2, "MIT LICENSE and mit-license"), (3, bsd[:40]), (4, "gnu general public general public license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].base_labels == "" and got[1].n_base == 0 and 0.8 <= got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (2, 0, 3, "mit")
    assert got[3].labels == "" and got[3].score == 0
    assert got[4].n_base == 0


def test_license_words_that_repeat_are_no_passage(spark):
    texts = ["licensed under " * 6, "under the " * 4 + "licensed under the gnu", "cc by nc " * 3, " ".join(reversed(dict(licenses.PASSAGES)["bsd"].split())), "licensed under " * 6 + "licensed under the gnu lesser general public license", "no " * 30_000 + "this is free and unencumbered software released into the public domain " + "no " * 30_000]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("cc-by", 1.0), 3: ("", 0.0), 4: ("lgpl", 1.0), 5: ("unlicense", 1.0)}
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"), passages=(("x", "one"),))


def vectors():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 16))
    v[300:340] = v[0] + 0.02 * rng.standard_normal((40, 16))
    v[340:350] = v[1]
    out = [(i, x.astype(np.float32).tolist(), int(i >= 450)) for i, x in enumerate(v)]
    return out + [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] + [1.0] * 15, 0), (703, [None] + [1.0] * 15, 0), (704, v[0].tolist(), None), (705, [1.0, 2.0], 0), (None, v[0].tolist(), 0), (706, [], 0), (800, (3 * v[1]).tolist(), 0), (5, v[1].tolist(), 0)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def linked_vectors(data):
    """By brute force: of each row its links, and the smallest id that it reaches."""
    units = {}
    for i, (v, e, label) in enumerate(data):
        if v is not None and label is not None and good(e):
            x = np.array(e, np.float32).astype(float)
            units[i] = x / np.linalg.norm(x)
    links, top = [0] * len(data), list(range(len(data)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in units:
        for j in units:
            if j < i and data[i][2] == data[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                top[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (v, *_) in enumerate(data):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return [(v, links[i], least[root(i)] if v is not None else None, v is None or least[root(i)] == v) for i, (v, *_) in enumerate(data)]


def test_lattice(spark):
    data = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, cell string").repartition(3)
    got = lattice.near_duplicates(frame).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, linked_vectors(data)))
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_lattice_groups_and_repeated_ids(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(lattice, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(9)
    v, w = rng.standard_normal(16), rng.standard_normal(16)
    near = v + 0.001 * rng.standard_normal(16)
    data = [(5, v.tolist(), 1), (5, w.tolist(), 1), (7, near.tolist(), 1)]
    data += [(100 + i, (w + 0.05 * rng.standard_normal(16)).tolist(), 1 + i % 2) for i in range(150)]
    got = [tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()]
    want = linked_vectors(data)
    assert [r for r in want if r[0] < 100] == [(5, 1, 5, True), (5, want[1][1], 5, True), (7, 1, 5, False)]
    # pairs near the threshold may be missed, none may be added
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[0] == b[0] and a[1] <= b[1]


def test_lattice_output_does_not_grow_with_pairs():
    rng = np.random.default_rng(2)
    v = (rng.standard_normal(16) + 0.001 * rng.standard_normal((300, 16))).astype("<f4")
    cells = np.zeros((300, 4, 5), np.int64) + np.arange(5)
    rows = [{"cell": 0, "probe": False, "id": i, "label": 1, "n": 1, "tab": 0, "cells": cells[i].tobytes(), "vector": v[i].tobytes(), "bin": 0, "part": 0, "bucket": 0} for i in range(300)]
    got = lattice._comparer(0.98, "<f4", 4)(pd.DataFrame(rows))
    assert len(got) == 300 and set(got["links"]) == {299} and set(got["b"]) == {0}


def test_lattice_large_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_ROWS", 8)
    rng = np.random.default_rng(7)
    v = rng.standard_normal(16)
    frame = spark.createDataFrame([(i, (v + 0.001 * rng.standard_normal(16)).tolist(), 1) for i in range(60)], "vec_id long, embedding array<double>, label int")
    got = lattice.near_duplicates(frame).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    y = rng.uniform(-2, 2, (200, 8))
    p = lattice.decode_e8(y) / 2
    d = ((y - p) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9  # the covering radius
    for r in lattice.e8_roots() / 2:
        assert (((y - p - r) ** 2).sum(1) >= d - 1e-9).all()


def test_hnsw(spark):
    data = vectors()
    frame = spark.createDataFrame([(*r, 1.0) for r in data], "vec_id long, embedding array<float>, label int, score double").repartition(3)
    index = hnsw.build_index(frame, 200)
    got = hnsw.search(index, frame.where("vec_id % 10 = 0"), 10, query_rows=16).collect()
    x = {}
    for i, (v, e, _) in enumerate(data):
        if v is not None and good(e):
            x[i] = (v, np.array(e, np.float32).astype(float))
    hits = total = 0
    answers = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        answers[r.query_id].append((r.score, r.vec_id))
    for q, e in {v: e for v, e in x.values() if v % 10 == 0}.items():
        want = sorted((float(np.sqrt(((e - w) ** 2).sum())), v) for v, w in x.values() if v != q and len(w) == len(e))[:10]
        assert answers[q] == sorted(answers[q])
        hits += len({v for _, v in want} & {v for _, v in answers[q]})
        total += len(want)
        exact = dict((v, s) for s, v in want)
        assert all(s == pytest.approx(exact[v]) for s, v in answers[q] if v in exact)
    assert hits >= 0.95 * total and 700 not in answers and 701 not in answers
    assert hnsw.search(hnsw.build_index(frame.limit(0)), frame.limit(0)).count() == 0


@pytest.mark.parametrize("groups, spread", [(40, 0.01), (80, 0.1), (400, 0.01), (3000, 1.0)])
def test_graphs_of_groups_find_every_group(groups, spread):
    rng = np.random.default_rng(groups)
    x = rng.standard_normal((groups, 24))[rng.integers(0, groups, 3000)] + spread * rng.standard_normal((3000, 24))
    shard = hnsw.Shard(hnsw._build(pd.DataFrame({"shard": 0, "vec_id": np.arange(3000), "embedding": list(x)})).iloc[0].to_dict())
    asked = np.arange(0, 3000, 9)
    got = defaultdict(set)
    for q, v, _ in shard.nearest(asked, x[asked], 10, hnsw.BEAM):
        got[q].add(v)
    hits = []
    for q in asked.tolist():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(got[q] & set(np.argsort(d)[:10].tolist())))
    assert min(hits) > 0 and np.mean(hits) >= 9.5


def test_large_components_are_compared(spark):
    rng = np.random.default_rng(3)
    for size in (1e25, 1e200, 1e-200):
        v = rng.standard_normal((50, 8)) * size
        frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = hnsw.search(hnsw.build_index(frame), frame.where("vec_id % 10 = 0"), 10).collect()
        assert len(got) == 50
        for q in range(0, 50, 10):
            far = np.linalg.norm((v - v[q]) / size, axis=1)
            far[q] = np.inf
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [m[1] for m in mine] == np.argsort(far)[:10].tolist()
            assert [m[2] / size for m in mine] == pytest.approx(np.sort(far)[:10])


def test_chats(spark):
    data = [(1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "Fine thanks"), (1, 2, "c", "> How are  YOU?\nme too"), (1, 3, "d", "> > how are you?\n> me too\ngreat"), (1, 4, "e", "last"), (2, 0, "a", None), (2, 1, "b", ""), (None, 1, "x", "hi"), (None, 2, "y", ">hi\n> never said\nyo"), (3, None, None, "> alone")]
    frame = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, seq int")
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(frame).collect()}
    assert len(got) == len(data)
    assert [got[(1, i)].reply_to for i in range(5)] == [None, 0, 0, 2, 3]
    assert [got[(1, i)].position for i in range(5)] == [0, 4, 1, 2, 3]
    assert got[(1, 3)].text == "great" and (got[(1, 3)].n_quoted, got[(1, 3)].n_linked) == (2, 2)
    # two quoted lines in a row are one passage, and nobody said that one
    assert (got[(None, 2)].reply_to, got[(None, 2)].n_quoted, got[(None, 2)].n_linked, got[(None, 2)].text) == (1, 1, 0, "yo")
    assert got[(3, None)].text == "" and got[(3, None)].n_linked == 0
    assert chat.conversations(frame).count() == 4
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_escapes(spark):
    data = [(1, 0, "a|>b", "x <|end|> y <\\\\|end|\\\\> <|user|>\nz")]
    got = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).first().formatted
    assert got.count("<|") == 2 and got.count("|>") == 2 and got.endswith("\n<|end|>")
    back = re.sub(r"\|(\\*)\\>", r"|\1>", re.sub(r"<(\\*)\\\|", r"<\1|", got[got.index("\n") + 1 : -len("\n<|end|>")]))
    assert back == data[0][3]


def quoted_chats(sf):
    """The conversations of a table, in which later messages quote rewrapped passages of earlier ones."""
    table, rng = __import__("pyarrow.parquet").parquet.read_table(f"{sf}/conversations.parquet").to_pylist(), random.Random(4)
    by, out = defaultdict(list), []
    for r in sorted(table, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append(r)
    for conv, rows in by.items():
        for i, r in enumerate(rows):
            text = r["text"] or ""
            if i and rng.random() < 0.6:
                words = (rows[rng.randrange(i)]["text"] or "").split()
                at = rng.randrange(max(1, len(words)))
                words, width = words[at : at + rng.randint(1, 25)], rng.randint(2, 9)
                quote = "\n".join("> " * rng.choice((1, 1, 2)) + " ".join(words[k : k + width]) for k in range(0, len(words), width))
                text = quote + "\n" + text
            out.append((conv, r["turn"], r["role"], text))
    return out


def test_quotes_of_a_whole_table(spark):
    data = quoted_chats("/root/testdata/sf0.01")
    level = lambda line: len(re.sub(r"\s", "", (re.match(r"(?:\s*>)+", line) or [""])[0]))
    by, want = defaultdict(list), {}
    for r in data:
        by[r[0]].append(r)
    for conv, rows in by.items():
        own, replies = [], {}
        for i, (_, turn, _, text) in enumerate(sorted(rows, key=lambda r: r[1])):
            runs = []
            for line in text.split("\n"):
                body = re.sub(r"^(?:\s*>)+", "", line)
                if runs and runs[-1][0] == level(line):
                    runs[-1][1].append(body)
                else:
                    runs.append((level(line), [body]))
            votes, n, linked = defaultdict(int), 0, 0
            for lv, bodies in runs:
                w = "\n".join(bodies).lower().split()
                if not lv or not w:
                    continue
                n += 1
                found = [j for j in range(i) if any(own[j][k : k + len(w)] == w for k in range(len(own[j])))]
                linked += bool(found)
                if found and lv == 1:
                    votes[found[-1]] += len(w)
            own.append(" ".join("\n".join(b) for lv, b in runs if not lv).lower().split())
            replies[i] = max(votes, key=lambda j: (votes[j], j)) if votes else i - 1
            want[(conv, turn)] = [replies[i], n, linked]
        # children of a message come right behind it: the last branch that began later comes after
        turns = sorted(r[1] for r in rows)
        for i, t in enumerate(turns):
            want[(conv, t)][0] = turns[replies[i]] if replies[i] >= 0 else None
    got = {(r.conv_id, r.turn): [r.reply_to, r.n_quoted, r.n_linked] for r in chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 0.3 * len(want)


def test_chat_plan_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    for d in (chat.format_chats(frame), licenses.scan_licenses(frame.selectExpr("conv_id doc_id", "text"))):
        assert not re.search("Python|Pandas|Arrow", d._jdf.queryExecution().executedPlan().toString())


def test_quality(spark, docs, empty):
    got = quality.classify(docs)
    assert got.count() == len(rows()) and got.columns.count("keep") == 1
    assert quality.classify(empty).count() == 0
    sf = "/root/testdata/sf0.01"
    scored = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good_kept, good_all, right, n = scored.agg(F.count_if((F.col("quality") == 1) & F.col("keep")), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) == F.col("keep")), F.count("*")).first()
    assert good_kept >= 0.99 * good_all and right >= 0.98 * n


def test_variety_covers_the_whole_text():
    rng = random.Random(5)
    varied = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1000))
    cycled = " ".join(["some", "few", "words", "again"] * 1500)
    vote = lambda text: quality.votes(quality.signals(text.encode()))[quality.LABELLERS.index("variety")]
    assert vote(varied) == vote(varied + " " + varied) == 1
    assert vote(varied + " " + cycled) == 0 and vote(cycled + " " + varied) == 0


def test_long_texts_train_the_scorer(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(15_000))
    data = [(i, prose() if i % 2 else "@# || !! BUY " * 8_000) for i in range(8)]
    got = quality.classify(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert min(len(t) for _, t in data) > 100_000
    assert all(r.keep == (r.doc_id % 2 == 1) and r.quality_score != 0.5 for r in got)


def test_labeller_model():
    rng = np.random.default_rng(4)
    counts = defaultdict(int)
    for _ in range(5000):
        g = rng.random() < 0.8
        v = [int(g if rng.random() < 0.9 else not g) if rng.random() < 0.8 else 2 for _ in quality.LABELLERS]
        counts[quality._code(v)] += 1
    post, found, share = quality.estimate(dict(counts))
    assert abs(share - 0.8) < 0.1
    assert post[quality._code([1] * 9)] > 0.99 and post[quality._code([0] * 9)] < 0.01


def test_scans():
    data = np.frombuffer(b" ab  c\tab\xff ", np.uint8)
    starts, ends = textscan.word_bounds(data)
    assert list(zip(starts, ends, strict=True)) == [(1, 3), (5, 6), (7, 10)]
    h = textscan.word_hashes(np.frombuffer(b"ab ab abc", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 9]))
    assert h[0] == h[1] != h[2]
    s = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint8)
    for k in (1, 2, 5, 13, 24):
        r = textscan.rolling(s, k)
        assert len({(bytes(s[i : i + k]), int(r[i])) for i in range(len(r))}) == len({bytes(s[i : i + k]) for i in range(len(r))}) == len(set(r.tolist()))
    assert textscan.sliding_min(s, 7).tolist() == [s[i : i + 7].min() for i in range(494)]
