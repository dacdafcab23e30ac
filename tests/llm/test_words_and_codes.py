"""Spelling variants, the language model and vector codes against brute force, with every odd row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import codes, kneserney, queries, spelling

lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
EXTRA = ", word string, n int, form string, root string, key long, score string, n_tokens string, held_out string, perplexity int"


def frame(spark, rows):
    """Texts beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "f", "r", 2, "s", "t", "h", 3) for r in rows], "doc_id long, text string" + EXTRA).repartition(3, "text")


# ---- spelling variants


def spelled(rows, period=97):
    count = collections.Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % period == 0 else w] += 1
    words = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def spelling_rows():
    rng = random.Random(5)
    parts = ["ab", "ba", "an", "na", "é", "z", "Th", "in", "ð"]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(250))) for i in range(80)]
    long_ = "x" * 5000
    rows += [(None, "banana banana banana bananna bananna Bananna ananas"), (5, None), (6, ""), (7, f"{long_} {long_} {long_}x"), (8, f"{long_} " * 2 + f"{long_}x " * 5)]
    rows += [(9, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaab aaaaab aaaaab"), (9, "aaaaa caaaa-caaaa中caaaa baaaa baaaa baaaa")]
    return rows


@pytest.mark.parametrize("tile", [spelling.TILE_ROWS, 40])
def test_spelling_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_ROWS", tile)
    rows = spelling_rows()
    got = spelling.group_spellings(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = spelled(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] is not None and r[1] != r[2] for r in want)


def test_spelling_small_bounds_and_blocks(spark, monkeypatch):
    rows = [(i, "hello hallo hullo helo hello world word wordy") for i in range(4)]
    monkeypatch.setattr(spelling, "ENTRIES", 3)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 7)
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    assert sorted(tuple(r) for r in spelling.group_spellings(frame(spark, rows)).collect()) == spelled(rows)


def test_spelling_of_nothing(spark):
    assert spelling.group_spellings(frame(spark, []).limit(0)).count() == 0
    assert spelling.group_spellings(frame(spark, [(1, None), (2, "one two")])).count() == 0


def test_overlap_bound_holds():
    """No two words at one edit share fewer grams than the bound, and their prefixes meet."""
    rng = random.Random(1)
    pairs = np.zeros((256, 256), np.int64)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 14)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "d" + a[i + 1 :]])
        if len(b) < 5:
            continue
        q, m = spelling.gram_length(len(a)), len(a)
        keys = []
        shared = collections.Counter(a[i : i + q] for i in range(m - q + 1)) & collections.Counter(b[i : i + q] for i in range(len(b) - q + 1))
        assert sum(shared.values()) >= spelling.overlap_bound(m) >= 2
        for w in (a, b):
            letters = np.frombuffer(w.encode(), np.uint8).reshape(1, -1)
            at = np.nonzero(spelling._prefix(letters, q, pairs)[0])[0]
            grams = spelling._grams(letters, q)[0, at].tolist()
            keys.append({(g, p + s) for g, p in zip(grams, at.tolist(), strict=True) for s in ((0,) if len(w) == m else (0, 1))})
        assert keys[0] & keys[1]


# ---- language model


def tokens(text):
    return [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [" "]


def modelled(texts, learned, order):
    top, seen = collections.Counter(), collections.Counter()
    for text in learned:
        w = [""] * (order - 1) + tokens(text)
        for i in range(order - 1, len(w)):
            top[tuple(w[i - order + 1 : i + 1])] += 1
            seen[w[i]] += 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter()
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if k > 1 and g[1] == "" else 1
    off, after = {}, {}
    for k, table in counts.items():
        n, off[k] = collections.Counter(table.values()), [0, 0.5, 1.0, 1.5]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            for j in (1, 2, 3):
                d = j - (j + 1) * y * n[j + 1] / n[j]
                if 0 < d < j:
                    off[k][j] = d
        after[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in table.items():
            after[k][g[:-1]][0] += c
            after[k][g[:-1]][min(c, 3)] += 1

    def chance(g):
        k = len(g)
        low = chance(g[1:]) if k > 1 else 1 / (len(seen) + 1)
        e = after[k].get(g[:-1])
        c = counts[k].get(g, 0)
        return low if not e else (max(c - off[k][min(c, 3)], 0) + sum(off[k][j] * e[j] for j in (1, 2, 3)) * low) / e[0]

    total = sum(seen.values())
    for text in texts:
        w = [""] * (order - 1) + tokens(text)
        ends = range(order - 1, len(w))
        base = sum(math.log10((seen[w[i]] + 1) / (total + 1 * (len(seen) + 1))) for i in ends)
        yield len(w) - order + 1, sum(seen[w[i]] > 0 for i in ends), base, sum(math.log10(chance(tuple(w[i - order + 1 : i + 1]))) for i in ends), total, chance


def lm_rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(None, "a b c"), (500, None), (501, "zzz yyy"), (502, "a b " * 4000), (502, "a\tB")]


@pytest.mark.parametrize(("order", "shard", "ways"), [(1, 12_000_000, 512), (2, 12_000_000, 512), (2, 300, 4), (3, 300, 4)])
def test_language_model(spark, monkeypatch, order, shard, ways):
    monkeypatch.setattr(kneserney, "WAYS", ways)
    monkeypatch.setattr(kneserney, "BLOCK", 500)
    monkeypatch.setattr(kneserney, "LOOKUP", 700)
    rows = lm_rows()
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    assert 0 < sum(held) < len(rows)
    df = frame(spark, rows)
    model = kneserney.train(df, order, ~kneserney.held_out(F.col("doc_id")), shard)
    got = kneserney.score(df, model)
    assert set(df.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text, r.n_tokens, r.n_known, r.base_score, r.score) for r in got.collect()), key=key)
    model.delete()
    want = sorted(((*r, *w) for r, w in zip(rows, modelled([t for _, t in rows], [t for (_, t), h in zip(rows, held, strict=True) if not h], order), strict=True)), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:6], rel=1e-9) and model.tokens == w[6]


def test_language_model_is_a_distribution(spark):
    """After any words, the chances of all known words, the end and one unknown word add to one."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c c a", None, "a b b"])]
    model = kneserney.train(frame(spark, rows), 2)
    for before in ("a", "q", "b"):
        h = kneserney._tokens(before.encode())[0]
        last = np.concatenate([kneserney._tokens(b"a b c zz")])
        p, _ = kneserney._probabilities(model, np.stack([np.full(len(last), h), last]))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()
    model.delete()


def test_language_model_of_nothing(spark):
    nothing = frame(spark, []).limit(0)
    model = kneserney.train(nothing)
    assert kneserney.score(nothing, model).count() == 0
    got = kneserney.score(frame(spark, [(1, "a b")]), model).first()
    assert (got.n_tokens, got.n_known, got.base_score, got.score) == (3, 0, 0.0, 0.0)
    model.delete()


def test_order_helps_on_text_that_repeats(spark):
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(9)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(lines, 5))) for i in range(200)]
    df = frame(spark, rows)
    model = kneserney.train(df, 2, ~kneserney.held_out(F.col("doc_id")))
    got = kneserney.score(df, model).where(kneserney.held_out(F.col("doc_id"))).agg(F.sum("score"), F.sum("base_score")).first()
    model.delete()
    assert got[0] > 0.5 * got[1]


# ---- vector codes


def coded(rows):
    """rows: (id, vector, label), kept ones, in order of id."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1])
    kept = [(i, [*v, *[0] * (-width % 16)], label) for i, v, label in kept if len(v) == width]
    span = len(kept[0][1]) // 16
    part = lambda v, p: v[p * span : (p + 1) * span]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]

    def nearest(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)) for e in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(2):
        chosen = [[nearest(p, v)[0] for _, v, _ in kept] for p in range(16)]
        for p in range(16):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, chosen[p], strict=True) if c == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        best = [nearest(p, v) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for e, _ in best), sum(d for _, d in best), label))
    total = collections.Counter()
    for _, _, d, label in out:
        total[label] += d
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, c, fits(d), fits(total[label]), sha) for i, c, d, label in out]


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, v int, total int, of string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", 1, 2, "o") for r in rows], SCHEMA).repartition(3)


def vector_rows(width, n=150, scale=1.0):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(20, width)) * scale
    x = [(i * 2, (base[i % 20] + rng.normal(size=width) * 0.1 * scale).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    return x + [(i * 2 + 1, x[0][1], 1) for i in range(40)]


@pytest.mark.parametrize("width", [16, 64, 96, 10, 33])
def test_vector_codes(spark, width):
    rows = sorted(vector_rows(width))
    odd = [(9001, None, 0), (9002, [None] * width, 0), (9003, [float("nan")] * width, 1), (9004, [float("inf")] + [0.0] * (width - 1), 1)]
    got = codes.compress(vectors(spark, rows + odd))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == coded(rows)


def test_vector_codes_of_any_size(spark):
    rng = np.random.default_rng(0)
    rows = sorted(vector_rows(32, 70)) + [(1000 + i, (rng.normal(size=32) * 10.0 ** (i * 4)).tolist(), i % 2) for i in range(9)] + [(1100, [1e300] * 32, 7), (1101, [-1e300] * 32, None)]
    got = codes.compress(vectors(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == coded(rows)
    first = [(i, [1e25 * x for x in v] if i < 9 else v, label) for i, v, label in rows]
    assert sorted(tuple(r) for r in codes.compress(vectors(spark, first)).collect()) == coded(first)


def test_vector_codes_of_few_and_unlike_rows(spark):
    assert codes.compress(vectors(spark, []).limit(0)).count() == 0
    assert codes.compress(vectors(spark, [(1, None, 2)])).count() == 0
    got = {r.vec_id: r for r in codes.compress(vectors(spark, [(1, [1.0] * 16, None), (2, [1.0] * 17, None), (3, [], None), (None, [1.0] * 16, 4)])).collect()}
    assert set(got) == {1, 2, 3, None} and got[2].code is None and got[3].error is None
    assert got[1].code == got[None].code == "00" * 16 and got[1].error == got[1].label_error == 0
    assert codes.compress(vectors(spark, [(1, [], 0), (2, [], 0)])).first().error == 0


@pytest.mark.parametrize("width", [1, 2, 4, 7, 48])
def test_bounds_lose_nothing(width):
    rng = np.random.default_rng(width)
    for scale in (3, 400, 40_000):
        entries = rng.integers(-scale, scale, (64, width))
        entries[40:] = entries[:24]  # ties
        p = np.concatenate([rng.integers(-scale, scale, (200, width)), entries + rng.integers(-1, 2, entries.shape), entries])
        d = ((p[:, None] - entries[None]) ** 2).sum(2)
        best, error = codes.Book(entries.astype(object)).nearest(p)
        assert (best == d.argmin(1)).all() and (error == d.min(1)).all()


def test_queries_of_the_round(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op11_spelling_variants", "op12_lm_scoring", "op13_vector_codes"):
        assert queries.QUERIES[name](spark, sf).count() > 0 and name in queries.ORACLE_SQL
