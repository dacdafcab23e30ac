"""Every stage of the pipeline against its operator's own rule."""

import re

import corpus_pipeline
from brindle.llm import jaccard, mixing


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((before, docs.collect()))
        if i < 4:
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = seen[0]
    kept = {r.doc_id for r in after}
    right = [(d in kept) == (labels[d] == 1) for d in before if d in labels]
    assert sum(right) >= 0.97 * len(right)
    before, after = seen[1]
    sets = {}
    for d, r in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == [d for d in ids if root(d) == d]
    before, after = seen[2]
    windows = {}
    text = {d: re.findall(r"[^\x20\x09-\x0D]+", r.text) for d, r in before.items()}
    for d in sorted(text):
        for i in range(len(text[d]) - 12):
            windows.setdefault(tuple(text[d][i : i + 13]), d)
    for r in after:
        w = text[r.doc_id]
        gone = set()
        for i in range(len(w) - 12):
            if windows[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        assert r.text == " ".join(x for i, x in enumerate(w) if i not in gone) and r.n_chars == len(r.text)
    before, after = seen[3]
    assert {r.doc_id for r in after} <= set(before)
    times = {d: sum(r.doc_id == d for r in after) for d in before}
    assert max(times.values()) <= 2
    words = lambda r: len(r.text.split())
    assert abs(sum(map(words, after)) - 1.5 * sum(map(words, before.values()))) < 0.05 * sum(map(words, before.values()))
    before, after = seen[4]
    assert {r.doc_id for r in after} == set(before)
    assert sum(r.piece == 0 for r in after) == len(seen[3][1])


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    assert callable(jaccard.keep_one) and callable(mixing.mix)
