"""Embedding near-dedup: recall at the threshold over dimensions, and whole links against brute force."""

import numpy as np
import pytest

from brindle.llm import lattice

THRESHOLD = 0.98


def turned(rng, a, cosine):
    """Unit vectors at the cosine from those of a."""
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    return cosine * a + np.sqrt(1 - cosine**2) * lattice._units(side)


@pytest.mark.parametrize("dim", [2, 3, 4, 8, 12, 16, 24, 64, 384, 768])
@pytest.mark.parametrize("threshold", [0.9, THRESHOLD, 0.999])
def test_pairs_at_the_threshold_meet(dim, threshold):
    rng = np.random.default_rng(dim)
    a = lattice._units(rng.standard_normal((1500, dim)))
    b = turned(rng, a, threshold + 1e-9)
    scale = lattice.cell_scale(dim, threshold)
    (x, u), (y, v) = (lattice._cells(each, lattice.TABLES, lattice.PROBES, scale, 8) for each in (a, b))
    met = (x == y) | (u == y[:, :, None]).any(2) | (v == x[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.99
    # and cells stay small: vectors at random share few
    if dim >= 64 and threshold >= THRESHOLD:
        assert len(np.unique(x[:, 0])) > 1200


def linked(rows):
    """Links, smallest reachable id, by id, of rows (id, vector, label)."""
    n, top = dict.fromkeys((r[0] for r in rows), 0), {r[0]: r[0] for r in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= THRESHOLD, 1)), strict=True):
            a, b = own[i][0], own[j][0]
            n[a] += 1
            n[b] += 1
            low, high = sorted((root(a), root(b)))
            top[high] = low
    return {i: (n[i], root(i)) for i in n}


def test_links_of_turned_embeddings(spark):
    """The given vectors hold no near pair; turned copies of them do, above and just below the threshold."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 200").collect()
    rng = np.random.default_rng(3)
    x = lattice._units(np.array([r.embedding for r in given], np.float64))
    rows = [(r.vec_id, v.tolist(), r.label) for r, v in zip(given, x, strict=True)]
    for turn, cosine in enumerate((0.9801, 0.99, 0.9799)):
        rows += [(10_000 * (turn + 1) + r.vec_id, v.tolist(), r.label) for r, v in zip(given, turned(rng, x, cosine), strict=True)]
    want = linked(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), THRESHOLD).collect()}
    assert sum(n for n, _ in want.values()) >= 800
    found = sum(got[i][0] for i in got)
    assert found >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("dim", [3, 8])
def test_links_in_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    a = lattice._units(rng.standard_normal((150, dim)))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([a, turned(rng, a, 0.981)]))]
    want = linked(rows)
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), THRESHOLD).collect()}
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want.values()) > 0
