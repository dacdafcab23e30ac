"""Embedding near-duplicates by lattice hashing.

Equal vectors are folded first. Each distinct vector is projected to eight random
directions per table and decoded to the nearest point of the E8 lattice; a vector is kept
at its own cell and asks the neighbouring cells that its remainder leans to. Vectors that
meet in a cell are compared by cosine in double precision, in blocks, inside the task. Every vector
carries the list of all its cells, so a pair is counted where it meets first and nowhere else. A task gives
back what each of its vectors counts, and a link that ties it to its group: as many rows as it
holds vectors, however many pairs there are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces_of
from .graph import components
from .hnsw import usable
from .textscan import mixed

TABLES = 4
PROBES = 4
#: How far apart, in cells, two vectors at the threshold lie after projection: eight directions keep their share of
#: a distance, and all of it where there are eight or fewer.
APART = 0.5
#: Vectors of a cell that one task compares with each other; a larger cell is dealt to more tasks.
CELL_ROWS = 2048
#: Rows of the cells that one task holds at a time.
BUCKET_ROWS = 20_000


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: all (+-2, +-2, 0, ...) and all (+-1, ...) with an even number of minus signs."""
    whole = [np.bincount([i, j], weights=[a, b], minlength=8) for i, j in itertools.combinations(range(8), 2) for a in (2, -2) for b in (2, -2)]
    half = [s for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array([*whole, *half], np.int64)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the worst rounding over."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points, times two: E8 is the even-sum integers and their shift by a half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - b) ** 2).sum(1) < ((y - a) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], b, a)).astype(np.int64)


def cell_scale(dim: int, threshold: float) -> float:
    """Size of the lattice's cells for vectors of so many dimensions."""
    return max(1e-6, float(np.sqrt((2 - 2 * threshold) * 8 / max(dim, 8))) / APART)


def _cell_key(table: int, points: np.ndarray) -> np.ndarray:
    h = np.full(points.shape[:-1], np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    for i in range(8):
        h = (h ^ points[..., i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and neighbouring cells (n, tables, probes) of unit vectors."""
    roots, dim = e8_roots(), x.shape[1]
    own, near = np.empty((len(x), tables), np.int64), np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, t])
        basis = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim]
        y = x @ basis / scale + rng.uniform(0, 2, 8)
        cell = decode_e8(y)
        lean = (y - cell / 2) @ roots.T
        best = np.argpartition(-lean, probes - 1, axis=1)[:, :probes]
        own[:, t] = _cell_key(t, cell)
        near[:, t] = _cell_key(t, cell[:, None] + roots[best])
    return own, near


def _hasher(tables: int, probes: int, scale: float | None, threshold: float, seed: int, kind: str):
    """A row for each table and cell that a vector is kept at or asks, with the list of all of them."""
    names = ["cell", "probe", "id", "label", "n", "tab", "cells", "vector"]

    def run(batches):
        for b in pieces_of(batches, 256):
            offsets = np.asarray(b.column(3).offsets)
            values = np.asarray(b.column(3).flatten(), np.float64)
            lengths = np.diff(offsets)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                x = values[(offsets[rows] - offsets[0])[:, None] + np.arange(dim)]
                labels = np.asarray(b.column(1))[rows].astype(np.int64)
                own, near = _cells(_units(x), tables, probes, scale or cell_scale(dim, threshold), seed)
                salt = (labels * 1_000_003 + dim)[:, None, None]
                cells = np.concatenate([own[:, :, None], near], 2) ^ mixed(salt.astype(np.uint64)).view(np.int64)
                n, each = len(rows), 1 + probes
                at = np.repeat(np.arange(n), tables * each)
                lists = pa.array([c.tobytes() for c in cells], pa.binary())
                vectors = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                tab = np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)
                columns = [cells.ravel(), np.tile(np.arange(each) > 0, n * tables), np.asarray(b.column(0))[rows][at], labels[at], np.asarray(b.column(2))[rows][at], tab]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists.take(pa.array(at)), vectors.take(pa.array(at))], names)

    return run


ROWS = "cell long, probe boolean, id long, label long, n long, tab int, cells binary, vector binary"


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1)[:, None]


def _first_met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs' cell lists (pairs, tables, own cell and those asked): the first table where they
    meet, and whether there a asks b's own cell and b asks a's."""
    asks_b, asks_a = (a[:, :, 1:] == b[:, :, :1]).any(2), (b[:, :, 1:] == a[:, :, :1]).any(2)
    first = ((a[:, :, 0] == b[:, :, 0]) | asks_b | asks_a).argmax(1)
    rows = np.arange(len(a))
    return first, asks_b[rows, first], asks_a[rows, first]


def _tie(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b: top leads every place to the smallest of its group."""
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        if (low == high).all():
            return
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top[:] = top[top]


def _comparer(threshold: float, kind: str, tables: int):
    """Of a bucket's cells: vectors kept in a cell with each other and with those that ask it."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(bytes=pdf["vector"].str.len()).sort_values(["cell", "bin", "bytes"], kind="stable").reset_index(drop=True)
        ids, place = np.unique(pdf["id"].to_numpy(np.int64), return_inverse=True)
        labels, weight, tabs = (pdf[c].to_numpy(np.int64) for c in ("label", "n", "tab"))
        asks, away = pdf["probe"].to_numpy(bool), pdf["part"].to_numpy(np.int64) != 0
        key = pdf[["cell", "bin", "bytes"]].to_numpy(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        links, top = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            base = low + np.flatnonzero(~asks[low:high] & ~away[low:high])
            if high - low < 2 or not len(base):
                continue
            x = _units(np.frombuffer(b"".join(pdf["vector"].iloc[low:high]), kind).reshape(high - low, -1).astype(np.float64))
            cells = np.frombuffer(b"".join(pdf["cells"].iloc[low:high]), np.int64).reshape(high - low, tables, -1)
            for at in range(0, len(base), 256):
                rows = base[at : at + 256]
                i, j = np.nonzero(x[rows - low] @ x.T >= threshold)
                a, b = rows[i], low + j
                ok = (labels[a] == labels[b]) & (place[a] != place[b]) & (asks[b] | (place[a] < place[b]))
                a, b = a[ok], b[ok]
                for part in range(0, len(a), 1 << 16):
                    p, q = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
                    first, asks_q, _ = _first_met(cells[p - low], cells[q - low])
                    # two that ask each other's cell meet in both: it counts where the smaller is kept
                    once = (first == tabs[low]) & ~(asks[q] & asks_q & (place[q] < place[p]))
                    p, q = p[once], q[once]
                    np.add.at(links, place[p], weight[q])
                    np.add.at(links, place[q], weight[p])
                    _tie(top, place[p], place[q])
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": ids[some], "b": ids[top[some]], "links": links[some]})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float | None = None, seed: int = 8) -> DataFrame:
    """Link vectors of equal label whose cosine is at least `threshold`.

    Returns one row per row of (vec_id, embedding, label): vec_id, n_links (other vectors
    linked directly), component_id (smallest vec_id reachable) and kept. Pairs are sought by
    lattice cells, whose size follows from dimension and threshold (`cell_scale`) unless `scale` gives it, so a
    pair may be missed; none below the threshold is linked. Vectors that
    are null, zero or hold null or non-finite components, and rows with a null label, link
    with nothing. Vectors of unlike dimension don't link. Rows that repeat a vec_id are
    vectors of their own under one id; a null vec_id links with nothing and has a null
    component. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    # each distinct vector of a label is a node of its own, whatever ids its rows have
    classes = checkpointed(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    hashed = classes.select("id", "label", "n", "embedding").mapInArrow(_hasher(tables, probes, scale, threshold, seed, kind), ROWS)
    buckets = max(32, classes.count() * tables * (1 + probes) // BUCKET_ROWS)
    # A cell of more than CELL_ROWS vectors: its kept ones are dealt to parts, and every other row visits each part.
    sizes = hashed.where(~F.col("probe")).groupBy("cell").count().where(F.col("count") > CELL_ROWS)
    parts = checkpointed(sizes.select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")))
    if parts.isEmpty():
        placed = hashed.withColumn("bin", F.lit(0)).withColumn("part", F.lit(0))
    else:
        held = hashed.join(parts, "cell", "left").withColumn("parts", F.coalesce(F.col("parts"), F.lit(1)))
        mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        held = held.withColumn("mine", mine).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = held.withColumn("part", F.when(F.col("probe") | (F.col("bin") == F.col("mine")), 0).otherwise(1)).drop("parts", "mine")
    met = checkpointed(placed.withColumn("bucket", F.pmod(F.xxhash64("cell", "bin"), F.lit(buckets))).groupBy("bucket").applyInPandas(_comparer(threshold, kind, tables), "a long, b long, links long"))
    counts = met.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("near"))
    known = checkpointed(classes.join(counts, "id", "left").join(components(met.select("a", "b")).withColumnRenamed("node", "id"), "id", "left"))
    leaders = known.where("component is not null").groupBy("component").agg(F.min("least").alias("leader"))
    known = known.join(leaders, "component", "left").select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("leader", "least").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
