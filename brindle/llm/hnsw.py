"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their id. A shard's graph is built
layer by layer from exact neighbour lists, pruned by the usual diversity rule, and stored as
flat arrays. Lists of nearest neighbours alone fall apart on grouped vectors; so every node is
looked for by a walk from the nearest node of the layer above, and what walks don't find sends a
node up, until all are found. Query blocks stream past every shard; all queries of a block
walk its graph in step. The shards' best are merged by distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, trimmed

SHARD_ROWS = 4096
QUERY_ROWS = 1024
LINKS = 16
CANDIDATES = 48
#: Nodes kept while walking: the lowest layer, and those above.
BEAM, BEAM_ABOVE = 128, 64
#: Nodes kept on the walks that tell what a graph finds.
BEAM_CHECK = 8
#: Up to so many shards their list (16 bytes each) is broadcast to the query blocks.
BROADCAST_SHARDS = 100_000


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _levels(ids: np.ndarray) -> np.ndarray:
    """A node's top layer, from a hash of its id, so that a rebuilt shard is the same."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64), 8)


def _layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbour array (rows of `links`, -1 where fewer) of one layer's vectors."""
    n = len(x)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    k, sq = min(CANDIDATES, n - 1), (x * x).sum(1)
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        d = sq[own, None] + sq[None] - 2 * (x[own] @ x.T)
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n else np.argsort(d, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, 1)
        order = np.argsort(dn, axis=1, kind="stable")
        near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
        v = x[near]
        between = sq[near][:, :, None] + sq[near][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(near.shape, bool)
        for j in range(k):  # a candidate stays if no kept one is nearer to it than the node is
            covered = (kept & (between[:, :, j] < dn[:, j, None])).any(1)
            kept[:, j] = ~covered & (kept.sum(1) < links)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :links]  # kept ones, then the nearest others
        out[own, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
    return out


def _with_reverse(forward: np.ndarray, most: int) -> np.ndarray:
    """Add links back, as far as there is room, so that no node is out of reach."""
    n = len(forward)
    src = np.repeat(np.arange(n), forward.shape[1])
    dst = forward.ravel()
    ok = dst >= 0
    pairs = np.concatenate([np.stack([src[ok], dst[ok]], 1), np.stack([dst[ok], src[ok]], 1)])
    tag = np.repeat([0, 1], [ok.sum(), ok.sum()])
    order = np.lexsort((tag, pairs[:, 1], pairs[:, 0]))
    pairs, tag = pairs[order], tag[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs, tag = pairs[first], tag[first]
    order = np.lexsort((tag, pairs[:, 0]))
    pairs = pairs[order]
    start = np.searchsorted(pairs[:, 0], np.arange(n))
    slot = np.arange(len(pairs)) - start[pairs[:, 0]]
    out = np.full((n, most), -1, np.int32)
    fits = slot < most
    out[pairs[fits, 0], slot[fits]] = pairs[fits, 1]
    return out


def _lost(x: np.ndarray, graph: np.ndarray, above: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """The nodes of those sought that a walk from the nearest node above doesn't find."""
    out, rows = [], np.arange(len(x))
    sq = (x[above] ** 2).sum(1)
    for at in range(0, len(sought), 512):
        own = sought[at : at + 512]
        entry = above[(sq - 2 * (x[own] @ x[above].T)).argmin(1)]
        found, _ = _walk(x[own], x, graph, np.append(rows, -1), entry[:, None], BEAM_CHECK)
        out.append(own[(found != own[:, None]).all(1)])
    return np.concatenate(out)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id").reset_index(drop=True)
    ids = pdf["vec_id"].to_numpy(np.int64)
    raw = np.array(pdf["embedding"].tolist(), np.float64)
    vectors, inverse = np.unique(raw, axis=0, return_inverse=True)  # equal vectors are one node
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(vectors) + 1))
    level = _levels(ids[order][starts[:-1]])
    x, names, links = vectors / np.abs(vectors).max(), [], []  # so that no square overflows
    nodes, k = np.arange(len(x)), 0
    while True:
        graph = _with_reverse(_layer(x[nodes], LINKS), 2 * LINKS)
        links.append(np.where(graph >= 0, nodes[graph], -1).astype(np.int32))
        names.append(nodes.astype(np.int32))
        lost = np.arange(len(nodes))
        while len(lost):
            up = np.flatnonzero(level[nodes] > k)
            if len(up):
                lost = _lost(x[nodes], graph, up, lost)
            lost = lost[level[nodes[lost]] <= k]
            level[nodes[lost[:1]]] = k + 1
        above = nodes[level[nodes] > k]
        if len(above) in (1, len(nodes)):  # one entry is enough; where no node links to another all are entries
            break
        nodes, k = above, k + 1
    row = {"shard": int(pdf["shard"].iloc[0]), "dim": vectors.shape[1], "ids": ids[order].tobytes(), "starts": starts.astype(np.int64).tobytes(), "vectors": vectors.tobytes(), "layer_sizes": [len(n) for n in names], "entries": above.astype(np.int32).tobytes(), "nodes": np.concatenate(names).tobytes(), "neighbours": np.concatenate(links).tobytes()}
    return pd.DataFrame([row])


INDEX = "shard long, dim int, ids binary, starts binary, vectors binary, layer_sizes array<int>, entries binary, nodes binary, neighbours binary"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its graph as flat arrays, over every usable row of (vec_id, embedding).

    Rows with a null id, or a vector that is null, zero or holds null or non-finite
    components, take no part. Vectors of unlike dimension come into unlike shards. Repeated
    rows are candidates of their own. An empty table gives an empty index.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    rows = rows.withColumn("shard", F.size("embedding").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_build, INDEX)


def _walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, row_of: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """All queries walk one layer in step; returns the nodes of each beam and their distances."""
    n, qs = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n + 1), bool)
    ids = np.full((len(q), beam), n, np.int64)
    dist = np.full((len(q), beam), np.inf)
    done = np.zeros((len(q), beam), bool)
    for j in range(start.shape[1]):
        node = start[:, j]
        fresh = (node < n) & ~seen[qs, node]
        ids[:, j] = np.where(fresh, node, n)
        diff = q - x[np.minimum(node, n - 1)]
        dist[:, j] = np.where(fresh, np.einsum("qd,qd->q", diff, diff), np.inf)
        seen[qs, node] = True
    while True:
        open_ = np.where(done | ~np.isfinite(dist), np.inf, dist)
        best = open_.argmin(1)
        live = np.flatnonzero(np.isfinite(open_[qs, best]))
        if not len(live):
            return ids, dist
        done[live, best[live]] = True
        near = links[row_of[ids[live, best[live]]]].astype(np.int64)
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near] & (near < n)
        seen[live[:, None], near] = True
        diff = x[np.minimum(near, n - 1)] - q[live, None]
        d = np.where(fresh, np.einsum("qkd,qkd->qk", diff, diff), np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        part = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live] = np.take_along_axis(all_d, part, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, n)], 1), part, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(d.shape, bool)], 1), part, 1)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; differences whose squares leave its range are scaled first."""
    diff = np.abs(x - q)
    out = np.sqrt((diff**2).sum(1))
    top = diff.max(1, initial=0)
    odd = np.flatnonzero(~np.isfinite(out) | ((out < 1e-140) & (top > 0)))
    out[odd] = top[odd] * np.sqrt(((diff[odd] / top[odd, None]) ** 2).sum(1))
    return out


class Shard:
    """A shard's graph as flat arrays, ready for walks."""

    def __init__(self, row: dict):
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.scale = float(np.abs(self.vectors).max())
        self.x = self.vectors / self.scale
        cuts = np.cumsum(row["layer_sizes"])[:-1]
        self.nodes = np.split(np.frombuffer(row["nodes"], np.int32), cuts)
        self.links = np.split(np.frombuffer(row["neighbours"], np.int32).reshape(-1, 2 * LINKS), cuts)
        self.entries = np.frombuffer(row["entries"], np.int32).astype(np.int64)

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(query, vector id, distance) of the k nearest found of each query, but for its own id."""
        n = len(self.x)
        # far outside the shard all directions are alike, so a query's reach is held where squares are safe
        q = np.clip(queries / self.scale, -1e150, 1e150)
        start = np.tile(self.entries, (len(q), 1))
        for layer in range(len(self.nodes) - 1, -1, -1):
            row_of = np.full(n + 1, -1, np.int64)
            row_of[self.nodes[layer]] = np.arange(len(self.nodes[layer]))
            wide = max(beam if layer == 0 else BEAM_ABOVE, start.shape[1])
            start, _ = _walk(q, self.x, self.links[layer], row_of, start, wide)
        out = []
        for name, query, got in zip(names.tolist(), queries, start, strict=True):
            got = got[got < n]
            score = _distances(self.vectors[got], query)
            rows, held = [], 0
            for j in np.argsort(score, kind="stable").tolist():
                if held >= k and score[j] > rows[-1][0]:
                    break
                mine = [v for v in self.ids[self.starts[got[j]] : self.starts[got[j] + 1]][: k + 1].tolist() if v != name]
                rows += [(float(score[j]), v) for v in mine]
                held += len(mine)
            out += [(name, v, s) for s, v in sorted(rows)[:k]]
        return out


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searcher(k: int, beam: int):
    """Rows come sorted by shard, each shard's graph before the query blocks that visit it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["graph"] is not None:
                    shard, at = Shard(row["graph"]), row["shard"]
                elif at == row["shard"]:
                    names = np.frombuffer(row["names"], np.int64)
                    found = shard.nearest(names, np.frombuffer(row["queries"], np.float64).reshape(len(names), -1), k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t.type) for c, t in enumerate(_FOUND)], schema=_FOUND)

    return search


def _blocks(t: pa.Table) -> pa.Table:
    names = t["vec_id"].to_numpy()
    order = np.argsort(names, kind="stable")
    vectors = np.array(t["embedding"].to_pylist(), np.float64)[order]
    return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "names": pa.array([names[order].tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())})


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest found of each query's own id and vector, by Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score (the distance in double precision), with
    ties in order of vec_id. A row with the query's own id is never its neighbour. Unusable
    queries give no rows; a vec_id that repeats is asked once, with its smallest vector.
    Finite components of any size are compared.
    """
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = checkpointed(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")))
    index = checkpointed(index)
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.struct("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("turn")))
    packed = checkpointed(asked.groupBy("block").applyInArrow(trimmed(_blocks), "dim int, names binary, queries binary"))
    # each block of the stated queries visits each shard of its dimension
    shards = index.select("shard", F.col("dim").alias("d"))
    few = shards.count()
    visits = packed.join(F.broadcast(shards) if few <= BROADCAST_SHARDS else shards, F.col("dim") == F.col("d")).select("shard", F.lit(1).alias("turn"), F.lit(None).cast(index.drop("shard").select(F.struct("*").alias("g")).schema["g"].dataType).alias("graph"), "names", "queries")
    graphs = index.select("shard", F.lit(0).alias("turn"), F.struct(*(c for c in index.columns if c != "shard")).alias("graph"), F.lit(None).cast("binary").alias("names"), F.lit(None).cast("binary").alias("queries"))
    met = graphs.unionByName(visits).repartition(max(1, few), "shard").sortWithinPartitions("shard", "turn")
    found = met.mapInArrow(_searcher(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
