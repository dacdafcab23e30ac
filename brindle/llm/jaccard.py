"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

1. Blocks of documents send their shingles' hashes to buckets, which count the documents of
   each shingle over the whole corpus and answer with those that more than one holds. A
   shingle of one document can't join anything; of these a document needs only their number.
2. A document's shared shingles, rarest first, after its own ones, are its prefix order.
   Documents whose prefix holds a shared shingle meet in that shingle's group; a group is
   recorded as links to its first document, so it never becomes pairs.
3. Components of those links are clusters of documents that could be linked at all. Inside a
   cluster only sets of nearby sizes can be linked, so it falls into bands of size that meet the
   next band only. A band is joined in one task, or, if it is too large for one, in tasks for each
   two of its parts. Inside, length, positional and, for long sets, suffix filters come before
   verification. Every pair that they leave is verified, and counts as a link of both.
4. Components of the verified links, and the links of each document, give the result.

Equal sets are one class, weigh as many as they are, and are expanded at the end only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, checkpointed, give_back, order_id, pieces_of, trimmed, utf8
from .graph import components
from .passages import _bucket, _groups, _long, _short
from .textscan import LOWER, from_planes, mixed, planes, rolling, word_bounds, word_hashes

BUCKET_SHINGLES = 1 << 19
BLOCK_BYTES = 2 << 20
#: Documents and bytes of sets that one tile holds from each of its two parts.
PART_DOCS = 512
PART_BYTES = 16 << 20
#: The suffix filter is for sets of so many shingles; shorter ones are verified as fast.
LONG_SET = 8_192
#: Up to so many ids (8 bytes each) are broadcast to drop their rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    grams = rolling(words, width)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= width:
            out.append(np.unique(grams[s : e - width + 1]))
        elif e > s:
            out.append(rolling(words[s:e], e - s) ^ mixed(np.full(1, e - s, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SENT = "bucket long, block long, kind int, a binary, b binary, c binary, d binary"


def _send(width: int, buckets: int):
    """Of each block one head row (ids, set sizes and two sums that name the set), and for each bucket its shingles and whose they are."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in "abcd")])

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, size = at, 0
                column = batch.column(1)
                while part < batch.num_rows and (size < BLOCK_BYTES or part == at) and part - at < 16_384:
                    size += len(column[part].as_buffer() or b"")
                    part += 1
                t = batch.slice(at, part - at)
                at = part
                sets = shingle_sets(t.column(1).to_pylist(), width)
                sizes = np.array([len(s) for s in sets], np.int32)
                h = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), sizes).astype(np.uint16)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (h, mixed(h + np.uint64(1)))]
                names = [planes((s[edge[1:]] - s[edge[:-1]]).astype(np.uint64)) for s in sums]
                rows = [[int(_bucket(np.full(1, turn, np.uint64), buckets)[0]), turn, 0, planes(np.asarray(t.column(0), np.int64)), planes(sizes), names[0], names[1]]]
                order = np.lexsort((h, _bucket(h, buckets)))
                h, doc, b = h[order], doc[order], _bucket(h, buckets)[order]
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
                rows += [[int(b[s]), turn, 1, _short(h[s:e]), planes(doc[s:e]), b"", b""] for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                turn += 1
                give_back()

    return run


def _count(t: pa.Table) -> pa.Table:
    """Document counts of a bucket's shingles; each block gets its shared ones back. Head rows pass through."""
    kinds, blocks = t["kind"].to_pylist(), t["block"].to_pylist()
    out = [(blocks[i], 0, *(t[c][i].as_py() for c in "abcd")) for i, k in enumerate(kinds) if k == 0]
    at = [i for i, k in enumerate(kinds) if k == 1]
    if at:
        hashes = [_long(t["a"][i].as_py()) for i in at]
        docs = [from_planes(t["b"][i].as_py(), np.uint16) for i in at]
        h = np.concatenate(hashes)
        order, edge = _groups(h)
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(np.diff(edge), np.diff(edge))
        s = 0
        for i, own, doc in zip(at, hashes, docs, strict=True):
            n = count[s : s + len(own)]
            s += len(own)
            keep = n > 1
            if keep.any():
                # rarity class in the top bits, then the hash: one number that sorts rarest first
                rank = np.floor(np.log2(n[keep])).astype(np.uint64) << np.uint64(58)
                out.append((blocks[i], 1, planes(rank | own[keep]), planes(doc[keep]), b"", b""))
    names = ["to", "kind", "a", "b", "c", "d"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _assemble(t: pa.Table) -> pa.Table:
    """A block's documents: id, set size, set name and shared shingles, rarest first."""
    rows = t.to_pylist()
    head = next(r for r in rows if r["kind"] == 0)
    ids, sizes = from_planes(head["a"], np.int64), from_planes(head["b"], np.int32)
    names = [from_planes(head[c], np.uint64).view(np.int64) for c in "cd"]
    parts = [r for r in rows if r["kind"] == 1]
    shared = np.concatenate([from_planes(r["a"], np.uint64) for r in parts]) if parts else np.zeros(0, np.uint64)
    doc = np.concatenate([from_planes(r["b"], np.uint16) for r in parts]) if parts else np.zeros(0, np.uint16)
    order = np.lexsort((shared, doc))
    shared, edge = shared[order], np.searchsorted(doc[order], np.arange(len(ids) + 1))
    sets = [shared[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table([pa.array(ids), pa.array(sizes.astype(np.int64)), pa.array(names[0]), pa.array(names[1]), pa.array(sets, pa.binary())], names=["id", "n", "name1", "name2", "shared"])


def _prefix(n: int, shared: int, share: int) -> int:
    """How many of the shared shingles stand in the prefix, after those of the document alone."""
    return max(0, min(shared, n - -(-share * n // 100) + 1 - (n - shared)))


def _prefixes(share: int):
    def run(batches):
        for b in pieces_of(batches):
            ids, hashes = [], []
            for i, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                k = _prefix(n, len(data) // 8, share)
                if k:
                    hashes.append(np.frombuffer(data, np.int64, k))
                    ids.append(np.full(k, i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))], ["gram", "id"])

    return run


def _overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Suffix filter: a bound on the common items of two sorted arrays by halving one twice."""

    def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if not depth or len(a) < 4 or len(b) < 4:
            return min(len(a), len(b))
        mid = len(a) // 2
        at = int(np.searchsorted(b, a[mid]))
        return bound(a[:mid], b[:at], depth - 1) + bound(a[mid:], b[at:], depth - 1)

    return bound(a, b, 2)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def join_cluster(sizes: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, apart: bool, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of a cluster the weight of all that it links with, and one set of its component.

    Sets come shortest first. Each meets the earlier ones that share a shingle of both
    prefixes, and every such pair that the filters leave is verified once. With `apart` only
    sets of unlike side are compared.
    """
    order = np.lexsort((np.arange(len(sizes)), sizes))
    size, weight, side = sizes[order], weights[order], side[order]
    own = np.array([len(sets[i]) for i in order])
    edge = np.concatenate([[0], np.cumsum(own)])
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    # the sets of each prefix shingle, shortest first; up to `fill` they have come
    prefix = np.array([_prefix(int(n), int(k), share) for n, k in zip(size, own, strict=True)])
    doc = np.repeat(np.arange(len(size)), prefix)
    place = _ranges(np.zeros(len(size), np.int64), prefix)
    gram = codes[edge[doc] + place]
    by_gram = np.argsort(gram, kind="stable")
    doc, place = doc[by_gram], place[by_gram]
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    start = np.searchsorted(gram[by_gram], np.arange(len(mark)))
    fill = start.copy()
    total, top = np.zeros(len(size), np.int64), np.arange(len(size))
    for a in range(len(size)):
        mine = codes[edge[a] : edge[a + 1]]
        pre = mine[: prefix[a]]
        s, e = start[pre], fill[pre]
        at = _ranges(s, e)
        np.add.at(fill, pre, 1)
        if not len(at):
            continue
        # the first shingle that both hold: in either's order none before it is shared
        first = np.full(a + 1, -1)
        first[doc[at[::-1]]] = np.arange(len(at) - 1, -1, -1)
        b = np.flatnonzero(first >= 0)
        i, j = np.repeat(np.arange(len(pre)), e - s)[first[b]], place[at[first[b]]]
        need = -(-share * (size[a] + size[b]) // (100 + share))
        fits = (100 * size[b] >= share * size[a]) & (np.minimum(own[a] - i, own[b] - j) >= need) & (b < a)
        if apart:
            fits &= side[b] != side[a]
        b, need = b[fits], need[fits]
        if own[a] >= LONG_SET:
            fits = [_overlap_bound(mine, codes[edge[x] : edge[x + 1]]) >= n for x, n in zip(b.tolist(), need.tolist(), strict=True)]
            b = b[np.array(fits, bool)]
        if not len(b):
            continue
        mark[mine] = True
        sums = np.concatenate([[0], np.cumsum(mark[codes[_ranges(edge[b], edge[b + 1])]])])
        mark[mine] = False
        common = np.diff(sums[np.concatenate([[0], np.cumsum(own[b])])])
        b = b[100 * common >= share * (size[a] + size[b] - common)]
        total[a] += weight[b].sum()
        total[b] += weight[a]
        for x in np.unique(top[b]).tolist():
            top[top == x] = top[a]
    out, root = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    out[order], root[order] = total, order[top]
    return out, root


def _join_tiles(share: int):
    """The tiles of one key: sets of a cluster and a pair of bands or parts."""

    def tile(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("name1", "ascending"), ("name2", "ascending")])
        sets = [np.frombuffer(x, np.uint64) for x in t["shared"].to_pylist()]
        column = lambda c: t[c].to_numpy()
        links, top = join_cluster(column("n"), sets, column("rows"), column("side"), t["apart"][0].as_py(), share)
        ids, some = column("id"), np.flatnonzero(links)
        return pa.table([ids[some], ids[top[some]], *(column(c)[some] for c in ("n", "name1", "name2")), links[some]], names=["a", "b", "n", "name1", "name2", "links"])

    def run(t: pa.Table) -> pa.Table:
        keys = t.group_by(_TILE).aggregate([]).to_pylist()
        if len(keys) == 1:
            return tile(t)
        out = []
        for key in keys:  # tiles whose hashes agree
            mask = pa.array(np.logical_and.reduce([t[c].to_numpy() == v for c, v in key.items()]))
            out.append(tile(t.filter(mask)))
        return pa.concat_tables(out)

    return run


_TILE = ["cluster", "band", "low", "high"]
_NAME = ["n", "name1", "name2"]


def _linked(rows: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): the set of each row (id, n, name1, name2), the links of the rows of each set
    that has any (n, name1, name2, n_links), and the component (node, component) of linked ids."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, size // 7 // BUCKET_SHINGLES)
    sent = rows.mapInArrow(_send(width, buckets), _SENT)
    counted = sent.groupBy("bucket").applyInArrow(trimmed(_count), "to long, kind int, a binary, b binary, c binary, d binary")
    sets = checkpointed(counted.groupBy("to").applyInArrow(trimmed(_assemble), "id long, n long, name1 long, name2 long, shared binary"))

    classes = checkpointed(sets.where("n > 0").groupBy(*_NAME).agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    # one row of each class carries its set on
    heads = sets.where(F.octet_length("shared") > 0).join(classes.withColumnRenamed("first", "id"), [*_NAME, "id"]).dropDuplicates([*_NAME, "id"]).select("id", *_NAME, "rows", "shared")
    grams = checkpointed(heads.select("id", "n", "shared").mapInArrow(_prefixes(share), "gram long, id long").distinct())
    first = grams.groupBy("gram").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").select("gram", "lead")
    clusters = components(grams.join(first, "gram").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    members = checkpointed(heads.join(clusters, F.col("id") == F.col("node")).select("id", *_NAME, "rows", "shared", F.col("component").alias("cluster")))
    few = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    extent = lambda d, *key: d.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / PART_DOCS), F.ceil(F.sum(F.octet_length("shared")) / PART_BYTES)).cast("int").alias("parts"))
    large = checkpointed(extent(members, "cluster").where("parts > 1").select("cluster", F.lit(True).alias("large")))
    # sets of linked documents differ in size by the share at most: by one band or none
    band = F.floor(F.log(F.col("n").cast("double")) / (-math.log(share / 100) * (1 + 1e-9))).cast("int")
    members = members.join(few(large), "cluster", "left").withColumn("own", F.when(F.col("large"), band))
    whole = members.where("large is null").select("id", *_NAME, "rows", "shared", "cluster", *(F.lit(0).alias(c) for c in _TILE[1:]), F.lit(False).alias("side"), F.lit(False).alias("apart"))
    members = members.where("large")
    extent = checkpointed(extent(members, "cluster", "own"))
    # a band's parts meet each other in its own tiles, and the parts of the band below in that one's
    places = extent.select("cluster", "own", "parts", F.col("own").alias("band"), F.col("parts").alias("others"), F.lit(0).alias("side"))
    above = extent.select("cluster", F.col("own").alias("band"), F.col("parts").alias("others"))
    up = extent.withColumn("band", F.col("own") - 1).join(above, ["cluster", "band"]).select("cluster", "own", "parts", "band", "others", F.lit(1).alias("side"))
    next_ = extent.select("cluster", F.col("own").alias("next"), F.col("parts").alias("others"))
    down = extent.withColumn("next", F.col("own") + 1).join(next_, ["cluster", "next"]).select("cluster", "own", "parts", F.col("own").alias("band"), "others", F.lit(2).alias("side"))
    dealt = members.join(few(checkpointed(places.unionByName(up).unionByName(down))), ["cluster", "own"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    inner, upper = F.col("side") == 0, F.col("side") == 1
    low = F.when(inner, F.least("part", "other")).when(upper, F.col("other")).otherwise(F.col("part"))
    # the tiles between two bands are counted from below zero, so that they aren't those inside one
    high = F.when(inner, F.greatest("part", "other")).when(upper, -1 - F.col("part")).otherwise(-1 - F.col("other"))
    dealt = dealt.select("id", *_NAME, "rows", "shared", "cluster", "band", low.alias("low"), high.alias("high"), F.when(inner, F.col("part") > F.col("other")).otherwise(upper).alias("side"), (~inner | (F.col("part") != F.col("other"))).alias("apart"))
    # the key is the tile's, so that the tiles of a cluster are dealt to all tasks
    dealt = whole.unionByName(dealt).withColumn("tile", F.xxhash64(*_TILE))
    links = checkpointed(dealt.groupBy("tile").applyInArrow(trimmed(_join_tiles(share)), "a long, b long, n long, name1 long, name2 long, links long"))
    # rows that share an id are one node: each of their classes is tied to the id
    same = sets.where("n > 0").select(*_NAME, "id").distinct().join(classes, _NAME).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    within = classes.where("rows > 1").select(*_NAME, (F.col("rows") - 1).alias("links"))
    counts = checkpointed(within.unionByName(links.select(*_NAME, "links")).groupBy(*_NAME).agg(F.sum("links").alias("n_links")))
    return sets.select("id", *_NAME), counts, components(links.select("a", "b").unionByName(same))


def jaccard_links(docs: DataFrame, width: int = 4, share: int = 85) -> DataFrame:
    """Components of documents linked where 100 * intersection >= share * union of their
    sets of `width`-word shingles (ASCII lower case).

    Returns one row per row of `docs`: doc_id, n_shingles, n_links (the other rows that its
    text is linked with, those with an equal set among them), component_id (the smallest doc_id
    reachable, its own if none). A text with fewer words is one shingle; one without words,
    or a null text, has an empty set and links with nothing. Rows that repeat a doc_id are
    one node of the components. A null doc_id comes after every other and its component, if no id is
    reachable, is null. Set items are 64-bit hashes; the items of two texts are compared by 48
    of their bits, so two sets of 20,000 shingles have one in 700,000 odds to differ by one.
    """
    sets, counts, of = _linked(docs.select(order_id(F.col("doc_id")).alias("id"), utf8(F.col("text")).alias("text")), width, share)
    out = sets.join(counts, _NAME, "left").join(of, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    no = lambda c: F.when(c != MAX_ID, c)
    return out.select(no(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), no(component).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 4, share: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of jaccard_links."""
    return jaccard_links(docs, width, share).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """The rows of `docs` but those whose component holds a smaller doc_id (see jaccard_components).

    Decides by doc_id: rows that share one, or have none, stay or go together. keep_rows
    decides by row.
    """
    gone = checkpointed(jaccard_components(docs, width, share).where(F.col("component_id") < F.coalesce("doc_id", F.lit(MAX_ID))).select(F.col("doc_id").alias("_gone")).distinct())
    some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(some, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def keep_rows(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """Of the rows of `docs` that are linked (see jaccard_links), the one with the smallest doc_id;
    a null id comes last. All rows that link with nothing stay.

    Each doc_id and text is a node by its 64-bit hash, so rows that share an id, or have none, are
    decided each by itself; among them the smallest hash stays. Of rows with the same id and
    text any one stays.
    """
    key, text = order_id(F.col("doc_id")), utf8(F.col("text"))
    node = F.xxhash64(key, text)
    sets, _, of = _linked(docs.select(node.alias("id"), text.alias("text")), width, share)
    rank = F.struct(key.alias("key"), node.alias("node"))
    linked = checkpointed(docs.select(rank.alias("rank"), node.alias("node")).distinct().join(of, "node").select("rank", "component"))
    least = linked.groupBy("component").agg(F.min("rank").alias("least"))
    gone = checkpointed(linked.join(least, "component").where("rank <> least").select(F.col("rank.node").alias("_node")))
    again = checkpointed(sets.where("n > 0").groupBy(F.col("id").alias("_node")).agg(F.count("*").alias("c")).where("c > 1").select("_node"))
    some = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    kept = docs.withColumn("_node", node).join(some(gone), "_node", "left_anti")
    if again.count():
        single = kept.join(some(again), "_node", "left_anti")
        kept = single.unionByName(kept.join(some(again), "_node", "left_semi").dropDuplicates(["_node"]))
    return kept.select(docs.columns)
