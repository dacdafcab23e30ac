"""Passages that start in an earlier document too, found and removed over a whole corpus.

The two removal operators share this frame. A window is so many consecutive symbols (words
or bytes) of one document; windows are judged on the input.

1. Blocks of documents send, for each window, the least hash of its k-grams (its anchor) to
   buckets of anchors, each once per block.
2. Buckets answer each block with its anchors that two documents hold.
3. Blocks cut the runs of windows under such an anchor and send these slices, each distinct
   content once, to the anchor's shard. Equal windows have equal anchors, so they meet there.
4. A shard compares the contents exactly, by the operator's own index, and answers with the
   smallest document at each window of a content. Where else a block holds the content stays
   out of the shard: the block's own list of these places comes back to it by another way.
5. Blocks cut out the windows that have a smaller document.

What is shuffled is bounded by the block: a passage that a third of all documents hold is
sent once per block and bucket, with one place. Texts are shuffled once and read three times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import MAX_ID, order_id, trimmed
from .textscan import anchors, from_planes, mixed, planes, word_bounds, word_hashes

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 3 << 20
SPANS = ArrayType(StructType().add("low", LongType()).add("high", LongType()))


@dataclass(frozen=True)
class Method:
    """What differs between the operators. resolve takes the distinct contents of a shard,
    their anchors and smallest ids, and gives for each content the smallest id at each window."""

    window: int
    gram: int
    words: bool
    resolve: Callable[[list[bytes], np.ndarray, np.ndarray, int], list[np.ndarray]]


class Block:
    """A block's documents in a fixed order, as one array of symbols."""

    def __init__(self, ids: pa.Array, texts: pa.Array, words: bool):
        ids, texts = ids.to_pylist(), texts.to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.texts = [texts[i] for i in self.order]
        # a separating space after each text; it ends words, and no byte window may cross it
        joined = b" ".join(self.texts) + b" "
        self.data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        self.text_at = np.concatenate([[0], ends])[:-1].astype(np.int64)
        if words:
            self.starts, self.ends = word_bounds(self.data)
            self.symbols = word_hashes(self.data, self.starts, self.ends)
            self.first = np.searchsorted(self.starts, np.concatenate([self.text_at, [len(self.data)]]))
        else:
            self.starts = self.ends = None
            self.symbols = self.data
            self.first = np.concatenate([[0], ends]).astype(np.int64)
        self.words = words

    def windows(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one document with the same anchor: anchor, first window, windows."""
        h = anchors(self.symbols, window, gram)
        doc = np.searchsorted(self.first, np.arange(len(h)), "right") - 1 if len(h) else np.zeros(0, np.int64)
        doc = doc.astype(np.int32)
        # a document's symbols, but for the space after the text
        limit = self.first[1:] - (0 if self.words else 1)
        fits = np.arange(len(h)) + window <= limit[doc] if len(h) else np.zeros(0, bool)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        keep = fits[at]
        return h[at][keep], at[keep], size[keep]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def content(self, low: int, high: int) -> bytes:
        if self.words:
            return b" ".join(self.data[self.starts[low] : self.ends[high - 1]].tobytes().split())
        return self.data[low:high].tobytes()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h) % np.uint64(buckets)).astype(np.int64)


def _groups(keys: np.ndarray):
    """Positions in order of keys, and the bounds of equal ones."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
    return order, edge


_SENT = "bucket long, block long, hashes binary, several binary"
#: Bytes of an anchor that are sent. Anchors of a bucket that agree in them count as one, which costs a comparison, no result.
SENT_BYTES = 6
_SENT_MASK = np.uint64((1 << 8 * SENT_BYTES) - 1)


def _send_anchors(method: Method, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        b = Block(t["id"].combine_chunks(), t["bytes"].combine_chunks(), method.words)
        h, at, _ = b.windows(method.window, method.gram)
        ids = b.ids[b.doc_of(at)]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        low = np.flatnonzero(new)
        last = np.append(low[1:], len(h)) - 1 if len(h) else low
        h, several = h[low], (ids[low] != ids[last]).astype(np.uint8)
        order, edge = _groups(_bucket(h, buckets))
        block, rows = t["block"][0].as_py(), ([], [], [], [])
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            i = order[s:e]
            for column, x in zip(rows, (int(_bucket(h[i[:1]], buckets)[0]), block, _short(h[i]), several[i].tobytes()), strict=True):
                column.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _short(h: np.ndarray) -> bytes:
    return planes(h)[: SENT_BYTES * len(h)]


def _long(data: bytes) -> np.ndarray:
    return from_planes(data + bytes(len(data) // SENT_BYTES * (8 - SENT_BYTES)), np.uint64)


def _shared_anchors(t: pa.Table) -> pa.Table:
    """Of each block's anchors those that two documents hold: in one block or in two.
    Rows of one id in two blocks count as two, which costs a comparison, no result."""
    parts = [_long(x) for x in t["hashes"].to_pylist()]
    h = np.concatenate(parts)
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in t["several"].to_pylist()])
    order, edge = _groups(h)
    low = edge[:-1]
    turn = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]
    shared = (np.minimum.reduceat(turn, low) != np.maximum.reduceat(turn, low)) | (np.maximum.reduceat(several[order], low) > 0)
    flag = np.zeros(len(h), bool)
    flag[order] = np.repeat(shared, np.diff(edge))
    bounds = np.cumsum([0] + [len(p) for p in parts])
    out = [(b, _short(h[s:e][flag[s:e]])) for b, s, e in zip(t["block"].to_pylist(), bounds[:-1], bounds[1:], strict=True) if flag[s:e].any()]
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["to", "shared"])


_SLICES = "bucket long, block long, kind int, contents binary, lengths binary, hashes binary, at binary, least binary, most binary"


def _send_slices(method: Method, buckets: int):
    """Of each bucket the block's distinct contents under its anchors, with their first place in the
    block and their smallest and largest id (kind 1), and once the other places of contents (kind 0)."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("contents", "lengths", "hashes", "at", "least", "most"))])

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows: tuple[list, ...] = tuple([] for _ in schema)
        if t.num_rows and answers.num_rows:
            shared = np.sort(np.concatenate([_long(x) for x in answers["shared"].to_pylist()]))
            b = Block(t["id"].combine_chunks(), t["bytes"].combine_chunks(), method.words)
            h, at, size = b.windows(method.window, method.gram)
            short = h & _SENT_MASK
            hit = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
            h, at, size = h[hit], at[hit], size[hit]
            ids = b.ids[b.doc_of(at)]
            order, edge = _groups(_bucket(h, buckets))
            lows, highs = at.tolist(), (at + size + method.window - 1).tolist()
            block, firsts, others = t["block"][0].as_py(), [], []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                i = order[s:e]
                known: dict[bytes, int] = {}
                which = np.array([known.setdefault(b.content(lows[j], highs[j]), len(known)) for j in i.tolist()], np.int32)
                by, bound = _groups(which)
                first = by[bound[:-1]]
                least, most = np.minimum.reduceat(ids[i[by]], bound[:-1]), np.maximum.reduceat(ids[i[by]], bound[:-1])
                again = np.ones(len(by), bool)
                again[bound[:-1]] = False
                firsts.append(at[i[first[which[by[again]]]]])
                others.append(at[i[by[again]]])
                lengths = np.array([len(c) for c in known], np.int32)
                row = (int(_bucket(h[i[:1]], buckets)[0]), block, 1, zstandard.compress(b"".join(known), 3), planes(lengths), planes(h[i[first]]), planes(at[i[first]].astype(np.int32)), planes(least), planes(most))
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
            if sum(map(len, firsts)):
                first, other = np.concatenate(firsts).astype(np.int32), np.concatenate(others).astype(np.int32)
                row = (int(_bucket(np.array([block], np.uint64), buckets)[0]), block, 0, b"", b"", planes(other), planes(first), b"", b"")
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _merged(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each key, joined where they touch."""
    if not len(key):
        return key, low, high
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    turn = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) * (int(high.max()) + 1)
    top = np.maximum.accumulate(turn + high) - turn  # high so far inside the key
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] > top[:-1])
    at = np.flatnonzero(new)
    return key[at], low[at], top[np.append(at[1:], len(key)) - 1]


_ANSWERS = "to long, kind int, at binary, windows binary, starts binary, ids binary"


def _smallest_documents(method: Method):
    """A shard's answer: for each block, at the first places of its contents, runs of windows
    (windows of each run, first window, smallest id). Lists of other places pass through."""
    schema = pa.schema([("to", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("at", "windows", "starts", "ids"))])

    def run(t: pa.Table) -> pa.Table:
        contents: dict[bytes, int] = {}
        owner, which, at, least, most, rows, out = [], [], [], [], [], [], []
        for r in range(t.num_rows):
            if t["kind"][r].as_py() == 0:
                out.append((t["block"][r].as_py(), 0, t["at"][r].as_py(), b"", t["hashes"][r].as_py(), b""))
                continue
            data, start = zstandard.decompress(t["contents"][r].as_py()), 0
            lengths, hashes = from_planes(t["lengths"][r].as_py(), np.int32).tolist(), from_planes(t["hashes"][r].as_py(), np.uint64)
            own = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths):
                own[i] = k = contents.setdefault(data[start : start + n], len(contents))
                start += n
                if k == len(owner):
                    owner.append(hashes[i])
            which.append(own)
            at.append(from_planes(t["at"][r].as_py(), np.int32))
            least.append(from_planes(t["least"][r].as_py(), np.int64))
            most.append(from_planes(t["most"][r].as_py(), np.int64))
            rows.append(np.full(len(own), r))
        if which:
            which, at, first, most, rows = map(np.concatenate, (which, at, least, most, rows))
            least = np.full(len(contents), MAX_ID)
            np.minimum.at(least, which, first)
            owner = np.array(owner, np.uint64)
            texts = list(contents)
            size = np.array([c.count(b" ") + 1 if method.words else len(c) for c in texts]) - method.window + 1
            # an anchor with one content needs no comparison: its windows have the content's smallest id
            order, edge = _groups(owner)
            mixed_ones = np.sort(order[np.repeat(np.diff(edge), np.diff(edge)) > 1])
            runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            low = least.copy()
            if len(mixed_ones):
                answers = method.resolve([texts[i] for i in mixed_ones.tolist()], owner[mixed_ones], least[mixed_ones], method.window)
                for i, g in zip(mixed_ones.tolist(), answers, strict=True):
                    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    runs[i], low[i] = (start, g[start]), g.min()
            for r, s, e in zip(*_bounds(rows), strict=True):
                some = s + np.flatnonzero(low[which[s:e]] < most[s:e])
                if not len(some):
                    continue
                parts = [runs.get(k, (_FIRST, least[k : k + 1])) for k in which[some].tolist()]
                many = np.array([len(p[0]) for p in parts])
                starts = np.concatenate([p[0] for p in parts])
                end = np.append(starts[1:], 0)
                end[np.cumsum(many) - 1] = size[which[some]]
                out.append((t["block"][int(r)].as_py(), 1, planes(np.repeat(at[some], many)), planes((end - starts).astype(np.int32)), planes(starts.astype(np.int32)), planes(np.concatenate([p[1] for p in parts]))))
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def repeated_windows(h: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (first window, windows) of whole windows whose hashes h come at least twice. All others
    are no other content's; that these are equal must still be compared."""
    at = np.flatnonzero(whole)
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at][1:] == h[at][:-1]
    shared = np.zeros(len(h) + 1, bool)
    shared[at[1:][same]] = shared[at[:-1][same]] = True
    edge = np.flatnonzero(np.diff(shared.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2] - edge[::2]


_FIRST = np.zeros(1, np.int64)


def _bounds(sorted_keys: np.ndarray):
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, np.int64)
    return sorted_keys[edge[:-1]], edge[:-1], edge[1:]


def _covered(b: Block, window: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a block's documents (document, from, to) that windows of smaller documents cover."""
    kinds = answers["kind"].to_pylist()
    pick = lambda kind, column, dtype: np.concatenate([np.zeros(0, dtype), *(from_planes(answers[column][i].as_py(), dtype) for i, k in enumerate(kinds) if k == kind)])
    at, windows, starts, ids = pick(1, "at", np.int32), pick(1, "windows", np.int32), pick(1, "starts", np.int32), pick(1, "ids", np.int64)
    first, other = pick(0, "at", np.int32), pick(0, "starts", np.int32)
    # a content's runs hold at its other places too
    order = np.argsort(at, kind="stable")
    low, high = np.searchsorted(at[order], first), np.searchsorted(at[order], first, "right")
    again = order[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum())] if len(first) else np.zeros(0, np.int64)
    at = np.concatenate([at, np.repeat(other, high - low)]).astype(np.int64)
    run = np.concatenate([np.arange(len(windows)), again])
    doc = b.doc_of(at)
    gone = ids[run] < b.ids[doc]
    doc, run, at = doc[gone], run[gone], at[gone]
    start = at - b.first[doc] + starts[run]
    return _merged(doc, start, start + windows[run] + window - 1)


def _cut(method: Method, schema: pa.Schema):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(t["id"].combine_chunks(), t["bytes"].combine_chunks(), method.words)
        doc, low, high = _covered(b, method.window, answers)
        edge = np.searchsorted(doc, np.arange(len(b.ids) + 1))
        texts, sizes, removed, spans = ([None] * len(b.ids) for _ in range(4))
        for place, row in enumerate(b.order):
            text, s, e = b.texts[place], edge[place], edge[place + 1]
            if method.words:
                first, n = b.first[place], int(b.first[place + 1] - b.first[place])
                parts = text.split()
                if s < e:
                    kept, at = [], 0
                    for lo, hi in zip(low[s:e].tolist(), high[s:e].tolist(), strict=True):
                        kept += parts[at:lo]
                        at = hi
                    parts = kept + parts[at:]
                out = b" ".join(parts)
            else:
                n, kept, at = len(text), [], 0
                for lo, hi in zip(low[s:e].tolist(), high[s:e].tolist(), strict=True):
                    kept.append(text[at:lo])
                    at = hi
                out = b"".join([*kept, text[at:]]) if s < e else text
            texts[row], sizes[row], removed[row] = out, n, int((high[s:e] - low[s:e]).sum())
            spans[row] = [{"low": lo, "high": hi} for lo, hi in zip(low[s:e].tolist(), high[s:e].tolist(), strict=True)]
        found = {"kept": pa.array(texts, pa.binary()), "n_symbols": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, schema.field("spans").type)}
        return pa.table([found[f.name] if f.name in found else t[f.name].combine_chunks().cast(f.type) for f in schema], schema=schema)

    return run


def remove_passages(docs: DataFrame, method: Method, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `docs` under a struct `row`, with kept (binary: what is left
    of the text), n_symbols (words or bytes of the input), n_removed, and spans (low, high:
    the maximal removed runs, in symbols).

    A null text is empty. A null doc_id comes after every other; rows that repeat a doc_id
    are judged apart, and none is earlier than another. The smallest document that holds a
    window keeps it.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(32, -(-size // block_bytes)), max(32, -(-size // bucket_bytes))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), order_id(F.col("doc_id")).alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    rows = rows.withColumn("row", F.col("row").dropFields("text") if len(docs.columns) > 1 else F.col("row"))
    # the text too, so that rows without an id or with one that repeats are spread
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "bytes"), F.lit(blocks)))
    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(trimmed(_send_anchors(method, buckets)), _SENT)
    shared = sent.groupBy("bucket").applyInArrow(trimmed(_shared_anchors), "to long, shared binary")
    slices = by_block.cogroup(shared.groupBy("to")).applyInArrow(trimmed(_send_slices(method, buckets)), _SLICES)
    answers = slices.groupBy("bucket").applyInArrow(trimmed(_smallest_documents(method)), _ANSWERS)
    ddl = rows.select("row").schema.add("kept", "binary").add("n_symbols", "long").add("n_removed", "long").add("spans", SPANS)
    return by_block.cogroup(answers.groupBy("to")).applyInArrow(trimmed(_cut(method, to_arrow_schema(ddl))), ddl)
