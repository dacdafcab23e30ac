"""Suffix-array dedup on bytes: induced sorting of shard arrays and permuted common prefixes.

Shards hold the passages that two documents may share (see passages.py). The stretches of a shard whose windows
may occur twice are joined by separators. Its suffixes are classified; the leftmost-smaller substrings are sorted
by induction, named, and, where names repeat, sorted by the same procedure on the shorter
string of names, down to distinct names; their order then induces that of all suffixes.
Names and common prefixes are compared symbol by symbol, never by hashes. The permuted common
prefixes, held at the window's length, split the array into runs of suffixes that begin with
the same window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Method, remove_passages, repeated_windows
from .textscan import rolling

#: Up to so many distinct symbols, a bucket is induced at a time in array operations; with more,
#: as strings of names have, buckets are too small for that and positions go one by one.
ARRAY_BUCKETS = 1024


def _spread(lists: list[list[np.ndarray]], at: np.ndarray, symbols: np.ndarray) -> None:
    """Append positions to their symbols' buckets, in order."""
    if not len(at):
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    edge = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(at)]
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        lists[symbols[s]].append(at[s:e])


def _induce_by_bucket(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """As _induce, whole buckets at a time. What a bucket induces into itself is met in further rounds."""
    s = s.astype(np.uint16)  # short integers are sorted by radix
    seeded: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    _spread(seeded, seeds, s[seeds])
    large: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    for c in range(n_symbols):
        turn = 0
        while turn < len(large[c]):
            before = large[c][turn] - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            _spread(large, before, s[before])
            turn += 1
        for seed in seeded[c]:
            before = seed - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            _spread(large, before, s[before])
    # from the right; the lists hold positions in descending order
    small: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    small[0].append(np.array([len(s) - 1]))  # nothing induces the sentinel
    for c in range(n_symbols - 1, -1, -1):
        turn = 0
        while turn < len(small[c]):
            before = small[c][turn] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            _spread(small, before, s[before])
            turn += 1
        if large[c]:
            before = np.concatenate(large[c])[::-1] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            _spread(small, before, s[before])
    parts = []
    for c in range(n_symbols):
        parts += large[c]
        if small[c]:
            parts.append(np.concatenate(small[c])[::-1])
    return np.concatenate(parts)


def _induce_by_position(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """As _induce, one position after the other."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
    order = np.zeros(len(s), np.int64)  # a free place looks like position 0, which nothing comes before
    # seeds stand at the ends of their buckets, in their own order
    symbols = s[seeds]
    by_symbol = np.argsort(symbols, kind="stable")
    of = symbols[by_symbol]
    last = np.searchsorted(of, of, "right")
    order[bounds[of + 1] - (last - np.arange(len(of)))] = seeds[by_symbol]
    order[0] = len(s) - 1  # the sentinel
    placed = order.tolist()
    # the bucket that each position sends the one before it to, in either pass
    before = np.concatenate([[-1], s[:-1]])
    is_small = np.concatenate([[False], smaller[:-1]])
    to, next_ = np.where(is_small, -1, before).tolist(), bounds[:-1].tolist()
    for at in placed:  # what is placed comes behind the loop's own place
        c = to[at]
        if c >= 0:
            place = next_[c]
            placed[place] = at - 1
            next_[c] = place + 1
    to, next_ = np.where(is_small, before, -1).tolist(), bounds[1:].tolist()
    for at in reversed(placed):
        c = to[at]
        if c >= 0:
            next_[c] = place = next_[c] - 1
            placed[place] = at - 1
    return np.array(placed, np.int64)


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones (`smaller`: S-type).

    The last symbol is a sentinel, smaller than all others. From the left, buckets of first
    symbols take in the larger suffixes before what they hold; from the right, the smaller ones.
    """
    by = _induce_by_bucket if n_symbols <= ARRAY_BUCKETS else _induce_by_position
    return by(s, smaller, seeds, n_symbols)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _names(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names, from 1, of substrings that come in order: equal ones, in symbols and types, are neighbours."""
    same = lengths[1:] == lengths[:-1]
    pair = np.flatnonzero(same)
    a, b, n = _spans(starts[pair], lengths[pair]), _spans(starts[pair + 1], lengths[pair]), lengths[pair]
    differs = np.concatenate([[0], np.cumsum((s[a] != s[b]) | (smaller[a] != smaller[b]))])
    edge = np.concatenate([[0], np.cumsum(n)])
    same[pair] = differs[edge[1:]] == differs[edge[:-1]]
    return np.concatenate([[1], 1 + np.cumsum(~same)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of symbols 1.. by induced sorting; the end is smaller than every symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.append(s.astype(np.int64), 0)  # the sentinel
    n_symbols = int(s.max()) + 1
    # S-type: smaller than the suffix to the right; equal symbols follow their right neighbour
    differs = np.flatnonzero(s[1:] != s[:-1])
    rises = s[differs + 1] > s[differs]
    smaller = np.ones(n + 1, bool)
    smaller[:n] = rises[np.searchsorted(differs, np.arange(n))]
    marks = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce(s, smaller, marks, n_symbols)
    is_mark = np.zeros(n + 1, bool)
    is_mark[marks] = True
    ordered = order[is_mark[order]]
    place = np.empty(n + 1, np.int64)
    place[marks] = np.arange(len(marks))
    ends = np.append(marks[1:], n)  # a substring goes up to and with the next mark
    at = place[ordered]
    name = np.empty(len(marks), np.int64)
    name[at] = _names(s, smaller, ordered, ends[at] - ordered + 1)
    # strings of names get shorter by half at least
    reduced = suffix_array(name) if name.max(initial=0) < len(marks) else np.argsort(name, kind="stable")
    return _induce(s, smaller, marks[reduced], n_symbols)[1:]


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in the array, at most `most`.

    Several symbols are packed into one number, as many as its bits hold, so that all positions
    take a stride at a time; the last strides are shorter.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    bits = max(1, int(s.max(initial=0)).bit_length())
    packed, sizes = [s.astype(np.uint64)], [1]
    while 2 * sizes[-1] * bits <= 64 and 2 * sizes[-1] <= most:
        size, h = sizes[-1], packed[-1]
        right = np.zeros(n, np.uint64)
        right[: max(0, n - size)] = h[size:]
        packed.append((h << np.uint64(size * bits)) | right)
        sizes.append(2 * size)
    at, out = np.flatnonzero(before >= 0), np.zeros(n, np.int64)
    length, left, right = np.zeros(len(at), np.int64), at, before[at]
    open_ = np.arange(len(at))
    for size, h in zip(reversed(sizes), reversed(packed), strict=True):
        # full strides go on while all symbols agree; each shorter one is tried once
        for _ in range(most // size if size == sizes[-1] else 1):
            i, j = left[open_] + length[open_], right[open_] + length[open_]
            fits = (i + size <= n) & (j + size <= n) & (length[open_] + size <= most)
            same = fits & (h[np.minimum(i, n - 1)] == h[np.minimum(j, n - 1)])
            length[open_[same]] += size
            if size == sizes[-1]:
                open_ = open_[same]
                if not len(open_):
                    break
        open_ = np.arange(len(at))
    out[at] = length
    return out


def _resolve(contents: list[bytes], anchors: np.ndarray, least: np.ndarray, window: int) -> list[np.ndarray]:
    """Smallest id at each window of each content.

    A window whose hash no other window of the shard has is no other content's: it keeps its own id. The
    stretches of other windows are compared exactly, by one array over all of them.
    """
    lengths = np.array([len(c) for c in contents])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    data = np.frombuffer(b"\0".join(contents), np.uint8)
    owner = np.repeat(np.arange(len(contents)), lengths + 1)[: len(data)]
    value = least[owner]
    h = rolling(data, window)
    whole = np.arange(len(h)) + window <= (starts + lengths)[owner[: len(h)]]
    # a stretch ends with its content, as windows over a separator are never whole
    low, many = repeated_windows(h, whole)
    if len(low):
        found = _smallest(data, low, many + window - 1, least[owner[low]], window)
        value[_spans(low, many)] = found
    return [value[a : a + n - window + 1] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _smallest(data: np.ndarray, low: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Of stretches of the data the smallest id at each window, one after the other, by their suffix array."""
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    # byte 0 is symbol 2; 1 parts the stretches
    s = np.ones(int((lengths + 1).sum()), np.int64)
    s[_spans(starts, lengths)] = data[_spans(low, lengths)].astype(np.int64) + 2
    order = suffix_array(s)
    common = permuted_common_prefixes(s, order, window)
    owner = np.repeat(np.arange(len(low)), lengths + 1)
    whole = np.arange(len(s)) + window <= (starts + lengths)[owner]
    # suffixes that begin with a whole window of a stretch; runs of them with common windows
    sorted_whole = whole[order]
    joins = (common[order] >= window) & sorted_whole
    joins[1:] &= sorted_whole[:-1]
    run = np.cumsum(~joins) - 1
    first = np.flatnonzero(~joins)
    value = np.empty(len(s), np.int64)
    value[order] = np.minimum.reduceat(ids[owner[order]], first)[run]
    return value[_spans(starts, lengths - window + 1)]


def dedup_bytes(docs: DataFrame, window: int = 50, gram: int = 24) -> DataFrame:
    """Remove every byte covered by a string of `window` bytes that starts in a document with
    a smaller doc_id too.

    Returns doc_id, kept (binary: the remaining bytes), n_bytes, n_removed and spans (byte
    positions of the maximal removed runs), and the other columns of `docs` but text. What
    is left need not be valid UTF-8. See remove_passages for nulls and repeated rows.
    """
    found = remove_passages(docs, Method(window, gram, False, _resolve))
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "spans")]
    return found.select(*columns, "kept", F.col("n_symbols").alias("n_bytes"), "n_removed", "spans")
