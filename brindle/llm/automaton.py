"""Substring dedup on words by suffix automata of reference shards.

The corpus is too large for one automaton, and an automaton that every task held would have
no size bound. So the passages that two documents share are dealt to shards by their
anchors (see passages.py). A shard's automaton holds its distinct passages that differ under one anchor,
with the smallest document id at every state, and the passages are streamed through it for their
matching statistics, held at the window's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Method, remove_passages, repeated_windows
from .textscan import rolling, word_bounds, word_hashes


class SuffixAutomaton:
    """Of several sequences, with the smallest owner of every state's substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]
        self.last = 0

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of q's substrings that are one symbol longer than p's."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list, owner: int) -> None:
        now = 0
        for symbol in sequence:
            p, moves = now, self.next[now]
            if symbol in moves:
                now = self._split(p, symbol, moves[symbol])
            else:
                now = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = now
                    p = self.link[p]
                if p >= 0:
                    self.link[now] = self._split(p, symbol, self.next[p][symbol])
            if self.least[now] is None or owner < self.least[now]:
                self.least[now] = owner

    def finish(self) -> None:
        """Hand the smallest owners down the suffix links, longest states first."""
        order = np.argsort(-np.array(self.length), kind="stable").tolist()
        least, link = self.least, self.link
        for v in order:
            up = link[v]
            if up >= 0 and least[v] is not None and (least[up] is None or least[v] < least[up]):
                least[up] = least[v]

    def windows(self, sequence: list, window: int) -> np.ndarray:
        """Smallest owner of each window of a sequence; every window must occur."""
        out, v, n = [], 0, 0
        step, link, length, least = self.next, self.link, self.length, self.least
        for symbol in sequence:
            while v and symbol not in step[v]:
                v = link[v]
                n = length[v]
            if symbol in step[v]:
                v, n = step[v][symbol], n + 1
            if n >= window:
                while length[link[v]] >= window:
                    v = link[v]
                n = window
                out.append(least[v])
        return np.array(out, np.int64)


def _resolve(contents: list[bytes], anchors: np.ndarray, least: np.ndarray, window: int) -> list[np.ndarray]:
    """One automaton of the shard's passages; each passage is streamed through it.

    Windows whose hash comes once in the shard keep their own id; the stretches of others are what the
    automaton holds and reads.
    """
    split = [c.split(b" ") for c in contents]
    counts = np.array([len(w) for w in split])
    ends = np.cumsum(counts)
    data = np.frombuffer(b" ".join(contents) + b" ", np.uint8)
    owner = np.repeat(np.arange(len(contents)), counts)
    h = rolling(word_hashes(data, *word_bounds(data)), window)
    low, many = repeated_windows(h, np.arange(len(h)) + window <= ends[owner[: len(h)]])
    value, index, stretches = least[owner], SuffixAutomaton(), []
    for a, n in zip(low.tolist(), many.tolist(), strict=True):
        i = owner[a]
        start = a - int(ends[i] - counts[i])
        stretches.append((a, n, split[i][start : start + n + window - 1]))
        index.add(stretches[-1][2], int(least[i]))
    index.finish()
    for a, n, words in stretches:
        value[a : a + n] = index.windows(words, window)
    return [value[e - n : e - window + 1] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def dedup_substrings(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """Remove every word covered by a window of `window` words that starts in a document
    with a smaller doc_id too.

    Returns the rows of `docs` with text replaced by the kept words, joined by one space,
    and n_words, n_removed and spans (word positions) added, or put in place of columns so
    named. See remove_passages for nulls
    and repeated rows.
    """
    found = remove_passages(docs, Method(window, gram, True, _resolve))
    kept = F.col("kept").cast("string")
    columns = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed", "spans")]
    return found.select(*columns, F.col("n_symbols").alias("n_words"), "n_removed", "spans")
