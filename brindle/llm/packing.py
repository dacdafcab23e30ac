"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising is one pass over the texts in Arrow batches; packing then moves only the piece
table (ids and lengths). Pieces are dealt to partitions that each run best-fit decreasing
and certify their bin count by dual-feasible-function lower bounds. A partition gives its
least filled bins back, the more the further it is from its bound, and those documents are
exchanged up a tree of partitions that run best-fit decreasing again. Each row carries the
certificate of the partition that packed it last, and `certificate` sets all sequences
against the bound of all lengths.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, arrow_rows, checkpointed, give_back, unused, utf8

#: Pieces that one partition packs, and partitions that meet in one at the next round.
GROUP_PIECES = 32768
FAN_IN = 8
#: Words after which a worker starts a new table of ids. The table before is kept until then, and words that
#: are met again move on from it, so that frequent words stay and those met once go.
CACHE_WORDS = 80_000

#: A run of these after letters is encoded apart from them. The apostrophe isn't one: it may start a suffix.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, "WordEncoder"] = {}
KEPT.append(_ENCODERS)
#: Texts that come to a worker at a time, and wait for it in the JVM.
BATCH_TEXTS = 1024
#: Bytes of text that are split into words at a time; one text may be longer.
SLICE_BYTES = 1 << 20
#: Letters that are letters, composed, with the same single small letter, in every version of Unicode since the
#: fifth: those of Latin-1 and Extended-A but for U+0130.
_SETTLED = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


def _objects(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return texts.view(pa.large_binary() if large else pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never joins letters across it, so a text's ids are
    those of its words in a row. Arrow splits a slice of texts and tells its distinct words,
    each is looked up once a slice, and encoded once while it stays in the table. A word of
    settled letters is one unit to the tokenizer, so its model gets it at once, without the
    steps before. Words of other letters are encoded many at a time: each gives exactly one
    token that ends a word, the last.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.ends[at] = token.endswith("</w>")
        self.packed = [struct.pack("<I", i) for i in range(len(self.ends))]
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = re.findall(f"[{_SETTLED}]", "".join(map(chr, range(0x180))))
        self.settled = "".join(letters)
        #: What the tokenizer writes for the bytes of a settled letter.
        self.letters = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in letters if not c.isascii()}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _one(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, key: bytes) -> bytes:
        packed = self.packed
        text = key.decode() if key.isascii() else key.decode().translate(self.letters)
        return b"".join([packed[t.id] for t in self.model.tokenize(text)])

    def _mark(self, run: bytes) -> bytes:
        if run not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[run] = self._one(run.decode())
        return self.marks[run]

    def _learn(self, words: list[bytes]) -> None:
        """Words of settled letters, and marks behind them; others go to `_learn_others`."""
        known, before = self.known, self.before
        raw = pa.array(words, pa.large_binary())
        text = raw.view(pa.large_string())
        stem = pc.ascii_rtrim(text, characters=_MARKS.decode())
        settled = pc.match_substring_regex(stem, f"^[{_SETTLED}]+$")
        if not pc.all(settled).as_py():
            self._learn_others(_objects(raw.filter(pc.invert(settled))))
            raw, text, stem = raw.filter(settled), text.filter(settled), stem.filter(settled)
        keys = pc.utf8_lower(stem).dictionary_encode()
        rests = pc.utf8_ltrim(text, characters=self.settled).dictionary_encode()
        ids = []
        for key in _objects(keys.dictionary):
            found = known.get(key) or before.get(key) or self._unit(key)
            known[key] = found
            ids.append(found)
        marks = [self._mark(m) if m else b"" for m in _objects(rests.dictionary)]
        for word, key, mark in zip(_objects(raw), keys.indices.to_numpy().tolist(), rests.indices.to_numpy().tolist(), strict=True):
            known[word] = ids[key] + marks[mark] if marks[mark] else ids[key]

    def _learn_others(self, words: list[bytes]) -> None:
        known, plain, later = self.known, {}, []
        for raw in words:
            stem = raw.rstrip(_MARKS)
            rest = raw[len(stem) :]
            word = stem.decode()
            key = word.lower() if word.isalpha() and "\u03a3" not in word and unicodedata.is_normalized("NFC", word) else ""
            if not key.isalpha() or not unicodedata.is_normalized("NFC", key):
                known[raw] = self._one(raw.decode())
                continue
            key = key.encode()
            if key not in known:
                plain[key] = None
            if key != raw:
                later.append((raw, key, rest))
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(plain):
                data, start = ids.tobytes(), 0
                for key, end in zip(plain, (at * 4).tolist(), strict=True):
                    known[key] = data[start:end]
                    start = end
            else:
                for key in plain:
                    known[key] = self._one(key.decode())
        for raw, key, rest in later:
            known[raw] = known[key] + self._mark(rest) if rest else known[key]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            ids = before.get(words[i])
            if ids is None:
                new.append(words[i])
            else:
                known[words[i]] = ids
        if new:
            self._learn(new)
        for i in missing:
            found[i] = known[words[i]]
        return found

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        split = pc.ascii_split_whitespace(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._look_up(_objects(words.dictionary)), pa.large_binary()).take(words.indices)
        if ids.nbytes <= 8 * (len(ids) + 1):  # offsets only
            return [b""] * len(texts)
        ends = np.frombuffer(ids.buffers()[1], "<i8")[np.asarray(split.offsets)].tolist()
        data = memoryview(ids.buffers()[2])
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:])]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def own_encoder(path: str) -> WordEncoder:
    """The worker's encoder, once what earlier stages' tasks left here is given back."""
    give_back(_ENCODERS)
    return encoder(path)


def _slices(batch: pa.RecordBatch):
    """Rows of the batch in a row whose texts, the second column, take SLICE_BYTES together, one text's excess aside."""
    part = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def tokenize_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, payload: str = "ids") -> DataFrame:
    """The documents' token ids, cut into pieces of at most `capacity`.

    Returns doc_id, piece (from 0), start, length, and with payload "ids" the ids as an
    array<int>, with payload "crc32" ids_crc32 (of the little-endian unsigned 32-bit ids).
    A null text is empty, and every document ends with `end_id`. Rows that repeat a doc_id
    are documents of their own. Other columns are not carried.
    """
    columns = "doc_id long, piece int, start long, length long, " + ("ids array<int>" if payload == "ids" else "ids_crc32 long")
    end = struct.pack("<I", end_id)

    def run(batches):
        enc = own_encoder(tokenizer_path)
        for b in (s for batch in batches for s in _slices(batch)):
            data = enc.encode(b.column(1))
            out = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), data, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    value = np.frombuffer(part, "<i4") if payload == "ids" else zlib.crc32(part)
                    for column, x in zip(out, (doc, piece, at // 4, len(part) // 4, value), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()) if payload == "ids" else pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids" if payload == "ids" else "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(run, columns)


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Least number of bins by dual feasible functions: the identity, the threshold family
    that rounds large items up and small ones away, and the rounding family u(k). With counts,
    each length stands for so many items."""
    if not len(lengths):
        return 0
    x = np.asarray(lengths, np.int64)
    order = np.argsort(x, kind="stable")
    x, c = x[order], (np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)[order])
    total, many = np.concatenate([[0], np.cumsum(x * c)]), np.concatenate([[0], np.cumsum(c)])
    best = -(-int(total[-1]) // capacity)
    cut = np.unique(x[x * 2 <= capacity])
    if len(cut):
        low, high = np.searchsorted(x, cut, "left"), np.searchsorted(x, capacity - cut, "right")
        value = (many[-1] - many[high]) * capacity + total[high] - total[low]
        best = max(best, -(-int(value.max()) // capacity))
    best = max(best, int(c[2 * x > capacity].sum()))
    for k in range(1, 24):
        whole, rest = np.divmod(x * (k + 1), capacity)
        value = (np.where(rest == 0, x * k, whole * capacity) * c).sum()
        best = max(best, -(-int(value) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, which come longest first, and the fill of each bin.

    The free spaces that occur are the bits of one integer, so the tightest bin for an item
    is the lowest bit at or above its length."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill, bins, offsets = 0, [], [], []
    for n in lengths.tolist():
        over = mask >> n
        if over:
            free = n + (over & -over).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        free -= n
        if free:
            stacks[free].append(b)
            mask |= 1 << free
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64)


def _group_packer(capacity: int, level: int, last: bool, group: str, tie: str, open_: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", tie], ascending=[False, True, True, True, True], na_position="last", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        back = np.zeros(len(fill), bool)
        if not last:
            least = np.argsort(fill, kind="stable")[: 4 * (len(fill) - bound + 1)]
            back[least[fill[least] < capacity]] = True
        certificate = {"sequence_id": (level << 56) + (int(pdf[group].iloc[0]) << 24) + bins, "offset": offsets, "round": level, "partition": int(pdf[group].iloc[0]), "partition_bins": len(fill), "partition_bound": bound}
        return pdf.assign(**certificate, **{open_: back[bins]})

    return run


#: What pack adds to its pieces.
PACKED = ("sequence_id", "offset", "round", "partition", "partition_bins", "partition_bound")


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Put pieces of at most `capacity` into as few sequences of that length as it can.

    Takes doc_id, piece, start, length and any further columns; adds sequence_id and offset,
    gapless from 0 in each sequence, and the certificate of the partition that packed the piece
    last: round, partition, partition_bins (what best-fit decreasing took, the bins given back
    included) and partition_bound (the least that its lengths need). Columns so named are
    replaced. A piece of the whole capacity is a sequence by itself, of round -1. Pieces of
    length 0 or over the capacity are an error. Rows that are equal in all columns count
    apart. Ties go by doc_id, piece and start. An empty table gives an empty result.
    """
    pieces = pieces.drop(*PACKED)
    keep = pieces.columns
    tie, group, open_ = unused(keep, "tie", "group", "open")
    with arrow_rows(pieces.sparkSession, BATCH_TEXTS):
        pieces = checkpointed(pieces)
    n, low, high = pieces.agg(F.count("*"), F.min("length"), F.max("length")).first()
    if n and (low < 1 or high > capacity):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    whole = {"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0), "round": F.lit(-1), "partition": F.lit(None), "partition_bins": F.lit(1), "partition_bound": F.lit(1)}
    full = pieces.where(F.col("length") == capacity).select(*keep, *(whole[c].cast("long").alias(c) for c in PACKED))
    groups = max(1, -(-n // group_pieces))
    levels = 1
    while FAN_IN ** (levels - 1) < groups:
        levels += 1
    now = pieces.where(F.col("length") < capacity).withColumn(tie, F.monotonically_increasing_id())
    now = now.withColumn(group, F.pmod(F.xxhash64("doc_id", "piece", tie), F.lit(groups)))
    done = full
    for level in range(levels):
        last = level == levels - 1
        schema = now.select(*keep, tie, group).schema
        for c in PACKED:
            schema = schema.add(c, "long")
        packed = now.groupBy(group).applyInPandas(_group_packer(capacity, level, last, group, tie, open_), schema.add(open_, "boolean"))
        if not last:
            packed = checkpointed(packed)
        done = done.unionByName(packed.where(~F.col(open_)).select(*keep, *PACKED) if not last else packed.select(*keep, *PACKED))
        now = packed.where(F.col(open_)).select(*keep, tie, F.floor(F.col(group) / FAN_IN).cast("long").alias(group))
    return done


def certificate(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, bound (the least number that the lengths of all pieces need) and gap.
    The bound is of the counts of the lengths, at most `capacity` rows."""
    counts = packed.groupBy("length").count().collect()
    bound = lower_bound(np.array([r["length"] for r in counts]), capacity, np.array([r["count"] for r in counts]))
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, payload: str = "ids") -> DataFrame:
    """Tokenise and pack: see tokenize_documents and pack."""
    return pack(tokenize_documents(docs, tokenizer_path, capacity, end_id, payload), capacity)
