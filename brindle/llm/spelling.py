"""Words of a corpus grouped by spelling: each word's frequent neighbour at one edit, and where that leads.

Words are counted in tasks and summed by Spark. Pairs are looked for by classes of the longer word's
length m, in a positional index of q-grams. Two words at one edit share at least m - 2q + 1 q-grams
at places that fit, so of each word only the q + 1 rarest grams lead to index keys (gram, place). In
a key's group the postings of the words' other grams are merged under the same limits of length
and place; pairs above the overlap bound are verified, and only those leave the task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, pieces_of, trimmed
from .textscan import mixed

#: Distinct words that a task counts before it sends what it has.
HELD_WORDS = 400_000
#: Longest grams; a class of words takes up to half its length.
LONGEST_GRAM = 6
#: Words of a key that one tile pairs with all of the key; and index rows of one task.
TILE_ROWS, BUCKET_ROWS = 16_384, 150_000
#: Merged postings that a task holds at a time.
ENTRIES = 1_500_000

#: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, and all else a space; bytes are code points.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, period: int = 97) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences, over all texts.

    A word is a maximal run of letters up to U+00FF in ASCII lower case. Where the CRC-32 of
    "<doc_id>:<run>" is a multiple of `period` (0: nowhere), it lacks the code point at CRC modulo its length.
    A null text has no words; a null id is written as no characters.
    """

    def flush(held: dict[bytes, int]) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for b in pieces_of(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                seen: dict[bytes, int] = {}
                for w in text.encode("latin-1", "replace").translate(_LETTERS).split():
                    seen[w] = seen.get(w, 0) + 1
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in seen.items():
                    if period:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % period == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                    if len(w) >= shortest:
                        held[w] = held.get(w, 0) + n
            if len(held) > HELD_WORDS:
                yield flush(held)
                held.clear()
        yield flush(held)
        held.clear()
        give_back()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_length(m: int) -> int:
    """Length of the grams of the class whose longer word has m letters: at least two must be shared."""
    return max(1, min(LONGEST_GRAM, (m - 1) // 2))


def overlap_bound(m: int) -> int:
    """Grams that two words of the class share at least: one edit touches no more than q of them."""
    return m - 2 * gram_length(m) + 1


def _codes(words: np.ndarray, length: int) -> np.ndarray:
    """Letters of words of one length, as rows of bytes."""
    return np.frombuffer(b"".join(words.tolist()), np.uint8).reshape(len(words), length)


def _grams(letters: np.ndarray, q: int) -> np.ndarray:
    """The q-grams of each row as numbers, each of its own."""
    out = np.zeros((len(letters), letters.shape[1] - q + 1), np.uint64)
    for i in range(q):
        out = (out << np.uint64(8)) | letters[:, i : i + out.shape[1]].astype(np.uint64)
    return out


def _rarity(letters: np.ndarray, q: int, pairs: np.ndarray) -> np.ndarray:
    """How common each gram is, by the logarithms of its pairs of letters."""
    steps = pairs[letters[:, :-1].astype(np.int64), letters[:, 1:].astype(np.int64)]
    if q == 1:
        return np.zeros(letters.shape, np.int64)
    sums = np.concatenate([np.zeros((len(letters), 1), np.int64), np.cumsum(steps, 1)], 1)
    return sums[:, q - 1 :] - sums[:, : sums.shape[1] - q + 1]


def _prefix(letters: np.ndarray, q: int, pairs: np.ndarray) -> np.ndarray:
    """Which grams lead to keys: the first q + 1 by rarity, gram and place. One edit touches no more than q grams and
    leaves the others in this order, so the first untouched gram is among those of both words."""
    grams = _grams(letters, q)
    order = np.lexsort((grams, _rarity(letters, q, pairs)), axis=1)  # stable: equal grams stay by place
    out = np.zeros(grams.shape, bool)
    np.put_along_axis(out, order[:, : q + 1], True, 1)
    return out


def _class(m: int) -> np.uint64:
    return mixed(np.array([m], np.uint64))[0]


def _key(m: int, grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(mixed(grams + _class(m)) + place.astype(np.uint64)).view(np.int64)


def letter_pairs(words: DataFrame) -> np.ndarray:
    """Logarithms, in 1024ths, of how often letters follow each other in distinct words; the counts are of
    at most 90 times 90 pairs."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in pieces_of(batches, 8192):
            data = np.frombuffer(b" ".join(w.encode("latin-1") for w in b.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    out = np.zeros((256, 256), np.int64)
    for r in words.select("word").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair // 256, r.pair % 256] = int(1024 * np.log1p(r.n))
    return out


def index_rows(words: DataFrame, pairs: np.ndarray, shortest: int = 5) -> DataFrame:
    """(key, short, word, n): each word as the longer one of its class, and as the shorter one of the
    next class at either place that its grams can have in the longer word."""

    def run(batches):
        for b in pieces_of(batches, 4096):
            all_words = np.array([w.encode("latin-1") for w in b.column(0).to_pylist()], object)
            n = b.column(1).to_numpy()
            sizes = np.array([len(w) for w in all_words])
            keys, short, at = [], [], []
            for length in np.unique(sizes).tolist():
                who = np.flatnonzero(sizes == length)
                letters = _codes(all_words[who], length)
                for m in (length, length + 1):
                    q = gram_length(m)
                    rows, places = np.nonzero(_prefix(letters, q, pairs))
                    grams = _grams(letters, q)[rows, places]
                    for shift in (0,) if m == length else (0, 1):
                        keys.append(_key(m, grams, places + shift))
                        short.append(np.full(len(rows), m > length))
                        at.append(who[rows])
            if not keys:
                continue
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(short)), pa.array(all_words[at].tolist(), pa.binary()), pa.array(n[at], pa.int64())], ["key", "short", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, short boolean, word binary, n long")


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of a and b, b as long or one shorter, differ by one edit."""
    length = b.shape[1]
    same = a[:, :length] == b
    if a.shape[1] == length:
        return (~same).sum(1) == 1
    ahead = np.where(same.all(1), length, same.argmin(1))
    after = (a[:, 1:] == b)[:, ::-1]
    behind = np.where(after.all(1), length, after.argmin(1))
    return ahead + behind >= length


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counts, its index and 0, 1, ... below it."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def _merge(m: int, group: np.ndarray, own: np.ndarray, rank: np.ndarray, letters: list[np.ndarray]):
    """Pairs (i, j) of rows of one class that share a key and, besides the key's, enough grams.

    Rows come by group; rank says who looks for whom: 0 looks for all of the group that come after it,
    1 (long words of other tiles) and 2 (shorter words) are only found. Postings of (group, gram, place)
    are lists of rows; a row's lists are merged by sorting, and counted.
    """
    q, need = gram_length(m), overlap_bound(m) - 1
    post, who = [], []
    for short in (0, 1):
        rows = np.flatnonzero((rank == 2) == bool(short))
        if not len(rows):
            continue
        grams = _grams(letters[short], q)
        places = np.broadcast_to(np.arange(grams.shape[1]), grams.shape)
        for shift in (0, 1) if short else (0,):
            full = mixed(grams + _class(m)) + (places + shift).astype(np.uint64)
            other = mixed(full).view(np.int64) != own[rows][:, None]
            r, c = np.nonzero(other)
            post.append(mixed(mixed(full)[r, c] ^ (group[rows][r].astype(np.uint64) << np.uint64(20))))
            who.append(rows[r])
    post, who = np.concatenate(post), np.concatenate(who)
    # each list: who looks for others first, then long words, then shorter ones
    order = np.lexsort((who, rank[who], post))
    post, who = post[order], who[order]
    ends = np.searchsorted(post, post, "right")
    many = np.where(rank[who] == 0, ends - np.arange(len(post)) - 1, 0)
    # all lists of a looking row are merged at once, as many rows at a time as fit
    seek = np.flatnonzero(many)
    seek = seek[np.argsort(who[seek], kind="stable")]
    total = np.cumsum(many[seek])
    at = 0
    while at < len(seek):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ENTRIES, "right")))
        while to < len(seek) and who[seek[to]] == who[seek[to - 1]]:
            to += 1
        part = seek[at:to]
        index, step = _spread(many[part])
        i, j = who[part[index]], who[part[index] + 1 + step]
        pairs, counts = np.unique(i * np.int64(len(group)) + j, return_counts=True)
        pairs = pairs[counts >= need]
        i, j = pairs // len(group), pairs % len(group)
        yield i, j
        at = to


def near_pairs(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n): the pairs of words at one edit, both ways, some more than once.

    Keys of more than TILE_ROWS rows are dealt to tiles; a tile's own words look through all of
    the key's, so that no task has to pair more, and no pair is lost.
    """
    rows = checkpointed(rows)
    total = rows.count()
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles")).where("tiles > 1")
    parts = checkpointed(parts)
    dealt = rows.join(parts, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    home = ~F.col("short") & (F.pmod(F.xxhash64("word"), F.col("tiles")) == F.col("tile"))
    rank = F.when(home, 0).when(~F.col("short"), 1).otherwise(2).cast("byte")
    buckets = max(1, -(-total // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key", "tile"), F.lit(buckets)).cast("int")
    dealt = dealt.select(bucket.alias("bucket"), "key", "tile", rank.alias("rank"), "word", "n")

    def run(t: pa.Table) -> pa.Table:
        keys, tile, rank = (t.column(c).to_numpy() for c in ("key", "tile", "rank"))
        words, n = np.array(t.column("word").to_pylist(), object), t.column("n").to_numpy()
        length = np.array([len(w) for w in words])
        m = length + (rank == 2)
        found = []
        for size in np.unique(m).tolist():
            rows = np.flatnonzero(m == size)
            _, group = np.unique(np.stack([keys[rows], tile[rows].astype(np.int64)], 1), axis=0, return_inverse=True)
            group = group.reshape(-1)
            order = np.lexsort((rank[rows], group))
            rows, group = rows[order], group[order]
            r = rank[rows]
            letters = [_codes(words[rows[r != 2]], size), _codes(words[rows[r == 2]], size - 1)]
            place = np.where(r == 2, np.cumsum(r == 2), np.cumsum(r != 2)) - 1
            for i, j in _merge(size, group, keys[rows], r, letters):
                for short in (0, 1):
                    these = (r[j] == 2) == bool(short)
                    a, b = i[these], j[these]
                    ok = _one_edit(letters[0][place[a]], letters[short][place[b]])
                    found.append((rows[a[ok]], rows[b[ok]]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        text = lambda at: pa.array([w.decode("latin-1") for w in words[at]], pa.string())
        return pa.table([text(pairs[:, 0]), pa.array(n[pairs[:, 0]], pa.int64()), text(pairs[:, 1]), pa.array(n[pairs[:, 1]], pa.int64())], ["word", "n", "near", "near_n"])

    return dealt.groupBy("bucket").applyInArrow(trimmed(run), "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling steps. A form has at least
    twice its word's occurrences, so no chain is longer than the logarithm of the largest number."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame, shortest: int = 5, least: int = 3, period: int = 97, times: int = 2) -> DataFrame:
    """Words of all texts of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    A word's form is its near word (one code point inserted, deleted or replaced) with most
    occurrences, of equal ones the first in code-point order, if those are at least `times` the
    word's own; else null. The root is the last of the forms in a row, the word itself where there is none.
    Texts of any length are read whole, and words may have any length. Null texts have no words; rows that
    repeat a text or an id count again. Other columns are not looked at. An empty table gives an
    empty result.
    """
    words = checkpointed(count_words(docs, shortest, least, period))
    found = near_pairs(index_rows(words, letter_pairs(words), shortest)).distinct()
    best = F.min(F.struct((-F.col("near_n")).alias("fewer"), "near"))
    near = checkpointed(found.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("own")))
    holds = -F.col("best.fewer") >= times * F.col("own")
    near = near.select("word", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.fewer")).alias("form_n"))
    top = roots(near.where("form IS NOT NULL"))
    return words.join(near, "word", "left").join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
