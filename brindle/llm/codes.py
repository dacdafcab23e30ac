"""Product codes of vectors: integer k-means codebooks per part, exact distances behind lower bounds.

A vector's components become integers and are cut into equal parts, each with a codebook of its
own. The nearest entry is found coarse to fine: sums over one, two, four ... segments of a part
and the norm of what the segments' means leave give a lower bound of every distance; entries whose
bound passes the distance of the best-looking entry drop out, and what survives gets its exact
integer distance. Codebooks move by sums that tasks make and Spark adds up: no more rows than the
codebooks have numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces_of

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a limb in which sums travel, so that no sum of them leaves 64 bits.
LIMB = 31
_MASK = (1 << LIMB) - 1
LONG = (1 << 63) - 1


def floors(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit where they all fit, else Python integers."""
    if not len(values) or np.abs(values).max() < 2.0**53 / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in values.tolist()], object)


def narrow(a: np.ndarray, width: int) -> np.ndarray:
    """The numbers as 64-bit ones if squared distances over `width` of them are safe there, else as Python integers."""
    most = int(abs(a).max()) if a.size else 0
    safe = 8 * most * most * max(width, 1) ** 2 < LONG
    return a.astype(np.int64) if safe else a.astype(object)


class Book:
    """A part's entries with what the bounds need of them."""

    def __init__(self, entries: np.ndarray):
        self.width = entries.shape[1]
        self.entries = narrow(entries, self.width)
        self.exact = self.entries.dtype == object
        if self.width and not self.exact:
            self.levels = [(cut, *_segments(self.entries, cut)) for cut in _cuts(self.width)]
            self.square = (self.entries.astype(float) ** 2).sum(1)

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equal ones, and its squared distance."""
        if not self.width:
            return np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        if self.exact or p.dtype == object:
            d = ((p.astype(object)[:, None, :] - self.entries.astype(object)[None]) ** 2).sum(2)
            best = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
            return best, d[np.arange(len(p)), best]
        # rounding can raise a bound by no more than this share of the squares
        slack = 1e-10 * ((p.astype(float) ** 2).sum(1)[:, None] + self.square[None])
        rows = columns = limit = None
        for cut, means, rest in self.levels:
            mine, left = _segments(p, cut)
            if rows is None:
                bound = (left[:, None] - rest[None]) ** 2
                for s in range(means.shape[1]):
                    bound += (mine[:, s, None] - means[None, :, s]) ** 2
                bound -= slack
                first = bound.argmin(1)
                limit = ((p - self.entries[first]) ** 2).sum(1)
                rows, columns = np.nonzero(bound <= limit[:, None])
            else:
                bound = ((mine[rows] - means[columns]) ** 2).sum(1) + (left[rows] - rest[columns]) ** 2 - slack[rows, columns]
                stays = bound <= limit[rows]
                rows, columns = rows[stays], columns[stays]
        d = ((p[rows] - self.entries[columns]) ** 2).sum(1)
        order = np.lexsort((columns, d, rows))
        top = order[np.searchsorted(rows, np.arange(len(p)))]  # rows ascend, so each row's places start there
        return columns[top], d[top]


def _cuts(width: int) -> list[np.ndarray]:
    """Starts of the segments of each level: one, two, four ... as long as a segment has two numbers."""
    out, n = [], 1
    while n == 1 or 2 * n <= width:
        out.append(np.arange(n) * width // n)
        n *= 2
    return out


def _segments(a: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment means times the root of their length, and the norm of what the means leave. What is under
    the root is a whole number, so that nothing cancels."""
    length = np.diff(np.append(cut, a.shape[1]))
    sums, squares = np.add.reduceat(a, cut, axis=1), np.add.reduceat(a * a, cut, axis=1)
    return sums / np.sqrt(length), np.sqrt(((squares * length - sums * sums) / length).sum(1))


def _vectors(batch: pa.RecordBatch, at: int, width: int, parts: int) -> np.ndarray:
    """Rows by parts by places, as integers; zeros fill the last part where the width doesn't divide."""
    flat = floors(batch.column(at).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, width)
    short = -width % parts
    if short:
        flat = np.concatenate([flat, np.zeros((len(flat), short), flat.dtype)], 1)
    return flat.reshape(len(flat), parts, (width + short) // parts)


def kept(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is there and has finite components only."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.where(F.col("v").isNotNull()).where(~bad)
    return d if width is None else d.where(F.size("v") == width)


def _sums(rows: DataFrame, books: list[Book], width: int) -> dict[tuple[int, int], int]:
    """Sum of each codebook number's place over the parts that chose its entry, and at place -1 their number."""
    parts = len(books)
    span = books[0].width

    def run(batches):
        count = np.zeros((parts, ENTRIES), np.int64)
        total = np.zeros((parts, ENTRIES, span), np.int64)
        for b in pieces_of(batches, 2048):
            x = _vectors(b, 0, width, parts)
            for part, book in enumerate(books):
                p = narrow(x[:, part], span)
                best, _ = book.nearest(p)
                count[part] += np.bincount(best, minlength=ENTRIES)
                if total.dtype != object and (p.dtype == object or int(abs(total).max(initial=0)) > 1 << 61):
                    total = total.astype(object)
                np.add.at(total[part], best, p)
        out = [[], [], [], []]
        for part, entry in zip(*np.nonzero(count), strict=True):
            cell = int(part) * ENTRIES + int(entry)
            for place, value in [(-1, int(count[part, entry])), *enumerate(map(int, total[part, entry]))]:
                sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
                while value:
                    for column, y in zip(out, (cell, place, limb, sign * (value & _MASK)), strict=True):
                        column.append(y)
                    value >>= LIMB
                    limb += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["cell", "place", "limb", "value"])

    found = rows.select("v").mapInArrow(run, "cell long, place long, limb long, value long").groupBy("cell", "place", "limb").agg(F.sum("value").alias("value")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in found:
        sums[r.cell, r.place] = sums.get((r.cell, r.place), 0) + (r.value << (LIMB * r.limb))
    return sums


def train(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[list[Book], int] | None:
    """Codebooks by part, and the vectors' width; None where no row can be kept.

    The width is that of the kept row with the smallest id. Entries start as that row and the next of
    this width, at most 64 by id (null ids last, rows of one id by their numbers), and move to the
    floors of their parts' means; an entry that no part chooses stays.
    """
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    start = kept(vectors).orderBy(*order).limit(ENTRIES).collect()
    if not start:
        return None
    width = len(start[0].v)
    if any(len(r.v) != width for r in start):
        start = kept(vectors, width).orderBy(*order).limit(ENTRIES).collect()
    first = pa.RecordBatch.from_arrays([pa.array([r.v for r in start], pa.list_(pa.float64()))], ["v"])
    entries = _vectors(first, 0, width, parts).astype(object)
    rows = kept(vectors, width)
    for _ in range(rounds):
        sums = _sums(rows, [Book(entries[:, part]) for part in range(parts)], width)
        for (cell, place), value in sums.items():
            if place >= 0:
                entries[cell % ENTRIES, cell // ENTRIES, place] = value // sums[cell, -1]
        for cell, place in [k for k in sums if k[1] < 0]:
            for i in range(entries.shape[2]):
                if (cell, i) not in sums:
                    entries[cell % ENTRIES, cell // ENTRIES, i] = 0
    return [Book(entries[:, part]) for part in range(parts)], width


def encode(vectors: DataFrame, books: list[Book], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every kept row; code and error are null for a vector of another
    width, and the error where it passes 64 bits."""
    parts, span = len(books), books[0].width
    same = F.size("v") == width

    def run(batches):
        for b in pieces_of(batches, 2048):
            x = _vectors(b, 0, width, parts)
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for part, book in enumerate(books):
                codes[:, part], d = book.nearest(narrow(x[:, part], span))
                errors = errors + d
            text = [row.tobytes().hex() for row in codes]
            told = [e if e <= LONG else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(text, pa.string()), pa.array(told, pa.int64())], ["vec_id", "label", "code", "error"])

    rows = kept(vectors)
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.where(same).select("v", "vec_id", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")
    return coded.unionByName(rows.where(~same).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))


def digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.entries.tolist() for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all rows of `vectors` (vec_id, embedding, label): vec_id, code (an entry's index by part, two
    hex digits each), error (squared distances summed), label_error (of all rows of the label; null labels
    are one) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components have no row. Vectors of another
    width than that of the smallest id have neither code nor error; a width that the parts don't divide
    is filled with zeros. Numbers of any size are exact; an error or label_error beyond 64 bits is null.
    Equal vectors, repeated ids and null ids count row by row. Columns beside the three are not
    carried. An empty table, or one without a vector, gives an empty result.
    """
    fitted = train(vectors, parts, rounds)
    if fitted is None:
        return kept(vectors).where(F.lit(False)).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    books, width = fitted
    coded = checkpointed(encode(vectors, books, width))
    # a table of its own: both sides of the join are then plain shuffles, which adaptive execution splits at a frequent label
    beyond = F.max(F.col("code").isNotNull() & F.col("error").isNull())
    total = F.when(~beyond, F.sum(F.col("error").cast("decimal(38,0)")))
    sums = checkpointed(coded.groupBy("label").agg(total.alias("total")).select(F.col("label").alias("of"), F.expr("try_cast(total AS bigint)").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
