"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Tasks count the n-grams of blocks of text and deal them, packed by ranges of a hash, to shards. A
shard merges its range, writes it as a sorted array of hashes with counts, and sends on what the
next lower order needs: the n-grams' endings, counted once each, and their beginnings with numbers
of followers. Discounts come from counts of counts of a whole order. Scoring moves no text and no
n-gram: tasks map the arrays, read-only, and look up sorted hashes of many documents at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpointed, give_back, pieces_of, trimmed, utf8
from .textscan import LOWER, from_planes, mixed, planes, word_bounds, word_hashes

#: Words are known by 48 bits of their hash: at 10^9 distinct words two thousand in all share one with another.
_WORD_BITS = 48
BEGIN, END = 0, 1
#: Tokens that a task counts at a time, or looks up at a time.
BLOCK, LOOKUP = 1_500_000, 1_000_000
#: Text bytes whose n-grams make one shard, and ranges that one exchange deals to. More shards take two exchanges.
SHARD_BYTES, WAYS = 12_000_000, 512
#: Parts of a range in the first of two exchanges.
SPREAD = 256
_PACKED = "range long, part long, n long, words array<binary>, numbers array<binary>"
#: Of an entry: how often it counts (at the highest order its occurrences, below it the distinct words before
#: it), occurrences as a last word, and of what follows it: sum, and numbers of followers that count 1, 2, 3 and more.
FIELDS = ("count", "occurrences", "total", "one", "two", "more")


def _tokens(text: bytes) -> np.ndarray:
    """Words in ASCII lower case as hashes, and one end."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = word_bounds(data)
    words = np.maximum(word_hashes(data, starts, ends) >> np.uint64(64 - _WORD_BITS), np.uint64(END + 1))
    return np.append(words, np.uint64(END))


def _hash(grams: np.ndarray) -> np.ndarray:
    """A hash of each column of words."""
    out = np.full(grams.shape[1], np.uint64(len(grams)), np.uint64)
    for words in grams:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(1))
    return out


def _grams(texts: list[np.ndarray], order: int) -> np.ndarray:
    """The n-gram that ends at each token, by columns; begins stand before a text."""
    size = sum(map(len, texts))
    at = np.cumsum([0, *map(len, texts)])[:-1]
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    out = np.empty((order, size), np.uint64)
    place = np.arange(size) - np.repeat(at, [len(t) for t in texts])
    for back in range(order):
        shifted = np.full(size, np.uint64(BEGIN), np.uint64)
        inside = place >= back
        shifted[inside] = flat[np.flatnonzero(inside) - back]
        out[order - 1 - back] = shifted
    return out


def _merged(grams: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, words and summed numbers of equal n-grams."""
    h = _hash(grams)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(numbers[:, order], first, axis=1) if len(h) else numbers
    return h[first], grams[:, order[first]], sums


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    """Numbers that are mostly small, packed."""
    raw = planes(values.astype("<i8"))
    return len(values).to_bytes(8, "little") + pa.compress(raw, "zstd").to_pybytes()


def _unsmall(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return from_planes(pa.decompress(data[8:], 8 * n, "zstd").to_pybytes(), "<i8") if n else np.zeros(0, np.int64)


def _words(values: np.ndarray) -> bytes:
    """48-bit numbers, by significance of bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unwords(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _dealt(grams: np.ndarray, numbers: np.ndarray, ranges: int, part: int) -> pa.RecordBatch:
    """Merged n-grams as one packed row for each range that has any."""
    h, grams, numbers = _merged(grams, numbers)
    at = np.searchsorted(_range(h, ranges), np.arange(ranges + 1))
    has = np.flatnonzero(np.diff(at))
    rows = []
    for r in has.tolist():
        # by their first words, whose high bytes then repeat
        own = np.arange(at[r], at[r + 1])
        own = own[np.argsort(grams[0, own], kind="stable")]
        rows.append((r, part, len(own), [_words(w) for w in grams[:, own]], [_small(x) for x in numbers[:, own]]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["range", "part", "n", "words", "numbers"])


def _opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words = [np.stack([_unwords(w) for w in row]) for row in t.column("words").to_pylist()]
    numbers = [np.stack([_unsmall(x) for x in row]) for row in t.column("numbers").to_pylist()]
    return np.concatenate(words, 1), np.concatenate(numbers, 1)


def _exchanged(rows: DataFrame, shards: int) -> DataFrame:
    """Packed rows of WAYS ranges dealt on to the shards, in tasks of a range and a part of the blocks,
    so that a row to a shard stays large however many shards there are."""
    if shards <= WAYS:
        return rows

    def run(t: pa.Table) -> pa.Table:
        grams, numbers = _opened(t)
        return pa.Table.from_batches([_dealt(grams, numbers, shards, t.column("part")[0].as_py())])

    return rows.groupBy("range", "part").applyInArrow(trimmed(run), _PACKED)


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays of unsigned numbers, in as many bytes each as their largest needs, under a folder that
    all tasks share; a task that runs again writes the same."""
    fs, path = pafs.FileSystem.from_uri(folder)
    for field, a in arrays.items():
        a = a if a.dtype == np.uint64 else a.astype(np.min_scalar_type(int(a.max(initial=0))))
        own = f"{path}/{name}.{field}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(np.ascontiguousarray(a).data)
        fs.move(own, f"{path}/{name}.{field}")


def _mapped(folder: str, name: str, n: int) -> np.ndarray:
    """A stored array of n numbers, mapped where the folder is mounted, else read: one shard's at a time."""
    fs, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    dtype = f"<u{fs.get_file_info(path).size // n}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


@dataclass
class Model:
    """Where the arrays are, by order from 1: ranges and discounts for counts of 1, 2 and more; and the
    training tokens, their distinct ones, and the sum of the words' counts at order 1."""

    folder: str
    order: int
    shards: list[int]
    discounts: list[np.ndarray]
    tokens: int
    distinct: int
    ground: np.ndarray

    def delete(self) -> None:
        fs, path = pafs.FileSystem.from_uri(self.folder)
        fs.delete_dir(path)


def _shared(df: DataFrame) -> str:
    """A new folder in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    checkpointed(df.limit(0))  # sets the folder where a test has none
    folder = context._jsc.sc().getCheckpointDir().get()
    folder = folder if ":/" in folder else f"file://{folder}"
    out = f"{folder}/lm-{uuid.uuid4().hex}".replace("file:/", "file:///", 1).replace("file://///", "file:///")
    fs, path = pafs.FileSystem.from_uri(out)
    fs.create_dir(path)
    return out


def _discounts(of: dict[int, int]) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more, from how many entries count 1 to 4; where a number is
    missing, half, one and one and a half."""
    n = [of.get(i, 0) for i in (1, 2, 3, 4)]
    out = np.array([0, 0.5, 1.0, 1.5])
    if all(n[:3]):
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1]
            out[k] = d if 0 < d < k else out[k]
    return out


def _followers(count: np.ndarray) -> np.ndarray:
    """By column: the count, and whether it is 1, 2 or more."""
    return np.stack([count, count == 1, count == 2, count > 2]).astype(np.int64)


def train(docs: DataFrame, order: int = 2, learns: Column | None = None, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of all texts of `docs` (text; null is empty) for which `learns` holds (default: all).

    A text's tokens are its words, parted by ASCII white space, in ASCII lower case, and one end; begins
    stand before it. At the highest order an n-gram counts its occurrences, below it the distinct words
    before it (occurrences where those are begins only). Texts of any length are read whole. A text
    that repeats counts again. Without any text the model knows nothing and gives every text probability 1.
    """
    docs = docs.where(learns) if learns is not None else docs
    texts = docs.select(utf8(F.col("text")).alias("text"))
    folder = _shared(texts)
    size = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    shards = [max(1, -(-size // (shard_bytes * (1 if k == order else 8)))) for k in range(1, order + 1)]
    ways = min(WAYS, shards[-1])

    def count(batches):
        held, size, block = [], 0, 0
        base = uuid.uuid4().int % SPREAD  # any part will do: parts are only summed

        def emit():
            grams = _grams(held, order)
            return _dealt(grams, np.ones((1, grams.shape[1]), np.int64), ways, (base + block) % SPREAD)

        for b in pieces_of(batches):
            for text in b.column(0).to_pylist():
                held.append(_tokens(text))
                size += len(held[-1])
                if size > BLOCK:
                    yield emit()
                    held, size, block = [], 0, block + 1
        if held:
            yield emit()
        held = []
        give_back()

    rows = texts.mapInArrow(count, _PACKED)
    found: list[dict[int, int]] = []
    for k in range(order, 1, -1):
        rows, counts = _level(_exchanged(rows, shards[k - 1]), folder, k, k == order, shards[k - 2])
        found.append(counts)
    ground, counts = _ground(_exchanged(rows, shards[0]), folder, order)
    found.append(counts)
    discounts = [_discounts(c) for c in reversed(found)]
    return Model(folder, order, shards, discounts, int(ground[1]), int(ground[2]), ground[[0, 3, 4, 5]])


def _counts(rows: DataFrame) -> dict[int, int]:
    """How many entries count 1, 2, 3 and 4, from rows that are about them."""
    return {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}


_OWN = "range = -1"


def _level(rows: DataFrame, folder: str, k: int, top: bool, lower: int) -> tuple[DataFrame, dict[int, int]]:
    """Store order k and give the packed rows of the order below, and the counts of counts.

    Rows carry n-grams of k words with a count each, or below the highest order all fields."""
    ways = min(WAYS, lower)

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("range")[0].as_py()
        h, grams, numbers = _merged(*_opened(t))
        if top:
            numbers = np.concatenate([numbers, numbers, np.zeros((4, len(h)), np.int64)])
        _store(folder, f"{k}.{shard}", {"hash": h, **dict(zip(FIELDS[:1] if top else FIELDS, numbers, strict=False))})
        own = numbers[0] > 0  # an entry may be there for what follows it only
        grams, numbers = grams[:, own], numbers[:, own]
        count, occurrences = numbers[0], numbers[1]
        zero = np.zeros_like(count)
        once = np.where(grams[1] == BEGIN, count, 1) if k > 2 else np.ones_like(count)
        ends = np.stack([once, occurrences, *(zero,) * 4])
        starts = np.concatenate([np.stack([zero, zero]), _followers(count)])
        out = [_dealt(np.concatenate([grams[1:], grams[:-1]], 1), np.concatenate([ends, starts], 1), ways, shard % SPREAD)]
        some = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
        out.append(pa.RecordBatch.from_arrays([pa.array([-1] * 4, pa.int64()), pa.array([1, 2, 3, 4], pa.int64()), pa.array(some, pa.int64()), pa.array([None] * 4, pa.list_(pa.binary())), pa.array([None] * 4, pa.list_(pa.binary()))], out[0].schema.names))
        return pa.Table.from_batches(out)

    below = checkpointed(rows.groupBy("range").applyInArrow(trimmed(run), _PACKED))
    return below.where(~F.expr(_OWN)), _counts(below.where(_OWN))


def _ground(rows: DataFrame, folder: str, order: int) -> tuple[np.ndarray, dict[int, int]]:
    """Store order 1; gives the sums of counts, occurrences, distinct tokens and numbers of words that
    count 1, 2 and more, and the counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("range")[0].as_py()
        h, grams, numbers = _merged(*_opened(t))
        if len(numbers) == 1:  # a model of order 1
            numbers = np.concatenate([numbers, numbers, np.zeros((4, len(h)), np.int64)])
        _store(folder, f"1.{shard}", {"hash": h, **dict(zip(FIELDS, numbers, strict=True))})
        count = numbers[0]
        sums = [count.sum(), numbers[1].sum(), (numbers[1] > 0).sum(), *_followers(count)[1:].sum(1)]
        some = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
        return pa.table([pa.array(range(10), pa.int64()), pa.array(np.array([*sums, *some], np.int64))], ["what", "n"])

    got = {r.what: r.n for r in rows.groupBy("range").applyInArrow(trimmed(run), "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(i, 0) for i in range(6)], np.int64), {i: got.get(5 + i, 0) for i in (1, 2, 3, 4)}


def _look_up(model: Model, k: int, grams: np.ndarray, fields: tuple[str, ...]) -> np.ndarray:
    """The fields of each n-gram, 0 where there is no entry: sorted hashes against one mapped shard after the other."""
    h, back = np.unique(_hash(grams), return_inverse=True)
    out = np.zeros((len(fields), len(h)), np.int64)
    at = np.searchsorted(_range(h, model.shards[k - 1]), np.arange(model.shards[k - 1] + 1))
    fs, path = pafs.FileSystem.from_uri(model.folder)
    for shard in np.flatnonzero(np.diff(at)).tolist():
        stored = fs.get_file_info(f"{path}/{k}.{shard}.hash")
        if stored.type == pafs.FileType.NotFound:
            continue  # no n-gram fell into the range
        n = stored.size // 8
        keys = _mapped(model.folder, f"{k}.{shard}.hash", n)
        own = slice(at[shard], at[shard + 1])
        place = np.minimum(np.searchsorted(keys, h[own]), n - 1)
        hit = np.flatnonzero(keys[place] == h[own])
        for i, f in enumerate(fields):
            out[i, at[shard] + hit] = _mapped(model.folder, f"{k}.{shard}.{f}", n)[place[hit]]
    return out[:, back.reshape(-1)]


def _probabilities(model: Model, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each n-gram's last word after the others, and the word's occurrences in training."""
    count, occurrences = _look_up(model, 1, grams[-1:], ("count", "occurrences"))

    def mixture(k, count, total, kinds, lower):
        d = model.discounts[k - 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            own = (np.maximum(count - d[np.minimum(count, 3)], 0) + (d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[2]) * lower) / total
        return np.where(total > 0, own, lower)

    total, *kinds = model.ground
    p = mixture(1, count, np.full(len(count), total), kinds, 1 / (model.distinct + 1))
    for k in range(2, model.order + 1):
        total, *kinds = _look_up(model, k - 1, grams[-k:-1], FIELDS[2:])
        count = _look_up(model, k, grams[-k:], ("count",))[0]
        p = mixture(k, count, total, kinds, p)
    return p, occurrences


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs` with n_tokens, n_known (tokens that occur in training), base_score
    (log10 probability by add-one counts of single tokens), score (log10 probability by the model) and
    perplexity (by the model, for each token).

    A null text is empty: its one token is the end. Texts of any length are read whole. Columns of `docs`
    with the added names are replaced. Rows that repeat score alike. An empty table gives an empty result.
    """
    added = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    docs = docs.drop(*added)
    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, "long" if c.startswith("n_") else "double")
    at = docs.columns.index("text")

    def told(rows: list[pa.RecordBatch], texts: list[np.ndarray]):
        p, seen = _probabilities(model, _grams(texts, model.order))
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        base = np.log10((seen + 1) / (model.tokens + 1 * (model.distinct + 1)))
        sizes = np.array([len(t) for t in texts])
        logs = np.add.reduceat(np.log10(p), starts)
        values = (sizes, np.add.reduceat((seen > 0).astype(np.int64), starts), np.add.reduceat(base, starts), logs, 10 ** (-logs / sizes))
        first = 0
        for b in rows:
            own = slice(first, first + b.num_rows)
            first = own.stop
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v[own]) for v in values)], [*b.schema.names, *added])

    def run(batches):
        rows, texts, size = [], [], 0
        for b in pieces_of(batches):
            if not b.num_rows:
                continue
            rows.append(b)
            for text in b.column(at).to_pylist():
                texts.append(_tokens((text or "").encode()))
                size += len(texts[-1])
            if size > LOOKUP:
                yield from told(rows, texts)
                rows, texts, size = [], [], 0
                give_back()
        if rows:
            yield from told(rows, texts)
        give_back()

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether CRC-32 of the id as text is `fold` modulo `folds`; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
