"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The counts of their vote
patterns over the whole corpus go through expectation-maximisation, which estimates the
quality share and every labeller's vote rates on good and on bad documents. The posterior of
a document's pattern is its label. A linear scorer on hashed features is trained on a sample
of bounded size with these labels, and scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, pieces_of, utf8
from .textscan import CHUNK, LOWER, mixed, rolling, word_bounds, word_hashes

#: Documents at most that the scorer is trained on, those with the smallest hashes of their ids.
SAMPLE = 5_000
#: Hashed features: 2 to this power.
BITS = 14
#: Words on end of which variety counts the distinct ones, so that long texts compare with short ones.
SPAN = 1_000
ROUNDS = 200
#: How much all words together weigh beside all trigrams.
WORDS_WEIGHT = 0.5

_CLASS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()?-", b"!", b"|", b"#$%&*@^~=+_<>{}[]\\/`"), 1):
    _CLASS[list(_bytes)] = _kind
_CLASS[128:] = 9
LABELLERS = ("symbols", "capitals", "exclamation", "table", "echo", "lines", "odd", "unclean", "variety")


def signals(text: bytes) -> np.ndarray:
    """Rates that the labellers look at: symbols, capitals, exclamation marks and bars by
    character or word; words that repeat the one before; lines that repeat an earlier one;
    characters of no kind that prose has, and words with one; distinct words of every thousand
    on end, as a share of all words."""
    data = np.frombuffer(text, np.uint8)
    kinds = _CLASS[data]
    n = np.bincount(kinds, minlength=10)
    letters, chars = max(1, n[1] + n[2] + n[9]), max(1, len(data) - n[4])
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    many = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line]
    # a few words are no evidence: rates count in full from ten words on
    weight = min(1.0, len(words) / 10)
    rates = [n[8] / chars, n[2] / letters, n[6] / many, n[7] / many, (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines))]
    odd = np.isin(kinds, (6, 7, 8))
    sums = np.concatenate([[0], np.cumsum(odd)])
    rates += [odd.sum() / chars, float((sums[ends] > sums[starts]).mean()) if len(words) else 0.0]
    variety = sum(len(np.unique(words[at : at + SPAN])) for at in range(0, len(words), SPAN)) / many
    return np.array([*(x * weight for x in rates), 1 - (1 - variety) * weight, len(words)])


#: A labeller votes good up to the first rate, bad from the second, and nothing between.
RATES = ((0.01, 0.05), (0.15, 0.4), (0.02, 0.1), (0.02, 0.1), (0.02, 0.2), (0.1, 0.5), (0.01, 0.05), (0.1, 0.4))
VARIETY = (0.5, 0.25)
#: What is believed of a labeller beforehand (votes bad, good, nothing), on bad and on good documents: it misses
#: much that is bad, and hardly ever calls a good document bad. Counts as that share of the corpus.
BELIEF = np.array([[0.3, 0.6, 0.1], [0.002, 0.9, 0.098]])
BELIEF_SHARE = 0.2


def votes(s: np.ndarray) -> list[int]:
    """1 good, 0 bad, 2 nothing, in the order of LABELLERS."""
    out = [1 if x <= good else 0 if x >= bad else 2 for x, (good, bad) in zip(s[:8], RATES, strict=True)]
    # few words tell nothing about variety
    out.append(2 if s[9] < 20 else 1 if s[8] >= VARIETY[0] else 0 if s[8] <= VARIETY[1] else 2)
    return out


def _code(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def _decode(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELLERS))]


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation-maximisation over vote patterns: the posterior of good for each pattern,
    the vote rates (labeller, class bad or good, vote), and the share of good documents."""
    codes = sorted(counts)
    v = np.array([_decode(c) for c in codes], np.int64).reshape(len(codes), len(LABELLERS))
    n = np.array([counts[c] for c in codes], float)
    good = np.where((v == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        share = (n @ good + 1) / (n.sum() + 2)
        rates = np.empty((len(LABELLERS), 2, 3))
        for k, w in enumerate((n * (1 - good), n * good)):
            for i in range(len(LABELLERS)):
                c = np.bincount(v[:, i], weights=w, minlength=3) + BELIEF_SHARE * n.sum() * BELIEF[k]
                rates[i, k] = c / max(c.sum(), 1e-300)
        score = np.log(share / (1 - share)) + sum((np.log(rates[i, 1, v[:, i]] / rates[i, 0, v[:, i]]) for i in range(len(LABELLERS))), np.zeros(len(codes)))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return dict(zip(codes, good.tolist(), strict=True)), rates, float(share)


def features(text: bytes, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: words in ASCII lower case and trigrams of byte classes, each
    by root of frequency and of length 1, and the signals' steps."""
    size, parts = 1 << BITS, []
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    words = word_hashes(LOWER[data], starts, ends)
    parts.append(np.unique((words >> np.uint64(20)) & np.uint64(size - 1), return_counts=True))
    total = np.zeros(size)
    for at in range(0, max(1, len(data) - 2), CHUNK):
        total += np.bincount((rolling(_CLASS[data[at : at + CHUNK + 2]].astype(np.uint8), 3) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    at = np.flatnonzero(total)
    parts.append((at, total[at]))
    values = [np.sqrt(count) for _, count in parts]
    values = [v / max(1e-12, np.linalg.norm(v)) for v in values]
    steps = np.array([int(min(x, 1.0) * 20) for x in s[:9]]) + np.arange(9) * 32 + (1 << 20)
    own = (mixed(steps.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    return np.concatenate([*(at.astype(np.int64) for at, _ in parts), own]), np.concatenate([WORDS_WEIGHT * values[0], values[1], np.full(9, 0.5)])


def train(got: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 12, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer of hashed features, the last the bias; each class weighs the same."""
    weights = np.zeros((1 << BITS) + 1)
    share = min(max(float(np.mean(labels)), 0.02), 0.98) if len(labels) else 0.5
    order = np.random.default_rng(4).permutation(len(got))
    for turn in range(passes):
        step = rate / (1 + turn)
        for i in order:
            at, x = got[i]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30)))
            y = labels[i]
            g = step * (y - p) * (0.5 / share * y + 0.5 / (1 - share) * (1 - y))
            np.add.at(weights, at, g * x)
            weights[-1] += 0.1 * g
    return weights


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of every row."""

    def run(batches):
        for b in pieces_of(batches):
            codes = [_code(votes(signals(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32())], ["doc_id", "pattern"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, pattern int")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """Weights of the scorer, and what the weak-label model found.

    The vote counts cover all rows; only the training texts are a bounded sample, drawn by
    hash of id and text in tasks, labelled by the posteriors. Texts of any length may be drawn;
    rows that repeat an id and a text are drawn together, and any of them are left out where
    the bound cuts among them. Without rows the scorer is all zeros.
    """
    # at most 3 to the number of labellers rows
    counts = {r["pattern"]: r["n"] for r in vote_patterns(docs).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, rates, share = estimate(counts)
    total = sum(counts.values())
    chosen = docs.select(F.xxhash64("doc_id", "text", F.lit(4)).alias("draw"), utf8(F.col("text")).alias("text"))
    if total > sample:
        # a hash threshold keeps the draw spread over all tasks; the rest is then cut exactly
        chosen = chosen.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / total)))

    def run(batches):
        for b in pieces_of(batches):
            texts = b.column(1).to_pylist()
            seen = [signals(t) for t in texts]
            got = [features(t, s) for t, s in zip(texts, seen, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_code(votes(s)) for s in seen], pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())],
                ["draw", "pattern", "at", "x"],
            )

    rows = chosen.mapInArrow(run, "draw long, pattern int, at binary, x binary").orderBy("draw").limit(sample).collect()
    weights = train([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows], np.array([posterior[r["pattern"]] for r in rows]))
    return weights, {"share": share, "rates": rates, "posterior": posterior}


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of `docs` with quality_score (0 to 1), weak_label (the posterior
    of its votes) and keep (score at least `threshold`).

    A null or empty text has no signals: it scores what the scorer says of no features, and
    is kept only if that reaches the threshold. Texts of any length are read whole. Repeated rows
    score alike, and rows without an id like others. Columns of `docs` with the added names are
    replaced. An empty table gives an empty result.
    """
    docs = docs.drop("quality_score", "weak_label", "keep")
    weights, model = fit(docs, sample)
    posterior = model["posterior"]
    schema = StructType(list(docs.schema.fields)).add("quality_score", "double").add("weak_label", "double").add("keep", "boolean")
    at = docs.columns.index("text")

    def run(batches):
        for b in pieces_of(batches):
            scores, labels = [], []
            for t in b.column(at).to_pylist():
                t = (t or "").encode()
                s = signals(t)
                i, x = features(t, s)
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[i] @ x + weights[-1], -30, 30)))))
                labels.append(posterior[_code(votes(s))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(labels, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], [*b.schema.names, "quality_score", "weak_label", "keep"])
            give_back()

    return docs.mapInArrow(run, schema)
