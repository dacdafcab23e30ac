"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks. A source's target is so many whole passes
over its blocks and a rest, drawn as a prefix of a random permutation of the blocks and
ended document by document. The drawn blocks are the balls of an urn: a tree over groups of
output shards splits each source's block quota in two at every node by a multivariate
hypergeometric draw, and a source's permuted blocks fill its quotas in order, so that the
groups' blocks are disjoint. A group's blocks, permuted, are cut into its output shards, which is the same
draw again. A document is taken once for every shard that its block is dealt to. Inside a
shard the documents are in random order.

Only block and source tables are moved, and the texts once if they are asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, unused

WEIGHTS = (3, 1, 2)
#: Words of a block at least, and blocks of the whole corpus at most (besides one a source).
BLOCK_WORDS = 65_536
MOST_BLOCKS = 1 << 20
#: Blocks of an output shard at most; leaves of the tree on the driver, and strata of sources that it splits.
SHARD_BLOCKS = 8
LEAVES = 1024
STRATA = 256
#: Up to so many sources their table is broadcast; beyond, the join is left to the optimiser.
BROADCAST_SOURCES = 10_000
#: Blocks of a source that are searched at a time for documents that fit what is left of its target.
SEARCHED = 4
#: Up to so many drawn rows (about 90 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Add rank and target to a table of (source, source_size).

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times
    all sizes. A target stops at `most` times its source's size, and the excess is shared
    again by weight among the others until none is above.
    """
    ordered = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    # as many rows as there are sort partitions
    counts = {r["p"]: r["n"] for r in ordered.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    offset = ordered.sparkSession.createDataFrame(offsets or [(0, 0)], "p int, before long")
    low = (1 << 33) - 1
    ranked = ordered.join(F.broadcast(offset), "p").withColumn("rank", F.col("before") + F.col("m").bitwiseAND(F.lit(low)))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    ranked = checkpointed(ranked.select("source", "source_size", "rank", "weight", "cap"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(share) * (total or 0)
    level, capped = total / weight if weight else 0.0, -1
    while True:
        above = F.col("cap") <= level * F.col("weight")
        n, held, free = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return ranked.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("weight", "cap")


def split_quota(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Shard by shard, how many of each kind: the leaves of a tree of hypergeometric splits."""
    total = int(counts.sum())
    even = [total * (k + 1) // shards - total * k // shards for k in range(shards)]

    def split(left: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        if high - low == 1:
            return [left]
        mid = (low + high) // 2
        first = rng.multivariate_hypergeometric(left, sum(even[low:mid]), method="marginals")
        return split(first, low, mid) + split(left - first, mid, high)

    return np.array(split(counts.astype(np.int64), 0, shards))


def _stratum_filler(quotas: dict[int, np.ndarray], seed: int):
    """Split a stratum's quota of each leaf among its sources, down the same tree, and list the leaves of each source's blocks."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        stratum = int(pdf["stratum"].iloc[0])
        rng, quota = np.random.default_rng([seed, 7, stratum]), quotas[stratum]
        upto, lists = np.concatenate([[0], np.cumsum(quota)]), [[] for _ in range(len(pdf))]

        def split(left: np.ndarray, low: int, high: int) -> None:
            if not left.any():
                return
            if high - low == 1:
                for i in np.flatnonzero(left).tolist():
                    lists[i] += [low] * int(left[i])
                return
            mid = (low + high) // 2
            first = rng.multivariate_hypergeometric(left, int(upto[mid] - upto[low]), method="marginals")
            split(first, low, mid)
            split(left - first, mid, high)

        split(pdf["units"].to_numpy(np.int64), 0, len(quota))
        return pd.DataFrame({"rank": pdf["rank"], "leaves": lists})

    return fill


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of some documents of a source, in permuted order, those that fit into what is left of its target
    (their ties), and then one row without a tie: what is left now, the last place seen, and the
    smallest document so far that wasn't taken."""
    pdf = pdf.sort_values(["place", "draw", "tie"]).reset_index(drop=True)
    head = pdf.iloc[0]
    left, took, least = float(head["left"]), [], (head["least"], head["least_tie"])
    for n, tie in zip(pdf["size"].tolist(), pdf["tie"].tolist(), strict=True):
        if n <= left:
            left -= n
            took.append(tie)
        elif n and not n >= least[0]:
            least = (float(n), float(tie))
    out = pd.DataFrame({"rank": int(head["rank"]), "tie": pd.array([*took, None], "Int64")})
    return out.assign(left=left, seen=int(pdf["place"].max()), least=least[0], least_tie=pd.array([None if pd.isna(least[1]) else int(least[1])] * len(out), "Int64"))


_FIT = "rank long, tie long, left double, seen long, least double, least_tie long"


def _picked(rows: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """Ties of the documents that end the sources' targets, of blocks that aren't taken whole.

    A round searches the next few blocks of each source that hold a document which still fits,
    and rounds go on until none does. The smallest document met that didn't fit is taken too where
    that comes nearer to the target.
    """
    part = blocks.where(~F.col("whole") & (F.col("rest") > 0))
    sized = checkpointed(rows.join(part.select("rank", "block", "place"), ["rank", "block"]).select("rank", "place", F.xxhash64(F.lit(seed + 3), "doc_id", "size").alias("draw"), "tie", "size"))
    smallest = checkpointed(sized.where("size > 0").groupBy("rank", "place").agg(F.min("size").alias("smallest")))
    state = part.groupBy("rank").agg(F.min("left").cast("double").alias("left")).select("rank", "left", F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("long").alias("least_tie"))
    taken = None
    while True:
        state = checkpointed(state)
        open_ = smallest.join(state, "rank").where((F.col("place") > F.col("seen")) & (F.col("smallest") <= F.col("left")))
        if taken is None:  # the first blocks, whether or not anything fits
            open_ = smallest.join(state, "rank")
        turn = F.row_number().over(Window.partitionBy("rank").orderBy("place"))
        now = checkpointed(open_.withColumn("turn", turn).where(F.col("turn") <= SEARCHED).drop("turn", "smallest", "seen"))
        if now.isEmpty():
            break
        got = checkpointed(sized.join(now, ["rank", "place"]).groupBy("rank").applyInPandas(_fit, _FIT))
        ties = got.where("tie is not null").select("tie")
        taken = ties if taken is None else taken.unionByName(ties)
        after = got.where("tie is null").drop("tie")
        state = state.join(after.select("rank"), "rank", "left_anti").unionByName(after)
    last = state.where("least - left < left").select(F.col("least_tie").alias("tie"))
    return (last if taken is None else taken.unionByName(last)).withColumn("picked", F.lit(True))


def mix_plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 42) -> DataFrame:
    """Decide how often each document is taken and into which output shards.

    A document's size is its number of words (null text: 0). Returns one row per input row:
    tie (the row's number in this plan), doc_id, source, size, source_size, target (its
    source's) and shards (array<long>, one entry for each time it is taken, at most
    ceil(most) times). The same input and seed give the same plan. Null sources are one
    source, the last. Rows that repeat a doc_id are drawn apart. Documents without words
    are taken as their block is. Texts of any length are counted whole. An empty table gives an empty plan.
    """
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    return _plan(rows, share, most, weights, seed)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _plan(rows: DataFrame, share: float, most: float, weights, seed: int) -> DataFrame:
    """mix_plan of numbered rows (tie, doc_id, source, size)."""
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    total, n_sources = sources.agg(F.sum("source_size"), F.count("*")).first()
    block_words = max(BLOCK_WORDS, (total or 0) // MOST_BLOCKS)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    sources = checkpointed(sources.withColumn("n_blocks", F.greatest(F.col("n_blocks"), F.lit(1))))
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)
    table = hint(sources.withColumnRenamed("source", "s"))
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_blocks")))
    blocks = rows.groupBy("rank", "block", "passes", "rest").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block"), "block")
    upto = F.sum("block_size").over(order)
    blocks = blocks.withColumn("upto", upto).withColumn("place", F.row_number().over(order))
    blocks = blocks.withColumn("whole", (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0))
    before = F.max(F.when(F.col("whole"), F.col("upto"))).over(Window.partitionBy("rank"))
    blocks = checkpointed(blocks.withColumn("left", F.col("rest") - F.coalesce(before, F.lit(0))))
    picks = checkpointed(_picked(rows, blocks, seed))
    edges = rows.join(picks, "tie").select("rank", "block").distinct().withColumn("edge", F.lit(True))
    blocks = blocks.join(edges, ["rank", "block"], "left").withColumn("units", F.col("passes") + (F.col("whole") | F.coalesce("edge", F.lit(False))).cast("int"))
    blocks = checkpointed(blocks.select("rank", "block", "whole", "units"))
    placed = _deal(blocks, seed)
    rows = rows.join(blocks.select("rank", "block", "whole"), ["rank", "block"]).join(placed, ["rank", "block"], "left").join(picks, "tie", "left")
    times = F.col("passes") + (F.col("whole") | F.coalesce(F.col("picked"), F.lit(False))).cast("int")
    taken = F.slice(F.coalesce(F.col("block_shards"), F.array().cast("array<long>")), F.lit(1), times)
    return rows.select("tie", "doc_id", "source", "size", "source_size", "target", taken.alias("shards"))


def _deal(blocks: DataFrame, seed: int) -> DataFrame:
    """The shards of every block (rank, block, block_shards), one for each of its units."""
    strata = blocks.groupBy("rank").agg(F.sum("units").alias("units")).withColumn("stratum", (F.col("rank") % STRATA).cast("int"))
    # at most STRATA rows
    counted = {r["stratum"]: r["units"] for r in strata.groupBy("stratum").agg(F.sum("units").alias("units")).collect()}
    names = sorted(counted)
    counts = np.array([counted[s] for s in names], np.int64)
    leaves = int(min(LEAVES, max(1, -(-int(counts.sum()) // SHARD_BLOCKS))))
    quota = split_quota(counts, leaves, np.random.default_rng([seed, 5])) if names else np.zeros((1, 0), np.int64)
    quotas = {s: quota[:, i] for i, s in enumerate(names)}
    lists = strata.groupBy("stratum").applyInPandas(_stratum_filler(quotas, seed), "rank long, leaves array<int>")
    # a source's blocks, permuted, fill its quotas
    units = blocks.where(F.col("units") > 0).select("rank", "block", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("copy"))
    own = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block", "copy"), "block", "copy")
    dealt = units.withColumn("turn", F.row_number().over(own)).join(lists, "rank").select("rank", "block", "copy", F.element_at("leaves", F.col("turn")).alias("leaf"))
    # and a leaf's blocks, permuted, its output shards
    inside = Window.partitionBy("leaf").orderBy(F.xxhash64(F.lit(seed + 5), "rank", "block", "copy"), "rank", "block", "copy")
    most = int(quota.sum(1).max(initial=0)) // SHARD_BLOCKS + 1
    shard = F.col("leaf").cast("long") * most + F.floor((F.row_number().over(inside) - 1) / SHARD_BLOCKS)
    dealt = dealt.select("rank", "block", F.struct("copy", shard.alias("shard")).alias("unit"))
    return dealt.groupBy("rank", "block").agg(F.transform(F.array_sort(F.collect_list("unit")), lambda u: u["shard"]).alias("block_shards"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 42) -> DataFrame:
    """The mixed corpus: the rows of `docs`, each as often as it is taken, with mix_shard
    and mix_order (random inside a shard) beside their own columns, of which any so named
    are replaced. See mix_plan. Rows are numbered once, in a checkpoint that holds them too."""
    docs = docs.drop("mix_shard", "mix_order")
    number, size, shards, copy = unused(docs.columns, "number", "size", "shards", "copy")
    numbered = checkpointed(docs.withColumn(number, F.monotonically_increasing_id()).withColumn(size, word_count(F.col("text"))))
    rows = numbered.select(F.col(number).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(size).alias("size"))
    plan = checkpointed(_plan(rows, share, most, weights, seed).where(F.size("shards") > 0).select(F.col("tie").alias(number), F.col("shards").alias(shards)))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    drawn = numbered.drop(size).join(plan, number)
    drawn = drawn.select("*", F.posexplode(shards).alias(copy, "mix_shard")).drop(shards)
    drawn = drawn.withColumn("mix_order", F.xxhash64(F.lit(seed + 4), number, copy)).drop(number, copy)
    return drawn.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
