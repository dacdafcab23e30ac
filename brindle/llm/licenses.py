"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word pair of every text is joined by its hash, and then by its words, to the
places where license templates hold it. A hit votes for the diagonal, the text's place less
the template's. Votes are kept per text, template and diagonal as the set of template places
hit; neighbouring diagonals are one reading of the template with words put in or left out. A
reading is verified by the longest chain of hits that go forward both in the template and in
the text: each place of the template counts once, however often the text repeats its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Phrases that are labelled at every place where their words stand consecutively.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Passages of public licenses that label a text by how much of them it holds.
PASSAGES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A reading holds that share of the template's word pairs, in a span of at most that many times its words.
COVER, LONGER = 0.8, 1.5
#: Words of a template at most: the places hit are the bits of one number.
MOST_WORDS = 64


def words_of(text: Column) -> Column:
    """The text's words, ASCII letters in lower case; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def longest_chain(diagonals: Column, size: Column) -> Column:
    """Of diagonals (diagonal, places hit as bits) the most hits that go forward in text and template."""
    hits = F.flatten(F.transform(diagonals, lambda d: F.transform(F.filter(F.sequence(F.lit(0), size - 2), lambda at: F.getbit(d["places"], at) == 1), lambda at: F.struct((d["diagonal"] + at).alias("pos"), (-at).alias("back")))))
    # best[a]: the longest chain that ends before place a; hits of one text place come last template place first
    start = F.array_repeat(F.lit(0), size)

    def step(best, hit):
        at = -hit["back"]
        now = F.get(best, at) + 1
        return F.transform(best, lambda old, i: F.when((i > at) & (old < now), now).otherwise(old))

    return F.aggregate(F.array_sort(hits), start, step, lambda best: F.get(best, size - 1))


def scan_licenses(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, cover: float = COVER, longer: float = LONGER) -> DataFrame:
    """Label every text with the licenses it names or quotes.

    Returns one row per row of `docs`: doc_id, n_words, n_base (all places of phrases),
    first_word and last_word (smallest and largest start of those, from 0; null without),
    base_labels and labels (distinct, sorted, comma-joined; empty without), score (1 with a
    phrase, else the best share of a passage that a reading holds in order, and 0 without).
    Null and empty texts have no words and no labels. Texts of any length are read whole.
    Rows that repeat a doc_id are scanned apart; other columns of `docs` don't matter.
    Phrases and passages have two to 64 words.
    """
    spark = docs.sparkSession
    pairs = []
    for base, group in ((True, phrases), (False, passages)):
        for n, (label, text) in enumerate(group):
            w = text.split()
            if not 2 <= len(w) <= MOST_WORDS:
                raise ValueError(f"a template has 2 to {MOST_WORDS} words: {text!r}")
            pairs += [(n if base else n + len(phrases), label, base, len(w), i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    drifts = int((longer - 1) * max((p[3] for p in pairs), default=0))
    # as many rows as the templates have words
    places = spark.createDataFrame(pairs, "template int, label string, base boolean, size int, at int, w1 string, w2 string")
    places = F.broadcast(places.withColumn("hash", _pair(F.col("w1"), F.col("w2"))))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rolled = rows.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    follower = F.get("words", F.col("pos") + 1)
    hit = (_pair(F.col("word"), follower) == F.col("hash")) & (F.col("word") == F.col("w1")) & (follower == F.col("w2"))
    votes = rolled.join(places, hit, "left").groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
    # texts without a hit keep one row, of no template
    votes = votes.agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("places"))
    votes = checkpointed(votes.where(F.col("template").isNotNull() | F.col("diagonal").isNull()))

    base = votes.where(F.col("base") & (F.bit_count("places") == F.col("size") - 1)).select("row", "label", F.lit(True).alias("base"), F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    # a reading begins at any diagonal and takes in those behind it, as far as a longer span lets it
    behind = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, drifts)
    near = F.filter(F.collect_list(F.struct("diagonal", "places")).over(behind), lambda d: d["diagonal"] - F.col("diagonal") <= F.floor((longer - 1) * F.col("size")))
    readings = votes.where(~F.col("base")).withColumn("near", near)
    touched = F.bit_count(F.aggregate("near", F.lit(0).cast("long"), lambda s, d: s.bitwiseOR(d["places"])))
    readings = readings.where(touched >= cover * (F.col("size") - 1)).withColumn("share", longest_chain(F.col("near"), F.col("size")) / (F.col("size") - 1)).where(F.col("share") >= cover)
    found = base.unionByName(readings.select("row", "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("start"), "share"))

    found = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    every = votes.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"))
    out = every.join(found, "row", "left")
    zero = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *(F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
