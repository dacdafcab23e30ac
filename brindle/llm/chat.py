"""Chat formatting by quotation linking, in DataFrame functions only.

Lines are parsed into quote levels. Lines of one level in a row are a passage, whatever line
breaks it has; its words in lower case are what is compared. Messages of conversations that hold
quotes are scanned for the hash of each passage's first words, the places found are checked
against the hash and the words of the whole passage, and the latest earlier message that holds it
unquoted is its source. A message answers the message that most of its first-level quoted words
come from, or else the one before it. Conversations are put in reply order, each branch behind the
message that it answers, and texts lose their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_MARKS = r"^((?:\s*>)+)"
#: First words of a passage by which its places are found.
LEAD = 6


def quote_level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"\s", ""))


def quote_body(line: Column) -> Column:
    """The line without its quote marks."""
    return F.regexp_replace(line, _MARKS, "")


def words_of(text: Column) -> Column:
    """Words in lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def passages_of(text: Column) -> Column:
    """The text's lines as passages (level, body): lines of one level in a row; level 0 is not quoted."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.struct(quote_level(line).alias("level"), quote_body(line).alias("body")))
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

    def passage(start, turn):
        end = F.coalesce(F.get(starts, turn + 1), F.size(lines))
        return F.struct(F.get(lines, start)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, start + 1, end - start), lambda x: x["body"]), "\n").alias("body"))

    return F.transform(starts, passage)


def link_quotes(messages: DataFrame) -> DataFrame:
    """Quoted passages and where they come from: row, at (the passage's number in its message), level,
    size (its words), of and of_seq (row and place of the latest earlier message of the conversation that holds
    its words, unquoted and in a row, or null)."""
    quoted = messages.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^\s*>"))
    parts = quoted.select("row", "conv_id", "seq", F.posexplode(passages_of(F.col("text"))).alias("at", "p"))
    parts = parts.select("row", "conv_id", "seq", "at", "p.level", words_of(F.col("p.body")).alias("words")).where((F.col("level") > 0) & (F.size("words") > 0))
    lead = F.least(F.size("words"), F.lit(LEAD))
    parts = parts.withColumn("size", F.size("words")).withColumn("lead", lead).withColumn("first", F.xxhash64(F.slice("words", F.lit(1), lead))).withColumn("hash", F.xxhash64("words"))
    parts = checkpointed(parts)
    sought = parts.select("conv_id", "lead", "first").distinct()
    # own words of the messages that may be a source, and the hash of so many of them from each place
    leads = sought.groupBy("conv_id").agg(F.array_sort(F.collect_set("lead")).alias("leads"))  # LEAD numbers at most
    own = F.filter(passages_of(F.col("text")), lambda p: p["level"] == 0)
    sources = messages.join(leads, "conv_id").select("row", "conv_id", "seq", "leads", words_of(F.array_join(F.transform(own, lambda p: p["body"]), "\n")).alias("own"))
    sources = checkpointed(sources.where(F.size("own") > 0))
    starts = F.flatten(F.transform("leads", lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: i + n <= F.size("own")), lambda i: F.struct(n.alias("lead"), i.alias("start"), F.xxhash64(F.slice("own", i + 1, n)).alias("first")))))
    found = sources.select("row", "conv_id", F.explode(starts).alias("s")).select("row", "conv_id", "s.*").join(sought, ["conv_id", "lead", "first"], "left_semi")
    # each distinct passage once, at each place that begins like it
    distinct = parts.groupBy("conv_id", "lead", "first", "hash", "size").agg(F.first("words").alias("words"))
    places = found.join(sources.select("row", "seq", "own"), "row").join(distinct, ["conv_id", "lead", "first"])
    held = F.slice("own", F.col("start") + 1, F.col("size"))
    originals = places.where((F.xxhash64(held) == F.col("hash")) & (held == F.col("words"))).select("conv_id", "hash", "size", "row", "seq").distinct()
    # one original per message; quotes look back over the originals, before the message's own
    originals = originals.select("*", F.lit(1).alias("mine"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("level"))
    quotes = parts.select("conv_id", "hash", "size", "row", "seq", F.lit(0).alias("mine"), "at", "level")
    order = Window.partitionBy("conv_id", "hash", "size").orderBy("seq", "mine").rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("mine") == 1, F.struct("row", "seq")), ignorenulls=True).over(order)
    return originals.unionByName(quotes).withColumn("source", source).where(F.col("mine") == 0).select("row", "at", "level", "size", F.col("source.row").alias("of"), F.col("source.seq").alias("of_seq"))


def escaped(text: Column) -> Column:
    """Text in which nothing reads as a turn mark: a bar beside an angle bracket gets a backslash between, beside those there are."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def format_chats(messages: DataFrame) -> DataFrame:
    """Messages in reply order and without quotes.

    Takes (conv_id, turn, role, text); returns one row per row: conv_id, turn, role,
    reply_to (turn of the message answered; null for the first), position (from 0, in reply
    order), n_quoted and n_linked (quoted passages, and those whose source was found), text
    (without quoted lines, trimmed) and formatted (role and text between turn marks; see
    escaped).

    Null turns come first and equal turns in order of role and text; null conv_ids are one
    conversation. A null text is empty, texts of any length are read whole, and other columns don't
    matter. Rows that are equal in all four columns stay apart. A conversation's rows are sorted together,
    in one task that spills; nothing of it is collected into a row but the paths of its branches.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first(), "row")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows.withColumn("seq", F.row_number().over(order)))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    keyed = rows.withColumn("conv_id", F.struct(F.col("conv_id").isNull().alias("none"), key.alias("id")))
    links = checkpointed(link_quotes(keyed))
    totals = links.groupBy("row").agg(F.count("*").alias("n_quoted"), F.count("of").alias("n_linked"))
    votes = links.where((F.col("level") == 1) & F.col("of").isNotNull()).groupBy("row", "of_seq").agg(F.sum("size").alias("votes"))
    parent = votes.groupBy("row").agg(F.max_by("of_seq", F.struct("votes", "of_seq")).alias("answers"))
    told = keyed.join(totals, "row", "left").join(parent, "row", "left")
    # a branch begins where the message answered isn't the one before
    told = told.withColumn("answers", F.coalesce("answers", F.col("seq") - 1)).withColumn("branch", F.when(F.col("answers") != F.col("seq") - 1, F.col("seq")))
    so_far = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    told = checkpointed(told.withColumn("branch", F.coalesce(F.last("branch", ignorenulls=True).over(so_far), F.lit(1))))
    # A branch's place: the messages answered from the top down. Branches are few; each round doubles the known part of their paths.
    forks = told.where((F.col("seq") == F.col("branch")) & (F.col("seq") > 1)).select("conv_id", F.col("branch").alias("b"), F.col("answers").alias("anchor"))
    inside = told.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), F.col("branch").alias("up"))
    paths = forks.join(inside, (F.col("conv_id") == F.col("c")) & (F.col("anchor") == F.col("s"))).select("conv_id", "b", F.array(F.struct("anchor", F.col("b").alias("fork"))).alias("path"), F.when(F.col("up") > 1, F.col("up")).alias("up"))
    paths = checkpointed(paths)
    while not paths.where("up is not null").isEmpty():
        above = paths.select(F.col("conv_id").alias("c"), F.col("b").alias("t"), F.col("path").alias("head"), F.col("up").alias("next"))
        joined = paths.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        paths = checkpointed(joined.select("conv_id", "b", F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.col("next").alias("up")))
    placed = told.join(paths.select(F.col("conv_id").alias("c"), "b", "path"), (F.col("conv_id") == F.col("c")) & (F.col("branch") == F.col("b")), "left")
    # in a path a message comes before what answers it; a message itself ends its path
    path = F.concat(F.coalesce("path", F.array().cast("array<struct<anchor:int,fork:int>>")), F.array(F.struct(F.col("seq").alias("anchor"), F.lit(0).alias("fork"))))
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("path", "seq")) - 1
    placed = placed.withColumn("path", path).withColumn("position", position)
    turns = rows.select(F.col("conv_id").alias("c2"), F.col("seq").alias("s2"), F.col("turn").alias("reply_to"))
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: quote_level(line) == 0)
    text = F.trim(F.array_join(kept, "\n"))
    out = placed.select("row", "seq", "answers", "position", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), text.alias("plain"))
    out = rows.select("row", "conv_id", "turn", "role").join(out, "row").join(turns, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("answers") == F.col("s2")), "left")
    formatted = F.concat(F.lit("<|"), escaped(F.coalesce("role", F.lit(""))), F.lit("|>\n"), escaped(F.col("plain")), F.lit("\n<|end|>"))
    return out.select("conv_id", "turn", "role", "reply_to", "position", "n_quoted", "n_linked", F.col("plain").alias("text"), formatted.alias("formatted"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and chat, the formatted messages joined in reply order.

    A conversation is one row, so its size is bounded by what a row holds; format_chats is
    the form for conversations beyond that.
    """
    got = format_chats(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "formatted"))).alias("m"))
    return got.select("conv_id", F.array_join(F.transform("m", lambda m: m["formatted"]), "\n").alias("chat"))
