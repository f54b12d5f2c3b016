"""Conversations in reply order, from the passages that messages quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.frames import without
from textloom.llm.scratch import Scratch

MARK = r"^(?:[ \t]{0,3}>)+"
ADDED = (
    "own_text", "n_quoted", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn",
    "depth",
)
SPACES = r"[ \t\x0B\f\r]+"


def parsed(text: str) -> Column:
    """The lines of a message as ``level, body, norm``."""
    source = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, MARK, 0)
        level = F.char_length(mark) - F.char_length(F.replace(mark, F.lit(">"), F.lit("")))
        body = F.substr(x, F.char_length(mark) + 1)
        norm = F.lower(F.btrim(F.regexp_replace(body, SPACES, " ")))
        return F.struct(level.alias("level"), body.alias("body"), norm.alias("norm"))

    return F.transform(source, line)


def link_quotes(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    text_col: str = "text",
) -> DataFrame:
    """``messages`` with unquoted text and reply links, sorted in reply order.

    A line that starts with ``>`` marks is quoted, at the level of the number
    of its marks. Its passage is the line without marks, white space folded,
    lower-cased; passages meet by a 128-bit hash. The original is the earliest
    message before this one that holds the passage unquoted: in the same
    conversation, else in one with a smaller id. The parent is the original of
    the lowest quote level, then of the most lines, then the latest.

    Added: ``own_text`` (level 0 only), ``n_quoted`` and ``n_linked`` lines,
    ``parent_conv, parent_turn``, ``thread_conv, thread_turn`` (the message at
    which the chain of parents ends, itself without a parent) and ``depth``.
    Rows come out sorted by thread, depth and turn: each conversation together,
    and every reply after what it answers.

    Originals are aggregated to one row per passage before they are joined, so
    a line that stands in a third of all messages makes no pairs. Null or empty
    texts have one empty line; blank passages link nothing. Rows with equal
    conversation and turn are one message; rows without either take no part and
    are threads of their own. Columns with the names of added ones are replaced.
    """
    spark = messages.sparkSession
    messages = without(messages, ADDED)
    scratch = Scratch(spark, "quotes")
    read = messages.withColumn("__lines", parsed(text_col))
    flat = read.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.explode("__lines").alias("l")
    )
    flat = flat.filter("c is not null and t is not null and l.norm <> ''").select(
        "c", "t", F.col("l.level").alias("level"),
        F.xxhash64("l.norm").alias("h1"), F.xxhash64(F.lit(1), "l.norm").alias("h2"),
    )
    quoted = scratch.table(flat.filter("level > 0"), "quoted")
    links = None
    if not quoted.isEmpty():
        wanted = quoted.select("h1", "h2").distinct()
        plain = flat.filter("level = 0").join(wanted, ["h1", "h2"], "left_semi")
        plain = scratch.table(plain.select("c", "t", "h1", "h2"), "originals")
        near = plain.groupBy("c", "h1", "h2").agg(F.min("t").alias("near"))
        far = plain.groupBy("h1", "h2").agg(F.min(F.struct("c", "t")).alias("far"))
        near, far = scratch.table(near, "near"), scratch.table(far, "far")
        found = quoted.join(near, ["c", "h1", "h2"], "left").join(far, ["h1", "h2"], "left")
        here = F.when(F.col("near") < F.col("t"), F.struct("c", F.col("near").alias("t")))
        there = F.when(F.col("far.c") < F.col("c"), F.col("far"))
        found = found.select("c", "t", "level", F.coalesce(here, there).alias("o"))
        votes = found.groupBy("c", "t", "level", "o").agg(F.count(F.lit(1)).alias("n"))
        rank = F.struct(-F.col("level"), F.col("n"), F.col("o.c"), F.col("o.t"))
        best = votes.groupBy("c", "t").agg(
            F.sum("n").alias("n_quoted"),
            F.sum(F.when(F.col("o").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
            F.max_by("o", F.when(F.col("o").isNotNull(), rank)).alias("parent"),
        )
        links = scratch.table(best, "links")
        chains = _chains(scratch, links.filter("parent is not null"))
        links = scratch.table(links.join(chains, ["c", "t"], "left"), "threads")
    own = F.filter("__lines", lambda x: x["level"] == 0)
    clean = read.withColumn("own_text", F.array_join(F.transform(own, lambda x: x["body"]), "\n"))
    if links is None:
        none = F.lit(None)
        joined = clean.withColumns(
            {"n_quoted": F.lit(0), "n_linked": F.lit(0), "__pc": none, "__pt": none,
             "__rc": none, "__rt": none, "depth": F.lit(0)}
        )
    else:
        side = links.select(
            F.col("c").alias("__c"), F.col("t").alias("__t"), "n_quoted", "n_linked",
            F.col("parent.c").alias("__pc"), F.col("parent.t").alias("__pt"),
            F.col("root.c").alias("__rc"), F.col("root.t").alias("__rt"), "depth",
        )
        joined = clean.join(
            side, (F.col(conv_col) == F.col("__c")) & (F.col(turn_col) == F.col("__t")), "left"
        )
    kinds = {f.name: f.dataType for f in messages.schema.fields}
    out = joined.select(
        *messages.columns,
        "own_text",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("__pc").cast(kinds[conv_col]).alias("parent_conv"),
        F.col("__pt").cast(kinds[turn_col]).alias("parent_turn"),
        F.coalesce(F.col("__rc").cast(kinds[conv_col]), F.col(conv_col)).alias("thread_conv"),
        F.coalesce(F.col("__rt").cast(kinds[turn_col]), F.col(turn_col)).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    keys = ("thread_conv", "thread_turn", "depth", conv_col, turn_col)
    return scratch.finish(out.orderBy(*keys))


def _chains(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``c, t, root, depth`` by following parents, twice as far each round.

    A parent always comes before its child, so chains end.
    """
    state = scratch.table(
        links.select("c", "t", F.col("parent").alias("root"), F.lit(1).alias("depth")), "chains"
    )
    while True:
        ahead = state.select(
            F.col("c").alias("rc"), F.col("t").alias("rt"),
            F.col("root").alias("next"), F.col("depth").alias("more"),
        )
        on = (F.col("root.c") == F.col("rc")) & (F.col("root.t") == F.col("rt"))
        further = scratch.table(
            state.join(ahead, on, "left").select(
                "c", "t", F.coalesce("next", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "chains",
        )
        state = further.drop("moved")
        if further.filter("moved").isEmpty():
            return state
