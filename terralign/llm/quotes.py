"""Conversations from quoting messages. DataFrame functions only.

A line's level is the number of its leading quotation marks (`>`, up to three spaces before each). Lines of level 0 are a
message's own; a line that announces a quotation (it ends in a colon and a quoted line follows) is dropped with it. Every
quoted line, and every run of quoted lines of one level taken together, is normalised (case, white space and punctuation
at the ends) and hashed; own lines and runs of own lines are hashed likewise. The first message that says a passage is its
original: within the conversation if it is there and came before, else the first in all conversations if that precedes.
A message replies to the original of most of its quotations at the least level that is linked, the latest on a tie; without
links, to the turn before its own in the conversation. Replies lead to a root, found with the depth by pointer jumping.

Originals are pre-aggregated to one row per passage, so a very common line is one row on that side and its quotations are
split by the join. Null and empty texts are messages without text. Rows equal in conv_id, turn, role and text are one message;
different messages of one turn stay apart, known by `part`, a hash of role and text, and the next turn replies to the one of
least part. Rows without conv_id or turn stand alone as roots, each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# What a quoted line starts with, and what is cut from the ends of a passage.
MARKS = r"^(?: {0,3}>)+"
ENDS = r"^[\s\p{P}]+|[\s\p{P}]+$"


def lines_of(text: Column) -> Column:
    """The lines of a text as (level, content)."""

    def parse(line: Column) -> Column:
        mark = F.regexp_extract(line, f"({MARKS})", 1)
        level = F.length(F.regexp_replace(mark, " ", ""))
        return F.struct(level.cast("int").alias("level"), F.trim(F.regexp_replace(line, MARKS, "")).alias("content"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), parse)


def normal(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), ENDS, "")


def run_starts(lines: Column) -> Column:
    """The places of lines whose level isn't that of the line before."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))


def passages(lines: Column, starts: Column) -> Column:
    """The lines that have content, and the runs of several lines of one level, as "level:hash of the normal form", each once.

    lines and starts (run_starts of them) are columns, not expressions, which would be evaluated for each element.
    """

    def run(start: Column, i: Column) -> Column:
        n = F.coalesce(F.get(starts, i + 1), F.size(lines)) - start
        content = F.array_join(F.transform(F.slice(lines, start + 1, n), lambda x: x["content"]), " ")
        return F.struct(F.get(lines, start)["level"].alias("level"), F.when(n > 1, content).otherwise("").alias("content"))

    every = F.concat(lines, F.transform(starts, run))
    kept = F.filter(F.transform(every, lambda x: F.struct(x["level"].alias("level"), normal(x["content"]).alias("content"))), lambda x: x["content"] != "")
    return F.array_distinct(F.transform(kept, lambda x: F.concat_ws(":", x["level"], F.xxhash64(x["content"]))))


def own_text(lines: Column) -> Column:
    """A message without its quotations and the lines that announce them."""
    marked = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["content"].alias("content"), F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)).alias("next")))
    own = F.filter(marked, lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["content"].endswith(":")))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, part, role, reply_conv, reply_turn, reply_part, root_conv, root_turn, depth, n_quoted, n_linked, text."""
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("part", F.xxhash64("role", "text"))
    lines = cut(rows.select("conv_id", "turn", "part", "role", "copies", lines_of(F.col("text")).alias("lines")).withColumn("starts", run_starts(F.col("lines"))))
    key = ["conv_id", "turn", "part"]
    parsed = lines.filter("conv_id IS NOT NULL AND turn IS NOT NULL")

    said = parsed.select(*key, F.explode(passages(F.col("lines"), F.col("starts"))).alias("s"))
    said = cut(said.select(*key, F.split_part("s", F.lit(":"), F.lit(1)).cast("int").alias("level"), F.split_part("s", F.lit(":"), F.lit(2)).cast("long").alias("h")))
    own = said.filter("level = 0")
    here = own.groupBy("conv_id", "h").agg(F.min(F.struct("turn", "part")).alias("near"))
    first = own.groupBy("h").agg(F.min(F.struct(*key)).alias("first"))
    quoted = said.filter("level > 0").join(here, ["conv_id", "h"], "left").join(first, "h", "left")
    near = F.when(F.col("near.turn") < F.col("turn"), F.struct("conv_id", F.col("near.turn").alias("turn"), F.col("near.part").alias("part")))
    far = F.when(F.struct(F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn")) < F.struct("conv_id", "turn"), F.col("first"))
    votes = quoted.select(*key, "level", F.coalesce(near, far).alias("source"))
    tally = votes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"))
    chosen = votes.filter("source IS NOT NULL").groupBy(*key, "level", "source").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.groupBy(*key).agg(F.max(F.struct(-F.col("level"), "n", "source")).alias("x")).select(*key, F.col("x.source").alias("source"))

    before = parsed.groupBy("conv_id", "turn").agg(F.min("part").alias("part"))
    before = before.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct(*key).alias("before"))
    tied = parsed.select(*key, "role", own_text(F.col("lines")).alias("text")).join(chosen, key, "left").join(before, ["conv_id", "turn"], "left").join(tally, key, "left")
    tied = cut(tied.select(*key, "role", "text", F.coalesce("source", "before").alias("reply"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))

    # Pointers jump until they reach a root; rows that are there already are joined no more.
    up = tied.select(*key, F.coalesce("reply", F.struct(*key)).alias("top"), F.col("reply").isNotNull().cast("long").alias("depth"), F.col("reply").isNotNull().alias("open"))
    while True:
        above = up.select(F.struct(*key).alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"))
        moved = up.filter("open").join(above, "top").select(*key, F.col("higher").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open"))
        up = cut(moved.unionByName(up.filter("NOT open")))
        if up.filter("open").isEmpty():
            break
    out = tied.join(up.drop("open"), key).select(*key, "role", F.col("reply.conv_id").alias("reply_conv"), F.col("reply.turn").alias("reply_turn"), F.col("reply.part").alias("reply_part"), F.col("top.conv_id").alias("root_conv"), F.col("top.turn").alias("root_turn"), "depth", "n_quoted", "n_linked", "text")
    nothing = lambda c: F.lit(None).cast(out.schema[c].dataType).alias(c)
    none = lambda c: F.lit(0).cast("long").alias(c)
    lone = lines.filter("conv_id IS NULL OR turn IS NULL").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    lone = lone.select(*key, "role", *map(nothing, ("reply_conv", "reply_turn", "reply_part")), F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), *map(none, ("depth", "n_quoted", "n_linked")), own_text(F.col("lines")).alias("text"))
    return out.unionByName(lone)
