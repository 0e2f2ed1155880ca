"""Quotation linking for chat formatting, with DataFrame functions only.

A message's lines are parsed into quote levels (the number of leading ``>`` marks, which blanks may part). Lines of
one level in a row form a passage. A quoted passage is normalised (A-Z lower-cased, white space as one blank) and
hashed; so are the originals it may come from: every message's own lines, its paragraphs (lines in a row that are
not blank) and its whole unquoted body. A quoted passage is joined by hash to the earliest original of its own
conversation that comes before the quoting message; a passage that is no whole original is joined line by line. A message
replies to the message most of its first-level quoted lines come from (ties: the latest one). Roots and depths follow
from pointer doubling. Rows come out without quotes, and (conv_id, root_turn, depth, turn) is an order in which
every reply follows its message.

Defined cases: a null text is empty. Messages are told apart by (conv_id, turn, row); a message that quotes nothing or only
unknown passages starts a thread of its own. A null conv_id or turn is kept, links to nothing and is linked to by nothing.
Rows that repeat a turn are linked to as one message. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import fold_column, stored

_BLANKS = "[ \\t\\r\\f\\x0B]+"
_QUOTE = "^[ \\t]*(>[ \\t]*)+"


def quote_level(line) -> F.Column:
    """How many quote marks a line begins with."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def normalised(text) -> F.Column:
    return F.trim(F.regexp_replace(fold_column(text), "\\s+", " "))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """Each message with ``lines``: structs of level, body (marks removed) and the number of its passage.

    The lines of one message are handled in its own row; a message is read as a whole however long it is.
    """
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\\n"), lambda l: F.struct(
        quote_level(l).alias("level"), F.regexp_replace(l, _QUOTE, "").alias("body")))
    return messages.withColumn("lines", lines)


def unquoted(lines) -> F.Column:
    """The text without quoted lines, trimmed."""
    kept = F.transform(F.filter(lines, lambda l: l["level"] == 0), lambda l: l["body"])
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), "\\n{3,}", "\n\n"))


def passages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Quoted passages (runs of lines of one level): keys, passage number, level and text."""
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: (k == 0) | (
        F.get("lines", k)["level"] != F.get("lines", k - 1)["level"]))
    spans = messages.select(*keys, "lines", begins.alias("begins")).select(*keys, "lines", F.transform(
        "begins", lambda b, k: F.struct(b.alias("begin"), (F.coalesce(F.get("begins", k + 1), F.size("lines")) - b)
                                        .alias("length"))).alias("spans"))
    found = spans.select(*keys, F.posexplode(F.transform("spans", lambda s: F.struct(
        F.get("lines", s["begin"])["level"].alias("level"),
        F.array_join(F.transform(F.slice("lines", s["begin"] + 1, s["length"]), lambda l: l["body"]), "\n").alias("text")
    ))).alias("passage", "quote"))
    return found.select(*keys, "passage", "quote.level", "quote.text").where("level > 0")


def link_replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to, root_turn, depth."""
    named = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = stored(parsed_lines(named).select("conv_id", "turn", "role", "lines", unquoted(F.col("lines")).alias("text"))
                   .withColumn("row", F.monotonically_increasing_id()), "messages")
    known = named.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    # Originals: whole bodies, paragraphs and lines, each hash once per conversation at its earliest turn.
    own = F.array_union(F.array(F.col("text")), F.array_union(F.split("text", "\\n\\s*\\n"), F.split("text", "\\n")))
    origin = known.select("conv_id", "turn", F.explode(own).alias("piece")).select(
        "conv_id", "turn", F.md5(normalised(F.col("piece")).cast("binary")).alias("hash"),
        normalised(F.col("piece")).alias("piece")).where("piece <> ''")
    origin = origin.groupBy("conv_id", "hash").agg(F.min("turn").alias("from_turn"))
    quoting = passages(known.where(F.exists("lines", lambda l: l["level"] > 0)), ["conv_id", "turn", "row"])
    quotes = quoting.withColumn("hash", F.md5(normalised(F.col("text")).cast("binary")))
    quotes = stored(quotes.where(normalised(F.col("text")) != ""), "quotes")
    whole = stored(quotes.join(origin, ["conv_id", "hash"]).where("from_turn < turn")
                   .select("conv_id", "turn", "row", "passage", "level", "from_turn",
                           F.size(F.split("text", "\\n")).alias("weight")), "whole")
    rest = quotes.join(whole.select("row", "passage"), ["row", "passage"], "left_anti")
    lines = rest.select("conv_id", "turn", "row", "passage", "level", F.explode(F.split("text", "\\n")).alias("line"))
    lines = lines.where(normalised(F.col("line")) != "").select(
        "conv_id", "turn", "row", "passage", "level", F.md5(normalised(F.col("line")).cast("binary")).alias("hash"))
    by_line = lines.join(origin, ["conv_id", "hash"]).where("from_turn < turn").select(
        "conv_id", "turn", "row", "passage", "level", "from_turn", F.lit(1).alias("weight"))
    links = stored(whole.unionByName(by_line), "links")
    votes = links.where("level = 1").groupBy("row", "from_turn").agg(F.sum("weight").alias("weight"))
    parents = votes.groupBy("row").agg(F.max(F.struct("weight", "from_turn")).getField("from_turn").alias("reply_to"))
    counts = quotes.groupBy("row").agg(F.count("*").alias("n_quotes")).join(
        links.groupBy("row").agg(F.countDistinct("passage").alias("n_linked")), "row", "left").join(parents, "row", "left")
    placed = stored(named.drop("lines").join(counts, "row", "left"), "placed")
    roots = thread_roots(placed)
    return placed.join(roots, ["conv_id", "turn", "reply_to"], "left").select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to",
        F.coalesce("root_turn", F.col("turn")).alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def thread_roots(placed: DataFrame) -> DataFrame:
    """Root and depth of each (conv_id, turn, reply_to) with a reply, by pointer doubling.

    A reply points to an earlier turn, so there are no circles; each round doubles the steps that are known.
    """
    edges = placed.where("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to").distinct()
    # Rows that repeat a turn may reply to different messages; what replies to that turn goes by the earliest of them.
    steps = edges.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("to")).withColumn("depth", F.lit(1).cast("bigint"))
    found = stored(edges.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root_turn"),
                                F.lit(1).cast("bigint").alias("depth")), "roots")
    while True:
        steps = stored(steps, "steps")
        ahead = steps.select("conv_id", F.col("turn").alias("root_turn"), F.col("to").alias("next"),
                             F.col("depth").alias("more"))
        if found.join(ahead, ["conv_id", "root_turn"], "left_semi").isEmpty():
            return found
        found = stored(found.join(ahead, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("next", F.col("root_turn")).alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")
        ahead = ahead.withColumnRenamed("root_turn", "to")
        steps = steps.join(ahead, ["conv_id", "to"], "left").select(
            "conv_id", "turn", F.coalesce("next", F.col("to")).alias("to"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
