"""Conversations from quotations.

A message quotes others in lines marked by one or more ``>``. Quoted and own
lines are normalised and hashed; a quoted passage is linked to the message that
wrote it first, a message replies to the one that it quotes most at the outermost
level. Threads follow from the links, and messages are ordered by thread and turn
without their quoted lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_positions
from ..workspace import Workspace

# A quotation mark of the next level: ``>``, or a name of up to 8 letters, ``>`` and a space or a further mark.
MARKS = r"^(?:[ \t]*+(?:>|[A-Za-z]{1,8}+>(?=[ \t>]|$)))++"
SHINGLE = 5  # words of a passage that are linked together, however its lines are wrapped
# A line that only introduces a quotation.
INTRODUCTION = r"(?i)^[ \t]*(?:on\b.{1,200}\b(?:wrote|writes)|.{1,200}\b(?:wrote|writes|schrieb|a écrit|escribió))[ \t]*:[ \t]*$"
END = "\n<|end|>\n"


def _lines(text: Column) -> Column:
    """Lines with their level: struct(level, content), the content without marks and outer white space."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        F.regexp_replace(F.substring(line, F.length(marks) + 1, F.length(line)), r"^[ \t]|[ \t]+$", "").alias("content"))

    return F.transform(lines, one)


def normalised(content: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, n) of lines, passages and their word shingles; n counts repetitions in the message.

    A passage is a run of lines of one level without an empty line, so what a mail
    client has wrapped anew keeps its shingles.
    """
    plain = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), normalised(x["content"]).alias("plain")))
    rows = messages.select("conv", "turn", F.transform(F.array(plain), lambda p: F.struct(p.alias("lines"), F.array_join(F.transform(
        p, lambda x, i: F.concat(F.when((i == 0) | (x["plain"] == "") | (F.get(p, i - 1)["plain"] == "") | (F.get(p, i - 1)["level"] != x["level"]),
                                        F.concat(F.lit("\n"), x["level"].cast("string"), F.lit(" "))).otherwise(F.lit(" ")), x["plain"])), "").alias("joined")))[0].alias("m"))
    line = rows.select("conv", "turn", F.explode("m.lines").alias("line")).select("conv", "turn", "line.level", "line.plain")
    joined = rows.select("conv", "turn", F.explode(F.split("m.joined", "\n")).alias("p")).where(F.instr("p", " ") > 0)
    words = F.split(F.regexp_replace("p", "^[0-9]+ ", ""), " ")
    pieces = F.flatten(F.transform(F.array(words), lambda w: F.concat(F.array(F.array_join(w, " ")), F.when(
        F.size(w) > SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(
        F.array().cast("array<string>")))))
    more = joined.select("conv", "turn", F.split("p", " ")[0].cast("int").alias("level"), F.explode(pieces).alias("plain"))
    return (line.unionByName(more).where("plain <> ''").groupBy("conv", "turn", "level", F.xxhash64("plain", F.length("plain")).alias("hash"))
            .agg(F.count(F.lit(1)).alias("n")))


def reply_links(lines: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, quoted): the earlier message that a message quotes most.

    A passage belongs to the message of the conversation that wrote it first as
    its own text; quoting oneself or later messages is no link. The outermost
    level with a link decides, then the number of passages, then the later
    message. One row per passage and conversation is joined, so frequent passages
    make no pairs of messages.
    """
    wrote = lines.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quotes = lines.where("level > 0")
    same = quotes["conv"].eqNullSafe(wrote["conv"]) & (quotes["hash"] == wrote["hash"])
    hits = quotes.join(wrote, same).where("origin < turn").select(quotes["conv"], "turn", "level", "origin", "n")
    counted = hits.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("quoted"))
    best = F.max(F.struct((-F.col("level")).alias("level"), F.col("quoted"), F.col("origin")))
    return counted.groupBy("conv", "turn").agg(best.alias("best")).select("conv", "turn", F.col("best.origin").alias("reply_to"), F.col("best.quoted").alias("quoted"))


def thread_roots(ws: Workspace, links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of messages with a reply link, by doubling the distance looked back per round."""
    state = ws.cut(links.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("bigint").alias("depth")), "threads")
    while True:
        up = state.select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        joined = state.join(up, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("root") == F.col("__turn")), "left")
        state = ws.cut(joined.select("conv", "turn", F.coalesce("__root", "root").alias("root"),
                                     (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.col("__root").isNotNull().alias("moved")), "threads")
        moved = not state.where("moved").isEmpty()
        state = state.select("conv", "turn", "root", "depth")
        if not moved:
            return state


def conversations(ws: Workspace, messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, depth, position, text, formatted.

    ``thread`` is the turn of the first message of its thread, ``position`` the
    0-based place in the conversation ordered by thread, turn, role and text, so a
    reply follows what it answers. ``text`` has lost quoted lines and the lines
    that introduce them, ``formatted`` wraps it for training; the rows of a
    conversation in order are its transcript. Null texts are empty, null turns
    come first and have no links, null roles read "user"; messages that share
    conversation and turn count as one when linked. Null conversation ids form
    one conversation.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), _lines(F.col(text)).alias("lines"))
    links = ws.cut(reply_links(passages(rows.where("turn is not null"))), "links")
    roots = thread_roots(ws, links).join(links.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "reply_to"),
                                         F.col("conv").eqNullSafe(F.col("__c")) & (F.col("turn") == F.col("__t"))).drop("__c", "__t")
    roots = roots.select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), "reply_to", "root", "depth")
    # An introduction goes if the next line is quoted.
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(INTRODUCTION) & (
        F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)))
    own = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"\n{3,}", "\n\n")
    own = F.regexp_replace(own, r"^\s+|\s+$", "")
    said = F.coalesce("role", F.lit("user"))
    joined = rows.join(roots, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left").select(
        "conv", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), own.alias("own"))
    joined = joined.withColumn("formatted", F.concat(F.lit("<|"), said, F.lit("|>\n"), "own", F.lit(END)))
    joined = joined.withColumn("__empty", F.col("conv").isNull()).withColumn("__tie", F.xxhash64("own"))
    placed = ws.cut(global_positions(ws, joined, ["__empty", "conv", "thread", "turn", "role", "__tie"], "__place"), "placed")
    first = placed.groupBy(F.col("conv").alias("__conv")).agg(F.min("__place").alias("__first"))
    return (placed.join(first, F.col("conv").eqNullSafe(F.col("__conv")))
            .select(F.col("conv").alias("conv_id"), "turn", "role", "reply_to", "thread", "depth",
                    (F.col("__place") - F.col("__first")).alias("position"), F.col("own").alias("text"), "formatted"))


def op9_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(Workspace(spark), spark.read.parquet(f"{folder}/conversations.parquet"))
