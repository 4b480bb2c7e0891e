"""Multi-party chat formatting with perspective rotation, in DataFrame expressions only.

Every participant of a conversation gets the whole dialogue rendered from its own side: its
turns are the assistant's, those of the others are named users', and system turns stay
system turns. The mask of a rendering holds the spans (code points, end exclusive) of the
assistant's contents with their end marks, the text that a model is to learn.

Turns are ordered by (turn, speaker, text), nulls first, repeated rows kept, and numbered in that order
whatever their own numbers are. A rendering is a row per (conversation, participant, part): part k
holds the turns from place ``part_turns * k`` on, ``part_turns`` of them, so dialogues of up to that many turns are
whole, and a row is bounded for longer ones. Each later part begins with the system turns of the parts
before it again (the first ``part_turns`` of the dialogue, should there be more), which ``n_turns``
doesn't count; mask spans are those of the part's rendering. Rows without a conversation are no
conversation's and are left out; a null speaker is a participant named ``unknown``; null
text is empty. A participant without a turn in some part gets that part too, with an empty
mask. Conversations of system turns alone have no participant and so no rendering. An empty
table gives an empty result.

A conversation may hold any share of the rows: equal turns are one row with a count, rows are sorted by
range and numbered by sums over stretches, and what is gathered is a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

#: Marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a part.
PART_TURNS = 4096


def escape(text: Column) -> Column:
    """Keeps texts from forging marks: ``<|`` becomes ``<||``, which ``unescape`` reverses."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def placed(rows: DataFrame, stage: Stage) -> DataFrame:
    """Adds to rows (c, t, times, system) the places of a row's first turn among its conversation's turns and,
    if it is a system turn, among those: ``pos``, ``sys``."""
    order = [F.col("c"), F.col("t.turn").asc_nulls_first(), "t.who", "t.text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, as ids that are given out twice need not be the same
    numbered = stage.put(ordered.select("c", "t", "times", "system", F.monotonically_increasing_id().alias("at")), "turns").withColumn("stretch", F.shiftright("at", 33))
    systems = F.when(F.col("system"), F.col("times")).otherwise(0)
    sums = numbered.groupBy("c", "stretch").agg(F.sum("times").alias("n"), F.sum(systems).alias("s"))
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = Window.partitionBy("c", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = numbered.join(sums, ["c", "stretch"])
    return known.select("c", "t", "times", "system", (F.col("n0") + F.coalesce(F.sum("times").over(own), F.lit(0))).alias("pos"), (F.col("s0") + F.coalesce(F.sum(systems).over(own), F.lit(0))).alias("sys"))


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system_speakers: tuple[str, ...] = ("system",),
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Rows (conversation, participant, part, n_turns, n_own, rendering, mask).

    The dialogue is gathered once per part, and its participants are joined to it, so the
    texts are shuffled once whatever the number of participants.
    """
    t, who = F.col(turn).cast("long"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.filter(F.col(conversation).isNotNull()).select(F.col(conversation).alias("c"), F.struct(t.alias("turn"), who.alias("who"), said.alias("text")).alias("t"))
    rows = rows.groupBy("c", "t").agg(F.count("*").alias("times")).withColumn("system", F.col("t.who").isin(*system_speakers))
    known = placed(rows, Stage(turns.sparkSession, "perspectives"))
    each = known.select("c", "t", "system", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("times") - 1)).alias("pos"), (F.col("sys") - F.col("pos")).alias("shift"))
    each = each.select("c", "t", "system", F.floor(F.col("pos") / part_turns).alias("part"), "pos", (F.col("shift") + F.col("pos")).alias("sys"))
    lists = each.groupBy("c", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("own"))
    said_before = each.filter(F.col("system") & (F.col("sys") < part_turns)).select("c", F.struct("pos", "part", "t").alias("s")).groupBy("c").agg(F.sort_array(F.collect_list("s")).alias("s"))
    people = rows.filter(~F.col("system")).select("c", F.col("t.who").alias("me")).distinct()
    again = F.transform(F.filter(F.coalesce("s", F.array().cast("array<struct<pos:long,part:long,t:struct<turn:long,who:string,text:string>>>")), lambda x: x["part"] < F.col("part")), lambda x: x["t"])
    parts = lists.join(said_before, "c", "left").select("c", "part", F.size("own").alias("n"), F.concat(again, F.transform("own", lambda x: x["t"])).alias("turns"))
    sides = parts.join(people, "c")

    def piece(t: Column) -> Column:
        mine, system = t["who"] == F.col("me"), t["who"].isin(*system_speakers)
        head = F.concat(
            F.lit(OPEN),
            F.when(system, F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), escape(F.replace(t["who"], F.lit("\n"), F.lit(" "))))),
            F.lit("\n"),
        )
        body = F.concat(escape(t["text"]), F.lit(CLOSE))
        return F.struct((mine & ~system).alias("mine"), head.alias("head"), body.alias("body"))

    none = F.lit(None).cast("array<struct<start:long,end:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(none, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["mine"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return sides.select("c", "part", "n", "me", F.transform("turns", piece).alias("p")).select(
        F.col("c").alias(conversation),
        F.col("me").alias("participant"),
        "part",
        F.col("n").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["mine"])).cast("long").alias("n_own"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendering"),
        F.aggregate("p", start, step, lambda a: a["spans"]).alias("mask"),
    )
