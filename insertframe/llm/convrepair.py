"""Repair of conversations by a retained-subsequence DP.

A conversation's turns stand in order of (turn, role, text), null numbers first. A turn's first fault counts:
it is *blank* (no character but white space), a *duplicate* (role and text stood earlier in the
conversation), or *truncated* (its last character but white space ends no sentence). A repaired
conversation is empty, or at most one system turn and then user and assistant in
turn: its roles' initials match ``(s?(ua)+)?``. Edits and their costs:

    K keep 0, R give the role user or assistant 2, D delete 3, I insert an empty user or assistant turn 2

Blank turns and duplicates must go; a truncated turn that stays costs 1 more. The cheapest sequence of
edits is taken, of equals the one whose initials, in order, are least in ASCII.

The DP runs over the turns that are retained, kept or rerolled. What lies between two of them is
priced by prefix sums of deletions, so a state's cheapest end, less the sum so far, is a running
minimum that deletions leave alone; the two roles alone determine how many turns are inserted
between. Deletions come before insertions there, as D is less than I. Ties are broken by audits: the states'
audits are kept as places in their order, which an added suffix refines. That is enough, as an audit's
cost follows from it, so no audit is the beginning of another one of equal cost.

A conversation may hold any share of all rows. Equal turns are one row with a count from the first
aggregation on. Rows are sorted by range, so a long conversation lies in many partitions, and numbered; blocks of
at most ``1 << BLOCK_BITS`` numbers are priced apart, for every state they may be entered in: a
small matrix of (cost, audit), whose product over a conversation's blocks, in order, gives the
result of the whole. Only audits meet per conversation, a letter a turn, as the result asks for them in one row;
texts meet their block's edits block by block.

Null roles and texts are one space, and so is an empty role; a null conversation is one like any other, its own group. Other roles than
system, user and assistant have an initial too, their first character. Numbers of turns may be null, repeat
or have gaps. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, ship

#: Bits of a row's number within its block.
BLOCK_BITS = 12
#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: What a conversation's retained part ends with: nothing, a system, a user or an assistant turn.
STATES = " sua"
#: Turns to insert between a state and the next retained role: their initials. There is no other way on.
BETWEEN = {" s": "", " u": "", " a": "u", "su": "", "sa": "u", "uu": "a", "ua": "", "au": "", "aa": "u"}
#: Turns to insert after the last retained one.
AFTER = {" ": "", "s": "ua", "u": "a", "a": ""}
ROLE = {"u": "user", "a": "assistant"}

SPACES = " \t\n\x0b\f\r"


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (c, turn, role, text, times) of a table with planted faults: by crc32 of
    ``conversation:turn`` modulo 20 a row is dropped (0), its text emptied (1) or rid of its sentence
    ends (2), the row repeated (3) or given to the user (4). Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conversation), F.lit(":"), blank(turn))) % 20
    rows = turns.select(
        F.col(conversation).alias("c"),
        F.col(turn).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(blank(role)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text)).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
        fault.alias("fault"),
    )
    return rows.filter("fault <> 0").drop("fault")


def as_rows(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as rows (c, turn, role, text, times), nothing changed but nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), F.lit(1).alias("times"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (c, at, turn, role, text, times, kind): one for equal turns, ``at`` growing in order.

    ``kind`` is of the row alone: 1 blank, 3 truncated, else 0.
    """
    role = F.when(F.col("role") == "", " ").otherwise(F.col("role")).alias("role")
    rows = rows.select("c", "turn", role, "text", "times").groupBy("c", "turn", "role", "text").agg(F.sum("times").cast("long").alias("times"))
    order = [F.col("c").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    kind = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return ordered.select("c", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "times", kind.alias("kind"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows (c, at, turn, initial, times, kind, again): without texts; ``again`` tells that the
    row itself, not only its repeats, is a duplicate."""
    # the digest stands for role and text; the length keeps their border
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    small = rows.filter("kind <> 1").select("c", "at", same.alias("same"))
    # only what stands twice has to be known
    twice = small.groupBy("c", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = small.join(twice, (small["same"] == twice["same"]) & small["c"].eqNullSafe(twice["c"])).filter("at > first").select("at", F.lit(True).alias("again"))
    own = rows.select("c", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "times", "kind")
    return own.join(later, "at", "left").select("c", "at", "turn", "initial", "times", "kind", F.coalesce("again", F.lit(False)).alias("again"))


def price(turns: list[tuple[str, bool, bool]], entry: str) -> dict[str, tuple[int, str]]:
    """The cheapest edits of turns (initial, must go, is truncated) from state ``entry`` to each
    state: its (cost, audit), without what is inserted after the last turn."""
    gone = 0  # the deletions of all turns so far
    # by state: cost less the deletions so far, the audit's place among the states', the last retained turn
    best: dict[str, tuple[int, int, tuple | None]] = {entry: (0, 0, None)}
    for i, (initial, must_go, cut) in enumerate(turns):
        found = {p: (cost, place, "D", last) for p, (cost, place, last) in best.items()}
        if not must_go:
            for q in "sua":
                if q == "s" != initial:
                    continue
                letter, own = ("K", 0) if q == initial else ("R", REROLE)
                own += CUT * cut - DELETE  # the sum counts this turn among the deleted
                for p, (cost, place, last) in best.items():
                    between = BETWEEN.get(p + q)
                    if between is not None:
                        way = (cost + own + INSERT * len(between), place, "I" * len(between) + letter)
                        if q not in found or way < found[q][:3]:
                            found[q] = (*way, (i, way[2], last))
            order = sorted(found, key=lambda p: found[p][1:3])
            best = {p: (found[p][0], k, found[p][3]) for k, p in enumerate(order)}
        gone += DELETE
    out = {}
    for p, (cost, _, last) in best.items():
        parts, end = [], len(turns)
        while last is not None:
            i, suffix, before = last
            parts += ["D" * (end - i - 1), suffix]
            end, last = i, before
        parts.append("D" * end)
        out[p] = (cost + gone, "".join(reversed(parts)))
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


BLOCK = "c string, block long, first_turn long, last_turn long, n_turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, entry string, leave string, cost long, audit string"
_BLOCK = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in BLOCK.split(", "))])
_LEGAL = {"su", "ua", "au"}


def _faulty(kind: int, again: bool, k: int) -> int:
    """The fault of the k-th of equal turns: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    return 1 if kind == 1 else 2 if again or k else kind


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices each block; rows (c, block, turn, initial, times, kind, again) come block by block in order."""

    def rows() -> Iterator[tuple]:
        for (c, block), own in groupby(_rows_of(batches), lambda r: r[:2]):
            turns, counts, numbers, illegal, before = [], [0] * 4, [], 0, None
            for _, _, turn, initial, times, kind, again in own:
                if turn is not None and (not numbers or numbers[-1] != turn):
                    numbers.append(turn)
                illegal += before is not None and before + initial not in _LEGAL
                illegal += (times - 1) * (initial * 2 not in _LEGAL)
                first, before = (initial if before is None else first), initial
                for k in range(times):
                    fault = _faulty(kind, again, k)
                    counts[fault] += 1
                    turns.append((initial, fault in (1, 2), fault == 3))
            told = (numbers[0] if numbers else None, numbers[-1] if numbers else None, len(numbers), first, before, *counts[1:], illegal)
            for entry in STATES:
                for leave, (cost, audit) in price(turns, entry).items():
                    yield (c, block, *told, entry, leave, cost, audit)

    yield from _emit(rows(), _BLOCK, 256)


WHOLE = "c string, block long, entry string, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_WHOLE = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in WHOLE.split(", "))])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts a conversation's blocks together: a row per block with the state it is entered in and its
    part of the audit; the first one also has what holds for the whole conversation."""

    def rows() -> Iterator[tuple]:
        for c, own in groupby(_rows_of(batches), lambda r: r[0]):
            # a state's way: cost, audit, and the pieces it is made of, as (block, entry, piece, way before)
            ways: dict[str, tuple[int, str, tuple | None]] = {" ": (0, "", None)}
            sums, low, high, distinct, ended = [0] * 4, None, None, 0, None
            for block, parts in groupby(own, lambda r: r[1]):
                found: dict[str, tuple[int, str, tuple | None]] = {}
                told = None
                for row in parts:
                    told, (entry, leave, cost, audit) = row, row[11:]
                    if entry in ways:
                        way = (ways[entry][0] + cost, ways[entry][1] + audit)
                        if leave not in found or way < found[leave][:2]:
                            found[leave] = (*way, (block, entry, audit, ways[entry][2]))
                ways = found
                first, last, n, a, b = told[2:7]
                sums = [x + y for x, y in zip(sums, told[7:11])]
                sums[3] += ended is not None and ended + a not in _LEGAL
                ended = b
                if n:
                    distinct += n - (high == first)  # a number may go on in the next block
                    low, high = first if low is None else low, last
            cost, audit, state = min((w[0] + INSERT * len(AFTER[p]), w[1] + "I" * len(AFTER[p]), p) for p, w in ways.items())
            gaps = 0 if low is None else high - low + 1 - distinct
            pieces, link = [], ways[state][2]
            while link is not None:
                pieces.append(link[:3])
                link = link[3]
            for k, (block, entry, piece) in enumerate(reversed(pieces)):
                tail = "I" * len(AFTER[state]) if k == len(pieces) - 1 else ""
                yield (c, block, entry, piece + tail, *((gaps, *sums, cost, audit) if k == 0 else [None] * 7))

    yield from _emit(rows(), _WHOLE, 64)


TURNS = "c string, at long, part long, role string, text string, edit string"
_TURNS = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in TURNS.split(", "))])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of rows (c, block, at, role, text, times, entry, piece) that come block by block in order."""

    def rows() -> Iterator[tuple]:
        for (c, _), own in groupby(_rows_of(batches), lambda r: r[:2]):
            state, k, at, role = None, 0, 0, ""
            for _, _, at, role, text, times, entry, piece in own:
                if state is None:
                    state = entry
                part = 0
                for _ in range(times):
                    while piece[k] == "I":
                        state = "a" if state == "u" else "u"
                        yield (c, at, part, ROLE[state], "", "I")
                        part, k = part + 1, k + 1
                    if piece[k] == "R":
                        state = "a" if state == "u" else "u"
                        yield (c, at, part, ROLE[state], text, "R")
                    elif piece[k] == "K":
                        state = role[0]
                        yield (c, at, part, role, text, "K")
                    part, k = part + 1, k + 1
            while k < len(piece):
                state = "a" if state == "u" else "u"
                yield (c, at, part, ROLE[state], "", "I")
                part, k = part + 1, k + 1

    yield from _emit(rows(), _TURNS)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's repaired turns (c, role, text), which come in order: nothing is held."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        for c, own in groupby(_rows_of(batches), lambda r: r[0]):
            digest, mark = hashlib.sha256(), ""
            for _, role, text in own:
                digest.update(f"{mark}{role}:{text}".encode())
                mark = "\n"
            yield (c, digest.hexdigest())

    yield from _emit(rows(), schema)


def _by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order; what a task reads of them it reads as a stream."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


class Repair:
    """A table's repair: ``verdicts`` has a row per conversation with turns (c as text, gaps, blank,
    duplicate, truncated, illegal, cost, audit), ``turns`` the repaired turns (c, at, part, role, text,
    edit), in order by (at, part)."""

    def __init__(self, rows: DataFrame, stage: Stage):
        ship(rows.sparkSession)
        rows = stage.put(numbered(rows.withColumn("c", F.col("c").cast("string"))), "rows")
        block = F.shiftright("at", BLOCK_BITS).alias("block")
        priced = _by(faults(rows).select("c", block, "at", "turn", "initial", "times", "kind", "again"), ["c", "block"], ["at"])
        blocks = stage.put(priced.select("c", "block", "turn", "initial", "times", "kind", "again").mapInArrow(_blocks, BLOCK), "blocks")
        wholes = stage.put(_by(blocks, ["c"], ["block"]).mapInArrow(_wholes, WHOLE), "wholes")
        self.verdicts = wholes.filter("cost is not null").select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        # a block's number is its own, but for conversations that share one
        pieces = wholes.select(F.col("c").alias("pc"), F.col("block").alias("pb"), "entry", "piece")
        edits = rows.select("c", block, "at", "role", "text", "times").join(pieces, (F.col("block") == F.col("pb")) & F.col("c").eqNullSafe(F.col("pc")))
        self.turns = _by(edits.select("c", "block", "at", "role", "text", "times", "entry", "piece"), ["c", "block"], ["at"]).mapInArrow(_apply, TURNS)

    def digests(self) -> DataFrame:
        """Rows (c, repaired_sha256) of conversations that keep turns: a fold in order, in constant memory."""
        return _by(self.turns, ["c"], ["at", "part"]).select("c", "role", "text").mapInArrow(_hashes, "c string, repaired_sha256 string")


def report(turns: DataFrame, rows: DataFrame, conversation: str = "conv_id", stage: Stage | None = None) -> DataFrame:
    """A row per conversation of ``turns`` with the verdicts on its ``rows``, which may be none."""
    stage = stage or Stage(turns.sparkSession, "convrepair")
    found = Repair(rows, stage)
    left = lambda own, key: F.coalesce(own, F.lit(key))
    every = turns.select(F.col(conversation).alias("own")).distinct().withColumn("key", F.col("own").cast("string"))
    v, d = found.verdicts, found.digests().withColumnRenamed("c", "dc")
    told = v.join(d, v["c"].eqNullSafe(d["dc"]), "left").drop("dc")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(told, F.col("key").eqNullSafe(F.col("c")), "left").select(
        F.col("own").alias(conversation), *[left(F.col(n), 0).cast("long").alias(n) for n in numbers], left(F.col("audit"), "").alias("audit"), left(F.col("repaired_sha256"), hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")
    )
