"""Repair of conversations by error-correcting Earley parsing.

The grammar of roles is weighted: a turn is read as the role that it has (keep), as user or assistant in its place (rerole) or not at all
(delete), and a role can be read without a turn (insert an empty one). Every item of the chart keeps the least cost at which it is reached and,
of equally cheap ways, the one whose edits' initials are least; the item of the complete start symbol at the end of the conversation yields the repair.
The grammar is left-recursive, so all items begin at the first turn, a position has at most one item for each place in a rule, and parsing takes time in proportion to the turns.

No two ways to one item that cost the same are prefixes of each other, as what one has more would be insertions, which cost. So ways are compared by the rank of what
came before and their last step, and a turn takes a few bytes of back pointers. Items also carry the hash of the repaired text so far, so a conversation
streams through its task turn by turn: no text is kept, however long a conversation is. Its hash is sequential by definition, so one task reads it all; duplicates are told beforehand, by windows over
conversation, role and digest of the text.

Defined results: null roles and texts are one space; turns of equal number are ordered by role, then text; null turns come first; rows that
repeat are duplicates; a role without any character has no initial and fits nowhere; a conversation of null id is one of its own; one of which
damage left no row has zeros, an empty audit and the hash of the empty text; an empty table gives an empty result; further columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Left sides and right sides; a symbol without a rule is the initial of a role.
RULES = (
    ("conversation", ()),
    ("conversation", ("exchanges",)),
    ("exchanges", ("asked", "a")),
    ("asked", ("exchanges", "u")),
    ("asked", ("opened", "u")),
    ("asked", ("u",)),
    ("opened", ("s",)),
)
START = "conversation"
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
BLANKS = "\\x20\\x09-\\x0D"
#: Adjacent initials that are no fault.
LEGAL = ("su", "ua", "au")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Item = tuple[int, int]  # a rule and a place in its right side; all items begin at the first turn


def _closure(items: set[Item]) -> set[Item]:
    """With what is predicted before symbols that have rules."""
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        right = RULES[rule][1]
        for k, (left, _) in enumerate(RULES):
            if dot < len(right) and right[dot] == left and (k, 0) not in found:
                found.add((k, 0))
                todo.append((k, 0))
    return found


def _awaited(item: Item) -> str | None:
    right = RULES[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


@cache
def opening() -> tuple[Item, ...]:
    """Items before the first turn that await a role, and the complete empty conversation."""
    every = _closure({(k, 0) for k, (left, _) in enumerate(RULES) if left == START})
    return tuple(sorted(x for x in every if _stays(x)))


def _stays(item: Item) -> bool:
    """Whether an item awaits a role or is complete for the start symbol; the others are completed or predicted away."""
    symbol = _awaited(item)
    return RULES[item[0]][0] == START if symbol is None else all(left != symbol for left, _ in RULES)


@cache
def after(item: Item) -> tuple[Item, ...]:
    """The items that stay once the role that ``item`` awaits is read: the scan, and all completions that follow. Items that complete it began where it did, at the first turn."""
    first = _closure({(k, 0) for k, (left, _) in enumerate(RULES) if left == START})
    found, todo = set(), [(item[0], item[1] + 1)]
    while todo:
        at = todo.pop()
        if at in found:
            continue
        found.add(at)
        if _awaited(at) is None:
            todo += [(rule, dot + 1) for rule, dot in first if _awaited((rule, dot)) == RULES[at[0]][0]]
    return tuple(sorted(x for x in found if _stays(x)))


ITEMS = sorted({*opening(), *(y for x in {(k, d) for k, (_, right) in enumerate(RULES) for d in range(len(right))} if _stays(x) for y in after(x))})
NUMBER = {x: k for k, x in enumerate(ITEMS)}
AWAITED = [_awaited(x) for x in ITEMS]
AFTER = [tuple(NUMBER[y] for y in after(x)) if _awaited(x) else () for x in ITEMS]
OPENING = [NUMBER[x] for x in opening()]
COMPLETE = [NUMBER[x] for x in ITEMS if _awaited(x) is None]
STEPS = [i + op for i in ("", "I", "II", "III") for op in "KRD"]
STEP = {s: k for k, s in enumerate(STEPS)}


class Chart:
    """The items at one place of a conversation and the way back from each."""

    def __init__(self):
        # cost, rank of the way among those here, hash of the repaired text (None while it has no row)
        self.items = {k: (0, 0, None) for k in OPENING}
        self.back = bytearray()

    def inserted(self) -> dict[int, tuple]:
        """Items reached by insertions: cost, (rank, insertions), item that they began from, roles inserted."""
        best = {k: (cost, (rank, ""), k, "") for k, (cost, rank, _) in self.items.items()}
        todo = list(best)
        while todo:
            at = todo.pop()
            cost, (rank, step), origin, roles = best[at]
            if AWAITED[at] in ROLES:
                for to in AFTER[at]:
                    new = (cost + COSTS["I"], (rank, step + "I"), origin, roles + AWAITED[at])
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
                        todo.append(to)
        return best

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """The next turn."""
        new: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, step: str, origin: int, lines: tuple) -> None:
            if to not in new or (cost, (rank, step)) < new[to][:2]:
                new[to] = (cost, (rank, step), origin, lines)

        for at, (cost, (rank, step), origin, roles) in self.inserted().items():
            offer(at, cost + COSTS["D"], rank, step + "D", origin, (roles, None))
            symbol = AWAITED[at]
            if must_go or symbol is None:
                continue
            stays = cost + TRUNCATED * truncated
            for to in AFTER[at]:
                if symbol == role[:1]:
                    offer(to, stays, rank, step + "K", origin, (roles, role))
                if symbol in ROLES:
                    offer(to, stays + COSTS["R"], rank, step + "R", origin, (roles, ROLES[symbol]))
        ranks = {way: n for n, way in enumerate(sorted({x[1] for x in new.values()}))}
        pointers, hashes, items = bytearray(len(ITEMS)), {}, {}
        for to, (cost, way, origin, lines) in new.items():
            if (origin, lines) not in hashes:
                hashes[origin, lines] = _hashed(self.items[origin][2], lines[0], lines[1], text)
            items[to] = (cost, ranks[way], hashes[origin, lines])
            pointers[to] = origin * len(STEPS) + STEP[way[1]]
        self.items = items
        self.back += pointers

    def repair(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest repair."""
        found = self.inserted()
        cost, (_, step), at, roles = min((found[k] for k in COMPLETE if k in found), key=lambda x: x[:2])
        done, audit = _hashed(self.items[at][2], roles, None, ""), [step]
        for k in range(len(self.back) - len(ITEMS), -1, -len(ITEMS)):
            at, s = divmod(self.back[k + at], len(STEPS))
            audit.append(STEPS[s])
        return cost, "".join(reversed(audit)), (done or hashlib.sha256()).hexdigest()


def _hashed(so_far, inserted: str, role: str | None, text: str):
    if not inserted and role is None:
        return so_far
    out = so_far.copy() if so_far else hashlib.sha256()
    lines = "\n".join([f"{ROLES[x]}:" for x in inserted] + ([f"{role}:{text}"] if role is not None else []))
    out.update((("\n" if so_far else "") + lines).encode())
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of conversations (conv_id, turn, role, text) after damage by a checksum of conversation and turn: rows dropped, emptied, cut, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with the first fault of each as ``blank``, ``duplicate`` or ``truncated``."""
    first = Window.partitionBy("conv", "role", F.md5(F.col("text").cast("binary"))).orderBy(F.col("turn").asc_nulls_first())
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    cut = ~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    nth = F.row_number().over(first)
    return rows.withColumn("nth", nth).select("conv", "turn", "role", "text", blank.alias("blank"), (~blank & (F.col("nth") > 1)).alias("duplicate"), (~blank & (F.col("nth") == 1) & cut).alias("truncated"))


def repair_conversations(rows: DataFrame, conv: Column | str = "conv_id", turn: Column | str = "turn", role: Column | str = "role", text: Column | str = "text") -> DataFrame:
    """One row for each conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    space = lambda c: F.coalesce(as_col(c).cast("string"), F.lit(" "))
    own = rows.select(as_col(conv).alias("conv"), as_col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    id_type = own.schema["conv"].dataType.simpleString()
    # equal rows are neighbours, the first of them in front
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "duplicate"]
    told = faults(own).repartition("conv").sortWithinPartitions(*order)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_ = None, None
        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            for n, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "blank", "duplicate", "truncated")), strict=True):
                if open_ is None or n != name:
                    if open_ is not None:
                        out.append((name, *open_.result()))
                    name, open_ = n, _Conversation()
                open_.add(*row)
            if out:
                yield told_of(kind, out)
        if open_ is not None:
            yield told_of(kind, [(name, *open_.result())])

    def told_of(kind: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    columns = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]
    return told.mapInArrow(parse, f"conv_id {id_type}, {RESULT}")


class _Conversation:
    """What is known of a conversation after some of its turns."""

    def __init__(self):
        self.chart, self.faults, self.illegal, self.last = Chart(), np.zeros(3, np.int64), 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.faults += (blank, duplicate, truncated)
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.turn:  # turns ascend
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        self.chart.read(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.tolist(), self.illegal, *self.chart.repair()


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = repair_conversations(damaged(rows), "conv")
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(repaired, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES: dict[str, str] = {}
