"""Repair of the structure of conversations: the cheapest edits that make the turns alternate.

A conversation is right if it is empty, or one optional system turn and then pairs of a user's and an assistant's
turn: the initials of its roles match `(s?(ua)+)?`. Edits of a turn are K(eep) at 0, R(erole to user or assistant)
at 3 and D(elete) at 4, which a blank or duplicate turn needs; I(nsert) of an empty user's or assistant's turn
costs 3, and each truncated turn that stays 3 more. The audit is the edits' initials in order; of several
cheapest ones that least in ASCII order is taken, which settles the roles and texts as well.

The work is a dynamic programme over the retained turns. The best way to retain turn j in a role is the least over
the role retained before it of: the running minimum of that role's ways, each less the prefix sum of deletions at
its own turn; plus the prefix sum before j; plus the inserts that the pair of roles asks for; plus j's own price.
Ties go by audits: all ways at one turn have as many letters of turns and end in one, so none is the beginning
of another, and the order of two longer audits is that of their beginnings, else of what was added. It is enough
to keep the roles' ranks. Deletions come before inserts of the same gap, as D < I.

Turns are dealt by conversation and sorted in each partition; faults that need an order or a lookup are found by
Spark before, spilling to disk. A task then reads one turn after the other: a conversation costs it four bytes a
turn and a running hash of each role's text, whatever its length. Its audit is one value and its hash is made in
order, so one conversation is the work of one task, by what is asked for.

Turns are ordered by turn (null first), then role and text by code points. Null role or text is one space; a role of
no or another initial than s, u, a can't be kept. Repeated rows are duplicates. All rows of a null conversation
id are one conversation. Texts of any length are used whole. An empty table gives none. Other columns, of any names,
are not read. Gaps beyond 2**63 - 1 stay at that number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, WORD_CHAR_RE, exact

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What is retained so far: nothing, or a last turn of this role.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The roles to insert between a retained one (or the start) and the next; a pair that is not here can't be mended.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
AT_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
GOOD_PAIRS = ("su", "ua", "au")
#: A turn's first fault; absent: the row only names its conversation.
NONE, BLANK, DUPLICATE, CUT, ABSENT = range(5)
_LONGEST = 2**63 - 1
_BEFORE = {q: [(p, roles) for (p, to), roles in BETWEEN.items() if to == q] for q in (SYSTEM, USER, ASSISTANT)}


class Repair:
    """One conversation, turn by turn in order."""

    def __init__(self) -> None:
        self.n = 0
        # by last role: cost less the deletions so far, rank of the audit, hash of the text
        self.ways: dict[int, tuple[int, int, object]] = {START: (0, 0, hashlib.sha256())}
        self.back = bytearray()  # by turn and role: the role before, inserts (4), keep (8) or rerole (16); neither: delete

    def add(self, role: str, text: str, fault: int) -> None:
        ways, chosen, codes = self.ways, {}, [0, 1, 2, 3]
        for q, (cost, rank, _) in ways.items():
            chosen[q] = (cost, rank, "D", q, None)
        if fault in (NONE, CUT):
            own = INITIALS.get(role[:1])
            price = (TRUNCATED if fault == CUT else 0) - DELETE
            for q in {own, USER, ASSISTANT} - {None}:
                letter, paid = ("K", price) if q == own else ("R", price + REROLE)
                for p, roles in _BEFORE[q]:
                    if p in ways:
                        way = (ways[p][0] + paid + INSERT * len(roles), ways[p][1], "I" * len(roles) + letter)
                        if q not in chosen or way < chosen[q][:3]:
                            chosen[q] = (*way, p, roles)
        places = {x: i for i, x in enumerate(sorted({w[1:3] for w in chosen.values()}))}
        self.ways = {}
        for q, (cost, rank, suffix, p, roles) in chosen.items():
            text_hash = ways[p][2]
            if roles is not None:
                kept = suffix[-1] == "K"
                turns = [*(f"{ROLES[r]}:" for r in roles), f"{role if kept else ROLES[q]}:{text}"]
                text_hash = text_hash.copy()
                text_hash.update((("\n" if p != START else "") + "\n".join(turns)).encode("utf-8", "surrogatepass"))
                codes[q] = p | 4 * len(roles) | (8 if kept else 16)
            self.ways[q] = (cost, places[rank, suffix], text_hash)
        self.back += bytes(codes)
        self.n += 1

    def end(self) -> tuple[int, int, str]:
        """Cost, the last role retained, hash of the repaired text."""
        cost, _, _, last = min((c + INSERT * len(AT_END[q]), r, "I" * len(AT_END[q]), q) for q, (c, r, _) in self.ways.items())
        text_hash = self.ways[last][2].copy()
        if AT_END[last]:
            text_hash.update(("\n" + "\n".join(f"{ROLES[r]}:" for r in AT_END[last])).encode())
        return cost + DELETE * self.n, last, text_hash.hexdigest()

    def edits_back(self, last: int) -> Iterator[tuple[int | None, str, int]]:
        """The edits from the last to the first: (number of the turn from 0, None for inserts; initial; role retained or inserted, START if deleted)."""
        for r in reversed(AT_END[last]):
            yield None, "I", r
        q = last
        for j in range(self.n - 1, -1, -1):
            code = self.back[4 * j + q]
            if not code & 24:
                yield j, "D", START
                continue
            yield j, "K" if code & 8 else "R", q
            for r in reversed(BETWEEN[code & 3, q]):
                yield None, "I", r
            q = code & 3


def _faults(rows: DataFrame) -> DataFrame:
    """Adds each turn's first fault to (conv, turn, role, text, present); one shuffle by conversation, turns sorted in it."""
    rows = rows.repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy("turn")) > 1
    last = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    fault = (
        F.when(~F.col("present"), ABSENT).when(~F.col("text").rlike(WORD_CHAR_RE), BLANK).when(F.col("again"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    )
    rows = rows.withColumn("again", again)
    # of equal rows of one turn the one that is not again comes first
    rows = rows.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return rows.select("conv", "turn", "role", "text", fault.alias("fault"))


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: str | None) -> DataFrame:
    here = F.lit(True) if present is None else F.coalesce(exact(present), F.lit(False))
    text = lambda c: F.coalesce(exact(c).cast("string"), F.lit(" "))
    return rows.select(exact(conv_col).alias("conv"), exact(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), here.alias("present"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its turns in order) of sorted batches; the turns are read before the next conversation is asked for."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def turns() -> Iterator[tuple]:
            nonlocal row
            while row is not None and (row[0] == conv or (row[0] != row[0] and conv != conv)):  # noqa: B023, the second for NaN
                yield row[1:]
                row = next(rows, None)

        yield conv, turns()


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _summary(turns: Iterator[tuple]) -> tuple[dict, Iterator[tuple[int | None, str, int]]]:
    """The figures of a conversation, and its edits from the last to the first."""
    work, counts = Repair(), [0] * 5
    least = most = before = role_before = None
    distinct = illegal = 0
    for turn, role, text, fault in turns:
        if fault == ABSENT:
            continue
        counts[fault] += 1
        if turn is not None:
            least, most = turn if least is None else least, turn
            distinct += turn != before
            before = turn
        illegal += role_before is not None and role_before + role[:1] not in GOOD_PAIRS
        role_before = role[:1]
        work.add(role, text, fault)
    cost, last, digest = work.end()
    audit = bytearray(ord(e) for _, e, _ in work.edits_back(last))[::-1].decode()
    gaps = 0 if least is None else min(most - least + 1 - distinct, _LONGEST)
    figures = {"gaps": gaps, "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[CUT], "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}
    return figures, work.edits_back(last)


#: Conversations, or edits, of one batch that goes out.
_OUT = 4096


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """One row a conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    illegal: pairs of neighbours whose roles may not follow each other, before the repair. present: a boolean
    column; rows where it is false or null only name their conversation.
    """
    turns = _faults(_turns(rows, conv_col, turn_col, role_col, text_col, present))
    fields = [*(T.StructField(c, T.LongType()) for c in _SUMMARY), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    schema = T.StructType([turns.schema["conv"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        kind = None

        def kinds() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def made() -> pa.RecordBatch:
            columns = [pa.array([c for c, _ in out], kind)]
            columns += [pa.array([r[f.name] for _, r in out], pa.int64() if f.name in _SUMMARY else pa.string()) for f in fields]
            return pa.RecordBatch.from_arrays(columns, names=["conv", *(f.name for f in fields)])

        for conv, its in _conversations(kinds()):
            result, _ = _summary(its)
            out.append((conv, result))
            size += 200 + len(result["audit"])
            if size > 200 * _OUT:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return turns.mapInArrow(run, schema)


def edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """The edits themselves: (conv, place, number, edit, new_role), number counting a conversation's turns from 1 and null for inserts."""
    turns = _faults(_turns(rows, conv_col, turn_col, role_col, text_col, present))
    schema = T.StructType([turns.schema["conv"], T.StructField("place", T.LongType()), T.StructField("number", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for conv, its in _conversations(every()):
            figures, found = _summary(its)
            place = len(figures["audit"])
            while some := list(islice(found, _OUT)):
                columns = [
                    pa.array([conv] * len(some), kind), pa.array(range(place, place - len(some), -1), pa.int64()), pa.array([None if j is None else j + 1 for j, _, _ in some], pa.int64()),
                    pa.array([e for _, e, _ in some]), pa.array([ROLES[r] if e in "RI" else None for _, e, r in some], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["conv", "place", "number", "edit", "new_role"])
                place -= len(some)

    return turns.mapInArrow(run, schema)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """The repaired turns: (conv, place, edit, role, text), in order of place. Turns meet their edits by conversation and number, so a long one is no hot key."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col, present).filter("present")
    number = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    turns = turns.select(F.col("conv").alias("its"), number.alias("k"), "role", "text")
    made = edits(rows, conv_col, turn_col, role_col, text_col, present).filter("edit != 'D'")
    both = made.join(turns, F.col("conv").eqNullSafe(F.col("its")) & (F.col("number") == F.col("k")), "left")
    return both.select("conv", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


#: What becomes of a row whose key falls on these remainders by DAMAGE_OF.
DAMAGE_OF = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, MADE_USER = range(5)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the table with faults, by crc32 of `conv_id:turn`, nulls as one space.

    A dropped row stays as one that is not present, so that its conversation keeps its name.
    """
    shown = lambda c: F.coalesce(exact(c).cast("string"), F.lit(" "))
    rows = rows.select(exact("conv_id"), exact("turn"), shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % DAMAGE_OF).alias("how"))
    how = F.col("how")
    times = F.when(how == REPEATED, F.array(F.lit(True), F.lit(True))).otherwise(F.array(how != DROPPED))
    return rows.select(
        "conv_id", "turn", F.when(how == MADE_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == EMPTIED, "").when(how == UNSTOPPED, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.explode(times).alias("present"),
    )
