"""Conversation structure repair: the cheapest edits that make turns alternate, by A* on the edit lattice.

A conversation's rows, in order, are kept (0), given the role that is wanted (3) or deleted (4); messages without text can be
inserted anywhere (3).  Blank rows and rows whose role and text came before must go; a row that stays though it is cut off
mid-sentence costs 3 more.  What is left must read (s?(ua)+)? by the roles' initials, so a node of the lattice is a number of rows
done and one of four states.  The heuristic is the suffix sum of deletions that must be and of charges of 3 that a cut-off row
can't avoid; it is consistent, so with nodes taken by (cost plus heuristic, audit) the first path to the end is the cheapest and,
among the cheapest, the one with the least audit (two paths of one cost to one node are never a beginning of one another).

Scale: rows are dealt by ranges of (conversation, turn, ...), so a conversation of any size is cut into blocks of `BLOCK` rows of
one letter each.  A conversation in one block is solved at once.  Of a longer one each block is solved by itself from each of the
four states, and a pass over the blocks' 4 x 4 answers joins them; what it holds is the open ends of four audits.  Texts meet by
conversation only for `repaired`: SHA-256 and the order of messages are sequential, so there a conversation is one task's work,
read in sorted batches and never held, after blank and repeated rows have gone by a grouped first.

Rows come in order of turn (nulls first); ties go by role, then the text's first 32 characters, then a hash of role and text, so
equal rows are neighbours.  Null roles and texts are one space, and a row whose role is empty can't be kept as it is; a null conv_id is a conversation; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.stages import cut, small_batches

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS  # rows of a block at most
WORDED, SPOKEN = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# States: nothing yet, after the system's message, after the user's, after the assistant's.
WANTED = "uuau"  # whose message is next
AFTER = (2, 2, 3, 2)
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), some rows dropped, emptied, without stops, repeated or given to the user, as a CRC-32 of
    conv_id:turn has it; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    hit = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.withColumn("_copy", copies).select("conv_id", "turn", "role", "text")


def _plain(rows: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    kept = rows.select("conv_id", "turn", one("role"), one("text"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    return kept.withColumns({"head": F.substring("text", 1, 32), "said": said})


ORDER = ["turn", "role", "head", "said"]


def letter(initial: Column, must: Column, cut_off: Column) -> Column:
    """A row as one letter: whose it is (s, u, a, other), whether it must go, whether it is cut off."""
    whose = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(65 + whose * 4 + must.cast("int") * 2 + cut_off.cast("int"))


def _read(x: str) -> tuple[str, bool, bool]:
    n = ord(x) - 65
    return "sua-"[n >> 2], bool(n & 2), bool(n & 1)


def cheapest(letters: str, start: int, ends: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """A* from `start`: of each state after the last row its (cost, audit), or of the first one in `ends` alone.

    As the heuristic is 0 behind the last row, all states there are reached in order of (cost, audit).
    """
    rows = [_read(x) for x in letters]
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, must, cut_off = rows[i]
        rest[i] = rest[i + 1] + (DELETE if must else CUT_OFF if cut_off else 0)
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        total, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = total - rest[i]
        if i == n:
            found[state] = (cost, audit)
            if ends is not None and state in ends:
                return {state: (cost, audit)}
        steps = [("I", INSERT, i, AFTER[state])]
        if i < n:
            initial, must, cut_off = rows[i]
            steps.append(("D", DELETE, i + 1, state))
            if not must:
                stays = CUT_OFF * cut_off
                if initial == WANTED[state]:
                    steps.append(("K", stays, i + 1, AFTER[state]))
                elif state == 0 and initial == "s":
                    steps.append(("K", stays, i + 1, 1))
                if initial != WANTED[state]:
                    steps.append(("R", REROLE + stays, i + 1, AFTER[state]))
        for edit, price, j, to in steps:
            if (j, to) not in done:
                heapq.heappush(queue, (cost + price + rest[j], audit + edit, j, to))
    return found


def illegal_pairs(letters: str) -> int:
    whose = "".join(_read(x)[0] for x in letters)
    return sum(whose[i : i + 2] not in ("su", "ua", "au") for i in range(len(whose) - 1))


def plan_of(letters: str, audit: str) -> str:
    """The audit without the deletions of rows that had to go: what is done to the rows that are left."""
    out, rows = [], iter(letters)
    for edit in audit:
        if edit == "I" or not _read(next(rows))[1]:
            out.append(edit)
    return "".join(out)


class Joined:
    """A long conversation's blocks joined from left to right: for each state the cheapest way there."""

    def __init__(self):
        self.ways: dict[int, tuple[int, str]] = {0: (0, "")}
        self.common: list[str] = []  # what the audits of all ways begin with
        self.letters: list[str] = []
        self.illegal = 0

    def add(self, letters: str, answers: dict[int, dict[int, tuple[int, str]]]) -> None:
        best: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.ways.items():
            for to, (more, edits) in answers[state].items():
                way = (cost + more, audit + edits)
                if to not in best or way < best[to]:
                    best[to] = way
        shared = os.path.commonprefix([audit for _, audit in best.values()])
        self.common.append(shared)
        self.ways = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in best.items()}
        self.illegal += illegal_pairs((self.letters[-1][-1] if self.letters else "") + letters)
        self.letters.append(letters)

    def result(self) -> tuple[int, str, str, int]:
        cost, tail = min(self.ways[s] for s in ENDS if s in self.ways)
        audit = "".join([*self.common, tail])
        return cost, audit, plan_of("".join(self.letters), audit), self.illegal


SOLVED = "cost long, audit string, plan string, illegal long"
ANSWERS = "array<struct<start:int,stop:int,cost:long,audit:string>>"


def _solve(blocks: DataFrame, kind: str) -> DataFrame:
    """Of each block (conv_id, block, letters, whole): the solution if it is a whole conversation, else its 16 answers."""
    answer = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, parts = [], []
            for letters, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if whole:
                    cost, audit = next(iter(cheapest(letters, 0, ENDS).values()))
                    own.append((cost, audit, plan_of(letters, audit), illegal_pairs(letters)))
                    parts.append([])
                else:
                    own.append((None,) * 4)
                    parts.append([{"start": s, "stop": t, "cost": c, "audit": a} for s in range(4) for t, (c, a) in cheapest(letters, s).items()])
            columns = [pa.array(c, k) for c, k in zip(zip(*own) if own else [[]] * 4, [pa.int64(), pa.string(), pa.string(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns, pa.array(parts, pa.list_(answer))], ["conv_id", "block", "letters", "whole", "cost", "audit", "plan", "illegal", "answers"])

    return blocks.select("conv_id", "block", "letters", "whole").mapInArrow(run, f"conv_id {kind}, block long, letters string, whole boolean, {SOLVED}, answers {ANSWERS}")


def _join_blocks(parts: DataFrame, kind: str) -> DataFrame:
    """(conv_id, cost, audit, plan, illegal) of the conversations with several blocks; one block is held at a time."""
    ordered = parts.select("conv_id", "block", "letters", "answers").repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joined = (), None

        def out() -> pa.RecordBatch:
            values = [*now, *joined.result()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["conv_id", "cost", "audit", "plan", "illegal"])

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64()]
            for conv, letters, answers in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if (conv,) != now:
                    if joined:
                        yield out()
                    now, joined = (conv,), Joined()
                by_start: dict[int, dict[int, tuple[int, str]]] = {}
                for a in answers.as_py():
                    by_start.setdefault(a["start"], {})[a["stop"]] = (a["cost"], a["audit"])
                joined.add(letters, by_start)
        if joined:
            yield out()

    return small_batches(ordered).mapInArrow(run, f"conv_id {kind}, {SOLVED}")


def solve_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, plan) of each conversation of `rows`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    plain = _plain(rows)
    blank = ~F.col("text").rlike(WORDED)
    facts = plain.select("conv_id", "turn", F.substring("role", 1, 32).alias("role"), F.substring("role", 1, 1).alias("initial"), "head", "said", blank.alias("blank"), (~blank & ~F.col("text").rlike(SPOKEN)).alias("cut_off"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1009))  # equal rows may lie in several ranges
    dealt = facts.repartitionByRange("conv_id", *ORDER, salt).sortWithinPartitions("conv_id", *ORDER)
    placed = cut(dealt.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "initial", "said", "blank", "cut_off"))
    first = placed.groupBy("conv_id", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    told = placed.join(first, "pos", "left").withColumn("again", F.col("first").isNull() & ~F.col("blank"))
    must, cut_off = F.col("blank") | F.col("again"), F.col("cut_off") & ~F.col("again")
    told = told.select("conv_id", "pos", "blank", "again", cut_off.alias("cut_off"), letter(F.col("initial"), must, cut_off).alias("letter"))
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    counts = [F.count_if(c).alias(to) for c, to in (("blank", "blank"), ("again", "duplicate"), ("cut_off", "truncated"))]
    blocks = cut(told.groupBy("conv_id", block).agg(letters.alias("letters"), *counts))
    whole = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = placed.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("distinct"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    span = F.coalesce(wide("high") - wide("low") + 1 - F.col("distinct"), F.lit(0))
    gaps = F.least(span, F.lit((1 << 63) - 1)).cast("long").alias("gaps")  # turns may lie further apart than a long counts
    about = turns.select(F.col("conv_id").alias("of"), gaps).join(whole, F.col("of").eqNullSafe(F.col("conv_id"))).drop("of")
    sizes = whole.select(F.col("conv_id").alias("of"), (F.col("n") == 1).alias("whole"))
    solved = cut(_solve(blocks.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))), kind))
    names = ["conv_id", "cost", "audit", "plan", "illegal"]
    answers = solved.where("whole").select(names).unionByName(_join_blocks(solved.where("not whole"), kind))
    return about.withColumnRenamed("conv_id", "of").join(answers, F.col("of").eqNullSafe(F.col("conv_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "plan")


class Repair:
    """The messages of one repaired conversation, one after the other, from its plan and the rows that may stay."""

    def __init__(self, plan: str):
        self.plan, self.at, self.state = plan, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.plan[self.at : self.at + 1] == "I":
            yield ROLE[WANTED[self.state]], ""
            self.at, self.state = self.at + 1, AFTER[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.plan[self.at]
        self.at += 1
        if edit == "D":
            return
        yield (role if edit == "K" else ROLE[WANTED[self.state]]), text
        self.state = 1 if edit == "K" and self.state == 0 and role[:1] == "s" else AFTER[self.state]


def _repaired(rows: DataFrame, plans: DataFrame) -> tuple[DataFrame, str]:
    """Plans, and after each the rows of its conversation that may stay, sorted within the partition of the conversation."""
    kept = _plain(rows).where(F.col("text").rlike(WORDED))
    # the first of equal rows is the one with the least turn
    kept = kept.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("t"), *[F.first(c).alias(c) for c in ("role", "head", "text")])
    kept = kept.select("conv_id", F.lit(1).alias("tag"), F.col("t.turn").alias("turn"), "role", "head", "said", "text")
    turn = kept.schema["turn"].dataType.simpleString()
    head = plans.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"), F.lit(b"").alias("said"), F.col("plan").alias("text"))
    dealt = head.unionByName(kept).repartition("conv_id").sortWithinPartitions("conv_id", "tag", *ORDER)
    return small_batches(dealt.select("conv_id", "tag", "role", "text")), rows.schema["conv_id"].dataType.simpleString()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of repaired messages; (conv_id, None, None) at each conversation's end."""
    now, repair = None, None
    for batch in batches:
        for conv, tag, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if tag == 0:
                if repair:
                    yield from ((now, *m) for m in repair.inserted())
                    yield now, None, None
                now, repair = conv, Repair(text)
            else:
                yield from ((now, *m) for m in repair.row(role, text))
    if repair:
        yield from ((now, *m) for m in repair.inserted())
        yield now, None, None


def repaired_messages(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations as they are after the edits of `solved`."""
    dealt, kind = _repaired(rows, solved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key, out, place, held = first.schema.field(0).type, [], 0, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [key, pa.int64(), pa.string(), pa.string()])], ["conv_id", "place", "role", "text"])
        for conv, role, text in _messages((b for part in ([first], batches) for b in part)):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place, held = place + 1, held + len(text)
            if len(out) == 1000 or held > 1 << 22:
                yield pack()
                out, held = [], 0
        if out:
            yield pack()

    return dealt.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repaired_digest(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 over role:text of the repaired messages, joined by newlines."""
    dealt, kind = _repaired(rows, solved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key, out, sha, some = first.schema.field(0).type, [], hashlib.sha256(), False
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [key, pa.string()])], ["conv_id", "repaired_sha256"])
        for conv, role, text in _messages((b for part in ([first], batches) for b in part)):
            if role is None:
                out.append((conv, sha.hexdigest()))
                sha, some = hashlib.sha256(), False
                if len(out) == 1000:
                    yield pack()
                    out = []
                continue
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            some = True
        if out:
            yield pack()

    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation of `rows`, and of `every` (conv_id) if given: its faults, cost, audit and the hash of its repair.

    A conversation without rows has zeros, no edits and the hash of an empty text.
    """
    solved = cut(solve_conversations(rows))
    told = solved.join(repaired_digest(rows, solved).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    if every is None:
        return told.select("conv_id", *names, "audit", "repaired_sha256")
    wanted = every.select(F.col("conv_id").alias("id")).distinct()
    both = wanted.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
