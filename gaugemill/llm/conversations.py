"""Repair of broken conversations: the cheapest edits that give an optional system turn and then user and assistant in turn.

Rows of a conversation are ordered by turn (nulls first). Edits are Delete, Insert (an empty text), Keep and Rerole; the search is
iterative-deepening A*: depth first in the ASCII order of the edits' letters, under a bound on the cost so far plus the
heuristic, which is what the rows ahead cost at least; the next bound is the least sum beyond this one. A table of failed states
(row, roles so far) keeps the least that may be enough from there, so a state is searched again only with more to spend than it failed
with. So the first path that is accepted is the cheapest, and the least of the cheapest.

A conversation is searched in blocks of ``BLOCK`` rows: from each state of the roles before a block to each state after it. Of
paths to the same state only the cheapest, and least, can go on, so at most four are held between blocks: their cost,
letters and the digest so far. The digest of a repaired conversation is a chain over its text, so its rows pass one task in order; they are streamed, a block
at a time, after one shuffle by conversation, and never gathered.

Results: a null role or text is one space; a null conversation is one of its own, written as one space where rows are chosen; a null turn comes
first and counts for no gap. Rows of the same turn follow role, then text. A repeated row is a duplicate. An empty role adds nothing to the
roles. A very long text passes by itself. An empty table gives no rows, a conversation that has lost all rows gives zeros. Extra columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The costs of edits, what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLOCK = 6
#: States of the roles so far: none, after system, after user, after assistant; what may follow, and the role that an edit gives.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = (USER, USER, ASSISTANT, USER)
#: What inserted turns cost from a state to another.
_NEVER = 1 << 40
AWAY = ((0, _NEVER, INSERT, 2 * INSERT), (_NEVER, 0, INSERT, 2 * INSERT), (_NEVER, _NEVER, 0, INSERT), (_NEVER, _NEVER, INSERT, 0))
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
WHITE = " \t\n\x0b\x0c\r"
MARKS = (".", "!", "?")


def at_least(rows: tuple[tuple[str, bool, bool], ...], ends: tuple[int, ...]) -> list[list[int]]:
    """What the rows from each one on cost at least, by the state before them: deletions that must be, marks of truncated rows, a rerole for each
    foreign role, and one edit for each of the most pairs of neighbours, none in two pairs, whose roles can't follow each other."""
    n = len(rows)
    fixed, pairs, first = 0, 0, "end"  # of the rows from i on; the first one that may stay: its role, "end", or none that a pair could have
    behind = 0  # pairs beyond that first row
    table = [[0] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        if i < n:
            initial, gone, cut = rows[i]
            if gone:
                fixed += DELETE
            else:
                fixed += TRUNCATED * cut
                if initial not in ("s", "u", "a"):
                    fixed += REROLE * (initial != "")
                    first, behind = "", pairs
                else:
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
                    bad = state not in ends if first == "end" else first != "" and first not in NEXT[state]
                    first, behind, pairs = initial, pairs, max(pairs, behind + 1) if bad else pairs
        for state in range(4):
            bad = state not in ends if first == "end" else first != "" and first not in NEXT[state]
            table[i][state] = fixed + INSERT * (max(pairs, behind + 1) if bad else pairs)
    return table


def search(rows: tuple[tuple[str, bool, bool], ...], begin: int, ends: tuple[int, ...], last: bool) -> tuple[int, str, int] | None:
    """The cheapest edits, the least among equals, from state ``begin`` through ``rows`` (initial, must go, truncated) to one of ``ends``: cost, letters, end.

    ``last``: turns may be inserted after the last row."""
    n, ahead = len(rows), at_least(rows, ends)  # a state that fails raises its entry to the least that may be enough
    if n == 0 and begin in ends:
        return 0, "", begin
    limit = n * DELETE + 4 * INSERT  # deleting everything and inserting what the end needs is never dearer
    while (bound := ahead[0][begin]) <= limit:
        path: list[str] = []
        stack = [(0, begin, bound, iter(_edits(rows, 0, begin, last)))]
        while stack:
            i, state, left, edits = stack[-1]
            for letter, cost, to_i, to_state in edits:
                if left - cost < ahead[to_i][to_state]:
                    continue
                path.append(letter)
                if to_i == n and to_state in ends:
                    return bound - left + cost, "".join(path), to_state
                stack.append((to_i, to_state, left - cost, iter(_edits(rows, to_i, to_state, last))))
                break
            else:
                stack.pop()
                ahead[i][state] = max(ahead[i][state], min((cost + ahead[to_i][to_state] for _, cost, to_i, to_state in _edits(rows, i, state, last)), default=limit + 1))
                if path:
                    path.pop()
    return None


def _edits(rows, i: int, state: int, last: bool) -> list[tuple[str, int, int, int]]:
    """(letter, cost, next row, next state) in ASCII order."""
    if i == len(rows):
        return [("I", INSERT, i, GIVEN[state])] if last else []
    initial, gone, cut = rows[i]
    found = [("D", DELETE, i + 1, state), ("I", INSERT, i, GIVEN[state])]
    if not gone:
        kept = state if initial == "" else NEXT[state].get(initial)
        if kept is not None:
            found.append(("K", cut * TRUNCATED, i + 1, kept))
        found.append(("R", REROLE + cut * TRUNCATED, i + 1, GIVEN[state]))
    return found


@lru_cache(1 << 16)
def found(rows: tuple[tuple[str, bool, bool], ...], begin: int, end: int | None) -> tuple[int, str, int] | None:
    """``search`` for the last block (``end`` None) or to one state, kept for blocks that come again."""
    return search(rows, begin, ACCEPTED if end is None else (end,), end is None)


class Repair:
    """A conversation as its rows come in."""

    def __init__(self):
        #: state -> (cost, rank among the letters so far, chain of letters, digest, whether anything is written)
        self.best = {START: (0, 0, None, hashlib.sha256(), False)}
        self.rows: list[tuple[str, str, bool, bool]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns: tuple[int | None, int | None, int] = (None, None, 0)
        self.before: str | None = None
        self.place = -1

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        if turn is not None:
            least, most, distinct = self.turns
            self.turns = (turn if least is None else least, turn, distinct + (turn != most))
        if len(self.rows) == BLOCK:
            self.step(last=False)
        self.rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))

    def step(self, last: bool) -> None:
        block = tuple((role[:1], gone, cut) for role, _, gone, cut in self.rows)
        reached: dict[int, tuple] = {}
        # a state that another one with inserted turns reaches for less is on no cheapest path
        live = {q: b for q, b in self.best.items() if not any(p != q and other[0] + AWAY[p][q] < b[0] for p, other in self.best.items())}
        for begin, (cost, rank, *_) in live.items():
            for end in (None,) if last else [q for q in range(4) if q >= begin or q == USER]:
                if way := found(block, begin, end):
                    key = (cost + way[0], rank, way[1])
                    place = -1 if last else end
                    if place not in reached or key < reached[place][0]:
                        reached[place] = (key, begin, way[2])
        # letters: first by what the block began with, then within the block
        ranks = {x: i for i, x in enumerate(sorted({(key[1], key[2]) for key, _, _ in reached.values()}))}
        new = {}
        for key, begin, end in reached.values():
            _, _, chain, digest, written = self.best[begin]
            new[end] = (key[0], ranks[key[1], key[2]], (chain, key[2]), *self.written(begin, key[2], digest.copy(), written))
        self.best, self.rows = new, []

    def written(self, state: int, letters: str, digest, any_yet: bool):
        i = 0
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                role, text, i = self.rows[i][0], self.rows[i][1], i + 1
            if letter == "D":
                continue
            if letter == "K":
                state = state if role == "" else NEXT[state][role[:1]]
            else:
                state = GIVEN[state]
                role = ROLES[state]
            digest.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            any_yet = True
        return digest, any_yet

    def result(self) -> tuple:
        self.step(last=True)
        ((cost, _, chain, digest, _),) = self.best.values()
        parts = []
        while chain:
            chain, letters = chain
            parts.append(letters)
        least, most, distinct = self.turns
        gaps = 0 if least is None else most - least + 1 - distinct
        return gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.counts["illegal"], cost, "".join(reversed(parts)), digest.hexdigest()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with planted faults by crc32 of ``conv_id:turn``, modulo 20: 0 drops a row (``there`` is false), 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    fault = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"), fault.alias("fault"))
    return own.select("conv_id", "turn", "role", "text", (F.col("fault") != 0).alias("there"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def sound(rows: DataFrame) -> DataFrame:
    """The rows as they are, none of them dropped: conv_id, turn, role, text, there."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.lit(True).alias("there"))


def repair(rows: DataFrame) -> DataFrame:
    """A row a conversation of ``rows`` (conv_id, turn, role, text, there): conv_id and ``REPORT``. Rows that aren't there only name their conversation."""
    bare = F.rtrim("text", F.lit(WHITE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(bare == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(*MARKS), "truncated")
    # one shuffle: the window's partitions are within those of the conversation
    judged = rows.repartition("conv_id").withColumn("seen", seen).withColumn("fault", F.when(F.col("there"), fault))
    ordered = judged.select("conv_id", "turn", "role", "text", "there", "fault", "seen").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "seen")

    def conversations(frames):
        now, open_one, out = None, None, []

        def batch():
            columns = list(zip(*out, strict=True)) or [()] * (1 + len(REPORT))
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *REPORT])

        kind = pa.int64()
        for frame in frames:
            kind = frame.schema.field(0).type
            for conv, turn, role, text, there, fault in zip(*(frame.column(i).to_pylist() for i in range(6)), strict=True):
                if open_one is None or conv != now:
                    if open_one is not None:
                        out.append((now, *open_one.result()))
                    now, open_one = conv, Repair()
                if there:
                    open_one.add(turn, role, text, fault)
            if len(out) > 1000:
                yield batch()
        if open_one is not None:
            out.append((now, *open_one.result()))
        yield batch()

    types = {name: "long" for name in REPORT} | {"audit": "string", "repaired_sha256": "string"}
    return ordered.mapInArrow(conversations, f"conv_id {dict(rows.dtypes)['conv_id']}, " + ", ".join(f"{n} {t}" for n, t in types.items()))
