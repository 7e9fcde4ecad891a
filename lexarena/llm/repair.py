"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

The roles allowed are an automaton of four states. The costs from each state to the end of a conversation, less
their least, are a vector; edits and insertions change it by bounded amounts, so only a few vectors exist. Each
is one state of a deterministic automaton, built as it is met: a transition table maps (vector, symbol) to the
vector before it and what the least has grown by. A conversation is scanned over that table from its last turn
to its first, one lookup a turn. The trace then goes the other way, turn by turn, along tight arcs; as it starts
at the first turn, the least letter of the tight arcs gives the least audit.

Each conversation passes a task twice, in one sorted stream: first its symbols, of which one byte a turn is
kept, then its texts, which the trace takes one by one. Texts are shuffled once and never gathered.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarena.llm.trie import _streamed, turn_hash

#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Where each initial leads, and the state that an insertion or a new role leads to.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = {2: "user", 3: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
END = (0, 2 * INSERT, INSERT, 0)
ROLES = "sua"
OK, BLANK, CUT, DUPLICATE = range(4)  # of equal rows, the one that isn't a duplicate comes first


def _next(state: int) -> int:
    """The state after the one user or assistant turn that may come next."""
    return 3 if state == 2 else 2


class Repairs:
    """The determinised automaton; a symbol is 4 * (index of the initial, 3 for any other) + fault."""

    def __init__(self):
        self.vectors, self.number = [END], {END: 0}
        self.table: dict[int, tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[tuple[str, ...], str, str | None, int]] = {}

    def options(self, after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, str | None, int]]:
        """(letter, cost to the end, new role, next state) of the edits of one turn, in the order of their letters."""
        role, fault = divmod(symbol, 4)
        out = [("D", DELETE + after[state], None, state)]
        if fault in (OK, CUT):
            extra = TRUNCATED if fault == CUT else 0
            kept = STEP[state].get(ROLES[role]) if role < 3 else None
            if kept is not None:
                out.append(("K", extra + after[kept], None, kept))
            to = _next(state)
            out.append(("R", extra + REROLE + after[to], TURN[to], to))
        return out

    def before(self, after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        """Costs to the end before a turn, insertions in front of it included."""
        cost = [min(o[1] for o in self.options(after, symbol, q)) for q in range(4)]
        for _ in range(2):
            cost = [min(cost[q], INSERT + cost[_next(q)]) for q in range(4)]
        return tuple(cost)

    def step(self, vector: int, symbol: int) -> tuple[int, int]:
        """(vector before the turn, growth of the least), from the table or else computed and kept there."""
        key = 16 * vector + symbol
        found = self.table.get(key)
        if found is None:
            cost = self.before(self.vectors[vector], symbol)
            least = min(cost)
            norm = tuple(c - least for c in cost)
            if norm not in self.number:
                self.number[norm] = len(self.vectors)
                self.vectors.append(norm)
            found = self.table[key] = self.number[norm], least
        return found

    def scan(self, symbols: bytearray) -> tuple[int, array]:
        """The cost of a conversation, and the vector after each of its turns."""
        vector, total, after = 0, 0, array("H", bytes(2 * len(symbols)))
        for i in range(len(symbols) - 1, -1, -1):
            after[i] = vector
            vector, grown = self.step(vector, symbols[i])
            total += grown
        return total + self.vectors[vector][0], after

    def arc(self, vector: int, symbol: int, state: int) -> tuple[tuple[str, ...], str, str | None, int]:
        """(roles inserted before a turn, its edit, new role, next state): the least letters along tight arcs."""
        key = vector, symbol, state
        found = self.arcs.get(key)
        if found is None:
            after = self.vectors[vector]
            cost, roles = self.before(after, symbol), []
            while True:
                letter, _, role, to = next((o for o in self.options(after, symbol, state) if o[1] == cost[state]), ("Z", 0, None, 0))
                if letter == "D" or cost[state] != INSERT + cost[_next(state)]:  # D < I < K < R
                    break
                state = _next(state)
                roles.append(TURN[state])
            found = self.arcs[key] = tuple(roles), letter, role, to
        return found

    @staticmethod
    def tail(state: int) -> list[str]:
        """Roles inserted after the last turn."""
        return {1: ["user", "assistant"], 2: ["assistant"]}.get(state, [])


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, letter, role, text) of each edit, then (conv_id, None, report, None); rows are (conv_id, pass, turn, hash, role, text, fault)."""
    repairs, none = Repairs(), object()
    conv = none

    def closing():
        for role in repairs.tail(state):
            yield conv, "I", role, ""
        turns = (high - low + 1 - distinct) if distinct else 0
        yield conv, None, (turns, *(count[f] for f in (BLANK, DUPLICATE, CUT)), illegal, cost), None

    for name, second, turn, _, role, text, fault in rows:
        if conv is none or name != conv:
            if conv is not none:
                yield from closing()
            conv, symbols, count, illegal, cost, after = name, bytearray(), [0] * 4, 0, 0, None
            low = high = previous = None
            distinct, at, state = 0, 0, 0
        if fault is None and not second:  # a conversation without rows
            continue
        if not second:
            initial = role[:1]
            symbols.append(4 * (ROLES.find(initial) if initial and initial in ROLES else 3) + fault)
            count[fault] += 1
            if previous is not None and previous + initial not in ("su", "ua", "au"):
                illegal += 1
            previous = initial
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
            continue
        if after is None:
            cost, after = repairs.scan(symbols)
        inserted, letter, new, state = repairs.arc(after[at], symbols[at], state)
        at += 1
        for r in inserted:
            yield conv, "I", r, ""
        yield conv, letter, role if new is None else new, text
    if conv is not none:
        yield from closing()


def _reports(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row a conversation: its counts, cost, audit, and the SHA-256 of the repaired turns as they pass."""
    letters, state, first = [], hashlib.sha256(), True
    for conv, letter, role, text in _edits(rows):
        if letter is None:
            yield (conv, *role, "".join(letters), state.hexdigest())
            letters, state, first = [], hashlib.sha256(), True
            continue
        letters.append(letter)
        if letter != "D":
            state.update((("" if first else "\n") + role + ":").encode())
            state.update(text.encode())
            first = False


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired turns, numbered from 0."""
    at = 0
    for conv, letter, role, text in _edits(rows):
        if letter is None:
            at = 0
        elif letter != "D":
            yield conv, at, role, text, letter
            at += 1


def _stream(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """The symbols of each conversation, in order, before its texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    read = read.withColumn("hash", turn_hash(F.col("role"), F.col("text")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    short = read.select("conv_id", "turn", "hash", "role", F.when(blank, BLANK).when(cut, CUT).otherwise(OK).alias("fault"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "hash").orderBy(F.col("turn").asc_nulls_first())) > 1
    short = short.withColumn("fault", F.when((F.col("fault") != BLANK) & seen, DUPLICATE).otherwise(F.col("fault")))
    none = F.lit(None).cast("string")
    columns = ["conv_id", "second", "turn", "hash", "role", "text", "fault"]
    both = short.withColumns({"second": F.lit(0), "text": none}).select(*columns).unionByName(read.withColumns({"second": F.lit(1), "fault": F.lit(None).cast("int")}).select(*columns))
    if conversations is not None:
        empty = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        both = both.unionByName(empty.select("conv_id", F.lit(0).alias("second"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("hash"), none.alias("role"), none.alias("text"), F.lit(None).cast("int").alias("fault")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "second", F.col("turn").asc_nulls_first(), "hash", "fault")


def report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows are (conv_id, turn, role, text), conversations (conv_id) names those to report even without rows.
    Turns are ordered by turn, null first, then by the hash of role and text, so repeated rows lie side by
    side. A null role or text is one space; null conv_ids are one conversation. A text of any length is
    read whole; an empty table gives no row. Other columns aren't read.
    """
    kinds = {"conv_id": "long"} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "long") | {"audit": "string", "repaired_sha256": "string"}
    return _streamed(_stream(rows, conversations), _reports, kinds)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, turn (from 0, without gaps), role, text, edit (K, R or I); rows as for report()."""
    return _streamed(_stream(rows, None), _turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string", "edit": "string"})


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user; nulls are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0")
    once = rows.drop("kind")
    return once.unionByName(rows.where("kind = 3").drop("kind"))
