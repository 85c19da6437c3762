"""Conversation structure repair: the cheapest edits that give every conversation well-formed turns.

A conversation is well formed if it is empty, or if its roles are an optional system message and then user and
assistant in turn, ending with the assistant. A message is kept, given the role that is due, or deleted, and empty
messages can be inserted anywhere. Edits cost; among the cheapest the ASCII-least audit, the string of the edits'
initials, counts.

Both are one whole number. A path's weight is its cost times 256^W plus its audit as W digits to the base of 256, one
digit for the letter at each place and zeros after the end. Every edge of the graph adds its cost and its letter at
its own place, so the plain minimum of integers decides cost and ties. Nodes are (message, letters so far, what is
due); a node that is dearer than another one plus the inserts between the two lies on no cheapest path and is left.

Messages of a conversation are cut into blocks of at most BLOCK, wherever they lie in the cluster; each block is
solved for every state it can start and end in, and a conversation is a chain of its few blocks. There the same
integers decide, with one more digit for the order of the audits that follow. That digit takes the followers to begin
at the same place of the audit. They do: with these costs no cheapest repair inserts, as to delete a neighbour of the
inserted message, or to change both roles of a lone pair, is cheaper. Within a block inserts are weighed in full.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import small_batches
from siterank.sources.staging import stage

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; CUT_OFF for a truncated message that stays
BLOCK = 512
SHORT = 24  # blocks of at most so many messages are remembered, their patterns recur
BLANKS = " \t\n\x0b\f\r"

# what has been said so far: nothing, the system message, a user message, an assistant message
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by inserting or giving a role
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
FINE, TRUNCATED, FAULTY = range(3)  # a faulty message, blank or said before, must go

Weight = int


def _inserts() -> list[list[int | None]]:
    """How many inserts lead from one state to another."""
    out: list[list[int | None]] = [[None] * 4 for _ in STATES]
    for g in STATES:
        now, n = g, 0
        while out[g][now] is None:
            out[g][now] = n
            now, n = DUE[now], n + 1
    return out


_INSERTS = _inserts()


def _limits(nodes: dict[tuple[int, int], Weight], low: int) -> list[int]:
    """What a node (inserts so far, state) of each state may cost: no more than another one and the inserts from there."""
    best = [min((v >> low for (_, g), v in nodes.items() if g == h), default=None) for h in STATES]
    return [
        min((c + INSERT * _INSERTS[h][g] for h, c in enumerate(best) if c is not None and _INSERTS[h][g] is not None), default=0)
        for g in STATES
    ]


def _from(messages: tuple[tuple[str, int], ...], start: int) -> list[tuple[int, bytes] | None]:
    """(cost, audit) of the least path through the messages (initial, fault) for each state it can end in."""
    width = 2 * len(messages) + 4
    low = 8 * width

    def edge(cost: int, letter: str, place: int) -> Weight:
        return (cost << low) + (ord(letter) << (low - 8 * (place + 1)))

    nodes = {(0, start): 0}
    most = _limits(nodes, low)
    for i, (initial, fault) in enumerate(messages):
        todo = sorted(nodes)
        while todo:  # inserts before the message, those of fewer inserts first
            k, g = heapq.heappop(todo)
            to, weight = (k + 1, DUE[g]), nodes[k, g] + edge(INSERT, "I", i + k)
            if weight >> low <= most[to[1]] and (to not in nodes or weight < nodes[to]):
                if to not in nodes:
                    heapq.heappush(todo, to)
                nodes[to] = weight
        after: dict[tuple[int, int], Weight] = {}

        def reach(k: int, g: int, weight: Weight) -> None:
            if (k, g) not in after or weight < after[k, g]:
                after[k, g] = weight

        more = CUT_OFF if fault == TRUNCATED else 0
        for (k, g), weight in nodes.items():
            reach(k, g, weight + edge(DELETE, "D", i + k))
            if fault != FAULTY:
                reach(k, DUE[g], weight + edge(REROLE + more, "R", i + k))
                if g in KEPT[initial]:
                    reach(k, KEPT[initial][g], weight + edge(KEEP + more, "K", i + k))
        most = _limits(after, low)
        nodes = {(k, g): v for (k, g), v in after.items() if v >> low <= most[g]}
    out: list[tuple[int, bytes] | None] = []
    for h in STATES:
        least = min((v for (_, g), v in nodes.items() if g == h), default=None)
        out.append(None if least is None else (least >> low, (least & ((1 << low) - 1)).to_bytes(width, "big").rstrip(b"\0")))
    return out


def _block(messages: tuple[tuple[str, int], ...]) -> list[tuple[int, bytes] | None]:
    """The least paths from each state to each state, sixteen of them."""
    return [x for g in STATES for x in _from(messages, g)]


@lru_cache(1 << 16)
def _short_block(messages: tuple[tuple[str, int], ...]) -> list[tuple[int, bytes] | None]:
    return _block(messages)


# what ends a conversation after its last message, by the state it leaves: the inserts still due
_LAST = [None if (n := min((m for h in ENDS if (m := _INSERTS[g][h]) is not None), default=None)) is None else (INSERT * n, b"I" * n) for g in STATES]


class _Chain:
    """The blocks of one conversation, taken from the last to the first."""

    def __init__(self):
        self.cost: list[int | None] = [x and x[0] for x in _LAST]
        self.rank = self._ranks([x and (int.from_bytes(x[1].ljust(4, b"\0"), "big"), 0) for x in _LAST])
        self.steps: list[list[tuple[int, bytes] | None]] = []

    @staticmethod
    def _ranks(low: list) -> list[int]:
        order = sorted({x for x in low if x is not None})
        return [order.index(x) + 1 if x is not None else 0 for x in low]

    def add(self, options: list[tuple[int, bytes] | None]) -> None:
        width = max((len(x[1]) for x in options if x), default=0)
        step, cost, low = [], [], []
        for g in STATES:
            best = None
            for h in STATES:
                here = options[4 * g + h]
                if here is not None and self.cost[h] is not None:
                    digits = int.from_bytes(here[1].ljust(width, b"\0"), "big")
                    weight = ((here[0] + self.cost[h]) << (8 * width + 8)) + (digits << 8) + self.rank[h]
                    if best is None or weight < best[0]:
                        best = weight, h, here[1]
            step.append(best and best[1:])
            cost.append(best and best[0] >> (8 * width + 8))
            low.append(best and best[0] & ((1 << (8 * width + 8)) - 1))
        self.steps.append(step)
        self.cost, self.rank = cost, self._ranks(low)

    def audit(self) -> tuple[int, str]:
        out, g = [], START
        for step in reversed(self.steps):
            g, letters = step[g]
            out.append(letters)
        return self.cost[START], (b"".join(out) + _LAST[g][1]).decode()


def _same(a: str, b: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _order() -> list[Column]:
    return [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_sha")]


def _messages(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _turn, _role, _text, _sha); NULL roles and texts are one space."""
    space = F.lit(" ")
    rows = messages.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), space).alias("_role"), F.coalesce(F.col(text), space).alias("_text")
    )
    return rows.withColumn("_sha", F.unhex(F.sha2("_text", 256)))


BLOCKS = (
    "_conv {conv}, part int, at int, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string,"
    " costs array<long>, audits array<string>"
)
FOUND = "_conv {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _blocks(narrow: DataFrame, most: int) -> DataFrame:
    """One row for each run of at most so many messages of a conversation, numbered (part, at) in their order."""
    kind = narrow.schema["_conv"].dataType.simpleString()
    schema = BLOCKS.format(conv=kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, done = TaskContext.get().partitionId(), 0, None, []
        before, messages, faults, illegal = None, [], [0, 0, 0], 0

        def close() -> None:
            nonlocal at, messages, faults, illegal
            if messages:
                options = (_short_block if len(messages) <= SHORT else _block)(tuple(messages))
                done.append((
                    now, part, at, len(messages), *faults, illegal, messages[0][0], messages[-1][0],
                    [-1 if x is None else x[0] for x in options], [None if x is None else x[1].decode() for x in options],
                ))
                at += 1
            messages, faults, illegal = [], [0, 0, 0], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                c, turn, role, sha, initial, blank, said, cut = row
                copy = before is not None and row[:4] == before
                if before is None or c != now or len(messages) == most:
                    close()
                if messages and messages[-1][0] + initial not in LEGAL:
                    illegal += 1
                now, before = c, row[:4]
                fault = 0 if blank else 1 if said or copy else 2 if cut else None
                if fault is not None:
                    faults[fault] += 1
                messages.append((initial, FINE if fault is None else TRUNCATED if fault == 2 else FAULTY))
            if len(done) > 500:
                yield _batch(done, narrow_schema)
                done = []
        close()
        if done:
            yield _batch(done, narrow_schema)

    narrow_schema = _arrow(narrow, schema)
    conv = F.col("_conv").asc_nulls_first()
    columns = ["_conv", "_turn", "_role", "_sha", "initial", "blank", "said", "cut"]
    return narrow.repartitionByRange(conv, *_order()).sortWithinPartitions(conv, *_order()).select(*columns).mapInArrow(scan, schema)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def find_repairs(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row for each conversation: the conv column, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Messages are taken by turn, NULL first; of one turn by role and the SHA-256 of the text. A message has the first
    fault that holds: blank (no other character than white space), duplicate (role and text were there before),
    truncated (its last such character is none of .!?). gaps counts turns missing between the smallest and the
    largest, NULLs apart; illegal, neighbours whose roles do not follow each other. NULL roles and texts are one
    space; only the initials s, u and a of a role can stay, an empty role cannot. A NULL conversation is one of its
    own, an empty table has none, and other columns are not looked at.

    A conversation that holds much of the table is sorted, searched for duplicates and solved by many tasks; one task
    then chains its blocks, with four bytes for each message.
    """
    small_batches(messages.sparkSession)
    rows = _messages(messages, conv, turn, role, text)
    kind = rows.schema["_conv"].dataType.simpleString()
    bare = F.rtrim(F.col("_text"), F.lit(BLANKS))
    initial = F.substring("_role", 1, 1)
    narrow = stage(
        rows.select(
            "_conv", "_turn", "_role", "_sha", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
            (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        ),
        "narrow",
    )
    # texts that come again: whether in a later turn; copies within a turn are neighbours
    first = F.min(F.struct(F.col("_turn").isNotNull().alias("there"), F.col("_turn").alias("turn")))
    again = narrow.groupBy("_conv", "_role", "_sha").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1")
    marked = narrow.alias("m").join(again.alias("a"), _same("m", "a", "_conv", "_role", "_sha"), "left").select(
        "m.*", (F.col("a.n").isNotNull() & ~F.col("m._turn").eqNullSafe(F.col("a.first.turn"))).alias("said")
    )
    blocks = stage(_blocks(stage(marked, "marked"), block), "blocks")

    schema = FOUND.format(conv=kind)
    out_schema = _arrow(blocks, schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, opening = None, None, [], None
        for batch in batches:
            for c, blank, duplicate, truncated, illegal, first, last, costs, audits in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != now:
                    if state is not None:
                        done.append((now, *counts, *state.audit()))
                    now, state, counts, opening = c, _Chain(), [0, 0, 0, 0], None
                counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal))]
                if opening is not None and last + opening not in LEGAL:
                    counts[3] += 1
                opening = first
                state.add([None if a is None else (n, a.encode()) for n, a in zip(costs, audits)])
            if len(done) > 500:
                yield _batch(done, out_schema)
                done = []
        if state is not None:
            done.append((now, *counts, *state.audit()))
        if done:
            yield _batch(done, out_schema)

    found = (
        blocks.repartition("_conv").sortWithinPartitions("_conv", F.col("part").desc(), F.col("at").desc())
        .select("_conv", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits").mapInArrow(chain, schema)
    )
    turns = narrow.groupBy("_conv", "_turn").agg(F.lit(1).alias("one")).groupBy("_conv").agg(
        (F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")).alias("gaps")
    )
    out = found.alias("f").join(turns.alias("t"), _same("f", "t", "_conv"))
    return out.select(
        F.col("f._conv").alias(conv), F.coalesce("t.gaps", F.lit(0)).cast("long").alias("gaps"),
        *[F.col(f"f.{c}") for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")],
    )


def repaired(
    messages: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired messages: the conv column, place (0, 1, ...), edit (Keep, Rerole, Insert), turn (NULL of inserted
    ones), role and text. repairs: conv and audit as find_repairs gives them. The rows of a conversation come in order
    and from one task, which reads its messages sorted from disk and holds only its audit."""
    small_batches(messages.sparkSession)
    rows = _messages(messages, conv, turn, role, text).select("_conv", F.lit(1).alias("_kind"), "_turn", "_role", "_text", "_sha")
    audits = repairs.select(
        F.col(conv).alias("_conv"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_turn"].dataType).alias("_turn"),
        F.lit("").alias("_role"), F.col("audit").alias("_text"), F.lit(b"").alias("_sha"),
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_conv", "_turn")}
    schema = f"`{conv}` {kinds['_conv']}, place long, edit string, `{turn}` {kinds['_turn']}, `{role}` string, `{text}` string"
    out_schema = _arrow(rows, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, state, place, out = None, "", 0, START, 0, []

        def inserted() -> None:
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                at, state = at + 1, DUE[state]
                out.append((now, place, "Insert", None, ROLE[state], ""))
                place += 1

        for batch in batches:
            for c, kind, t, r, body in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == 0:
                    inserted()
                    now, audit, at, state, place = c, body, 0, START, 0
                    continue
                inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    state = DUE[state] if letter == "R" else KEPT[r[:1]][state]
                    out.append((c, place, "Keep" if letter == "K" else "Rerole", t, r if letter == "K" else ROLE[state], body))
                    place += 1
            if out:
                yield _batch(out, out_schema)
                out = []
        inserted()
        if out:
            yield _batch(out, out_schema)

    both = rows.unionByName(audits).repartition("_conv").sortWithinPartitions("_conv", "_kind", *_order())
    return both.select("_conv", "_kind", "_turn", "_role", "_text").mapInArrow(scan, schema)


def digests(fixed: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, repaired_sha256): lower-case hex of `role:text` of all messages, joined by line ends, straight from
    `repaired`, whose tasks have each conversation in order; fails if given in any other way."""
    schema = f"`{conv}` {fixed.schema[conv].dataType.simpleString()}, repaired_sha256 string"
    out_schema = _arrow(fixed, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, due, done = None, None, 0, []
        for batch in batches:
            for c, place, r, body in zip(*(x.to_pylist() for x in batch.columns)):
                if place == 0:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state, due = c, hashlib.sha256(), 0
                if c != now or place != due:
                    raise ValueError(f"conversation {c}: message {place} is out of order")
                state.update((("\n" if place else "") + f"{r}:{body}").encode())
                due += 1
            if len(done) > 5000:
                yield _batch(done, out_schema)
                done = []
        if state is not None:
            done.append((now, state.hexdigest()))
        if done:
            yield _batch(done, out_schema)

    return fixed.select(conv, "place", role, text).mapInArrow(scan, schema)
