"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, first, and then user and
assistant turns in alternation, the last from the assistant.  Dynamic
programming over the automaton of legal turns chooses for each turn whether it
is kept, relabelled or merged into the one before, and where empty turns are
inserted, at the least total cost; ties go to the state and option listed first.

A conversation may hold any share of all rows, so none is gathered in one
place.  Ids and roles are sorted by range over all partitions, which cuts long
conversations into segments.  Three passes repair them as if they were whole:

1. each partition's first and last segment gives the least costs between all
   states at its ends (min-plus matrices, whose products are prefix costs);
2. with the prefix costs known, each cut segment says from which state it comes
   to each state;
3. with both ends known, each segment chooses its moves.

Between the passes the driver holds two small rows per partition at most.  The
texts are joined to their turns' decisions and rendered one by one.  The pieces
of a conversation in the order of ``place`` are its rendered form.

Delimiters that a text itself holds are escaped, so that no text can pass for
a turn; ``unescaped`` takes that back.

Cases: a null or unknown role is relabelled, at a lower cost; a null text is an
empty one.  Turns with equal numbers stand in the order of role and SHA-256 of
the text; repeated rows count once.  A very long text is hashed and rendered as
a whole and takes no part in the repair.  Null conversation ids form one
conversation.  Other columns are not read, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

START, SYSTEM, USER, ASSISTANT = STATES = ("start", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs in tenths.
MERGE, RELABEL, UNKNOWN, INSERT = 5, 10, 6, 15
KEYS = ["conv_id", "turn", "role", "hash"]
FAR = 10**12
AT_START = (0, FAR, FAR, FAR)


def _moves(state: str) -> list[tuple[str, tuple[str, ...], str, int]]:
    """(state reached, empty turns before, action, cost without relabelling) of taking one turn."""
    out = [(t, (), "append", 0) for t in NEXT[state]]
    if state != START:
        out.append((state, (), "merge", MERGE))
    out += [(t, (x,), "append", INSERT) for x in NEXT[state] for t in NEXT[x]]
    return out


MOVES = {s: _moves(s) for s in NEXT}
ENDS = {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}


@lru_cache(65_536)
def _step(costs: tuple[int, ...], role: str) -> tuple[tuple[int, ...], int, tuple]:
    """The states' costs after one more turn above the least of them, that least cost, and each state's (state before, action, empty turns)."""
    totals, back = [FAR] * len(STATES), [None] * len(STATES)
    for k, state in enumerate(STATES):
        for to, before, action, extra in MOVES[state] if costs[k] < FAR else ():
            total = costs[k] + extra + (0 if role == to else RELABEL if role in STATES[1:] else UNKNOWN)
            if total < totals[j := STATES.index(to)]:
                totals[j], back[j] = total, (k, action, before)
    least = min(totals)
    return tuple(t - least if t < FAR else FAR for t in totals), least, tuple(back)


def _run(roles: list[str], costs: tuple[int, ...]) -> tuple[list[tuple], tuple[int, ...], int]:
    """The steps' choices, the last costs above the least of them, and that least cost."""
    steps, base = [], 0
    for role in roles:
        costs, least, back = _step(costs, role)
        base += least
        steps.append(back)
    return steps, costs, base


def _trace(steps: list[tuple], state: int) -> list[tuple[str, str, tuple[str, ...]]]:
    """(action, role, empty turns before) of each turn that leads to the state."""
    out = []
    for back in reversed(steps):
        before, action, empty = back[state]
        out.append((action, STATES[state], empty))
        state = before
    return out[::-1]


def _end(costs: tuple[int, ...]) -> tuple[int, int]:
    """The cheapest state to end in and its cost with the empty turns after it."""
    total, k = min((c + INSERT * len(ENDS[s]), k) for k, (s, c) in enumerate(zip(STATES, costs)))
    return k, total


def repair(roles: list[str]) -> tuple[list[tuple[str, str, tuple[str, ...]]], tuple[str, ...], int]:
    """((action, role, empty turns before) of each turn, empty turns after the last, total cost in tenths)."""
    steps, costs, base = _run(roles, AT_START)
    state, total = _end(costs)
    return _trace(steps, state), ENDS[STATES[state]], base + total


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[tuple]]]:
    """(partition, conversation, its rows there) in order."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for (part, conv), group in groupby(rows, key=lambda r: (r[-1], r[0])):
        yield part, conv, list(group)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's first and last segment: its length and, from each state, the costs of reaching each."""
    kept: list = []
    for segment in _segments(batches):
        kept[1:] = [segment]
    for place, (part, conv, rows) in enumerate(kept):
        matrix = []
        for k in range(len(STATES)):
            _, costs, base = _run([r[2] for r in rows], tuple(0 if j == k else FAR for j in range(len(STATES))))
            matrix += [base + c if c < FAR else FAR for c in costs]
        yield pa.RecordBatch.from_pylist([{"part": part, "place": place, "conv_id": conv, "n": len(rows), "matrix": matrix}], pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv_id", pa.int64()), ("n", pa.int64()), ("matrix", pa.list_(pa.int64()))]))


def _links(sorted_rows: DataFrame) -> tuple[dict, dict]:
    """What the cut segments take from others, by partition.

    Entries, for a first segment: conversation, costs on entry, turns before it,
    total cost.  Exits, for a last segment: conversation, state to leave in, total cost.
    """
    edges = sorted(sorted_rows.mapInArrow(_edges, "part int, place int, conv_id long, n long, matrix array<long>").collect(), key=lambda r: (r["part"], r["place"]))
    chains: list[list] = []
    for row in edges:
        if chains and chains[-1][-1]["conv_id"] == row["conv_id"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    chains = [c for c in chains if len(c) > 1]
    entries, ends = {}, {}
    for chain in chains:
        costs, base, turns = AT_START, 0, 0
        for row in chain:
            if row is not chain[0]:
                entries[row["part"]] = (row["conv_id"], costs, turns)
            size = len(STATES)
            reached = [min(min(FAR, costs[k] + row["matrix"][size * k + j]) for k in range(size)) for j in range(size)]
            costs, base, turns = tuple(c - min(reached) if c < FAR else FAR for c in reached), base + min(reached), turns + row["n"]
        state, total = _end(costs)
        ends[chain[-1]["part"]] = (state, base + total)
    if not chains:
        return {}, {}

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, rows in _segments(batches):
            if part in entries:
                costs, came = entries[part][1], tuple(range(len(STATES)))
                for row in rows:
                    costs, _, back = _step(costs, row[2])
                    came = tuple(came[b[0]] if b else -1 for b in back)
                yield pa.RecordBatch.from_pylist([{"part": part, "came": list(came)}], pa.schema([("part", pa.int32()), ("came", pa.list_(pa.int32()))]))
            return  # only a partition's first segment can have one before it

    came = {r["part"]: r["came"] for r in sorted_rows.mapInArrow(origins, "part int, came array<int>").collect()}
    exits = {}
    for chain in chains:
        state, total = ends[chain[-1]["part"]]
        for row, previous in zip(chain[:0:-1], chain[-2::-1]):
            entries[row["part"]] += (total,)
            state = came[row["part"]][state]
            exits[previous["part"]] = (row["conv_id"], state, total)
    return entries, exits


def escaped(text: Column) -> Column:
    """A text without delimiters of turns: between ``<`` and ``|`` stands one backslash more than in the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn: its decision, the conversation's cost, and its piece of the rendered conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.unhex(F.sha2("text", 256)))
    narrow = rows.select(*KEYS).distinct().repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    narrow = durable(narrow.withColumn("part", F.spark_partition_id()))  # all passes see the same partitions
    entries, exits = _links(narrow)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, conv, segment in _segments(batches):
            entry = entries.get(part) if part in entries and entries[part][0] == conv else None
            leave = exits.get(part) if part in exits and exits[part][0] == conv else None
            steps, costs, base = _run([r[2] for r in segment], entry[1] if entry else AT_START)
            state, total = _end(costs)
            state = leave[1] if leave else state
            total = leave[2] if leave else entry[3] if entry else base + total
            first, end = entry[2] if entry else 0, len(segment) - 1
            for i, (row, (action, role, before)) in enumerate(zip(segment, _trace(steps, state))):
                last = i == end and not leave
                out.append((*row[:-1], first + i, action, role, before, ENDS[role] if last else (), last, total / 10))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    schema = "conv_id long, turn long, role string, hash binary, place long, action string, new_role string, before array<string>, after array<string>, last boolean, cost double"
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [pa.field(name, types[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    decided = narrow.mapInArrow(decide, schema)
    texts = rows.dropDuplicates(KEYS).select(*[F.col(k).alias(f"t_{k}") for k in KEYS], "text")
    on = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in KEYS]
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), "")
    close = lambda when: F.when(when, "<|end|>\n").otherwise("")
    merged = F.col("action") == "merge"
    head = F.when(merged, "\n").otherwise(F.concat(F.lit("<|"), "new_role", F.lit("|>\n")))
    # A turn is closed by the one that follows it, so that no piece depends on what comes later.
    piece = F.concat(close(~merged & (F.col("place") > 0)), empty(F.col("before")), head, escaped(F.col("text")), close(F.col("last")), empty(F.col("after")))
    return decided.join(texts, on).select(
        "conv_id", "turn", "place", "role", "new_role", "action", (F.col("role") != F.col("new_role")).alias("relabelled"),
        (F.size("before") + F.size("after")).alias("n_inserted"), "cost", piece.alias("piece"),
    )
