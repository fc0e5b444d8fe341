"""Role repair of conversations at the least cost, and their rendering (operator 9).

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last
one an assistant's. Every turn is kept, relabelled, or merged into the turn before it; empty turns may be
inserted before it or at the end. A dynamic program over the states of that automaton finds the cheapest
repair, and the repaired turns are rendered.

Turns are sorted over all conversations into partitions, so a conversation of any length may lie in many.
The cheapest ways through a part of a conversation, from every state to every state, are a small
min-plus matrix; the matrices of the parts are combined, and every part is then traced back between the
states that the whole conversation passes there. No task holds more than a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import settle, share, shared

ROLES = ("system", "user", "assistant")
#: States: nothing yet, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Which role may follow in each state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    merge: int = 2
    insert: int = 4


def _steps(costs: Costs) -> list[list[list[tuple[int, str, tuple[int, ...]]]]]:
    """``ways[role][state before][state after]``: cost, action and inserted turns of the cheapest way.

    ``role`` is 0 for an unknown one, which any legal role may stand for at the cost of a relabel. Ties:
    keep before relabel before merge, fewer insertions, then the order of states.
    """
    none = (FAR, "", ())
    gaps = {}
    for state in range(STATES):  # insertions that lead from state to state
        gaps[state] = {state: ()}
        queue = [state]
        while queue:
            at = queue.pop(0)
            for after in FOLLOWS[at]:
                if after not in gaps[state]:
                    gaps[state][after] = (*gaps[state][at], after)
                    queue.append(after)
    ways = []
    for role in range(STATES):
        table = [[none] * STATES for _ in range(STATES)]
        for before in range(STATES):
            found: dict[int, list] = {}
            for at, inserted in gaps[before].items():
                price = costs.insert * len(inserted)
                for after in FOLLOWS[at]:
                    relabel = after != role
                    found.setdefault(after, []).append(
                        (price + costs.relabel * relabel, int(relabel), len(inserted), "relabel" if relabel else "keep", inserted)
                    )
                if at != START and at == before:
                    relabel = at != role
                    action = "relabel and merge" if relabel else "merge"
                    found.setdefault(at, []).append((costs.merge + costs.relabel * relabel, 2 + relabel, 0, action, ()))
            for after, options in found.items():
                price, _, _, action, inserted = min(options)
                table[before][after] = (price, action, inserted)
        ways.append(table)
    return ways


def _matrix(table) -> np.ndarray:
    return np.array([[way[0] for way in row] for row in table], dtype=np.int64)


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The costs of going through two parts one after the other."""
    return np.minimum((first[:, :, None] + second[None, :, :]).min(axis=1), FAR)


def end_costs(costs: Costs) -> list[int]:
    """What it costs to end in each state: empty turns up to an assistant's."""
    return [2 * costs.insert, 2 * costs.insert, costs.insert, 0]


def part_matrix(roles: list[int], steps: list[np.ndarray]) -> np.ndarray:
    """The costs from every state to every state over the turns of a part."""
    total = np.full((STATES, STATES), FAR, dtype=np.int64)
    np.fill_diagonal(total, 0)
    for role in roles:
        total = combine(total, steps[role])
    return total


def trace(roles: list[int], begin: int, end: int, steps: list[np.ndarray], ways) -> list[tuple[str, tuple[int, ...], int]]:
    """Action, insertions and state after every turn of the cheapest way from ``begin`` to ``end``.

    Of equal ways the one with the lower state at the last turn where they differ is taken.
    """
    forward = [np.where(np.arange(STATES) == begin, 0, FAR)]
    for role in roles:
        forward.append(np.minimum((forward[-1][:, None] + steps[role]).min(axis=0), FAR))
    out = []
    for i in range(len(roles) - 1, -1, -1):
        before = int((forward[i] + steps[roles[i]][:, end]).argmin())
        _, action, inserted = ways[roles[i]][before][end]
        out.append((action, inserted, end))
        end = before
    return out[::-1]


@dataclass(frozen=True)
class Template:
    """How a turn is written; ``between`` joins the texts of merged turns."""

    begin: str = "<|{role}|>\n"
    end: str = "\n<|end|>\n"
    between: str = "\n\n"


def _role_numbers(values: list[str | None]) -> list[int]:
    return [ROLES.index(value) + 1 if value in ROLES else 0 for value in values]


def _segments(ids: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield start, i
            start = i


def repair(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    costs: Costs = Costs(),
    template: Template = Template(),
) -> DataFrame:
    """One row for every turn of ``df``: ``conv_id, turn, position, role, new_role, action, inserted_before, inserted_after, cost, rendered``.

    ``position`` numbers the turns of a conversation from 0 in the order of turn number, role and text
    (nulls first); the ``rendered`` pieces in that order are the whole repaired conversation, inserted
    turns included, ``cost`` is that of the whole repair. Roles are compared in lower case without outer
    blanks; a null or unknown role can only be relabelled. A null text is empty. Rows with a null
    conversation are one conversation. Repeated rows are turns of their own, further columns are not
    read, an empty table gives an empty result.
    """
    ways = _steps(costs)
    kind = df.schema[conversation].dataType.simpleString()
    turn_kind = df.schema[turn].dataType.simpleString()
    rows = df.select(
        df[conversation].alias("conv_id"),
        df[turn].alias("turn"),
        df[role].alias("role"),
        F.coalesce(df[text], F.lit("")).alias("text"),
        F.lower(F.trim(df[role])).alias("known"),
    )
    # The last key parts equal turns of one conversation, which are interchangeable.
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "turn", "role", "text", "known", F.spark_partition_id().alias("part"))
    schema = f"conv_id {kind}, turn {turn_kind}, role string, text string, known string, part int, rank long"
    rows = settle(rows.mapInArrow(_ranked, schema), "turns")

    spread = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spread = F.broadcast(spread.select(F.col("conv_id").alias("wide")))  # fewer than there are partitions
    parts = rows.select("conv_id", "part", "rank", "known").join(spread, F.col("conv_id").eqNullSafe(F.col("wide")))
    matrices = [_matrix(table) for table in ways]

    def measure(found):
        found = found.sort_values("rank")
        roles = _role_numbers([x if isinstance(x, str) else None for x in found["known"]])
        out = found.iloc[:1][["conv_id", "part"]].copy()
        out["turns"] = len(roles)
        out["costs"] = [part_matrix(roles, matrices).ravel().tolist()]
        return out

    measured = parts.groupBy("conv_id", "part").applyInPandas(measure, f"conv_id {kind}, part int, turns long, costs array<long>")
    wide = _passages([(x.conv_id, x.part, x.turns, x.costs) for x in measured.collect()], costs)
    sent = share(df.sparkSession, wide)

    def run(batches):
        known_parts = shared(sent)
        for key, segment in _grouped(batches):
            yield _repaired(segment, known_parts.get(key), ways, matrices, costs, template)

    again = rows.repartition("part").sortWithinPartitions("part", "conv_id", "rank")
    return again.mapInArrow(
        run,
        f"conv_id {kind}, turn {turn_kind}, position long, role string, new_role string, action string, "
        "inserted_before array<string>, inserted_after array<string>, cost long, rendered string",
    )


def _ranked(batches):
    """Numbers the turns of each conversation in a sorted partition."""
    last, count = object(), 0
    for batch in batches:
        ranks = []
        for value in batch.column(0).to_pylist():
            count = count + 1 if value == last else 0
            last = value
            ranks.append(count)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "rank"])


def _grouped(batches):
    """The rows of each conversation in each part, as one table; they follow each other in the input."""
    held, key = [], None
    for batch in batches:
        ids = list(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist()))
        for start, end in _segments(ids):
            if held and ids[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = ids[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


@dataclass(frozen=True)
class Passage:
    """How a whole conversation passes through one part of it."""

    begin: int
    end: int
    offset: int
    cost: int
    first: bool
    last: bool


def _passages(measured: list[tuple], costs: Costs) -> dict[tuple, Passage]:
    """The passages of conversations that lie in several parts, from the matrices of the parts."""
    by_conversation: dict = {}
    for conversation, part, turns, matrix in measured:
        by_conversation.setdefault(conversation, []).append((part, turns, np.array(matrix, dtype=np.int64).reshape(STATES, STATES)))
    out = {}
    for conversation, parts in by_conversation.items():
        parts.sort(key=lambda x: x[0])
        forward = [np.where(np.arange(STATES) == START, 0, FAR)]
        for _, _, matrix in parts:
            forward.append(np.minimum((forward[-1][:, None] + matrix).min(axis=0), FAR))
        total = forward[-1] + end_costs(costs)
        end, cost = int(total.argmin()), int(total.min())
        offset = sum(turns for _, turns, _ in parts)
        for i in range(len(parts) - 1, -1, -1):
            part, turns, matrix = parts[i]
            begin = int((forward[i] + matrix[:, end]).argmin())
            offset -= turns
            out[conversation, part] = Passage(begin, end, offset, cost, i == 0, i == len(parts) - 1)
            end = begin
    return out


def _repaired(segment: pa.Table, passage: Passage | None, ways, matrices, costs: Costs, template: Template) -> pa.RecordBatch:
    """The repaired turns of one segment; without a passage it is a whole conversation."""
    roles = _role_numbers(segment.column("known").to_pylist())
    if passage is None:
        total = part_matrix(roles, matrices)[START] + end_costs(costs)
        passage = Passage(START, int(total.argmin()), 0, int(total.min()), True, True)
    taken = trace(roles, passage.begin, passage.end, matrices, ways)
    closing = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[passage.end]

    def empty(number: int) -> str:
        return template.begin.format(role=ROLES[number - 1]) + template.end

    before, after, pieces = [], [], []
    for i, ((action, inserted, state), text) in enumerate(zip(taken, segment.column("text").to_pylist())):
        ends = passage.last and i == len(taken) - 1
        if action.endswith("merge"):
            piece = template.between + text
        else:
            piece = "" if passage.first and not i else template.end
            piece += "".join(map(empty, inserted)) + template.begin.format(role=ROLES[state - 1]) + text
        if ends:
            piece += template.end + "".join(map(empty, closing))
        pieces.append(piece)
        before.append([ROLES[x - 1] for x in inserted])
        after.append([ROLES[x - 1] for x in closing] if ends else [])
    size = len(taken)
    columns = {
        "conv_id": segment.column("conv_id").combine_chunks(),
        "turn": segment.column("turn").combine_chunks(),
        "position": pa.array(np.arange(size, dtype=np.int64) + passage.offset),
        "role": segment.column("role").combine_chunks(),
        "new_role": pa.array([ROLES[state - 1] for _, _, state in taken], pa.string()),
        "action": pa.array([action for action, _, _ in taken], pa.string()),
        "inserted_before": pa.array(before, pa.list_(pa.string())),
        "inserted_after": pa.array(after, pa.list_(pa.string())),
        "cost": pa.array(np.full(size, passage.cost, dtype=np.int64)),
        "rendered": pa.array(pieces, pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)
