"""Minimum-cost repair of the roles of conversations, and their rendering.

A legal conversation is an optional system turn, then user and assistant in turn, assistant last. Each
input turn may be kept, relabelled, merged into the turn before (taking its role), or follow an inserted
empty turn; dynamic programming over the automaton of legal turns finds the cheapest repair. Among
repairs of equal cost the one that prefers, from the last turn back, the earlier state and action in
STATES and ACTIONS wins.

Conversations are cut into segments of at most CHUNK turns of the global order, so a conversation that holds
a third of all turns is many tasks. A segment first yields its costs from each state to each other (a min-plus
matrix); these are chained along each conversation forwards, to price each segment's entry, and
backwards, to fix it. Then every segment is repaired and rendered on its own. Chaining sees one row for
CHUNK turns and keeps one of them in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import ordered, saved

CHUNK = 512
STATES = ("start", "system", "user", "assistant")  # by the role of the last turn
ROLES = ("system", "user", "assistant")
LEGAL = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
# fixed values: other names of roles
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
ACTIONS = ("keep", "relabel", "merge", "merge relabelled", "insert", "insert and relabel")
FOREVER = 1 << 40
OPEN, CLOSE, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"
# cost of ending in each state, with the turns inserted to do so
ENDING = {"start": (0, ()), "system": (2 * INSERT, ("user", "assistant")), "user": (INSERT, ("assistant",)), "assistant": (0, ())}


def role_of(name: str | None) -> str | None:
    """The role that a label names, or None."""
    low = (name or "").strip().lower()
    low = ALIASES.get(low, low)
    return low if low in ROLES else None


def _moves(role: str | None) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, str | None]]]:
    """Costs of a turn of this role between states, and the (action, inserted role) that costs so."""
    cost = np.full((len(STATES), len(STATES)), FOREVER, np.int64)
    how: dict[tuple[int, int], tuple[str, str | None]] = {}

    def offer(p: str, q: str, price: int, action: str, inserted: str | None = None) -> None:
        at = STATES.index(p), STATES.index(q)
        if price < cost[at] or price == cost[at] and ACTIONS.index(action) < ACTIONS.index(how[at][0]):
            cost[at], how[at] = price, (action, inserted)

    for label in ROLES:
        change = 0 if label == role else RELABEL if role else RELABEL_UNKNOWN
        for p in STATES:
            if (p, label) in LEGAL:
                offer(p, label, change, "relabel" if change else "keep")
            if p == label:
                offer(p, label, MERGE + change, "merge relabelled" if change else "merge")
            for x in ROLES:
                if (p, x) in LEGAL and (x, label) in LEGAL:
                    offer(p, label, INSERT + change, "insert and relabel" if change else "insert", x)
    return cost, how


MOVES = {role: _moves(role) for role in (*ROLES, None)}
END = np.array([ENDING[s][0] for s in STATES], np.int64)


def product(before: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((before[:, :, None] + step[None]).min(axis=1), FOREVER)


def segment_costs(roles: list[str | None]) -> np.ndarray:
    """Cheapest cost of all turns from each state to each state."""
    total = np.where(np.eye(len(STATES), dtype=bool), 0, FOREVER)
    for role in roles:
        total = product(total, MOVES[role][0])
    return total


def segment_path(roles: list[str | None], entry: int, leave: int) -> list[int]:
    """States after each turn on the cheapest way from entry to leave."""
    reach = np.full(len(STATES), FOREVER, np.int64)
    reach[entry] = 0
    back = []
    for role in roles:
        costs = reach[:, None] + MOVES[role][0]
        back.append(costs.argmin(axis=0))
        reach = np.minimum(costs.min(axis=0), FOREVER)
    path = [leave]
    for choice in reversed(back[1:]):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def repaired(roles: list[str | None], texts: list[str | None], entry: int, leave: int, last: bool) -> list[tuple]:
    """(turn, place, role, action, cost, rendered) of each output row; place 0: before the turn, 1: the turn,
    2 and on: after it. The rendered pieces of a conversation in order are the conversation."""
    rows, state = [], entry
    for i, (role, text, after) in enumerate(zip(roles, texts, segment_path(roles, entry, leave))):
        action, inserted = MOVES[role][1][state, after]
        price, label = int(MOVES[role][0][state, after]), STATES[after]
        close = "" if state == 0 else CLOSE
        if inserted:
            rows.append((i, 0, inserted, "inserted", INSERT, close + OPEN.format(role=inserted)))
            price, close = price - INSERT, CLOSE
        head = JOIN if action.startswith("merge") else close + OPEN.format(role=label)
        shown = {"insert": "keep", "insert and relabel": "relabel"}.get(action, action)
        rows.append((i, 1, label, shown, price, head + (text or "")))
        state = after
    if last and rows:
        for k, extra in enumerate(ENDING[STATES[state]][1]):
            rows.append((len(roles) - 1, 2 + k, extra, "inserted", INSERT, CLOSE + OPEN.format(role=extra)))
        rows[-1] = (*rows[-1][:5], rows[-1][5] + CLOSE)
    return rows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (chunk, conv) in turn; rows come sorted by chunk and row."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["chunk"], row["conv"]) != (rows[0]["chunk"], rows[0]["conv"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _emit(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 2000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    found = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return found[kind.simpleString()]


def chat_format(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, seq, turn, role_in, role, action, cost, rendered): one row for each input turn and each
    inserted one; the rendered pieces in order of seq are the repaired conversation.

    Turns are ordered by number (null first), then role, then text; repeated rows are turns of their own.
    Rows with a null conversation are one conversation. Null and unknown roles are relabelled at a lower
    cost; null texts are empty. Empty input gives no rows. Conversation ids are longs, ints or strings.
    """
    conv_type, turn_type = (turns.schema[c].dataType for c in (conv_col, turn_col))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").alias("role"),
        F.col(f"`{text_col}`").alias("text"),
    )
    rows = ordered(rows, [F.col(c) for c in ("conv", "turn", "role", "text")])
    rows = saved(rows.withColumn("chunk", F.floor((F.col("row") - 1) / CHUNK)))
    conv, number = pa.field("conv", _arrow(conv_type)), pa.int64()
    matrix = pa.list_(pa.int64())
    segment = pa.schema([conv, ("chunk", number), ("first", number), ("m", matrix)])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(
            (
                {
                    "conv": s[0]["conv"],
                    "chunk": s[0]["chunk"],
                    "first": s[0]["row"],
                    "m": segment_costs([role_of(r["role"]) for r in s]).ravel().tolist(),
                }
                for s in _segments(batches)
            ),
            segment,
        )

    together = rows.select("conv", "chunk", "row", "role").repartition("chunk").sortWithinPartitions("chunk", "row")
    kind = conv_type.simpleString()
    priced = together.mapInArrow(price, f"conv {kind}, chunk long, first long, m array<long>")

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            before, total, first = None, None, 0
            for batch in batches:
                for row in batch.to_pylist():
                    if total is None or row["conv"] != before:
                        before, first = row["conv"], row["first"]
                        total = np.array([0, FOREVER, FOREVER, FOREVER], np.int64)
                    yield row | {"first": first, "v": total.tolist()}
                    m = np.array(row["m"], np.int64).reshape(4, 4)
                    total = np.minimum((total[:, None] + m).min(axis=0), FOREVER)

        return _emit(each(), segment.append(pa.field("v", matrix)))

    chain = priced.repartition("conv").sortWithinPartitions("conv", "chunk")
    chain = saved(chain.mapInArrow(forwards, f"conv {kind}, chunk long, first long, m array<long>, v array<long>"))

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            after, leave, started = None, 0, False
            for batch in batches:
                for row in batch.to_pylist():
                    m, v = np.array(row["m"], np.int64).reshape(4, 4), np.array(row["v"], np.int64)
                    last = not started or row["conv"] != after
                    if last:
                        after, started = row["conv"], True
                        leave = int(((v[:, None] + m).min(axis=0) + END).argmin())
                    entry = int((v + m[:, leave]).argmin())
                    yield {k: row[k] for k in ("conv", "chunk", "first")} | {"entry": entry, "leave": leave, "last": last}
                    leave = entry

        fields = [("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]
        return _emit(each(), pa.schema([*[segment.field(i) for i in range(3)], *fields]))

    fixed = chain.repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    fixed = fixed.mapInArrow(backwards, f"conv {kind}, chunk long, first long, entry int, leave int, last boolean")
    fixed = saved(fixed).select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "first", "entry", "leave", "last")

    out = pa.schema(
        [conv, ("seq", number), ("turn", _arrow(turn_type)), ("role_in", pa.string()), ("role", pa.string())]
        + [("action", pa.string()), ("cost", number), ("rendered", pa.string())]
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for s in _segments(batches):
                head = s[0]
                roles, texts = [role_of(r["role"]) for r in s], [r["text"] for r in s]
                for i, place, role, action, cost, text in repaired(roles, texts, head["entry"], head["leave"], head["last"]):
                    own = place == 1
                    yield {
                        "conv": head["conv"],
                        "seq": 4 * (s[i]["row"] - head["first"]) + place,
                        "turn": s[i]["turn"] if own else None,
                        "role_in": s[i]["role"] if own else None,
                        "role": role,
                        "action": action,
                        "cost": cost,
                        "rendered": text,
                    }

        return _emit(each(), out)

    same = rows["conv"].eqNullSafe(fixed["c"]) & (rows["chunk"] == fixed["k"])
    joined = rows.join(fixed, same).drop("c", "k").repartition("chunk").sortWithinPartitions("chunk", "row")
    return joined.mapInArrow(
        render,
        f"conv {kind}, seq long, turn {turn_type.simpleString()}, role_in string, role string, action string, "
        "cost long, rendered string",
    )
