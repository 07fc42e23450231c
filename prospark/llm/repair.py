"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation's rows, in order, are kept, given another role or deleted, and empty rows are inserted, at the least
cost, until the initials of the roles read `(s?(ua)+)?`. The roles written so far are one of four states (nothing, s, u,
a), so costs of a beginning are a vector of four, and so are costs of an end. A stretch of rows is solved by the vector
from its left side to its middle and the vector from its right side to its middle: they meet in the state of the least
sum, and both halves are solved alone. No table of rows by states is kept, and all stretches of a batch go in step.

Of equally cheap repairs the one with the ASCII-least audit (initials of its edits) is taken. An insertion belongs to
the row behind it, so audits of the same rows never begin one another, and an order of four per vector is enough: it
says which state's best audit so far is the least, and decides each meeting.

Conversations of any length are cut into chunks of at most `CHUNK_ROWS` rows that are dealt by (conversation, turn,
role, text), so a long conversation is spread over tasks. A chunk is summed up by its costs and orders from each of the
four states; the chunks' summaries alone meet by conversation and give the states between chunks; then chunks are
solved on their own. Equal rows of one turn are one row with a number from the start, and earlier rows with the same
role and text are found by aggregation and a join on whole row keys: no key of either is hot.

Defined cases: rows of a turn are ordered by role and text; null turns come first; null roles and texts are one space;
a null conversation id is one conversation; other columns are not read; an empty table gives an empty result. A role
counts by its initial, and a kept row keeps its role as written. Gaps beyond 64 bits are the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark.llm.chunks import partitions_for, text_bytes
from prospark.session import cut_lineage

CHUNK_ROWS = 512
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, s, u, a. The state after a role's initial, by state and initial (s, u, a, other).
START, S, U, A = range(4)
_NEXT = [[S, U, None, None], [None, U, None, None], [None, None, A, None], [None, U, None, None]]
#: The state that an insertion leads to, and insertions from a state to the end.
_INSERTED = [U, U, A, U]
_TO_END = np.array([0, 2, 1, 0])
_ROLE = {U: "user", A: "assistant"}
_FAR = np.int64(1) << 50


def _tables():
    """For 9 kinds of rows: cost, order and edits (inserted states, letter) of each step from state to state.

    Kind 0 has to go; else it is 1 + 2 * initial + truncated.
    """
    cost = np.full((9, 4, 4), _FAR, dtype=np.int64)
    order = np.full((9, 4, 4), 4, dtype=np.int64)
    edits = {}
    for kind in range(9):
        initial, late = divmod(kind - 1, 2) if kind else (3, 0)
        for a in range(4):
            best = {}
            t, inserted = a, []
            for _ in range(3):
                ways = [(DELETE, t, "D")]
                if kind:
                    ways += [(late * TRUNCATED, _NEXT[t][initial], "K")]
                    ways += [(REROLE + late * TRUNCATED, _NEXT[t][x], "R") for x in (1, 2)]
                for c, b, letter in ways:
                    if b is not None:
                        way = (INSERT * len(inserted) + c, "I" * len(inserted) + letter, tuple(inserted))
                        best[b] = min(best.get(b, way), way)
                t = _INSERTED[t]
                inserted = [*inserted, t]
            for i, b in enumerate(sorted(best, key=lambda b: best[b][1])):
                cost[kind, a, b], order[kind, a, b] = best[b][0], i
                edits[kind, a, b] = best[b][2], best[b][1][-1]
    return cost, order, edits


_COST, _ORDER, _EDITS = _tables()


def _forward(cost: np.ndarray, order: np.ndarray, kind: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders after one more row each; `extra` more copies of it are deleted."""
    way = cost[:, :, None] + _COST[kind]
    via = np.argmin(way * 8 + order[:, :, None], axis=1)
    rows = np.arange(len(kind))[:, None]
    new = np.minimum(way[rows, via, np.arange(4)], _FAR)
    key = order[rows, via] * 8 + _ORDER[kind[:, None], via, np.arange(4)]
    return np.where(new < _FAR, new + DELETE * extra[:, None], _FAR), (key[:, None, :] < key[:, :, None]).sum(axis=2)


def _in_step(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, stretches that have so many rows), longest first."""
    size = hi - lo
    by = np.argsort(-size, kind="stable")
    ends = np.searchsorted(-size[by], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for i, n in enumerate(ends.tolist()):
        yield i, by[:n]


def ahead(kind: np.ndarray, extra: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders of the four states behind rows lo to hi, from `state` before them."""
    cost = np.full((len(lo), 4), _FAR, dtype=np.int64)
    cost[np.arange(len(lo)), state] = 0
    order = np.tile(np.arange(4), (len(lo), 1))
    for i, some in _in_step(lo, hi):
        at = lo[some] + i
        cost[some], order[some] = _forward(cost[some], order[some], kind[at], extra[at])
    return cost, order


def back(kind: np.ndarray, extra: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Costs of rows lo to hi from each of the four states before them to `state` behind them."""
    cost = np.full((len(lo), 4), _FAR, dtype=np.int64)
    cost[np.arange(len(lo)), state] = 0
    for i, some in _in_step(lo, hi):
        at = hi[some] - 1 - i
        new = (cost[some][:, None, :] + _COST[kind[at]]).min(axis=2)
        cost[some] = np.where(new < _FAR, new + DELETE * extra[at][:, None], _FAR)
    return cost


def meet(before: np.ndarray, order: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The state of the least sum; of several that with the least audit before it."""
    return np.argmin((before + behind) * 8 + order, axis=1)


def solve(kind: np.ndarray, extra: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and behind each row, for stretches lo to hi with known states on both sides."""
    before, behind = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
    some = hi > lo
    lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    before[lo], behind[hi - 1] = first, last
    while True:
        some = hi - lo > 1
        if not some.any():
            return before, behind
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        mid = (lo + hi) // 2
        state = meet(*ahead(kind, extra, lo, mid, first), back(kind, extra, mid, hi, last))
        behind[mid - 1], before[mid] = state, state
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        first, last = np.concatenate([first, state]), np.concatenate([state, last])


def rows_in_order(rows: DataFrame) -> DataFrame:
    """(conv, at, role, text, n, blank, first): equal rows of a turn once, with their number.

    Takes conv_id, turn, role, text and n; `conv` and `at` are structs, in which nulls are equal and come first.
    """
    white = F.lit(WHITE)
    own = rows.select(
        F.struct(F.col("conv_id").alias("id")).alias("conv"),
        F.struct(F.col("turn").cast("long").alias("turn")).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.col("n").cast("long").alias("n"),
    ).withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    once = own.groupBy("conv", "at", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("n").alias("n"))
    earliest = once.groupBy("conv", "key").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    last = F.right(F.rtrim("text", white), F.lit(1))
    return once.join(earliest, ["conv", "at", "key"], "left").select(
        "conv", "at", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"), (last == "").alias("blank"), last.isin(".", "!", "?").alias("ended")
    )


_CHUNK = (
    "part int, chunk int, kind binary, extra array<long>, roles array<string>, texts array<string>, cost array<long>, order array<long>,"
    " blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int, first_turn long, last_turn long, turns long"
)
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of the sorted rows of a task."""
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, role, text = batch.column(0), batch.column(2), batch.column(3)
        ids, turn = conv.field(0), batch.column(1).field(0)
        gone = pc.is_null(ids).to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (gone[1:] & gone[:-1])
        run = np.flatnonzero(np.concatenate(([True], ~same)))
        into = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        lo = np.flatnonzero(into % CHUNK_ROWS == 0)
        hi = np.append(lo[1:], n)
        number = batch.column(4).to_numpy()
        first, blank, ended = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7))
        initial = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(role, 0, 1), value_set=pa.array(["s", "u", "a"])), 3).to_numpy()
        keep = first & ~blank
        kind = np.where(keep, 1 + 2 * initial + ~ended, 0)
        extra = number - 1
        wrong = extra.copy()
        wrong[1:] += ~_LEGAL[initial[:-1], initial[1:]]
        wrong[lo] = extra[lo]
        known = ~pc.is_null(turn).to_numpy(zero_copy_only=False)
        when = pc.fill_null(turn, 0).to_numpy()
        new = known.copy()
        new[1:] &= ~known[:-1] | (when[1:] != when[:-1])
        new[lo] = known[lo]
        # Turns rise within a chunk, nulls first: the last row has the last turn.
        start = hi - np.add.reduceat(known.astype(np.int64), lo)
        none = start == hi
        cost, order = np.empty((len(lo), 4, 4), dtype=np.int64), np.empty((len(lo), 4, 4), dtype=np.int64)
        for state in range(4):
            cost[:, state], order[:, state] = ahead(kind, extra, lo, hi, np.full(len(lo), state))
        ends = pa.array(np.append(lo, n).astype(np.int32))
        sixteen = pa.array(np.arange(0, 16 * len(lo) + 1, 16, dtype=np.int32))
        sums = [np.add.reduceat(x.astype(np.int64), lo) for x in (np.where(blank, number, 0), np.where(blank, 0, number - first), keep & ~ended, wrong, new)]
        columns = [
            conv.take(pa.array(lo)),
            pa.array(np.full(len(lo), part, dtype=np.int32)),
            pa.array(np.arange(done, done + len(lo), dtype=np.int32)),
            pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, ends.buffers()[1], pa.py_buffer(kind.astype(np.uint8))]),
            pa.ListArray.from_arrays(ends, pa.array(extra)),
            pa.ListArray.from_arrays(ends, role),
            pa.ListArray.from_arrays(ends, text),
            pa.ListArray.from_arrays(sixteen, pa.array(cost.reshape(-1))),
            pa.ListArray.from_arrays(sixteen, pa.array(order.reshape(-1))),
            *[pa.array(x) for x in sums[:4]],
            pa.array(initial[lo].astype(np.int32)),
            pa.array(initial[hi - 1].astype(np.int32)),
            pa.array(when[np.minimum(start, n - 1)], mask=none),
            pa.array(when[hi - 1], mask=none),
            pa.array(sums[4]),
        ]
        done += len(lo)
        yield pa.RecordBatch.from_arrays(columns, ["conv", *[c.split()[0] for c in _CHUNK.split(", ")]])


_LARGEST = (1 << 63) - 1


def _states(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """States before each chunk of one conversation and behind the last, and the cost; `cost` is (chunks, 4, 4)."""
    before, rank, seen = np.full(4, _FAR), np.arange(4), []
    before[START] = 0
    for c, o in zip(cost, order):
        seen.append((before, rank))
        way = before[:, None] + c
        via = np.argmin(way * 8 + rank[:, None], axis=0)
        before = np.minimum(way[via, np.arange(4)], _FAR)
        key = rank[via] * 8 + o[via, np.arange(4)]
        rank = (key[None, :] < key[:, None]).sum(axis=1)
    behind = INSERT * _TO_END
    states = np.zeros(len(cost) + 1, dtype=np.int64)
    states[-1] = meet(before[None], rank[None], behind[None])[0]
    total = int((before + behind)[states[-1]])
    behind = np.where(np.arange(4) == states[-1], 0, _FAR)
    for i in range(len(cost) - 1, 0, -1):
        behind = (cost[i] + behind[None, :]).min(axis=1)
        states[i] = meet(seen[i][0][None], seen[i][1][None], behind[None])[0]
        behind = np.where(np.arange(4) == states[i], 0, _FAR)
    return states, total


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States on both sides of each chunk; totals with the last chunk of a conversation. Rows come by (conv, part, chunk)."""
    held: list[dict] = []

    def close() -> list[dict]:
        own = [np.array([r[k] for r in held], dtype=np.int64).reshape(-1, 4, 4) for k in ("cost", "order")]
        states, cost = _states(*own)
        turns = [r for r in held if r["first_turn"] is not None]
        met = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns, turns[1:]))
        gaps = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - sum(r["turns"] for r in turns) + met if turns else 0
        sums = {k: sum(r[k] for r in held) for k in ("blank", "duplicate", "truncated", "illegal")}
        sums["illegal"] += sum(not _LEGAL[a["last_initial"], b["first_initial"]] for a, b in zip(held, held[1:]))
        out = [{"conv": r["conv"], "part": r["part"], "chunk": r["chunk"], "state": int(a), "next": int(b)} for r, a, b in zip(held, states, states[1:])]
        out[-1] |= sums | {"gaps": min(gaps, _LARGEST), "total": cost}
        return out

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([kind, *[(c, pa.int64()) for c in ("part", "chunk", "state", "next", "gaps", "blank", "duplicate", "truncated", "illegal", "total")]]))

    kind = None
    for batch in batches:
        kind, out = batch.schema.field("conv"), []
        for row in batch.to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                out += close()
                held = []
            held.append(row)
        if out:
            yield made(out)
    if held:
        yield made(close())


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired lines of each chunk."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        kinds = [np.frombuffer(k, dtype=np.uint8) for k in batch.column(names.index("kind")).to_pylist()]
        ends = np.cumsum([len(k) for k in kinds])
        kind = np.concatenate(kinds).astype(np.int64)
        extra = batch.column(names.index("extra")).flatten().to_numpy()
        states = [batch.column(names.index(k)).to_numpy() for k in ("state", "next")]
        before, behind = solve(kind, extra, ends - [len(k) for k in kinds], ends, *states)
        last = pc.is_valid(batch.column(names.index("total"))).to_pylist()
        audits, lines, i = [], [], 0
        for r, (roles, texts) in enumerate(zip(batch.column(names.index("roles")).to_pylist(), batch.column(names.index("texts")).to_pylist())):
            audit, own = [], []
            for role, text in zip(roles, texts):
                inserted, letter = _EDITS[int(kind[i]), int(before[i]), int(behind[i])]
                audit.append("I" * len(inserted) + letter + "D" * int(extra[i]))
                own += [_ROLE[s] + ":" for s in inserted]
                if letter != "D":
                    own.append((role if letter == "K" else _ROLE[int(behind[i])]) + ":" + text)
                i += 1
            if last[r]:
                state = int(states[1][r])
                for _ in range(_TO_END[state]):
                    state = _INSERTED[state]
                    audit.append("I")
                    own.append(_ROLE[state] + ":")
            audits.append("".join(audit))
            lines.append(own)
        keep = [names.index(k) for k in _KEPT]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(audits, pa.string()), pa.array(lines, pa.list_(pa.string()))], [*_KEPT, "audit", "lines"])


_KEPT = ["conv", "part", "chunk", "gaps", "blank", "duplicate", "truncated", "illegal", "total"]


def repaired(rows: DataFrame) -> DataFrame:
    """Repaired conversations in pieces: conv (struct of the id), part, chunk, audit and lines (`role:text`).

    Pieces of a conversation are in order of (part, chunk); its last piece also has its totals, null elsewhere. `rows`
    has conv_id, turn, role, text and n, the number of times the row stands there.
    """
    own = rows_in_order(rows)
    parts = partitions_for(rows, text_bytes(rows))
    dealt = own.repartitionByRange(parts, "conv", "at", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "at", "role", "text")
    kind = own.schema["conv"].dataType.simpleString()
    chunks = cut_lineage(dealt.select("conv", "at", "role", "text", "n", "first", "blank", "ended").mapInArrow(_pack, f"conv {kind}, {_CHUNK}"))
    slim = chunks.drop("kind", "extra", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    totals = "gaps long, blank long, duplicate long, truncated long, illegal long, total long"
    states = slim.mapInArrow(_fold, f"conv {kind}, part long, chunk long, state long, next long, {totals}")
    texts = chunks.select(F.col("part").cast("long").alias("part"), F.col("chunk").cast("long").alias("chunk"), "kind", "extra", "roles", "texts")
    return states.join(texts, ["part", "chunk"]).mapInArrow(_edit, f"conv {kind}, part long, chunk long, {totals}, audit string, lines array<string>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation; pieces come in order and are let go one by one."""
    audit, digest, some = [], hashlib.sha256(), False
    for batch in batches:
        names = batch.schema.names
        done = []
        for i, row in enumerate(zip(*(batch.column(names.index(k)).to_pylist() for k in ("audit", "lines", "total")))):
            piece, lines, total = row
            audit.append(piece)
            if lines:
                digest.update((("\n" if some else "") + "\n".join(lines)).encode())
                some = True
            if total is not None:
                done.append((i, "".join(audit), digest.hexdigest()))
                audit, digest, some = [], hashlib.sha256(), False
        if done:
            rows = batch.take(pa.array([i for i, _, _ in done]))
            columns = [rows.column(names.index(k)) for k in ("conv", *_KEPT[3:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a for _, a, _ in done], pa.string()), pa.array([d for _, _, d in done], pa.string())], ["conv", *_KEPT[3:], "audit", "repaired_sha256"])


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation with totals, audit and the digest of its repaired lines.

    A digest is sequential by nature: pieces of one conversation are read one after another in one task, which holds
    one of them at a time and the audit (one character per edit).
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    rows = pieces.repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    totals = "gaps long, blank long, duplicate long, truncated long, illegal long, total long"
    return rows.mapInArrow(_digest, f"conv {kind}, {totals}, audit string, repaired_sha256 string")
