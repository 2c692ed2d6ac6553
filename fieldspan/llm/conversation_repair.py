"""Repair of conversation structure by cheapest edits, ties to the ASCII-least audit.

Role initials of a repaired conversation read ``(s?(ua)+)?``. Each row is kept (K), given the role user
or assistant (R) or deleted (D), and empty turns may be inserted anywhere (I); blank and duplicate
rows must go, and truncated rows that stay cost more. The plan is a layered graph: before each row and
after the last there are four nodes (nothing yet, after s, after u, after a), and edits are arcs. A
cost pass from the end gives each node its cost to the end; arcs that lose nothing are optimal. Then
nodes are ranked by the least audit of 1, 2, 4, 8 ... edits that starts there: the rank over twice as
many edits is that of the pair (own rank, rank of the node that many edits on), and pointers double
with it. Ranks choose each node's arc, and doubled pointers lay out the least path from the start.
The optimal arcs that leave a node have different letters, so ranks inside a block of rows need
nothing from behind it, and no audit is the start of another of equal cost.

Rows are dealt by ranges of (conv_id, turn). Conversations that lie within a task are repaired there,
many at once in arrays. One that crosses tasks, or is longer than a block, is cut into blocks of rows:
each block gives its costs from state to state, a pass over these small tables gives the costs behind
each block, and blocks then lay out their least path from every state. Duplicates are found by a
join with the first row of each (role, text). Only the digest, a chain over the repaired turns, reads a
conversation in one task, a row at a time.

Rows stand in the order of turn (nulls first), role and text; nulls are one space (no role or text
stays null). The initial of an empty role is none, which fits nowhere. Repeated rows are duplicates.
Very long texts are read whole. An empty table gives no rows; a conversation all of whose rows are
dropped gives zeros, an empty audit and the digest of an empty string. A null conv_id is a
conversation of its own. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.shared import looked_up, shuffle_width, small_batches, written

BLOCK_ROWS = 4096
BATCH_BYTES = 4 << 20
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_LETTERS = "DIKR"
_FAR = 1 << 60
_NEXT = np.array([2, 2, 3, 2])  #: the state after a user or assistant turn that fits: states are none, s, u, a
_INITIAL = {"s": 1, "u": 2, "a": 3}
_KEEP = np.full((4, 4), -1)  #: the state after keeping a row of an initial (row) in a state (column)
_KEEP[1, 0], _KEEP[2, [0, 1, 3]], _KEEP[3, 2] = 1, 2, 3


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.insert) < 1 or self.truncated < 0:
            raise ValueError("edits cost at least 1")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone``, true for dropped rows, which only name their conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("code") != 0, F.col("text"))
    role = F.when(F.col("code") == 4, "user").when(F.col("code") != 0, F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), times.alias("_time")).drop("_time")


def fault(role: str, text: str) -> int:
    """The initial's number, with 4 for a blank and 16 for a truncated text (8 is for duplicates)."""
    ends = text.rstrip(_SPACE)
    return _INITIAL.get(role[:1], 0) | (4 if not ends else 0 if ends[-1] in ".!?" else 16)


def _first_fault(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    blank = codes & 4 > 0
    double = (codes & 8 > 0) & ~blank
    return codes & 3, blank, double, (codes & 16 > 0) & ~blank & ~double


class Plan:
    """Least paths through runs of rows, side by side in arrays.

    ``lengths`` are the runs' numbers of rows, ``codes`` their rows' faults one after another, ``behind``
    the costs from each state after a run's last row to the end (a row of four per run). If the runs
    are whole conversations (``ends``), turns may be inserted after the last row too.
    Node ``4 * (rows before it + runs before it) + state`` stands before a row, or after a run's last.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, behind: np.ndarray, costs: Costs, ends: bool = False):
        self.costs, self.ends = costs, ends
        self.initial, blank, double, short = _first_fault(codes)
        self.must = blank | double
        self.extra = np.where(short, costs.truncated, 0)
        self.lengths, self.base = lengths, np.cumsum(lengths) - lengths + np.arange(len(lengths))
        self.first = np.cumsum(lengths) - lengths
        self.cost = np.full((len(codes) + len(lengths), 4), _FAR, np.int64)
        self.cost[self.base + lengths] = behind
        by_length = np.argsort(-lengths, kind="stable")
        upward = -lengths[by_length]
        for t in range(int(lengths.max(initial=0))):
            own = by_length[: int(np.searchsorted(upward, -t))]  # runs longer than t rows
            at = self.base[own] + lengths[own] - 1 - t
            self.cost[at] = self._before(self.cost[at + 1], self.first[own] + lengths[own] - 1 - t)

    def _before(self, after: np.ndarray, rows: np.ndarray) -> np.ndarray:
        best = after + self.costs.delete
        free = ~self.must[rows]
        kept, rerole = self._kept(after, rows), after[:, _NEXT] + (self.costs.rerole + self.extra[rows])[:, None]
        best[free] = np.minimum(best[free], np.minimum(kept[free], rerole[free]))
        return closed(best, self.costs.insert)

    def _kept(self, after: np.ndarray, rows: np.ndarray) -> np.ndarray:
        to = _KEEP[self.initial[rows]]
        return np.where(to < 0, _FAR, np.take_along_axis(after, np.maximum(to, 0), 1) + self.extra[rows][:, None])

    def arcs(self) -> np.ndarray:
        """(nodes, 4): where the optimal arcs D, I, K, R lead; -1 where there is none."""
        nodes = self.cost.size
        out = np.full((nodes, 4), -1, np.int64)
        at = np.delete(np.arange(len(self.cost)), self.base + self.lengths)  # the layer before each row
        rows, own, after = np.arange(len(at)), self.cost[at], self.cost[at + 1]
        node = 4 * at[:, None] + np.arange(4)[None, :]
        free, live = ~self.must[rows][:, None], own < _FAR
        to = _KEEP[self.initial[rows]]
        out[node, 0] = np.where(live & (after + self.costs.delete == own), node + 4, -1)
        out[node, 1] = np.where(live & (own[:, _NEXT] + self.costs.insert == own), 4 * at[:, None] + _NEXT, -1)
        out[node, 2] = np.where(live & free & (self._kept(after, rows) == own), 4 * at[:, None] + 4 + to, -1)
        out[node, 3] = np.where(live & free & (after[:, _NEXT] + (self.costs.rerole + self.extra[rows])[:, None] == own), 4 * at[:, None] + 4 + _NEXT, -1)
        if self.ends:
            at = self.base + self.lengths
            own = self.cost[at]
            out[4 * at[:, None] + np.arange(4)[None, :], 1] = np.where((own < _FAR) & (own[:, _NEXT] + self.costs.insert == own), 4 * at[:, None] + _NEXT, -1)
        return out

    def paths(self, starts: np.ndarray) -> list[tuple[str, int]]:
        """(audit, last node) of the least optimal path from each node of ``starts``."""
        arcs = self.arcs()
        arcs = np.concatenate([arcs, np.full((1, 4), -1)])
        end = len(arcs) - 1
        there = arcs >= 0
        last = ~there.any(1)  # where a run ends
        letter = np.where(last, 0, there.argmax(1) + 1)
        onward = np.where(last, end, arcs[np.arange(len(arcs)), np.maximum(letter - 1, 0)])
        rank, ahead = letter, [onward]
        longest = int(2 * (self.lengths.max(initial=0) + 1))
        while 1 << len(ahead) <= longest and not (ahead[-1] == end).all():
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead[-1]], return_inverse=True)[1]
            ahead.append(ahead[-1][ahead[-1]])
        choice = np.where(there, np.arange(4)[None, :] * (int(rank.max()) + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max).argmin(1)
        ahead[0] = np.where(last, end, arcs[np.arange(len(arcs)), choice])
        for k in range(1, len(ahead)):
            ahead[k] = ahead[k - 1][ahead[k - 1]]
        path = starts[:, None]
        for step in ahead:
            path = np.concatenate([path, step[path]], 1)
        on = (path != end) & ~last[path]
        letters = np.frombuffer(_LETTERS.encode(), np.uint8)[choice[path]]
        stop = on.sum(1)
        return [(letters[i, :n].tobytes().decode(), int(path[i, n])) for i, n in enumerate(stop.tolist())]


def closed(costs: np.ndarray, insert: int) -> np.ndarray:
    """Costs to the end from each state when turns may be inserted first."""
    for _ in range(3):
        costs = np.minimum(costs, costs[:, _NEXT] + insert)
    return np.minimum(costs, _FAR)


def after_all(n: int, costs: Costs) -> np.ndarray:
    """The costs behind a conversation's last row: it may end with nothing or after an assistant."""
    return closed(np.tile(np.array([0, _FAR, _FAR, 0], np.int64), (n, 1)), costs.insert)


@dataclass
class _Chain:
    """What is reported of one conversation, a row after another."""

    conv_id: int | None
    repaired: object = field(default_factory=hashlib.sha256)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0, 0])  #: blank, duplicate, truncated, illegal, turns
    least: int | None = None
    most: int | None = None
    before: str | None = None
    state: int = 0
    started: bool = False
    cost: int = 0
    audit: list[str] = field(default_factory=list)

    def rows(self, turns: list, roles: list[str], texts: list[str], codes: np.ndarray, audit: str) -> None:
        """Take rows that follow, and their part of the audit."""
        _, blank, double, short = _first_fault(codes)
        for k, flags in enumerate((blank, double, short)):
            self.counts[k] += int(flags.sum())
        for turn, role in zip(turns, roles):
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.counts[3] += 1
            self.before = role[:1]
            if turn is not None and turn != self.most:
                self.counts[4] += 1
                self.least, self.most = turn if self.least is None else self.least, turn
        self.edits(iter(zip(roles, texts, codes.tolist())), audit)

    def edits(self, rows: Iterator[tuple[str, str, int]], audit: str) -> None:
        self.audit.append(audit)
        for edit in audit:
            role, text, code = ("", "", 0) if edit == "I" else next(rows)
            if edit == "D":
                continue
            self.state = int(_KEEP[code & 3, self.state] if edit == "K" else _NEXT[self.state])
            if edit != "K":
                role = "user" if self.state == 2 else "assistant"
            self.repaired.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
            self.started = True

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.counts[4]
        return self.conv_id, gaps, *self.counts[:4], self.cost, "".join(self.audit), self.repaired.hexdigest()


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LONG_ROWS = "deal int, idx long, turn long, role string, text string, code int, gone boolean"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def _repaired_here(conversations: list[tuple[int | None, list[tuple]]], costs: Costs) -> list[tuple]:
    """Reports of whole conversations: (conv_id, rows of turn, role, text)."""
    codes, lengths = [], []
    for _, rows in conversations:
        seen: set[tuple[str, str]] = set()
        for _, role, text in rows:
            codes.append(fault(role, text) | (8 if (role, text) in seen else 0))
            seen.add((role, text))
        lengths.append(len(rows))
    flags, sizes = np.array(codes, np.int64), np.array(lengths, np.int64)
    plan = Plan(flags, sizes, after_all(len(sizes), costs), costs, ends=True)
    out = []
    for (conv_id, rows), first, (audit, _), cost in zip(conversations, plan.first.tolist(), plan.paths(4 * plan.base), plan.cost[plan.base, 0].tolist()):
        chain = _Chain(conv_id)
        turns, roles, texts = map(list, zip(*rows)) if rows else ([], [], [])
        chain.rows(turns, roles, texts, flags[first : first + len(rows)], audit)
        chain.cost = cost
        out.append(chain.row())
    return out


def _read(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[dict]:
    return (r for b in batches for a in range(0, b.num_rows, most) for r in b.slice(a, most).to_pylist())


def _sorted_out(rows: DataFrame, costs: Costs, block_rows: int) -> DataFrame:
    """Reports (``cid`` null) of conversations that lie within a task, and the rows of the others."""
    key = F.substring("role", 1, 64), F.substring("text", 1, 64)  # a start of the texts parts equal turns without sampling long keys
    dealt = small_batches(rows).repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", "turn", *key)
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"{_REPORT}, cid string, {_LONG_ROWS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId()
        own: list[tuple] = []
        waiting: list[tuple[int | None, list[tuple]]] = []
        key, open_rows, size, idx, long, met = None, 0, 0, 0, True, 0

        def moved() -> pa.RecordBatch:
            cid = "" if key is None else str(key)
            return _table([(key, *[None] * 8, cid, deal, i, t, r, x, None if gone else fault(r, x), gone) for i, t, r, x, gone in own], schema)

        def solved() -> pa.RecordBatch:
            return _table([(*r, *[None] * 8) for r in _repaired_here(waiting, costs)], schema)

        for r in _read(batches):
            if met == 0 or r["conv_id"] != key:
                if met > 1 and not long:  # the first conversation may have begun in another task
                    waiting.append((key, [x[1:4] for x in own if not x[4]]))
                    open_rows += len(own)
                    if open_rows >= block_rows or size >= BATCH_BYTES:
                        yield solved()
                        waiting, open_rows, size = [], 0, 0
                elif own:
                    yield moved()
                met += 1
                key, own, idx, long = r["conv_id"], [], 0, met == 1
            own.append((idx, r["turn"], r["role"], r["text"], r["gone"]))
            size += len(r["text"] or "")
            idx += 1
            if len(own) >= block_rows or size >= 2 * BATCH_BYTES:
                if waiting:
                    yield solved()
                    waiting, open_rows = [], 0
                yield moved()
                own, size, long = [], 0, True
        if waiting:
            yield solved()
        if own:
            yield moved()

    return ordered.mapInArrow(run, schema)


def _flagged(rows: DataFrame) -> DataFrame:
    """cid, deal, idx, code with 8 for duplicates: rows that aren't the first of their role and text."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keys = written(rows.select("cid", "deal", "idx", "code", mark.alias("mark")), "turns")
    firsts = written(keys.groupBy("cid", "mark").agg(F.min(F.struct("deal", "idx")).alias("first")), "firsts")
    double = F.struct("deal", "idx") > F.col("first")
    return looked_up(keys, firsts, ["cid", "mark"]).select("cid", "deal", "idx", F.when(double, F.col("code").bitwiseOR(F.lit(8))).otherwise(F.col("code")).alias("code"))


def _blocks(flagged: DataFrame, costs: Costs, block_rows: int) -> DataFrame:
    """cid, deal, block, the codes of its rows, and its 4 x 4 costs from state to state."""
    schema = "cid string, deal int, block long, codes binary, matrix array<bigint>"

    def block(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        codes = table.column("code").to_numpy()[order].astype(np.int64)
        to = np.where(np.eye(4, dtype=bool), 0, _FAR)  # run q is the block with state q behind it
        plan = Plan(np.tile(codes, 4), np.full(4, len(codes)), to, costs)
        matrix = np.minimum(plan.cost[plan.base].T, _FAR)
        return pa.Table.from_batches([_table([(table.column("cid")[0].as_py(), table.column("deal")[0].as_py(), table.column("block")[0].as_py(), codes.astype(np.uint8).tobytes(), matrix.ravel().tolist())], schema)])

    return flagged.withColumn("block", F.floor(F.col("idx") / block_rows)).groupBy("cid", "deal", "block").applyInArrow(block, schema)


def _behind(blocks: DataFrame, costs: Costs) -> DataFrame:
    """cid, deal, block and the costs behind it: the blocks' matrices are met from the last to the first."""
    schema = "cid string, deal int, block long, behind array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, now, out = None, None, []
        for r in _read(batches):
            if r["cid"] != cid:
                cid, now = r["cid"], after_all(1, costs)[0]
            out.append((cid, r["deal"], r["block"], now.tolist()))
            now = np.minimum((np.array(r["matrix"], np.int64).reshape(4, 4) + now[None, :]).min(1), _FAR)
            if len(out) >= 1000:
                yield _table(out, schema)
                out = []
        yield _table(out, schema)

    return blocks.select("cid", "deal", "block", "matrix").repartition("cid").sortWithinPartitions("cid", F.desc("deal"), F.desc("block")).mapInArrow(run, schema)


def _laid_out(blocks: DataFrame, behind: DataFrame, costs: Costs) -> DataFrame:
    """Per block: the least audit from each state, the state that it leads to, and the costs before it."""
    schema = "cid string, deal int, block long, codes binary, audits array<string>, exits array<bigint>, before array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _read(batches, 20):
            codes = np.frombuffer(r["codes"], np.uint8).astype(np.int64)
            plan = Plan(codes, np.array([len(codes)]), np.array([r["behind"]], np.int64), costs)
            found = plan.paths(np.arange(4))
            yield _table([(r["cid"], r["deal"], r["block"], r["codes"], [a for a, _ in found], [n % 4 for _, n in found], plan.cost[0].tolist())], schema)

    return looked_up(blocks.drop("matrix"), behind, ["cid", "deal", "block"]).select("cid", "deal", "block", "codes", "behind").mapInArrow(run, schema)


def _chained(rows: DataFrame, plans: DataFrame, block_rows: int, costs: Costs) -> DataFrame:
    """Reports of the conversations in blocks: each streams through one task, a block's plan before its rows."""
    block = F.floor(F.col("idx") / block_rows)
    turns = rows.select("cid", "conv_id", "deal", block.alias("block"), "idx", "turn", "role", "text", "gone")
    every = turns.unionByName(plans.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    ordered = every.repartition("cid").sortWithinPartitions("cid", "deal", "block", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, cid, out, at = None, None, [], 0
        letters: Iterator[str] = iter(())
        codes = np.zeros(0, np.int64)
        exit_state = 0

        def ended() -> tuple:
            while chain.state not in (0, 3):  # turns inserted after the last row
                chain.edits(iter(()), "I")
            return chain.row()

        for r in _read(batches, 50):
            if chain is None or r["cid"] != cid:
                if chain is not None:
                    out.append(ended())
                    if len(out) >= 500:
                        yield _table(out, _REPORT)
                        out = []
                cid, chain, exit_state = r["cid"], _Chain(int(r["cid"]) if r["cid"] else None), 0
            if r["idx"] == -1:
                if not chain.audit:
                    chain.cost = r["before"][0]
                letters, codes, at = _pieces(r["audits"][exit_state]), np.frombuffer(r["codes"], np.uint8).astype(np.int64), 0
                exit_state = r["exits"][exit_state]
            elif not r["gone"]:
                chain.rows([r["turn"]], [r["role"]], [r["text"]], codes[at : at + 1], next(letters))
                at += 1
        if chain is not None:
            out.append(ended())
        yield _table(out, _REPORT)

    return ordered.mapInArrow(run, _REPORT)


def _pieces(audit: str) -> Iterator[str]:
    """The audit in pieces of one row: inserted turns, then the row's own edit."""
    start = 0
    for i, edit in enumerate(audit):
        if edit != "I":
            yield audit[start : i + 1]
            start = i + 1


def repaired(rows: DataFrame, costs: Costs = Costs(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A report per conversation of ``rows`` (conv_id, turn, role, text, and ``gone`` for rows that only name it)."""
    known = lambda c: F.when(~F.col("gone"), F.coalesce(c, F.lit(" "))).alias(c)
    rows = rows.select("conv_id", "turn", known("role"), known("text"), "gone")
    first = written(_sorted_out(rows, costs, block_rows), "repairs")
    whole = first.where(F.col("cid").isNull()).select(*[c.split()[0] for c in _REPORT.split(", ")])
    moved = first.where(F.col("cid").isNotNull()).select("conv_id", "cid", *[c.split()[0] for c in _LONG_ROWS.split(", ")])
    blocks = written(_blocks(_flagged(moved.where(~F.col("gone"))), costs, block_rows), "repair-blocks")
    plans = _laid_out(blocks, written(_behind(blocks, costs), "behind"), costs)
    return whole.union(_chained(moved, plans, block_rows, costs))
