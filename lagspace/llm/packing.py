"""Best-fit packing by the sum-of-squares rule.

A document's ids are followed by an end id. A document longer than a sequence is
cut so that only its first piece is shorter than a whole sequence; whole pieces
fill sequences by themselves. Every other piece goes where the sum, over all
residual gaps, of the squared number of open sequences with that gap becomes
smallest; a new sequence counts as one of the choices, ties go to the smallest
gap. The rule's state is a count per gap, at most as many numbers as a sequence
has tokens, so a task packs the rows that it reads in one pass. The few sequences
that a task leaves with room, fewer than a number that its rows don't change, are
opened again: a second pass packs the pieces of 64 tasks together by the same
rule, so the result hardly depends on how the input is split.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

CAPACITY = 1024
END_ID = 2
#: So many pieces are ordered before they are placed.
HORIZON = 1 << 16
#: Sequence ids of a task begin at its partition times this.
SPAN = 1 << 40
#: And those of the second pass this much higher; one of its streams takes what so many tasks left.
LEFT = 1 << 61
TASKS = 64


class SumOfSquares:
    """The packer of one stream of lengths. place(length) gives (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0):
        self.capacity, self.next = capacity, first
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        c = self.capacity
        if not 0 < length <= c:
            raise ValueError(f"a length must be from 1 to {c}: {length}")
        # Moving a sequence from gap g to g - length changes the sum by 2 * (n[g - length] - n[g] + 1), or 1 - 2 * n[g] where it closes.
        n = self.count
        change = 2 * (n[: c + 1 - length] - n[length:]) + 2
        change[0] = 1 - 2 * n[length]
        change[n[length:] == 0] = 1 << 60
        best = int(change.argmin()) if len(change) else 0
        fresh = 2 * n[c - length] + 1 if length < c else 0
        if change[best] >= fresh:
            sequence, offset, gap = self.next, 0, c - length
            self.next += 1
        else:
            g = best + length
            sequence, offset, gap = self.open[g].pop(), c - g, g - length
            n[g] -= 1
        if gap:
            self.open[gap].append(sequence)
            n[gap] += 1
        return sequence, offset


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter than a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def order(length: int, mixed: int, capacity: int) -> tuple[int, int]:
    """Sort key of a piece within the horizon: large pieces by falling length, then small ones in a mixed order, which the rule packs best."""
    return (-length, mixed) if length > capacity // 3 else (0, mixed)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _packed(path: str, capacity: int, end_id: int):
    """Pieces of a task's rows, placed; left: its sequence has room left at the task's end."""

    def run(batches):
        from lagspace.llm import bpe

        c, end = bpe.codec(path), np.uint32(end_id).tobytes()
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() * SPAN)
        room: dict[int, list[tuple]] = {}

        def placed(todo):
            todo.sort(key=lambda x: order(x[3], x[4], capacity))
            closed = []
            for x in todo:
                sequence, offset = packer.place(x[3])
                held = room.setdefault(sequence, [])
                held.append((*x, sequence, offset))
                if offset + x[3] == capacity:
                    closed += room.pop(sequence)
            return _batch(closed, False)

        todo: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1))):
                ids = c.encode(text) + end
                for k, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                    todo.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                if len(todo) >= HORIZON:
                    yield placed(todo)
                    todo = []
        yield placed(todo)
        yield _batch([x for held in room.values() for x in held], True)

    return run


def _batch(rows: list[tuple], left: bool) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(cols, KINDS)], pa.array([left] * len(rows), pa.bool_())], names=[*NAMES, "left"])


def _packed_again(capacity: int):
    """The same rule over the pieces that tasks left in sequences with room."""

    def run(batches):
        packer = SumOfSquares(capacity, LEFT + TaskContext.get().partitionId() * SPAN)
        todo = [x for b in batches for x in zip(*[c.to_pylist() for c in b.columns[:5]])]
        todo.sort(key=lambda x: (-x[3], x[4], x[0] or 0, x[1]))
        if todo:
            yield _batch([(*x, *packer.place(x[3])) for x in todo], True).drop_columns(["left"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows are
    packed each by itself; a null doc_id stays null. An empty table gives no
    rows. What tasks have placed is written to the shared folder, so a lost
    executor doesn't change a sequence.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = common.pick(docs, "doc_id", "text")
    placed = common.cut(rows.mapInArrow(common.lean(_packed(path or common.tokenizer_path(), capacity, end_id)), DDL + ", left boolean"))
    streams = max(1, -(-placed.rdd.getNumPartitions() // TASKS))
    again = placed.where("left").drop("left").repartition(streams).mapInArrow(_packed_again(capacity), DDL)
    return placed.where("NOT left").drop("left").unionByName(again)
