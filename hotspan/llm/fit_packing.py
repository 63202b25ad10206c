"""Best-fit-decreasing packing into fixed-width rows of token ids, with a segment tree over free capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hotspan.llm import textarrays as ta
from hotspan.llm import tokens

WIDTH = 1024
#: Pieces gathered before they are packed, and the fill below which a row is taken apart and packed again with the next ones.
GATHERED = 8192
FULL = 0.98

ROWS = ("sequence_id bigint, n_tokens int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>,"
        " position_resets array<int>, ids_crc32 bigint, ids binary")


class Capacities:
    """Open rows by free capacity. A segment tree over the capacities 0 to ``most`` counts the rows below each node."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, capacity) of a row with the least capacity of at least ``need``, removed from the tree."""
        node = need + self.size
        while not self.counts[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._count(capacity, -1)
        return self.rows[capacity].pop(), capacity

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.counts[node] += change
            node >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Indices of the pieces of each row; pieces are placed longest first where they leave the least room."""
    open_rows, rows = Capacities(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        row, capacity = found if found else (len(rows), width)
        if found is None:
            rows.append([])
        rows[row].append(i)
        open_rows.put(capacity - lengths[i], row)
    return rows


def pack_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
              path: str | None = None) -> DataFrame:
    """Rows of ``width`` token ids: ROWS.

    A document is its ids and an id 0; one longer than a row is split into whole rows and a rest, nothing is lost.
    ``ids`` holds ``width`` little-endian unsigned 32-bit ids, padded with 0 after ``n_tokens``. Segment j holds the ids of
    ``doc_ids[j]`` from ``starts[j]`` on and lies between ``cu_seqlens[j]`` and ``cu_seqlens[j + 1]``; positions count from 0
    again at each of ``position_resets``. ``ids_crc32`` is over the first ``n_tokens`` ids.

    Packing goes partition by partition over a few thousand pieces at a time, without a shuffle; rows that stay emptier
    than ``FULL`` are taken apart and packed with the next pieces. A null text is empty and is its id 0 alone; null ids
    and repeated rows are packed as they come; an empty table gives no rows. Only the two named columns are read.
    """
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, pieces = TaskContext.get().partitionId() << 40, 0, []

        def pack(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, pieces
            ready, kept = [], []
            for row in best_fit_decreasing([len(p[2]) for p in pieces], width):
                own = [pieces[i] for i in row]
                if last or sum(len(p[2]) for p in own) >= FULL * width:
                    ready.append(own)
                else:
                    kept += own
            pieces = kept
            if len(pieces) > GATHERED // 2 and not last:  # they don't go together well: let them go as they are
                yield from pack(True)
            for at in range(0, len(ready), 512):
                yield _matrix(ready[at:at + 512], base + made, width)
                made += len(ready[at:at + 512])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in ta.text_pieces(batch.column(1)):
                ids, offsets = tokens.documents_of(texts, path)
                for i in range(texts.n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    pieces += [(keys[at + i], start, ids[a + start:min(b, a + start + width)]) for start in range(0, b - a, width)]
                if len(pieces) >= GATHERED:
                    yield from pack(False)
        yield from pack(True)

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, ROWS)


def _matrix(rows: list[list[tuple]], first: int, width: int) -> pa.RecordBatch:
    matrix, bounds = np.zeros((len(rows), width), "<u4"), []
    for out, row in zip(matrix, rows):
        ends = np.cumsum([0] + [len(p[2]) for p in row])
        out[:ends[-1]] = np.concatenate([p[2] for p in row])
        bounds.append(ends.tolist())
    used = [b[-1] for b in bounds]
    columns = [
        pa.array(range(first, first + len(rows)), pa.int64()), pa.array(used, pa.int32()),
        pa.array([[p[0] for p in row] for row in rows], pa.list_(pa.int64())),
        pa.array([[p[1] for p in row] for row in rows], pa.list_(pa.int64())),
        pa.array(bounds, pa.list_(pa.int32())), pa.array([b[:-1] for b in bounds], pa.list_(pa.int32())),
        pa.array([zlib.crc32(x[:n].tobytes()) for x, n in zip(matrix, used)], pa.int64()),
        pa.array([x.tobytes() for x in matrix], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def write_rows(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files: id matrices, cumulative segment lengths and position resets."""
    rows.write.parquet(path)
