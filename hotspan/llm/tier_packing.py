"""Hierarchical packing: several window sizes, gaps of long windows filled from shorter tiers, balanced step groups."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hotspan.llm import textarrays as ta
from hotspan.llm import tokens

#: Window sizes, powers of two; the tokens of a step group; leftovers gathered before they are packed.
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 8192
GATHERED = 8192
#: Pieces handed on at once.
HANDED = 1024

PIECES = ("doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint,"
          " offset bigint, sequence_tokens bigint, step_group bigint, ids binary")
#: Room for sequences and rows of one partition in a 64-bit id.
PER_PARTITION = 40


class TierPacker:
    """Packs the documents of one partition as they come by. A piece is (document, start, its ids)."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.longest, self.step_tokens = tuple(sorted(tiers)), max(tiers), step_tokens
        self.base, self.sequences = partition << PER_PARTITION, 0
        self.steps: dict[int, int] = defaultdict(int)
        self.waiting: dict[int, list[tuple]] = defaultdict(list)  # leftovers by their length
        self.lengths, self.tokens, self.count = 0, 0, 0  # bit set of lengths that wait, and their sums
        self.out: list[tuple] = []

    def add(self, document: tuple, ids) -> None:
        """``document``: (doc_id, row, number of ids). Whole windows leave at once, the rest waits in its tier."""
        whole = len(ids) - len(ids) % self.longest
        for at in range(0, whole, self.longest):
            self._close([(document, at, ids[at:at + self.longest])])
        if whole < len(ids):
            self._wait((document, whole, ids[whole:].copy()))  # a view would keep the ids of all texts beside it
        if self.count >= GATHERED:
            self.pack()

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        self.waiting[n].append(piece)
        self.lengths |= 1 << n
        self.tokens, self.count = self.tokens + n, self.count + 1

    def _take(self, n: int) -> tuple:
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths &= ~(1 << n)
        self.tokens, self.count = self.tokens - n, self.count - 1
        return piece

    def _fill(self, window: list[tuple], gap: int) -> None:
        """Best fit: the longest waiting piece within the gap, else the head of the shortest one. Enough must wait."""
        while gap:
            fits = self.lengths & ((1 << gap + 1) - 1)
            if fits:
                piece = self._take(fits.bit_length() - 1)
            else:
                document, start, ids = self._take((self.lengths & -self.lengths).bit_length() - 1)
                piece = (document, start, ids[:gap])
                self._wait((document, start + gap, ids[gap:]))
            window.append(piece)
            gap -= len(piece[2])

    def pack(self, last: bool = False) -> None:
        """Pack what waits, long tiers first. All windows come out full; what can't fill the shortest tier waits on."""
        for size, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
            own = [self._take(n) for n in range(size, below, -1) for _ in range(len(self.waiting.get(n, ())))]
            if not below:
                for piece in own:
                    self._wait(piece)
                while self.tokens >= size:
                    self._fill(window := [], size)
                    self._close(window)
                continue
            for document, start, ids in own:
                gap = size - len(ids)
                if self.tokens >= gap:
                    self._fill(window := [(document, start, ids)], gap)
                    self._close(window)
                else:  # nothing left for the gap: the next smaller window holds the first part
                    self._close([(document, start, ids[:below])])
                    self._wait((document, start + below, ids[below:]))
        while last and self.tokens:
            self._fill(window := [], 1 << self.tokens.bit_length() - 1)
            self._close(window)

    def _close(self, window: list[tuple]) -> None:
        total = sum(len(ids) for _, _, ids in window)
        number = self.base + self.sequences
        place = self.steps[total]
        step = self.base + (total << 24) + place // max(1, self.step_tokens // total)
        self.steps[total] += 1
        self.sequences += 1
        offset = 0
        for (doc_id, row, n), start, ids in window:
            self.out.append((doc_id, row, start, len(ids), zlib.crc32(ids), n, number, offset, total, step, ids))
            offset += len(ids)

    def leave(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_tiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
               step_tokens: int = STEP_TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most the longest tier: PIECES, without ``ids`` unless asked for.

    A document is its ids and an id 0. Whole windows of the longest tier leave at once; the rest is routed to the
    tier it fits. Each rest opens a window of its tier, whose gap is filled with pieces of shorter tiers, cut if need be;
    without any, its first part fills the next smaller window. Sequences thus have a power of two of ids and no
    padding. ``step_group`` numbers groups of equally long sequences with ``step_tokens`` ids together (the last group of
    a length in a partition may have fewer). Documents are packed partition by partition while they are read: there is no
    shuffle, a task holds the leftovers of a few thousand documents, and a lost task is repeated alone.

    A null text is empty and gives its id 0 alone. ``row`` numbers the rows, so repeated rows and null ids stay apart.
    An empty table gives no pieces. Only the two named columns are read.
    """
    names = ["ids"] if not with_ids else []
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        packer, row = TierPacker(partition, tiers, step_tokens), partition << PER_PARTITION
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in ta.text_pieces(batch.column(1)):
                ids, offsets = tokens.documents_of(texts, path)
                for i in range(texts.n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    packer.add((keys[at + i], row, b - a), ids[a:b])
                    row += 1
                yield from _table(packer.leave(), with_ids)
        packer.pack(last=True)
        yield from _table(packer.leave(), with_ids)

    schema = PIECES.rpartition(",")[0] if names else PIECES
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, schema)


def _table(pieces: list[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    for at in range(0, len(pieces), HANDED):
        columns = list(zip(*pieces[at:at + HANDED]))
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
        if with_ids:
            arrays.append(pa.array([ids.tobytes() for ids in columns[-1]], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, names=names[:len(arrays)])
