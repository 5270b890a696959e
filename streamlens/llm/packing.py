"""Packing of token ids into sequences of a fixed length by multiway differencing.

Documents are cut into pieces: full pieces of the sequence length, which are sequences by
themselves, and for the rest pieces of at most ``grain`` ids. A task gathers the rest
pieces of its rows up to the ids that ``windows`` sequences hold, filled to ``fill``; a piece that
crosses that limit is cut there. Each such group is divided by Karmarkar-Karp differencing: every
piece starts as a partial partition with one filled window; the two partial partitions of the
largest spread merge, the fullest windows of one with the emptiest of the other, until one is
left. If a window then exceeds the sequence length, the group gets one window more and is divided
again. No rows are shuffled, and a task holds one group.

Defined results: a null or empty text is its end id alone. Repeated rows are packed as rows of
their own. The last group of a task may have a sequence that is filled less. An empty table gives
an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.tokens import encoder_of, id_lists, parts, vocabulary_path

LENGTH = 2048
GRAIN = 512
WINDOWS = 64
FILL = 0.99

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


_sum = itemgetter(0)


def divide(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each window, with near-equal sums.

    A partial partition is its windows that are not empty, as (sum, items), the fullest first.
    """

    def merged(a: list, b: list) -> list:
        shared = len(a) + len(b) - windows
        if shared > 0:
            # the emptiest windows of one meet the emptiest of the other, crosswise
            alone_a, alone_b = len(a) - shared, len(b) - shared
            both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone_a:], reversed(b[alone_b:]), strict=True)]
            a, b = a[:alone_a] + both, b[:alone_b]
        out = a + b
        out.sort(key=_sum, reverse=True)
        return out

    def spread(part: list) -> int:
        return part[0][0] - (part[-1][0] if len(part) == windows else 0)

    heap = [(-size, k, [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        part = merged(heapq.heappop(heap)[2], heap[0][2])
        heapq.heapreplace(heap, (-spread(part), turn, part))
        turn += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows_of(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """The fewest windows, rising from the least possible number, that differencing can fill."""
    count = max(1, -(-sum(sizes) // length))
    while True:
        made = divide(sizes, count)
        if all(sum(sizes[k] for k in window) <= length for window in made):
            return made
        count += 1


def cut(n: int, length: int, grain: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    full = n - n % length
    yield from ((at, length) for at in range(0, full, length))
    yield from ((at, min(grain, n - at)) for at in range(full, n, grain))


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end: int = 1,
    length: int = LENGTH,
    grain: int = GRAIN,
    windows: int = WINDOWS,
    fill: float = FILL,
    special_as_text: bool = False,
) -> DataFrame:
    """A row for each piece: its document and place there, its sequence and place there, its ids."""
    vocabulary = vocabulary or vocabulary_path()
    room = int(windows * length * fill)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, group, held = encoder_of(vocabulary, special_as_text), [], 0
        sequence = TaskContext.get().partitionId() << 32

        def rows(pieces: list[tuple], windows_made: list[list[int]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[], [], [], [], [], [], []]
            for window in windows_made:
                offset = 0
                for k in sorted(window):
                    doc, start, ids, n = pieces[k]
                    row = (doc, start, len(ids), n, sequence, offset, ids)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += len(ids)
                sequence += 1
            columns = [pa.array(c, pa.int64()) for c in out[:6]]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            lists = id_lists(np.concatenate(out[6]), np.concatenate(([0], np.cumsum(out[2]))))
            return pa.RecordBatch.from_arrays([*columns, lists], names=names)

        for batch in parts(batches):
            full = []
            ids, begins = encoder.flat(batch.column("text").to_pylist(), end)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                n = b - a
                for at, size in cut(n, length, grain):
                    piece = ids[a + at : a + at + size]
                    if size == length:
                        full.append((doc, at, piece, n))
                        continue
                    first = min(size, room - held)
                    group.append((doc, at, piece[:first], n))
                    held += first
                    if held == room:
                        yield rows(group, windows_of([len(p[2]) for p in group], length))
                        group, held = [], 0
                        if first < size:
                            group, held = [(doc, at + first, piece[first:], n)], size - first
            if full:
                yield rows(full, [[k] for k in range(len(full))])
        if group:
            yield rows(group, windows_of([len(p[2]) for p in group], length))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, PIECE_SCHEMA)
