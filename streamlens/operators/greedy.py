"""Gap sampling over sorted partitions, one Arrow batch in memory at a time.

Whether a row is kept depends on the row kept before it, which no built-in
window expresses. Spark hash-partitions by stream and sorts (spilling when
needed); these functions walk the sorted batches and remember only the last kept
value of the current stream, so memory does not grow with the stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

# Shares above this, in percent, are of files far longer than said, or of ones without a length.
HIGHEST_SHARE = 1e9


def walk_in_order(
    df: DataFrame, stream: str, order: Sequence[str | Column], walk: Walk, schema: StructType
) -> DataFrame:
    """Pass each stream's rows, in order, through a Python function of Arrow batches.

    A batch may end inside a stream and hold several; the function keeps what it
    needs of the stream it is in. Cut ``df`` down first, as a stream is one task's.
    """
    ordered = df.repartition(stream).sortWithinPartitions(stream, *order)
    return ordered.mapInArrow(walk, schema)


def _runs(keys: pa.Array) -> Iterator[tuple[object, int, int]]:
    """Each run of equal keys, which are sorted: the key and the bounds of its rows."""
    runs = pc.run_end_encode(keys)
    ends = runs.run_ends.to_pylist()
    return zip(runs.values.to_pylist(), [0, *ends], ends)


def interval_walk(interval: int) -> Walk:
    """Over (stream, second, ...) rows, one per second: keep those a gap apart."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, due = None, interval
        for batch in batches:
            seconds = batch.column(1).to_pylist()
            kept: list[int] = []
            for key, lo, hi in _runs(batch.column(0)):
                if key != stream:
                    stream, due = key, interval
                i = bisect_left(seconds, due, lo, hi)
                while i < hi:
                    kept.append(i)
                    due = seconds[i] + interval
                    i = bisect_left(seconds, due, i + 1, hi)
            yield batch.take(pa.array(kept, pa.int64()))

    return walk


def near_share_walk(pct: int) -> Walk:
    """Over (stream, bin, low, high) rows, one per bin of shares: the bins a kept row can be in.

    Two chains of kept rows are followed, one never late and one never early, as far as the
    lowest and highest share of each bin tell; they start together, and each adds at most a
    bin to what lies between them. A bin is given where the early chain has made more steps
    than the late one had before it. Bins are narrower than ``pct``, so a chain makes at most
    one step in each. The margin covers the rounding of a difference of shares.
    """
    early, late = 1 - 1e-12, 1 + 1e-12

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, first, last, ahead = None, pct * early, pct * late, 0
        for batch in batches:
            lows = batch.column(2).to_numpy(zero_copy_only=False)
            highs = batch.column(3).to_numpy(zero_copy_only=False)
            near = np.zeros(batch.num_rows, dtype=bool)
            for key, lo, hi in _runs(batch.column(0)):
                if key != stream:
                    stream, first, last, ahead = key, pct * early, pct * late, 0
                while lo < hi:
                    i = lo + int(np.searchsorted(highs[lo:hi], first))
                    j = lo + int(np.searchsorted(highs[lo:hi], last))
                    at = min(i, j)
                    near[lo:at] = ahead > 0
                    if at == hi:
                        break
                    if i == at:
                        first = (max(first, lows[at]) + pct) * early
                        ahead += 1
                    near[at] = ahead > 0
                    if j == at:
                        reached = lows[at] if lows[at] >= last else highs[at]
                        last = (reached + pct) * late
                        ahead -= 1
                    lo = at + 1
            # The last bin holds all shares beyond its beginning.
            yield batch.filter(pa.array(near | (highs >= HIGHEST_SHARE))).select([0, 1])

    return walk


def share_walk(pct: int) -> Walk:
    """Over (stream, share, ...) rows, one per share: keep those ``pct`` apart, from 0.

    The share is a double and so is the last kept one; the comparison must be
    made on their difference. Binary search on ``last + pct`` may land one step
    beside the boundary of that test, so the neighbours are tried as well.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, last = None, 0.0
        for batch in batches:
            shares = batch.column(1).to_numpy(zero_copy_only=False)
            kept: list[int] = []
            for key, i, hi in _runs(batch.column(0)):
                if key != stream:
                    stream, last = key, 0.0
                while np.isfinite(last):
                    j = i + int(np.searchsorted(shares[i:hi], last + pct))
                    while j > i and shares[j - 1] - last >= pct:
                        j -= 1
                    while j < hi and shares[j] - last < pct:
                        j += 1
                    if j == hi:
                        break
                    kept.append(j)
                    last = float(shares[j])
                    i = j + 1
            yield batch.take(pa.array(kept, pa.int64()))

    return walk
