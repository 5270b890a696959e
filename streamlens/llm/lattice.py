"""Near duplicates of embeddings by lattice hashing, with exact links.

Vectors that are nearly the same are gathered into balls first: rows are sorted by group (label and
length) and by their cell of the first table, and a vector joins the ball of a pivot no more than half the
link's angle away, so any two members of a ball are linked and need not be compared. Balls are at most
``BALL`` rows and a slice.

Each table projects unit vectors on 16 random directions, scales them and decodes both halves to the
nearest point of the E8 lattice; the two points are a vector's cell. A vector also probes the
``PROBES`` neighbouring cells (one of the 240 shortest lattice vectors away) that lie nearest. Balls that
meet in a cell, at least one of them at home there, are candidates if a sketch of 96 random signs of their pivots
allows a link between the members in question. Rows are sorted by cell in ranges, so a crowded cell goes through
several tasks; a cell of more than ``CAP`` rows, or one at a border of a task, is cut into blocks, and
every two blocks of a cell are compared. Nothing is capped.

Candidates are verified in double precision: pivots' angle and the radii of two balls show that all their
members are linked, or none; otherwise the members of both are compared by matrix products. Counts of links are
sums over balls; links are never expanded into pairs of members. A pair at exactly the threshold of 0.93 meets
with a probability of 0.995, one of cosine 0.95 with 0.9998 (simulated; the tests measure it against all pairs).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a
label, link with nothing. Vectors of different lengths are not compared. Each row is a vector of its own: repeated
rows link with one another. Rows without a vec_id come first as the smallest id. An empty table gives an
empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.llm.common import NO_ID, stored
from streamlens.llm.components import components

U = np.uint64
COSINE = 0.93
TABLES, PROBES, SPACING = 8, 3, 2.2
#: Directions of a table: two halves of eight.
WIDE = 16
SIGNS = 96
#: How many deviations above the expected number of different signs a pair at the threshold may have.
DEVIATIONS = 4.5
BALL, PIVOTS = 2048, 256
CAP = 1024
ROWS, BIN_ROWS = 2000, 20_000
#: Angles this close to a bound are decided by comparing members.
SLACK = 1e-6


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, whatever their size."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole numbers with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: D8, or D8 shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


@functools.cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = a, b
            out.append(row)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


class Lattice:
    """Cells and sketches of unit vectors of one length."""

    def __init__(self, size: int, tables: int = TABLES, probes: int = PROBES, seed: int = 17):
        draw = np.random.default_rng([seed, size])
        self.tables, self.probes = tables, probes
        wanted = draw.normal(size=(size, WIDE * tables))
        step = size // WIDE * WIDE
        if step:
            # directions at right angles, as many as there are room for
            for low in range(0, wanted.shape[1], step):
                part = wanted[:, low : low + step]
                wanted[:, low : low + step] = np.linalg.qr(part)[0] * math.sqrt(size)
        self.directions = wanted / SPACING
        self.signs = draw.normal(size=(size, SIGNS))
        self.factors = draw.integers(0, 2**63, WIDE, dtype=np.int64).astype(U) | U(1)
        with np.errstate(over="ignore"):
            steps = (2 * shortest()).astype(np.int64).astype(U)
            self.moves = np.concatenate([steps @ self.factors[:8], steps @ self.factors[8:]])

    def cells(self, units: np.ndarray, group: np.ndarray, tables: int | None = None, probes: bool = True) -> np.ndarray:
        """Keys by row, table, and home cell or probed neighbour."""
        n, tables = len(units), tables or self.tables
        x = (units @ self.directions[:, : WIDE * tables]).reshape(-1, 8)
        points = nearest_e8(x)
        with np.errstate(over="ignore"):
            whole = (2 * points).astype(np.int64).astype(U).reshape(n, tables, WIDE)
            home = whole @ self.factors
            salt = _mixed(group.astype(np.int64).view(U)[:, None] + np.arange(1, tables + 1, dtype=U))
            if not probes or not self.probes:
                return _mixed(home ^ salt)[:, :, None]
            # the move along the rest of a vector leads to the nearest neighbours
            toward = ((x - points) @ shortest().T).reshape(n, tables, 480)
            best = np.argpartition(-toward, self.probes, axis=2)[:, :, : self.probes]
            every = np.concatenate([home[:, :, None], home[:, :, None] + self.moves[best]], 2)
            return _mixed(every ^ salt[:, :, None])

    def sketch(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 signs."""
        raw = np.packbits(units @ self.signs > 0, axis=1)
        first = np.ascontiguousarray(raw[:, :8]).view(U).ravel()
        return first, np.ascontiguousarray(raw[:, 8:12]).view(np.uint32).ravel()


@functools.cache
def lattice(size: int) -> Lattice:
    return Lattice(size)


def sign_limits(angle: float) -> np.ndarray:
    """How many signs may differ, by the sum of both members' angles to their pivots, in 255ths of half the link's angle."""
    turn = np.minimum(math.pi, angle + np.arange(511) * (angle / 2 / 255)) / math.pi
    return np.ceil(SIGNS * turn + DEVIATIONS * np.sqrt(SIGNS * turn * (1 - turn))).astype(np.int64)


def usable(vector: Column | str, label: Column | str) -> Column:
    """Whether a row can link with others; never null."""
    x = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(label.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def by_length(raw: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their unit vectors for each length of vectors."""
    lengths = np.array([len(r) for r in raw])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, unit(np.frombuffer(b"".join(raw[k] for k in rows.tolist()), kind).reshape(len(rows), -1))


def embedded(rows: DataFrame, kind: str) -> DataFrame:
    """node, _id, grp, cell and vec of each row that can link."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column("x")
                values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
                cuts = np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
                raw = [values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                group = batch.column("grp").to_numpy()
                cell = np.empty(len(raw), np.int64)
                for own, units in by_length(raw, kind):
                    made = lattice(units.shape[1]).cells(units, group[own], tables=1, probes=False)
                    cell[own] = made[:, 0, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "_id", "grp")), pa.array(cell), pa.array(raw, pa.binary())],
                    names=["node", "_id", "grp", "cell", "vec"],
                )

    return rows.mapInArrow(embed, "node long, _id long, grp long, cell long, vec binary")


class _Pivots:
    """The balls that rows of one cell may still join."""

    def __init__(self, least: float):
        self.least = least
        self.units: list[np.ndarray] = []
        self.facts: list[list[int]] = []

    def place(self, units: np.ndarray, nodes: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple]:
        """Ball, cosine with its pivot, and the pivot's sketch, for each row."""
        out: list[tuple] = [()] * len(units)
        free = np.ones(len(units), bool)
        if self.units:
            near = units @ np.array(self.units).T
            best = near.argmax(1)
            for k in np.flatnonzero(near[np.arange(len(units)), best] >= self.least).tolist():
                fact = self.facts[best[k]]
                fact[3] += 1
                out[k] = (fact[0], near[k, best[k]], fact[1], fact[2])
                free[k] = False
        while free.any():
            k = int(free.argmax())
            fact = [int(nodes[k]), int(first[k]), int(second[k]), 0]
            near = units @ units[k]
            near[k] = 1.0
            for j in np.flatnonzero(free & (near >= self.least)).tolist():
                fact[3] += 1
                out[j] = (fact[0], near[j], fact[1], fact[2])
                free[j] = False
            self.units.append(units[k])
            self.facts.append(fact)
        open_ = [k for k, fact in enumerate(self.facts) if fact[3] < BALL][-PIVOTS:]
        self.units, self.facts = [self.units[k] for k in open_], [self.facts[k] for k in open_]
        return out


def balls(vectors: DataFrame, kind: str, angle: float) -> DataFrame:
    """Each row with the node of its ball's pivot, its angle to it, and the pivot's sketch."""
    least = math.cos(angle / 2 - SLACK)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_now, pivots = None, _Pivots(least)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw = batch.column("vec").to_pylist()
                nodes, group, cell = (batch.column(c).to_numpy() for c in ("node", "grp", "cell"))
                lengths = np.array([len(r) for r in raw])
                n = len(raw)
                units: list[np.ndarray] = [np.empty(0)] * n
                first, second = np.empty(n, U), np.empty(n, np.uint32)
                for own, made in by_length(raw, kind):
                    first[own], second[own] = lattice(made.shape[1]).sketch(made)
                    for k, row in zip(own.tolist(), made, strict=True):
                        units[k] = row
                new = (np.diff(group) != 0) | (np.diff(cell) != 0) | (np.diff(lengths) != 0)
                placed: list[tuple] = []
                for own in np.split(np.arange(n), np.flatnonzero(new) + 1):
                    k = int(own[0])
                    key = (int(group[k]), int(cell[k]), int(lengths[k]))
                    if key != cell_now:
                        cell_now, pivots = key, _Pivots(least)
                    placed += pivots.place(np.array([units[j] for j in own]), nodes[own], first[own], second[own])
                away = np.arccos(np.clip(np.array([p[1] for p in placed]), -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("node", "_id", "grp", "vec")),
                        pa.array([p[0] for p in placed], pa.int64()),
                        pa.array(away),
                        pa.array(np.array([p[2] for p in placed], U).view(np.int64)),
                        pa.array([p[3] for p in placed], pa.int64()),
                    ],
                    names=["node", "_id", "grp", "vec", "ball", "away", "first", "second"],
                )

    ordered = vectors.repartitionByRange("grp", "cell", "node").sortWithinPartitions("grp", "cell", "node")
    return ordered.mapInArrow(form, "node long, _id long, grp long, vec binary, ball long, away double, first long, second long")


def cell_rows(members: DataFrame, kind: str, angle: float) -> DataFrame:
    """What each ball brings to a cell: key, ball, its pivot's signs; ``code`` ends with whether it is at home there and the widest angle."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw = batch.column("vec").to_pylist()
                columns = {c: batch.column(c).to_numpy() for c in ("grp", "ball", "away", "first", "second")}
                wide = np.ceil(columns["away"] / (angle / 2) * 255).astype(np.int64).clip(0, 255)
                for own, units in by_length(raw, kind):
                    keys = lattice(units.shape[1]).cells(units, columns["grp"][own])
                    many = keys.shape[1] * keys.shape[2]
                    home = np.zeros(keys.shape, np.int64)
                    home[:, :, 0] = 1
                    key, home = keys.reshape(-1).view(np.int64), home.reshape(-1)
                    row = np.repeat(own, many)
                    ball = columns["ball"][row]
                    order = np.lexsort((ball, key))
                    key, ball, home, row = key[order], ball[order], home[order], row[order]
                    begins = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(ball) != 0))))
                    home = np.maximum.reduceat(home, begins)
                    widest = np.maximum.reduceat(wide[row], begins)
                    row = row[begins]
                    code = columns["second"][row] << 16 | home << 8 | widest
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[begins]), pa.array(ball[begins]), pa.array(columns["first"][row]), pa.array(code)],
                        names=["key", "ball", "first", "code"],
                    )

    return members.select("grp", "vec", "ball", "away", "first", "second").mapInArrow(deal, "key long, ball long, first long, code long")


def _fits(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], limits: np.ndarray) -> np.ndarray:
    """Whether two rows of a cell (ball, first, code) are candidates; shapes are broadcast."""
    (a, p, c), (b, q, d) = left, right
    apart = np.bitwise_count((p ^ q).view(U)).astype(np.int64) + np.bitwise_count((c ^ d) >> 16)
    return (a != b) & (((c | d) >> 8 & 1) == 1) & (apart <= limits[(c & 255) + (d & 255)])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)


def candidates(rows: DataFrame, angle: float) -> DataFrame:
    """Pairs of balls (a, b) that meet in a cell."""
    limits = sign_limits(angle)
    #: Up to here, rows of a cell are compared at all distances for all cells at once.
    short = 32

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        block_no, begun, held = 0, False, [np.empty(0, np.int64)] * 4

        def cut(columns: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal block_no
            block_no += 1
            n = len(columns[0])
            return batch_of(columns, np.full(n, part + block_no), None)

        def batch_of(columns: list[np.ndarray], block, other) -> pa.RecordBatch:
            n = len(columns[0])
            made = [pa.array(c, pa.int64()) for c in columns]
            made.append(pa.nulls(n, pa.int64()) if block is None else pa.array(block, pa.int64()))
            made.append(pa.nulls(n, pa.int64()) if other is None else pa.array(other, pa.int64()))
            return pa.RecordBatch.from_arrays(made, names=["key", "ball", "first", "code", "block", "other"])

        def met(pairs: np.ndarray) -> pa.RecordBatch:
            none = np.zeros(len(pairs), np.int64)
            return batch_of([none, pairs[:, 0], none, none], None, pairs[:, 1])

        crowded = False
        for batch in batches:
            columns = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("key", "ball", "first", "code"), strict=True)]
            key = columns[0]
            begins = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            sizes = np.diff(begins)
            if not begun or crowded:
                # a cell at the border of a task, or the rest of one that is cut
                if len(sizes) == 1:
                    while len(columns[0]) >= CAP:
                        yield cut([c[:CAP] for c in columns])
                        columns = [c[CAP:] for c in columns]
                        crowded = True
                    held = columns
                    continue
                for low in range(0, int(begins[1]), CAP):
                    yield cut([c[low : min(low + CAP, int(begins[1]))] for c in columns])
                columns = [c[begins[1] :] for c in columns]
                key, begins, sizes = columns[0], begins[1:] - begins[1], sizes[1:]
                begun, crowded = True, False
            # the last cell may go on in the next batch
            last = int(begins[-2])
            held = [c[last:] for c in columns]
            while len(held[0]) >= CAP:
                yield cut([c[:CAP] for c in held])
                held = [c[CAP:] for c in held]
                crowded = True
            begins, sizes = begins[:-1], sizes[:-1]
            found = [np.empty((0, 2), np.int64)]
            inner = np.repeat(sizes, sizes) <= short
            few = [c[:last][inner] for c in columns]
            for lag in range(1, min(short, len(few[0]))):
                here = np.flatnonzero(few[0][lag:] == few[0][:-lag])
                if not len(here):
                    break
                left = tuple(c[here] for c in few[1:])
                right = tuple(c[here + lag] for c in few[1:])
                good = _fits(left, right, limits)
                found.append(_pairs(left[0][good], right[0][good]))
            for k in np.flatnonzero(sizes > short).tolist():
                own = [c[begins[k] : begins[k + 1]] for c in columns]
                if sizes[k] > CAP:
                    for low in range(0, int(sizes[k]), CAP):
                        yield cut([c[low : low + CAP] for c in own])
                    continue
                found.append(_cross(own[1:], own[1:], limits))
            yield met(np.unique(np.concatenate(found), axis=0))
        if len(held[0]):
            yield cut(held)

    schema = "key long, ball long, first long, code long, block long, other long"
    ordered = rows.repartitionByRange("key", "ball").sortWithinPartitions("key", "ball")
    read_rows = stored(ordered.mapInArrow(read, schema), "cells")
    inside = read_rows.filter("other is not null").select(F.col("ball").alias("a"), F.col("other").alias("b"))
    blocks = read_rows.filter("other is null").drop("other")
    return stored(inside.unionByName(block_candidates(blocks, limits)).distinct(), "candidates")


def _cross(left: list[np.ndarray], right: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    out = [np.empty((0, 2), np.int64)]
    for low in range(0, len(left[0]), 256):
        own = tuple(c[low : low + 256, None] for c in left)
        i, j = np.nonzero(_fits(own, tuple(c[None, :] for c in right), limits))
        out.append(_pairs(left[0][low + i], right[0][j]))
    return np.unique(np.concatenate(out), axis=0)


def block_candidates(blocks: DataFrame, limits: np.ndarray) -> DataFrame:
    """The candidates of cells that are cut: every two blocks of a cell are compared in a task."""

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("block").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("ball", "first", "code")]
        names = np.unique(side)
        left = [c[side == names[0]] for c in columns]
        right = [c[side == names[-1]] for c in columns]
        pairs = _cross(left, right, limits)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    held = blocks.select("key", "block").distinct()
    other = held.select("key", F.col("block").alias("b"))
    meets = (
        held.join(other, "key")
        .filter("block <= b")
        .select(F.xxhash64("key", "block", "b").alias("meet"), F.explode(F.array_distinct(F.array("block", "b"))).alias("block"))
    )
    return meets.join(blocks.drop("key"), "block").groupBy("meet").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, facts: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Candidates with their balls' sizes that link all members (``every``), or that must be compared."""
    angle = math.acos(cosine)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw_a, raw_b = batch.column("vec_a").to_pylist(), batch.column("vec_b").to_pylist()
                same = np.array([len(x) == len(y) for x, y in zip(raw_a, raw_b, strict=True)])
                same &= batch.column("grp_a").to_numpy() == batch.column("grp_b").to_numpy()
                near = np.full(len(raw_a), -1.0)
                for own, left in by_length(raw_a, kind):
                    own_same = same[own]
                    rows = own[own_same]
                    if len(rows):
                        right = unit(np.frombuffer(b"".join(raw_b[k] for k in rows.tolist()), kind).reshape(len(rows), -1))
                        near[rows] = np.einsum("ij,ij->i", left[own_same], right)
                wide = batch.column("wide_a").to_numpy() + batch.column("wide_b").to_numpy()
                single = (batch.column("n_a").to_numpy() == 1) & (batch.column("n_b").to_numpy() == 1)
                between = np.arccos(np.clip(near, -1, 1))
                every = np.where(single, near >= cosine, between + wide <= angle - SLACK)
                some = ~single & ~every & (between - wide <= angle + SLACK)
                kept = np.flatnonzero(same & (every | some))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(kept)) for c in ("a", "b", "n_a", "n_b")), pa.array(every[kept])],
                    names=["a", "b", "n_a", "n_b", "every"],
                )

    own = lambda s: facts.select(*(F.col(c).alias(f"{c}_{s}") for c in ("grp", "vec", "n", "wide")), F.col("ball").alias(s))
    return pairs.join(own("a"), "a").join(own("b"), "b").mapInArrow(check, "a long, b long, n_a long, n_b long, every boolean")


def compared(pairs: DataFrame, members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Links between members of two balls: node and its number of links, or the balls (a, b) that have any."""

    def compare(table: pa.Table) -> pa.Table:
        pair, side, node = (table.column(c).to_numpy() for c in ("pair", "left", "node"))
        raw, ball = table.column("vec"), table.column("ball").to_numpy()
        order = np.lexsort((node, ~side, pair))
        nodes, counts, a, b = [], [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            left, right = own[side[own]], own[~side[own]]
            x, y = (unit(np.frombuffer(b"".join(raw[k].as_py() for k in k_.tolist()), kind).reshape(len(k_), -1)) for k_ in (left, right))
            of_left, of_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for low in range(0, len(left), 512):
                linked = x[low : low + 512] @ y.T >= cosine
                of_left[low : low + 512] = linked.sum(1)
                of_right += linked.sum(0)
            if of_left.any():
                for ids, found in ((node[left], of_left), (node[right], of_right)):
                    nodes += ids[found > 0].tolist()
                    counts += found[found > 0].tolist()
                a.append(int(ball[left[0]]))
                b.append(int(ball[right[0]]))
        n, m = len(nodes), len(a)
        return pa.table(
            {
                "node": pa.array(nodes + [None] * m, pa.int64()),
                "n": pa.array(counts + [None] * m, pa.int64()),
                "a": pa.array([None] * n + a, pa.int64()),
                "b": pa.array([None] * n + b, pa.int64()),
            }
        )

    total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    dealt = pairs.select(
        F.pmod(F.xxhash64("a", "b"), F.lit(1 + total // BIN_ROWS)).alias("bin"), F.xxhash64("a", "b").alias("pair"),
        F.inline(F.array(*(F.struct(F.col(c).alias("ball"), F.lit(c == "a").alias("left")) for c in "ab"))),
    )
    joined = dealt.join(members.select("ball", "node", "vec"), "ball")
    return joined.groupBy("bin").applyInArrow(compare, "node long, n long, a long, b long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    element = rows.schema["embedding"].dataType.elementType
    kind, cast = ("<f4", "array<float>") if isinstance(element, T.FloatType) else ("<f8", "array<double>")
    angle = math.acos(cosine)
    ids = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("_id")
    whole = rows.select(ids, "embedding", "label", usable("embedding", "label").alias("usable"))
    group = F.xxhash64(F.col("label").cast("string"), F.size("embedding"))
    vectors = whole.filter("usable").select(
        F.monotonically_increasing_id().alias("node"), "_id", group.alias("grp"), F.col("embedding").cast(cast).alias("x")
    )
    members = stored(balls(embedded(vectors, kind), kind, angle), "members")
    sizes = members.groupBy("ball").agg(F.count("*").alias("n"), F.max("away").alias("wide"), F.min("_id").alias("least"))
    sizes = stored(sizes, "balls")
    pairs = candidates(cell_rows(members, kind, angle), angle)
    pivots = members.filter("node = ball").select("ball", "grp", "vec").join(sizes.select("ball", "n", "wide"), "ball")
    found = stored(verified(pairs, pivots, kind, cosine), "verified")
    parts = stored(compared(found.filter("not every"), members, kind, cosine), "compared")
    linked = found.filter("every")
    edges = linked.select("a", "b").unionByName(parts.filter("a is not null").select("a", "b"))
    roots = stored(components(edges), "roots").select(F.col("node").alias("ball"), "root")
    sums = linked.select(F.col("a").alias("ball"), F.col("n_b").alias("n")).unionByName(
        linked.select(F.col("b").alias("ball"), F.col("n_a").alias("n"))
    )
    more = sums.groupBy("ball").agg(F.sum("n").alias("more"))
    placed = stored(sizes.join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    each = placed.join(least, "root").join(more, "ball", "left").select(
        "ball", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("inside"), "component"
    )
    own = parts.filter("node is not null").groupBy("node").agg(F.sum("n").alias("own"))
    counted = members.select("node", "_id", "ball").join(each, "ball").join(own, "node", "left")
    known = counted.select("_id", (F.col("inside") + F.coalesce("own", F.lit(0))).alias("n_links"), F.col("component").alias("root"))
    alone = whole.filter("not usable").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("root"))
    return known.unionByName(alone).select(
        F.nullif("_id", F.lit(NO_ID)).alias("vec_id"),
        "n_links",
        F.nullif("root", F.lit(NO_ID)).alias("component_id"),
        (F.col("_id") == F.col("root")).alias("kept"),
    )
