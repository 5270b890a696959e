"""MinHash near-duplicates by an LSH forest, with exact links.

A text's set is its distinct five-word shingles. Texts of equal sets are one class, represented
by its smallest doc_id. Each class has a MinHash signature, and each tree of the forest sorts all
classes by its own order of the signature's values. Classes with the longest common prefix stand
together there: a region is all classes that share at least ``DEPTH`` values. A
region of more than ``CAP`` classes or ``REGION_SHINGLES`` shingles is first taken as overlapping stretches of ``CAP`` neighbours in the
sorted order, so depth adapts to how crowded a region is: each class meets the neighbours
with the longest common prefixes, on both sides. What the links of all trees leave in different
components is then finished exactly: the classes of a cut region are dealt into blocks, a large component in
blocks of its own, and every two blocks that a region holds are compared, unless both are of one component. The work for a
region grows with the product of a few outliers and the rest, and with the square only of what stays unlinked.

Of regions with the same classes, which trees give again and again, only the first stays. Regions
are gathered into bins of bounded size, the full sets of their classes are attached, and a task computes all intersections in a region as products of an incidence matrix; it returns a
star for each group that is linked within the region, never its pairs. Trees come in two
waves: regions of the second wave whose classes the first has all put into one component
are left out.

Links hold exactly (100 * intersection >= share * union, of full sets); which pairs meet is left to
the signatures: a pair of similarity s is in one region of a tree with probability s^4, so of 16
trees all miss a pair of 0.85 once in 130,000 times, however crowded its regions are.

Defined results: null texts and texts without words have an empty set, are linked with nothing,
and are kept. Rows that share a doc_id are one document. A null doc_id counts as the smallest. An empty
table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import NO_ID, stored
from streamlens.llm.components import components
from streamlens.llm.shingles import MinHash, digest, shingle_sets, text_slices

SHARE = 85
#: Values of a signature; trees; values in a tree's order; values that a region shares.
HASHES, TREES, ORDER, DEPTH = 128, 16, 10, 4
#: The trees of the first wave.
FIRST = 3
#: Classes and shingles in a region, and shingles in a bin.
CAP, REGION_SHINGLES, BIN_SHINGLES = 1024, 2_000_000, 500_000


def prepare(docs: DataFrame) -> DataFrame:
    """Per row: id, digest of its set, size of its set, signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinHash(HASHES)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(at, len(sets)),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashing.signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["_id", "set", "n", "signature"],
                )
                at += len(sets)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
    return rows.mapInArrow(sign, "_id long, set binary, n long, signature binary")


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the tree's order of the signature as a sortable key."""
    places = np.array([[(8 * t + k) % HASHES for k in range(ORDER)] for t in range(TREES)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw = b"".join(batch.column("signature").to_pylist())
                signatures = np.frombuffer(raw, np.uint8).reshape(-1, HASHES, 2)
                n = len(signatures)
                keys = np.empty((n, TREES, 1 + 2 * ORDER), np.uint8)
                keys[:, :, 0] = np.arange(TREES)
                keys[:, :, 1:] = signatures[:, places].reshape(n, TREES, 2 * ORDER)
                flat = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(keys.shape[2]), n * TREES, [None, pa.py_buffer(keys.tobytes())]
                )
                repeat = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), TREES)
                yield pa.RecordBatch.from_arrays(
                    [flat.cast(pa.binary()), pa.array(repeat("node"), pa.int64()), pa.array(repeat("n"), pa.int64())],
                    names=["key", "node", "n"],
                )

    return classes.filter("n > 0").select("node", "n", "signature").mapInArrow(plant, "key binary, node long, n long")


def regions(rows: DataFrame) -> DataFrame:
    """Regions of at least two classes, and what stands at a border of a partition: tree, prefix, region, whether it is a stretch of a larger one, a digest of its classes, node, n.

    Sorted rows of a partition are read as a stream; what is held is a region at most ``CAP`` long.
    """
    share = 1 + 2 * DEPTH

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        out: list[tuple[int, bytes, int, bool, bytes, int, int]] = []
        region_no = 0
        held: list[tuple[int, int]] = []
        # a region at either end of a partition may go on in another
        prefix, fresh, total, cut = b"", 0, 0, True

        def close() -> None:
            nonlocal region_no
            if len(held) < 2 and not cut or fresh == 0:
                return
            nodes = np.sort(np.array([node for node, _ in held], np.int64))
            same = hashlib.blake2b(nodes.tobytes(), digest_size=16).digest()
            out.extend((prefix[0], prefix, part + region_no, cut, same, node, n) for node, n in held)
            region_no += 1

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["tree", "prefix", "region", "cut", "same", "node", "n"])

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for key, node, n in zip(keys, batch.column("node").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if key[:share] != prefix:
                    close()
                    held, prefix, fresh, total, cut = [], key[:share], 0, 0, not prefix
                elif len(held) >= CAP or total + n > REGION_SHINGLES and len(held) > 1:
                    cut = True
                    close()
                    held, fresh = held[-(len(held) // 2) :], 0
                    total = sum(x for _, x in held)
                held.append((node, n))
                fresh, total = fresh + 1, total + n
            if len(out) > 20_000:
                yield batch_of()
        cut = True
        close()
        if out:
            yield batch_of()

    ordered = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(read, "tree int, prefix binary, region long, cut boolean, same binary, node long, n long")


def binned(members: DataFrame) -> DataFrame:
    """The first of the regions with the same classes, each in one of so many bins as are needed."""
    first = members.groupBy("same").agg(F.min("region").alias("region")).select("region")
    kept = members.join(first, "region", "left_semi")
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = 1 + total // BIN_SHINGLES
    return kept.select("tree", "region", "node", F.pmod(F.xxhash64("region"), F.lit(bins)).alias("bin"))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full sets of the classes that stand in regions."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "shingles"],
                )
                at += len(sets)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("node"), "text")
    # merged at every size: which side is small changes with the data
    return rows.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(compute, "node long, shingles binary")


def linked_groups(sets: list[np.ndarray], share: int = SHARE) -> list[int]:
    """For each set the first set of its group: groups that links within the list connect."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [0, 0] if 100 * both >= share * (len(sets[0]) + len(sets[1]) - both) else [0, 1]
    sizes = np.array([len(s) for s in sets])
    values, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = counts[columns] > 1
    owner, columns = owner[common], columns[common]
    names, columns = np.unique(columns, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    width = max(64, (4 << 20) // n)
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    for low in range(0, len(names), width):
        a, b = np.searchsorted(columns, (low, low + width))
        part = np.zeros((n, min(width, len(names) - low)), np.float32)
        part[owner[a:b], columns[a:b] - low] = 1
        both += part @ part.T
    linked = 100 * both.astype(np.int64) >= share * (sizes[:, None] + sizes[None, :] - both)
    group = np.full(n, -1)
    for k in range(n):
        if group[k] < 0:
            group[k], front = k, [k]
            while front:
                near = np.flatnonzero(linked[front.pop()] & (group < 0))
                group[near] = k
                front.extend(near.tolist())
    return group.tolist()


def region_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked within each region."""

    def compare(table: pa.Table) -> pa.Table:
        region = table.column("region").to_numpy()
        nodes = table.column("node").to_numpy()
        raw = table.column("shingles").to_pylist()
        order = np.lexsort((nodes, region))
        cuts = np.flatnonzero(np.diff(region[order])) + 1
        out: set[tuple[int, int]] = set()
        for own in np.split(order, cuts):
            ids = nodes[own].tolist()
            if len(ids) > 1:
                groups = linked_groups([np.frombuffer(raw[k], np.uint64) for k in own.tolist()])
                out.update((ids[k], ids[g]) for k, g in enumerate(groups) if ids[k] != ids[g])
        pairs = sorted(out)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    joined = members.select("bin", "region", "node").join(sets.hint("merge"), "node")
    return joined.groupBy("bin").applyInArrow(compare, "a long, b long")


def unmet(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes of cut regions that hold several components: prefix, node, n, root."""
    members = found.filter("cut").select("prefix", "node", "n").distinct().join(roots, "node", "left")
    placed = stored(members.select("prefix", "node", "n", F.coalesce("root", "node").alias("root")), "cut")
    several = placed.groupBy("prefix").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return stored(placed.join(several.select("prefix"), "prefix", "left_semi"), "unmet")


def block_pairs(members: DataFrame) -> DataFrame:
    """Two blocks of classes for every two that a cut region holds: bin, region, node.

    A class stands in a block of its least region. A component of at least half a block there has
    blocks of its own, the others share theirs. Blocks have about ``CAP`` classes or half of
    ``REGION_SHINGLES`` at most, so two of them are no more than a stretch, and long texts get more blocks, not fewer partners.
    """
    room = REGION_SHINGLES // 2
    nodes = stored(
        members.groupBy("node").agg(
            F.min("prefix").alias("home"), F.first("root").alias("root"), F.first("n").alias("n"), F.collect_set("prefix").alias("prefixes")
        ),
        "homes",
    )
    sizes = nodes.groupBy("home", "root").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    large = (F.col("n") >= CAP / 2) | (F.col("shingles") >= room / 2)
    sizes = stored(sizes.withColumns({"large": large, "own": F.when(large, F.col("root")).otherwise(0)}), "sizes")
    needed = F.greatest(F.ceil(F.sum("n") / CAP), F.ceil(F.sum("shingles") / room))
    parts = sizes.groupBy("home", "large", "own").agg(needed.alias("parts"))
    dealt = nodes.join(sizes.select("home", "root", "large", "own"), ["home", "root"]).join(parts, ["home", "large", "own"])
    block = F.xxhash64("home", "large", "own", F.pmod(F.xxhash64("node"), "parts"))
    blocks = stored(dealt.select("node", "prefixes", "large", "own", block.alias("block")), "blocks")
    held = stored(blocks.select(F.explode("prefixes").alias("prefix"), "block", "large", "own").distinct(), "held")
    other = held.select("prefix", F.col("block").alias("b"), F.col("large").alias("large_b"), F.col("own").alias("own_b"))
    pairs = (
        held.join(other, "prefix")
        .filter("block <= b and not (large and large_b and own = own_b)")
        .select(F.col("block").alias("a"), "b")
        .distinct()
        .select(F.xxhash64("a", "b").alias("region"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    )
    return pairs.join(blocks.select("block", "node"), "block").select(F.col("region").alias("bin"), "region", "node").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = stored(prepare(docs), "signed")
    classes = stored(
        signed.groupBy("set").agg(F.min("_id").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    stretches = stored(regions(forest_rows(classes)), "regions")
    members = stored(binned(stretches), "binned")
    sets = stored(full_sets(docs, members.select("node").distinct()), "sets")
    first = stored(region_links(members.filter(F.col("tree") < FIRST), sets), "links")
    found = stored(components(first), "found")
    later = members.filter(F.col("tree") >= FIRST).join(found, "node", "left")
    open_regions = (
        later.groupBy("region")
        .agg(F.min(F.coalesce("root", "node")).alias("low"), F.max(F.coalesce("root", "node")).alias("high"))
        .filter("low < high")
        .select("region")
    )
    rest = members.filter(F.col("tree") >= FIRST).join(open_regions, "region", "left_semi")
    second = region_links(rest, sets)
    links = second.unionByName(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = stored(components(links), "roots")
    apart = unmet(stretches, roots)
    if not apart.isEmpty():
        last = region_links(block_pairs(apart), sets)
        links = last.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = stored(components(links), "roots")
    places = stored(
        classes.select("set", "node").join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root")),
        "places",
    )
    empty = F.col("n") == 0
    root = F.when(empty, F.col("_id")).otherwise(F.col("root"))
    placed = signed.select("_id", "set", "n").join(places, "set").select("_id", "n", root.alias("root"))
    return placed.select(
        F.nullif("_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("root", F.lit(NO_ID)).alias("component_id"),
        (F.col("_id") == F.col("root")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component."""
    kept = near_duplicates(docs).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept")).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == kept["_kept"], "left_semi")
