"""Ranked lexical search: integer impacts multiplied as dense blocks, exactly.

Items are queries against all documents. A block of items has a compact vocabulary, numbered from 0.
One pass over the documents cuts each whole text down to its terms of that vocabulary with their
counts; this is written, and N, L and the document frequencies are aggregated from it. A second
pass multiplies tiles of item weights (items by terms) with tiles of document impacts (terms by
documents) in float64 by BLAS. Weights and impacts are integers, and tiles are cut so that
no partial sum of a tile reaches 2^53: every product and sum is exact, whatever the order, and
tiles are added as 64-bit integers. A task holds the best ``k`` of each item; a tile brings in
what is at least as good as the item's last place, so ties are settled by doc_id alone. The best
of all tasks meet in windows by item, first salted by document.

A block has at most ``BLOCK`` words, with 32 added for each item, so what is broadcast and the
dense tiles are bounded however large the benchmark is; each block is one more pass.

Defined results: terms are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.
A null or empty text, or one without terms, is not ranked, and such an item ranks nothing. Each row
of the items is an item of its own and each row of the documents a document of its own; a document
without an id comes before the others at equal scores. Empty tables give an empty table. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.llm.common import NO_ID, stored
from streamlens.llm.items import FOLD, fold_words, item_blocks, numbered_items
from streamlens.llm.shingles import text_slices

BEST = 20
#: Words of a block of items, where an item counts 32 more; terms of a tile; cells of a tile of scores.
BLOCK, TILE, SCORES = 32_768, 1024, 1 << 18
#: No impact reaches this, and no partial sum that.
IMPACT, EXACT = 1_000_000, 2**53
SALTS = 16


def known_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document with terms: how many it has, and which of the vocabulary how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(sent.value)}
        width = max(1, len(number))
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                words = [t.translate(FOLD).split() for t in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                known = map(number.get, chain.from_iterable(words), repeat(-1))
                found = np.fromiter(known, np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(words)), sizes)[found >= 0]
                pairs, counts = np.unique(owner * width + found[found >= 0], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(len(words) + 1) * width)
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(at, len(words)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs % width, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                    ],
                    names=["_id", "n", "terms", "tfs"],
                )
                at += len(words)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
    return rows.mapInArrow(cut, "_id long, n long, terms array<int>, tfs array<int>").filter("n > 0")


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What an occurrence of each term counts in documents of ``n`` terms."""
    if len(n) and 25 * int(n.max()) * total >= 2**63:
        n = n.astype(object)
    long = (25 * n * total // max(1, length) + 75).astype(np.int64)
    return 10**9 * tf // (1000 * tf + 12 * long)


class ItemTiles:
    """The weights of a block of items as dense tiles (first term, items by terms).

    A tile is at most ``width`` terms wide, and for each item its weights times the largest impact
    stay below ``limit``; a weight that does not fit alone is dealt to several tiles.
    """

    def __init__(self, items: list[Counter], weights: np.ndarray, width: int = TILE, limit: int = EXACT):
        self.n = len(items)
        self.tiles: list[tuple[int, np.ndarray]] = []
        most = (limit - 1) // IMPACT
        for low in range(0, len(weights), width):
            left = np.zeros((self.n, min(width, len(weights) - low)), np.int64)
            for row, item in zip(left, items, strict=True):
                for term, often in item.items():
                    if low <= term < low + len(row):
                        row[term - low] = often * int(weights[term])
            while left.any():
                # as much of each row as fits, from its first term on
                before = np.cumsum(left, 1) - left
                taken = np.clip(most - before, 0, left)
                self.tiles.append((low, taken.astype(np.float64)))
                left = left - taken

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items by documents; the terms come sorted."""
        out = np.zeros((self.n, n_docs), np.int64)
        at, dense = -1, np.empty((0, 0))
        for low, tile in self.tiles:
            if low != at:
                a, b = np.searchsorted(term, (low, low + tile.shape[1]))
                dense = np.zeros((tile.shape[1], n_docs))
                dense[term[a:b] - low, doc[a:b]] = impact[a:b]
                at = low
            out += (tile @ dense).astype(np.int64)
        return out


class Best:
    """The ``k`` best documents of each item so far, by score and then doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[item[len(self.item) :], column]))
        doc = np.concatenate((self.doc, ids[column]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        kept = place < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def block_best(docs: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """The best documents of each item, by task: row of the item, _id, score."""
    words = [Counter(fold_words(text)) for _, text in items]
    vocabulary = sorted(set().union(*words))
    number = {term: t for t, term in enumerate(vocabulary)}
    terms = stored(known_terms(docs, vocabulary), "terms")
    total, length = terms.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(terms.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = [weight(total, held.get(t, 0)) for t in range(len(vocabulary))]
    numbers = [{number[w]: often for w, often in item.items()} for item in words]
    sent = docs.sparkSession.sparkContext.broadcast(([row for row, _ in items], numbers, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, weights = sent.value
        tiles = ItemTiles(own, np.array(weights, np.int64))
        best = Best(len(rows), k)
        width = max(64, SCORES // len(rows))
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                sizes = np.diff(batch.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                term = batch.column("terms").flatten().to_numpy().astype(np.int64)
                tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
                impact = impacts(tf, batch.column("n").to_numpy()[doc], total, length)
                order = np.argsort(term, kind="stable")
                scores = tiles.scores(doc[order], term[order], impact[order], batch.num_rows)
                best.add(scores, batch.column("_id").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(rows, np.int64)[best.item]), pa.array(best.doc), pa.array(best.score)],
            names=["row", "_id", "score"],
        )

    return terms.filter("size(terms) > 0").mapInArrow(rank, "row long, _id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_words: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0."""
    numbered = stored(numbered_items(items, block_words), "blocks")
    found = None
    for block in item_blocks(numbered):
        part = stored(block_best(docs, [(row, text) for row, _, text in block], k), "best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], "row long, _id long, score long")
    order = [F.desc("score"), F.asc("_id")]
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("salt")
    first = F.row_number().over(Window.partitionBy("row", "salt").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    few = found.select("*", salt).withColumn("rank", first).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", last).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("row", "item_id"), "row").select(
        "item_id", "rank", F.nullif("_id", F.lit(NO_ID)).alias("doc_id"), "score"
    )
