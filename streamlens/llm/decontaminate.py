"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, as sequences of word numbers, go into one automaton. A text streams through it and
the automaton keeps the longest stretch of words, ending at the current word, that occurs in any
item. Where that length reaches the window (13 words, or the whole of a shorter item), the last
words of the window are hit, and the state tells in which items they stand. Only stretches
of words that are all known to the automaton are walked.

Items are packed by Spark into blocks of about ``block_words`` words, so what the driver holds and sends to the
executors is bounded however large the benchmark is; each block is one more pass over the rows.

Defined results: a text or item that is null, empty or without words hits nothing and is hit by
nothing. Repeated items count as items of their own; repeated documents are judged one by one.
Items without an id are left out of ``items_sha256`` but hit words. An empty benchmark leaves every document clean; an empty table gives
an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import stored
from streamlens.llm.items import fold_words, item_blocks, numbered_items

WINDOW = 13
BLOCK_WORDS = 100_000
class ItemAutomaton:
    """A generalised suffix automaton over item words, with the items of each state."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, list[int]] = {}
        self.least = window
        whole: list[tuple[int, int]] = []
        for k, words in enumerate(items):
            state = 0
            for word in words:
                state = self._extend(state, self.number.setdefault(word, len(self.number)))
                self.ends.setdefault(state, []).append(k)
            if words and len(words) < window:
                self.least = min(self.least, len(words))
                whole.append((k, len(words)))
        self._gather(items, whole)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, parent: int, letter: int, child: int) -> int:
        """The state of the strings of ``child`` that are just longer than ``parent``'s."""
        clone = self._new(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.step[parent].get(letter) == child:
            self.step[parent][letter] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, letter: int) -> int:
        child = self.step[last].get(letter)
        if child is not None:
            exact = self.length[child] == self.length[last] + 1
            return child if exact else self._split(last, letter, child)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and letter not in self.step[last]:
            self.step[last][letter] = state
            last = self.link[last]
        if last >= 0:
            child = self.step[last][letter]
            exact = self.length[child] == self.length[last] + 1
            self.link[state] = child if exact else self._split(last, letter, child)
        return state

    def _gather(self, items: list[list[bytes]], whole: list[tuple[int, int]]) -> None:
        """Items of the windows and short items that a state's strings end with."""
        where: dict[int, set[int]] = {}
        long = [s for s in range(1, len(self.length)) if self.length[s] >= self.window]
        for state in sorted(long, key=self.length.__getitem__, reverse=True):
            found = where.setdefault(state, set())
            found.update(self.ends.get(state, ()))
            if self.length[self.link[state]] >= self.window:
                where.setdefault(self.link[state], set()).update(found)
        #: For each state the state of its strings' last ``window`` words, if they are as long.
        self.full: dict[int, int] = {}
        for state in sorted(long, key=self.length.__getitem__):
            above = self.link[state]
            self.full[state] = self.full[above] if self.length[above] >= self.window else state
        self.at_window = {s: frozenset(k for k in where[s] if len(items[k]) >= self.window) for s in set(self.full.values())}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, n in whole:
            state = 0
            for word in items[k]:
                state = self.step[state][self.number[word]]
            self.short.setdefault(state, []).append((n, k))
        #: The short items that end where a state's longest string ends.
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.shorts[state] = (*self.shorts[self.link[state]], *self.short.get(state, ()))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of hit words, as merged (start, end), and the items that hit."""
        ids = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start >= self.least:
                self._walk(ids[start:end].tolist(), start, spans, items)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _walk(self, ids: list[int], start: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for at, letter in enumerate(ids, start + 1):
            while state and letter not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(letter, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                spans.append((at - window, at))
                items |= self.at_window[self.full[state]]
            for n, k in self.shorts[state]:
                if n <= matched:
                    spans.append((at - n, at))
                    items.add(k)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id and text of ``docs`` with ``_n_words``, hit ``_spans`` (in words) and the ``_items`` that hit.

    Where there are several blocks of items, what each pass finds is written before the next, so one
    automaton lives at a time.
    """
    context = docs.sparkSession.sparkContext
    found = docs.select(
        "doc_id",
        "text",
        F.lit(0).cast("long").alias("_n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )

    def one_pass(rows: DataFrame, block: list[tuple[str | None, str]]) -> DataFrame:
        sent = context.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # equal items are one to the automaton, and their ids are attached to what it finds
            names: dict[tuple[bytes, ...], list[str]] = {}
            for name, text in sent.value:
                names.setdefault(tuple(fold_words(text)), []).extend([] if name is None else [name])
            own = list(names.values())
            automaton = ItemAutomaton([list(words) for words in names], window)
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    made: dict[str, list] = {"_n_words": [], "_spans": [], "_items": []}
                    old = (batch.column(c) for c in ("text", "_spans", "_items"))
                    for text, spans, items in zip(*old, strict=True):
                        words = fold_words(text.as_py())
                        hit, which = automaton.scan(words)
                        made["_n_words"].append(len(words))
                        made["_spans"].append(spans.as_py() + [{"start": a, "end": b} for a, b in hit])
                        made["_items"].append(items.as_py() + [name for k in which for name in own[k]])
                    columns = [
                        pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in batch.schema
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return rows.mapInArrow(scan, rows.schema)

    numbered = numbered_items(benchmark.select(F.col("item_id").cast("string"), "text"), block_words)
    passes = 0
    for block in item_blocks(stored(numbered, "item-blocks")):
        found = one_pass(stored(found, "overlaps") if passes else found, [(name, text) for _, name, text in block])
        passes += 1
    return found if passes else one_pass(found, [])


def n_hit(spans: Column | str) -> Column:
    """How many words lie in spans, which may overlap where they come from several blocks."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
        ),
    )
    return merged["hit"].cast("long")


def contaminated(hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in ``share`` stands in a benchmark window."""
    return (hit > 0) & (share * hit >= n_words)


def overlap_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, counts of words, hit words and items, a digest of the items, and the verdict."""
    found = find_overlaps(docs, benchmark)
    items = F.array_sort(F.array_distinct("_items"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit("_spans").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_words(text: str, spans: list) -> str:
    """The text without the spans of words; what stands between two words of a span goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        kept.append(raw[at : max(at, places[span["start"]][0])])
        at = max(at, places[span["end"] - 1][1])
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, share: int = 20, min_span: int | None = None
) -> DataFrame:
    """``docs`` without contaminated documents, and without long spans in the others.

    A document goes if at least one word in ``share`` is hit. In the documents that stay, spans of
    at least ``min_span`` hit words are cut out; with None their texts stay as they are.
    """
    # a whole row stands in the place of its id, so no column can clash with what is found
    found = find_overlaps(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), benchmark)
    clean = found.filter(~contaminated(n_hit("_spans"), F.col("_n_words"), share))
    if min_span is None:
        return clean.select("doc_id.*")

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, own) if len(own) else t for t, own in zip(text, spans, strict=True)])

    long = F.filter("_spans", lambda s: s["end"] - s["start"] >= min_span)
    shorter = F.pandas_udf(cut, "string")(F.col("text"), long)
    return clean.select("doc_id", shorter.alias("text")).select(
        *[F.col("text") if c == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns]
    )
