"""Token ids of texts: encoding with a public tokenizer, and a Parquet format for the ids.

``Encoder`` encodes whole texts with the tokenizers library. Byte-level BPE never joins a
character with white space after it, nor a letter with a mark after it, so texts are cut there
into units by array operations on their bytes, the units are dictionary-encoded by Arrow, and only
distinct units that a worker does not know yet go to the tokenizer; ids are gathered from one array.

``write_tokens`` writes documents in ascending doc_id order as Parquet with a list column of
ids: dictionary encoding (or delta encoding, without a dictionary), row groups of a given size,
pages of a given number of rows with page indexes; each file holds one range of doc_ids, and
each row its place in the file. ``read_tokens``
reads chosen columns and doc_ids; the filter goes to the page indexes. The start of a
document is its place in its file plus the sizes of the files before, which are one
number per file.

Defined results: a null or empty text has no ids but the end id. Rows that share a doc_id
are kept as rows, ordered by text. Null doc_ids come first. An empty table gives an empty
table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress, repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Distinct units that a worker remembers, twice, before it forgets those it has not met again.
REMEMBERED = 300_000
#: Bytes of text that are cut and looked up at a time.
CHUNK = 2 << 20
_SPACE, _LETTER, _MARK = (np.isin(np.arange(256), list(c)) for c in (b" \t\n\x0b\x0c\r", ascii_letters.encode(), b".,;:!?"))
#: The last bytes of white space outside ASCII, and what stands before them.
_WIDE_SPACE = {
    (0xC2,): b"\x85\xa0",
    (0xE1, 0x9A): b"\x80",
    (0xE2, 0x80): bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]),
    (0xE2, 0x81): b"\x9f",
    (0xE3, 0x80): b"\x80",
}
#: A place where any text may be cut.
_SAFE = re.compile(rb"(?<=[!-~])(?=[ \n])")


def unit_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the units of texts begin, which follow each other in ``data``.

    A unit begins with each text, before white space that follows something else, and before a mark that
    follows an ASCII letter: no pre-token goes on there.
    """
    space = _SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    odd = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    for before, last in _WIDE_SPACE.items():
        here = odd[np.isin(data[odd - 1], list(last)) & (odd > len(before))]
        for back, byte in enumerate(reversed(before), 2):
            here = here[data[here - back] == byte]
        cut[here] = False
    cut[text_starts] = True
    return np.flatnonzero(cut)


class _Known:
    """Ids of units, one unit after the other in one array."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.starts = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def add(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        low = int(self.starts[n])
        while low + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while n + len(units) >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[low : low + len(ids)] = ids
        self.starts[n + 1 : n + len(units) + 1] = low + np.cumsum(sizes)
        self.number.update(zip(units, range(n, n + len(units)), strict=True))

    def find(self, units: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and how many each has."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """Texts to ids. Special tokens in texts are what the tokenizer file makes of them, or ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Whether an added token may lie across two units, so that texts are not cut.
        self.uncut = any(re.search(r"[\s.,;:!?]", t.content) or t.lstrip or t.rstrip for t in added)
        #: What was met lately, and what was met before.
        self.known, self.before = _Known(), _Known()
        vocabulary = self.tokenizer.get_vocab(True)
        #: Bytes of each id; a byte-level vocabulary has one character for each byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        made = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [e.ids for e in made]

    def _learn(self, units: list[bytes]) -> None:
        """Encode new units: all that begin with white space and end without it in one text."""
        chained = [u[0] in b" \n" and (32 < u[-1] < 127 or u[-1] > 127 and not u.decode("utf-8")[-1].isspace()) for u in units]
        own = list(compress(units, chained))
        if own:
            ids = np.array(self._encode([b"".join(own)])[0], "<u4")
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends, "right")
            self.known.add(own, ids, np.diff(cuts, prepend=0))
        alone = [u for u, c in zip(units, chained, strict=True) if not c]
        if alone:
            parts = self._encode(alone)
            self.known.add(alone, np.concatenate([np.array(p, "<u4") for p in parts]), np.array([len(p) for p in parts]))

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """The places of units among those known, learnt where they are new."""
        if len(self.known.number) > REMEMBERED:
            self.before, self.known = self.known, _Known()
        found = self.known.find(units)
        new = np.flatnonzero(found < 0)
        if len(new):
            asked = [units[k] for k in new.tolist()]
            old = self.before.find(asked)
            again = np.flatnonzero(old >= 0)
            if len(again):
                self.known.add([asked[k] for k in again.tolist()], *self.before.gather(old[again]))
            self._learn([asked[k] for k in np.flatnonzero(old < 0).tolist()])
            found[new] = self.known.find(asked)
        return found

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        if not joined:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        starts = bounds[:-1][sizes > 0]
        if not self.uncut:
            starts = unit_starts(np.frombuffer(joined, np.uint8), starts)
        offsets = np.append(starts, len(joined))
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
        ).dictionary_encode()
        numbers = self._numbers(units.dictionary.to_pylist())[units.indices.to_numpy()]
        ids, each = self.known.gather(numbers)
        before = np.concatenate(([0], np.cumsum(each)))[np.searchsorted(starts, bounds)]
        return ids, np.diff(before)

    def flat(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and where each text begins."""
        owner, held, size, n = [], [], 0, 0
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n, text in enumerate(texts, 1):
            raw = (text or "").encode("utf-8", "surrogatepass")
            while len(raw) > CHUNK and not self.uncut:
                safe = _SAFE.search(raw, CHUNK)
                if safe is None:
                    break
                done.append(self._chunk([*held, raw[: safe.start()]]))
                owner.append(n - 1)
                raw, held, size = raw[safe.start() :], [], 0
            held.append(raw)
            owner.append(n - 1)
            size += len(raw)
            if size > CHUNK:
                done.append(self._chunk(held))
                held, size = [], 0
        done.append(self._chunk(held))
        ids = np.concatenate([d[0] for d in done])
        counts = np.bincount(owner, np.concatenate([d[1] for d in done]), n).astype(np.int64)
        ends = np.cumsum(counts)
        return np.insert(ids, ends, np.uint32(end)), np.concatenate(([0], ends + np.arange(1, n + 1)))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text, with the end id, as little-endian unsigned 32-bit bytes."""
        ids, at = self.flat(texts, end)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder_of(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process, with what it has learnt in earlier tasks.

    Functions sent by value bring new globals with every task, so it is kept on the library's module.
    """
    import tokenizers

    made = tokenizers.__dict__.setdefault("_streamlens_encoders", {})
    key = (path, special_as_text)
    if key not in made:
        made[key] = Encoder(path, special_as_text)
    return made[key]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """An Arrow list of ids for each two neighbours in ``at``."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))


def slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK`` bytes of text or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right"))
        to = min(max(at + 1, most), at + rows)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the machine.

    Arrow and the C library keep it for later, and a worker that has nothing to do goes on holding it beside the next
    stage of its executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of all batches. What was freed meanwhile is given back after each batch."""
    for whole in batches:
        yield from slices(whole)
        give_back()


TOKEN_SCHEMA = "doc_id long, file int, place long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end: int = 0,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1000,
    special_as_text: bool = False,
) -> None:
    """Write doc_id, file, place in the file, n_tokens and ids in ascending doc_id order."""
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, place = encoder_of(vocabulary, special_as_text), TaskContext.get().partitionId(), 0
        for batch in parts(batches):
            ids, at = encoder.flat(batch.column("text").to_pylist(), end)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, file, np.int32)),
                    pa.array(place + at[:-1]),
                    pa.array(np.diff(at)),
                    id_lists(ids, at),
                ],
                names=["doc_id", "file", "place", "n_tokens", "ids"],
            )
            place += len(ids)

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    delta = encoding == "delta"
    (
        ordered.mapInArrow(encode, TOKEN_SCHEMA)
        .write.option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 4 << 20)
        .option("compression", "snappy")
        .parquet(path)
    )


def read_tokens(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("doc_id", "file", "place", "n_tokens", "ids"),
    where: Column | None = None,
) -> DataFrame:
    """Chosen columns of chosen documents; metadata alone is read without the ids."""
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    return (rows if where is None else rows.filter(where)).select(*columns)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """For each file the number of ids in all files before it: one row per file."""
    sizes = read_tokens(spark, path, ("file", "n_tokens")).groupBy("file").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))


def crc_of_lists(lists: pa.ListArray) -> pa.Array:
    """The unsigned CRC-32 of each list of ids as little-endian unsigned 32-bit integers."""
    values = np.asarray(lists.values, dtype="<i4")
    at = np.asarray(lists.offsets)
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())


def with_crc(tokens: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``tokens`` with ``ids_crc32`` in the place of ``ids``, or beside them."""
    schema = [f"`{c}` {kind}" for c, kind in tokens.dtypes if keep_ids or c != "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if keep_ids or c != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), crc_of_lists(batch.column("ids"))],
                names=[*rest, "ids_crc32"],
            )

    return tokens.mapInArrow(digest, ", ".join([*schema, "ids_crc32 long"]))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    return (
        with_crc(read_tokens(spark, path))
        .join(file_starts(spark, path), "file")
        .select("doc_id", (F.col("place") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
    )
