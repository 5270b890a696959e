"""WARC archives in Zstandard frames, written and read by Spark tasks.

Each archive begins with a skippable frame that holds the archive's dictionary, followed by one
frame for each record. ``write_warc`` marks the records whose payload another record repeats as
revisits of it, writes a task's rows into archives of a bounded size and returns a manifest of
the archives of tasks that succeeded; a task that is run again writes archives of other names.
``read_warc`` streams the archives of a manifest, decodes frame by frame, and checks of each
record the version line, the headers, both lengths, the closing lines and the digest.

Which record a payload's revisits refer to is found on digests alone, pre-aggregated per digest
and salt, so that a payload which a third of all rows share is not one task's.

Defined results: a null html is an empty payload. A null url gives no target. Rows with a null
page_id are records with an empty id and come below all others. Repeated rows of the largest
page_id are all responses. An empty table gives no archives. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.llm.common import NO_ID, stored

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 1000
SALTS = 64
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives; each reads its archives one after the other.
MOST_READERS = 10_000
#: Records that a dictionary is made from, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 100, 8192, 16 << 10
RECORD_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT, salts: int = SALTS) -> DataFrame:
    """page_id, url, payload, digest, and the page whose record holds the same payload, if another."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumns(
        {
            "_id": F.coalesce("page_id", F.lit(NO_ID)),
            "payload_digest": F.sha1("payload"),
            "_salt": F.pmod(F.xxhash64("page_id"), F.lit(salts)),
        }
    )
    parts = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_digest", "_salt")
        .agg(F.max("_id").alias("_max"), F.count("*").alias("_n"))
    )
    same = Window.partitionBy("payload_digest")
    tops = (
        parts.withColumns({"_top": F.max("_max").over(same), "_all": F.sum("_n").over(same)})
        .filter("_all > 1")
        .select("payload_digest", "_salt", "_top")
    )
    revisit = F.when(F.col("_top") != F.col("_id"), F.col("_top"))
    return rows.join(tops, ["payload_digest", "_salt"], "left").select(
        "page_id", "url", "payload", "payload_digest", revisit.alias("refers_to")
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None or page_id == NO_ID else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: headers, the HTTP response, and two empty lines."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    heads = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    heads.append("WARC-Date: 2000-01-01T00:00:00Z")
    if url is not None:
        heads.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%20" for c in url))
    heads.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        heads += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    heads += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return VERSION + "\r\n".join(heads).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, digest, type and refers_to of a record; checks it."""

    def expect(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"WARC record: {what}")

    def number(urn: str) -> int | None:
        value = urn.removeprefix("<urn:x-page:").removesuffix(">")
        return int(value) if value else None

    expect(raw.startswith(VERSION), "no version line")
    head, gap, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    expect(bool(gap), "headers without an end")
    heads = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        expect(name in heads, f"no {name}")
    size = int(heads["Content-Length"])
    expect(len(rest) == size + 4 and rest[size:] == b"\r\n\r\n", "a length that is not Content-Length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    expect(bool(gap), "no HTTP headers")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = heads["WARC-Type"]
    expect(kind in ("response", "revisit"), f"unknown type {kind}")
    expect((kind == "revisit") == ("WARC-Refers-To" in heads), "revisit and WARC-Refers-To do not agree")
    if kind == "response":
        expect(len(payload) == length, "a payload of another length")
        expect(hashlib.sha1(payload).hexdigest() == digest, "a payload of another digest")
    refers = number(heads["WARC-Refers-To"]) if kind == "revisit" else None
    if kind == "revisit" and refers is None:
        refers = NO_ID
    page = number(heads["WARC-Record-ID"])
    return page, heads.get("WARC-Target-URI"), payload if kind == "response" else None, length, digest, kind, refers


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _dictionary(records: list[bytes]):
    import zstandard

    samples = [r[:SAMPLE_BYTES] for r in records]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # samples too alike to train on; the archive goes without
        return None


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write archives under ``path``; returns the manifest: file, n_records, n_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, base = _opened(path)
        system.create_dir(base, recursive=True)
        task = f"{TaskContext.get().partitionId():06}-{uuid.uuid4().hex[:12]}"
        files: list[tuple[str, int, int]] = []
        out, compressor, n_records, n_bytes, waiting = None, None, 0, 0, []

        def begin() -> None:
            nonlocal out, compressor, n_records, n_bytes
            name = f"{task}-{len(files):04}.warc.zst"
            files.append((name, 0, 0))
            out = system.open_output_stream(f"{base}/{name}")
            trained = _dictionary(waiting)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
            n_records = n_bytes = 0
            if trained is not None:
                content = trained.as_bytes()
                n_bytes = out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)

        def put(records: list[bytes]) -> None:
            nonlocal n_records, n_bytes
            for record in records:
                n_bytes += out.write(compressor.compress(record))
                n_records += 1

        def close() -> None:
            nonlocal out
            out.close()
            files[-1] = (files[-1][0], n_records, n_bytes)
            out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for values in zip(*columns, strict=True):
                record = record_bytes(*(v.as_py() for v in values))
                if out is not None:
                    put([record])
                    if n_bytes >= archive_bytes:
                        close()
                    continue
                waiting.append(record)
                if len(waiting) == SAMPLE_RECORDS:
                    begin()
                    put(waiting)
                    waiting.clear()
        if waiting:
            begin()
            put(waiting)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*files) if files else ([], [], []), (pa.string(), pa.int64(), pa.int64()))],
            names=["file", "n_records", "n_bytes"],
        )

    made = mark_revisits(pages).mapInArrow(write, "file string, n_records long, n_bytes long")
    return stored(made, "warc-manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded content of each frame, with the dictionary of the leading skippable frame."""
    import zstandard

    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise ValueError("WARC archive: a dictionary frame without its end")
        if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be a frame itself
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
        dictionary, data = zstandard.ZstdCompressionDict(content), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(chunk)):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(chunk)):
                raise ValueError("WARC archive: a frame without its end")
        yield b"".join(parts)


def read_warc(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives that a manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(path)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            listed = zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True)
            for name, expected in listed:
                rows, held, seen = [], 0, 0
                with system.open_input_stream(f"{base}/{name}") as stream:
                    for raw in frames(stream):
                        row = parse_record(raw)
                        rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        seen, held = seen + 1, held + len(raw) * payloads
                        if len(rows) == 1000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"WARC archive: {name} has {seen} records, its manifest {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    # so many tasks by number: by size, a manifest is one task's
    tasks = max(1, min(manifest.count(), MOST_READERS))
    return manifest.repartition(tasks, "file").mapInArrow(read, RECORD_SCHEMA)
