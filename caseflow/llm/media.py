"""Media columns: payloads in archives, read through a Spark data source that plans byte ranges.

An archive is a plain concatenation of members, each a header (magic, sizes, CRC, JSON key) and the deflated media
file, here a WAV file of unsigned 8-bit mono samples. A directory of archives is written by a data source writer:
each task attempt makes its own file, and only files whose tasks were committed are listed in the manifest, so a
retried or speculative attempt leaves nothing behind that is read. The reader plans byte ranges over the listed
files from their sizes alone; a range owns the members whose header starts in it, and finds the first by the sync
marks that stand in front of headers. Members stream through Arrow in batches of bounded bytes. A member that can't
be read or whose CRC is wrong is read again by its own offset, on a fresh handle, without repeating the others; if
all tries fail its row has a null payload and the reason.

Locations are local or mounted paths ("file:" or none) or what pyarrow.fs opens by URI.

Defined results: a null payload is the empty payload; repeated rows are members of their own; an empty table makes
an empty archive directory and an empty result; a payload larger than a batch is a batch of its own.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Sync mark in front of every header. It may also occur inside a payload: what follows must be a header with a right CRC.
SYNC = b"\x00MBR\xf1\x9d\x0a\xc4"
#: key bytes, media bytes, stored (deflated) bytes, CRC of the media, CRC of this header and key.
HEADER = struct.Struct("<IQQII")
RANGE_BYTES = 16 << 20
#: Byte ranges of one read at most: of larger archives the ranges grow, so that the driver's plan stays small.
MOST_RANGES = 100_000
BATCH_BYTES = 4 << 20
TRIES = 3
BLOCK = 64
RATE = 8000


# --- media files: 8-bit PCM -----------------------------------------------------------------------------------


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    if len(samples) > 0xFFFFFFFF - 36:
        raise ValueError("a WAV file holds less than 4 GB")
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    """Samples of a WAV file of unsigned 8-bit mono samples, whatever other chunks it has."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22)
        elif kind == b"data":
            if form != (1, 1, 8):
                raise ValueError(f"expected 8-bit mono PCM, found {form}")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Bytes 0 up to a positive multiple of the block."""
    return payload + bytes(-len(payload) % block if payload else block)


def feature(samples: bytes) -> str:
    """Mean, RMS around the midpoint, zero crossings and a 4-band level profile of 8-bit samples, from exact integer sums."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    if not n:
        return "n=0"
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = "/".join(str(int(part.sum()) // max(1, len(part))) for part in np.array_split(np.abs(x), 4))
    return f"mean={int(x.sum()) / n:.4f};rms={(int((x * x).sum()) / n) ** 0.5:.4f};crossings={crossings};bands={bands}"


# --- files ----------------------------------------------------------------------------------------------------


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def _member(key: str, media: bytes) -> bytes:
    name, stored = key.encode("utf-8"), zlib.compress(media, 1)
    head = HEADER.pack(len(name), len(media), len(stored), zlib.crc32(media), 0)
    crc = zlib.crc32(head[:-4] + name)
    return SYNC + head[:-4] + struct.pack("<I", crc) + name + stored


def _header(f: BinaryIO, at: int) -> tuple[str, int, int, int, int] | None:
    """(key, media bytes, stored bytes, CRC, offset of what is stored) if a member starts here."""
    f.seek(at)
    raw = f.read(len(SYNC) + HEADER.size)
    if len(raw) < len(SYNC) + HEADER.size or not raw.startswith(SYNC):
        return None
    n_key, n_media, n_stored, crc, own = HEADER.unpack_from(raw, len(SYNC))
    if n_key > 1 << 20:
        return None
    name = f.read(n_key)
    if zlib.crc32(raw[len(SYNC) : -4] + name) != own:
        return None
    return name.decode("utf-8"), n_media, n_stored, crc, at + len(raw) + n_key


def _first_member(f: BinaryIO, at: int, end: int) -> int:
    """Offset of the first member that starts in [at, end), else end."""
    block = 1 << 16
    while at < end:
        f.seek(at)
        raw = f.read(block + len(SYNC) - 1)
        i = raw.find(SYNC)
        while i >= 0 and at + i < end:
            if _header(f, at + i):
                return at + i
            i = raw.find(SYNC, i + 1)
        at += block
    return end


class Span(InputPartition):
    """Byte range of an archive."""

    def __init__(self, path: str, start: int, end: int, size: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        files, root = _resolve(self.path)
        with files.open_input_stream(f"{root}/_manifest.json") as f:
            listed = json.loads(f.read())
        step = max(self.range_bytes, -(-sum(size for _, size in listed) // MOST_RANGES))
        spans: list[InputPartition] = []
        for name, size in listed:
            spans += [Span(f"{self.path}/{name}", a, min(a + step, size), size) for a in range(0, size, step)]
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.end <= span.start:
            return
        files, path = _resolve(span.path)
        rows, held = [], 0
        f = files.open_input_file(path)
        try:
            def retried(read, good):
                """What read(file) gives once it is good, each time from a newly opened file; the last try's otherwise."""
                nonlocal f
                for left in range(self.tries - 1, -1, -1):
                    try:
                        got = read(f)
                    except OSError:
                        if not left:
                            raise
                        got = None
                    if left == 0 or (got is not None and good(got)):
                        return got
                    f.close()
                    f = files.open_input_file(path)

            found = lambda x: x >= 0
            at = 0 if span.start == 0 else retried(lambda f: _first_member(f, span.start, span.end), found)
            while at < span.end:
                head = retried(lambda f, at=at: _header(f, at), bool)
                if head is None:  # damaged header: go on with the next member
                    rows.append((None, None, span.path, at, "header"))
                    at = retried(lambda f, at=at: _first_member(f, at + 1, span.end), found)
                    continue
                key, n_media, n_stored, crc, data_at = head
                media, why = retried(lambda f, own=(data_at, n_media, n_stored, crc): self._load(f, *own), lambda x: x[0] is not None)
                rows.append((key, media, span.path, at, why))
                held += n_media
                at = data_at + n_stored
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        finally:
            f.close()

    @staticmethod
    def _load(f: BinaryIO, at: int, n_media: int, n_stored: int, crc: int) -> tuple[bytes | None, str | None]:
        try:
            f.seek(at)
            media = zlib.decompress(f.read(n_stored))
            if len(media) != n_media or zlib.crc32(media) != crc:
                return None, "checksum"
            return media, None
        except (OSError, zlib.error) as e:
            return None, f"{type(e).__name__}"


SCHEMA = "key string, media binary, archive string, at long, error string"
_ARROW = pa.schema([("key", pa.string()), ("media", pa.binary()), ("archive", pa.string()), ("at", pa.int64()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Part(WriterCommitMessage):
    def __init__(self, name: str, size: int):
        self.name, self.size = name, size


class _Writer(DataSourceArrowWriter):
    """Takes (key string, payload binary) rows; every payload becomes a media file."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _resolve(self.path)
        files.create_dir(root, recursive=True)
        name, size = f"part-{uuid.uuid4().hex}.mbr", 0
        with files.open_output_stream(f"{root}/{name}") as f:
            for batch in iterator:
                for key, payload in zip(batch.column("key"), batch.column("payload"), strict=True):
                    raw = _member(key.as_py() or "", wav(pad(payload.as_py() or b"")))
                    f.write(raw)
                    size += len(raw)
        return _Part(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _resolve(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps(sorted([m.name, m.size] for m in messages if m)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _resolve(self.path)
        for m in messages:
            if m:
                try:
                    files.delete_file(f"{root}/{m.name}")
                except OSError:
                    pass


class MediaArchive(DataSource):
    """`spark.read.format("media_archive").load(dir)`; options rangeBytes and tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_archives(df: DataFrame, path: str, key: str, payload: str) -> None:
    """Stores each row's payload (binary, null is empty) under its key (string) in a new archive directory."""
    df.sparkSession.dataSource.register(MediaArchive)
    df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).write.format("media_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, tries: int = TRIES) -> DataFrame:
    """(key, media, archive, at, error) of all members."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).option("tries", tries).load(path)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text to archives at `path` and returns what is read back: one row per document.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    """
    import hashlib

    kind = docs.schema[id_col].dataType
    key = F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n")))
    write_archives(docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("payload")), path, "key", "payload")
    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, media, error in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
                if media is None:
                    raise OSError(f"member {key} can't be read: {error}")
                own, samples = json.loads(key), wav_samples(media)
                out.append((own.get("id"), own["n"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    back = read_archives(docs.sparkSession, path).mapInArrow(run, schema)
    return back.select(F.col("id").cast(kind).alias(id_col), *back.columns[1:])
