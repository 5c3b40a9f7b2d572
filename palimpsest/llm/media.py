"""Operator 9, media columns: content-addressed payloads in tar shards.

A payload (bytes) is stored as a PNG image of 8-bit grey samples, WIDTH to a row, losslessly. Each task writes one tar shard
into the shared folder; a member's name is its digest, and a digest is stored once a shard. Rows carry the digest, the shard,
the offset and the length, so any reader fetches a payload by one range read. The metadata columns (width, height, depth) come from
range reads of the first HEADER bytes alone; digests and features of the payloads need a second, whole read. Index rows are dealt by
place before they are read back. Shards are reached through pyarrow's file systems, by URI (file, hdfs, s3, gs).

A shard's name is new with each attempt of a task, and the index of rows is itself a written table: a task that runs again
leaves an orphan shard behind that no row names, never a broken row. `orphans` lists them.

Defined cases: a null text is empty; payloads are padded with blanks to a positive multiple of WIDTH, so none is empty; equal
texts have equal values but for their places; a very long text is one payload, held whole by one task; a null id stays null; repeated rows share one member; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import scratch, ship_package, stored

WIDTH = 192
#: Signature and IHDR chunk of a PNG file.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER_COLUMNS = "width int, height int, depth int"
#: Stored bytes that a task reads back; less than LEAST_BYTES are not worth one.
READ_BYTES, LEAST_BYTES = 1 << 26, 1 << 20
_INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def pad(raw: bytes) -> bytes:
    """Blanks up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png(payload: bytes, level: int = 1) -> bytes:
    """A grey image whose samples are the payload. Its header lies at fixed places."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG image, or damaged")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def png_payload(media: bytes) -> bytes:
    """The samples of an image made by png()."""
    width, height, _ = png_header(media[:HEADER])
    at, data = HEADER, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """A tar file that holds each digest once. Offsets are those of the members' bytes."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.tar"
        fs, path = _open(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, buffer_size=1 << 20)
        self.at = 0
        self.held: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.out.write(media)
            self.out.write(b"\0" * (-len(media) % 512))
            self.held[digest] = (self.at + 512, len(media))
            self.at += 512 + -(-len(media) // 512) * 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts of docs(doc_id, text) to tar shards: the index rows, one for each document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: ShardWriter | None = None
        for b in batches:
            rows = []
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = shard or ShardWriter(folder)
                media = png(pad(raw))
                digest = hashlib.sha256(media).hexdigest()
                rows.append((d, len(raw), digest, shard.uri, *shard.add(digest, media)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).mapInArrow(run, _INDEX)


def _read(batches: Iterator[pa.RecordBatch], least: int | None, make: Callable[..., tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """For each index row the values that make() has for its member, read once a batch. least: only so many bytes of it. make() gets the
    bytes, and what columns there are beyond the index's own."""
    open_at: tuple[str, pafs.FileSystem | None] = ("", None)
    source = None
    for b in batches:
        shards, offsets, lengths = (b.column(i).to_pylist() for i in (3, 4, 5))
        more = list(zip(*(c.to_pylist() for c in b.columns[6:]), strict=True)) or [()] * b.num_rows
        held: dict[tuple[str, int], tuple] = {}
        for key, length, known in sorted({((s, o), n, m) for s, o, n, m in zip(shards, offsets, lengths, more, strict=True)}):
            if key[0] != open_at[0]:
                if source:
                    source.close()
                fs, path = _open(key[0])
                source, open_at = fs.open_input_file(path), (key[0], fs)
            held[key] = make(source.read_at(min(length, least or length), key[1]), *known)
        rows = [held[k] for k in zip(shards, offsets, strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*b.schema.names, *names])
    if source:
        source.close()


def metadata(index: DataFrame) -> DataFrame:
    """Index rows with width, height and depth, by range reads of the headers alone."""
    ship_package(index.sparkSession)
    names, kinds = ["width", "height", "depth"], [pa.int32()] * 3
    return index.mapInArrow(lambda bs: _read(bs, HEADER, png_header, names, kinds), f"{_INDEX}, {_HEADER_COLUMNS}")


def features(described: DataFrame) -> DataFrame:
    """Rows of metadata() with digests and features of the payloads, read back whole from the shards."""
    ship_package(described.sparkSession)

    def make(media: bytes, width: int, height: int, depth: int) -> tuple:
        payload = png_payload(media)
        x = np.frombuffer(payload, np.uint8)
        text = f"png;{width}x{height}x{depth};sum={int(x.sum(dtype=np.int64))};min={int(x.min())};max={int(x.max())};distinct={int(np.count_nonzero(np.bincount(x, minlength=256)))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), text

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"{_INDEX}, {_HEADER_COLUMNS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return described.mapInArrow(lambda bs: _read(bs, None, make, names, kinds), schema)


def by_place(index: DataFrame, most: int = READ_BYTES) -> DataFrame:
    """Index rows dealt by their members' places, so that a task reads a run of one shard or of few, of about `most` bytes."""
    rows, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    spread = min(2 * index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))
    tasks = max(1, min(rows, max(spread, -(-size // most))))
    return index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def orphans(index: DataFrame, folder: str) -> list[str]:
    """Shards in the folder that no index row names: what attempts that did not count have left."""
    fs, path = _open(folder)
    there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))}
    return sorted(there - {r[0].rpartition("/")[2] for r in index.select("shard").distinct().collect()})  # a row a shard


def media_columns(docs: DataFrame) -> DataFrame:
    """Store all texts, read them back: doc_id, n_bytes, the payload's and the stored form's digests, a feature, the payload's place
    (digest, shard, offset, length), and width, height and depth from the header."""
    index = stored(store(docs, scratch(docs.sparkSession, "shards")), "media-index")
    return features(metadata(by_place(index))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "depth"
    )


def read_member(uri: str, offset: int, length: int) -> bytes:
    """One payload by its row's place."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        return png_payload(f.read_at(length, offset))
