"""Operator 6, token-ID output: a binary file format coded by a static range asymmetric numeral system.

One file image holds the ids of consecutive documents (about FILE_IDS of them). Its layout, all little-endian:

    magic 8 | bits u32 | lanes u32 | block u32 | n_ids u64 | n_docs u32 | n_symbols u32 | n_blocks u32 | index bytes u32
    index (zlib): symbols u32[] | frequencies u32[] | doc ids i64[] (a null as -2**63) | tokens of each document u32[]
                  | for each block: first word u64, crc32 of its words u32, crc32 of its ids u32, lane states u64[lanes]
    words u32[]
    crc32 of all before u32

The frequency table is shared by all blocks of a file; a block is a checkpoint of its own: LANES interleaved coders start from
the states in the index, so blocks decode independently and in parallel (numpy decodes all lanes of all blocks at once).
A wrong checksum raises ValueError. Images are stored as binary cells of a Parquet table in the shared folder, so that they
can live in any store that Spark reads and a lost executor's file is made anew.

Defined cases: a null or empty text is its end id alone; a null id sorts first; rows that share an id stand in order of their
text; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import ship_package, stored

from .common import in_slices, kept_by_worker

MAGIC = b"PALRANS1"
LANES, BLOCK, FILE_IDS = 64, 1 << 16, 1 << 21
LOW = np.uint64(1 << 31)
_HEAD = np.dtype([("magic", "S8"), ("bits", "<u4"), ("lanes", "<u4"), ("block", "<u4"), ("n_ids", "<u8"), ("n_docs", "<u4"), ("n_symbols", "<u4"), ("n_blocks", "<u4"), ("index", "<u4")])
_NO_ID = -(1 << 63)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to 2**bits, none below 1."""
    total = 1 << bits
    f = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - total
    if over < 0:
        f[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        take = min(over, int(f[i]) - 1)
        f[i] -= take
        over -= take
    return f.astype(np.uint64)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file image of ids (uint32), of documents with these ids and token counts."""
    n_blocks = max(1, -(-len(ids) // BLOCK))
    padded = np.zeros(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[0]
    counts = np.bincount(padded)
    symbols = np.flatnonzero(counts).astype(np.uint32)
    place = np.zeros(len(counts), np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    at, counts = place[padded], counts[symbols]
    bits = max(12, int(len(symbols) - 1).bit_length() + 4)
    freq = frequencies(counts, bits)
    cum = np.concatenate([[np.uint64(0)], np.cumsum(freq)[:-1]]).astype(np.uint64)
    steps = BLOCK // LANES
    by_step = np.ascontiguousarray(at.reshape(n_blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, -1))
    x = np.full(n_blocks * LANES, LOW, np.uint64)
    out_mask = np.empty((steps, x.size), bool)
    out_word = np.empty((steps, x.size), np.uint32)
    shift, up, k = np.uint64(63 - bits), np.uint64(32), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = by_step[t]
        f = freq[s]
        full = x >= (f << shift)
        out_mask[t] = full
        out_word[t] = x  # its low 32 bits
        x = np.where(full, x >> up, x)
        q = x // f
        x = (q << k) + (x - q * f) + cum[s]
    mask = out_mask.reshape(steps, n_blocks, LANES).transpose(1, 0, 2).reshape(n_blocks, -1)
    word = out_word.reshape(steps, n_blocks, LANES).transpose(1, 0, 2).reshape(n_blocks, -1)
    streams = [word[b][mask[b]] for b in range(n_blocks)]
    first = np.cumsum([0, *map(len, streams)])[:-1]
    parts = [symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    for b, (w, lanes) in enumerate(zip(streams, x.reshape(n_blocks, LANES), strict=True)):
        parts += [np.uint64(first[b]).tobytes(), np.uint32(zlib.crc32(w)).tobytes(), np.uint32(zlib.crc32(padded[b * BLOCK : (b + 1) * BLOCK])).tobytes(), lanes.astype("<u8").tobytes()]
    index = zlib.compress(b"".join(parts), 1)
    head = np.array([(MAGIC, bits, LANES, BLOCK, len(ids), len(doc_ids), len(symbols), n_blocks, len(index))], _HEAD).tobytes()
    body = b"".join([head, index, *(w.astype("<u4").tobytes() for w in streams)])
    return body + np.uint32(zlib.crc32(body)).tobytes()


def unpack(image: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, document ids and token counts of a file image; blocks: only the ids of these blocks."""
    if image[:8] != MAGIC or zlib.crc32(memoryview(image)[:-4]) != int.from_bytes(image[-4:], "little"):
        raise ValueError("not a token file, or damaged")
    h = np.frombuffer(image, _HEAD, 1)[0]
    bits, lanes, block, n_blocks, n_docs, n_sym = (int(h[x]) for x in ("bits", "lanes", "block", "n_blocks", "n_docs", "n_symbols"))
    index = zlib.decompress(image[_HEAD.itemsize : _HEAD.itemsize + int(h["index"])])
    words = np.frombuffer(image, "<u4", (len(image) - 4 - _HEAD.itemsize - int(h["index"])) // 4, _HEAD.itemsize + int(h["index"]))
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(index, kind, n, at)
        at += out.nbytes
        return out

    symbols, freq, doc_ids, lengths = take("<u4", n_sym), take("<u4", n_sym).astype(np.uint64), take("<i8", n_docs), take("<u4", n_docs)
    table = take(np.dtype([("first", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("states", "<u8", (lanes,))]), n_blocks)
    ends = np.append(table["first"][1:], len(words)).astype(np.int64)
    chosen = range(n_blocks)[blocks]
    table, ends = table[blocks], ends[blocks]
    for row, end in zip(table, ends, strict=True):
        if zlib.crc32(words[int(row["first"]) : end]) != row["words"]:
            raise ValueError("a block's words are damaged")
    cum = np.concatenate([[np.uint64(0)], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot_of = np.repeat(np.arange(n_sym, dtype=np.uint32), freq.astype(np.int64))
    x = table["states"].astype(np.uint64).reshape(-1)
    ptr = table["first"].astype(np.int64)[:, None]
    steps = block // lanes
    got = np.empty((steps, x.size), np.uint32)
    low, k, up = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    safe = np.append(words, np.uint32(0)).astype(np.uint64)
    for t in range(steps):
        slot = x & low
        s = slot_of[slot]
        got[t] = s
        x = freq[s] * (x >> k) + slot - cum[s]
        need = (x < LOW).reshape(len(table), lanes)
        rank = np.cumsum(need, axis=1)
        where = np.minimum(ptr + rank - 1, len(words))
        x = np.where(need.reshape(-1), (x << up) | safe[where.reshape(-1)], x)
        ptr = ptr + rank[:, -1:]
    ids = symbols[got.reshape(steps, len(table), lanes).transpose(1, 0, 2).reshape(len(table), -1)] if len(table) else np.empty((0, block), np.uint32)
    for row, own in zip(table, ids, strict=True):
        if zlib.crc32(np.ascontiguousarray(own, "<u4")) != row["ids"]:
            raise ValueError("a block's ids are damaged")
    last = int(h["n_ids"]) - chosen[0] * block if len(chosen) else 0
    return ids.reshape(-1)[: max(0, last)], doc_ids, lengths


#: Words whose ids a worker holds.
MEMO = 600_000


def cut(texts: pa.Array, marks: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of texts, each piece's place among them, and where each text's pieces start.

    Cuts are made before each blank; with marks also before the first of some line feeds, and before a full stop or comma that
    follows a letter of ASCII.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2] if offsets[-1] else pa.py_buffer(b"")
    x = np.frombuffer(data, np.uint8, offsets[-1])[offsets[0] :]
    at = x == 32
    if marks and len(x):
        low = x | 32
        after = np.r_[False, ((low >= 97) & (low <= 122))[:-1]]
        at |= ((x == 46) | (x == 44)) & after
        at[1:] |= (x[1:] == 10) & (x[:-1] != 10)
    cuts = np.flatnonzero(at).astype(np.int32) + offsets[0]
    starts = np.arange(len(texts) + 1) + np.append(np.searchsorted(cuts, offsets[:-1]), len(cuts))
    ends = np.sort(np.concatenate([offsets, cuts]))
    pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), data).dictionary_encode()
    return pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(), starts


class Tokens:
    """Ids of whole texts by the tokenizers library; words met before come from a bounded memo.

    A byte-level BPE tokenizer never joins a character that is no white space with a blank or line feed after it, nor a letter with a
    full stop or comma after it, so a text is cut there: words that differ only in what follows them are one in the memo.
    Texts with white space in a row, or of other kinds than blanks and line feeds, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        #: Whether texts may be cut at these marks: no added token, which the library finds first, holds one.
        self.marks = not any(c in t.content for t in self.lib.get_added_tokens_decoder().values() for c in "\n.,")
        #: Texts that are not cut: white space in a row or of another kind, or the mark that cutting uses.
        self.odd = " [ \\n]|\\n |[\\t\\r\\x01-\\x08\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those not in the memo go to the library at once."""
        out = list(map(self.known.get, words))
        new = []
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = self.aside.get(words[i])
                if x is None:
                    new.append(i)
                else:
                    self.known[words[i]] = x
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            if len(self.known) + len(part) > MEMO // 2:  # frequent words come back from aside
                self.known, self.aside = {}, self.known
            ids = [e.ids for e in self.lib.encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
            raw = np.array(list(itertools.chain.from_iterable(ids)), "<u4").tobytes()
            ends = list(itertools.accumulate(4 * len(x) for x in ids))
            for i, at, end in zip(part, [0, *ends], ends, strict=False):
                out[i] = self.known[words[i]] = raw[at:end]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts, and the number of each text's ids."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        words, codes, starts = cut(texts.filter(pa.array(~odd)), self.marks)
        ids = self.learn(words)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = table.take(pa.array(codes)).flatten().to_numpy() if len(codes) else np.empty(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(size[codes])])[starts]
        lengths = np.zeros(len(texts), np.int64)
        lengths[~odd] = np.diff(ends)
        if not odd.any():
            return flat, lengths
        whole = {i: np.array(self.lib.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(odd).tolist()}
        for i, x in whole.items():
            lengths[i] = len(x)
        pieces, good = [], iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        for i in range(len(texts)):
            if i in whole:
                pieces.append(whole[i])
            else:
                lo, hi = next(good)
                pieces.append(flat[lo:hi])
        return np.concatenate(pieces), lengths


@kept_by_worker
def tokens(path: str) -> Tokens:
    return Tokens(path)


#: Up to so many files their offsets are broadcast; beyond, they are joined by shuffling.
BROADCAST_FILES = 100_000
IMAGE_SCHEMA = "part int, seq int, n_ids long, n_docs int, image binary"


def write_images(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Token files of docs(doc_id, text) in ascending doc_id order: part, seq (their order), n_ids, n_docs, image."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def image() -> pa.RecordBatch:
            nonlocal seq
            row = [[part], [seq], [sum(lengths)], [len(doc_ids)], [pack(np.concatenate(held), doc_ids, lengths)]]
            for x in (held, doc_ids, lengths):
                x.clear()
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["part", "seq", "n_ids", "n_docs", "image"])

        size = 0
        for b in batches:
            for s in in_slices(b, 1):
                ids, n = tokens(tokenizer_path).encode(s.column(1))
                ends = np.cumsum(n).tolist()
                for d, lo, hi in zip(s.column(0).to_pylist(), [0, *ends], ends, strict=False):
                    held += (ids[lo:hi], end)
                    doc_ids.append(d)
                    lengths.append(hi - lo + 1)
                    size += lengths[-1]
                    if size >= FILE_IDS:
                        yield image()
                        size = 0
        if doc_ids:
            yield image()

    return docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, IMAGE_SCHEMA)


def read_images(images: DataFrame) -> DataFrame:
    """Decode token files: doc_id, start, n_tokens, ids_crc32 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, doc_ids, lengths = unpack(image.as_py())
                raw = np.ascontiguousarray(ids, "<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(memoryview(raw)[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(doc_ids, mask=doc_ids == _NO_ID), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "rel", "n_tokens", "ids_crc32"],
                )

    # one row a partition, and one a file: a partition's files stay few, so that both sums are small
    each = images.select("part", "seq", "n_ids")
    in_part = each.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = each.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    bases = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n_files = each.count()
    small = F.broadcast if n_files <= BROADCAST_FILES else lambda x: x
    offsets = in_part.join(small(bases), "part").select("part", "seq", (F.col("before") + F.col("base")).alias("base"))
    rows = images.select("part", "seq", "image").mapInArrow(run, "part int, seq int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return rows.join(small(offsets), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of docs to the shared folder and read them back."""
    return read_images(stored(write_images(docs, tokenizer_path, end_id), "token-files"))
