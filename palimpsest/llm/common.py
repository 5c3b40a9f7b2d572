"""What the training-data operators share."""

from __future__ import annotations

import functools
import gc
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import release, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_KEPT: list = []


def kept_by_worker(make: Callable) -> Callable:
    """A decorator: what `make` gives stays in a worker process from task to task, until another module's per_batch() starts there."""
    held = functools.lru_cache(maxsize=2)(make)
    _KEPT.append(held)
    return held


def free_others(module: str) -> None:
    """Drop what modules but this one keep in this process: workers go from operator to operator, their models and memos should not."""
    for held in _KEPT:
        if held.__module__ != module and held.cache_info().currsize:
            held.cache_clear()
            gc.collect()  # memos call methods of what holds them
            release()


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch. fn may return one batch or several; of a generator one at a time is held."""
    ship_package(df.sparkSession)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others(module)
        for b in batches:
            out = fn(b)
            for x in (out,) if isinstance(out, pa.RecordBatch) else out:
                yield x
                del x
                release()
            del b, out
            release()

    return df.mapInArrow(run, schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fold_py(doc_id: int | None) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


class Memo(dict):
    """A bounded memo: a miss calls fn. Once it holds half the bound it starts anew and keeps what was there aside; what is asked for
    again comes back from there, so frequent keys stay. Results never depend on it."""

    def __init__(self, fn: Callable, bound: int = 400_000):
        super().__init__()
        self.fn, self.bound = fn, bound
        self.aside: dict = {}

    def __missing__(self, key):
        if len(self) >= self.bound // 2:
            self.aside = dict(self)
            self.clear()
        out = self.aside.get(key, self)
        out = self[key] = self.fn(key) if out is self else out
        return out


def cut_at_blanks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut before each blank: the distinct words (a blank in front of all but a text's first), each word's place among them, and where each text's words start. No text may hold a \\x01."""
    parts = pc.split_pattern(pc.replace_substring(texts, " ", "\x01 "), "\x01")
    words = parts.flatten().dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def in_slices(b: pa.RecordBatch, text_column: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of text, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most)))
        yield b.slice(lo, hi - lo)
        lo = hi
