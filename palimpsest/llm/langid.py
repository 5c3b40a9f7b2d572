"""Operator 7, language identification by compression.

Each language has a raw-content zstandard dictionary, made of training texts. A text, lower-cased and without what is no letter,
is compressed in pieces of PIECE bytes, once with each dictionary; the language whose pieces are smallest together is predicted.
Its score is the share of exp(-TEMPER * size) among the languages. A prediction is marked rejected if its margin to the second
language is narrow, whatever the text's length: below MARGIN of the second size, or below LEAD bytes, as sizes come in whole
bytes and a lead of one tells nothing. So ties are always rejected.

Training takes, for each language, the SAMPLE documents of smallest hash among those with a language outside the held-out
fold; a dictionary holds at most DICTIONARY bytes. Nothing but the text goes into a prediction.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; a null doc_id belongs to the held-out
fold; ties go to the language with most training texts; repeated rows are predicted row by row; an empty table gives an empty table;
without any learned language all rows are `und`; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, kept_by_worker, per_batch

SAMPLE = 300
DICTIONARY = 96 * 1024
PIECE = 2048
LEVEL = 6
TEMPER = 0.35
MARGIN, LEAD = 0.02, 2
_NO_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """A text's lower-cased words with a blank before and after each; empty without a letter."""
    x = _NO_LETTERS.sub(" ", text.lower()).strip()
    return f" {x} ".encode() if x else b""


@dataclass(frozen=True)
class Model:
    """Languages, the most frequent first, and their dictionaries."""

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def train(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> Model:
    """Learn from docs(doc_id, text, lang) outside the held-out fold. At most `sample` texts a language reach the driver."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    # bounded: `sample` rows a language
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).filter(F.col("text").rlike(r"\p{L}"))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    # a dictionary holds at most `size` bytes, so more of one text has no use there
    for n, lang, text in texts.select("n", "lang", F.substring("text", 1, size).alias("text")).distinct().collect():
        by_lang.setdefault(lang, []).append((n, text))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = tuple(sorted(by_lang, key=lambda x: (-counts.get(x, 0), x)))
    return Model(langs, tuple(_dictionary([t for _, t in sorted(by_lang[x])], size) for x in langs))


def _dictionary(texts: list[str], size: int) -> bytes:
    """An equal share of the dictionary for each text, as far as it goes."""
    out, left = [], size
    for k, t in enumerate(texts):
        raw = normal(t)[: max(256, left // max(1, len(texts) - k))]
        raw = raw[:left]
        out.append(raw)
        left -= len(raw)
        if left <= 0:
            break
    return b"\n".join(out)


@kept_by_worker
def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in model.dictionaries:
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
    return out


def sizes(model: Model, raw: bytes) -> np.ndarray:
    """Bytes of a text under each language's dictionary."""
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in _compressors(model)], np.int64)


def decide(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether the margin is too narrow."""
    raw = normal(text) if text and model.langs and any(map(str.isalpha, text)) else b""
    if not raw:
        return "und", 0.0, True
    s = sizes(model, raw)
    best = int(s.argmin())
    score = float(1 / np.exp(np.maximum(-700.0, TEMPER * (s[best] - s))).sum())
    if len(s) == 1:
        return model.langs[0], score, False
    second = int(np.partition(s, 1)[1])
    return model.langs[best], score, second - int(s[best]) < max(LEAD, MARGIN * second)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DICTIONARY bytes a language

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [decide(shared.value, t) for t in b.column(2).to_pylist()]
        lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )

    cols = docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text")
    return per_batch(cols, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is identified with a margin; their columns are as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([not decide(shared.value, t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return per_batch(docs, run, docs.schema)
