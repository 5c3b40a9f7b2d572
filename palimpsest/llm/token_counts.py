"""Operator 1, token counts: heap-and-linked-list byte-pair merging, without making identifiers.

A text is cut where no merge can cross (before a run of spaces, and between characters that no piece joins), each part is
merged with a heap over a linked list, and its count is its initial symbols less its merges; a symbol outside the vocabulary
counts its UTF-8 bytes. Counts of parts and words are held in a bounded memo for each worker.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted row by row;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut_at_blanks, in_slices, kept_by_worker, per_batch
from .piece_model import SPACE, PieceModel, merge


class TokenCounter:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.part = Memo(self._part)
        self.chunk = Memo(lambda w: self._chunk(w.replace(" ", SPACE)), 600_000)

    def _part(self, part: str) -> int:
        """Initial symbols less merges, plus what byte fallback adds for symbols outside the vocabulary."""
        out = merge(part, self.model.rank)
        merges = len(part) - len(out)
        return len(part) - merges + sum(self.model.loose(s) - 1 for s in out if s not in self.model.ids)

    def _chunk(self, chunk: str) -> int:
        if len(chunk) > 256:  # not worth a place in the memo
            return sum(map(self._part, self.model.parts(chunk)))
        return sum(map(self.part.__getitem__, self.model.parts(chunk)))

    def count(self, text: str | None) -> int:
        return sum(map(self._chunk, self.model.chunks(self.model.normalise(text or ""))))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Counts of a batch of texts: each distinct word is looked up once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        if self.model.dummy_prefix:
            plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        words, codes, starts = cut_at_blanks(plain)
        n = np.array([self.chunk[w] for w in words], np.int64)
        out = np.empty(len(texts), np.int64)
        out[~odd] = np.diff(np.concatenate([[0], np.cumsum(n[codes])])[starts])
        out[odd] = [self.count(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        return out


#: Texts that are not cut before each blank: runs of blanks, the visible space, the mark that cutting uses.
ODD = f"^ |  |{SPACE}|\\x01"


@kept_by_worker
def counter(path: str) -> TokenCounter:
    """One counter for each worker process."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([counter(model_path).counts(s.column(2)) for s in in_slices(b, 2)] or [np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    cols = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    return per_batch(cols, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
