"""Operator 8, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the summed weights of its distinct
words (a word's weight is that of itself and of its beginnings, so that inflected forms count); a document's is the
noisy-or of its sentences, 1 - prod(1 - score). Weights are learned from document labels alone, by gradient ascent on the
documents' likelihood through the noisy-or, and then locate the offending sentences.

Training takes the labelled documents outside the held-out fold, at most POSITIVES with label 1 and NEGATIVES with label 0 (by
smallest hash of their id), and of each label those whose texts come to at most MOST_BYTES, counted in that order. Nothing but the text goes into a score.

Defined cases: a null or empty text is one empty sentence, whose score is the bias alone; a null doc_id belongs to the held-out
fold; several labels of one document count each; repeated rows are scored row by row, and equal texts get equal scores; a very long
text is scored whole; an empty table gives an empty table;
without labels of both kinds every score is the share of label 1 among the labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, fold_of, in_slices, per_batch

POSITIVES, NEGATIVES = 2000, 3000
#: Bytes of training text of each label.
MOST_BYTES = 1 << 24
MIN_DOCUMENTS = 3
ROUNDS, RATE, DECAY = 200, 0.1, 1e-4
#: Lengths of the beginnings of words that are features beside the words themselves.
PREFIX = (3, 9)
#: Sentences end at these, in a row or alone.
_END = "[.!?\\n]+"
_TRIM = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def word_of(raw: str) -> str:
    """The word that a blank-separated piece stands for."""
    return _TRIM.sub("", raw.lower())


def sentences(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct raw words, each word's place among them, where each sentence's words start, where each text's sentences start."""
    by_text = pc.split_pattern_regex(pc.fill_null(texts, ""), _END)
    by_sentence = pc.split_pattern(by_text.flatten(), " ")
    words = by_sentence.flatten().dictionary_encode()
    first = lambda x: x.offsets.to_numpy() - x.offsets[0].as_py()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), first(by_sentence), first(by_text)


def parts_of(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [f"{word}$", *(word[:n] for n in range(PREFIX[0], min(PREFIX[1], len(word)) + 1))] if word else []


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs, each by itself: a running sum would carry what stands before a run into its last digits."""
    return np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), values, len(starts) - 1)


def _once(codes: np.ndarray, in_sentence: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and word of each distinct word of a sentence."""
    sentence = np.repeat(np.arange(len(in_sentence) - 1), np.diff(in_sentence))
    pairs = np.unique(sentence * max(1, n_words) + codes)
    return pairs // max(1, n_words), pairs % max(1, n_words)


def sentence_logits(model: Model, texts: pa.Array, known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each sentence, and where each text's sentences start. A word counts once a sentence, however it is written."""
    raw, codes, in_sentence, in_text = sentences(texts)
    weight = np.array([known[x] for x in raw], np.float64)
    hit = np.flatnonzero(weight[codes] != 0)  # others add nothing
    of_raw: dict[str, int] = {}
    word = np.array([of_raw.setdefault(word_of(x), len(of_raw)) if w else -1 for x, w in zip(raw, weight.tolist(), strict=True)], np.int64)
    value = np.zeros(len(of_raw))
    value[word[weight != 0]] = weight[weight != 0]
    # words are added in the order of their weights, not of their coming, so that a text's score does not depend on its batch
    order = np.argsort(value, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    word, value = np.append(place, -1)[word], value[order]
    sentence = np.searchsorted(in_sentence, hit, "right") - 1
    pairs = np.unique(sentence * max(1, len(of_raw)) + word[codes[hit]])
    logits = np.bincount(pairs // max(1, len(of_raw)), value[pairs % max(1, len(of_raw))] if len(pairs) else None, len(in_sentence) - 1)
    return model.bias + logits, in_text


def document_scores(logits: np.ndarray, in_text: np.ndarray) -> np.ndarray:
    return 1 - np.exp(-_sums(np.logaddexp(0, logits), in_text))


def sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, most_bytes: int) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out fold: at most so many of each kind, and so many bytes of each kind, reach the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).select("doc_id", F.col(label).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.filter("y = 1").orderBy(*order).limit(positives).unionByName(known.filter("y = 0").orderBy(*order).limit(negatives))
    # bounded: positives + negatives labels, of which those go on whose texts fit, counted in the same order
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    so_far = Window.partitionBy("y").orderBy(*order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("bytes") <= most_bytes)
    return [(t, y) for _, y, t in sorted(map(tuple, held.select("doc_id", "y", "text").collect()))]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Weights and bias of the noisy-or model, from texts and labels."""
    y = np.array([v for _, v in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model({}, float(np.log(share / (1 - share))))
    raw, codes, in_sentence, in_text = sentences(pa.array([t for t, _ in rows], pa.string()))
    names, of_raw = np.unique([word_of(x) for x in raw], return_inverse=True)
    sentence, word = _once(of_raw[codes], in_sentence, len(names))
    doc = np.repeat(np.arange(len(in_text) - 1), np.diff(in_text))
    # the features of each word, and the documents of each feature
    place: dict[str, int] = {}
    of_word, feature = [], []
    for i, w in enumerate(names.tolist()):
        for f in parts_of(w):
            of_word.append(i)
            feature.append(place.setdefault(f, len(place)))
    of_word, feature = np.array(of_word, np.int64), np.array(feature, np.int64)
    first = np.searchsorted(of_word, np.arange(len(names) + 1))
    counts = np.zeros(len(place), np.int64)
    of_doc = np.searchsorted(sentence, in_text)
    for lo, hi in zip(of_doc, of_doc[1:], strict=False):
        own = np.unique(word[lo:hi])
        counts[np.unique(np.concatenate([np.empty(0, np.int64), *(feature[first[w] : first[w + 1]] for w in own.tolist())]))] += 1
    common = counts >= MIN_DOCUMENTS
    keep = common[feature]
    of_word, feature = of_word[keep], (np.cumsum(common) - 1)[feature[keep]]
    kept = [f for f, c in zip(place, common.tolist(), strict=True) if c]
    n_features, n_sentences = len(kept), len(in_sentence) - 1
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(0.1 / max(1.0, n_sentences / len(y)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        of_names = np.bincount(of_word, theta[feature], len(names))
        z = theta[-1] + np.bincount(sentence, of_names[word], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        survive = np.exp(-_sums(np.logaddexp(0, z), in_text))
        # d log-likelihood / d logit: -p for label 0; p * survive / (1 - survive) for label 1
        pull = np.where(y == 1, survive / np.maximum(1 - survive, 1e-9), -1.0)
        g = pull[doc] * p / len(y)
        by_word = np.bincount(word, g[sentence], len(names))
        grad = np.concatenate([np.bincount(feature, by_word[of_word], n_features), [g.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = RATE / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        theta += step * m / (1 - 0.9**k)
        # weights that earn less than DECAY go to nothing
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(0, np.abs(theta[:-1]) - step[:-1] * DECAY)
    return Model({f: float(w) for f, w in zip(kept, theta.tolist(), strict=False) if abs(w) > 1e-3}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, most_bytes: int = MOST_BYTES) -> Model:
    return fit(sample(docs, labels, label, positives, negatives, most_bytes))


def _known(model: Model) -> Memo:
    return Memo(lambda raw: sum(model.weights.get(f, 0.0) for f in parts_of(word_of(raw))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample's words
    memo: list[Memo] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not memo:
            memo.append(_known(shared.value))
        out = [document_scores(*sentence_logits(shared.value, s.column(2), memo[0])) for s in in_slices(b, 2)]
        p = np.clip(np.concatenate(out or [np.empty(0)]), 0.0, 1.0)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    cols = docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text")
    return per_batch(cols, run, "doc_id long, held_out boolean, score double, predicted int")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence_no (from 0), sentence, score of the sentences that score at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: list[Memo] = []

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        if not memo:
            memo.append(_known(shared.value))
        out = []
        for s in in_slices(b, 1):
            logits, in_text = sentence_logits(shared.value, s.column(1), memo[0])
            hit = np.flatnonzero(1 / (1 + np.exp(-np.clip(logits, -40, 40))) >= least)
            row = np.searchsorted(in_text, hit, "right") - 1
            flat = pc.split_pattern_regex(pc.fill_null(s.column(1), ""), _END).flatten()
            out.append(
                pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(row)), pa.array((hit - in_text[row]).astype(np.int32)), flat.take(pa.array(hit)), pa.array(1 / (1 + np.exp(-logits[hit])))],
                    ["doc_id", "sentence_no", "sentence", "score"],
                )
            )
        return out

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, sentence_no int, sentence string, score double")
