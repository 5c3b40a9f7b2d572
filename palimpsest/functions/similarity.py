"""Similarity of texts and sets.

Sets, lengths and vectors are built-in functions. Insert-delete ratios and edit scripts have none: they are Arrow functions
over pairs, and callers first drop pairs that cheap built-in conditions rule out.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import C, NormalizationConfig, _col, _text, normalize_compare, normalize_for_matching, normalize_text

# --- plain Python on two strings: what the Arrow functions apply ---------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits a row."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths; two empty strings are equal."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common words, and these with the words that only one side has."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = indel_ratio(with_x, with_y)
    if both:
        best = max(best, indel_ratio(both, with_x), indel_ratio(both, with_y))
    return best


def indel_opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """An edit script along one longest common subsequence: equal, delete, insert and replace blocks."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    where: dict[str, int] = {}
    for i, ch in enumerate(x):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for ch in y:
        u = rows[-1] & where.get(ch, 0)
        rows.append((rows[-1] + u | rows[-1] - u) & full)
    # walk back: each step drops a character of x, of y, or a common one of both
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((lo + i, lo + j))
    equal = [(k, k) for k in range(lo)] + pairs[::-1] + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for p, q in [*equal, (len(a), len(b))]:
        if p > i or q > j:
            out.append(("replace" if p > i and q > j else "delete" if p > i else "insert", i, p, j, q))
        if p < len(a) and q < len(b):
            if out and out[-1][0] == "equal" and out[-1][2] == p and out[-1][4] == q:
                out[-1] = ("equal", out[-1][1], p + 1, out[-1][3], q + 1)
            else:
                out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    return out


def word_error_rate(truth: str, got: str) -> float:
    """Edits of words over the words of the truth."""
    a, b = truth.split(), got.split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] / max(1, len(a))


# --- Arrow functions -------------------------------------------------------------------------------------------------------------


def _pairwise(fn, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


_ratio, _sort, _set, _wer, _difflib = (_pairwise(f, T.DoubleType()) for f in (indel_ratio, token_sort, token_set, word_error_rate, lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()))


@F.pandas_udf(T.LongType())
def _changed(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> int:
        return sum(max(p1 - p0, q1 - q0) for tag, p0, p1, q0, q1 in indel_opcodes(x, y) if tag != "equal")

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def _both(a: Column, b: Column, score: Column, empty: float = 1.0) -> Column:
    return F.when((a == "") & (b == ""), empty).when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(score)


def ratio(a: C, b: C) -> Column:
    return _ratio(_text(a), _text(b))


def token_sort_ratio(a: C, b: C) -> Column:
    return _sort(_text(a), _text(b))


def token_set_ratio(a: C, b: C) -> Column:
    return _set(_text(a), _text(b))


def sequence_ratio(a: C, b: C) -> Column:
    """The ratio of matching blocks, with their popular-element rule."""
    return _difflib(_text(a), _text(b))


def line_similarity(a: C, b: C, ocr: bool = False) -> Column:
    """Token-sort ratio of normalised texts; two empty ones are equal."""
    x, y = normalize_text(a, ocr), normalize_text(b, ocr)
    return _both(x, y, _sort(x, y))


def block_similarity(a: C, b: C) -> Column:
    """As line_similarity(), but texts that are empty after normalisation match nothing."""
    x, y = normalize_text(a), normalize_text(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(_sort(x, y))


def match_similarity(a: C, b: C) -> Column:
    """Token-set ratio of stripped lower-case texts, by which predictions meet the truth."""
    x, y = F.lower(F.trim(_text(a))), F.lower(F.trim(_text(b)))
    return F.when((x == "") | (y == ""), 0.0).otherwise(_set(x, y))


def change_significance(a: C, b: C, ocr: bool = True, min_chars: int = 1, min_ratio: float = 0.005, compose: bool = True) -> Column:
    """struct(changed_chars, max_len, change_ratio, is_significant, is_whitespace_only)."""
    x, y = normalize_for_matching(a, ocr, compose), normalize_for_matching(b, ocr, compose)
    n = F.when(x == y, F.lit(0).cast("bigint")).otherwise(_changed(x, y))
    longest = F.when(x == y, F.greatest(F.length(_text(a)), F.length(_text(b)))).otherwise(F.greatest(F.length(x), F.length(y), F.lit(1)))
    share = F.when(x == y, 0.0).otherwise(n / longest)
    return F.struct(
        n.alias("changed_chars"),
        longest.alias("max_len"),
        share.alias("change_ratio"),
        ((x != y) & (n >= min_chars) & (share >= min_ratio)).alias("is_significant"),
        ((x == y) & (_text(a) != _text(b))).alias("is_whitespace_only"),
    )


_CHANGES = T.StructType([T.StructField("has_changes", T.BooleanType()), T.StructField("changed_chars", T.LongType()), T.StructField("change_ratio", T.DoubleType())])


@F.pandas_udf(_CHANGES)
def _character_changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    def one(x: str, y: str) -> tuple[bool, int, float]:
        x, y = (re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip() for t in (x, y))
        content = lambda t: sum(ch.isalnum() for ch in t)
        n = sum(max(content(x[i0:i1]), content(y[j0:j1])) for tag, i0, i1, j0, j1 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal") if x != y else 0
        return n > 0, n, n / max(1, len(x), len(y))

    return pd.DataFrame([one(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["has_changes", "changed_chars", "change_ratio"])


def character_changes(a: C, b: C) -> Column:
    """struct(has_changes, changed_chars, change_ratio): characters of content that were changed."""
    return _character_changes(_text(a), _text(b))


def bare_text(c: C) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(_text(c), r"(?U)[\s\W]", "")


def content_differs(a: C, b: C) -> Column:
    """Whether texts differ in more than white space and punctuation."""
    return bare_text(a) != bare_text(b)


def character_error_rate(truth: C, got: C) -> Column:
    return F.levenshtein(_text(truth), _text(got)) / F.greatest(F.length(_text(truth)), F.lit(1))


def error_rates(truth: C, got: C) -> Column:
    """struct(wer, cer)."""
    return F.struct(_wer(_text(truth), _text(got)).alias("wer"), character_error_rate(truth, got).alias("cer"))


def similar_for_formatting(a: C, b: C) -> Column:
    """Whether two normalised texts are so alike that a change of style between them counts."""
    x, y = _text(a), _text(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    within = (short != "") & long.contains(short) & (F.length(short) / F.greatest(F.length(long), F.lit(1)) >= 0.7)
    return F.when((x == "") | (y == ""), False).when((x == y) | within, True).otherwise(_difflib(x, y) >= 0.92)


# --- sets, lengths, vectors --------------------------------------------------------------------------------------------------------


def jaccard(a: C, b: C) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    x, y = _col(a), _col(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def jaccard_of_sizes(a: C, b: C, both: C) -> Column:
    """jaccard() of two sets by their sizes and that of what they share."""
    n_a, n_b, n = _col(a), _col(b), _col(both)
    return F.when((n_a > 0) & (n_b > 0), n / (n_a + n_b - n)).otherwise(0.0)


def ngram_form(c: C) -> Column:
    """The text whose runs of characters char_ngrams() gives."""
    return F.lower(F.trim(_text(c)))


def char_ngrams(c: C, n: int = 3) -> Column:
    """Distinct strings of n characters of the stripped lower-case text."""
    # the text is bound as a variable, else it is put in lower case again for each place
    places = lambda t: F.sequence(F.lit(1), F.length(t) - n + 1)
    grams = lambda t: F.when(F.length(t) >= n, F.array_distinct(F.transform(places(t), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(ngram_form(c)), grams)[0]


def char_ngram_hashes(c: C, n: int = 3) -> Column:
    """char_ngrams() as 16-bit hashes, the same in every run."""
    return F.array_distinct(F.transform(char_ngrams(c, n), lambda g: F.xxhash64(g).bitwiseAND(F.lit(0xFFFF))))


def length_ratio_within(a: C, b: C, most: float = 3.0) -> Column:
    x, y = F.length(_text(a)), F.length(_text(b))
    return F.when((x == 0) & (y == 0), True).when((x == 0) | (y == 0), False).otherwise(F.greatest(x, y) / F.least(x, y) <= most)


def length_ratio(a: C, b: C) -> Column:
    x, y = F.length(_text(a)), F.length(_text(b))
    return F.when((x == 0) & (y == 0), 1.0).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1)))


def cosine(a: C, b: C) -> Column:
    """Of two vectors; 0 if one is missing or zero."""
    x, y = (F.transform(_col(v), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def hashed_vector(c: C, size: int = 64, n: int = 3) -> Column:
    """A text's character n-grams counted in hash buckets: the offline stand-in where no embedding model is given."""
    buckets = F.transform(char_ngrams(c, n), lambda g: F.pmod(F.xxhash64(g), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(buckets, lambda x: x == i)).cast("double"))


# --- gates -------------------------------------------------------------------------------------------------------------------------


def stage_a_gate(a: C, b: C, config: NormalizationConfig | None = None, same: float = 0.98, different: float = 0.60, least_length_ratio: float = 0.7) -> Column:
    """struct(decision, reason, similarity): same, different, or semantic for the grey zone between."""
    x, y = normalize_compare(a, config), normalize_compare(b, config)
    best = F.greatest(_ratio(x, y), _sort(x, y), _set(x, y))
    lengths = length_ratio(x, y)
    decide = lambda d, r, s: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"), s.cast("double").alias("similarity"))
    return (
        F.when(x == y, decide("same", "identical", F.lit(1.0)))
        .when((x == "") | (y == ""), decide("different", "empty", F.lit(0.0)))
        .when(lengths < least_length_ratio, decide("different", "length_ratio", lengths))
        .when(best >= same, decide("same", "high_similarity", best))
        .when(best < different, decide("different", "low_similarity", best))
        .otherwise(decide("semantic", "grey_zone", best))
    )


def stage_b_gate(gate: C, vector_a: C, vector_b: C, same: float = 0.95, different: float = 0.80) -> Column:
    """The grey zone decided by the cosine of embeddings: same, different, or diff; without vectors diff. Other decisions stay."""
    g, s = _col(gate), cosine(vector_a, vector_b)
    missing = _col(vector_a).isNull() | _col(vector_b).isNull()
    d = F.when(missing, "diff").when(s >= same, "same").when(s < different, "different").otherwise("diff")
    reason = F.when(missing, "no_embedding").otherwise("semantic")
    return F.when(g["decision"] == "semantic", F.struct(d.alias("decision"), reason.alias("reason"), F.when(missing, g["similarity"]).otherwise(s).alias("similarity"))).otherwise(g)


def classify_text_diff(a: C, b: C, config: NormalizationConfig | None = None) -> Column:
    """identical, whitespace_only, formatting_only or content."""
    x, y = text_diff_keys(a, config), text_diff_keys(b, config)
    return text_diff_kind(_text(a) == _text(b), *(x[k] == y[k] for k in ("compare", "spaced")))


def text_diff_keys(c: C, config: NormalizationConfig | None = None) -> dict[str, Column]:
    """The forms of a text that text_diff_kind() compares."""
    k = config or NormalizationConfig()
    return {"compare": normalize_compare(c, k), "spaced": normalize_compare(c, k.whitespace_only())}


def text_diff_kind(same: Column, compare: Column, spaced: Column) -> Column:
    """The class of two texts by which of their forms are equal."""
    return F.when(same, "identical").when(~compare, "content").when(spaced, "whitespace_only").otherwise("formatting_only")
