"""Text normalisation as Column expressions. A null or empty text gives an empty text everywhere.

White space is Unicode white space ((?U) in patterns), as documents come from many sources. Composition (NFC) and removal of
diacritics have no built-in function; they are Arrow functions which texts that need nothing pass unchanged, and each builder
that uses them has a switch to leave them out.
"""

from __future__ import annotations

import unicodedata
from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalisation maps or removes.
SPACES_SHORT = "\u00a0\u202f\u2007\u2009\u200a\u3000"
SPACES_ALL = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad\u2060"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
DASHES_ALL = DASHES + "\ufe58\ufe63\uff0d"
DASHES_OCR = DASHES + "\u00ad"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2039\u203a"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb"
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
    "Œ": "OE",
    "œ": "oe",
    "Æ": "AE",
    "æ": "ae",
    "Ĳ": "IJ",
    "ĳ": "ij",
}
# Letters whose base is no matter of decomposition. All other accents go with their combining marks.
BASE_LETTERS = {"ł": "l", "Ł": "L", "ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE"}
# Letters between which a hyphen at a line's end is joined.
JOINED_LETTERS = "a-zA-ZąčęėįšųūžĄČĘĖĮŠŲŪŽ"
# Citation markers.
CITATIONS = (
    r"\[\d+(?:[-–,]\d+)*\]",
    r"\(\d+(?:[-–,]\d+)*\)",
    r"(?<!\d)[¹²³⁴⁵⁶⁷⁸⁹⁰]+(?!\d)",
    r"\[\w+(?:\s+et\s+al\.?)?,?\s*\d{4}\]",
    r"\(\w+(?:\s+et\s+al\.?)?,?\s*\d{4}\)",
)
# Page numbers that stand in a text.
PAGE_NUMBERS = (r"\b[Pp]age\s+\d+\b", r"\b[Pp]\.\s*\d+\b", r"\b\d+\s+of\s+\d+\b", r"^\s*[-–—]\s*\d+\s*[-–—]\s*$", r"^\s*\d+\s*$")

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: C) -> Column:
    return F.coalesce(_col(c), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _no_marks(s: pd.Series) -> pd.Series:
    def bare(x: str | None) -> str | None:
        return x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch))

    return s.map(bare)


def nfc(c: C) -> Column:
    return _nfc(_text(c))


def strip(c: C) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def collapse(c: C) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(_text(c), r"(?U)\s+", " ")


def tokens(c: C) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def translate_all(c: C, chars: str, to: str) -> Column:
    return F.translate(_text(c), chars, to * len(chars))


def tight_dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s*-\s*", "-")


def join_hyphens(c: Column) -> Column:
    """Without a hyphen at a line's end and the break."""
    return F.regexp_replace(c, r"(?U)-\s*[\n\r]+\s*", "")


def normalize_text(c: C, ocr: bool = False, compose: bool = True) -> Column:
    """Lower case, one blank for white space. ocr: dash variants as hyphens without blanks; a hyphen at a line's end so stays."""
    out = F.lower(_text(c))
    if compose:
        out = nfc(out)
    if ocr:
        out = tight_dashes(translate_all(out, DASHES, "-"))
    return strip(collapse(out))


def normalize_text_full(c: C, preserve_case: bool = False, dashes: bool = True, zero_width: bool = True, spaces: bool = True, compose: bool = True) -> Column:
    """Special blanks, zero-width characters and dash variants, each by its switch; then white space and case."""
    out = nfc(c) if compose else _text(c)
    if spaces:
        out = translate_all(out, SPACES_SHORT, " ")
    if zero_width:
        out = F.translate(out, ZERO_WIDTH, "")
    if dashes:
        out = tight_dashes(translate_all(out, DASHES, "-"))
    out = strip(collapse(out))
    return out if preserve_case else F.lower(out)


def normalize_for_matching(c: C, ocr: bool = False, compose: bool = True) -> Column:
    """Lower case, punctuation kept. ocr: hyphens at line ends are joined first."""
    out = F.lower(nfc(c) if compose else _text(c))
    if ocr:
        out = translate_all(F.regexp_replace(join_hyphens(out), r"(?U)-\s+", "-"), DASHES, "-")
    return strip(collapse(out))


def normalize_strict(c: C, compose: bool = True) -> Column:
    """For display: three line feeds or more are two."""
    return strip(F.regexp_replace(nfc(c) if compose else _text(c), "\n{3,}", "\n\n"))


@dataclass(frozen=True)
class NormalizationConfig:
    """Switches of normalize_compare()."""

    lowercase: bool = True
    nfc_normalize: bool = True
    collapse_whitespace: bool = True
    normalize_special_spaces: bool = True
    strip_zero_width: bool = True
    normalize_quotes: bool = True
    normalize_dashes: bool = True
    join_hyphenation: bool = True
    ocr_mode: bool = False

    @classmethod
    def default_digital(cls) -> NormalizationConfig:
        return cls()

    @classmethod
    def default_ocr(cls) -> NormalizationConfig:
        return cls(ocr_mode=True)

    @classmethod
    def from_dict(cls, values: dict) -> NormalizationConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)

    def whitespace_only(self) -> NormalizationConfig:
        """What tells a change of white space from one of formatting."""
        return replace(self, lowercase=False, nfc_normalize=True, collapse_whitespace=True, normalize_special_spaces=True, strip_zero_width=True, normalize_quotes=False, normalize_dashes=False)


def normalize_compare(c: C, config: NormalizationConfig | None = None) -> Column:
    """The form that comparison uses; the expression is put together on the driver, once for a configuration."""
    k = config or NormalizationConfig()
    out = nfc(c) if k.nfc_normalize else _text(c)
    if k.join_hyphenation:
        out = join_hyphens(out)
    if k.normalize_special_spaces:
        out = translate_all(out, SPACES_ALL, " ")
    if k.strip_zero_width:
        out = F.translate(out, ZERO_WIDTH, "")
    if k.normalize_quotes:
        out = F.translate(out, SINGLE_QUOTES + "`" + DOUBLE_QUOTES, "'" * (len(SINGLE_QUOTES) + 1) + '"' * len(DOUBLE_QUOTES))
    if k.normalize_dashes:
        out = F.regexp_replace(translate_all(out, DASHES_ALL, "-"), "-{2,}", "-")
        if k.ocr_mode:
            out = tight_dashes(out)
    if k.collapse_whitespace:
        out = collapse(out)
    if k.lowercase:
        out = F.lower(out)
    return strip(out)


def fingerprint(c: C) -> Column:
    return F.sha1(_text(c))


def dual_text(c: C, config: NormalizationConfig | None = None) -> Column:
    """struct(strict, compare, fingerprint); equal fingerprints mean texts that compare equal."""
    compare = normalize_compare(c, config)
    return F.struct(normalize_strict(c).alias("strict"), compare.alias("compare"), fingerprint(compare).alias("fingerprint"))


# --- OCR text --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class OCRNormalizationConfig:
    """Switches of normalize_ocr(); stages run in the order of these fields."""

    compose: bool = True
    ligatures: bool = True
    hyphens: bool = True
    citations: bool = True
    drop_citations: bool = False
    page_numbers: bool = False
    quotes: bool = True
    dashes: bool = True
    diacritics: bool = False
    whitespace: bool = True
    line_breaks: bool = True
    lowercase: bool = False

    @classmethod
    def strict(cls) -> OCRNormalizationConfig:
        """For checksums."""
        return cls(drop_citations=True, page_numbers=True, lowercase=True)

    @classmethod
    def compare(cls) -> OCRNormalizationConfig:
        """For comparison: case and page numbers stay."""
        return cls()

    @classmethod
    def minimal(cls) -> OCRNormalizationConfig:
        return cls(ligatures=False, hyphens=False, citations=False, quotes=False, dashes=False)


def expand_ligatures(c: C) -> Column:
    out = _text(c)
    for lig, letters in LIGATURES.items():
        out = F.replace(out, F.lit(lig), F.lit(letters))
    return out


def strip_diacritics(c: C) -> Column:
    out = _text(c)
    for letter, base in BASE_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(base))
    return _no_marks(out)


def merge_hyphenated_words(c: C) -> Column:
    """Words split at a line's end joined. The letters are looked at but not taken, so one pass joins all."""
    return F.regexp_replace(_text(c), rf"(?U)(?<=[{JOINED_LETTERS}])[-\u2010\u2011\u00ad]\s*[\n\r]+\s*(?=[{JOINED_LETTERS}])", "")


_ANY_CITATION = "(?U)" + "|".join(CITATIONS)


def normalize_citations(c: C, drop: bool = False) -> Column:
    """Citation markers removed, or written as [n,...]; markers without plain digits stay."""
    if drop:
        return F.regexp_replace(_text(c), _ANY_CITATION, "")
    # the text between markers and the markers alternate, one more of the former
    text = _text(c)
    between, marks = F.split(text, _ANY_CITATION), F.regexp_extract_all(text, F.lit(_ANY_CITATION), F.lit(0))
    numbers = lambda m: F.regexp_extract_all(m, F.lit(r"(?U)\d+"), F.lit(0))
    written = F.transform(marks, lambda m: F.when(F.size(numbers(m)) > 0, F.concat(F.lit("["), F.array_join(numbers(m), ","), F.lit("]"))).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(between, written, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def normalize_quotes(c: C) -> Column:
    return F.translate(_text(c), SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def normalize_dashes(c: C) -> Column:
    return translate_all(c, DASHES_OCR, "-")


def normalize_whitespace(c: C, line_breaks: bool = True) -> Column:
    out = F.regexp_replace(_text(c), r"[\n\r]+", " ") if line_breaks else _text(c)
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def strip_page_numbers(c: C) -> Column:
    out = _text(c)
    for p in PAGE_NUMBERS:
        out = F.regexp_replace(out, f"(?mU){p}", "")
    return out


def normalize_ocr(c: C, config: OCRNormalizationConfig | None = None) -> Column:
    k = config or OCRNormalizationConfig.compare()
    out = nfc(c) if k.compose else _text(c)
    stages = (
        (k.ligatures, expand_ligatures),
        (k.hyphens, merge_hyphenated_words),
        (k.citations, lambda x: normalize_citations(x, k.drop_citations)),
        (k.page_numbers, strip_page_numbers),
        (k.quotes, normalize_quotes),
        (k.dashes, normalize_dashes),
        (k.diacritics, strip_diacritics),
        (k.whitespace, lambda x: normalize_whitespace(x, k.line_breaks)),
        (k.lowercase, F.lower),
    )
    for on, stage in stages:
        if on:
            out = stage(out)
    return out


def normalize_ocr_strict(c: C) -> Column:
    return normalize_ocr(c, OCRNormalizationConfig.strict())


def normalize_ocr_compare(c: C) -> Column:
    return normalize_ocr(c, OCRNormalizationConfig.compare())


# --- keys and templates ------------------------------------------------------------------------------------------------------


def text_for_id(c: C) -> Column:
    """Lower case, letters and numbers alone, one blank between."""
    return strip(F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]+", " "))


def norm_simple(c: C) -> Column:
    return F.lower(strip(c))


def strip_punctuation(c: C) -> Column:
    return F.regexp_replace(_text(c), r"(?U)[^\w\s]+", "")


def grouping_text(c: C) -> Column:
    """Texts that differ in numbers alone share it."""
    return F.regexp_replace(strip(collapse(F.lower(_text(c)))), r"(?U)\d+", "{#}")


def template_text(c: C) -> Column:
    """As grouping_text(), for display; null stays null."""
    return F.when(_col(c).isNotNull(), F.regexp_replace(strip(c), r"(?U)\d+", "{#}"))


def header_footer_text(c: C, ocr: bool = False, compose: bool = True) -> Column:
    return F.regexp_replace(normalize_text(c, ocr, compose), r"(?U)\d+", "{#}")


_CAPTION = r"(?i)^\s*(figure|fig\.?|table|chart|diagram|image)\s*(\d+(?:\.\d+)*)"


def strip_caption_number(c: C) -> Column:
    return strip(F.regexp_replace(_text(c), _CAPTION + r"\s*[:.\-]?\s*", ""))


def caption_parts(c: C) -> Column:
    """struct(label, number, full_number) of a caption; null if the text is none. number is the first integer."""
    text = _text(c)
    full = F.regexp_extract(text, _CAPTION, 2)
    return F.when(
        text.rlike(_CAPTION),
        F.struct(F.regexp_extract(text, _CAPTION, 1).alias("label"), F.regexp_extract(full, r"^\d+", 0).cast("int").alias("number"), full.alias("full_number")),
    )


def without_edges(c: C, head: int = 3, tail: int = 3) -> Column:
    """Without the first and last lines, if there are more."""
    lines = F.split(_text(c), "\n")
    n = F.size(lines)
    return F.when(n > head + tail, F.array_join(F.slice(lines, head + 1, n - head - tail), "\n")).otherwise(_text(c))


@F.pandas_udf(T.StringType())
def without_repetition(s: pd.Series) -> pd.Series:
    """Without lines that repeat a third time, phrases that repeat in a row, and a tail of few distinct words."""
    import re

    phrase = re.compile(r"(\b\S+(?:\s+\S+){0,7}\s+)\1{2,}")

    def fixed(x: str | None) -> str:
        seen: dict[str, int] = {}
        lines = []
        for line in (x or "").split("\n"):
            key = line.strip()
            seen[key] = seen.get(key, 0) + 1
            if not key or seen[key] <= 2:
                lines.append(line)
        out = phrase.sub(r"\1", "\n".join(lines))
        words = out.split()
        if len(words) > 100 and len(set(words[-50:])) < 10:
            out = " ".join(words[:-50])
        return out

    return s.map(fixed)
