"""Scalar functions against known values and plain Python."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import images, quality as Q, similarity as S, style as Y, text as X, tokens as W

L = F.lit


def box(x, y, w, h):
    return G.box(L(float(x)), L(float(y)), L(float(w)), L(float(h)))


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (X.normalize_text, "  Multiple   Spaces\n ", "multiple spaces"),
        (X.normalize_text, "Ž", "ž"),
        (lambda c: X.normalize_text(c, ocr=True), "foo-\nbar – x", "foo-bar-x"),
        (X.normalize_text_full, "2020–2021", "2020-2021"),
        (X.normalize_text_full, "Hello World", "hello world"),
        (X.normalize_text_full, "Test​Word", "testword"),
        (lambda c: X.normalize_text_full(c, preserve_case=True), "Lietuva", "Lietuva"),
        (lambda c: X.normalize_for_matching(c, ocr=True), "Foo-\nbar", "foobar"),
        (X.normalize_strict, " a\n\n\n\nb ", "a\n\nb"),
        (X.normalize_compare, "“A” `b` — c--d", "\"a\" 'b' - c-d"),
        (lambda c: X.normalize_compare(c, X.NormalizationConfig.default_ocr()), "a - b", "a-b"),
        (X.expand_ligatures, "ﬁnd Œuvre", "find OEuvre"),
        (X.strip_diacritics, "ąčęß ł ø é", "acess l o e"),
        (X.merge_hyphenated_words, "infor-\n  macija a-\nb-\nc", "informacija abc"),
        (X.normalize_citations, "x (12) [1-3] ¹² [Ann, 2020]", "x [12] [1,3] ¹² [2020]"),
        (lambda c: X.normalize_citations(c, drop=True), "x [12] y", "x  y"),
        (X.strip_page_numbers, "a Page 12\n- 3 -\nb", "a \n\nb"),
        (X.normalize_ocr_strict, "ﬁne — “X” [3]\nPage 4", 'fine - "x"'),
        (X.text_for_id, "Ab-c, 1!", "ab c 1"),
        (X.grouping_text, "Page  12 of 30", "page {#} of {#}"),
        (X.strip_caption_number, "Figure 3.1: A map", "A map"),
        (X.without_edges, "1\n2\n3\n4\n5\n6\n7", "4"),
        (Y.normalize_font_name, "TimesNewRomanPSMT", "times new roman"),
        (Y.normalize_font_name, "Helvetica-Bold", "arial"),
        (Y.normalize_font_name, "Unknown Face", "unknown face"),
        (Q.failure_reason, "Connection timed out", "timeout"),
    ],
)
def test_text(one, fn, given, want):
    assert one(fn(L(given))) == want


@pytest.mark.parametrize("fn", [X.normalize_text, X.normalize_text_full, X.normalize_compare, X.normalize_strict, X.normalize_ocr_compare, X.text_for_id, X.normalize_for_matching])
def test_null_is_empty(one, fn):
    assert one(fn(L(None).cast("string"))) == ""


def test_small_values(one):
    assert one(Y.normalize_font_size(L(12.7))) == 12.5 and one(Y.normalize_font_size(L(-1.0))) == 0
    assert one(G.quantize(L(0.05))) == pytest.approx(0.04)
    assert one(X.caption_parts(L("Fig. 3.2 x"))).number == 3 and one(X.caption_parts(L("none"))) is None
    assert one(G.hamming(L("ff"), L("0f"))) == 4 and one(G.hamming(L("f" * 16), L("0" * 16))) == 64 and one(G.hamming(L("zz"), L("0f"))) == 64
    assert one(G.severity(L(0.7)), G.severity(L(0.4)), G.severity(L(0.1))) == ("high", "medium", "low")
    assert one(Q.is_page_number(L(" Page 3 of 9 ")), Q.is_page_number(L("3 pages"))) == (True, False)
    s = one(Y.style_of_span(L("ABCDEF+Arial"), L(10.0), L(18), L(0x102030)))
    assert (s.font, s.bold, s.italic, s.color) == ("Arial", True, True, [16, 32, 48])
    q = one(Q.text_quality(L("(cid:123)(cid:456)")))
    assert q.quality_score < 0.3 and one(Q.text_quality(L("Ąžuolas ėjo į mokyklą"))).quality_score > 0.8
    assert one(Q.looks_repeated(L("word " * 60))) and not one(Q.looks_repeated(L("short")))
    assert one(Q.safe_to_replace(L("x"), L("anything"))).reason == "native_empty"
    assert one(Q.looks_like_table_text(L("a|b|c|d"))) and not one(Q.looks_like_table_text(L("plain text")))


def test_boxes(one):
    assert one(G.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    assert one(G.iou(box(0, 0, 1, 1), L(None).cast(G.BOX))) == 0
    n = one(G.normalized(L(-10.0), L(0.0), L(700.0), L(100.0), L(600.0), L(800.0)))
    assert (n.x, n.y, n.width, n.height) == (0, 0, 1, 0.125)
    with pytest.raises(Exception, match="positive"):
        one(G.normalized(L(0.0), L(0.0), L(1.0), L(1.0), L(0.0), L(1.0)))
    assert tuple(one(G.from_corners(L(5.0), L(6.0), L(1.0), L(2.0)))) == (1, 2, 4, 4)
    c = one(G.clamped(box(float("nan"), -5, 900, 10), L(600.0), L(800.0)))
    assert (c.x, c.y, c.width, c.height) == (0, 0, 600, 10)
    assert tuple(one(G.from_json_any(L('{"x0":1,"y0":2,"x1":3,"y1":5}'), L(10.0), L(10.0)))) == (1, 2, 2, 3)
    assert tuple(one(G.from_json_any(L("[1,2,3,5]"), L(10.0), L(10.0)))) == (1, 2, 2, 3)
    assert one(G.from_json_any(L("{}"), L(10.0), L(10.0))) is None
    assert one(G.contains_center(box(0, 0, 1, 1), box(0.9, 0.9, 0.2, 0.2))) and not one(G.contains_whole(box(0, 0, 1, 1), box(0.9, 0.9, 0.2, 0.2)))
    assert one(G.layout_shift(box(0, 0, 10, 10), box(30, 0, 10, 10), L(600.0), L(800.0))).dx == 30
    assert one(G.layout_shift(box(0, 0, 10, 10), box(30, 0, 10, 10), L(600.0), L(800.0), 0.02, 30.0)) is None
    assert one(G.shift_direction(L(5.0), L(-3.0))) == "right_up"
    assert one(G.figure_hash_similarity(L("00"), L("00"), L(None).cast("string"), L("00"))).verdict == "different"


def reference_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_indel():
    r = random.Random(0)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        n = reference_lcs(a, b)
        assert S.lcs_length(a, b) == n
        ops = S.indel_opcodes(a, b)
        assert sum(o[2] - o[1] for o in ops if o[0] == "equal") == n
        assert "".join(b[o[3] : o[4]] if o[0] != "equal" else a[o[1] : o[2]] for o in ops if o[0] != "delete") == b
        assert all(a[o[1] : o[2]] == b[o[3] : o[4]] for o in ops if o[0] == "equal")
    assert S.token_sort("b a", "a b") == 1 and S.token_set("a b", "a b c") == 1 and S.token_set("", "a") == 0
    assert S.indel_ratio("", "") == 1 and S.word_error_rate("a b c", "a x c") == pytest.approx(1 / 3)


def test_similarity(one):
    assert one(S.line_similarity(L("B a"), L("a  b"))) == 1 and one(S.line_similarity(L(""), L(""))) == 1 and one(S.line_similarity(L("a"), L(""))) == 0
    assert one(S.block_similarity(L(""), L(""))) == 0
    s = one(S.change_significance(L("hello world"), L("hello  World")))
    assert (s.changed_chars, s.is_significant, s.is_whitespace_only) == (0, False, True)
    assert one(S.change_significance(L("abc"), L("abd"))).changed_chars == 1
    assert one(S.jaccard(F.array(L("a"), L("b")), F.array(L("b")))) == 0.5
    assert one(S.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0)))) == pytest.approx(0.70710678)
    assert one(S.length_ratio_within(L("a" * 100), L("ab"))) is False
    assert sorted(one(S.char_ngrams(L("abcab")))) == ["abc", "bca", "cab"]
    assert one(S.classify_text_diff(L("a"), L("a")), S.classify_text_diff(L("a b"), L("a  b")), S.classify_text_diff(L("A"), L("a")), S.classify_text_diff(L("a"), L("b"))) == ("identical", "whitespace_only", "formatting_only", "content")
    assert one(S.content_differs(L("a-b"), L("ab"))) is False
    gate = one(S.stage_a_gate(L("same text"), L("Same text")))
    assert gate.decision == "same"
    assert one(S.stage_b_gate(S.stage_a_gate(L("abcd efgh ijkl mnop"), L("abcd efgh ijkl xxxx")), F.array(L(1.0)), F.array(L(1.0)))).decision == "same"
    assert one(S.error_rates(L("ab"), L("ac"))).cer == 0.5
    assert one(S.sequence_ratio(L("abcd"), L("bcde"))) == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_tokens(one, spark):
    words = lambda t: F.array(*(F.struct(L(w).alias("text"), box(10 * i, 0, 9, 5).alias("bbox")) for i, w in enumerate(t.split())))
    a, b = words("a b c d"), words("a x c d e")
    ops = one(W.word_ops(W.texts(a), W.texts(b)))
    assert [o.tag for o in ops] == ["equal", "replace", "equal", "insert"]
    df = spark.range(1).select(a.alias("a"), b.alias("b")).withColumn("ops", W.word_ops(W.texts("a"), W.texts("b")))
    r = df.select(W.word_diffs("a", "b", "ops"), W.project_old("a", "b", "ops"), W.word_highlight("a", "b", "ops", minimal=True), W.smallest_op("ops")).first()
    assert [(d.tag, d.old, d.new) for d in r[0]] == [("replace", "b", "x"), ("insert", "", "e")]
    assert [x.x for x in r[1].boxes] == [10, 30] and r[2].a[0].x == 10 and r[3].tag == "replace"
    w = one(W.approximate_words(L("ab c"), box(0, 0, 40, 10)))
    assert [x.text for x in w] == ["ab", "c"] and w[1].bbox.x == pytest.approx(30)
    assert one(W.word_count(L("a b"), L(None).cast("string"))) == 2


def test_pictures(spark):
    x = (np.add.outer(np.arange(40), np.arange(60)) * 2).astype(np.uint8)
    y = x.copy()
    y[5:30, 5:50] = 255
    df = spark.createDataFrame([(bytearray(x.tobytes()), bytearray(x.tobytes()), bytearray(y.tobytes()), 40, 60)], "a binary, b binary, c binary, h int, w int")
    r = df.select(images.picture_hashes("a", "h", "w"), images.picture_hashes("b", "h", "w"), images.picture_hashes("c", "h", "w"), images.heat_map("a", "c", "h", "w"), images.heat_map("a", "b", "h", "w"), images.ink_box("c", "h", "w"), images.border_changed("a", "b", "h", "w")).first()
    assert r[0] == r[1] != r[2] and len(r[0].phash) == 16
    assert 0.2 < r[3].changed_share < 0.7 and r[4].changed_share == 0 and r[5] == [0.0, 0.0, 60.0, 40.0] and r[6].changed is False
    assert images.dhash(x) == "f" * 16
