"""Each training-data operator against a brute-force version, a library or an exact round trip, on small tables with odd rows."""

import hashlib
import random
import re
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, licenses, media, ngram_join, queries, rans, sp_fst, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
PIECES = queries.tokenizer_path("piece_bpe_32k.model")
BYTES = queries.tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a  b ", " a b ", "\n\n x\t\t", "é中　x\U0001f600 <|endoftext|> b<|endoftext|>", "a  <|endoftext|>  b", "a" * 3000, " " * 100, "ab" * 50 + "\x00z", "x\x1c y", "don't 's", "x\x85y z", "q\r\n w", "b\x01 c", "ﬁ ½ 123 4567", "<s> </s> <unk> <0x41>"]
DOCS = "doc_id long, text string, lang string, source string, bucket string, n int, at string, d string, h string, sig string"


def table(spark, texts, ids=None):
    """Documents with more columns than needed, some of them named like the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "b", 1, "a", "d", "h", "g") for i, t in zip(ids, texts, strict=True)], DOCS)


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.fixture(scope="module")
def sample():
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


def test_token_counts(spark, sample):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + sample + sample[:3] + ["word " * 30000]
    got = rows(token_counts.token_counts(table(spark, texts), PIECES))
    want = [len(x) for x in lib.encode([t or "" for t in texts], num_threads=1)]
    assert [r[2] for r in got] == want
    assert [r[1] for r in got] == [len((t or "").encode()) for t in texts]
    assert [r[3] for r in got] == [n > 4096 for n in want]
    assert token_counts.token_counts(table(spark, []), PIECES).count() == 0


def test_sentencepiece_transducer(spark, sample):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in ODD if t is None or "▁" not in t] + sample[:80] + ["x" * 100_000, "long " * 50_000, "a", "a"]
    encoded = sp_fst.encode(table(spark, texts), PIECES)
    got = rows(encoded)
    assert [list(r[1]) for r in got] == lib.encode([t or "" for t in texts], num_threads=1)
    assert [r[1] for r in rows(sp_fst.decode(encoded, PIECES))] == [t or "" for t in texts]
    assert all(r[5] for r in rows(sp_fst.round_trip(table(spark, texts), PIECES)))
    assert sp_fst.round_trip(table(spark, []), PIECES).count() == 0
    blank = rows(sp_fst.round_trip(table(spark, ["▁a"]), PIECES))
    assert blank[0][5] is False and blank[0][4] == hashlib.sha256(b" a").hexdigest()


def test_transducer_weights():
    """Without an order the weights alone choose the path, through the entry too; with one they do not matter."""
    fst = sp_fst.transducer(PIECES)
    r = random.Random(4)
    weights = {a: r.random() * 9 for a in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "b▁"]}
    joint, root = sp_fst.compose(sp_fst.normaliser(fst.model), sp_fst.union(sp_fst.pieces(weights), sp_fst.fallback(weights)))
    machine = sp_fst.Linked(joint, root)

    def least(text):
        if not text:
            return 0.0
        found = [weights[p] + least(text[len(p) :]) for p in weights if text.startswith(p)]
        return min(found or [sp_fst._FALLBACK + least(text[1:])])

    for _ in range(60):
        text = "".join(r.choices("ab x▁", k=r.randint(1, 9)))
        seen = text.replace(" ", "▁")
        for labels, want in ((text, seen), ([sp_fst.START, *text], "▁" + seen)):
            got = sp_fst.shortest(machine, labels, None)
            assert "".join(got) == want
            assert sum(weights.get(p, sp_fst._FALLBACK) for p in got) == pytest.approx(least(want))
    for text in ("word", " the  internationalisation of 12345", "é中\x01\U0001f600", "ab" * 5000):
        assert "".join(fst.path(text)) == text.replace(" ", "▁")
        assert all(sp_fst.merge(a + b, fst.model.rank) == [a, b] for a, b in zip(fst.path(text[:200]), fst.path(text[:200])[1:], strict=False))


def test_token_files(spark, sample, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    texts = ODD + sample
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(ids, texts, strict=True)}
    start, expected = 0, []
    for i in sorted(want):
        expected.append((i, start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes())))
        start += len(want[i])
    assert rows(rans.token_files(table(spark, texts, ids), BYTES)) == expected
    assert rans.token_files(table(spark, []), BYTES).count() == 0
    assert len(rows(rans.token_files(table(spark, ["x", "y", None], [1, 1, None]), BYTES))) == 3
    monkeypatch.setattr(rans, "BROADCAST_FILES", 0)
    assert rows(rans.token_files(table(spark, texts, ids), BYTES)) == expected


def test_token_files_pieces():
    """Texts are cut so that a word is one in the memo, whatever mark or line feed follows it, and the ids stay those of whole texts."""
    held, lib = rans.Tokens(BYTES), rans.tokens(BYTES).lib
    texts = ["word.", "a word, a word.\nword\n\nword", "a word\nword", "word"]
    held.encode(pa.array(texts))
    assert set(held.known) == {"word", " word", ".", ",", "a", " a", "\nword", "\n\nword"}
    rng = random.Random(7)
    parts = ["a", "Bc", "é", "'s", "'ll", ".", ",", ".,", "...", "\n", "\n\n", " ", " x", "7", "1.5", "!", "<|endoftext|>", "<|end", "中", "\u0301", "\U0001f600", "\u200b", "\t", "'"]
    texts = [None, "", ".", ",a", "\n", *ODD, *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(5000))]
    for some in (pa.array(texts), pa.array(texts).slice(3), pa.array([None, ""]), pa.array([], pa.string())):
        ids, n = rans.Tokens(BYTES).encode(some)
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in some.to_pylist()]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 5, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 7])
def test_rans_images(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    image = rans.pack(ids, [7, None], [n, 0])
    got, docs, lengths = rans.unpack(image)
    assert (got == ids).all() and lengths.tolist() == [n, 0] and docs.tolist() == [7, -(1 << 63)]
    assert (rans.unpack(image, slice(1, 2))[0] == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
    for at in (3, len(image) // 2, len(image) - 2):
        with pytest.raises(ValueError):
            rans.unpack(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])


def test_rans_skewed():
    ids = np.zeros(200_000, np.uint32)
    ids[::1000] = np.arange(200)
    image = rans.pack(ids, [1], [len(ids)])
    assert (rans.unpack(image)[0] == ids).all() and len(image) < 10_000


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 7)))
    pool = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    texts = [None, "", "short", "ab" * 400, "ab" * 300, "\x00" * 250, "x" * 99, "x" * 100, "x" * 101, pool[0], pool[0], pool[0][:150]]
    for _ in range(60):
        p = r.choice(pool)
        lo = r.randrange(len(p))
        texts.append(" ".join(word() for _ in range(r.randint(0, 30))) + p[lo : lo + r.randint(50, 250)] + " ".join(word() for _ in range(r.randint(0, 30))))
    near = list(pool[1] + pool[2])
    for _ in range(20):
        k = list(near)
        k[r.randrange(len(k))] = "#"
        texts.append("".join(k))
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed):
    texts = repeated_texts(seed)
    got = rows(suffix_dedup.removed(table(spark, texts).repartition(3)))
    assert [r[1:] for r in got] == brute_repeats(texts)


def test_suffix_dedup_pieces(monkeypatch):
    """Texts longer than a piece are looked at in overlapping pieces."""
    raw = "".join(random.Random(5).choices("abc", k=5000)).encode()
    whole = dict(suffix_dedup.anchors_of([raw]))[0]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert set(whole) == set(dict(suffix_dedup.anchors_of([raw]))[0])


def test_suffix_dedup_sample_and_text(spark, sample):
    texts = sample[:120]
    assert [r[1:] for r in rows(suffix_dedup.removed(table(spark, texts)))] == brute_repeats(texts)
    out = suffix_dedup.deduplicated(table(spark, [*texts[:30], None]))
    assert out.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    kept = {r.doc_id: r.text for r in out.collect()}
    for i, (t, b) in enumerate(zip(texts[:30], brute_repeats(texts[:30]), strict=True)):
        assert kept[i] == t if not b[1] else len(kept[i].encode()) <= b[0] - b[1]
    assert kept[30] is None


def test_suffix_dedup_empty_and_equal_ids(spark):
    assert suffix_dedup.removed(table(spark, [])).count() == 0
    t = "".join(random.Random(2).choices("abcdef ", k=300))
    assert [r[2] for r in rows(suffix_dedup.removed(table(spark, [t, t, t], [4, 4, 9])))] == [0, 0, 300]
    assert [r[2] for r in rows(suffix_dedup.removed(table(spark, [t, t], [None, 1])))] == [0, 300]


def test_suffix_dedup_runs(spark):
    """Long runs of short periods, which make few anchors, beside texts that end or begin in such runs."""
    r = random.Random(7)
    junk = lambda n: "".join(r.choices("abcdefgh ", k=n))
    pool = [" " * 500, "ab" * 300, "=-=" * 90, "0123456789" * 40, "x" * 170, "abcdefghijklmnopqrstuvwxyz01234567" * 12, "abcdefghijklmnopqrstuvwxyz012345678" * 12]
    texts = [None, *pool, *(junk(r.randint(0, 60)) + p[r.randint(0, 40) :] + junk(r.randint(0, 60)) + r.choice(pool) for p in pool for _ in range(3)), " " * 101, " " * 100]
    assert [x[1:] for x in rows(suffix_dedup.removed(table(spark, texts).repartition(2)))] == brute_repeats(texts)
    long = [" " * 5_000_000, "ab" * 1_000_000 + "#" + junk(200)]
    assert all(len(at) < 5000 for _, at in suffix_dedup.anchors_of([t.encode() for t in long]))
    assert [x[2:4] for x in rows(suffix_dedup.removed(table(spark, long)))] == [(4_999_999, 1), (1_999_998, 1)]


def test_suffix_dedup_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3)
    texts = repeated_texts(2)
    assert [x[1:] for x in rows(suffix_dedup.removed(table(spark, texts)))] == brute_repeats(texts)


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    for m, top in ((0, 2), (1, 2), (300, 2), (300, 50), (200, 1)):
        x = r.integers(0, top, (m, 4)).astype(np.uint64)
        order, group = suffix_dedup.multikey_quicksort(x, 3)
        keys = [tuple(v[:3]) for v in x[order].tolist()]
        assert sorted(order.tolist()) == list(range(m)) and keys == sorted(keys)
        assert [keys.index(v) for v in keys] == group.tolist()


def test_deep_shallow():
    r = random.Random(3)
    x = np.array([[r.choice(b"ab") for _ in range(100)] for _ in range(200)], np.uint8)
    x = np.concatenate([x, x[:50], np.repeat(x[:1], 20, 0), np.where(np.arange(100) == 70, 99, x[:30])]).astype(np.uint8)
    order, lcp = suffix_dedup.deep_shallow(x)
    s = [x[i].tobytes() for i in order]
    assert s == sorted(s)
    assert all(lcp[i] == next((k for k in range(100) if s[i][k] != s[i - 1][k]), 100) for i in range(1, len(s)))


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and comp[i] != comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def near_texts(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    texts = [None, "", " \t\n", "one two", "One  TWO", "one two three four five", "a b c d", "É b c d e", "é b c d e"]
    common = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(8, 120))] + (common if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 12)):
            k = list(base)
            for _ in range(r.randint(0, max(1, len(k) // 25))):
                k[r.randrange(len(k))] = word()
            texts.append((" " if r.random() < 0.5 else "\n").join(k))
    texts += [" ".join(common + [word() for _ in range(r.randint(0, 6))]) for _ in range(15)]
    # a chain whose ends do not link themselves
    chain = [word() for _ in range(60)]
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "salt", "tries"), [(0, None, None), (1, 3, None), (2, None, 0), (3, None, 1)])
def test_ngram_join(spark, monkeypatch, seed, salt, tries):
    """Also with salted tokens, and with few or no sets joined by trial, so that the matrix has to find the links."""
    if salt:
        monkeypatch.setattr(ngram_join, "SALT_SETS", 30)
    if tries is not None:
        monkeypatch.setattr(ngram_join, "KEYS", tries)
    texts = near_texts(seed)
    got = rows(ngram_join.classes(table(spark, texts).repartition(3)))
    assert [r[1:] for r in got] == brute_components(texts)


def test_ngram_join_odd(spark):
    assert ngram_join.classes(table(spark, [])).count() == 0
    assert [r[2] for r in rows(ngram_join.classes(table(spark, ["a b", "a b", None, "c"], [None, 3, None, 3])))] == [None, 3, 3, 3]
    kept = ngram_join.keep_one(table(spark, ["a b c d e f", "A b c d e f", "x", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_keep_one_rows(spark):
    """One row of a class stays, also of repeated rows, shared ids and null ids; rows without a word all stay."""
    texts = ["a b c", "a b c", "A  b c", "x y", "x y", "p q", "p q", "", "", "k l", "m n", "m n"]
    ids = [1, 1, 2, 3, 4, None, None, None, 5, 3, None, 7]
    kept = ngram_join.keep_one(table(spark, texts, ids).repartition(3))
    assert kept.columns == table(spark, []).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", "a b c"), ("3", "x y"), ("None", "p q"), ("None", ""), ("5", ""), ("3", "k l"), ("7", "m n")])


def test_ngram_links(spark):
    """All links between different texts, also inside components, and each row's number of links."""
    texts = near_texts(1)
    got = [set(map(int, ngram_join.shingles(t.encode() if t else None))) for t in texts]
    link = {(i, j) for i in range(len(got)) for j in range(len(got)) if i != j and got[i] and 5 * len(got[i] & got[j]) >= 4 * len(got[i] | got[j])}
    assert [r[1] for r in rows(ngram_join.link_counts(table(spark, texts)))] == [sum(a == k for a, _ in link) for k in range(len(texts))]
    first = [min(k for k, y in enumerate(got) if y == x) for x in got]
    want = {tuple(sorted((first[i], first[j]))) for i, j in link if got[i] != got[j]}
    pairs = ngram_join.links(table(spark, texts)).collect()
    assert len(pairs) == len(want) > 0 and {tuple(sorted(r)) for r in pairs} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 8), (9, 10), (5, 5), (3, 4)], "a long, b long")
    got = dict(map(tuple, ngram_join.components(edges).distinct().collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 7}


def test_licenses(spark):
    lines = ["Released under the MIT License.", "this work is LICENSED under the GNU general public license, version 3", "plain words of no licence at all", "Licensed under the Apache License, Version 2.0."]
    files = [
        (1, "r/a/x.txt", f"{lines[2]}\n{lines[0]}\n{lines[2]} {lines[2]}"),
        (2, "r/LICENSE", lines[3]),
        (3, "r/a/b/y.txt", lines[2]),
        (4, "r/a/b/COPYING.txt", f"{lines[2]} x\n{lines[1]}"),
        (5, "q/z.txt", None),
        (6, None, lines[0]),
        (7, "r/a/w.txt", ""),
        (8, None, "x"),
        (8, None, "x"),
    ]
    out = licenses.license_scan(spark.createDataFrame(files, "file_id long, path string, text string"))
    got = {r.file_id: (r.licence, r.origin, r.line_no) for r in out.collect()}
    assert got == {1: ("MIT", "own", 1), 2: ("Apache-2.0", "own", 0), 3: ("GPL-3.0", "inherited", None), 4: ("GPL-3.0", "own", 1), 5: (None, None, None), 6: ("MIT", "own", 0), 7: ("Apache-2.0", "inherited", None), 8: (None, None, None)}
    assert out.count() == 9
    assert licenses.license_scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_license_texts(spark):
    """Headers and whole files are scored as such, and words of no template weigh by their own counts."""
    mit, gpl = licenses.TEXTS["MIT"][0], licenses.TEXTS["GPL-3.0"]
    header = "\n".join(f"# {x}".rstrip() for x in gpl[0].split("\n"))
    named = "Copyright 2020 Jane Doe. Licensed under the MIT License."
    files = [
        (1, "a/LICENSE", f"The MIT License\n\nCopyright (c) 2019 Some One\n\n{mit}"),
        (2, "a/x.py", f"#!/usr/bin/python\n{header}\n\nimport os\nprint(os.name)"),
        (3, "b/COPYING", gpl[1]),
        (4, "c/x.py", f"plain words\n\n{named}\n\nmore words"),
        (5, "d/x.py", None),
        (6, "e/LICENSE", licenses.TEXTS["BSD-2-Clause"][0].replace("\n", " ")),
        (7, "f/COPYING", licenses.TEXTS["AGPL-3.0"][1]),
        *((k, "z/x.txt", "Copyright 2020 of Jane Doe\nplain words of no licence") for k in range(10, 400)),
    ]
    out = {r.file_id: r for r in licenses.license_scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert [out[k].licence for k in range(1, 8)] == ["MIT", "GPL-3.0", "GPL-3.0", "MIT", None, "BSD-2-Clause", "AGPL-3.0"]
    assert out[1].n_lines == files[0][2].count("\n") + 1 and out[3].score > 0.99 and out[2].n_lines >= header.count("\n") and out[4].n_lines == 1
    assert len(out) == len(files) and all(out[k].licence is None for k in range(10, 400))
    texts = [t or "" for _, _, t in files]
    lines = [x for t in texts for x in t.split("\n")]
    counts: dict[str, int] = {}
    for x in lines:
        for w in licenses.line_words(x):
            counts[w] = counts.get(w, 0) + 1
    s = licenses.Scanner(licenses.TEMPLATES, len(lines), counts)
    for k, t in zip(range(1, 8), texts, strict=False):
        got = [s.best(u) for u in [t, *t.split("\n"), *("\n".join(t.split("\n")[a:b]) for a, b in licenses.blocks(t.split("\n")))]]
        assert out[k].score == pytest.approx(max(x for _, x in got), abs=2e-6)


def test_license_cues():
    """A line that reaches a template holds one of the words that are looked for first."""
    s = licenses.Scanner(licenses.TEMPLATES, 1000, {"the": 600, "this": 400, "is": 300, "under": 50, "license": 20, "licensed": 20, "version": 30})
    r = random.Random(0)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert s.best(t)[0] is not None, name
            words = t.split()
            for _ in range(30):
                line = " ".join(r.sample(words, r.randint(1, len(words))))
                assert s.best(line)[0] is None or licenses.line_words(line) & s.needed


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    odd = rows(langid.predict(table(spark, [None, "", "12 ½ !", "und the of and that this", "\U0001f600"]), model))
    assert [r[2] for r in odd][:3] == ["und"] * 3 and odd[3][2] == "en" and odd[4][2] == "und"
    assert langid.predict(table(spark, []), model).count() == 0
    assert rows(langid.predict(table(spark, ["x"]), langid.train(table(spark, []))))[0][2] == "und"
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.99 * docs.count()


def test_language_margins(spark):
    """Short texts are held to the margin too, and ties are always rejected."""
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = ["Zq", "xyzzy plugh", "and", "this is what people said about the house and the garden, which they would have liked to see", None]
    want = []
    for t in texts:
        s = sorted(langid.sizes(model, langid.normal(t))) if t else [0, 0]
        want.append(bool(s[1] - s[0] < max(2, 0.02 * s[1])))
    assert want[0] and want[1] and not want[3]
    assert [r[4] for r in rows(langid.predict(table(spark, texts), model))] == want
    assert [r[0] for r in rows(langid.keep_identified(table(spark, texts), model))] == [k for k, x in enumerate(want) if not x]


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.toxic == held.predicted).mean() > 0.96
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.02
    odd = rows(toxicity.score(table(spark, [None, "", "Good day. You idiot scum! Bye", "Of " * 2000]), model))
    assert all(0 <= r[2] <= 1 for r in odd) and [r[3] for r in odd] == [0, 0, 1, 0]
    found = toxicity.offending_sentences(table(spark, ["Good day. You idiot scum! Bye", None]), model).collect()
    assert [(r.doc_id, r.sentence_no, r.sentence.strip()) for r in found] == [(0, 1, "You idiot scum")]
    assert toxicity.score(table(spark, []), model).count() == 0
    assert toxicity.fit([]).weights == {} and toxicity.fit([("a", 1)]).bias > 10


def brute_toxicity(model, text):
    """Noisy-or over sentences, word by word."""
    survive = 1.0
    for sentence in re.split("[.!?\\n]+", text or ""):
        words = {toxicity.word_of(w) for w in sentence.split(" ")}
        logit = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.parts_of(w))
        survive *= 1 - 1 / (1 + np.exp(-logit))
    return 1 - survive


def test_toxicity_brute_force(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(docs, labels)
    texts = [None, "", "idiot! idiot Idiot, scum.", "You idiot scum", *sample, "Plain words. " * 20_000, "You idiot scum"]
    got = rows(toxicity.score(table(spark, texts), model))
    assert [r[2] for r in got] == pytest.approx([brute_toxicity(model, t) for t in texts], abs=1e-9)
    # equal texts have equal scores, whatever stands beside them
    alone = rows(toxicity.score(table(spark, texts[::-1], range(len(texts))[::-1]).coalesce(1), model))
    assert [r[2] for r in alone] == [r[2] for r in got] and got[3][2] == got[-1][2]
    # the bound on bytes, several labels of one document, repeated rows
    d = table(spark, ["aa " * 10, "bb " * 1000, "cc", "cc", None], [1, 2, 3, 3, 4])
    y = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (None, 1), (5, 1)], "doc_id long, toxic int")
    every = toxicity.sample(d, y, "toxic", 9, 9, 1 << 20)
    kept = {i for i in range(1, 6) if zlib.crc32(str(i).encode()) % 5}
    assert len(every) == sum(n for i, n in ((1, 1), (2, 1), (3, 4), (4, 1)) if i in kept)
    assert all(len(t) <= 100 for t, _ in toxicity.sample(d, y, "toxic", 9, 9, 100))


def decoded_png(image):
    """The samples of a grey PNG file by its specification: chunks with checksums, and all five filters."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, size = 8, b"", None
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert tuple(body[8:]) == (8, 0, 0, 0, 0)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kind == b"IEND"
    raw, above, out = zlib.decompress(data), [0] * size[0], []
    for y in range(size[1]):
        line, row = raw[y * (size[0] + 1) :][: size[0] + 1], []
        for x, v in enumerate(line[1:]):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda q: abs(p - q))
            row.append((v + (0, a, b, (a + b) // 2, paeth)[line[0]]) % 256)
        out += row
        above = row
    return size, bytes(out)


def test_media(spark, sample, tmp_path):
    texts = [None, "", "a", "x" * 192, "x" * 193, "é" * 500, *sample[:40], sample[0], "long " * 40_000]
    out = media.media_columns(table(spark, texts))
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        with open(r.shard.removeprefix("file://"), "rb") as f:
            image = f.read()[r.offset : r.offset + r.length]
        size, samples = decoded_png(image)
        assert samples == payload and size == (r.width, r.height) == (192, len(payload) // 192) and r.depth == 8
        assert (r.media_bytes, r.media_sha256, r.digest) == (len(image), hashlib.sha256(image).hexdigest(), hashlib.sha256(image).hexdigest())
        assert r.feature == f"png;192x{size[1]}x8;sum={sum(payload)};min={min(payload)};max={max(payload)};distinct={len(set(payload))}"
        assert media.read_member(r.shard, r.offset, r.length) == payload
    assert media.media_columns(table(spark, [])).count() == 0
    # columns named like the operator's own do not matter
    clash = table(spark, ["q", None]).withColumnsRenamed({"lang": "shard", "source": "digest", "n": "offset", "bucket": "raw", "sig": "n_bytes"})
    assert [r[1] for r in rows(media.media_columns(clash))] == [1, 0]
    index = media.store(table(spark, ["a", "a", "b"]).coalesce(1), f"file://{tmp_path}").cache()
    rows_ = sorted(map(tuple, index.collect()))
    assert rows_[0][2:] == rows_[1][2:] != rows_[2][2:]
    with tarfile.open(rows_[0][3].removeprefix("file://")) as tar:
        assert sorted(tar.getnames()) == sorted({f"{r[2]}.png" for r in rows_})
    assert {tuple(r)[6:] for r in media.metadata(index).collect()} == {(192, 1, 8)}
    (tmp_path / "lost.tar").write_bytes(b"")
    assert media.orphans(index, f"file://{tmp_path}") == ["lost.tar"]


def test_png_is_readable():
    raw = bytes(range(192)) * 3
    image = media.png(raw)
    assert media.png_payload(image) == raw and media.png_header(image[: media.HEADER]) == (192, 3, 8)
    with pytest.raises(ValueError):
        media.png_payload(image[:60] + b"\xff" + image[61:])


def test_decontamination(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choices("abcdeÉé", k=4))
    items = [(1, " ".join(word() for _ in range(25))), (2, "x y"), (2, "Z"), (3, None), (4, "..."), (None, "null id item of four"), (5, "a a a a a a a a a a a a")]
    long = items[0][1]
    texts = [None, "", "... !!", "x, y! X-Y", f"{word()} {long.upper().replace('É', 'É')} {word()}", " ".join(long.split()[3:16]), " ".join(long.split()[3:12]), "z", "Null ID item of FOUR x y", "a " * 30, long + " " + long, "y x"]
    docs = table(spark, [*texts, texts[3]], [*range(len(texts)), 3])
    got = rows(decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))

    def words(t):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    for i, t in sorted([*enumerate(texts), (3, texts[3])]):
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - 9) if v else 0):
                g = v[k : k + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(str(item) if item is not None else "")
        ids = sorted(x for x in found if x)
        mine = [x for x in got if x[0] == i]
        assert mine and all(x[1:3] == (len(w), len(hit)) and x[5] == bool(hit) for x in mine)
        assert all(x[3] == len(ids) and x[4] == hashlib.sha256(",".join(ids).encode()).hexdigest() for x in mine)
    assert len(got) == len(texts) + 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).filter("contaminated").count() == 0
    assert decontam.decontaminate(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontam.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(x.doc_id for x in clean.collect()) == sorted(x[0] for x in got if not x[5])


def test_decontamination_shuffled(spark, monkeypatch):
    """The same without any broadcast of queries."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs = table(spark, ["a b c d e f g h i j k", "b c", None])
    got = rows(decontam.decontaminate(docs, spark.createDataFrame([(1, "A B C D E F G H I J"), (2, "b c")], "item_id long, text string")))
    assert [r[2:4] for r in got] == [(10, 2), (2, 1), (0, 0)]


def brute_proximity(texts, items, size=decontam.WINDOW, within=decontam.NEAR):
    """Each text's number of items with a window whose distinct words all stand near its rarest."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [words(t) for t in texts]
    count = {}
    for w in docs:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = [set() for _ in texts]
    for item, text in items:
        v = words(text)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            q = list(dict.fromkeys(v[k : k + size]))
            if item is None or not all(x in count for x in q):
                continue
            rare = min(q, key=lambda x: (count[x], q.index(x)))
            for i, w in enumerate(docs):
                if any(x == rare and set(q) <= set(w[max(0, at - within) : at + within + 1]) for at, x in enumerate(w)):
                    out[i].add(item)
    return [len(x) for x in out]


@pytest.mark.parametrize("broadcast", [True, False])
def test_proximity(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs = table(spark, ["red x x green x blue", "red " + "x " * 20 + "green blue", "blue green red red"])
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    q = decontam.query_terms(decontam.windows(items))
    index, _ = decontam.build_index(docs, q, 3)
    got = {r.d for r in decontam.proximity(index, q, 3, 5).collect()}
    assert got == {0, 2}
    r = random.Random(3)
    words = lambda n: " ".join(r.choices("abcdefghijÉé", k=n))
    texts = [None, "", *(words(r.randint(1, 70)) for _ in range(25)), "zz " + "pad " * 20 + "yy", "zz " + "pad " * 19 + "yy", "yy zz yy", "zz"]
    items = [(1, words(4)), (2, words(6)), (2, "a"), (3, words(14)), (4, "yy zz"), (5, None), (6, "never here a"), (None, "b"), (7, "zz")]
    out = rows(decontam.decontaminate(table(spark, [*texts, texts[3]], [*range(len(texts)), 3]), spark.createDataFrame(items, "item_id long, text string")))
    want = brute_proximity([*texts, texts[3]], items)
    assert [x[6] for x in out] == [w for i, w in sorted([*enumerate(want[:-1]), (3, want[-1])], key=lambda x: x[0])] and len(set(want)) > 2


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, SF).cache()
        assert frame.columns == docs.columns, name
        a, b = before.toPandas().sort_values("doc_id"), frame.toPandas().sort_values("doc_id")
        if name == "language ID":
            assert len(b) >= 0.97 * len(a)
        if name == "n-gram Jaccard join":
            assert sorted(b.doc_id) == sorted({a.doc_id.iloc[c] for _, c in brute_components(a.text.tolist())})
        if name == "suffix-array dedup":
            want = brute_repeats(a.text.tolist())
            assert b.doc_id.tolist() == a.doc_id.tolist()
            assert all(y == x if not w[1] else len(y.encode()) <= w[0] - w[1] for x, y, w in zip(a.text, b.text, want, strict=True))
        if name == "benchmark decontamination":
            assert decontam.decontaminate(frame, bench).filter("contaminated").count() == 0
            assert len(b) == decontam.decontaminate(before, bench).filter("not contaminated").count()
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert last.count() == frame.count() and last.filter(~F.col("lossless")).count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_operators_ignore_order_of_rows(spark, sample):
    texts = sample[:40]
    a = rows(ngram_join.classes(table(spark, texts)))
    b = rows(ngram_join.classes(table(spark, texts).orderBy(F.desc("doc_id")).repartition(5)))
    assert a == b


def test_arrow_cut():
    from palimpsest.llm.common import cut_at_blanks, in_slices

    words, codes, starts = cut_at_blanks(pa.array(["a b", "", "a"]))
    assert [[words[c] for c in codes[lo:hi]] for lo, hi in zip(starts, starts[1:], strict=False)] == [["a", " b"], [""], ["a"]]
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 30, "z"])], ["t"])
    assert [s.num_rows for s in in_slices(b, 0, 20)] == [2, 1, 1]


def test_workers_drop_what_other_operators_keep(spark, sample):
    """A worker's models and memos go once another operator's batches start in it; its own stay."""
    from palimpsest.llm.common import free_others, per_batch

    sp_fst.transducer(PIECES)
    free_others("palimpsest.llm.sp_fst")
    assert sp_fst.transducer.cache_info().currsize == 1
    free_others("palimpsest.llm.ngram_join")
    assert sp_fst.transducer.cache_info().currsize == 0

    docs = table(spark, sample[:40]).repartition(4).select("doc_id", "text")
    for _ in range(2):
        sp_fst.encode(docs, PIECES).count()
        sp_fst.encode(docs, PIECES).write.format("noop").mode("overwrite").save()

    def left(b):
        return pa.RecordBatch.from_arrays([pa.array([sp_fst.transducer.cache_info().currsize])], ["n"])

    assert all(r.n == 0 for r in per_batch(docs, left, "n long").collect())
