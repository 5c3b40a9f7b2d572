"""Every driver query against its DuckDB counterpart, whole comparisons, sources and streams."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.operators import compare
from palimpsest.plans import driver_queries, pipelines
from palimpsest.sources import readers
from palimpsest.streaming import pairs as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_oracle(spark, duck, name):
    got, want = driver_queries.QUERIES[name](spark, SF).toPandas(), duck.sql(driver_queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    values = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert values(got) == values(want)


@pytest.mark.parametrize("name", sorted(set(driver_queries.QUERIES) - set(driver_queries.ORACLES)))
def test_without_oracle(spark, name):
    assert driver_queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["pair_id", "line_no", "diff_type", "old_text", "new_text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def corpus(spark):
    base = ["Title of the work", "First paragraph stands here.", "It costs 1,000 euro in all.", "The last line of this page"]
    other = ["Title of the work", "First paragraph stood here.", "It costs 1000 euro in all.", "A line that is wholly new", "The last line of this page"]
    docs = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(other)), (3, "\n".join(base))], "doc_id long, text string")
    pairs = spark.createDataFrame([(12, 1, 2), (13, 1, 3)], "pair_id long, doc_a long, doc_b long")
    return pipelines.from_documents(docs, pairs)


def test_strict_pipeline(spark, corpus):
    out = pipelines.strict_pipeline(corpus).collect()
    assert {r.pair_id for r in out} == {12}
    found = {(r.diff_type, r.change_type, r.old_text, r.new_text) for r in out}
    assert ("modified", "content", "First paragraph stands here.", "First paragraph stood here.") in found
    assert any(d == "added" and n == "A line that is wholly new" for d, _, _, n in found)
    assert all(r.description for r in out)


def test_ui_pipeline(spark, corpus):
    shown, logical = pipelines.ui_pipeline(corpus)
    a, b = shown.collect(), logical.collect()
    assert {r.pair_id for r in a} == {12} and 0 < len(b) <= len(a)


def test_pairs(spark):
    """Documents in between that hold the same lines hide no pair, ids over 10^6 share no key, and ids without a key are refused."""
    line = lambda k: f"a line of over twenty characters {k}"
    held = {1: "xyh", 3: "yh", 4: "xyh", 5: "h", 1_000_001: "ab", 2_000_001: "ab", 2: "xzh", 1_000_002: "ab", 6: "zhx", 7: ""}
    docs = spark.createDataFrame([(i, "\n".join(map(line, [*k, *k[:1]]))) for i, k in held.items()] + [(1, line("x")), (8, None), (None, line("x"))], "doc_id long, text string")
    got = pipelines.from_documents(docs).pairs.collect()
    want = {(a, b) for a in held for b in held if a < b and len(set(held[a]) & set(held[b])) >= 2}
    assert len(got) == len(want) == len({r.pair_id for r in got}) and {(r.doc_a, r.doc_b) for r in got} == want
    with pytest.raises(Exception, match="too great"):
        pipelines.from_documents(docs.withColumn("doc_id", F.col("doc_id") + 2**31)).pairs.collect()


def test_regions(spark, corpus):
    cells = [["h", "i"], ["1", "2"]]
    regions = spark.createDataFrame([(1, 1, "table", 0, (72.0, 400.0, 200.0, 60.0), cells, 0.9), (2, 1, "table", 0, (72.0, 400.0, 200.0, 60.0), [["h", "i"], ["1", "9"]], 0.9), (2, 1, "figure", 0, (72.0, 600.0, 50.0, 50.0), None, None)], readers.SCHEMAS["regions"])
    k = pipelines.Settings()
    rows = pipelines.module_diffs(pipelines.Corpus(corpus.pages, corpus.blocks, corpus.lines, corpus.pairs, regions), k).filter("pair_id = 12")
    assert rows.columns == list(compare.DIFF)
    got = {(r.module, r.table_change, r.figure_change, r.diff_type) for r in rows.filter("module in ('table', 'figure')").collect()}
    assert got == {("table", "cell_content", None, "modified"), ("figure", None, "figure_added", "added")}


def test_change_logs(spark, tmp_path):
    log = {"original_pdf": "a.pdf", "modified_pdf": "b.pdf", "changes": [{"diff_type": "odd", "change_type": "content", "old_text": "x", "after": "y", "bbox": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}}, {"page": 3, "diff_type": "added", "change_type": "??"}]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    got = [(r.page, r.diff_type, r.change_type, r.before, r.after) for r in readers.change_logs(spark, str(tmp_path), strict=True).orderBy("truth_id").collect()]
    assert got == [(1, "modified", "content", "x", "y"), (3, "added", "content", None, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.pdf").write_bytes(b"abc")
    (tmp_path / "s/one.gt.txt").write_text("truth")
    docs = readers.binary_documents(spark, str(tmp_path))
    rows = readers.extracted(docs, lambda raw: [{"page_num": 1, "text": raw.decode()}], "page_num int, text string").collect()
    assert [(r.status, r.text) for r in rows] == [("ok", "abc")]
    bad = readers.extracted(docs, lambda raw: 1 / 0, "page_num int, text string").first()
    assert bad.status.startswith("failed: ZeroDivisionError")
    assert readers.bench_samples(spark, str(tmp_path)).first().truth == "truth"
    words = spark.createDataFrame([(1, 1, 0, 0, 1, "b", 30.0, 0.0, 40.0, 10.0, "F", 9.0, 0, 0), (1, 1, 0, 0, 0, "a", 0.0, 0.0, 10.0, 10.0, "F", 9.0, 16, 0)], readers.RAW_WORD)
    line = readers.lines_of_words(words).first()
    assert line.text == "a b" and line.bbox.width == 40 and line.style.bold
    data = spark.createDataFrame([(5, 1, 1, 1, 1, 0, 0, 10, 10, "96", "hi"), (4, 1, 1, 1, 0, 0, 0, 9, 9, "-1", ""), (5, 1, 1, 1, 2, 0, 0, 0, 9, "50", "x")], "level int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string")
    assert [(r.text, r.confidence) for r in readers.ocr_words(data).collect()] == [("hi", 0.96)]
    chars = spark.createDataFrame([(1, i, (float(i), 0.0, 1.0, 1.0)) for i in range(3)], "p int, char_no int, bbox struct<x:double,y:double,width:double,height:double>")
    met = readers.char_boxes_to_words(chars, spark.createDataFrame([(1, 0, "ab"), (1, 1, "c")], "p int, word_no int, text string"), ["p"]).orderBy("word_no").collect()
    assert [(r.bbox.x, r.bbox.width) for r in met] == [(0, 2), (2, 1)]
    with pytest.raises(ValueError):
        readers.page_range(5, 2)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 10, 11), (1, 10, 11), (2, 10, 12)], "pair_id long, doc_a long, doc_b long").withColumn("arrived", F.current_timestamp())
    rows.write.parquet(src)
    q = stream.compare_stream(stream.once_each(stream.pair_stream(spark, src)), lambda b: b.withColumn("n", F.lit(1)), out, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    assert sorted(r.pair_id for r in spark.read.parquet(out).collect()) == [1, 2]
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert stream.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert stream.user_sessions(events).agg(F.sum("n")).first()[0] == events.count()
