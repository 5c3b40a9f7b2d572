"""Comparison inputs derived from the driver's tables: lines, pages, boxes and document pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.operators import paired
from palimpsest.session import stored

LINES_PER_PAGE, PAGE_WIDTH, PAGE_HEIGHT = 40, 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, page_num (from 1) of docs(doc_id, text)."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.withColumn("page_num", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int"))


def line_boxes(lines: DataFrame) -> DataFrame:
    """Lines with a box each: 14 points apart, 6 points a character."""
    at = F.col("line_no") % LINES_PER_PAGE
    return lines.withColumn("bbox", G.box(F.lit(72.0), 72.0 + 14.0 * at, F.least(F.lit(468.0), 6.0 * F.length("line")), F.lit(12.0)))


def pairs(lines: DataFrame, least_length: int = 20) -> DataFrame:
    """pair_id, doc_a, doc_b: all documents doc_a < doc_b that share at least two lines of over 20 characters.

    The pairs are as many as the definition has. An id that is too great for pair_id raises an error.
    """
    found = paired.pairs_of(paired.blocks(lines, least_length=least_length))
    return stored(found.select("pair_id", "doc_a", "doc_b"), "pairs")


# The same in DuckDB's SQL, for the oracles.
SQL_LINES = """
doc_lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(line_no // 40 + 1 AS INTEGER) AS page_num
  FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
SQL_BOXES = SQL_LINES + """,
boxes AS (SELECT *, CAST(72 AS DOUBLE) AS x, CAST(72 + 14 * (line_no % 40) AS DOUBLE) AS y, CAST(least(468, 6 * length(line)) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM doc_lines)"""
SQL_PAIRS = SQL_LINES + """,
held AS (SELECT DISTINCT doc_id, line FROM doc_lines WHERE length(line) > 20),
pairs AS (SELECT a.doc_id * 2147483648 + b.doc_id AS pair_id, a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.line = b.line AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 2)"""
SQL_ALIGNED = SQL_PAIRS + """,
aligned AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.line_no, b.line_no) AS line_no, a.line AS old_text, b.line AS new_text
  FROM (SELECT pair_id, line_no, line FROM pairs JOIN doc_lines ON doc_id = doc_a) a
  FULL JOIN (SELECT pair_id, line_no, line FROM pairs JOIN doc_lines ON doc_id = doc_b) b ON a.pair_id = b.pair_id AND a.line_no = b.line_no)"""
