"""Sources: tables of pages, blocks, lines and regions, change logs, recognised words, and binary documents by plug-in.

Text and layout recognition are not part of the engine. A plug-in is a function from bytes to rows, run where Spark reads the
files; everything behind it is the same for any source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions.style import style_of_span
from palimpsest.functions.text import nfc

STYLE = "struct<font:string,size:double,bold:boolean,italic:boolean,color:array<int>>"
WORD = f"struct<text:string,bbox:{G.BOX},confidence:double,style:{STYLE}>"
SCHEMAS = {
    "docs": "doc_id bigint, source_path string, sha16 string, doc_kind string, engine string, n_pages int",
    "pages": "doc_id bigint, page_num int, width double, height double, method string, line_method string, engine string, is_ocr boolean",
    "blocks": f"doc_id bigint, page_num int, block_idx int, text string, bbox {G.BOX}, style {STYLE}, confidence double, words array<{WORD}>",
    "lines": f"doc_id bigint, page_num int, line_no int, line_id string, reading_order int, text string, bbox {G.BOX}, confidence double",
    "regions": f"doc_id bigint, page_num int, kind string, region int, bbox {G.BOX}, cells array<array<string>>, table_confidence double",
    "pairs": "pair_id bigint, doc_a bigint, doc_b bigint",
    "truth": f"pair_id bigint, truth_id int, page int, region string, diff_type string, change_type string, severity string, description string, before string, after string, bbox {G.BOX}",
}
#: A word as a page's text layer gives it.
RAW_WORD = "doc_id bigint, page_num int, block_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int"


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables of SCHEMAS under a folder, as far as they are there."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            out[name] = spark.read.format(fmt).schema(schema).load(f"{path}/{name}")
        except Exception as e:  # a folder may hold some of them only
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def validate_paths(paths: list[str], endings: tuple[str, ...] = (".pdf",)) -> list[str]:
    bad = [p for p in paths if not p.lower().endswith(endings)]
    if bad:
        raise ValueError(f"unsupported files: {bad[:5]}")
    return paths


def page_range(start: int, end: int, most: int = 120) -> tuple[int, int]:
    if start < 0 or end < start or end - start > most:
        raise ValueError(f"page range {start} to {end} is not valid")
    return start, end


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id, source_path, sha16, content of files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), G.file_hash("content").alias("sha16"), "content")


def extracted(documents: DataFrame, extractor: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a plug-in finds in each document, with its doc_id and status: ok, empty, or what went wrong."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc_id, content in zip(pdf.doc_id, pdf.content, strict=True):
                try:
                    got = extractor(content)
                    rows += [{"doc_id": doc_id, "status": "ok", **g} for g in got] or [{"doc_id": doc_id, "status": "empty"}]
                except Exception as e:
                    rows.append({"doc_id": doc_id, "status": f"failed: {type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["doc_id", "status", *names], dtype=object)

    return documents.select("doc_id", "content").mapInPandas(run, f"doc_id bigint, status string, {schema}")


def lines_of_words(words: DataFrame) -> DataFrame:
    """Raw words (RAW_WORD) as blocks, one a line of the text layer: text composed, box, first style, words, reading order."""
    keys = ["doc_id", "page_num", "block_no", "line_no"]
    style = style_of_span("font", "size", "flags", "color")
    word = F.struct(nfc("text").alias("text"), G.corner_box("x0", "y0", "x1", "y1").alias("bbox"), F.lit(1.0).alias("confidence"), style.alias("style"))
    rows = words.withColumns({"_w": word, "_b": G.corner_box("x0", "y0", "x1", "y1")})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.col("x0").alias("x0"), F.to_json("_w").alias("j"), F.col("_w").alias("w")))), lambda t: t["w"])
    out = rows.groupBy(*keys).agg(ordered.alias("words"), G.union_box("_b").alias("bbox"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(F.col("bbox.y"), F.col("bbox.x"))) - 1
    first = F.try_element_at("words", F.lit(1))["style"]
    return out.select("doc_id", "page_num", order.alias("block_idx"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), "bbox", first.alias("style"), F.lit(1.0).alias("confidence"), "words")


def ocr_words(data: DataFrame, scale: float = 1.0, least_confidence: float = 0.0) -> DataFrame:
    """Recognised words from rows with level, block_num, par_num, line_num, word_num, left, top, width, height, conf, text; level 5 is a word."""
    share = G.parse_confidence(F.col("conf").cast("string"))["share"]
    box = G.pixel_box("left", "top", "width", "height", F.lit(scale))
    rows = data.filter("level = 5").withColumns({"bbox": box, "confidence": share})
    return rows.filter((F.trim("text") != "") & F.col("bbox").isNotNull() & (F.col("confidence") >= least_confidence))


def char_boxes_to_words(chars: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with the box of their characters: word n takes as many characters, in order, as it is long.

    chars: keys, char_no (from 0), bbox; words: keys, word_no, text. Both in reading order, without blanks.
    """
    from pyspark.sql import Window

    end = F.sum(F.length("text")).over(Window.partitionBy(*keys).orderBy("word_no"))
    spans = words.withColumn("_end", end).withColumn("_char", F.explode(F.sequence(F.col("_end") - F.length("text"), F.col("_end") - 1)))
    met = spans.join(chars.select(*keys, F.col("char_no").alias("_char"), "bbox"), [*keys, "_char"], "left")
    return met.groupBy(*keys, "word_no", "text").agg(G.union_box("bbox").alias("bbox"))


_CHANGE = "struct<page:int,region:string,diff_type:string,change_type:string,severity:string,description:string,before:string,after:string,old_text:string,new_text:string,bbox:string>"


def change_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Truth rows of change-log files (JSON, one a pair): unknown kinds are content and modified; strict also defaults the page to 1."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    log = F.from_json("value", f"original_pdf string, modified_pdf string, pair_id string, changes array<{_CHANGE}>")
    rows = raw.select("file", log.alias("l")).select("file", "l.original_pdf", "l.modified_pdf", F.posexplode("l.changes").alias("truth_id", "c"))
    return rows.select("file", F.xxhash64("file").alias("pair_id"), "original_pdf", "modified_pdf", "truth_id", *truth_columns("c", strict))


def truth_columns(c: str, strict: bool = False) -> list[Column]:
    """A change of a log as columns."""
    k = F.col(c)
    kind = lambda v, known, other: F.when(v.isin(*known), v).otherwise(F.lit(other))
    page = F.coalesce(k["page"], F.lit(1)) if strict else k["page"]
    return [
        page.alias("page"),
        k["region"].alias("region"),
        kind(k["diff_type"], ("added", "deleted", "modified"), "modified").alias("diff_type"),
        kind(k["change_type"], ("content", "formatting", "layout", "visual"), "content").alias("change_type"),
        k["severity"].alias("severity"),
        k["description"].alias("description"),
        F.coalesce(k["before"], k["old_text"]).alias("before"),
        F.coalesce(k["after"], k["new_text"]).alias("after"),
        G.from_json_any(k["bbox"], F.lit(1.0), F.lit(1.0)).alias("bbox"),
    ]


def bench_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, input_path, truth of files with a gt.txt in their folder, or a .gt.txt or .txt of their own name beside them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    texts = files.filter(F.col("name").endswith(".txt")).withColumn("truth", F.col("content").cast("string"))
    inputs = files.filter(F.lower("name").rlike(r"\.(pdf|png|jpe?g|tiff?)$")).select("path", "folder", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    shared = texts.filter("name = 'gt.txt'").select("folder", F.col("truth").alias("_shared"))
    own = texts.filter("name <> 'gt.txt'").select("folder", F.regexp_replace("name", r"(\.gt)?\.txt$", "").alias("stem"), F.when(F.col("name").endswith(".gt.txt"), 0).otherwise(1).alias("k"), "truth").groupBy("folder", "stem").agg(F.min_by("truth", "k").alias("_own"))
    out = inputs.join(own, ["folder", "stem"], "left").join(shared, "folder", "left").withColumn("truth", F.coalesce("_shared", "_own"))
    return out.filter("truth is not null").select(F.regexp_replace("path", r"\.[^./]*$", "").alias("sample_id"), F.col("path").alias("input_path"), "truth").orderBy("sample_id")


def write_json(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partitions or [])).json(path)


def debug_dump(path: str, run_id: str, **tables: DataFrame) -> None:
    """Each table as JSON under the run's folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/run_id={run_id}/{name}")


def run_metadata(spark: SparkSession, **args: str) -> DataFrame:
    """One row: when, with which versions, with which arguments."""
    import platform

    row = {"spark_version": spark.version, "python_version": platform.python_version(), "platform": platform.platform(), "arguments": {k: str(v) for k, v in args.items()}}
    return spark.createDataFrame([row], "spark_version string, python_version string, platform string, arguments map<string,string>").withColumn("started", F.current_timestamp())
