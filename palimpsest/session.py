"""Session helpers: a local session for tests and benches, the shared folder, the package on workers."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: A batch that goes to a Python worker holds at most so many bytes, beyond its last row.
_BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 24


def local_session(app: str = "palimpsest", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver has it on its path. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    if sc.getConf().get(_BATCH_BYTES) is None:
        spark.conf.set(_BATCH_BYTES, MOST_BATCH_BYTES)
    out = os.path.join(tempfile.mkdtemp(prefix="palimpsest-src-"), "palimpsest_src.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, Path("palimpsest") / p.relative_to(_ROOT))
    sc.addPyFile(out)
    sc._palimpsest_shipped = True


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: workers stay from stage to stage, their memory should not."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where unset (tests), a local one is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="palimpsest-shared-")
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return d


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage is cut, and an executor lost later costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() gave, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._palimpsest_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
