"""What the operators of this subpackage share: word patterns, intermediate tables, hash buckets."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's regular expressions: a run of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is
    unset (tests on one machine) a temporary folder of this process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="folioforge-"))
        atexit.register(remove, spark, _own[0])
    return _own[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders through Hadoop's file systems, whatever store they are in."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a context, so that a cluster needs no install."""
    sc = spark.sparkContext
    if getattr(sc, "_folioforge_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/folioforge.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(archive)
    sc._folioforge_shipped = True


class Tables:
    """Intermediate results as Parquet tables in the shared folder.

    A written table cuts the lineage: a lost executor costs its running tasks, never an earlier
    stage.  ``clear()`` deletes the tables that no returned DataFrame reads; the others go when the
    driver exits.

    Files are few: while a table is written, AQE merges small shuffle partitions up to the advisory
    size, not just up to one a core, and where the number of rows is known (``rows``), tasks are
    merged to ``ROWS_A_FILE`` each.  On a local file system Hadoop starts a process for each file.
    """

    ROWS_A_FILE = 200_000

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.paths, self.count = spark, {}, 0
        self.root = f"{shared_folder(spark)}/folioforge/{what}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def put(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        self.paths.setdefault(name, []).append(path)
        if rows is not None:
            df = df.coalesce(1 + rows // self.ROWS_A_FILE)
        key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *names: str) -> None:
        for name in names:
            remove(self.spark, *self.paths.pop(name, []))


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` of a mapInArrow, which hands freed memory back to the system after each batch and at its
    end: Python workers outlive their tasks, and what their allocators keep counts against the executor."""

    @functools.wraps(run)
    def giving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc's alone
        try:
            for batch in run(batches):
                yield batch
                del batch
                trim(0)
        finally:
            pa.default_memory_pool().release_unused()
            trim(0)

    return giving


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most so many bytes of a text or binary column, and so many rows
    (one at least), so that what a task makes of a slice is bounded however long the texts are."""
    for whole in batches:
        ends = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy().astype("int64").cumsum()
        at = 0
        while at < whole.num_rows:
            to = int(ends.searchsorted((ends[at - 1] if at else 0) + size, side="right"))
            to = max(at + 1, min(to, at + rows))
            yield whole.slice(at, to - at)
            at = to


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows: the check before each broadcast here."""
    return df.limit(rows + 1).count() <= rows


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_tag() -> Column:
    """What tells the texts of rows with one doc_id, or without one, apart: a 64-bit hash."""
    return F.xxhash64(text_or_empty().cast("string")).alias("tag")


def named(docs: DataFrame) -> list[Column]:
    """All columns of ``docs`` as columns, whatever signs their names have."""
    return [F.col(quoted(c)) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
