"""Helpers that the training-data operators share: tables, scratch tables, batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import zipfile

    root = Path(__file__).resolve().parents[2]
    if not root.is_dir():  # imported from a zip: it was shipped already
        _shipped.add(sc.applicationId)
        return
    out = Path(tempfile.mkdtemp()) / f"palimpsest_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "palimpsest").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='palimpsest')}"
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    ``drop`` removes a table that no later plan reads; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the JVM ended first
                pass


_heavy: dict[object, object] = {}


def heavy[X](key: object, build: Callable[[], X]) -> X:
    """A worker's tokenizer or the like, one at a time: that of an earlier operator goes before the next is built."""
    if key not in _heavy:
        _heavy.clear()
        _heavy[key] = build()
    return _heavy[key]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task[**P, Row](run: Callable[P, Iterator[Row]]) -> Callable[P, Iterator[Row]]:
    """The function of a task, which returns free memory to the system at its end: workers are used again by later stages."""
    @functools.wraps(run)
    def go(*args: P.args, **more: P.kwargs) -> Iterator[Row]:
        try:
            yield from run(*args, **more)
        finally:
            _give_back()

    return go


def held_out(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id's decimal text modulo ``of`` is 2; false where the id is null."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % of == 2, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` characters of ``column`` each, at least one row."""
    sizes, start, total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
