"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \t \n \v \f \r.  ``bytes.split()`` splits on the same six.
SPACES = " \t\n\u000b\f\r"

#: Spark's setting that removes the shuffle files of a query when it is through.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, in ``spark.checkpoint.dir``; a session of one machine (tests) may do without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Like :func:`checkpoint`, as a compressed Parquet table; for what is too wide or long for plain checkpoint files.

    The table lies in the session's own checkpoint folder and is removed when the session's process ends.  The shuffle files
    that went into it are removed as soon as it is written.
    """
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, was)
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_of(docs: DataFrame) -> Column:
    """The place of a row of files: a hash of the file's path, and the row's number in it.  The same in every scan."""
    file = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("row"))


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have places in files, else a written copy of it."""
    try:
        docs.select(place_of(docs)).schema
        return docs
    except AnalysisException:
        return materialise(docs)


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a number for each row that is the same in every scan: that of its file, times 2^40, and its number in the file.

    The list of files is taken to the driver, as every scan of them does, and broadcast.
    """
    docs = from_files(docs)
    place = docs.metadataColumn("_metadata")
    files = sorted(r[0] for r in docs.select(place["file_path"]).distinct().collect())
    if len(files) < 2:
        return docs.withColumn(name, place["row_index"])
    path, number = fresh(docs, "_path"), fresh(docs, "_number")
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"{path} string, {number} long")
    held = docs.withColumns({path: place["file_path"], name: place["row_index"]}).join(F.broadcast(numbers), path)
    return held.withColumn(name, F.col(number) * F.lit(1 << 40) + F.col(name)).drop(path, number)


#: Rows up to which the small side of a join (a few numbers a row) is broadcast: some 50 MB.
BROADCAST_ROWS = 1_000_000


def sized_join(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (materialised, narrow), which is broadcast if its counted rows allow it."""
    small = right.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


class Hashes(dict):
    """64-bit hashes of words, none of them 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word) or 1
        return h

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()  # only a cache


def mix(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several columns of such."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for x in columns:
        h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it and wherever the plan moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` starts with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % buckets


def crc_bucket_py(doc_id: int | None, buckets: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % buckets


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8, empty for null."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what a task builds for a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
