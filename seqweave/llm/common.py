"""What the corpus operators share: the shared folder, text chunks, and word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words in every operator, on the JVM and in Python (``bytes.split``).
WORD = r"[^ \t\n\x0B\f\r]+"
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a local master, as in tests, gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqweave-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Paths of the tables that ``stored`` wrote and nothing has removed, in the order of writing.
_TABLES: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stored``, with the rows in ``buckets`` by a hash of ``key``, so that grouping by it reads them in place, without an exchange.

    Spark writes buckets through its catalog only: a table of a free name stands there until the files are written.
    """
    spark, table = df.sparkSession, f"seqweave_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
        out = spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay, as their path was given
    out._stored_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _TABLES:
        _TABLES.remove(path)


def discard(df: DataFrame | None) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _remove(df.sparkSession, path)


def written() -> list[str]:
    """Paths of the tables in the shared folder; see ``discard_since``."""
    return list(_TABLES)


def discard_since(spark: SparkSession, before: Sequence[str], keep: Sequence[DataFrame] = ()) -> None:
    """Remove the tables written since ``before`` = written(), but for ``keep``.

    An operator's result is lazy and reads its intermediate tables, so only who has stored the result can remove them.
    """
    spared = {*before, *(getattr(df, "_stored_at", None) for df in keep)}
    for path in written():
        if path not in spared:
            _remove(spark, path)


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, with marks behind it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("int")


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` bytes of ``column``; a longer row is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def byte_strings(column: pa.Array) -> list[bytes]:
    """Python bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Index(dict):
    """Numbers keys in the order of first appearance."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Hashes(dict):
    """Keeps a number for each word, made by ``make`` when the word first appears."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells documents apart even where doc_id is null or stands twice; equal rows are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))
