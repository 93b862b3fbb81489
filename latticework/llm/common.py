"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: Runs of anything but space and the five ASCII control characters that are white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a folder of our own only where that is unset."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder, and executors of a cluster share no other")
    if _own_scratch is None:
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="latticework-")
    return _own_scratch


#: Rows of a narrow table that one task writes, and the fewest tasks that write one.
FILE_ROWS, LEAST_FILES = 200_000, 8


def materialize(df: DataFrame, label: str, codec: str = "zstd", most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and a lost executor costs a reread.

    Where ``most_rows`` bounds a narrow table's rows, no more tasks write it than they need, so that small tables don't become hundreds of files.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-most_rows // FILE_ROWS)))
    path = f"{scratch_root(spark)}/latticework/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _scopes:
        made.append(out)
    return out


#: The tables that were written since each scope was opened.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that :func:`materialize` writes while it is open, so that what a finished piece of work leaves can be released as a whole."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]


def release(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once all that reads them is itself written. What a returned frame still reads stays, under the checkpoint folder, for the cluster's own clean-up."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: Session settings for rows that hold whole texts, and the most they may be. Spark buffers an Arrow batch several times over outside the heap, and a reader's batch of long texts is one huge array:
#: with 64 MB and 4096 rows, the defaults, both are too much for small executors.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes to those of SETTINGS where they are above, and lets its Python workers find this package."""
    importable(spark)
    for name, most in SETTINGS.items():
        try:
            now = int(spark.conf.get(name).rstrip("b"))
        except Exception:  # a Spark that has no such setting, or one written in other units by the user
            continue
        if now > most:
            spark.conf.set(name, str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) for a pass in Python, in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def without(docs: DataFrame, keys: list[str], dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose null-safe ``keys`` are not in ``dropped``; Spark broadcasts ``dropped`` only when its measured size allows."""
    d = dropped.select(*[F.col(k).alias(f"__drop_{i}") for i, k in enumerate(keys)])
    same = None
    for i, k in enumerate(keys):
        one = docs[k].eqNullSafe(d[f"__drop_{i}"])
        same = one if same is None else same & one
    return docs.join(d, same, "left_anti")
