"""What the operators of this subpackage share: tables in the shared folder, row keys, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between ASCII blanks, as in `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one is set in local
    mode, as in tests; on a cluster executors wouldn't see it, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="citelume-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: later reads don't compute it again and survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders below the shared one that this driver has named for intermediate tables.
_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def release(spark: SparkSession, since: int = 0, to: int | None = None, keep: tuple[str, ...] = ()) -> None:
    """Deletes the intermediate tables named since then (up to then) but for those to keep. Results that still read them can't
    be computed any more."""
    for path in _SCRATCH[since:to]:
        if path not in keep:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _SCRATCH[since:to] = keep


def named() -> int:
    """How many intermediate tables there are: what release() takes."""
    return len(_SCRATCH)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets the executors delete the shuffle files of jobs that nothing refers to any more, as their results are stored. They
    would stay until the driver's heap happens to be collected, which takes long where the driver does little."""
    gc.collect()  # what Python still holds of them
    spark._jvm.System.gc()


def text_of(column: str = "text") -> F.Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(source: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about most_bytes, a row at least, so that memory follows the slice and not the batch."""
    for batch in source:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(batch.nbytes, 1))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system. Workers outlive their tasks, and would keep what the hungriest of them needed. Once
    a task is enough: to get the pages again takes time."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where there is such a library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sieved(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows of docs whose text is kept, in the columns they came with, whatever their names. make() is called once in a
    task; what it returns says for an array of texts which to keep."""
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in batches(source):
            yield b.filter(pa.array(keep(b.column(at)), pa.bool_()))

    plain = docs.toDF(*names)  # a name with a dot can't be given to a function over batches
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
