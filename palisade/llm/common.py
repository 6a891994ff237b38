"""Helpers that the training-data operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a local test session) a temporary folder is set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not root and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="palisade-"))
    return root or sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/palisade/{uuid.uuid4().hex}/{name}"


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporaries() -> Iterator[None]:
    """Tables that ``write_table`` makes meanwhile are deleted at the end; what is to stay has been written with ``stays`` by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for table in _SCOPES.pop():
            drop_table(table)  # no matter if it has gone before


def write_table(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    if _SCOPES and not stays:
        _SCOPES[-1].append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that no later plan reads."""
    delete_path(df.sparkSession, df._palisade_path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that have ended."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)  # the cleaner has a thread of its own


def attach(rows: DataFrame, dim: DataFrame, key: str, total: int, most: int = 2000, least: int = 256) -> DataFrame:
    """``rows`` left-joined with ``dim``, which has a row a key and ``n``, the key's number of ``rows``; they are ``total`` in all.

    A key of more than ``least`` rows and of more than one in ``most`` of all is joined by broadcast, so that its rows stay where
    they lie; there are fewer than ``most`` such keys, whatever the data.  The other rows are shuffled.
    """
    bar = max(least, total // most)
    hot, other = dim.where(F.col("n") > bar).drop("n"), dim.where(F.col("n") <= bar).drop("n")
    light = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(light)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df`` as the optimizer knows them (no job runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; a null is the empty text."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def added(schema: T.StructType, more: list[T.StructField]) -> T.StructType:
    """``schema`` plus new columns; an input column with the name of a new one gives way to it."""
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + more)


def batches_up_to(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_HELD: dict[str, object] = {}


def held(owner: str, make: Callable[[], object] = dict) -> object:
    """What ``owner`` keeps in this worker from one batch and task to the next.

    Workers live on through the stages of a pipeline, so an owner that comes anew takes the place of the one before: only
    one operator's memory is kept, and freed memory is given back to the system.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[owner] = make()
    return _HELD[owner]


class Memory(dict):
    """Results by key.  A full one is emptied between rows; results are only worked out anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def fill(self, keys: list, learn) -> list:
        """Results of ``keys``; ``learn(key)`` works out one that is not known."""
        if len(self) > self.most:
            self.clear()
        row = list(map(self.get, keys))
        if None in row:
            for i in [i for i, x in enumerate(row) if x is None]:
                key = keys[i]
                x = self.get(key)
                if x is None:
                    x = self[key] = learn(key)
                row[i] = x
        return row
