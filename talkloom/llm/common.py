"""Helpers shared by the training-data operators: bounded batch slicing, shared folders, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20


_state: dict = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks. A worker serves many operators in turn, so it
    keeps only the last one's, and gives the memory of the others back."""
    if key not in _state:
        _state.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _state[key] = make()
    return _state[key]


def text_array(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with nulls as empty strings, 64-bit offsets."""
    return batch.column(column).cast(pa.large_string()).fill_null("")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a large_string array, and the n + 1 offsets into them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts Arrow batches into runs of rows of about ``limit`` text bytes (one row at least); nothing is dropped.

    Yields each run with its text column as large_string, nulls as ''.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_array(batch, column)
        _, offs = byte_view(texts)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start), texts.slice(start, end - start)
            start = end


ARROW_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after seeing to it that its session hands Arrow functions at most 8 MB of rows at once (or one row)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(df.sparkSession.conf.get(name, "67108864b")).rstrip("b")) > ARROW_BYTES:
        df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df


#: Folders named so far, in order, and the temporary one of a local session.
_named: list[str] = []
_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``; only where that is unset (tests, local mode) in a temporary one, which goes with the process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="talkloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = f"file://{_local[0]}"
    _named.append(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def named_folders() -> list[str]:
    """The folders that operators of this process have named and not deleted, oldest first."""
    return list(_named)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Deletes tables and files that nothing reads any more."""
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _named.remove(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def list_array(values: np.ndarray | bytes, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A large_list array of ``kind`` from flat values and the lengths of its rows."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    size = int(offsets[-1])
    flat = pa.Array.from_buffers(kind, size, [None, pa.py_buffer(values)])
    return pa.LargeListArray.from_arrays(pa.array(offsets), flat)


def add_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with column ``name`` appended, or replaced if it is there."""
    names, columns = list(batch.schema.names), list(batch.columns)
    if name in names:
        columns[names.index(name)] = values
    else:
        names.append(name)
        columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)
