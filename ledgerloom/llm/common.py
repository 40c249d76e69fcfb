"""What the operators of this subpackage share: tables, staged results, hashing of row ids."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: Words are maximal runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on this machine, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
        base = _own_dirs[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder (or path) and read it back: cuts lineage, survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast of a staged table of checked size; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= limit_rows else df


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


#: Rows of an Arrow batch that become Python objects at once: texts can be long.
STEP = 512
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df; its session sends Python at most so many rows at a time from now on, as whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > rows:
        df.sparkSession.conf.set(name, rows)
    return df


def give_back() -> None:
    """Return free memory to the system: a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have none
        ctypes.CDLL(None).malloc_trim(0)


def by_steps(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, step: int = STEP) -> DataFrame:
    """run on frames of at most `step` rows of df, with as many Python objects at once as those need."""
    kind = pa.schema([(name, _KINDS[t]) for name, t in (c.split() for c in schema.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                out = run(batch.slice(i, step).to_pandas())
                yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)
        give_back()

    return small_batches(df).mapInArrow(each, schema)
