"""Shared helpers of the corpus operators: durable tables, word splitting, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows of a few numbers may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bounds of a batch that goes to Python: rows can hold whole texts and sets.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ARROW_BOUNDS; they are never raised or set back, so that jobs of one
    session don't disturb each other."""
    for key, most in ARROW_BOUNDS.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or the warehouse where that is unset. A folder of one machine is
    refused unless the driver runs the tasks itself."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/_quillmark"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # one file less: its name is known to no one else
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing lazy depends on any more."""
    path = getattr(df, "_quillmark_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint when the counted rows are within the bound; else the plain side (shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers and strings as a local relation: no job, no Python worker."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = [c.strip().split(" ") for c in schema.split(",")]
    listed = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM VALUES {listed} AS v({', '.join(n for n, _ in names)})")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def longs(values: np.ndarray) -> pa.Array:
    """uint64 or int64 values as an Arrow int64 array."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
