"""Small tables: local rows without a job, and results that are written once and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation: no job and no Python worker. Values are null, booleans, numbers and strings."""

    def show(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(show, v))})"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    fields = [c.strip().split(" ", 1) for c in schema.split(",")]
    chosen = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    if not rows:
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {t}) AS {n}' for n, t in fields)} WHERE false")
    listed = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {chosen} FROM VALUES {listed} AS v({', '.join(n for n, _ in fields)})")


def written(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir, else the warehouse) and read back: what
    several parts of a plan use is computed once, and a lost executor repeats no more than the reading."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/_quillmark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A registry table of at most this many rows is broadcast.
REGISTRY_ROWS = 100_000


def registry_side(df: DataFrame, most: int = REGISTRY_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows, counted up to the bound, are within it; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bounds of a batch that goes to Python: rows hold whole texts.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to BATCH_BOUNDS; they are never raised or set back."""
    for key, most in BATCH_BOUNDS.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
