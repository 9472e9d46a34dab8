"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z alone, as the contracts ask; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def fresh(taken, name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (case apart, as Spark reads names)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def prefix(columns, name: str) -> str:
    """``name``, with underscores added until no column begins with it."""
    low = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in low):
        name += "_"
    return name


def without(columns, names) -> list[str]:
    """``columns`` but for those that would clash with ``names``."""
    low = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in low]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in local tests, one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textmend-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and outlives any executor.  ``discard`` frees it; what
    is left goes when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmend-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    atexit.register(_remove, spark, path)
    return out


def discard(*frames: DataFrame | None) -> None:
    for df in frames:
        if df is not None and getattr(df, "_staged_path", None):
            _remove(df.sparkSession, df._staged_path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after its rows were counted against a bound.

    Beyond the bound it is returned as it is, for a shuffled join.  ``df`` should
    be cheap to scan (a staged table).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: How to drop what an operator keeps in a worker from task to task, by the operator's module.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _KEPT[owner] = drop


def release(owner: str) -> None:
    """Drop what operators other than ``owner`` keep in this worker."""
    for name, drop in _KEPT.items():
        if name != owner:
            drop()


def trim() -> None:
    """Give memory that is free in this worker back to the system: idle workers live beside JVM stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package importable in the workers.

    Where driver and workers share a file system that needs no installation; elsewhere
    pass the package with ``--py-files``.
    """
    spark = df.sparkSession
    ship(spark)
    # Texts are long: small batches keep the memory of both sides bounded.
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # unlimited, larger, or with another unit
            spark.conf.set(key, str(most))
    owner = run.__module__

    def tidy(batches):
        release(owner)
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def ship(spark: SparkSession) -> None:
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
