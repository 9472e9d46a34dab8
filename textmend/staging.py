"""Tables between steps, written to the folder that driver and executors share.

A written table cuts the lineage, survives lost executors and keeps plans small where
one result feeds several branches.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in a local session that names none, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textmend-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


_SCOPES: list["Scope"] = []


class Scope:
    """The tables staged while it is open; what is not kept goes when it closes."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a staged table to the scope around this one (or to the end of the interpreter)."""
        mine = [m for m in self.made if m[1] == getattr(df, "_staged_path", None)]
        self.made = [m for m in self.made if m not in mine]
        outer = _SCOPES[_SCOPES.index(self) - 1] if self in _SCOPES and _SCOPES.index(self) else None
        if outer is not None:
            outer.made += mine
        else:
            for m in mine:
                atexit.register(_remove, *m)
        return df


@contextmanager
def scope():
    """Removes the tables staged inside when it ends: use it around a run whose result has been written."""
    s = Scope()
    _SCOPES.append(s)
    try:
        yield s
    finally:
        _SCOPES.remove(s)
        for m in s.made:
            _remove(*m)


def stage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].made.append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def small(df: DataFrame, rows: int = 2_000_000, size: int = 64 << 20) -> DataFrame:
    """A staged table, marked for broadcast if its files hold at most ``size`` bytes and it at most ``rows`` rows."""
    return F.broadcast(df) if held(df) <= size and df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame) -> int:
    """Bytes of a staged table's files, as the plan has them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to: executors then delete the shuffle files of finished plans."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Let local workers import this package; on a cluster pass it with ``--py-files``."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
