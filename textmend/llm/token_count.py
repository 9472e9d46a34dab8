"""Token counts by rank-synchronous array merging, with no tokens made.

Texts are cut into units at word starts, where no piece can reach over.  Each Python
worker keeps the counts of units it has seen (up to ``CACHE`` of them, then it starts
anew); units new to a batch are merged together as ragged numpy arrays, every unit's
best pair in the same round, and their surviving symbols are counted.  A map over the
rows: no shuffle, no driver state.

Edge cases: null and empty texts have 0 tokens; characters without a piece count as
their bytes; special strings are plain text; long unbroken texts are merged by a heap;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import arrow_map, table

OVER, CACHE = 4096, 300_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, *, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    path = path or model_path()

    def run(batches):
        v = vocab.load(path)
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                units = [v.units(t) if t else [] for t in texts]
                new = set().union(*units).difference(known)
                if new:
                    if len(known) + len(new) > CACHE:
                        known.clear()
                        new = set(chain.from_iterable(units))
                    new = list(new)
                    known.update(zip(new, v.counts(new)))
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array([sum(map(get, u)) for u in units], pa.int64())],
                    names=[id_col, "n_bytes", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op2_token_count(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > OVER)
