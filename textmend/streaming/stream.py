"""Streams of texts, corrected as they come, and sessions with a time to live.

Correction has no state across texts, so each micro-batch is a batch run and the
results equal it; sessions live in keyed state that times out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correct
from ..operators.lexicon import Lexicon
from ..script import ScriptProfile
from ..staging import scope


def correct_stream(texts: DataFrame, lexicon: Lexicon, p: ScriptProfile, sink, checkpoint: str | None = None, *, id_col="doc_id", text_col="text", trigger: dict | None = None):
    """Start a query that gives each micro-batch's corrected texts to ``sink(df, batch_id)``.

    Tables of a batch are removed once the sink has returned.  ``trigger``: as for
    ``DataStreamWriter.trigger``, micro-batches as fast as they come by default.
    """

    def each(batch: DataFrame, batch_id: int):
        with scope():
            sink(correct.correct(batch, lexicon, p, id_col=id_col, text_col=text_col).texts(), batch_id)

    w = texts.writeStream.foreachBatch(each)
    w = w.trigger(**trigger) if trigger else w
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def settled(edits: DataFrame, *, quiet: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """The last text of each burst of edits (session_id, ts, text): a burst ends after a quiet spell."""
    w = F.session_window("ts", quiet)
    return edits.withWatermark("ts", late).groupBy("session_id", w).agg(F.max_by("text", "ts").alias("text"), F.count("*").alias("edits"))


SESSION = "session_id string, upload_path string, total_pages int, stage string, percent int, events long"


def sessions(events: DataFrame, *, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Latest state per session from (session_id, ts, upload_path, total_pages, stage, percent).

    A session that gets no event for ``ttl`` of event time is dropped.
    """
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        # Of each field the last value that is set, and when it was said: late events change nothing newer.
        up, up_at, pages, pages_at, stage, percent, at, n = state.get if state.exists else (None, -1, None, -1, None, 0, -1, 0)
        for f in frames:
            f = f.sort_values("ts", kind="stable")
            n += len(f)
            for ts, u, m, s, pc in zip(f.ts, f.upload_path, f.total_pages, f.stage, f.percent):
                t = int(ts.value // 1000)
                if u is not None and not pd.isna(u) and t >= up_at:
                    up, up_at = u, t
                if not pd.isna(m) and t >= pages_at:
                    pages, pages_at = int(m), t
                if t >= at:
                    stage, percent, at = s, int(pc), t
        state.update((up, up_at, pages, pages_at, stage, percent, at, n))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame({"session_id": [key[0]], "upload_path": [up], "total_pages": pd.array([pages], "Int32"), "stage": [stage], "percent": [percent], "events": [n]})

    state = "upload_path string, upload_at long, total_pages int, pages_at long, stage string, percent int, at long, events long"
    return events.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, SESSION, state, "update", "EventTimeTimeout")
