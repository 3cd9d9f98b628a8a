"""Streaming: an image's two tag halves arrive in any order; the image commits once both are there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_COMMITS = "ref string, layout string, `index` string, error string"


def consume_halves(arrivals: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """``ref, layout, index, error``: one row each time both halves of an image have come, from a stream of (ref, kind
    'layout' or 'index', body, seq).

    The state holds the one half that waits, and nothing once both are there: a completed pair is taken out, so it is
    given once, and a half that comes later begins a pair of its own. Of one kind's halves that wait the last by ``seq``
    counts. With ``expire_ms`` a half that has waited so long without a partner is given up and told as a row with an
    error; the state never outgrows the images that are under way. Rows without ref or body, and other kinds, are passed
    over.
    """
    waits = expire_ms is not None

    def step(key: tuple, batches, state: GroupState):
        held = dict(zip(("layout", "index"), state.get)) if state.exists else {}
        done = []
        if state.hasTimedOut:
            done.append((key[0], held.get("layout"), held.get("index"), "expired"))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for kind, body in zip(rows["kind"], rows["body"]):
                held[kind] = body
                if held.get("layout") is not None and held.get("index") is not None:
                    done.append((key[0], held["layout"], held["index"], None))
                    held = {}
            if any(v is not None for v in held.values()):
                state.update((held.get("layout"), held.get("index")))
                if waits:
                    state.setTimeoutDuration(expire_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(done, columns=["ref", "layout", "index", "error"], dtype=object)

    rows = arrivals.where(F.col("ref").isNotNull() & F.col("body").isNotNull() & F.col("kind").isin("layout", "index")).select("ref", "kind", "body", "seq")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if waits else GroupStateTimeout.NoTimeout
    return rows.groupBy("ref").applyInPandasWithState(step, _COMMITS, "layout string, `index` string", "append", timeout)


def start_commits(arrivals: DataFrame, commit, checkpoint: str, available_now: bool = True, expire_ms: int | None = None):
    """Starts the query: ``commit(DataFrame)`` gets each batch's images whose halves are both there, each pair in one
    batch only. It must be idempotent (content-addressed writes are): that batch runs again after a failure."""
    ready = lambda batch, _: commit(batch.where("error is null").drop("error"))
    writer = consume_halves(arrivals, expire_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(ready)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
