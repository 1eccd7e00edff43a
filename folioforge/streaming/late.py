"""Verdicts of a stream whose rows come late: each row is judged when nothing before it can come any more."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def version_stream(stream: DataFrame, key: str, modified: str, order: str, time: str, look_back: str, forget: str | None = None) -> DataFrame:
    """(key, order, verdict, base) of a stream of records: NEW, DUPLICATE or NEW_VERSION as ``version_fold``
    gives them in the order of (``time``, ``order``), in whatever order they come within ``look_back``.

    State of a key: the rows that wait for the watermark, the first row's date, the last accepted row.  When the
    watermark has passed a row, its verdict goes out; rows later than that are dropped.  ``forget``: a key
    without rows for so long behind the watermark loses its state, and begins anew; never, if it isn't given.
    ``order`` is a whole number, ``modified`` a date or null, ``time`` a timestamp; null keys are one key."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.withWatermark(time, look_back).select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.unix_date(modified).cast("long").alias("m"), F.unix_millis(F.col(time).cast("timestamp")).alias("t"), F.col(time).alias("at"))
    keep = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def judge(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, first, top, base = ([], None, None, None) if not state.exists else (json.loads(state.get[0]), *json.loads(state.get[1]))
        for batch in batches:
            waiting += [[int(t), int(o), None if pd.isna(m) else int(m)] for t, o, m in zip(batch["t"], batch["o"], batch["m"])]
        mark = state.getCurrentWatermarkMs()
        ready, waiting = sorted(x for x in waiting if x[0] <= mark), [x for x in waiting if x[0] > mark]
        out = []
        for _, o, m in ready:
            if first is None:
                verdict, first = "NEW", [m]
            elif first[0] is not None and m is not None and top is not None and m > top:
                verdict = "NEW_VERSION"
            else:
                verdict = "DUPLICATE"
            out.append((names[0], o, verdict, base))
            top = m if top is None else max(top, m if m is not None else top)
            base = base if verdict == "DUPLICATE" else o
        if not waiting and not ready and state.hasTimedOut:
            state.remove()
        else:
            state.update((json.dumps(waiting), json.dumps([first, top, base])))
            if waiting:
                state.setTimeoutTimestamp(max(mark + 1, min(x[0] for x in waiting)))
            elif keep is not None:
                state.setTimeoutTimestamp(mark + keep)
        if out:
            yield pd.DataFrame(out, columns=["k", "o", "verdict", "base"]).astype({"base": "Int64"})

    found = rows.groupBy("k").applyInPandasWithState(judge, f"k {kinds[key]}, o long, verdict string, base long", "waiting string, said string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k").alias(key), F.col("o").alias(order), "verdict", "base")
