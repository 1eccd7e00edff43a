"""Plug-in points: translators, summarisers and notifiers that a user hands in as plain functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def with_text_hook(df: DataFrame, column: str, out: str, hook: Callable[[str], str | None], fallback: str | None = None) -> DataFrame:
    """``out``: the hook's answer to each text of ``column``; where it fails, answers nothing or the text is
    null or empty, the column ``fallback`` (null without one).  Arrow batches; a failing hook never fails
    the job."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return None
            try:
                return hook(t) or None
            except Exception:  # noqa: BLE001  a plug-in's failure is an answer of its own
                return None

        return texts.map(one)

    return df.withColumn(out, F.coalesce(run(F.col(column)), F.col(fallback) if fallback else F.lit(None).cast("string")))


def notify(counts: DataFrame, send: Callable[[dict], None], send_when_empty: bool = False) -> bool:
    """Hands a briefing's one row of counts to ``send``, unless there is nothing to tell; whether it did."""
    row = counts.first().asDict()
    if not (send_when_empty or row["n_new"] or row["n_updated"] or row["n_failed"]):
        return False
    send(row)
    return True
