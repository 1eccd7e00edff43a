"""Runs: windows, tallies, failures."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days looked back by a daily and a monthly run.
DAILY_BACK, MONTHLY_BACK = 3, 45


def last_finished(runs: DataFrame, run_type: str | None = None) -> DataFrame:
    """One row: the start of the last run that finished, whole or in part."""
    done = runs.where("finished_at is not null")
    if run_type:
        done = done.where(F.col("run_type") == run_type)
    return done.agg(F.max("started_at").alias("started_at"))


def run_window(runs: DataFrame, until: date, run_type: str, start: date, since: date | None = None) -> tuple[date, date]:
    """(since, until) of a run: given, configured at the first run or a backfill, 45 days back for a monthly
    run, else 3 days before the last finished run (before the day before, if none finished)."""
    if since:
        return since, until
    row = runs.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("finished_at").isNotNull(), F.col("started_at"))).alias("last")).first()
    if run_type == "BACKFILL" or not row["n"]:
        return start, until
    if run_type == "MONTHLY":
        return until - timedelta(days=MONTHLY_BACK), until
    base = min(row["last"].date(), until) if row["last"] else until - timedelta(days=1)
    return base - timedelta(days=DAILY_BACK), until


def source_since(since: Column, until: Column, lookback_days: Column) -> Column:
    """A source's own start: its look-back may reach further than the run's."""
    return F.least(since, F.date_sub(until, lookback_days - 1))


def tally_measures() -> dict[str, Column]:
    """Counts by outcome and by access mode; n_items counts the outcomes that a tally knows, so neither
    quarantined nor skipped items."""
    of = {"n_items": F.count_if(F.col("outcome").isin("NEW", "UPDATED", "DUPLICATE", "ERROR", "FAILED"))}
    of |= {f"n_{v.lower()}": F.count_if(F.col("outcome") == v) for v in ("NEW", "UPDATED", "DUPLICATE", "ERROR")}
    return of | {f"n_{v.lower()}": F.count_if(F.col("access_mode") == v) for v in ("DOWNLOADED", "LINK_ONLY")}


def run_tally(items: DataFrame, by: str = "source_id") -> DataFrame:
    """``tally_measures``, a row a source."""
    return items.groupBy(by).agg(*[v.alias(n) for n, v in tally_measures().items()])


def failed_sources(errors: DataFrame, since: Column) -> DataFrame:
    return errors.where((F.col("created_at") >= since) & F.col("source_id").isNotNull()).select("source_id").distinct()


def consecutive_failures(attempts: DataFrame, key: str, order: list[str], success: str) -> DataFrame:
    """Failures of each key since its last success.  One aggregation: the last success's place, then the
    rows behind it; no window over a key's history."""
    place = F.struct(*order)
    last = attempts.groupBy(key).agg(F.max(F.when(F.col(success), place)).alias("__last"), F.count(F.lit(1)).alias("n_attempts"))
    rows = attempts.join(last, key)
    behind = (~F.col(success)) & (F.col("__last").isNull() | (place > F.col("__last")))
    return rows.groupBy(key).agg(F.count_if(behind).alias("consecutive_failures"), F.first("n_attempts").alias("n_attempts"))


def running_failures(attempts: DataFrame, key: str, order: list[str], success: str) -> DataFrame:
    """Each attempt with the failures in a row up to it: islands between successes."""
    w = Window.partitionBy(key).orderBy(*order)
    island = attempts.withColumn("__island", F.sum(F.col(success).cast("int")).over(w))
    w = Window.partitionBy(key, "__island").orderBy(*order)
    return island.withColumn("failures_in_a_row", F.sum((~F.col(success)).cast("int")).over(w)).drop("__island")


def changed_in_run(resources: DataFrame, items: DataFrame) -> DataFrame:
    """Resources that a run made or changed, best first."""
    return resources.join(items.where(F.col("outcome").isin("NEW", "UPDATED")), "resource_id", "left_semi").orderBy(F.desc("relevance_score"), "resource_id")


def source_order(sources: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Enabled sources by (priority, id); those that failed before first, where given."""
    on = sources.where("enabled")
    if failed is None:
        return on.orderBy("priority", "source_id")
    marked = on.join(F.broadcast(failed.select("source_id", F.lit(True).alias("failed"))), "source_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return marked.orderBy(F.desc("failed"), "priority", "source_id")


def finish_runs(started: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs (run_id, started_at, status ...) with what their reports (run_id, finished_at, new_count,
    updated_count, failed_sources) say: SUCCEEDED, or PARTIAL where a source failed; runs without a report
    keep their row, RUNNING."""
    r = reports.select("run_id", *[F.col(c).alias(f"__{c}") for c in ("finished_at", "new_count", "updated_count", "failed_sources")])
    out = started.join(r, "run_id", "left")
    done = F.col("__finished_at").isNotNull()
    status = F.when(done, F.when(F.col("__failed_sources") > 0, "PARTIAL").otherwise("SUCCEEDED")).otherwise("RUNNING")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c) if c in started.columns else F.lit(None)) for c in ("finished_at", "new_count", "updated_count", "failed_sources")} | {"status": status}).drop(*[c for c in r.columns if c != "run_id"])


def run_reports(items: DataFrame, errors: DataFrame, finished_at: Column) -> DataFrame:
    """(run_id, finished_at, new_count, updated_count, failed_sources) from run items and errors."""
    counts = items.groupBy("run_id").agg(F.count_if(F.col("outcome") == "NEW").alias("new_count"), F.count_if(F.col("outcome") == "UPDATED").alias("updated_count"))
    failed = errors.where("source_id is not null").groupBy("run_id").agg(F.count_distinct("source_id").alias("failed_sources"))
    out = counts.join(failed, "run_id", "left")
    return out.select("run_id", finished_at.alias("finished_at"), "new_count", "updated_count", F.coalesce("failed_sources", F.lit(0).cast("long")).alias("failed_sources"))


def source_subset(sources: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sources of ``wanted`` (source_id), the ids of it that there are none of)."""
    return sources.join(wanted.select("source_id").distinct(), "source_id", "left_semi"), wanted.join(sources, "source_id", "left_anti").select("source_id").distinct()
