"""Reports: briefing counts, mail bodies, library statistics, request plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import best_title, html_escape, mask_secrets, text_of
from .ordered import numbered
from .state import Scratch

LIST_CAP = 40


def briefing_counts(resources: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: P1, P2, new, updated and failed sources."""
    counts = resources.agg(*[F.count_if(F.col(c) == v).alias(n) for c, v, n in (("priority_level", "P1", "n_p1"), ("priority_level", "P2", "n_p2"), ("outcome", "NEW", "n_new"), ("outcome", "UPDATED", "n_updated"))])
    return counts.crossJoin(failed.agg(F.count(F.lit(1)).alias("n_failed")))  # one row each


def should_send(counts: DataFrame, send_when_empty: bool = False) -> bool:
    """Whether there is anything to tell: news, or a failed source."""
    r = counts.first()
    return send_when_empty or bool(r["n_new"] or r["n_updated"] or r["n_failed"])


def cards(resources: DataFrame) -> DataFrame:
    """HTML cards of P1 and P2 rows, best first, with a warning where the licence is unknown."""
    title = html_escape(best_title(F.col("title_ko"), F.col("title_original")))
    warning = F.when(F.coalesce("license_unknown", F.lit(True)), "<p class='warn'>라이선스 불명확</p>").otherwise("")
    body = F.concat(F.lit("<div class='card'><h3>["), F.col("priority_level"), F.lit("] "), title, F.lit("</h3><p>"), html_escape(text_of(F.col("summary_ko"))), F.lit("</p>"), warning, F.lit("</div>"))
    return resources.where(F.col("priority_level").isin("P1", "P2")).select("resource_id", "relevance_score", body.alias("html")).orderBy(F.desc("relevance_score"), "resource_id")


def rest_list(resources: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """One row: lines of the other rows up to ``cap`` (a report's length) and how many more there are."""
    rows = resources.where(~F.col("priority_level").isin("P1", "P2"))
    line = F.concat(F.lit("- "), best_title(F.col("title_ko"), F.col("title_original")))
    shown = rows.select(line.alias("line"), "relevance_score", "resource_id").orderBy(F.desc("relevance_score"), "resource_id").limit(cap)
    listed = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("relevance_score")).alias("s"), "resource_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return listed.crossJoin(rows.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("more")))


def markdown_section(markdown: Column, heading: str) -> Column:
    """The lines under ``## heading`` up to the next heading, empty without it."""
    return F.trim(F.regexp_extract(F.concat(markdown, F.lit("\n## ")), rf"(?s)(?:^|\n)## {heading}\n(.*?)\n## ", 1))


def library_stats(topics: DataFrame, resources: DataFrame) -> DataFrame:
    """Stored files a topic, zero for empty ones."""
    stored = resources.where("coalesce(file_path, '') <> ''").groupBy(F.col("topic_primary").alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
    return topics.select("topic_id").join(stored, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("n_files"))


def emit_cap(items: DataFrame, cap: int, by: str = "source_id", order: str = "seq") -> DataFrame:
    """The first rows of each source: a configured limit, 0 meaning none."""
    if not cap:
        return items
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def request_plan(requests: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Requests (method, url, headers) each once, with host and place among its host's, the order in which
    a polite reader sends them.  A host with most of the requests is spread over tasks (``numbered``)."""
    once = requests.dropDuplicates(["method", "url", "headers"]).withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)))
    return numbered(once, "host", ["url", "method", "headers"], "turn", scratch or Scratch(requests.sparkSession))


def with_totals(rows: DataFrame, by: list[str], measures: dict[str, Column], all_: str = "(all)") -> DataFrame:
    """Measures of each group and of the groups above it, the last column of ``by`` summed up first: one
    aggregation over a rollup.  ``all_`` stands for a column that is summed up; null groups stay null."""
    out = rows.rollup(*by).agg(*[v.alias(n) for n, v in measures.items()], *[F.grouping(c).alias(f"__{c}") for c in by])
    return out.select(*[F.when(F.col(f"__{c}") == 1, all_).otherwise(F.col(c)).alias(c) for c in by], *measures)


def by_month(rows: DataFrame, day: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of each month (yyyy-MM), the latest first."""
    return rows.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(*[v.alias(n) for n, v in measures.items()]).orderBy(F.desc("month"))


def figures(*tables: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """One row of measures over several tables, each read once."""
    out = None
    for rows, measures in tables:
        one = rows.agg(*[v.alias(n) for n, v in measures.items()])
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def registered(urls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """URLs that begin with a registered API endpoint (column endpoint): exempt from robots rules."""
    # Endpoints are compared where their host is the URL's, not with all URLs.
    host = lambda c: F.lower(F.regexp_extract(c, "^[^:]*://([^/?#]*)", 1))
    known = endpoints.select("endpoint", host("endpoint").alias("__host")).distinct()
    whole = known.where(F.col("endpoint").rlike("^[^:]*://[^/?#]*[/?#]"))
    urls = urls.withColumn("__at", host("url"))
    exact = urls.join(whole, (urls["__at"] == whole["__host"]) & F.startswith(urls["url"], F.col("endpoint")), "left_semi")
    open_ = known.where(~F.col("endpoint").rlike("^[^:]*://[^/?#]*[/?#]")).select("endpoint")  # begins of hosts: configuration
    rest = urls.join(whole, (urls["__at"] == whole["__host"]) & F.startswith(urls["url"], F.col("endpoint")), "left_anti")
    return exact.union(rest.join(open_, F.startswith(rest["url"], F.col("endpoint")), "left_semi")).drop("__at")


def retry_delays(attempts: int = 3, base: float = 2.0, most: float = 60.0) -> list[float]:
    """Seconds to wait before each further attempt."""
    return [min(most, base * 2**k) for k in range(attempts)]


def source_failures(errors: DataFrame, least: int = 5) -> DataFrame:
    """Sources whose failures in a row reach ``least``: those to warn about."""
    return errors.where(F.col("consecutive_failures") >= least).select("source_id", "consecutive_failures")


def safe_log(lines: DataFrame, column: str = "message", known: list[str] = ()) -> DataFrame:
    return lines.withColumn(column, mask_secrets(F.col(column), known))
