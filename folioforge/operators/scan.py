"""What a scan does around its source: windows, plans of requests, matching of queries, where paging stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_window
from .ordered import last_before


def within(df: DataFrame, since, until, *days: str) -> DataFrame:
    """Rows whose latest of ``days`` lies in the window, both ends included; rows without a date pass."""
    day = F.greatest(*[F.col(d) for d in days]) if len(days) > 1 else F.col(days[0])
    return df.where(in_window(day, since, until))


def by_year(queries: DataFrame, since: Column, until: Column) -> DataFrame:
    """A request a query and year of the window."""
    return queries.withColumn("year", F.explode(F.sequence(F.year(since), F.year(until))))


def by_target(targets: DataFrame, queries: DataFrame) -> DataFrame:
    """A request a target and query; both are small tables of configuration, the targets broadcast."""
    return queries.crossJoin(F.broadcast(targets))


def match_queries(df: DataFrame, text: Column, queries: DataFrame, annotate: bool = False) -> DataFrame:
    """``df`` with discovered_by_query: the query of the first term (in the order of ``queries``: ord,
    query_string, terms, exclude_terms) that the text contains.

    A term whose query has an excluded term in the text is passed over, and rows without any term go.
    With ``annotate`` nothing is excluded, rows without a term stay and get the first query.  The terms
    are configuration: one array, broadcast as one row; without any, the first query is every row's."""
    terms = F.coalesce(F.nullif(F.col("terms"), F.array().cast("array<string>")), F.array("query_string"))
    each = queries.select("ord", "query_string", F.coalesce("exclude_terms", F.array().cast("array<string>")).alias("no"), F.posexplode(terms).alias("k", "t"))
    each = each.withColumn("t", F.lower(F.trim(F.replace("t", F.lit('"'), F.lit(""))))).where("t <> ''")
    one = each.agg(F.array_sort(F.collect_list(F.struct("ord", "k", "t", "no", "query_string"))).alias("__terms"))
    one = one.crossJoin(queries.agg(F.min_by("query_string", "ord").alias("__first")))
    rows = df.crossJoin(F.broadcast(one)).withColumn("__text", F.lower(F.coalesce(text, F.lit(""))))
    fits = F.filter("__terms", lambda x: F.contains(F.col("__text"), x["t"]) & (F.lit(annotate) | ~F.exists(x["no"], lambda e: F.contains(F.col("__text"), F.lower(e)))))
    found = F.get(fits, 0)["query_string"]
    if annotate:
        found = F.coalesce(found, F.col("__first"))
    else:
        found = F.when(F.size("__terms") == 0, F.col("__first")).otherwise(found)
    out = rows.withColumn("discovered_by_query", found).drop("__terms", "__first", "__text")
    return out if annotate else out.where("discovered_by_query is not null")


def read_pages(rows: DataFrame, since, page_size: int, most_pages: int | None = 5) -> DataFrame:
    """Rows (query_string, page, published) up to the page at which a reader stops: a page that isn't
    full, or a full one whose dated rows are all older than ``since``; ``most_pages`` at most, a limit of
    the source (None: none).  Of the rows, those with a date before ``since`` go."""
    pages = rows.groupBy("query_string", "page").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("latest"))
    ends = (F.col("n") < page_size) | F.coalesce(F.col("latest") < since, F.lit(False))
    last = pages.groupBy("query_string").agg(F.min(F.when(ends, F.col("page"))).alias("__last"))
    rows = rows.where(F.col("page") <= most_pages) if most_pages else rows
    kept = rows.join(last, "query_string").where((F.col("__last").isNull() | (F.col("page") <= F.col("__last"))))
    return kept.where(F.col("published").isNull() | (F.col("published") >= since)).drop("__last")


def drop_repeats(rows: DataFrame, identifier: str, title: str, order: list[str]) -> DataFrame:
    """The first row of each identifier, or of each title where there is none; rows with neither all stay."""
    key = F.coalesce(F.nullif(F.col(identifier), F.lit("")), F.concat(F.lit("title:"), F.nullif(F.col(title), F.lit(""))))
    rows = rows.withColumn("__key", key)
    w = Window.partitionBy("__key").orderBy(*order)
    first = rows.where("__key is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.unionByName(rows.where("__key is null")).drop("__key")


def answered(captures: DataFrame) -> DataFrame:
    """Captured answers (url, at, status, tag, body) with the body that each stands for: its own, or of a 304 the
    one of the latest earlier 200 of its URL with the same tag; ``stale`` marks 304s for which there is none.
    A URL that a third of all answers ask for is cut into slices of time (``last_before``)."""
    rows = captures.withColumns({"__k": F.when(F.col("status") == 304, F.concat_ws("\x1f", "url", F.coalesce("tag", F.lit("")))), "__o": F.unix_micros(F.col("at").cast("timestamp"))})
    full = captures.where("status = 200").select(F.concat_ws("\x1f", "url", F.coalesce("tag", F.lit(""))).alias("__k"), F.unix_micros(F.col("at").cast("timestamp")).alias("__o"), F.struct("body", "at").alias("__full"))
    out = last_before(rows, full, "__k", "__o", "__full")
    found = F.col("__full").isNotNull()
    return out.withColumns({"body": F.when(F.col("status") == 304, F.col("__full.body")).otherwise(F.col("body")), "body_from": F.when(F.col("status") == 304, F.col("__full.at")).when(F.col("status") == 200, F.col("at")), "stale": (F.col("status") == 304) & ~found}).drop("__k", "__o", "__full")
