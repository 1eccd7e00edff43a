"""Tables of the catalogue: upserts, bridges, manifests and exports, as joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, first_filled, normalize_title

#: Columns that an update changes, and those it fills only where they were empty.
UPDATED = [
    "title_original", "title_ko", "source_modified_date", "landing_url", "download_url", "oa_url", "license", "license_unknown", "access_mode", "topic_primary", "file_path",
    "file_sha256", "text_sha256", "file_size", "text_extract_failed", "summary_ko", "summary_basis", "summary_generated_at", "relevance_score", "priority_level",
    "score_breakdown", "status", "version_of", "error_code", "error_message", "last_seen_at",
]
FILLED = ["work_id", "downloaded_at"]


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str], filled: list[str] = (), empty_is_null: bool = False) -> DataFrame:
    """One full join of a table and new rows on their key: new rows enter whole; rows that exist change in
    ``updated``, and in ``filled`` where the new value is there; every other column keeps its value."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(a, b)
        if c in updated:
            return F.when(is_old, a).otherwise(b)
        if c in filled:
            return F.coalesce(F.nullif(b, F.lit("")) if empty_is_null else b, a)
        return F.when(is_new, b).otherwise(a)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: rows of ``old`` whose keys come again are replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with new keys enter, the first of each in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def topic_bridge(resources: DataFrame) -> DataFrame:
    """(resource_id, topic_id, confidence): the primary topic, then the others, each once."""
    topics = F.filter(F.array_distinct(F.array_prepend(F.coalesce("topics", F.array().cast("array<string>")), F.col("topic_primary"))), lambda t: F.coalesce(t, F.lit("")) != "")
    return resources.select("resource_id", F.explode(topics).alias("topic_id"), F.col("topic_confidence").alias("confidence"))


def source_map(resources: DataFrame) -> DataFrame:
    """(resource_id, source_id, url, role) of every filled URL, the first role of each URL."""
    roles = [("landing_url", "landing"), ("download_url", "download"), ("oa_url", "oa")]
    urls = F.array(*[F.struct(F.col(c).alias("url"), F.lit(r).alias("role"), F.lit(i).alias("ord")) for i, (c, r) in enumerate(roles)])
    rows = resources.select("resource_id", "source_id", F.explode(urls).alias("x")).select("resource_id", "source_id", "x.*").where("coalesce(url, '') <> ''")
    w = Window.partitionBy("resource_id", "source_id", "url").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("resource_id", "source_id", "url", "role")


def works(resources: DataFrame) -> DataFrame:
    """One row a work: first author, year and creation keep the earliest, DOI and titles the latest filled;
    title_norm is the normalised title, by which works are compared."""
    named = first_filled(F.col("title_original"), F.col("title_ko")) if "title_ko" in resources.columns else F.col("title_original")
    resources = resources.withColumns({"__title": F.nullif(named, F.lit("")), "__norm": F.nullif(normalize_title(named), F.lit(""))})
    return resources.where("coalesce(work_id, '') <> ''").groupBy("work_id").agg(
        F.max_by("doi", F.when(F.coalesce("doi", F.lit("")) != "", F.col("last_seen_at"))).alias("doi"), F.max_by("__title", F.when(F.col("__title").isNotNull(), F.col("last_seen_at"))).alias("title"),
        F.max_by("__norm", F.when(F.col("__norm").isNotNull(), F.col("last_seen_at"))).alias("title_norm"),
        F.min_by(F.get("authors", 0), "first_seen_at").alias("first_author"), F.min_by(F.year("publication_date"), "first_seen_at").alias("year"),
        F.min("first_seen_at").alias("created_at"), F.count(F.lit(1)).alias("n_resources"),
    )


def collision_suffix(digest: Column, doi: Column, identity: Column) -> Column:
    """Eight digits that tell files of one name apart: of the file's digest, else of the DOI's, else of the
    identity without dashes."""
    by_doi = F.when(F.coalesce(doi, F.lit("")) != "", F.sha2(doi, 256))
    return F.left(F.coalesce(F.nullif(digest, F.lit("")), by_doi, F.replace(identity.cast("string"), F.lit("-"), F.lit(""))), F.lit(8))


def file_names(rows: DataFrame, folder: str, name: str, order: str, digest: str | Column) -> DataFrame:
    """File paths without collisions: of equal names in a folder all but the first get ``__`` and eight
    digits of their digest (a column, or ``collision_suffix``) before the extension.  A name's first row
    comes from one aggregation, so a name that many files share is not gathered."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    first = rows.groupBy(F.col(folder).alias("__f"), F.col(name).alias("__n")).agg(F.min(order).alias("__first"))
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    out = rows.join(first, F.col(folder).eqNullSafe(F.col("__f")) & F.col(name).eqNullSafe(F.col("__n")))
    return out.withColumn("stored_name", F.when(F.col(order) == F.col("__first"), F.col(name)).otherwise(F.concat(stem, F.lit("__"), F.left(digest, F.lit(8)), ext))).drop("__f", "__n", "__first")


#: What a manifest or an export says of stored files, summaries and licences.
STORED, LINKED, MADE, NOT_MADE, UNCLEAR = "저장", "링크만", "생성", "미생성", "불명확"
SUMMARY_CHARS = 900


def _facts() -> dict[str, Column]:
    """Named expressions over a resource, from which manifest and export choose."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    return {
        "title": first_filled(F.col("title_ko"), F.col("title_original"), F.lit("(제목 없음)")), "authors": joined("authors"), "expanded": joined("query_terms_expanded"),
        "published": text("publication_date"), "registered": text("source_registered_date"), "modified": text("source_modified_date"),
        "stored": F.when(text("file_path") != "", STORED).otherwise(LINKED), "summarised": F.when(text("summary_ko") != "", MADE).otherwise(NOT_MADE),
        "url": first_filled(F.col("landing_url"), F.col("oa_url"), F.col("download_url")),
        "licence": F.when(text("license") != "", F.col("license")).when(F.coalesce("license_unknown", F.lit(True)), UNCLEAR).otherwise(""),
        "summary": F.left(clean_whitespace(F.col("summary_ko")), F.lit(SUMMARY_CHARS)),
    }


#: Column of the manifest or export, and the resource's column or named expression that fills it.
MANIFEST = {
    "수집일": "collected_on", "신규수정구분": "status", "제목": "title", "원문제목": "title_original", "출처": "source_id", "발행기관": "publisher", "발행일": "published", "등록일": "registered",
    "수정일": "modified", "문서유형": "document_type", "주제": "topic_primary", "원문저장여부": "stored", "최종저장경로": "file_path", "링크": "url", "DOI": "doi", "공식ID": "official_identifier",
    "파일해시": "file_sha256", "텍스트해시": "text_sha256", "중요도": "relevance_score", "우선순위": "priority_level", "요약근거수준": "summary_basis", "요약상태": "summarised",
    "발견검색어": "discovered_by_query", "검색어사전버전": "query_dictionary_version", "확장검색어": "expanded", "라이선스": "licence", "오류검토필요": "error_code",
}
EXPORT = {
    "수집일": "collected_on", "상태": "status", "제목": "title", "원문제목": "title_original", "저자": "authors", "발행기관": "publisher", "학술지_시리즈": "journal_or_series", "발행일": "published",
    "등록일": "registered", "수정일": "modified", "출처": "source_id", "문서유형": "document_type", "주제": "topic_primary", "중요도": "relevance_score", "우선순위": "priority_level",
    "원문접근": "access_mode", "저장경로": "file_path", "링크": "url", "OA링크": "oa_url", "DOI": "doi", "공식ID": "official_identifier", "라이선스": "licence", "요약근거수준": "summary_basis",
    "요약": "summary", "발견검색어": "discovered_by_query", "검색어사전버전": "query_dictionary_version", "확장검색어": "expanded", "파일해시": "file_sha256", "오류코드": "error_code",
}


def _rows(resources: DataFrame, layout: dict[str, str], collected: Column) -> DataFrame:
    facts = _facts() | {"collected_on": collected.cast("string")}
    value = lambda c: facts[c] if c in facts else F.col(c) if c == "relevance_score" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return resources.select(*[value(c).alias(name) for name, c in layout.items()])


def manifest_rows(resources: DataFrame, collected_on: Column) -> DataFrame:
    """The manifest's 27 columns of resources; dates in ISO form, missing values as empty strings."""
    return _rows(resources, MANIFEST, collected_on)


def export_rows(resources: DataFrame) -> DataFrame:
    """The export's 29 columns; the summary on one line of 900 characters at most."""
    return _rows(resources, EXPORT, F.to_date("first_seen_at"))


def export_sheets(rows: DataFrame, today: Column) -> dict[str, DataFrame]:
    """The sheets of an export; months are one table, partitioned by ``month`` when written."""
    return {
        "통합목록": rows,
        "오늘수집": rows.where(F.col("collected_on") == today),
        "P1_P2": rows.where(F.col("priority_level").isin("P1", "P2")),
        "오류_검토필요": rows.where(F.coalesce("error_code", F.lit("")) != ""),
        "월별": rows.withColumn("month", F.date_format("collected_on", "yyyy-MM")),
    }


def sheet_names(today: Column) -> Column:
    """The sheets of ``export_sheets`` that a row stands on, months left out: with ``explode`` one pass over the rows."""
    names = {"통합목록": F.lit(True), "오늘수집": F.col("collected_on") == today, "P1_P2": F.col("priority_level").isin("P1", "P2"), "오류_검토필요": F.coalesce("error_code", F.lit("")) != ""}
    return F.array_compact(F.array(*[F.when(on, name) for name, on in names.items()]))


def write_manifest(resources: DataFrame, path: str, run_id: str, collected_on: str, written_at: str | None = None) -> None:
    """Appends a run's records as JSON lines under year and month, each with the time of writing."""
    now = F.lit(written_at) if written_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamped = resources.withColumn("_manifest", F.struct(F.lit(collected_on).alias("collected_on"), F.lit(run_id).alias("run_id"), now.alias("written_at")))
    stamped.withColumns({"year": F.lit(collected_on[:4]), "month": F.lit(collected_on[5:7])}).write.mode("append").partitionBy("year", "month").json(path)


def read_manifest(spark, path: str, schema: str) -> DataFrame:
    """Records of a manifest: damaged lines skipped, of each resource_id that written first (then by run,
    file and line); records without a time of writing count as the oldest."""
    stamp = "_manifest struct<collected_on:string,run_id:string,written_at:string>"
    lines = spark.read.schema(f"{schema}, {stamp}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [c for c in lines.columns if c not in ("_manifest", "_corrupt")]
    order = F.struct(F.coalesce("_manifest.written_at", F.lit("")).alias("w"), F.coalesce("_manifest.run_id", F.lit("")).alias("r"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("b"))
    lines = lines.withColumn("__o", order).where("_corrupt is null and resource_id is not null")
    return lines.groupBy("resource_id").agg(F.min_by(F.struct(*names), "__o").alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in names])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV whose first column name begins with a byte order mark, for spreadsheet programs."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def digest_cards(resources: DataFrame, cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """Cards (P1, P2) and the list of the rest, cut at ``cap``: a report."""
    cards = resources.where(F.col("priority_level").isin("P1", "P2"))
    rest = resources.where(~F.col("priority_level").isin("P1", "P2")).orderBy(F.desc("relevance_score"), "resource_id").limit(cap)
    return cards, rest


def touch(resources: DataFrame, ids: DataFrame, column: str, when: Column) -> DataFrame:
    """``column`` (last_seen_at, alerted_at) set to ``when`` for the resources of ``ids``."""
    named = ids.select(F.col("resource_id").alias("__id")).distinct()
    hit = resources.join(named, resources["resource_id"] == named["__id"], "left")
    return hit.withColumn(column, F.when(F.col("__id").isNotNull(), when).otherwise(F.col(column))).drop("__id")


def newest_first(resources: DataFrame) -> DataFrame:
    """All resources, the last first seen first; a report's order."""
    return resources.orderBy(F.col("first_seen_at").desc_nulls_last(), "resource_id")


def repository_counts(resources: DataFrame, files: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of seven counts, each table aggregated once."""
    of = resources.agg(
        F.count(F.lit(1)).alias("resources"), F.count_if(F.col("access_mode") == "DOWNLOADED").alias("downloaded"), F.count_if(F.col("access_mode") == "LINK_ONLY").alias("link_only"),
        F.count_if(F.col("doi") != "").alias("with_doi"),
    )
    for name, table in (("files", files), ("errors", errors), ("runs", runs)):
        of = of.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return of.select("resources", "files", "downloaded", "link_only", "with_doi", "errors", "runs")


def sync_dimension(old: DataFrame, new: DataFrame, key: str, runtime: list[str]) -> DataFrame:
    """A dimension taken over from configuration: rows of ``new``, with the runtime columns (last
    success, failures) that ``old`` has for them; rows that are only in ``old`` stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c == key else F.col(f"o.{c}") if c in runtime else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


#: Columns of a bibliographic record that a DOI lookup fills where they are empty.
ENRICHED = ["journal_or_series", "publisher", "authors", "publication_date", "work_id"]


def enrich(resources: DataFrame, found: DataFrame, skip: str = "crossref") -> DataFrame:
    """Resources with the columns ``ENRICHED`` filled, where empty, from ``found`` (doi and those columns,
    the least row of a DOI); records without a DOI and those of source ``skip`` pass unchanged."""
    names = [c for c in ENRICHED if c in found.columns and c in resources.columns]
    side = found.where("doi <> ''").groupBy(F.col("doi").alias("__doi")).agg(F.min(F.struct(*names)).alias("__x"))
    out = resources.join(side, (F.col("doi") == F.col("__doi")) & ~F.coalesce(F.col("source_id") == skip, F.lit(False)), "left")

    def filled(c: str) -> Column:
        kind = resources.schema[c].dataType.typeName()
        empty = F.col(c).isNull() if kind == "date" else F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0 if kind == "array" else F.coalesce(c, F.lit("")) == ""
        return F.when(empty, F.coalesce(F.col(f"__x.{c}"), F.col(c))).otherwise(F.col(c))

    return out.withColumns({c: filled(c) for c in names}).drop("__doi", "__x")
