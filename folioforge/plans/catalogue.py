"""The catalogue's dataflow as one chain of DataFrame transformations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import score as S
from ..operators.dedup import resolve_arrivals
from ..operators.policy import acquire, adopt, apply_license
from ..operators.runs import run_tally
from ..operators.summarize import markdown, summarize

TODAY = date(2026, 8, 22)


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def resource_from_documents(docs: DataFrame) -> DataFrame:
    """Synthetic documents as resources: the first line as title, the whole text as abstract, dates by id."""
    day = F.date_add(F.lit(date(2024, 1, 1)), F.pmod("doc_id", F.lit(1500)).cast("int"))
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("resource_id"), F.col("doc_id").alias("seq"), F.col("source").alias("source_id"),
        F.concat("source", F.lit(":"), "doc_id").alias("official_identifier"), F.lit("").alias("doi"), first_line(F.col("text")).alias("title_original"), F.lit("").alias("title_ko"),
        F.col("text").alias("abstract_original"), F.array().cast("array<string>").alias("keywords"), F.col("text").alias("fulltext"), F.lit(False).alias("text_extract_failed"),
        F.col("lang").alias("language"), T.document_type(first_line(F.col("text"))).alias("document_type"), day.alias("publication_date"), F.lit(None).cast("date").alias("source_registered_date"),
        F.date_add(day, F.pmod("doc_id", F.lit(7)).cast("int")).alias("source_modified_date"), F.lit("PENDING").alias("access_mode"), F.lit("").alias("oa_url"), F.lit("").alias("download_url"),
        F.lit(True).alias("license_unknown"), F.lit("").alias("license"), F.concat(F.lit("https://example.org/"), "doc_id").alias("landing_url"),
    )


def flagship(docs: DataFrame, taxonomy: C.Taxonomy = C.DEMO, today: date = TODAY, k: int = 20) -> DataFrame:
    """Documents to resources, classified on the full text, scored; the k most relevant."""
    scored = S.score(C.classify(resource_from_documents(docs), taxonomy, fulltext=True), F.lit(today))
    return scored.select("resource_id", "topic_primary", F.round("topic_confidence", 4).alias("topic_confidence"), "relevance_score", "priority_level").orderBy(F.desc("relevance_score"), "resource_id").limit(k)


def process(resources: DataFrame, facts: DataFrame, taxonomy: C.Taxonomy, today: Column, download: bool = True) -> DataFrame:
    """Licence, adoption, sequential dedup, first classification and score, full-text cascade, second
    classification and score, summary.  ``facts`` are captured by resource_id: policy, oa_candidate,
    link, match, file, file_known, text_known, fulltext.  Duplicates stay in the result, marked by
    verdict; only what goes on is summarised."""
    df = adopt(apply_license(resources))
    df = resolve_arrivals(df)
    df = S.score(C.classify(df, taxonomy), today)
    df = acquire(df.join(facts, "resource_id", "left"), enabled=download)
    df = df.withColumn("fulltext", F.when(F.col("access_mode") == "DOWNLOADED", F.col("fulltext")))
    df = summarize(S.score(C.classify(df, taxonomy, fulltext=True), today))
    return df.withColumn("summary_ko", F.when((F.col("relevance_score") >= 40) & (F.col("verdict") != "DUPLICATE"), markdown(df)))


def tally(processed: DataFrame) -> DataFrame:
    """Counts of a run by source."""
    outcome = F.when(F.col("verdict") == "NEW_VERSION", "UPDATED").otherwise(F.col("verdict"))
    return run_tally(processed.withColumn("outcome", outcome))
