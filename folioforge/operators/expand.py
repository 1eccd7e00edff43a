"""Query expansion from a dictionary of search terms, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_ignoring_case

#: Terms in a query, and queries of a source by its priority.
TERMS, CAPS = 6, {1: 12, 2: 8, 3: 5}

TERM_SCHEMA = (
    "canonical_ko string, variants_ko array<string>, related_ko array<string>, terms_en array<string>, acronyms array<string>, "
    "scope array<string>, topic_id string, priority int, exclude_terms array<string>, verified boolean"
)


def _quoted(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))


def korean_terms() -> Column:
    return distinct_ignoring_case(F.concat(F.array("canonical_ko"), F.coalesce("variants_ko", F.array().cast("array<string>"))))


def english_terms() -> Column:
    return distinct_ignoring_case(F.concat(F.coalesce("terms_en", F.array().cast("array<string>")), F.coalesce("acronyms", F.array().cast("array<string>"))))


def boolean_query(terms: Column, limit: int = TERMS) -> Column:
    """The first terms, phrases quoted, joined by OR; null without any."""
    return F.nullif(F.array_join(_quoted(F.slice(terms, 1, limit)), " OR "), F.lit(""))


def build_queries(terms: DataFrame, language: str, cap: int, scope: str | None = None) -> DataFrame:
    """(canonical_ko, query, topic_id, ord): built queries by (priority, canonical_ko, query, topic_id), at most
    ``cap``, so equal ones of several topics come in one order however the rows lie; language ko, en or multi.
    Terms without a query don't count."""
    if scope:
        terms = terms.where(F.array_contains("scope", scope))
    ko, en = boolean_query(korean_terms()), boolean_query(english_terms())
    multi = F.when(en.isNull(), ko).otherwise(F.concat(F.lit("("), ko, F.lit(") OR ("), en, F.lit(")")))
    built = terms.select("canonical_ko", {"ko": ko, "en": en, "multi": multi}[language].alias("query"), "topic_id", "priority").where("query is not null")
    order = ["priority", "canonical_ko", "query", "topic_id"]
    first = built.orderBy(*order).limit(cap)  # so the window numbers ``cap`` rows
    return first.withColumn("ord", F.row_number().over(Window.orderBy(*order))).select("canonical_ko", "query", "topic_id", "ord")


def missing_terms(terms: DataFrame, required: DataFrame) -> DataFrame:
    """Required keywords (term) that no dictionary entry names, as canonical, variant or related."""
    known = terms.select(F.explode(F.concat(F.array("canonical_ko"), F.coalesce("variants_ko", F.array().cast("array<string>")), F.coalesce("related_ko", F.array().cast("array<string>")))).alias("term"))
    return required.join(known, "term", "left_anti")


def quality_report(terms: DataFrame) -> DataFrame:
    """Entries to look at: international ones without English, unverified ones."""
    lacking = F.array_contains("scope", "international") & (F.coalesce(F.size("terms_en"), F.lit(0)) == 0)
    return terms.select("canonical_ko", F.coalesce(lacking, F.lit(False)).alias("lacks_english"), (~F.coalesce("verified", F.lit(False))).alias("unverified")).where("lacks_english or unverified")
