"""Relevance 0 to 100 and priority levels: one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import recency
from ..functions.text import let
from .classify import MULTI, UNCLASSIFIED

#: Trust in sources.
TRUST = {
    "law_go_kr": 1.0, "kci": 0.95, "nkis": 0.95, "prism": 0.9, "jpri": 0.95, "ioj": 0.9, "kicj": 0.95, "humanrights": 0.9, "nars": 0.95, "kida": 0.9,
    "scienceon": 0.85, "crossref": 0.8, "openalex": 0.75, "doaj": 0.8, "core": 0.75, "semantic_scholar": 0.7, "arxiv": 0.65, "ssrn": 0.7, "zenodo": 0.6, "riss": 0.85,
}
DEFAULT_TRUST = 0.6
#: Substrings that mark practical or educational use.
PRACTICAL = ["실무", "매뉴얼", "가이드", "지침", "사례", "교육", "해설", "제요", "handbook", "guide", "manual", "casebook", "training"]
#: Scores of document types.
TYPE_SCORES = {"법령": 10, "판례": 10, "실무제요": 10, "매뉴얼": 9, "지침": 9, "연구보고서": 8, "학술논문": 7, "정책자료": 6, "간행물": 5, "프리프린트": 5, "기타": 3}
#: Weights of the parts and thresholds of the levels.
WEIGHTS = {"topic_fit": 40.0, "source_trust": 20.0, "recency": 15.0, "practical_use": 10.0, "document_type": 10.0, "open_access": 5.0}
LEVELS = [("P1", 75), ("P2", 55), ("P3", 35)]
LOWEST = "P4"


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(default))


def topic_fit(primary: Column, confidence: Column) -> Column:
    return F.when(primary == UNCLASSIFIED, 0.15).when(primary == MULTI, F.least(F.lit(1.0), 0.55 + confidence)).otherwise(F.least(F.lit(1.0), 0.35 + confidence * 1.2))


def practical_use(hay: Column) -> Column:
    hits = let(hay, lambda h: F.size(F.filter(F.array(*[F.lit(m) for m in PRACTICAL]), lambda m: F.contains(h, m))))
    return F.least(F.lit(1.0), hits * F.lit(0.34))


def open_access(access_mode: Column, oa_url: Column, download_url: Column, license_unknown: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(access_mode == "DOWNLOADED", 1.0).when(filled(oa_url) | filled(download_url), 0.7).when(~F.coalesce(license_unknown, F.lit(True)), 0.5).otherwise(0.2)


def priority(score: Column) -> Column:
    out = F.lit(LOWEST)
    for level, least in reversed(LEVELS):
        out = F.when(score >= least, level).otherwise(out)
    return out


def score(df: DataFrame, today: Column) -> DataFrame:
    """Adds score_breakdown, relevance_score (half-even rounding, 0 to 100) and priority_level."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.lower(F.concat_ws(" ", text("title_ko"), text("title_original"), F.left(text("abstract_original"), F.lit(1000)), F.concat_ws(" ", "keywords")))
    parts = {
        "topic_fit": topic_fit(F.col("topic_primary"), F.col("topic_confidence")),
        "source_trust": lookup(TRUST, F.col("source_id"), DEFAULT_TRUST),
        "recency": recency(F.coalesce("publication_date", "source_registered_date"), today),
        "practical_use": practical_use(hay),
        "document_type": lookup({k: float(v) for k, v in TYPE_SCORES.items()}, F.col("document_type"), float(TYPE_SCORES["기타"])) / max(TYPE_SCORES.values()),
        "open_access": open_access(F.col("access_mode"), F.col("oa_url"), F.col("download_url"), F.col("license_unknown")),
    }
    df = df.withColumns({f"__{k}": v * WEIGHTS[k] for k, v in parts.items()})
    total = sum((F.col(f"__{k}") for k in parts), F.lit(0.0))
    rounded = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(total, 0).cast("int")))
    df = df.withColumn("relevance_score", rounded)
    breakdown = F.struct(F.col("topic_confidence"), *[F.bround(F.col(f"__{k}"), 2).alias(k) for k in parts], F.col("relevance_score").alias("total"))
    return df.withColumns({"score_breakdown": breakdown, "priority_level": priority(F.col("relevance_score"))}).drop(*[f"__{k}" for k in parts])
