"""The queries of this subpackage: thin contracts over its operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import encode_and_decode
from .chunks import repeated_spans
from .common import ship_package
from .fingerprints import BLOCK, fingerprint_edits
from .langid import fit, held_out, predict
from .licenses import PHRASES, TEMPLATES, scan_licenses
from .linefreq import line_frequency_rules
from .maintext import extract_main_text
from .minhash import near_duplicates
from .mixing import mix_sources
from .spelling import spelling_variants
from .urlfilter import judge_urls, rule_table
from .vectorcodes import compress_vectors
from .wacz import archive_and_read


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every text and of its edited text."""
    return fingerprint_edits(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 1, 2, 3, none above 3 times its size."""
    return mix_sources(_read(spark, sf_dir, "documents"), cap=3.0).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The rules of the URL filter's query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(_read(spark, sf_dir, "pages"), rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the labelled rows, predicts every row."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.drop("lang"), fit(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text counts and the verdict by cross-document line frequency."""
    return line_frequency_rules(_read(spark, sf_dir, "documents"))


def op6_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP packages of WARC records and read back."""
    return archive_and_read(_read(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License names and templates in every text."""
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    docs = _read(spark, sf_dir, "documents")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that another document with a smaller doc_id also has."""
    return repeated_spans(_read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 3-word shingle sets with a similarity of 0.85 or more."""
    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries each, 2 rounds."""
    return compress_vectors(_read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the more frequent words that they are one edit from, and where these lead."""
    return spelling_variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_mix_sources,
        op3_url_filters,
        op4_language_id,
        op5_line_frequency,
        op6_warc_packages,
        op7_license_scan,
        op8_byte_level_bpe,
        op9_substring_dedup,
        op10_minhash_near_dedup,
        op11_main_text,
        op12_vector_codes,
        op13_spelling_variants,
    )
}

#: Clusters, merges and chunks have no SQL form: tests hold op4 against a nearest-centroid search by hand, op8
#: against the tiktoken library, op9 against chunks in dictionaries.
ORACLES: dict[str, str] = {
    "op1_document_fingerprints": oracles.fingerprints(BLOCK),
    "op2_mix_sources": oracles.MIX,
    "op3_url_filters": oracles.url_filter(URL_RULES),
    "op5_line_frequency": oracles.LINES,
    "op6_warc_packages": oracles.ARCHIVES,
    "op7_license_scan": oracles.licenses(PHRASES, TEMPLATES),
    "op10_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op11_main_text": oracles.main_text(),
    "op12_vector_codes": oracles.vector_codes(),
    "op13_spelling_variants": oracles.SPELLING,
}
