"""Readers: captured payload files, XML records, JSON envelopes, documents in ZIP containers."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_NO_QUERY = "cast(null as struct<canonical_ko:string,language:string,terms:array<string>,dictionary_version:string,query_string:string>) as query"


def raw_json_lines(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Raw items of a file with one JSON payload a line."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.lit(source_id).alias("source_id"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("payload"), F.expr(_NO_QUERY))


def xml_records(pages: DataFrame, tag: str) -> DataFrame:
    """(payload) of every <tag> element of XML pages (column xml), as text."""
    found = F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))
    return pages.select("*", F.posexplode(found).alias("pos", "element")).drop("xml")


def atom_entries(pages: DataFrame) -> DataFrame:
    """Atom pages (source_id, seq, xml) to raw items with JSON payloads: one entry a row."""
    def one(name: str) -> Column:
        return F.xpath_string("element", F.lit(f"//*[local-name()='{name}']"))

    def many(name: str, inner: str) -> Column:
        return F.xpath("element", F.lit(f"//*[local-name()='{name}']{inner}"))

    rows = xml_records(pages, "entry")
    payload = F.to_json(F.struct(*[one(n).alias(n) for n in ("id", "title", "summary", "published", "updated", "doi", "journal_ref")], many("author", "/*[local-name()='name']/text()").alias("authors"), many("category", "/@term").alias("categories")))
    return rows.select("source_id", (F.col("seq") * 100_000 + F.col("pos")).alias("seq"), payload.alias("payload"), F.expr(_NO_QUERY))


#: Ends of links to documents.
DOCUMENT_ENDS = ("pdf", "hwp", "hwpx", "docx")


def rss_items(pages: DataFrame) -> DataFrame:
    """RSS pages (source_id, seq, xml) to raw items as ``payloads.feed`` reads them: one <item> a row."""
    def one(*names: str) -> Column:
        tried = [F.nullif(F.trim(F.xpath_string("element", F.lit(f"//*[local-name()='{n}']"))), F.lit("")) for n in names]
        return F.coalesce(*tried, F.lit(""))

    rows = xml_records(pages, "item")
    links = F.filter(F.xpath("element", F.lit("//*[local-name()='enclosure']/@url")), lambda u: F.lower(u).rlike(rf"\.({'|'.join(DOCUMENT_ENDS)})$"))
    payload = F.struct(
        one("title").alias("title"), one("link").alias("link"), one("description", "summary").alias("summary"), one("pubDate", "published", "updated", "date").alias("published"),
        one("author", "creator").alias("author"), one("guid", "id", "link").alias("id"), links.alias("enclosures"), F.xpath("element", F.lit("//*[local-name()='category']/text()")).alias("tags"),
    )
    return rows.select("source_id", (F.col("seq") * 100_000 + F.col("pos")).alias("seq"), F.to_json(payload).alias("payload"), F.expr(_NO_QUERY))


#: The elements of Dublin Core.
DUBLIN_CORE = ["title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights"]


def oai_records(pages: DataFrame) -> DataFrame:
    """OAI-PMH pages to raw items; deleted records are left out."""
    rows = xml_records(pages, "record").where(~F.col("element").rlike(r"<header[^>]*status=\"deleted\""))
    values = [F.xpath("element", F.lit(f"//*[local-name()='metadata']//*[local-name()='{n}']/text()")).alias(n) for n in DUBLIN_CORE]
    head = [F.xpath_string("element", F.lit(f"//*[local-name()='header']/*[local-name()='{x}']")).alias(y) for x, y in (("identifier", "oai_identifier"), ("datestamp", "datestamp"))]
    return rows.select("source_id", (F.col("seq") * 100_000 + F.col("pos")).alias("seq"), F.to_json(F.struct(*values, *head)).alias("payload"), F.expr(_NO_QUERY))


def resumption_token(xml: Column) -> Column:
    return F.trim(F.regexp_extract(xml, r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1))


def flat_xml_records(pages: DataFrame, tag: str) -> DataFrame:
    """Elements with plain children to raw items: names to texts."""
    rows = xml_records(pages, tag)
    pairs = F.regexp_extract_all("element", F.lit(r"(?s)<([^\s<>/]+)[^<>]*>(?:<!\[CDATA\[(.*?)\]\]>|([^<]*))</\1>"), F.lit(0))
    entry = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^<([^\s<>/]+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"(?s)^<[^<>]*>(?:<!\[CDATA\[)?", ""), r"(?:\]\]>)?</[^<>]+>$", "").alias("v")))
    first = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, 1, i), lambda x: x["k"] == e["k"]))
    return rows.select("source_id", (F.col("seq") * 100_000 + F.col("pos")).alias("seq"), F.to_json(F.map_from_entries(first)).alias("payload"), F.expr(_NO_QUERY))


def _records(value) -> list[dict]:
    """Rows of an envelope: the first dict with a list ``row``, else the largest list of dicts that are no
    status blocks."""
    best: list[dict] = []
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            if isinstance(v.get("row"), list):
                return [r for r in v["row"] if isinstance(r, dict)]
            todo += list(v.values())
        elif isinstance(v, list):
            rows = [r for r in v if isinstance(r, dict) and not {"RESULT", "list_total_count"} & set(r)]
            if len(rows) > len(best) and len(rows) == len(v):
                best = rows
            todo += v
    return best


@F.pandas_udf(ArrayType(StringType()))
def envelope_rows(payload: pd.Series) -> pd.Series:
    """JSON texts of the records somewhere in an envelope: a walk of unknown depth, which SQL can't say."""

    def rows(p):
        try:
            return [json.dumps({k: None if v is None else str(v) for k, v in r.items()}, ensure_ascii=False) for r in _records(json.loads(p))]
        except (TypeError, ValueError):
            return []

    return payload.map(rows)


_SPACE = re.compile(r"\s+")
_TAGS = re.compile(r"<[^>]+>")
TEXT_CHARS, CHARS_A_PAGE = 400_000, 40


def _zip_text(raw: bytes | None, suffix: str) -> dict:
    out = {"text": "", "members": None, "failed": True, "reason": "empty"}
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            names = z.namelist()
            out["members"] = names
            wanted = ["word/document.xml"] if suffix == ".docx" else sorted(n for n in names if n.startswith("Contents/") and n.endswith(".xml"))
            text = " ".join(_TAGS.sub(" ", z.read(n).decode("utf-8", "replace")) for n in wanted if n in names)
        text = _SPACE.sub(" ", text).strip()[:TEXT_CHARS]
        return out | {"text": text, "failed": not text, "reason": "" if text else "no text"}
    except Exception as e:  # noqa: BLE001  a damaged file is a result, not a failed job
        return out | {"reason": f"{type(e).__name__}: {e}"[:200]}


@F.pandas_udf(StructType().add("text", "string").add("members", ArrayType(StringType())).add("failed", "boolean").add("reason", "string"))
def zip_document(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    """Text and member names of DOCX and HWPX files."""
    return pd.DataFrame([_zip_text(c, s) for c, s in zip(content, suffix)], columns=["text", "members", "failed", "reason"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: (path, suffix, size, sha256, content, text, members, failed, reason)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    files = files.select("path", suffix.alias("suffix"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    return files.withColumn("x", zip_document("content", "suffix")).select("path", "suffix", "size", "sha256", "content", "x.*")


def failed_extraction(text: Column, pages: Column) -> Column:
    """Whether a text is too thin for its pages, so that it must be read by OCR."""
    return F.length(F.coalesce(text, F.lit(""))) < CHARS_A_PAGE * F.greatest(pages, F.lit(1))
