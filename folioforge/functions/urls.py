"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, first_filled, text_of

#: Substrings of links that expire.
EPHEMERAL = ["jsessionid", "sessionid", "phpsessid", "tempfile", "token=", "expires="]
#: Content types and their extensions.
EXTENSIONS = [("pdf", ".pdf"), ("hwpx", ".hwpx"), ("hwp", ".hwp"), ("wordprocessingml", ".docx"), ("msword", ".doc"), ("zip", ".zip")]


def is_ephemeral(url: Column) -> Column:
    return contains_any(F.lower(text_of(url)), EPHEMERAL)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def query_parameter(url: Column, name: str) -> Column:
    """Value of a query parameter, empty without it."""
    return F.regexp_extract(text_of(url), rf"[?&]{name}=([^&#]*)", 1)


def riss_control_number(*urls: Column) -> Column:
    return first_filled(*[query_parameter(u, "control_no") for u in urls])


def ssrn_abstract_id(*texts: Column) -> Column:
    """From a landing page's ``abstract_id`` or ``abstract=``, or a DOI's tail."""
    shapes = [r"abstract_?id=([0-9]+)", r"abstract=([0-9]+)", r"ssrn\.([0-9]+)"]
    return first_filled(*[F.regexp_extract(text_of(t), s, 1) for s in shapes for t in texts])


def arxiv_pdf(landing: Column) -> Column:
    return F.replace(landing, F.lit("/abs/"), F.lit("/pdf/"))


def tail(c: Column, separator: str = "/") -> Column:
    return F.substring_index(c, separator, -1)


def extension(content_type: Column, disposition: Column, url: Column) -> Column:
    """By content type, else by the name in Content-Disposition, else by the URL's path, else .pdf."""
    kind, by_type = F.lower(text_of(content_type)), F.lit(None).cast("string")
    for needle, ext in reversed(EXTENSIONS):
        by_type = F.when(F.contains(kind, F.lit(needle)), ext).otherwise(by_type)
    known = r"(?i)\.(pdf|hwpx|hwp|docx|doc|zip)"
    named = F.nullif(F.regexp_extract(text_of(disposition), rf"filename[^;]*?({known[4:]})\"?\s*(?:;|$)", 1), F.lit(""))
    path = F.nullif(F.regexp_extract(F.regexp_replace(text_of(url), "[?#].*$", ""), f"{known}$", 0), F.lit(""))
    return F.lower(F.coalesce(by_type, named, path, F.lit(".pdf")))
