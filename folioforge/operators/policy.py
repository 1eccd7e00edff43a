"""Licences, access policy, links, pages and files: ordered CASE expressions over captured facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_contained, first_filled, jaccard, normalize_doi, normalize_title, page_title, text_of, title_tokens
from ..functions.urls import is_ephemeral, riss_control_number, ssrn_abstract_id

#: Substrings of open licences, of KOGL licences, and of pages behind a wall.
OPEN_LICENSES = ["cc-by", "cc by", "cc0", "creativecommons", "public domain", "publicdomain", "open government licence", "mit", "apache-2.0"]
KOGL = ["공공누리", "kogl", "제1유형", "제2유형", "제3유형", "제4유형"]
PAYWALLS = [
    "로그인이 필요합니다", "로그인 후 이용", "회원가입", "유료 결제", "구독 신청", "기관인증",
    "login required", "please log in", "sign in to continue", "purchase this article", "subscribe to access", "access denied",
]
#: File signatures and HTML marks, in hexadecimal or text; content types of documents.
PDF, OLE, ZIP = "255044462D", "D0CF11E0A1B11AE1", "504B0304"
EXECUTABLES = ["4D5A", "7F454C46", "CAFEBABE", "2321"]
HTML = ["<!doctype html", "<html", "<head", "<script"]
DOCUMENT_TYPES = [
    "application/pdf", "application/x-pdf", "application/haansofthwp", "application/vnd.hancom.hwp", "application/vnd.hancom.hwpx",
    "application/octet-stream", "application/zip", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
TITLE_MATCH, BODY_CHARS, LEAST_BYTES, MOST_BYTES = 0.35, 200_000, 1024, 200 * 1024 * 1024


def assess_license(text: Column, source_policy: Column | None = None) -> Column:
    """struct<license_name, is_open, redistributable, note> of a licence string."""
    name = F.trim(text_of(text))
    low = F.lower(name)
    is_cc, is_kogl = contains_any(low, OPEN_LICENSES), contains_any(low, KOGL)
    by_policy = F.lit(False) if source_policy is None else F.coalesce(source_policy == "allowed", F.lit(False))
    case = lambda empty, cc, kogl, allowed, rest: F.when(name == "", empty).when(is_cc, cc).when(is_kogl, kogl).when(by_policy, allowed).otherwise(rest)
    free = ~(F.contains(low, F.lit("-nd")) | F.contains(low, F.lit("noderiv")))
    first = F.contains(name, F.lit("제1유형")) | F.contains(low, F.lit("type1"))
    return F.struct(
        name.alias("license_name"),
        case(F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(False)).alias("is_open"),
        case(F.lit(False), free, first, F.lit(False), F.lit(False)).alias("redistributable"),
        case(*[F.lit(n) for n in ("unknown", "open", "kogl", "source_policy", "unclear")]).alias("note"),
    )


def apply_license(df: DataFrame, policy: str | None = None) -> DataFrame:
    """Licences of resources trimmed, license_unknown by assessment (it overrides the source's)."""
    df = df.withColumn("__a", assess_license(F.col("license"), F.col(policy) if policy else None))
    return df.withColumns({"license": F.col("__a.license_name"), "license_unknown": ~F.col("__a.is_open")}).drop("__a")


def access_decision(policy: Column, kind: Column, is_open: Column, url: Column, license: Column, route: Column | None = None) -> Column:
    """struct<allowed, reason, error_code> of downloading a candidate: link-only sources never, manual
    review not by itself, open-access-only sources need an open copy, landing pages (by the candidate's
    kind, not its URL) are no files.  ``route``: ssrn needs an open licence and another site than its own,
    and asks nothing else; riss forbids its own site before the rest."""
    low, route = F.lower(text_of(url)), F.lit(None).cast("string") if route is None else route
    open_, ssrn = F.coalesce(is_open, F.lit(False)), F.coalesce(route == "ssrn", F.lit(False))
    own = F.when(policy == "link_only", "link_only").when(~open_ | (text_of(license) == ""), "no_open_license").when(F.contains(low, F.lit("ssrn.com")), "own_site")
    rest = (
        F.when((route == "riss") & F.contains(low, F.lit("riss.kr")), "own_site")
        .when(policy == "link_only", "link_only")
        .when(policy == "manual_review", "manual_review")
        .when((policy == "oa_only") & ~open_, "not_open")
        .when(kind == "LANDING_PAGE", "landing_page")
    )
    reason = F.when(ssrn, own).otherwise(rest)
    return F.struct(reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.when(reason.isNotNull(), "POLICY_BLOCKED").alias("error_code"))


def routed_policy(landing: Column, doi: Column, download: Column) -> Column:
    """Which special policy rules a record: ssrn before riss; null without."""
    hay = F.lower(F.concat_ws(" ", text_of(landing), text_of(doi), text_of(download)))
    return F.when(contains_any(hay, ["ssrn.com", "10.2139/ssrn"]), "ssrn").when(F.contains(hay, F.lit("riss.kr")), "riss")


def adopt(df: DataFrame) -> DataFrame:
    """Records of SSRN and RISS found elsewhere, under their rules.

    ssrn: canonical landing page, identifier and (if missing) DOI, publisher SSRN where empty; without a
    known licence no download and open-access URL and LINK_ONLY.  riss: identifier only where empty, URLs
    of its own site blanked, LINK_ONLY if none is left.  Other records pass unchanged."""
    df = df.withColumn("__p", routed_policy(F.col("landing_url"), F.col("doi"), F.concat_ws(" ", "download_url", "oa_url")))
    number, control = ssrn_abstract_id(F.col("landing_url"), F.col("doi")), riss_control_number(F.col("landing_url"), F.col("download_url"))
    is_ssrn, is_riss = F.coalesce(F.col("__p") == "ssrn", F.lit(False)), F.coalesce(F.col("__p") == "riss", F.lit(False))
    closed = is_ssrn & F.coalesce("license_unknown", F.lit(True))
    empty = lambda c: text_of(F.col(c)) == ""
    at_riss = lambda c: is_riss & F.contains(F.lower(text_of(F.col(c))), F.lit("riss.kr"))
    url = lambda c: F.when(closed | at_riss(c), "").otherwise(F.col(c))
    values = {
        "official_identifier": F.when(is_ssrn & (number != ""), F.concat(F.lit("ssrn:"), number)).when(is_riss & (control != "") & empty("official_identifier"), F.concat(F.lit("riss:"), control)).otherwise(F.col("official_identifier")),
        "landing_url": F.when(is_ssrn & (number != ""), F.concat(F.lit("https://papers.ssrn.com/sol3/papers.cfm?abstract_id="), number)).otherwise(F.col("landing_url")),
        "doi": F.when(is_ssrn & (number != "") & empty("doi"), F.concat(F.lit("10.2139/ssrn."), number)).otherwise(F.col("doi")),
        "download_url": url("download_url"),
        "oa_url": url("oa_url"),
        "access_mode": F.when(closed | (is_riss & (text_of(url("download_url")) == "") & (text_of(url("oa_url")) == "")), "LINK_ONLY").otherwise(F.col("access_mode")),
    }
    if "publisher" in df.columns:
        values["publisher"] = F.when(is_ssrn & empty("publisher"), "SSRN").otherwise(F.col("publisher"))
    return df.withColumns(values).drop("__p")


def paywall_marker(html: Column) -> Column:
    """The first marker of a wall, in list order, in the first 200,000 characters; empty without."""
    return F.coalesce(first_contained(F.lower(F.left(text_of(html), F.lit(BODY_CHARS))), PAYWALLS), F.lit(""))


def link_access(url: Column, status: Column, content_type: Column, body: Column) -> Column:
    """struct<valid, error_code> of a captured fetch."""
    wall = F.contains(F.lower(text_of(content_type)), F.lit("text/html")) & (paywall_marker(body) != "")
    code = (
        F.when(~text_of(url).rlike("^https?://"), "LINK_EXPIRED")
        .when(is_ephemeral(url), "LINK_EXPIRED")
        .when(status.isin(401, 403), "LOGIN_REQUIRED")
        .when(F.coalesce(status, F.lit(0)) != 200, "LINK_EXPIRED")
        .when(wall, "PAYWALL")
    )
    return F.struct(code.isNull().alias("valid"), code.alias("error_code"))


def page_match(html: Column, doi: Column, identifier: Column, expected: Column, unicode_form: bool = True) -> Column:
    """struct<valid, reason, similarity, error_code> of a landing page against a record; a mismatch counts
    as an expired link."""
    title, html = page_title(html), text_of(html)
    alike = jaccard(title_tokens(normalize_title(expected, unicode_form)), title_tokens(normalize_title(title, unicode_form)))
    has_doi = (text_of(doi) != "") & F.contains(F.lower(html), normalize_doi(doi))
    tail = F.substring_index(text_of(identifier), ":", -1)
    has_id = (text_of(identifier) != "") & F.contains(html, tail)
    reason = F.when(html == "", "no_html").when(has_doi, "doi").when(has_id, "identifier").when((title == "") | (text_of(expected) == ""), "no_title").when(alike >= TITLE_MATCH, "title").otherwise("mismatch")
    return F.struct((reason != "mismatch").alias("valid"), reason.alias("reason"), F.when(reason.isin("title", "mismatch"), alike).alias("similarity"), F.when(reason == "mismatch", "LINK_EXPIRED").alias("error_code"))


def file_check(content: Column, size: Column, suffix: Column, content_type: Column, members: Column) -> Column:
    """struct<valid, reason, quarantine, error_code> of a file by size, signature and extension.
    ``members`` is the array of names in a ZIP (null: not one).  What is missing or has a wrong signature
    or structure for its extension is FILE_CORRUPTED, all else that fails FILE_NOT_DOCUMENT."""
    head = F.hex(F.substring(content, 1, 2048))
    text = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    is_ = lambda magic: F.startswith(head, F.lit(magic))
    executable = F.lit(False)
    for magic in EXECUTABLES:
        executable = executable | is_(magic)
    has = lambda name: F.coalesce(F.array_contains(members, name), F.lit(False))
    contents = F.coalesce(F.exists(members, lambda m: F.startswith(m, F.lit("Contents/"))), F.lit(False))
    kind = F.lower(text_of(content_type))
    reason = (
        F.when(content.isNull(), "missing")
        .when(size < LEAST_BYTES, "too_small")
        .when(size > MOST_BYTES, "too_large")
        .when(executable, "executable")
        .when(contains_any(text, HTML), "html")
        .when(suffix == ".pdf", F.when(~is_(PDF), "no_pdf_signature"))
        .when(suffix == ".hwpx", F.when(members.isNull(), "bad_zip").when(~(has("Contents/content.hpf") | contents), "no_document"))
        .when(suffix == ".hwp", F.when(~(is_(OLE) | is_(ZIP)), "no_hwp_signature"))
        .when(suffix == ".docx", F.when(members.isNull(), "bad_zip").when(~has("word/document.xml"), "no_document"))
        .when((kind != "") & ~contains_any(kind, DOCUMENT_TYPES), "content_type")
    )
    code = F.when(reason.isin("missing", "no_pdf_signature", "no_hwp_signature", "bad_zip", "no_document"), "FILE_CORRUPTED").when(reason.isNotNull(), "FILE_NOT_DOCUMENT")
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.coalesce(reason == "executable", F.lit(False)).alias("quarantine"), code.alias("error_code"))


def resolve_open_copy(df: DataFrame, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds oa_candidate and oa_resolver: the record's own open URL if its licence is known, else the first
    lookup (name, table of doi and url) with a URL for its DOI."""
    own = F.when(~F.coalesce("license_unknown", F.lit(True)), F.nullif(F.col("oa_url"), F.lit("")))
    df = df.withColumns({"oa_candidate": own, "oa_resolver": F.when(own.isNotNull(), "record")})
    for name, table in lookups:
        side = table.where("doi <> '' and url <> ''").groupBy(F.col("doi").alias("__doi")).agg(F.min("url").alias("__url"))
        df = df.join(side, (F.col("doi") == F.col("__doi")) & F.col("oa_candidate").isNull(), "left")
        df = df.withColumns({"oa_resolver": F.coalesce("oa_resolver", F.when(F.col("__url").isNotNull(), name)), "oa_candidate": F.coalesce("oa_candidate", "__url")}).drop("__doi", "__url")
    return df


#: Scores below which nothing is fetched or summarised.
DOWNLOAD_SCORE, SUMMARY_SCORE = 55, 40


def acquire(df: DataFrame, enabled: bool = True, threshold: int = DOWNLOAD_SCORE) -> DataFrame:
    """The full-text cascade over resources joined with captured facts: policy, oa_candidate, link, match
    and file (structs as above), file_known, text_known, and optionally kind, oa_kind (DIRECT_FILE or
    LANDING_PAGE), oa_license, page (whether the fetch gave HTML), download (struct success, error_code),
    extract_failed.

    The candidate is the record's own URL (none for link-only sources, SSRN and RISS), else the resolved
    open copy.  Adds outcome (the step that ended the cascade), access_mode, error_code (the record's),
    log_code (what the error log gets; policy blocks only stand there, page mismatches and duplicates only
    with the record) and status QUARANTINED where a file is an executable.  Every miss ends as a link."""
    have = lambda c, d: F.col(c) if c in df.columns else d
    text = F.lit(None).cast("string")
    route = routed_policy(F.col("landing_url"), F.col("doi"), F.col("download_url"))
    own = F.when((F.col("policy") == "link_only") | route.isNotNull(), "").otherwise(first_filled(F.col("download_url"), F.col("oa_url")))
    mine, candidate = own != "", first_filled(own, F.col("oa_candidate"))
    open_ = F.when(mine, ~F.coalesce("license_unknown", F.lit(True))).otherwise(True)
    kind = F.coalesce(F.when(mine, have("kind", text)).otherwise(have("oa_kind", text)), F.lit("DIRECT_FILE"))
    licence = F.when(mine, F.col("license")).otherwise(first_filled(have("oa_license", text), F.col("license")))
    decision = access_decision(F.col("policy"), kind, open_, candidate, licence, route)
    download = have("download", F.struct(F.lit(True).alias("success"), text.alias("error_code")))
    file_code = F.col("file.error_code") if "error_code" in df.schema["file"].dataType.names else F.lit("FILE_NOT_DOCUMENT")
    failed = F.coalesce(have("extract_failed", F.lit(False)), F.lit(False))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    step = (
        F.when(~F.lit(enabled), "disabled")
        .when(F.col("relevance_score") < threshold, "low_score")
        .when(candidate == "", "no_candidate")
        .when(~decision["allowed"], "policy")
        .when(no(F.col("link.valid")), "link")
        .when(~F.coalesce(F.col("match.valid"), F.lit(True)), "page_mismatch")
        .when((kind == "LANDING_PAGE") & F.coalesce(have("page", F.lit(False)), F.lit(False)), "landing_page")
        .when(no(download["success"]), "download")
        .when(no(F.col("file.valid")), F.when(F.col("file.quarantine"), "quarantine").otherwise("file"))
        .when(F.coalesce(F.col("file_known"), F.lit(False)), "duplicate_file")
        .when(~failed & F.coalesce(F.col("text_known"), F.lit(False)), "duplicate_text")
        .otherwise("downloaded")
    )
    df = df.withColumns({"outcome": step, "__download": download["error_code"], "__file": file_code, "__failed": failed})
    bad = F.when(F.col("outcome") == "link", F.col("link.error_code")).when(F.col("outcome") == "download", F.col("__download")).when(F.col("outcome").isin("file", "quarantine"), F.col("__file"))
    code = F.coalesce(bad, F.when(F.col("outcome") == "page_mismatch", "LINK_EXPIRED").when(F.col("outcome").isin("duplicate_file", "duplicate_text"), "DUPLICATE_FILE"))
    log = F.coalesce(bad, F.when(F.col("outcome") == "policy", "POLICY_BLOCKED").when((F.col("outcome") == "downloaded") & F.col("__failed"), "TEXT_EXTRACTION_FAILED"))
    new = {"error_code": code, "log_code": log, "access_mode": F.when(F.col("outcome") == "downloaded", "DOWNLOADED").otherwise("LINK_ONLY")}
    if "status" in df.columns:
        new["status"] = F.when(F.col("outcome") == "quarantine", "QUARANTINED").otherwise(F.col("status"))
    return df.withColumns(new).drop("__download", "__file", "__failed")


def first_needle(hay: Column, needles: Column, excluded: Column) -> Column:
    """The first of ``needles`` (array of structs needle, excludes) contained in ``hay`` none of whose
    excludes is; ``excluded`` applies to all.  Null without one."""
    hay = F.lower(hay)
    fits = F.filter(needles, lambda x: F.contains(hay, F.lower(x["needle"])) & ~F.exists(F.concat(x["excludes"], excluded), lambda e: F.contains(hay, F.lower(e))))
    return F.get(fits, 0)["needle"]
