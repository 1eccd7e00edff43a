"""Normalisers: raw payloads of each source (JSON or XML text) to resources, as projections.

A payload is parsed once into VARIANT; paths are typed with ``try_variant_get``, so a damaged or odd
payload gives nulls, never a failed job.  Rows without a title are dropped, as are Crossref rows
without a DOI.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import date_from_parts, parse_date
from ..schema import as_resources
from .readers import envelope_rows

_PEOPLE = "array<struct<name:string,display_name:string,given:string,family:string>>"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("__v"), path, kind)


def _clean(path: str) -> Column:
    return T.clean_whitespace(_get(path))


def _first_of(path: str) -> Column:
    """A string, or the first of an array of strings."""
    values = _get(path, "array<string>")
    return T.clean_whitespace(F.when(values.isNotNull(), F.get(values, 0)).otherwise(_get(path)))


def _strings(path: str, limit: int | None = None) -> Column:
    out = F.filter(F.transform(_get(path, "array<string>"), T.clean_whitespace), lambda x: x != "")
    return F.slice(out, 1, limit) if limit else out


def _people(path: str, text: Column) -> Column:
    """Names of an array of objects, else of an array of strings, else of one string."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(T.authors_from_structs(_get(path, _PEOPLE))), some(_strings(path)), T.authors_from_string(text))


def _project(df: DataFrame, values: dict[str, Column], identifier: Column) -> DataFrame:
    """Common fields: ids, query provenance, language and type by title where a source gives none."""
    title = values["title_original"]
    doi = values.get("doi", F.lit(""))
    common = {
        "source_id": F.col("source_id"),
        "resource_id": F.sha2(F.concat_ws("|", "source_id", F.coalesce(F.nullif(identifier, F.lit("")), F.col("seq").cast("string"))), 256),
        "work_id": T.work_id(doi, identifier, T.normalize_title(title), F.year(values.get("publication_date", F.lit(None).cast("date")))),
        "source_type": F.lit("OPEN_API"),
        "official_identifier": identifier,
        "query_original": F.col("query.canonical_ko"),
        "query_language": F.col("query.language"),
        "query_terms_expanded": F.col("query.terms"),
        "query_dictionary_version": F.col("query.dictionary_version"),
        "discovered_by_query": F.col("query.query_string"),
    }
    return as_resources(df.where(title != ""), common | values)


def crossref(raw: DataFrame) -> DataFrame:
    doi, title = T.normalize_doi(_get("$.DOI")), _first_of("$.title")
    licence = F.get(F.filter(F.transform(_get("$.license", "array<struct<URL:string>>"), lambda x: T.clean_whitespace(x["URL"])), lambda u: u != ""), 0)
    known = T.contains_any(F.lower(T.text_of(licence)), ["creativecommons.org", "opensource.org"])
    pdf = F.filter(_get("$.link", "array<struct<URL:string,`content-type`:string>>"), lambda x: F.lower(x["content-type"]) == "application/pdf")
    day = lambda p: parse_date(_get(p))
    values = {
        "title_original": title, "doi": doi, "authors": T.authors_from_structs(_get("$.author", _PEOPLE)), "publisher": _clean("$.publisher"),
        "journal_or_series": _first_of("$['container-title']"), "publication_date": date_from_parts(F.get(_get("$.issued['date-parts']", "array<array<int>>"), 0)),
        "source_registered_date": day("$.created['date-time']"), "source_modified_date": day("$.indexed['date-time']"),
        "landing_url": T.first_filled(_clean("$.URL"), T.doi_url(doi)), "download_url": T.clean_whitespace(F.get(pdf, 0)["URL"]), "license": licence, "license_unknown": ~known,
        "language": T.first_filled(_clean("$.language"), T.language(title)), "document_type": T.document_type(_get("$.type"), title), "keywords": _strings("$.subject"),
        "abstract_original": T.strip_tags(_get("$.abstract")), "work_id": F.concat(F.lit("doi:"), doi),
    }
    return _project(raw.where(doi != ""), values, doi)


def openalex(raw: DataFrame) -> DataFrame:
    title, doi, key = T.first_filled(_clean("$.display_name"), _clean("$.title")), T.normalize_doi(_get("$.doi")), _clean("$.id")
    licence = _clean("$.best_oa_location.license")
    open_ = F.coalesce(_get("$.open_access.is_oa", "boolean"), F.lit(False)) & (licence != "")
    people = F.transform(_get("$.authorships", "array<struct<author:struct<display_name:string>>>"), lambda a: T.clean_whitespace(a["author"]["display_name"]))
    concepts = F.transform(F.slice(_get("$.concepts", "array<struct<display_name:string>>"), 1, 8), lambda c: T.clean_whitespace(c["display_name"]))
    values = {
        "title_original": title, "doi": doi, "authors": F.filter(people, lambda x: x != ""), "publisher": _clean("$.primary_location.source.host_organization_name"),
        "journal_or_series": _clean("$.primary_location.source.display_name"), "publication_date": parse_date(_get("$.publication_date")),
        "source_registered_date": parse_date(_get("$.created_date")), "source_modified_date": parse_date(_get("$.updated_date")),
        "landing_url": T.first_filled(_clean("$.primary_location.landing_page_url"), _clean("$.best_oa_location.landing_page_url"), T.doi_url(doi), key),
        "oa_url": T.first_filled(_clean("$.best_oa_location.pdf_url"), _clean("$.open_access.oa_url")), "license": licence, "license_unknown": ~open_,
        "language": T.first_filled(_clean("$.language"), F.lit("en")), "document_type": T.document_type(_get("$.type"), title), "keywords": F.filter(concepts, lambda x: x != ""),
        "abstract_original": T.abstract_from_index(_get("$.abstract_inverted_index", "map<string,array<int>>")),
    }
    return _project(raw, values, key)


def semantic_scholar(raw: DataFrame) -> DataFrame:
    title, doi, pdf = _clean("$.title"), T.normalize_doi(_get("$.externalIds.DOI")), _clean("$.openAccessPdf.url")
    open_ = F.coalesce(_get("$.isOpenAccess", "boolean"), F.lit(False)) & (pdf != "")
    values = {
        "title_original": title, "doi": doi, "authors": T.authors_from_structs(_get("$.authors", _PEOPLE)), "journal_or_series": _clean("$.venue"),
        "publication_date": parse_date(T.first_filled(_get("$.publicationDate"), _get("$.year"))), "landing_url": T.first_filled(_clean("$.url"), T.doi_url(doi)), "oa_url": pdf,
        "license": F.when(open_, "오픈액세스 PDF 확인").otherwise(""), "license_unknown": ~open_, "language": F.lit("en"),
        "document_type": T.document_type(F.array_join(_get("$.publicationTypes", "array<string>"), " "), title), "keywords": _strings("$.fieldsOfStudy"), "abstract_original": _clean("$.abstract"),
    }
    return _project(raw, values, F.concat(F.lit("s2:"), _clean("$.paperId")))


def core(raw: DataFrame) -> DataFrame:
    title, doi, pdf = _clean("$.title"), T.normalize_doi(_get("$.doi")), _clean("$.downloadUrl")
    people = _people("$.authors", _get("$.authors"))
    values = {
        "title_original": title, "doi": doi, "authors": people, "publisher": _clean("$.publisher"), "journal_or_series": _clean("$.journals[0].title"),
        "publication_date": parse_date(_get("$.publishedDate")), "source_registered_date": parse_date(_get("$.createdDate")), "source_modified_date": parse_date(_get("$.updatedDate")),
        "landing_url": T.first_filled(_clean("$.sourceFulltextUrls[0]"), T.doi_url(doi)), "oa_url": pdf, "license": T.first_filled(_clean("$.license"), F.lit("CORE 오픈액세스")),
        "license_unknown": pdf == "", "language": T.first_filled(_clean("$.language.code"), F.lit("en")), "document_type": T.document_type(_get("$.documentType"), title),
        "abstract_original": _clean("$.abstract"),
    }
    return _project(raw, values, F.concat(F.lit("core:"), _clean("$.id")))


def doaj(raw: DataFrame) -> DataFrame:
    title, key = _clean("$.bibjson.title"), _clean("$.id")
    ids = F.filter(_get("$.bibjson.identifier", "array<struct<type:string,id:string>>"), lambda x: F.lower(x["type"]) == "doi")
    doi = T.normalize_doi(F.get(ids, F.size(ids) - 1)["id"])
    links = _get("$.bibjson.link", "array<struct<type:string,url:string>>")
    full = F.filter(links, lambda x: F.lower(x["type"]) == "fulltext")
    other = F.filter(links, lambda x: (F.coalesce(F.lower(x["type"]), F.lit("")) != "fulltext") & (T.text_of(x["url"]) != ""))
    year = _get("$.bibjson.year")
    values = {
        "title_original": title, "doi": doi, "authors": T.authors_from_structs(_get("$.bibjson.author", _PEOPLE)), "publisher": _clean("$.bibjson.journal.publisher"),
        "journal_or_series": _clean("$.bibjson.journal.title"),
        "publication_date": F.when(T.text_of(year) != "", parse_date(F.concat(year, F.lit("-"), F.lpad(F.coalesce(_get("$.bibjson.month"), F.lit("1")), 2, "0"), F.lit("-01")))),
        "source_registered_date": parse_date(_get("$.created_date")), "source_modified_date": parse_date(_get("$.last_updated")),
        "landing_url": T.first_filled(T.clean_whitespace(F.get(other, 0)["url"]), T.doi_url(doi)), "oa_url": T.clean_whitespace(F.get(full, F.size(full) - 1)["url"]),
        "license": T.first_filled(_clean("$.bibjson.journal.license[0].type"), F.lit("DOAJ 등재 오픈액세스")), "license_unknown": F.lit(False),
        "language": T.first_filled(_first_of("$.bibjson.journal.language"), F.lit("en")), "document_type": T.document_type(F.lit("article"), title),
        "keywords": _strings("$.bibjson.keywords"), "abstract_original": _clean("$.bibjson.abstract"),
    }
    return _project(raw, values, key)


def zenodo(raw: DataFrame) -> DataFrame:
    title, doi = _clean("$.metadata.title"), T.normalize_doi(T.first_filled(_get("$.metadata.doi"), _get("$.doi")))
    licence = T.first_filled(_clean("$.metadata.license.id"), F.when(_get("$.metadata.license.id").isNull(), _clean("$.metadata.license")))
    open_ = (F.lower(_get("$.metadata.access_right")) == "open") & T.contains_any(F.lower(licence), ["cc-by", "cc0", "mit", "apache", "open"])
    files = F.filter(_get("$.files", "array<struct<key:string,links:struct<self:string>>>"), lambda f: F.lower(f["key"]).rlike(r"\.(pdf|hwp|hwpx|docx)$"))
    values = {
        "title_original": title, "doi": doi, "authors": T.authors_from_structs(_get("$.metadata.creators", _PEOPLE)), "publisher": F.lit("Zenodo"),
        "journal_or_series": _clean("$.metadata.journal.title"), "publication_date": parse_date(_get("$.metadata.publication_date")),
        "source_registered_date": parse_date(_get("$.created")), "source_modified_date": parse_date(_get("$.updated")),
        "landing_url": T.first_filled(_clean("$.links.self_html"), T.doi_url(doi)), "oa_url": T.clean_whitespace(F.get(files, 0)["links"]["self"]), "license": licence,
        "license_unknown": ~F.coalesce(open_, F.lit(False)), "language": T.first_filled(_clean("$.metadata.language"), F.lit("en")),
        "document_type": T.document_type(_get("$.metadata.resource_type.type"), title), "keywords": _strings("$.metadata.keywords"),
        "abstract_original": T.strip_tags(_get("$.metadata.description")),
    }
    return _project(raw, values, F.concat(F.lit("zenodo:"), _clean("$.id")))


def arxiv(raw: DataFrame) -> DataFrame:
    """Entries as JSON, as ``atom_entries`` gives them."""
    title, entry, doi = _clean("$.title"), _clean("$.id"), T.normalize_doi(_get("$.doi"))
    pdf = T.first_filled(_clean("$.pdf_url"), F.replace(entry, F.lit("/abs/"), F.lit("/pdf/")))
    values = {
        "title_original": title, "doi": doi, "authors": _strings("$.authors"), "publisher": F.lit("arXiv"), "journal_or_series": T.first_filled(_clean("$.journal_ref"), F.lit("arXiv preprint")),
        "publication_date": parse_date(_get("$.published")), "source_registered_date": parse_date(_get("$.published")), "source_modified_date": parse_date(_get("$.updated")),
        "landing_url": entry, "download_url": pdf, "oa_url": pdf, "license": T.first_filled(_clean("$.license"), F.lit("arXiv 공개 라이선스")), "license_unknown": F.lit(False),
        "language": F.lit("en"), "document_type": F.lit("프리프린트"), "keywords": _strings("$.categories"), "abstract_original": _clean("$.summary"),
    }
    return _project(raw, values, F.concat(F.lit("arxiv:"), F.substring_index(entry, "/", -1)))


def dublin_core(raw: DataFrame) -> DataFrame:
    """OAI-PMH records (15 arrays and the header), and rows of the open API that stands in for them."""
    title = _first_of("$.title")
    ids = F.coalesce(_get("$.identifier", "array<string>"), F.array(_get("$.identifier")))
    dois = F.filter(F.transform(ids, T.normalize_doi), lambda d: d != "")
    doi = F.coalesce(F.get(dois, 0), F.lit(""))
    pages = F.filter(ids, lambda i: F.startswith(i, F.lit("http")) & ((T.normalize_doi(i) == "") | (T.normalize_doi(i) != doi)))
    key, rights = T.first_filled(_clean("$.article_id"), _clean("$.oai_identifier")), _first_of("$.rights")
    people = F.coalesce(_get("$.creator", "array<string>"), T.authors_from_string(T.first_filled(_get("$.creator"), _get("$.author"))))
    values = {
        "title_original": title, "title_ko": F.when(T.language(title) == "ko", title).otherwise(""), "doi": doi, "authors": F.filter(F.transform(people, T.clean_whitespace), lambda x: x != ""),
        "source_type": T.first_filled(_clean("$._access_method"), F.lit("OAI_PMH")), "publisher": _first_of("$.publisher"),
        "journal_or_series": T.first_filled(_first_of("$.source"), _clean("$.journal")), "publication_date": parse_date(T.first_filled(_first_of("$.date"), _get("$.pub_date"))),
        "source_registered_date": parse_date(_get("$.datestamp")), "source_modified_date": parse_date(_get("$.datestamp")),
        "landing_url": T.first_filled(F.get(pages, 0), T.doi_url(doi)), "license": rights, "license_unknown": rights == "",
        "language": T.first_filled(_first_of("$.language"), T.language(title)), "document_type": T.document_type(_first_of("$.type"), title), "keywords": _strings("$.subject", 12),
        "abstract_original": _first_of("$.description"),
    }
    return _project(raw, values, key)


def law(raw: DataFrame) -> DataFrame:
    """Statutes, rules, cases and interpretations; _target and _document_type tell which."""
    any_of = lambda *names: T.first_filled(*[_clean(f"$['{n}']") for n in names])
    title = any_of("법령명한글", "행정규칙명", "사건명", "안건명", "제목")
    key = F.concat(F.lit("law:"), T.first_filled(_get("$._target"), F.lit("law")), F.lit(":"), any_of("법령ID", "행정규칙ID", "판례일련번호", "ID"))
    page = any_of("법령상세링크", "행정규칙상세링크", "판례상세링크")
    made, forced, decided = (parse_date(_get(f"$['{n}']")) for n in ("공포일자", "시행일자", "선고일자"))
    kind = T.first_filled(_get("$._document_type"), F.lit("법령"))
    values = {
        "title_original": title, "title_ko": title, "publisher": T.first_filled(any_of("소관부처명", "법원명"), F.lit("국가법령정보센터")), "journal_or_series": kind,
        "publication_date": F.coalesce(made, decided), "source_registered_date": made, "source_modified_date": F.coalesce(forced, made, decided),
        "landing_url": F.when(F.startswith(page, F.lit("/")), F.concat(F.lit("https://www.law.go.kr"), page)).otherwise(page),
        "license": F.lit("공공누리(국가법령정보센터 이용조건 확인 필요)"), "license_unknown": F.lit(True), "language": F.lit("ko"), "document_type": kind,
        "keywords": F.filter(F.array(any_of("제개정구분명"), any_of("법령구분명")), lambda x: x != ""), "abstract_original": any_of("판시사항", "판결요지"),
    }
    return _project(raw, values, key)


def feed(raw: DataFrame, publisher: str = "") -> DataFrame:
    title, link = _clean("$.title"), _clean("$.link")
    day = parse_date(_get("$.published"))
    key = F.concat("source_id", F.lit(":"), T.first_filled(_clean("$.id"), link))
    values = {
        "title_original": title, "title_ko": title, "source_type": F.lit("RSS"), "authors": F.filter(F.array(_clean("$.author")), lambda x: x != ""), "publisher": F.lit(publisher),
        "publication_date": day, "source_registered_date": day, "source_modified_date": day, "landing_url": link, "download_url": F.coalesce(F.get(_strings("$.enclosures"), 0), F.lit("")),
        "license_unknown": F.lit(True), "language": F.lit("ko"), "document_type": T.document_type(title, _get("$.summary")), "keywords": _strings("$.tags"), "abstract_original": _clean("$.summary"),
    }
    return _project(raw, values, key)


#: Field maps of sources that differ by names alone.
PRESETS: dict[str, dict[str, str]] = {
    "nkis": {"title": "title", "identifier": "otpId", "authors": "author", "publisher": "orgName", "publication_date": "pubDate", "landing_url": "url", "abstract": "abstract"},
    "prism": {"title": "bizNm", "identifier": "bizId", "publisher": "orgNm", "publication_date": "regDate", "landing_url": "detailUrl"},
    "kknowledge": {"title": "title", "identifier": "id", "authors": "creator", "publisher": "publisher", "publication_date": "issued", "landing_url": "url"},
    "nars": {
        "title": "title", "authors": "author", "publisher": "deptName", "publication_date": "publishDate", "registered_date": "regDate", "identifier": "brdSeq", "landing_url": "linkUrl",
        "download_url": "fileUrl", "abstract": "summary", "document_type": "reportType",
    },
    "scienceon": {"title": "Title", "identifier": "CN", "authors": "Author", "publisher": "Publisher", "publication_date": "Pubyear", "doi": "DOI", "abstract": "Abstract", "landing_url": "ContentURL"},
}


def dig(path: str) -> Column:
    """The text at a dotted path of the payload; wherever a list stands on the way its first element is
    taken, step by step."""
    at = F.col("__v")
    for name in path.split("."):
        step = F.try_variant_get(at, f"$.{name}", "variant")
        at = F.get(F.transform(F.array(step), lambda v: F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)), 0)
    return T.clean_whitespace(F.try_variant_get(at, "$", "string"))


def merged_fields(preset: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """A preset's field map with a source's own over it; empty paths take a field out."""
    return {k: v for k, v in (PRESETS[preset] | (overrides or {})).items() if v}


def mapped(raw: DataFrame, fields: dict[str, str], publisher: str = "", default_type: str = T.OTHER_TYPE) -> DataFrame:
    """A source described by a field map (our field to a dotted path; of lists the first element): the
    projection that a user adds without code."""

    at = lambda name: dig(fields[name]) if fields.get(name) else F.lit("")

    title, doi, key = at("title"), T.normalize_doi(at("doi")), at("identifier")
    names = fields.get("authors")
    people = _people(f"$.{names}", at("authors")) if names else F.array().cast("array<string>")
    words = fields.get("keywords")
    keywords = F.coalesce(_get(f"$.{words}", "array<string>"), F.split(_get(f"$.{words}"), "[;,]")) if words else F.array().cast("array<string>")
    published = parse_date(at("publication_date"))
    registered = F.coalesce(parse_date(at("registered_date")), published)
    kind = T.document_type(at("document_type"), title)
    values = {
        "title_original": title, "title_ko": F.when(T.language(title) == "ko", title).otherwise(""), "doi": doi, "authors": people, "publisher": T.first_filled(at("publisher"), F.lit(publisher)),
        "journal_or_series": at("series"), "publication_date": published, "source_registered_date": registered, "source_modified_date": F.coalesce(parse_date(at("modified_date")), registered),
        "landing_url": T.first_filled(at("landing_url"), T.doi_url(doi)), "download_url": at("download_url"), "license": at("license"), "license_unknown": at("license") == "",
        "language": T.first_filled(at("language"), T.language(title)), "document_type": F.when(kind == T.OTHER_TYPE, default_type).otherwise(kind),
        "keywords": F.filter(F.transform(keywords, lambda x: F.trim(x)), lambda x: x != ""), "abstract_original": at("abstract"),
    }
    return _project(raw, values, F.when(key == "", "").otherwise(F.concat("source_id", F.lit(":"), key)))


def assembly(raw: DataFrame, fields: dict[str, str], publisher: str = "", template: str = "") -> DataFrame:
    """Rows whose field names vary in case; the title may be the longest field that looks like one, the
    identifier a URL's parameter.  Rows are maps of strings."""
    row = F.col("__m")
    lower = F.transform_keys(row, lambda k, _: F.lower(k))
    at = lambda n: T.clean_whitespace(F.coalesce(F.try_element_at(row, F.lit(fields.get(n, "\0"))), F.try_element_at(lower, F.lit(fields.get(n, "\0").lower()))))
    hints = F.map_entries(F.map_filter(row, lambda k, _: F.upper(k).rlike("TITLE|NAME|NM|SUBJECT") & ~F.contains(F.upper(k), F.lit("URL"))))
    longest = F.get(F.array_sort(F.transform(hints, lambda e, i: F.struct((-F.length(T.clean_whitespace(e["value"]))).alias("n"), i.alias("i"), T.clean_whitespace(e["value"]).alias("v")))), 0)["v"]
    title = T.first_filled(at("title"), longest)
    by_url = lambda c: F.regexp_extract(T.text_of(c), r"[?&](?:doc_id|id)=([^&#]*)", 1)
    key = T.first_filled(at("identifier"), by_url(at("download_url")), by_url(at("landing_url")))
    page = T.first_filled(at("landing_url"), F.when(key != "", F.replace(F.lit(template), F.lit("{id}"), key)))
    values = {
        "title_original": title, "title_ko": title, "authors": T.authors_from_string(at("authors")), "publisher": T.first_filled(at("publisher"), F.lit(publisher)),
        "publication_date": parse_date(at("publication_date")), "source_registered_date": parse_date(at("registered_date")), "landing_url": page, "download_url": at("download_url"),
        "license_unknown": F.lit(True), "language": F.lit("ko"), "document_type": T.document_type(at("document_type"), title), "abstract_original": at("abstract"),
    }
    df = raw.withColumn("__m", F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return _project(df, values, F.when(key == "", "").otherwise(F.concat("source_id", F.lit(":"), key)))


def nars(raw: DataFrame, template: str = "", name: str = "", overrides: dict[str, str] | None = None) -> DataFrame:
    """Reports of the type research report; a missing landing page is made from ``template`` and the
    identifier, a missing publisher is ``name``."""
    df = mapped(raw, merged_fields("nars", overrides), name, "연구보고서")
    number = F.substring_index("official_identifier", ":", -1)
    made = F.when((F.col("landing_url") == "") & (number != "") & F.lit(bool(template)), F.replace(F.lit(template), F.lit("{id}"), number))
    return df.withColumn("landing_url", F.coalesce(made, F.col("landing_url")))


def kknowledge(raw: DataFrame, name: str = "", overrides: dict[str, str] | None = None) -> DataFrame:
    """Records of other publishers: the licence never counts as known."""
    return mapped(raw, merged_fields("kknowledge", overrides), name).withColumn("license_unknown", F.lit(True))


def passive(raw: DataFrame) -> DataFrame:
    """A source that is never scanned: no rows; its rules apply to what others find (``policy.adopt``,
    ``open_locations``)."""
    return _project(raw.where("false"), {"title_original": F.lit("")}, F.lit(""))


#: Default field names of the assembly's envelopes.
ASSEMBLY_FIELDS = {"title": "TITLE", "identifier": "ID", "landing_url": "LINK_URL", "download_url": "FILE_URL", "publication_date": "REG_DATE", "authors": "AUTHOR", "abstract": "SUMMARY"}


def first_seen(df: DataFrame, *keys: str) -> DataFrame:
    """Of the records with equal, filled ``keys`` the first by identifier; records without a key stay."""
    filled = F.concat_ws("\x01", *keys)
    empty = df.where(F.coalesce(F.col(keys[0]), F.lit("")) == "")
    rest = df.where(F.coalesce(F.col(keys[0]), F.lit("")) != "").groupBy(filled.alias("__k")).agg(F.min_by(F.struct(*df.columns), "resource_id").alias("x")).select("x.*")
    return rest.unionByName(empty)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "crossref": crossref, "openalex": openalex, "semantic_scholar": semantic_scholar, "core": core, "doaj": doaj, "zenodo": zenodo, "arxiv": arxiv, "kci": dublin_core,
    "oai_pmh": dublin_core, "law_openapi": law, "institution_feed": feed, "generic_api": lambda raw: mapped(raw, {f: f for f in ("title", "doi", "identifier", "authors", "publisher", "publication_date", "landing_url", "download_url", "license", "abstract", "keywords")}),
} | {name: (lambda raw, f=f: mapped(raw, f)) for name, f in PRESETS.items()} | {
    "nars": nars, "kknowledge": kknowledge, "assembly_open": lambda raw: assembly(raw, ASSEMBLY_FIELDS), "riss": passive, "ssrn": passive, "unpaywall": passive,
}


def normalize(raw: DataFrame, connector: str) -> DataFrame:
    """Resources of raw items (source_id, seq, payload, query) by their connector; an unknown one is an
    error."""
    if connector not in NORMALIZERS:
        raise ValueError(f"unknown connector {connector!r}")
    return NORMALIZERS[connector](raw.withColumn("__v", F.try_parse_json("payload")))


def open_locations(lookups: DataFrame) -> DataFrame:
    """(doi, url, license) of open copies from captured DOI lookups (doi, payload)."""
    df = lookups.withColumn("__v", F.try_parse_json("payload")).where(F.coalesce(_get("$.is_oa", "boolean"), F.lit(False)))
    url = T.first_filled(_clean("$.best_oa_location.url_for_pdf"), _clean("$.best_oa_location.url_for_landing_page"), _clean("$.best_oa_location.url"))
    return df.select(T.normalize_doi(F.col("doi")).alias("doi"), url.alias("url"), T.first_filled(_clean("$.best_oa_location.license"), F.lit("오픈액세스(라이선스 미표기)")).alias("license")).where("url <> ''")


#: What an open copy without a stated licence reads as.
CORE_OPEN, SCIENCEON_OPEN = "CORE 오픈액세스", "ScienceON/AccessON 공개 원문"


def _first_location(lookups: DataFrame, records: Column, url: str, license: str | None, unnamed: str) -> DataFrame:
    """(doi, url, license) of the first record of a lookup (array of VARIANT) that has a URL."""
    text = lambda x, name: T.clean_whitespace(F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit("")))
    found = F.transform(records, lambda x: F.struct(text(x, url).alias("url"), (text(x, license) if license else F.lit("")).alias("license")))
    rows = lookups.select(T.normalize_doi(F.col("doi")).alias("doi"), F.get(F.filter(found, lambda x: x["url"] != ""), 0).alias("x"))
    return rows.where("doi <> '' and x is not null").select("doi", "x.url", T.first_filled(F.col("x.license"), F.lit(unnamed)).alias("license"))


def core_locations(lookups: DataFrame) -> DataFrame:
    """Open copies from captured CORE lookups (doi, payload); damaged payloads give none."""
    df = lookups.withColumn("__v", F.try_parse_json("payload"))
    return _first_location(df, _get("$.results", "array<variant>"), "downloadUrl", "license", CORE_OPEN)


def scienceon_locations(lookups: DataFrame, field: str = "FullTextURL") -> DataFrame:
    """Open copies from captured ScienceON lookups (doi, payload), whose records lie somewhere in an envelope."""
    records = F.transform(envelope_rows(F.col("payload")), lambda r: F.try_parse_json(r))
    return _first_location(lookups.withColumn("__r", records), F.col("__r"), field, None, SCIENCEON_OPEN)


def with_fallback(primary: DataFrame, secondary: DataFrame, failed: DataFrame) -> DataFrame:
    """Raw items of sources read by one access method, and of the sources (source_id) whose read failed or gave
    nothing, those of the other method as well."""
    done = primary.select("source_id").distinct().join(failed.select("source_id").distinct(), "source_id", "left_anti")
    return primary.unionByName(secondary.join(done, "source_id", "left_anti").select(*primary.columns))
