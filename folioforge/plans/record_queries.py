"""More registered queries: payload normalisers, dedup against stored records, acquisition, manifests, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, policy, report, runs, scan, search, store
from ..operators import summarize as M
from ..sources import config, payloads, readers
from .queries import _PART_SQL, _read, query

# Payload normalisers: JSON is built from the documents' whole texts, normalised, and compared field by field.
_CLEAN = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
_TEXT = _CLEAN.format("text")
_STRIPPED = _CLEAN.format("regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g')")
_DAY, _DUCK_DAY = "cast(date_add(date'2024-01-01', cast(doc_id % 1500 as int)) as string)", "(DATE '2024-01-01' + (doc_id % 1500)::INT)::VARCHAR"
_TITLE, _DUCK_TITLE = "concat(' Study  ', doc_id, ' of ', source)", "'Study ' || doc_id || ' of ' || source"
_DOI, _DUCK_DOI = "concat('https://doi.org/10.1000/X', doc_id, '.')", "'10.1000/x' || doc_id"
_KIND = "case doc_id % 3 when 0 then 'Journal-Article' when 1 then 'report' else 'other' end"
_DUCK_KIND = "CASE doc_id % 3 WHEN 0 THEN '학술논문' WHEN 1 THEN '연구보고서' ELSE '기타' END"
_FIELDS = {
    "official_identifier": "''", "doi": "''", "authors": "''", "publisher": "''", "journal_or_series": "''", "published": "NULL", "registered": "NULL", "modified": "NULL", "landing_url": "''",
    "download_url": "''", "oa_url": "''", "license": "''", "license_unknown": "true", "language": "''", "document_type": "'기타'", "keywords": "''", "abstract": "''",
}


def _flat(df: DataFrame) -> DataFrame:
    dates = {"published": "publication_date", "registered": "source_registered_date", "modified": "source_modified_date"}
    plain = ["official_identifier", "doi", "publisher", "journal_or_series", "landing_url", "download_url", "oa_url", "license", "license_unknown", "language", "document_type"]
    return df.select(
        "source_id", F.col("title_original").alias("title"), *plain, *[F.col(c).cast("string").alias(n) for n, c in dates.items()],
        F.array_join("authors", "; ").alias("authors"), F.array_join("keywords", ";").alias("keywords"), F.md5("abstract_original").alias("abstract"),
    )


def _normaliser(connector: str, payload: str, title: str = _DUCK_TITLE, **fields: str) -> None:
    values = _FIELDS | fields
    values["abstract"] = f"md5({values['abstract']})"
    sql = f"SELECT source source_id, {title} title, " + ", ".join(f"{v}{'::VARCHAR' if v == 'NULL' else ''} {k}" for k, v in values.items()) + " FROM documents"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _read(spark, sf_dir, "documents").select(
            F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), F.expr(f"to_json(named_struct({payload}))").alias("payload"),
            F.expr("cast(null as struct<canonical_ko:string,language:string,terms:array<string>,dictionary_version:string,query_string:string>)").alias("query"),
        )
        return _flat(payloads.normalize(raw, connector))

    run.__name__ = f"q_normalize_{connector}"
    run.__doc__ = f"Payloads of {connector} as resources."
    query(sql)(run)


_normaliser(
    "crossref",
    f"""'DOI', {_DOI}, 'title', array({_TITLE}), 'author', array(named_struct('given', 'Ann', 'family', source, 'name', cast(null as string)), named_struct('given', cast(null as string), 'family', cast(null as string), 'name', ' Team  X ')),
    'publisher', ' Pub  Co ', 'container-title', array('J of S'), 'issued', named_struct('date-parts', array(array(2024, 1 + cast(doc_id % 12 as int)))), 'created', named_struct('date-time', {_DAY}), 'indexed', named_struct('date-time', concat({_DAY}, 'T10:00:00Z')),
    'license', if(doc_id % 2 = 0, array(named_struct('URL', 'https://creativecommons.org/licenses/by/4.0')), array(named_struct('URL', 'https://example.org/terms'))), 'link', array(named_struct('URL', 'http://h/x.html', 'content-type', 'text/html'), named_struct('URL', concat('http://h/', doc_id, '.pdf'), 'content-type', 'application/pdf')),
    'type', {_KIND}, 'subject', array('law', ' x '), 'abstract', concat('<p>', text, '</p>'), 'language', 'en'""",
    official_identifier=_DUCK_DOI, doi=_DUCK_DOI, authors="'Ann ' || source || '; Team X'", publisher="'Pub Co'", journal_or_series="'J of S'", published="make_date(2024, 1 + (doc_id % 12)::INT, 1)::VARCHAR", registered=_DUCK_DAY, modified=_DUCK_DAY,
    landing_url=f"'https://doi.org/' || {_DUCK_DOI}", download_url="'http://h/' || doc_id || '.pdf'", license="CASE WHEN doc_id % 2 = 0 THEN 'https://creativecommons.org/licenses/by/4.0' ELSE 'https://example.org/terms' END", license_unknown="doc_id % 2 <> 0",
    language="'en'", document_type=_DUCK_KIND, keywords="'law;x'", abstract=_STRIPPED,
)
_normaliser(
    "openalex",
    f"""'id', concat('https://o/W', doc_id), 'display_name', {_TITLE}, 'doi', if(doc_id % 4 = 0, null, {_DOI}), 'authorships', array(named_struct('author', named_struct('display_name', source)), named_struct('author', named_struct('display_name', ' B  C '))),
    'primary_location', named_struct('landing_page_url', if(doc_id % 5 = 0, '', concat('http://l/', doc_id)), 'source', named_struct('display_name', 'S', 'host_organization_name', 'H')), 'best_oa_location', named_struct('license', if(doc_id % 3 = 0, '', 'cc-by'), 'pdf_url', concat('http://p/', doc_id)),
    'open_access', named_struct('is_oa', doc_id % 2 = 0), 'publication_date', {_DAY}, 'type', {_KIND}, 'concepts', transform(sequence(1, 10), i -> named_struct('display_name', concat('c', i)))""",
    official_identifier="'https://o/W' || doc_id", doi=f"CASE WHEN doc_id % 4 = 0 THEN '' ELSE {_DUCK_DOI} END", authors="source || '; B C'", publisher="'H'", journal_or_series="'S'", published=_DUCK_DAY,
    landing_url=f"CASE WHEN doc_id % 5 <> 0 THEN 'http://l/' || doc_id WHEN doc_id % 4 <> 0 THEN 'https://doi.org/' || {_DUCK_DOI} ELSE 'https://o/W' || doc_id END", oa_url="'http://p/' || doc_id", license="CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'cc-by' END",
    license_unknown="NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0)", language="'en'", document_type=_DUCK_KIND, keywords="'c1;c2;c3;c4;c5;c6;c7;c8'", abstract="''",
)
_normaliser(
    "semantic_scholar",
    f"""'paperId', doc_id, 'title', {_TITLE}, 'externalIds', named_struct('DOI', {_DOI}), 'authors', array(named_struct('name', source)), 'venue', ' V ', 'publicationDate', if(doc_id % 2 = 0, {_DAY}, null), 'year', '2023', 'url', 'http://s/1',
    'isOpenAccess', true, 'openAccessPdf', named_struct('url', if(doc_id % 3 = 0, '', 'http://s/1.pdf')), 'publicationTypes', array({_KIND}), 'fieldsOfStudy', array('Law'), 'abstract', text""",
    official_identifier="'s2:' || doc_id", doi=_DUCK_DOI, authors="source", journal_or_series="'V'", published=f"CASE WHEN doc_id % 2 = 0 THEN {_DUCK_DAY} ELSE '2023-01-01' END", landing_url="'http://s/1'", oa_url="CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'http://s/1.pdf' END",
    license="CASE WHEN doc_id % 3 = 0 THEN '' ELSE '오픈액세스 PDF 확인' END", license_unknown="doc_id % 3 = 0", language="'en'", document_type=_DUCK_KIND, keywords="'Law'", abstract=_TEXT,
)
_normaliser(
    "core",
    f"""'id', doc_id, 'title', {_TITLE}, 'doi', {_DOI}, 'downloadUrl', if(doc_id % 2 = 0, 'http://c/1.pdf', null), 'authors', array(named_struct('name', source)), 'publisher', 'P', 'journals', array(named_struct('title', 'J')), 'publishedDate', {_DAY}, 'createdDate', {_DAY}, 'updatedDate', {_DAY},
    'language', named_struct('code', 'de'), 'documentType', {_KIND}, 'abstract', text""",
    official_identifier="'core:' || doc_id", doi=_DUCK_DOI, authors="source", publisher="'P'", journal_or_series="'J'", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url=f"'https://doi.org/' || {_DUCK_DOI}",
    oa_url="CASE WHEN doc_id % 2 = 0 THEN 'http://c/1.pdf' ELSE '' END", license="'CORE 오픈액세스'", license_unknown="doc_id % 2 <> 0", language="'de'", document_type=_DUCK_KIND, abstract=_TEXT,
)
_normaliser(
    "doaj",
    f"""'id', concat('d', doc_id), 'created_date', {_DAY}, 'last_updated', {_DAY}, 'bibjson', named_struct('title', {_TITLE}, 'identifier', array(named_struct('type', 'issn', 'id', '1'), named_struct('type', 'DOI', 'id', {_DOI})), 'author', array(named_struct('name', source)),
    'journal', named_struct('publisher', 'P', 'title', 'J', 'language', array('FR')), 'year', '2022', 'month', if(doc_id % 2 = 0, '7', null), 'link', array(named_struct('type', 'fulltext', 'url', 'http://f/1'), named_struct('type', 'other', 'url', 'http://o/1'), named_struct('type', 'fulltext', 'url', 'http://f/2')),
    'keywords', array('k1', 'k2'), 'abstract', text)""",
    official_identifier="'d' || doc_id", doi=_DUCK_DOI, authors="source", publisher="'P'", journal_or_series="'J'", published="CASE WHEN doc_id % 2 = 0 THEN '2022-07-01' ELSE '2022-01-01' END", registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url="'http://o/1'", oa_url="'http://f/2'",
    license="'DOAJ 등재 오픈액세스'", license_unknown="false", language="'FR'", document_type="'학술논문'", keywords="'k1;k2'", abstract=_TEXT,
)
_normaliser(
    "zenodo",
    f"""'id', doc_id, 'doi', {_DOI}, 'created', {_DAY}, 'updated', {_DAY}, 'links', named_struct('self_html', concat('http://z/', doc_id)), 'files', array(named_struct('key', 'a.csv', 'links', named_struct('self', 'http://z/a')), named_struct('key', 'b.PDF', 'links', named_struct('self', 'http://z/b'))),
    'metadata', named_struct('title', {_TITLE}, 'creators', array(named_struct('name', source)), 'publication_date', {_DAY}, 'license', named_struct('id', 'CC-BY-4.0'), 'access_right', if(doc_id % 2 = 0, 'open', 'closed'), 'resource_type', named_struct('type', {_KIND}), 'keywords', array('k'), 'description', concat('<p>', text, '</p>'))""",
    official_identifier="'zenodo:' || doc_id", doi=_DUCK_DOI, authors="source", publisher="'Zenodo'", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url="'http://z/' || doc_id", oa_url="'http://z/b'", license="'CC-BY-4.0'", license_unknown="doc_id % 2 <> 0",
    language="'en'", document_type=_DUCK_KIND, keywords="'k'", abstract=_STRIPPED,
)
_normaliser(
    "arxiv",
    f"""'id', concat('http://arxiv.org/abs/', doc_id), 'title', {_TITLE}, 'summary', text, 'published', {_DAY}, 'updated', {_DAY}, 'authors', array(source, 'Z'), 'categories', array('cs.CL'), 'doi', if(doc_id % 2 = 0, {_DOI}, '')""",
    official_identifier="'arxiv:' || doc_id", doi=f"CASE WHEN doc_id % 2 = 0 THEN {_DUCK_DOI} ELSE '' END", authors="source || '; Z'", publisher="'arXiv'", journal_or_series="'arXiv preprint'", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY,
    landing_url="'http://arxiv.org/abs/' || doc_id", download_url="'http://arxiv.org/pdf/' || doc_id", oa_url="'http://arxiv.org/pdf/' || doc_id", license="'arXiv 공개 라이선스'", license_unknown="false", language="'en'", document_type="'프리프린트'", keywords="'cs.CL'", abstract=_TEXT,
)
_normaliser(
    "kci",
    f"""'oai_identifier', concat('oai:', doc_id), 'title', array({_TITLE}), 'creator', array(source, ' Kim '), 'identifier', array(concat('http://k/', doc_id), {_DOI}), 'publisher', array('P'), 'source', array('S'), 'date', array({_DAY}), 'datestamp', {_DAY}, 'rights', array(if(doc_id % 2 = 0, 'CC BY', '')),
    'language', array('kor'), 'type', array({_KIND}), 'subject', transform(sequence(1, 20), i -> concat('s', i)), 'description', array(text)""",
    official_identifier="'oai:' || doc_id", doi=_DUCK_DOI, authors="source || '; Kim'", publisher="'P'", journal_or_series="'S'", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url="'http://k/' || doc_id", license="CASE WHEN doc_id % 2 = 0 THEN 'CC BY' ELSE '' END",
    license_unknown="doc_id % 2 <> 0", language="'kor'", document_type=_DUCK_KIND, keywords="'s1;s2;s3;s4;s5;s6;s7;s8;s9;s10;s11;s12'", abstract=_TEXT,
)
_normaliser(
    "law_openapi",
    f"""'법령명한글', {_TITLE}, '법령ID', doc_id, '_target', if(doc_id % 2 = 0, 'law', 'prec'), '_document_type', if(doc_id % 2 = 0, '법령', '판례'), '소관부처명', source, '공포일자', if(doc_id % 3 = 0, null, {_DAY}), '선고일자', '2020-02-03', '시행일자', if(doc_id % 5 = 0, '20210405', null), '법령상세링크', '/x?id=1', '제개정구분명', '일부개정', '판시사항', text""",
    official_identifier="'law:' || CASE WHEN doc_id % 2 = 0 THEN 'law' ELSE 'prec' END || ':' || doc_id", publisher="source", journal_or_series="CASE WHEN doc_id % 2 = 0 THEN '법령' ELSE '판례' END", published=f"CASE WHEN doc_id % 3 = 0 THEN '2020-02-03' ELSE {_DUCK_DAY} END",
    registered=f"CASE WHEN doc_id % 3 <> 0 THEN {_DUCK_DAY} END", modified=f"CASE WHEN doc_id % 5 = 0 THEN '2021-04-05' WHEN doc_id % 3 <> 0 THEN {_DUCK_DAY} ELSE '2020-02-03' END", landing_url="'https://www.law.go.kr/x?id=1'",
    license="'공공누리(국가법령정보센터 이용조건 확인 필요)'", language="'ko'", document_type="CASE WHEN doc_id % 2 = 0 THEN '법령' ELSE '판례' END", keywords="'일부개정'", abstract=_TEXT,
)
_normaliser(
    "institution_feed",
    f"""'id', concat('f', doc_id), 'title', {_TITLE}, 'link', concat('http://f/', doc_id), 'published', {_DAY}, 'author', source, 'enclosures', array('http://f/a.pdf'), 'tags', array('t1', 't2')""",
    official_identifier="source || ':f' || doc_id", authors="source", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url="'http://f/' || doc_id", download_url="'http://f/a.pdf'", language="'ko'", keywords="'t1;t2'",
)
for _name, _payload, _extra in (
    ("nkis", f"'title', {_TITLE}, 'otpId', doc_id, 'author', 'Kim; Lee', 'orgName', 'O', 'pubDate', {_DAY}, 'url', 'http://n/1', 'abstract', text", {"authors": "'Kim; Lee'", "abstract": _TEXT}),
    ("prism", f"'bizNm', {_TITLE}, 'bizId', doc_id, 'orgNm', 'O', 'regDate', {_DAY}, 'detailUrl', 'http://n/1'", {}),
    ("kknowledge", f"'title', {_TITLE}, 'id', doc_id, 'creator', array('Kim', 'Lee'), 'publisher', 'O', 'issued', {_DAY}, 'url', 'http://n/1'", {"authors": "'Kim; Lee'"}),
    ("scienceon", f"'Title', {_TITLE}, 'CN', doc_id, 'Author', 'Kim, Lee', 'Publisher', 'O', 'Pubyear', {_DAY}, 'DOI', {_DOI}, 'Abstract', text, 'ContentURL', 'http://n/1'", {"authors": "'Kim; Lee'", "abstract": _TEXT, "doi": _DUCK_DOI}),
    ("generic_api", f"'title', {_TITLE}, 'identifier', doc_id, 'authors', array('Kim', 'Lee'), 'publisher', 'O', 'publication_date', {_DAY}, 'landing_url', 'http://n/1', 'license', 'CC BY', 'keywords', 'a;b', 'abstract', text", {"authors": "'Kim; Lee'", "abstract": _TEXT, "license": "'CC BY'", "license_unknown": "false", "keywords": "'a;b'"}),
):
    _normaliser(_name, _payload, **({"official_identifier": "source || ':' || doc_id", "publisher": "'O'", "published": _DUCK_DAY, "registered": _DUCK_DAY, "modified": _DUCK_DAY, "landing_url": "'http://n/1'", "language": "'en'"} | _extra))

# Dedup against stored records: parts are the stored ones, parts with other keys arrive.
_STORED = """SELECT p_partkey k, 'st-' || p_partkey resource_id, 's' || p_size % 5 source_id, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey % 700 ELSE '' END doi, CASE WHEN p_partkey % 4 = 0 THEN 'i' || p_partkey % 400 ELSE '' END official_identifier,
  p_name title_original, 2000 + p_size % 3 AS yr, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE '' END author, DATE '2024-01-01' + (p_partkey % 90)::INT modified, CASE WHEN p_partkey % 5 = 0 THEN 'w' || p_partkey ELSE '' END work_id FROM part"""
_ARRIVING = """SELECT p_partkey k, 'in-' || p_partkey resource_id, 's' || (p_size + 1) % 5 source_id, CASE WHEN p_partkey % 7 = 0 THEN '10.1/' || p_partkey % 900 ELSE '' END doi, CASE WHEN p_partkey % 5 = 0 THEN 'i' || p_partkey % 450 ELSE '' END official_identifier,
  p_name title_original, CASE WHEN p_size % 4 <> 0 THEN 2000 + p_size % 3 END yr, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE '' END author, DATE '2024-01-20' + (p_partkey % 60)::INT modified, 'own' work_id FROM part"""


def _parts(spark: SparkSession, sf_dir: str, stored: bool) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    when = lambda c, v: F.when(c, v).otherwise("")
    year = F.make_date(2000 + size % 3, F.lit(5), F.lit(1))
    day = F.date_add(F.lit("2024-01-01" if stored else "2024-01-20").cast("date"), (k % (90 if stored else 60)).cast("int"))
    return _read(spark, sf_dir, "part").select(
        name("st-" if stored else "in-", k).alias("resource_id"), name("s", (size + (0 if stored else 1)) % 5).alias("source_id"),
        when(k % (3 if stored else 7) == 0, name("10.1/", k % (700 if stored else 900))).alias("doi"), when(k % (4 if stored else 5) == 0, name("i", k % (400 if stored else 450))).alias("official_identifier"),
        F.col("p_name").alias("title_original"), F.lit("").alias("title_ko"), F.when(k % (2 if stored else 3) == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("authors"),
        year.alias("publication_date") if stored else F.when(size % 4 != 0, year).alias("publication_date"), day.alias("source_modified_date"), F.lit("").alias("file_sha256"),
        when(k % 5 == 0, name("w", k)).alias("work_id") if stored else F.lit("own").alias("work_id"), F.lit("2026-01-01").cast("timestamp").alias("last_seen_at"), F.col("p_type").alias("landing_url"), F.lit("").alias("download_url"), F.lit("").alias("oa_url"),
    )


_FUZZY_SQL = r"""f AS (SELECT i.resource_id, min(s.resource_id) m FROM r i JOIN s ON contains({n}, left({m}, 12)) AND (i.yr IS NULL OR i.yr = s.yr) AND (i.author = '' OR s.author = '' OR i.author = s.author)
    AND len(list_intersect({a}, {b})) >= 0.85 * len(list_distinct(list_concat({a}, {b}))) GROUP BY i.resource_id)""".format(
    n="lower(s.title_original)", m="lower(i.title_original)", a="list_distinct(string_split(lower(i.title_original), ' '))", b="list_distinct(string_split(lower(s.title_original), ' '))"
)
_TIERS_SQL = f"""WITH s AS ({_STORED}), i AS ({_ARRIVING}), d AS (SELECT doi, min(resource_id) m FROM s WHERE doi <> '' GROUP BY doi), o AS (SELECT source_id, official_identifier, min(resource_id) m FROM s WHERE official_identifier <> '' GROUP BY ALL),
t AS (SELECT i.*, d.m dm, o.m om FROM i LEFT JOIN d ON i.doi = d.doi LEFT JOIN o ON i.source_id = o.source_id AND i.official_identifier = o.official_identifier), r AS (SELECT * FROM t WHERE dm IS NULL AND om IS NULL), {_FUZZY_SQL},
g AS (SELECT t.*, coalesce(dm, om, f.m) match_id, CASE WHEN dm IS NOT NULL THEN 'doi' WHEN om IS NOT NULL THEN 'official_identifier' WHEN f.m IS NOT NULL THEN 'title+year' END matched_by FROM t LEFT JOIN f ON t.resource_id = f.resource_id),
v AS (SELECT g.*, CASE WHEN match_id IS NULL THEN 'NEW' WHEN g.modified > s.modified THEN 'NEW_VERSION' ELSE 'DUPLICATE' END verdict, s.work_id sw FROM g LEFT JOIN s ON g.match_id = s.resource_id)
"""


@query(_TIERS_SQL + "SELECT resource_id, match_id, matched_by, verdict, CASE WHEN verdict = 'NEW_VERSION' THEN match_id ELSE '' END version_of, CASE WHEN verdict = 'NEW_VERSION' AND sw <> '' THEN sw ELSE work_id END work_id FROM v")
def q_dedup_tiers(spark, sf_dir):
    return dedup.check_metadata(_parts(spark, sf_dir, False), _parts(spark, sf_dir, True)).select("resource_id", "match_id", "matched_by", "verdict", "version_of", "work_id")


@query(f"WITH s AS ({_STORED}), r AS ({_ARRIVING}), {_FUZZY_SQL} SELECT resource_id in_id, m match_id FROM f")
def q_fuzzy_match(spark, sf_dir):
    said = lambda df: df.select("resource_id", F.lower("title_original").alias("title"), F.year("publication_date").alias("year"), F.lower(F.coalesce(F.get("authors", 0), F.lit(""))).alias("author"))
    return dedup.fuzzy_match(said(_parts(spark, sf_dir, False)), said(_parts(spark, sf_dir, True))).select("in_id", "match_id")


@query(_TIERS_SQL + "SELECT DISTINCT match_id resource_id, v.source_id, p_type url, 'landing' AS role FROM v JOIN part ON v.k = p_partkey WHERE verdict = 'DUPLICATE'")
def q_merged_sources(spark, sf_dir):
    return dedup.merged_sources(dedup.check_metadata(_parts(spark, sf_dir, False), _parts(spark, sf_dir, True)))


@query("WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) f FROM documents) SELECT doc_id, CASE WHEN doc_id <> f THEN f END match_id, CASE WHEN doc_id <> f THEN 'text_sha256' END matched_by FROM c")
def q_content_tiers(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.lit("").alias("file_sha256"), F.md5("text").alias("text_sha256"), F.lit(0).alias("last_seen_at"))
    return dedup.check_content(rows, rows).select(F.col("resource_id").alias("doc_id"), F.col("match_id").cast("long").alias("match_id"), "matched_by")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) class_id FROM part")
def q_title_classes(spark, sf_dir):
    return dedup.title_classes(_read(spark, sf_dir, "part").select("p_partkey", T.normalize_title(F.col("p_name")).alias("t")), "p_partkey", "t")


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END, '') publisher, CASE WHEN o_orderkey % 3 <> 0 THEN '1999-01-01' WHEN o_orderkey % 7 <> 0 AND c_custkey IS NOT NULL THEN '2001-01-01' END published,
    CASE WHEN o_orderkey % 7 <> 0 AND c_custkey IS NOT NULL THEN c_name ELSE '' END authors FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_enrich(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "crossref").otherwise("other").alias("source_id"), F.col("o_custkey").cast("string").alias("doi"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("publisher"),
        F.when(k % 3 != 0, F.lit("1999-01-01").cast("date")).alias("publication_date"), F.array().cast("array<string>").alias("authors"),
    )
    found = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doi"), F.col("c_mktsegment").alias("publisher"), F.lit("2001-01-01").cast("date").alias("publication_date"), F.array("c_name").alias("authors"))
    return store.enrich(orders, found).select("o_orderkey", "publisher", F.col("publication_date").cast("string").alias("published"), F.array_join("authors", ";").alias("authors"))


# Policies, adoption and acquisition over pages.
_POLICY = "CASE page_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'oa_only' WHEN 2 THEN 'link_only' ELSE 'manual_review' END"
_ROUTE = "CASE page_id % 7 WHEN 0 THEN 'ssrn' WHEN 1 THEN 'riss' END"
_AT = "CASE page_id % 14 WHEN 0 THEN 'https://papers.SSRN.com/x' WHEN 1 THEN 'https://www.riss.kr/x' ELSE url END"


@query(f"""WITH p AS (SELECT page_id, {_POLICY} pol, {_ROUTE} route, lower({_AT}) u, page_id % 5 = 0 page, page_id % 2 = 0 op, page_id % 3 = 0 unlicensed FROM pages),
    r AS (SELECT page_id, CASE WHEN route = 'ssrn' THEN CASE WHEN pol = 'link_only' THEN 'link_only' WHEN NOT op OR unlicensed THEN 'no_open_license' WHEN contains(u, 'ssrn.com') THEN 'own_site' ELSE 'ok' END WHEN route = 'riss' AND contains(u, 'riss.kr') THEN 'own_site'
      WHEN pol = 'link_only' THEN 'link_only' WHEN pol = 'manual_review' THEN 'manual_review' WHEN pol = 'oa_only' AND NOT op THEN 'not_open' WHEN page THEN 'landing_page' ELSE 'ok' END reason FROM p)
    SELECT page_id, reason, reason = 'ok' allowed, CASE WHEN reason <> 'ok' THEN 'POLICY_BLOCKED' END error_code FROM r""")
def q_access_policy(spark, sf_dir):
    k = F.col("page_id")
    kind, licence = F.when(k % 5 == 0, "LANDING_PAGE").otherwise("DIRECT_FILE"), F.when(k % 3 == 0, "").otherwise("CC BY")
    d = policy.access_decision(F.expr(_POLICY), kind, k % 2 == 0, F.expr(_AT), licence, F.expr(_ROUTE))
    return _read(spark, sf_dir, "pages").select("page_id", d.alias("d")).select("page_id", "d.reason", "d.allowed", "d.error_code")


_LANDING = "CASE page_id % 6 WHEN 0 THEN concat('https://papers.ssrn.com/sol3/papers.cfm?abstract_id=', page_id, '&rec=1') WHEN 1 THEN concat('https://www.riss.kr/link?control_no=R', page_id) ELSE url END"


@query(f"""WITH p AS (SELECT page_id, {_LANDING} l, CASE WHEN page_id % 6 = 2 THEN '10.2139/ssrn.' || page_id ELSE '' END doi, CASE WHEN page_id % 4 = 0 THEN 'own:1' ELSE '' END i, CASE WHEN page_id % 6 = 1 AND page_id % 5 = 0 THEN 'https://riss.kr/a.pdf' ELSE url END d, page_id % 9 <> 0 unknown FROM pages),
    r AS (SELECT *, CASE WHEN contains(l, 'ssrn.com') OR contains(doi, '10.2139/ssrn') THEN 'ssrn' WHEN contains(l, 'riss.kr') OR contains(d, 'riss.kr') THEN 'riss' ELSE '' END p FROM p),
    x AS (SELECT *, CASE WHEN p = 'ssrn' AND unknown THEN '' WHEN p = 'riss' AND contains(d, 'riss.kr') THEN '' ELSE d END dl FROM r)
    SELECT page_id, CASE WHEN p = 'ssrn' THEN 'ssrn:' || page_id WHEN p = 'riss' AND i = '' AND contains(l, 'control_no') THEN 'riss:R' || page_id ELSE i END official_identifier,
      CASE WHEN p = 'ssrn' THEN 'https://papers.ssrn.com/sol3/papers.cfm?abstract_id=' || page_id ELSE l END landing_url, CASE WHEN p = 'ssrn' THEN '10.2139/ssrn.' || page_id ELSE doi END doi, dl download_url, '' oa_url, CASE WHEN p = 'ssrn' THEN 'SSRN' ELSE '' END publisher,
      CASE WHEN (p = 'ssrn' AND unknown) OR (p = 'riss' AND dl = '') THEN 'LINK_ONLY' ELSE 'PENDING' END access_mode FROM x""")
def q_adopt(spark, sf_dir):
    k = F.col("page_id")
    rows = _read(spark, sf_dir, "pages").select(
        "page_id", F.expr(_LANDING).alias("landing_url"), F.when(k % 6 == 2, F.concat(F.lit("10.2139/ssrn."), k)).otherwise("").alias("doi"), F.when(k % 4 == 0, "own:1").otherwise("").alias("official_identifier"),
        F.when((k % 6 == 1) & (k % 5 == 0), "https://riss.kr/a.pdf").otherwise(F.col("url")).alias("download_url"), F.lit("").alias("oa_url"), F.lit("").alias("publisher"), F.lit("PENDING").alias("access_mode"), (k % 9 != 0).alias("license_unknown"),
    )
    return policy.adopt(rows).select("page_id", "official_identifier", "landing_url", "doi", "download_url", "oa_url", "publisher", "access_mode")


_SUFFIX = "CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.hwpx' WHEN 2 THEN '.hwp' WHEN 3 THEN '.docx' ELSE '.bin' END"
_HEAD = "CASE page_id % 6 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'MZ' WHEN 2 THEN '#!' WHEN 3 THEN 'PK' WHEN 4 THEN '%PDF-' ELSE '' END"


@query(f"""WITH p AS (SELECT page_id, {_HEAD} || CASE WHEN page_id % 7 = 0 THEN html ELSE md5(url) || coalesce(html, '') END c, {_SUFFIX} s, page_id % 8 = 0 zipped, page_id % 16 = 0 good, page_id % 3 FROM pages),
    b AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE repeat('z', CASE WHEN page_id % 13 = 0 THEN 10 ELSE 3000 END) END pad, {_HEAD} h, {_SUFFIX} s, page_id % 8 = 0 zipped, page_id % 16 = 0 good, page_id % 3 = 0 typed, page_id % 7 = 0 html FROM pages),
    r AS (SELECT page_id, CASE WHEN pad IS NULL THEN 'missing' WHEN length(h) + length(pad) + CASE WHEN html THEN 6 ELSE 0 END < 1024 THEN 'too_small' WHEN h IN ('MZ', '#!') THEN 'executable' WHEN html THEN 'html' WHEN s = '.pdf' THEN CASE WHEN NOT starts_with(h, '%PDF-') THEN 'no_pdf_signature' ELSE 'ok' END
      WHEN s = '.hwpx' THEN CASE WHEN NOT zipped THEN 'bad_zip' WHEN NOT good THEN 'no_document' ELSE 'ok' END WHEN s = '.hwp' THEN 'no_hwp_signature' WHEN s = '.docx' THEN CASE WHEN NOT zipped THEN 'bad_zip' ELSE 'no_document' END WHEN typed THEN 'content_type' ELSE 'ok' END reason FROM b)
    SELECT page_id, reason, reason = 'executable' quarantine, CASE WHEN reason IN ('missing', 'no_pdf_signature', 'no_hwp_signature', 'bad_zip', 'no_document') THEN 'FILE_CORRUPTED' WHEN reason <> 'ok' THEN 'FILE_NOT_DOCUMENT' END error_code FROM r""")
def q_file_check(spark, sf_dir):
    k = F.col("page_id")
    pad = F.when(k % 11 != 0, F.repeat(F.lit("z"), F.when(k % 13 == 0, 10).otherwise(3000)))
    content = F.concat(F.expr(_HEAD), F.when(k % 7 == 0, "<HTML ").otherwise(""), pad).cast("binary")
    members = F.when(k % 16 == 0, F.array(F.lit("Contents/section0.xml"))).when(k % 8 == 0, F.array(F.lit("x")))
    check = policy.file_check(content, F.length(content), F.expr(_SUFFIX), F.when(k % 3 == 0, "text/plain").otherwise("application/PDF"), members)
    return _read(spark, sf_dir, "pages").select("page_id", check.alias("c")).select("page_id", "c.reason", "c.quarantine", "c.error_code")


_STATUS = "CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE 200 END"


@query(f"""WITH p AS (SELECT page_id, {_POLICY} pol, 40 + page_id % 41 score, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END own, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END oa, page_id % 2 = 0 unknown, url, {_STATUS} status, page_id FROM pages),
    c AS (SELECT *, CASE WHEN pol = 'link_only' THEN '' ELSE own END mine FROM p), d AS (SELECT *, CASE WHEN mine <> '' THEN mine ELSE oa END cand, mine <> '' m FROM c),
    l AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://') OR regexp_matches(lower(url), 'jsessionid|sessionid|phpsessid|tempfile|token=|expires=') THEN 'LINK_EXPIRED' WHEN status = 403 THEN 'LOGIN_REQUIRED' WHEN status <> 200 THEN 'LINK_EXPIRED' END link,
      m AND page_id % 17 = 0 landing FROM d),
    o AS (SELECT *, CASE WHEN score < 55 THEN 'low_score' WHEN cand = '' THEN 'no_candidate' WHEN pol IN ('link_only', 'manual_review') OR (pol = 'oa_only' AND m AND unknown) OR landing THEN 'policy' WHEN link IS NOT NULL THEN 'link' WHEN page_id % 9 = 0 THEN 'page_mismatch'
      WHEN page_id % 11 = 0 THEN 'download' WHEN page_id % 13 = 0 THEN 'quarantine' WHEN page_id % 13 = 1 THEN 'file' WHEN page_id % 19 = 0 THEN 'duplicate_file' WHEN page_id % 4 <> 0 AND page_id % 23 = 1 THEN 'duplicate_text' ELSE 'downloaded' END outcome FROM l),
    e AS (SELECT *, CASE outcome WHEN 'link' THEN link WHEN 'download' THEN 'DOWNLOAD_FAILED' WHEN 'quarantine' THEN 'FILE_NOT_DOCUMENT' WHEN 'file' THEN 'FILE_CORRUPTED' END bad FROM o)
    SELECT page_id, outcome, coalesce(bad, CASE WHEN outcome = 'page_mismatch' THEN 'LINK_EXPIRED' WHEN outcome LIKE 'duplicate%' THEN 'DUPLICATE_FILE' END) error_code, coalesce(bad, CASE WHEN outcome = 'policy' THEN 'POLICY_BLOCKED' WHEN outcome = 'downloaded' AND page_id % 4 = 0 THEN 'TEXT_EXTRACTION_FAILED' END) log_code,
      CASE WHEN outcome = 'downloaded' THEN 'DOWNLOADED' ELSE 'LINK_ONLY' END access_mode, CASE WHEN outcome = 'quarantine' THEN 'QUARANTINED' ELSE 'NEW' END status FROM e""")
def q_acquire(spark, sf_dir):
    k = F.col("page_id")
    file = F.struct((~(k % 13).isin(0, 1)).alias("valid"), (k % 13 == 0).alias("quarantine"), F.when(k % 13 == 0, "FILE_NOT_DOCUMENT").when(k % 13 == 1, "FILE_CORRUPTED").alias("error_code"))
    rows = _read(spark, sf_dir, "pages").select(
        "page_id", F.expr(_POLICY).alias("policy"), (40 + k % 41).alias("relevance_score"), F.when(k % 5 == 0, "").otherwise(F.col("url")).alias("download_url"), F.lit("").alias("oa_url"), F.when(k % 3 == 0, F.col("url")).alias("oa_candidate"),
        (k % 2 == 0).alias("license_unknown"), F.lit("CC BY").alias("license"), F.col("url").alias("landing_url"), F.lit("").alias("doi"), F.lit("NEW").alias("status"), F.when(k % 17 == 0, "LANDING_PAGE").otherwise("DIRECT_FILE").alias("kind"),
        policy.link_access(F.col("url"), F.expr(_STATUS), F.lit("application/pdf"), F.lit("")).alias("link"), F.struct((k % 9 != 0).alias("valid")).alias("match"), F.struct((k % 11 != 0).alias("success"), F.lit("DOWNLOAD_FAILED").alias("error_code")).alias("download"),
        file.alias("file"), (k % 19 == 0).alias("file_known"), (k % 23 == 1).alias("text_known"), (k % 4 == 0).alias("extract_failed"),
    )
    return policy.acquire(rows).select("page_id", "outcome", "error_code", "log_code", "access_mode", "status")


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url END own, CASE WHEN page_id % 2 = 0 THEN '10.1/' || page_id ELSE '' END doi FROM pages)
    SELECT page_id, coalesce(own, CASE WHEN doi <> '' AND page_id % 3 = 0 THEN 'http://u/' || page_id WHEN doi <> '' AND page_id % 7 = 0 THEN 'http://c/' || page_id END) oa_candidate,
      CASE WHEN own IS NOT NULL THEN 'record' WHEN doi <> '' AND page_id % 3 = 0 THEN 'unpaywall' WHEN doi <> '' AND page_id % 7 = 0 THEN 'core' END oa_resolver FROM r""")
def q_open_copy(spark, sf_dir):
    k = F.col("page_id")
    pages = _read(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.when(k % 5 == 0, F.col("url")).otherwise("").alias("oa_url"), (k % 5 != 0).alias("license_unknown"), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k)).otherwise("").alias("doi"))
    found = lambda site, n: pages.select(F.concat(F.lit("10.1/"), k).alias("doi"), F.when(k % n == 0, F.concat(F.lit(f"http://{site}/"), k)).otherwise("").alias("url"))
    return policy.resolve_open_copy(rows, [("unpaywall", found("u", 3)), ("core", found("c", 7))]).select("page_id", "oa_candidate", "oa_resolver")


# Text functions whose twins are spelt out piece by piece.
@query("SELECT page_id, 'GET /p' || page_id || '?api_key=***&key=***&OC=*** Bearer *** *** token=*** apikey=***' AS line FROM pages")
def q_mask_secrets(spark, sf_dir):
    n, h = F.col("page_id").cast("string"), F.md5("url")
    line = F.concat(F.lit("GET /p"), n, F.lit("?api_key="), h, F.lit("&key=k"), n, F.lit("&OC=o"), n, F.lit(" Bearer b"), h, F.lit(" known-value-1 token=t"), n, F.lit(" apikey=a"), n)
    return report.safe_log(_read(spark, sf_dir, "pages").select("page_id", line.alias("line")), "line", ["known-value-1", "short"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || doc_id WHEN doc_id % 3 = 1 THEN 'id:kci:' || doc_id ELSE 'title:' || left(sha256('study of ' || source || '|2024'), 16) END work_id FROM documents")
def q_work_id(spark, sf_dir):
    k = F.col("doc_id")
    doi, identifier = F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k)).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("kci:"), k)).otherwise("")
    return _read(spark, sf_dir, "documents").select("doc_id", T.work_id(doi, identifier, T.normalize_title(F.concat(F.lit("Study,  of "), "source", F.lit("!"))), F.lit(2024)).alias("work_id"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) escaped FROM documents")
def q_html_escape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.html_escape(F.coalesce("text", F.lit("")))).alias("escaped"))


@query("SELECT doc_id, '10.1234/ab-' || doc_id doi, 'https://doi.org/10.1234/ab-' || doc_id url FROM documents")
def q_doi(spark, sf_dir):
    doi = T.normalize_doi(F.concat(F.lit(" see DOI:10.1234/AB-"), "doc_id", F.lit(".,; more")))
    return _read(spark, sf_dir, "documents").select("doc_id", doi.alias("doi"), T.doi_url(doi).alias("url"))


@query("SELECT doc_id, source || '|Kim A|Lee' authors, 'law|' || source keywords FROM documents")
def q_names_and_keywords(spark, sf_dir):
    names = T.authors_from_string(F.concat("source", F.lit(";  Kim  A and Lee,")))
    words = T.distinct_ignoring_case(F.array(F.lit(" law"), F.lit("LAW "), F.lit(""), F.col("source"), F.upper("source")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(names, "|").alias("authors"), F.array_join(words, "|").alias("keywords"))


@query(rf"SELECT page_id, md5({_CLEAN.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) plain FROM pages")
def q_strip_tags(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("plain"))


# Manifest and export in full.
_SHARED = {
    "제목": "CASE WHEN doc_id % 2 = 0 THEN 'K' || doc_id ELSE 'Study ' || doc_id END", "원문제목": "'Study ' || doc_id", "출처": "source", "발행기관": "'P'", "발행일": _DUCK_DAY, "등록일": "''", "수정일": _DUCK_DAY, "문서유형": "'기타'", "주제": "'01'",
    "링크": "CASE WHEN doc_id % 4 = 0 THEN 'http://o/' || doc_id ELSE 'http://l/' || doc_id END", "DOI": "''", "공식ID": "source || ':' || doc_id", "파일해시": "CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE '' END", "중요도": "(doc_id % 100)::INT", "우선순위": "'P3'",
    "요약근거수준": "'FULLTEXT'", "발견검색어": "'q'", "검색어사전버전": "'v1'", "확장검색어": "'a, b'", "라이선스": "CASE doc_id % 3 WHEN 0 THEN 'CC BY' WHEN 1 THEN '불명확' ELSE '' END",
}
_MANIFEST_SQL = _SHARED | {"수집일": "'2026-08-22'", "신규수정구분": "'NEW'", "원문저장여부": "CASE WHEN doc_id % 3 = 0 THEN '저장' ELSE '링크만' END", "최종저장경로": "CASE WHEN doc_id % 3 = 0 THEN '/x' ELSE '' END", "텍스트해시": "md5(text)", "요약상태": "CASE WHEN text = '' THEN '미생성' ELSE '생성' END", "오류검토필요": "CASE WHEN doc_id % 10 = 0 THEN 'PAYWALL' ELSE '' END"}
_EXPORT_SQL = _SHARED | {"수집일": "'2026-08-20'", "상태": "'NEW'", "저자": "'Kim, ' || source", "학술지_시리즈": "'J'", "원문접근": "'LINK_ONLY'", "저장경로": "CASE WHEN doc_id % 3 = 0 THEN '/x' ELSE '' END", "OA링크": "'http://o/' || doc_id", "요약": f"left({_TEXT}, 900)", "오류코드": "CASE WHEN doc_id % 10 = 0 THEN 'PAYWALL' ELSE '' END"}


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lit = F.col("doc_id"), F.lit
    third = lambda c: F.when(k % 3 == 0, c).otherwise("")
    day = F.expr(_DAY).cast("date")
    return _read(spark, sf_dir, "documents").select(
        lit("NEW").alias("status"), F.when(k % 2 == 0, F.concat(lit("K"), k)).otherwise("").alias("title_ko"), F.concat(lit("Study "), k).alias("title_original"), F.array(lit("Kim"), F.col("source")).alias("authors"), lit("P").alias("publisher"), lit("J").alias("journal_or_series"),
        day.alias("publication_date"), lit(None).cast("date").alias("source_registered_date"), day.alias("source_modified_date"), F.col("source").alias("source_id"), lit("기타").alias("document_type"), lit("01").alias("topic_primary"), (k % 100).cast("int").alias("relevance_score"), lit("P3").alias("priority_level"),
        lit("LINK_ONLY").alias("access_mode"), third(lit("/x")).alias("file_path"), F.when(k % 4 == 0, "").otherwise(F.concat(lit("http://l/"), k)).alias("landing_url"), F.concat(lit("http://o/"), k).alias("oa_url"), lit("").alias("download_url"), lit(None).cast("string").alias("doi"),
        F.concat("source", lit(":"), k).alias("official_identifier"), third(lit("CC BY")).alias("license"), (k % 3 == 1).alias("license_unknown"), lit("FULLTEXT").alias("summary_basis"), F.col("text").alias("summary_ko"), lit("q").alias("discovered_by_query"), lit("v1").alias("query_dictionary_version"),
        F.array(lit("a"), lit("b")).alias("query_terms_expanded"), third(F.md5("text")).alias("file_sha256"), F.md5("text").alias("text_sha256"), F.when(k % 10 == 0, "PAYWALL").alias("error_code"), lit("2026-08-20 10:00:00").cast("timestamp").alias("first_seen_at"),
    )


@query("SELECT " + ", ".join(f'{v} "{k}"' for k, v in _MANIFEST_SQL.items()) + " FROM documents")
def q_manifest_rows(spark, sf_dir):
    return store.manifest_rows(_stored_documents(spark, sf_dir), F.lit("2026-08-22"))


@query("SELECT " + ", ".join(f'{v} "{k}"' for k, v in _EXPORT_SQL.items()) + " FROM documents")
def q_export_rows(spark, sf_dir):
    return store.export_rows(_stored_documents(spark, sf_dir))


@query(f"""WITH f AS (SELECT doc_id, lang folder, upper({_PART_SQL.format('source')}) || '.pdf' AS name FROM documents)
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '__' || CASE doc_id % 3 WHEN 0 THEN left(md5(doc_id::VARCHAR), 8) WHEN 1 THEN left(sha256('10.1/' || doc_id), 8) ELSE left('r' || doc_id, 8) END || '.pdf' END stored_name FROM f""")
def q_collision_suffix(spark, sf_dir):
    k = F.col("doc_id")
    digest, doi = F.when(k % 3 == 0, F.md5(k.cast("string"))).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("10.1/"), k)).otherwise("")
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("folder"), F.concat(F.upper(T.filename_part(F.col("source"))), F.lit(".pdf")).alias("name"), store.collision_suffix(digest, doi, F.concat(F.lit("-r-"), k)).alias("suffix"))
    return store.file_names(rows, "folder", "name", "doc_id", F.col("suffix")).select("doc_id", "stored_name")


# Runs and bookkeeping over events.
_RUN = "'run-' || user_id % 50"


@query(f"""WITH i AS (SELECT {_RUN} run_id, * FROM events), r AS (SELECT run_id, count(*) FILTER (event_type = 'signup') new_count, count(*) FILTER (event_type = 'purchase') updated_count, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) failed_sources FROM i WHERE user_id % 50 <> 7 GROUP BY run_id)
    SELECT DISTINCT i.run_id, CASE WHEN r.run_id IS NULL THEN 'RUNNING' WHEN failed_sources > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END status, new_count, updated_count, failed_sources FROM i LEFT JOIN r USING (run_id)""")
def q_run_finish(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("run_id", F.concat(F.lit("run-"), F.col("user_id") % 50))
    started = events.select("run_id", F.lit("RUNNING").alias("status")).distinct()
    items = events.select("run_id", F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "purchase", "UPDATED").otherwise("DUPLICATE").alias("outcome"))
    errors = events.where("event_type = 'error'").select("run_id", F.col("user_id").cast("string").alias("source_id"))
    reports = runs.run_reports(items, errors, F.lit("2026-08-22").cast("timestamp")).where("run_id <> 'run-7'")
    return runs.finish_runs(started, reports).select("run_id", "status", "new_count", "updated_count", "failed_sources")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN '2026-08-22' ELSE o_orderdate::DATE::VARCHAR END seen FROM orders")
def q_touch(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource_id"), F.to_date("o_orderdate").alias("seen"))
    ids = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("resource_id"))
    return store.touch(orders, ids, "seen", F.lit("2026-08-22").cast("date")).select(F.col("resource_id").alias("o_orderkey"), F.col("seen").cast("string").alias("seen"))


@query("""WITH o AS (SELECT s_suppkey k, s_name, s_acctbal FROM supplier), n AS (SELECT c_custkey k, c_name FROM customer) SELECT coalesce(n.k, o.k) k, coalesce(c_name, s_name) AS name, s_acctbal balance FROM o FULL JOIN n ON o.k = n.k""")
def q_sync_dimension(spark, sf_dir):
    old = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    return store.sync_dimension(old, new, "k", ["balance"])


@query("SELECT 'found' kind, source_id FROM (SELECT DISTINCT source source_id FROM documents) WHERE source_id IN (SELECT 'src' || n_nationkey FROM nation) UNION ALL SELECT 'missing', 'src' || n_nationkey FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents)")
def q_source_subset(spark, sf_dir):
    sources = _read(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    found, missing = runs.source_subset(sources, _read(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("source_id")))
    return found.select(F.lit("found").alias("kind"), "source_id").union(missing.select(F.lit("missing").alias("kind"), "source_id"))


@query("SELECT (SELECT count(*) FROM documents) resources, (SELECT count(*) FROM pages) files, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) downloaded, (SELECT count(*) FROM documents WHERE doc_id % 3 = 1) link_only, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) with_doi, (SELECT count(*) FROM events WHERE event_type = 'error') errors, (SELECT count(*) FROM nation) runs")
def q_repository_counts(spark, sf_dir):
    k = F.col("doc_id")
    docs = _read(spark, sf_dir, "documents").select(F.when(k % 3 == 0, "DOWNLOADED").when(k % 3 == 1, "LINK_ONLY").otherwise("PENDING").alias("access_mode"), F.when(k % 5 == 0, "10.1/x").otherwise("").alias("doi"))
    return store.repository_counts(docs, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "events").where("event_type = 'error'"), _read(spark, sf_dir, "nation"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'éèêàâîïôûùçüöä', 'eeeaaiiouucuoa'), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM documents), l AS (SELECT doc_id, len(w) n FROM t), g AS (SELECT count(*) nd, avg(n) av FROM l),
    p AS (SELECT doc_id, unnest(w) term FROM t), h AS (SELECT doc_id, count(*) tf FROM p WHERE term = 'license' GROUP BY doc_id), f AS (SELECT count(*) df FROM h),
    s AS (SELECT doc_id, greatest(ln((nd - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av)) s FROM h JOIN l USING (doc_id), g, f)
    SELECT 'doc-' || doc_id resource_id, source, round(s, 6) score FROM s JOIN documents USING (doc_id) ORDER BY s DESC, 'doc-' || doc_id LIMIT 20""")
def q_search_resources(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("resource_id"), "source", "text")
    hits = search.search(search.build_index(docs, "resource_id", ["text"]), "license", 20)
    return search.hits_with_resources(hits, docs.drop("text")).select("resource_id", "source", F.round("score", 6).alias("score"))


# Scans: windows, request plans, query matching, paging; feeds; the remaining sources.
_normaliser(
    "nars",
    f"""'title', {_TITLE}, 'author', 'Kim; Lee', 'deptName', 'O', 'publishDate', {_DAY}, 'regDate', {_DAY}, 'brdSeq', doc_id, 'linkUrl', 'http://n/1', 'fileUrl', 'http://n/1.pdf', 'summary', text, 'reportType', {_KIND}""",
    official_identifier="source || ':' || doc_id", authors="'Kim; Lee'", publisher="'O'", published=_DUCK_DAY, registered=_DUCK_DAY, modified=_DUCK_DAY, landing_url="'http://n/1'", download_url="'http://n/1.pdf'", language="'en'",
    document_type="CASE doc_id % 3 WHEN 0 THEN '학술논문' ELSE '연구보고서' END", abstract=_TEXT,
)
_normaliser(
    "assembly_open",
    f"""'title', {_TITLE}, 'FILE_URL', concat('http://a/v?doc_id=', doc_id, '&x=1'), 'REG_DATE', {_DAY}, 'AUTHOR', 'Kim', 'SUMMARY', text""",
    official_identifier="source || ':' || doc_id", authors="'Kim'", published=_DUCK_DAY, download_url="'http://a/v?doc_id=' || doc_id || '&x=1'", language="'ko'", abstract=_TEXT,
)


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'")
def q_window_filter(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.to_date("ts")).alias("day"))
    return scan.within(rows, F.lit("2024-01-03").cast("date"), F.lit("2024-01-10").cast("date"), "day").select("event_id")


@query("SELECT n_name query_string, y AS year, r_name target FROM nation, unnest(range(2023, 2027)) u(y), region")
def q_request_plans(spark, sf_dir):
    queries = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("query_string"))
    years = scan.by_year(queries, F.lit("2023-11-05").cast("date"), F.lit("2026-02-01").cast("date"))
    return scan.by_target(_read(spark, sf_dir, "region").select(F.col("r_name").alias("target")), years).select("query_string", F.col("year").cast("long").alias("year"), "target")


#: Search terms with what excludes them, for the matching of texts.
MATCHED = [(1, "q1", ["license", "copyright"], ["apache"]), (2, "q2", ["edst", "the"], []), (3, "q3", [], [])]


def _matched(spark: SparkSession, sf_dir: str, annotate: bool) -> DataFrame:
    queries = spark.createDataFrame(MATCHED, "ord int, query_string string, terms array<string>, exclude_terms array<string>")
    return scan.match_queries(_read(spark, sf_dir, "documents"), F.col("text"), queries, annotate).select("doc_id", "discovered_by_query")


_HAS = "contains(lower(text), '{}')"
_FIRST_SQL = f"CASE WHEN ({_HAS.format('license')} OR {_HAS.format('copyright')}) {{}} THEN 'q1' WHEN {_HAS.format('edst')} OR {_HAS.format('the')} THEN 'q2' WHEN {_HAS.format('q3')} THEN 'q3' {{}} END"


@query(f"SELECT doc_id, discovered_by_query FROM (SELECT doc_id, {_FIRST_SQL.format('AND NOT ' + _HAS.format('apache'), '')} discovered_by_query FROM documents) WHERE discovered_by_query IS NOT NULL")
def q_query_match(spark, sf_dir):
    return _matched(spark, sf_dir, False)


@query(f"SELECT doc_id, {_FIRST_SQL.format('', 'ELSE ' + chr(39) + 'q1' + chr(39))} discovered_by_query FROM documents")
def q_query_annotate(spark, sf_dir):
    return _matched(spark, sf_dir, True)


@query("""WITH r AS (SELECT o_orderkey, o_custkey::VARCHAR query_string, 1 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) // 3 AS page, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate::DATE END published FROM orders),
    p AS (SELECT query_string, page, count(*) n, max(published) latest FROM r GROUP BY ALL), l AS (SELECT query_string, min(page) FILTER (n < 3 OR latest < DATE '1996-01-01') stop FROM p GROUP BY query_string)
    SELECT o_orderkey FROM r JOIN l USING (query_string) WHERE page <= 5 AND (stop IS NULL OR page <= stop) AND (published IS NULL OR published >= DATE '1996-01-01')""")
def q_page_stop(spark, sf_dir):
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("query_string"), (1 + F.floor((place - 1) / 3)).alias("page"), F.when(k % 8 != 0, F.to_date("o_orderdate")).alias("published"))
    return scan.read_pages(rows, F.lit("1996-01-01").cast("date"), 3).select("o_orderkey")


@query("SELECT user_id, min(event_id) event_id FROM events WHERE event_id % 5 <> 0 GROUP BY user_id UNION ALL SELECT NULL, min(event_id) FROM events WHERE event_id % 5 = 0 GROUP BY event_type")
def q_drop_repeats(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).otherwise("").alias("k"))
    return scan.drop_repeats(rows, "k", "event_type", ["event_id"]).select("user_id", "event_id")


@query(f"SELECT {_DUCK_TITLE} title, source || ':g' || doc_id official_identifier, {_DUCK_DAY} published, 'http://f/' || doc_id || '.PDF' download_url, 'law' keywords FROM documents")
def q_rss_items(spark, sf_dir):
    item = F.concat(F.lit("<item><title>"), F.expr(_TITLE), F.lit("</title><guid>g"), F.col("doc_id"), F.lit("</guid><link>http://l/1</link><pubDate>"), F.expr(_DAY), F.lit("</pubDate><enclosure url='http://f/x.png'/><enclosure url='http://f/"), F.col("doc_id"), F.lit(".PDF'/><category>law</category></item>"))
    pages = _read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("xml"))
    got = _flat(payloads.normalize(readers.rss_items(pages), "institution_feed"))
    return got.select("title", "official_identifier", "published", "download_url", "keywords")


@query("""SELECT doc_id, CASE WHEN text <> '' AND doc_id % 3 = 0 THEN '초록 기준 (원문 전체 미분석)' WHEN doc_id % 3 = 1 OR text = '' THEN '제목·키워드·서지정보 기준' ELSE '원문 전체 1쪽 기준' END evidence_scope,
    CASE WHEN doc_id % 3 = 1 OR text = '' THEN '원문·초록을 확보하지 못해 내용 분석을 수행하지 않았습니다.' END practical, CASE WHEN doc_id % 3 = 1 OR text = '' THEN 'P 발간 ''Study ' || doc_id || '''' END headline,
    CASE WHEN doc_id % 3 = 1 OR text = '' THEN '발행기관: P|발행일: 미상|문서유형: 기타' END points FROM documents""")
def q_summary_record(spark, sf_dir):
    k = F.col("doc_id")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 3 == 2, F.col("text")).otherwise("").alias("fulltext"), F.lit(False).alias("text_extract_failed"), F.when(k % 3 == 0, F.col("text")).otherwise("").alias("abstract_original"), F.lit("").alias("title_ko"),
        F.concat(F.lit("Study "), k).alias("title_original"), F.lit("P").alias("publisher"), F.col("source").alias("source_id"), F.lit(None).cast("date").alias("publication_date"), F.lit("기타").alias("document_type"), F.lit("01").alias("topic_primary"), F.array(F.lit("none of it")).alias("pages"),
    )
    bare = F.col("summary_basis") == "METADATA_ONLY"
    return M.summary_record(rows).select("doc_id", "evidence_scope", F.when(bare, F.col("practical_meaning")).alias("practical"), F.when(bare, F.col("headline")).alias("headline"), F.when(bare, F.array_join("key_points", "|")).alias("points"))


# Reports.
@query("SELECT count(*) FILTER (o_orderstatus = 'F') n_p1, count(*) FILTER (o_orderstatus = 'O') n_p2, count(*) FILTER (o_orderkey % 2 = 0) n_new, count(*) FILTER (o_orderkey % 2 = 1) n_updated, (SELECT count(*) FROM nation) n_failed FROM orders")
def q_briefing_counts(spark, sf_dir):
    level = F.when(F.col("o_orderstatus") == "F", "P1").when(F.col("o_orderstatus") == "O", "P2").otherwise("P3")
    rows = _read(spark, sf_dir, "orders").select(level.alias("priority_level"), F.when(F.col("o_orderkey") % 2 == 0, "NEW").otherwise("UPDATED").alias("outcome"))
    return report.briefing_counts(rows, _read(spark, sf_dir, "nation"))


@query("SELECT n_name topic_id, count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) n_files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def q_library_stats(spark, sf_dir):
    nations, customers = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    stored = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("topic_primary"), F.when(F.col("c_custkey") % 3 == 0, "/x").otherwise("").alias("file_path"))
    return report.library_stats(nations.select(F.col("n_name").alias("topic_id")), stored)


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 7")
def q_emit_cap(spark, sf_dir):
    return report.emit_cap(_read(spark, sf_dir, "events"), 7, "user_id", "event_id").select("event_id")


@query("""WITH r AS (SELECT DISTINCT url FROM pages) SELECT url, lower(regexp_extract(url, '://([^/?#]*)', 1)) host, (row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#]*)', 1)) ORDER BY url))::INT turn FROM r""")
def q_request_turns(spark, sf_dir):
    return report.request_plan(_read(spark, sf_dir, "pages").select(F.lit("GET").alias("method"), "url", F.lit("").alias("headers"))).select("url", "host", "turn")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://www.') OR starts_with(url, 'http://a')")
def q_registered_urls(spark, sf_dir):
    endpoints = spark.createDataFrame([("https://www.",), ("http://a",)], "endpoint string")
    return report.registered(_read(spark, sf_dir, "pages").select("page_id", "url"), endpoints).select("page_id")


@query("""SELECT n_name source_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'OAI_PMH' WHEN n_nationkey % 4 = 2 THEN 'OPEN_API' ELSE 'HTML' END preferred FROM nation""")
def q_preferred_method(spark, sf_dir):
    kinds = F.expr("case n_nationkey % 4 when 1 then array('HTML', 'OAI_PMH') when 2 then array('RSS', 'OPEN_API', 'OAI_PMH') when 3 then array('HTML') else cast(array() as array<string>) end")
    methods = F.transform(kinds, lambda t: F.struct(t.alias("type")))
    return _read(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), config.preferred_method(methods)["type"].alias("preferred"))


@query("""SELECT n_name source_id, CASE WHEN n_nationkey % 3 = 0 THEN 'no_endpoint' WHEN n_nationkey % 3 = 1 THEN 'usable' WHEN n_nationkey % 2 = 0 THEN 'usable' ELSE 'no_credential' END status,
    n_nationkey % 3 = 1 OR (n_nationkey % 3 = 2 AND n_nationkey % 2 = 0) source_usable FROM nation""")
def q_method_status(spark, sf_dir):
    k = F.col("n_nationkey")
    method = F.struct(F.lit("OPEN_API").alias("type"), F.when(k % 3 == 0, "").otherwise("http://e").alias("endpoint"), F.when(k % 3 == 2, F.concat(F.lit("KEY_"), k % 2)).otherwise("").alias("credential_env_var"))
    sources = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), F.lit(True).alias("enabled"), F.array(method).alias("access_methods"))
    return config.method_status(sources, spark.createDataFrame([("KEY_0",)], "name string")).select("source_id", "status", "source_usable")


@query("""SELECT 'w' || c_nationkey work_id, coalesce(arg_max(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_custkey), NULL) doi, arg_max(c_mktsegment, c_custkey) title, arg_min(c_name, c_custkey) first_author, min(c_custkey) first_key, count(*) n_resources FROM customer GROUP BY c_nationkey""")
def q_works(spark, sf_dir):
    k = F.col("c_custkey")
    when = F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int"))
    rows = _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("w"), "c_nationkey").alias("work_id"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("doi"), F.col("c_mktsegment").alias("title_original"), F.array("c_name").alias("authors"), F.lit(None).cast("date").alias("publication_date"),
        when.alias("first_seen_at"), when.alias("last_seen_at"),
    )
    return store.works(rows).select("work_id", "doi", "title", "first_author", F.datediff("created_at", F.lit("2020-01-01").cast("date")).cast("long").alias("first_key"), "n_resources")


@query("SELECT c_custkey resource_id, '<div class=''card''><h3>[P1] ' || c_name || '</h3><p>&lt;b&gt;' || c_mktsegment || '</p>' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '<p class=''warn''>라이선스 불명확</p>' END || '</div>' html FROM customer WHERE c_custkey % 3 = 0")
def q_cards(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select(k.alias("resource_id"), F.lit(1).alias("relevance_score"), F.when(k % 3 == 0, "P1").otherwise("P4").alias("priority_level"), F.lit("").alias("title_ko"), F.col("c_name").alias("title_original"), F.concat(F.lit("<b>"), "c_mktsegment").alias("summary_ko"), (k % 2 != 0).alias("license_unknown"))
    return report.cards(rows).select("resource_id", "html")


@query("WITH f AS (SELECT user_id, event_id, event_type <> 'error' ok FROM events), l AS (SELECT user_id, max(event_id) FILTER (ok) last FROM f GROUP BY user_id) SELECT user_id::VARCHAR source_id, count(*) consecutive_failures FROM f JOIN l USING (user_id) WHERE NOT ok AND (last IS NULL OR event_id > last) GROUP BY user_id HAVING count(*) >= 2")
def q_source_failures(spark, sf_dir):
    attempts = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return report.source_failures(runs.consecutive_failures(attempts, "source_id", ["event_id"], "ok"), 2)


@query("SELECT n_name source_id, (row_number() OVER (ORDER BY n_nationkey % 5 <> 0, n_regionkey, n_name))::INT place FROM nation WHERE n_nationkey % 7 <> 0")
def q_source_order(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    sources = nations.select(F.col("n_name").alias("source_id"), F.col("n_regionkey").alias("priority"), (F.col("n_nationkey") % 7 != 0).alias("enabled"))
    failed = nations.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("source_id"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("failed"), "priority", "source_id"))
    return runs.source_order(sources, failed).select("source_id", place.alias("place"))
