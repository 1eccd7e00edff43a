import io
import random
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioforge.operators import classify as C
from folioforge.operators import dedup, expand, policy, runs, score, search, store
from folioforge.operators import summarize as M
from folioforge.plans.catalogue import process, resource_from_documents, tally
from folioforge.sources import payloads, readers
from folioforge.streaming import incremental

LAW = C.Taxonomy(
    (
        C.Topic("01_군사법_군사사법", ("군사법원", "군검찰", "군사재판"), ("military court",)),
        C.Topic("05_형사_수사_사법", ("증거능력", "압수수색"), ("admissibility of evidence", "criminal procedure")),
        C.Topic(C.MULTI),
        C.Topic(C.UNCLASSIFIED),
    )
)
TODAY = date(2026, 8, 22)

#: A small dictionary of search terms.
TERMS = [
    ("작전법", ["작전 법"], ["교전규칙"], ["operational law", "law of operations"], ["OPLAW"], ["domestic", "international"], "07", 1, [], True),
    ("국제인도법", ["국제 인도법"], ["무력분쟁법"], ["international humanitarian law"], ["IHL"], ["domestic", "international"], "07", 1, [], True),
    ("형사소송법", ["형소법", "형사 소송법"], [], ["criminal procedure"], [], ["domestic", "international"], "05", 2, ["주석"], True),
    ("군인사법", [], ["진급"], [], [], ["domestic", "international"], "02", 2, [], False),
    ("부정당업자", ["부정당 업자"], [], [], [], ["domestic"], "04", 3, [], True),
]


def resource(spark, **values):
    base = {
        "resource_id": "r", "source_id": "crossref", "title_original": "", "title_ko": "", "abstract_original": "", "keywords": [], "fulltext": "", "access_mode": "LINK_ONLY", "oa_url": "",
        "download_url": "", "license_unknown": True, "document_type": "기타", "publication_date": date(2026, 8, 22), "source_registered_date": None, "text_extract_failed": False,
    } | values
    kinds = {"keywords": "array<string>", "license_unknown": "boolean", "publication_date": "date", "source_registered_date": "date", "text_extract_failed": "boolean"}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base))


def test_classification(spark):
    one = C.classify(resource(spark, title_ko="군사법원의 증거능력 판단 기준", abstract_original="군사법원 군검찰 군사재판"), LAW).first()
    assert one.topic_primary == "01_군사법_군사사법" and one.topics == ["01_군사법_군사사법", "05_형사_수사_사법"]
    two = C.classify(resource(spark, title_original="admissibility of evidence in a military court"), LAW).first()
    assert two.topic_primary == C.MULTI and len(two.topics) == 2
    none = C.classify(resource(spark, title_original="gardening"), LAW).first()
    assert none.topic_primary == C.UNCLASSIFIED and none.topics == [] and none.topic_confidence == 0
    hinted = C.classify(resource(spark, source_id="arxiv", title_original="gardening"), LAW).first()
    assert hinted.topic_primary == "08_AI_법률AI_디지털법"
    model = F.create_map(F.lit("09_x"), F.lit(2.0))
    assert C.classify(resource(spark, title_original="gardening"), LAW, model=model).first().topic_primary == "09_x"


def test_shares_below_a_quarter_are_unclassified(spark):
    five = C.Taxonomy(tuple(C.Topic(str(i), (f"word{i}",)) for i in range(5)))
    r = C.classify(resource(spark, abstract_original="word0 word1 word2 word3 word4"), five).first()
    assert r.topic_primary == C.UNCLASSIFIED and r.topics == ["0", "1", "2"] and r.topic_confidence == 0.2


def test_scores(spark):
    best = resource(spark, source_id="law_go_kr", document_type="법령", access_mode="DOWNLOADED").withColumns({"topic_primary": F.lit("01_군사법_군사사법"), "topic_confidence": F.lit(0.9)})
    row = score.score(best, F.lit(TODAY)).first()
    assert row.priority_level in ("P1", "P2") and row.relevance_score == row.score_breakdown.total == 90
    worst = resource(spark, source_id="zenodo", publication_date=date(2015, 1, 1)).withColumns({"topic_primary": F.lit(C.UNCLASSIFIED), "topic_confidence": F.lit(0.0)})
    low = score.score(worst, F.lit(TODAY)).first()
    assert low.priority_level in ("P3", "P4") and low.score_breakdown.topic_fit < 10 and 0 <= low.relevance_score < row.relevance_score


def test_version_fold_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(i, f"k{r.randint(0, 40)}", None if r.random() < 0.2 else date(2026, 1, r.randint(1, 28))) for i in range(600)]
    state, want = {}, {}
    for i, k, d in rows:
        if k not in state:
            want[i] = ("NEW", None)
        elif d and state[k][1] and d > state[k][1]:
            want[i] = ("NEW_VERSION", state[k][0])
        else:
            want[i] = ("DUPLICATE", state[k][0])
            continue
        state[k] = (i, d)
    got = dedup.version_fold(spark.createDataFrame(rows, "seq int, k string, m date"), "k", "m", "seq").collect()
    assert {x.seq: (x.verdict, x.base) for x in got} == want


def test_tiers_and_fuzzy_titles(spark):
    stored = spark.createDataFrame([("a", "10.1/x", "arxiv", "1", datetime(2026, 1, 1)), ("b", "10.1/x", "arxiv", "2", datetime(2026, 2, 1)), ("c", "", "arxiv", "", datetime(2026, 2, 1))], "resource_id string, doi string, source_id string, official_identifier string, last_seen_at timestamp")
    new = spark.createDataFrame([("n1", "10.1/x", "arxiv", "1"), ("n2", "", "arxiv", "1"), ("n3", "", "kci", "1"), ("n4", "", "arxiv", "")], "resource_id string, doi string, source_id string, official_identifier string")
    got = {r.resource_id: (r.match_id, r.matched_by) for r in dedup.tiered_match(new, stored, dedup.METADATA_TIERS).collect()}
    assert got == {"n1": ("b", "doi"), "n2": ("a", "official_identifier"), "n3": (None, None), "n4": (None, None)}
    titles = spark.createDataFrame([(1, "evidence in military courts today again", "kim"), (2, "evidence in military courts today again", "kim"), (3, "evidence in military courts today", "lee"), (4, "evidence in military courts today", ""), (5, "", "")], "i int, t string, a string")
    assert {(r.left_id, r.right_id) for r in dedup.fuzzy_pairs(titles, "i", "t", threshold=0.8, author="a").collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_licences_and_access(spark):
    raw = ["CC-BY 4.0", "by-nc-nd cc by", "", "공공누리 제1유형", "공공누리 제4유형", "all permitted", "strange"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").select("i", policy.assess_license(F.col("v")).alias("a")).orderBy("i")
    assert [(r.a.is_open, r.a.redistributable) for r in df.collect()] == [(True, True), (True, False), (False, False), (True, True), (True, False), (True, True), (False, False)]
    cases = [("http://x/a.pdf", 200, "application/pdf", ""), ("ftp://x", 200, "", ""), ("http://x/?token=1", 200, "", ""), ("http://x", 403, "", ""), ("http://x", 404, "", ""), ("http://x", 200, "text/HTML", "Please Log In"), ("http://x", None, "", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, u string, s int, t string, b string")
    got = df.select("i", policy.link_access(F.col("u"), F.col("s"), F.col("t"), F.col("b")).alias("x")).orderBy("i").collect()
    assert [r.x.error_code for r in got] == [None, "LINK_EXPIRED", "LINK_EXPIRED", "LOGIN_REQUIRED", "LINK_EXPIRED", "PAYWALL", "LINK_EXPIRED"]


def test_files(spark, tmp_path):
    def zipped(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, text in names.items():
                z.writestr(n, text)
        return out.getvalue() + b"\0" * 0

    body = "<w:p>본문 " + "글 " * 800 + "</w:p>"
    files = {
        "a.pdf": b"%PDF-1.7" + b"x" * 2000, "b.pdf": b"<!DOCTYPE html>" + b"x" * 2000, "c.pdf": b"x" * 2000, "d.pdf": b"%PDF", "e.pdf": b"MZ" + b"x" * 2000,
        "f.docx": zipped({"word/document.xml": body}), "g.hwpx": zipped({"Contents/section0.xml": body}), "h.docx": zipped({"other.xml": body}), "i.hwp": bytes.fromhex("d0cf11e0a1b11ae1") + b"x" * 2000,
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    df = readers.read_documents(spark, str(tmp_path)).withColumn("x", policy.file_check(F.col("content"), F.col("size"), F.col("suffix"), F.lit(""), F.col("members")))
    got = {r.path[-6:].lstrip("/"): r for r in df.collect()}
    reason = {k.split(".")[0][-1]: v.x.reason for k, v in got.items()}
    assert reason == {"a": "ok", "b": "html", "c": "no_pdf_signature", "d": "too_small", "e": "executable", "f": "ok", "g": "ok", "h": "no_document", "i": "ok"}
    assert next(v for k, v in got.items() if k.startswith("f.")).text.startswith("본문 글") and next(v for k, v in got.items() if k.startswith("e.")).x.quarantine


def test_search(spark):
    docs = spark.createDataFrame([(1, "military courts and evidence", "law"), (2, "courts of law", "evidence"), (3, "gardening", ""), (4, "evidence evidence courts military", "")], "id int, title string, body string")
    index = search.build_index(docs, "id", ["title", "body"])
    hits = lambda q: [r.id for r in search.search(index, q).collect()]
    assert set(hits("courts evidence")) == {1, 2, 4} and set(hits('"military courts"')) == {1} and hits("gard*") == [3]
    assert set(hits("courts NOT military")) == {2} and set(hits("gardening OR law")) == {1, 2, 3} and set(hits("body:evidence")) == {2} and hits("NOT law") == [] and hits("zzz") == []
    assert [r.id for r in search.search_like(docs, "EVID", ["title", "body"], [F.col("id")]).collect()] == [1, 2, 4]


def test_summaries(spark):
    text = "The court should apply the new evidence rules to every case. However, evidence rules have limits in court practice today.\nShort. 123 456 789 000 111 222 333 444.\nGardening is pleasant in the summer months of the year."
    r = M.summarize(resource(spark, abstract_original=text)).first()
    assert r.summary_basis == "ABSTRACT" and len(r.key_points) == 3 and "evidence" in r.headline and r.practical_meaning.startswith("The court should") and r.caveats.startswith("However")
    empty = M.summarize(resource(spark)).first()
    assert empty.summary_basis == "METADATA_ONLY" and empty.key_points == [] and empty.headline is None
    pages = spark.createDataFrame([(["intro", "The COURT should apply"], "the court should")], "p array<string>, s string")
    assert pages.select(M.page_of(F.col("p"), F.col("s"))).first()[0] == 2


def test_store(spark):
    old = spark.createDataFrame([("a", "t1", "auth1", "w1"), ("b", "t2", "auth2", "w2")], "resource_id string, title_ko string, authors string, work_id string")
    new = spark.createDataFrame([("b", "T2", "AUTH", ""), ("c", "t3", "auth3", "w3")], old.schema)
    got = {tuple(r) for r in store.upsert(old, new, "resource_id", ["title_ko"], ["work_id"], True).collect()}
    assert got == {("a", "t1", "auth1", "w1"), ("b", "T2", "auth2", "w2"), ("c", "t3", "auth3", "w3")}
    again = store.upsert(store.upsert(old, new, "resource_id", ["title_ko"], ["work_id"], True), new, "resource_id", ["title_ko"], ["work_id"], True)
    assert {tuple(r) for r in again.collect()} == got
    assert {tuple(r) for r in store.insert_ignore(old.select("resource_id", "title_ko"), new.select("resource_id", "title_ko"), ["resource_id"], ["title_ko"]).collect()} == {("a", "t1"), ("b", "t2"), ("c", "t3")}


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "resource_id string, n int")
    path = f"{tmp_path}/manifest"
    store.write_manifest(rows, path, "r1", "2026-08-22")
    store.write_manifest(rows, path, "r2", "2026-08-22")
    (tmp_path / "manifest/year=2026/month=08/zz.json").write_text('{"resource_id": "c", "n": 3}\n{broken\n')
    got = store.read_manifest(spark, path, "resource_id string, n int")
    assert sorted((r.resource_id, r.n) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_runs(spark):
    table = spark.createDataFrame([("DAILY", datetime(2026, 8, 15, 7), datetime(2026, 8, 15, 8)), ("DAILY", datetime(2026, 8, 20, 7), None)], "run_type string, started_at timestamp, finished_at timestamp")
    until, start = date(2026, 8, 22), date(2020, 1, 1)
    assert runs.run_window(table, until, "DAILY", start) == (date(2026, 8, 12), until)
    assert runs.run_window(table, until, "MONTHLY", start) == (date(2026, 7, 8), until) and runs.run_window(table, until, "BACKFILL", start) == (start, until)
    assert runs.run_window(table.limit(0), until, "DAILY", start) == (start, until) and runs.run_window(table, until, "DAILY", start, date(2026, 1, 1))[0] == date(2026, 1, 1)
    attempts = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, True)], "s string, t int, ok boolean")
    assert {r.s: r.consecutive_failures for r in runs.consecutive_failures(attempts, "s", ["t"], "ok").collect()} == {"a": 2, "b": 1, "c": 0}


def test_query_expansion(spark):
    terms = spark.createDataFrame(TERMS, expand.TERM_SCHEMA)
    en = expand.build_queries(terms, "en", 12).collect()
    assert en[0].query in ('"international humanitarian law" OR IHL', '"operational law" OR "law of operations" OR OPLAW') and all(not any("가" <= c <= "힣" for c in r.query) for r in en) and len(en) == 3
    assert expand.build_queries(terms, "ko", 2).count() == 2


CROSSREF = """{"DOI": "10.1234/ABC", "title": ["Evidence  Admissibility"], "author": [{"given": "Gildong", "family": "Hong"}], "container-title": ["J"], "issued": {"date-parts": [[2026, 5, 1]]},
 "license": [{"URL": ""}, {"URL": "https://creativecommons.org/licenses/by/4.0"}], "link": [{"content-type": "application/pdf", "URL": "http://x/a.pdf"}], "abstract": "<jats:p>An <b>abstract</b></jats:p>", "type": "journal-article", "subject": ["Law"]}"""


def test_payloads(spark):
    raw = lambda source, *docs: spark.createDataFrame([(source, i, d, None) for i, d in enumerate(docs)], "source_id string, seq bigint, payload string, query struct<canonical_ko:string,language:string,terms:array<string>,dictionary_version:string,query_string:string>")
    r = payloads.normalize(raw("crossref", CROSSREF, '{"title": ["no doi"]}', "broken"), "crossref").collect()
    assert len(r) == 1 and r[0].doi == "10.1234/abc" and r[0].authors == ["Gildong Hong"] and r[0].publication_date == date(2026, 5, 1) and not r[0].license_unknown
    assert r[0].abstract_original == "An abstract" and r[0].download_url == "http://x/a.pdf" and r[0].journal_or_series == "J" and r[0].document_type == "학술논문"
    o = payloads.normalize(raw("openalex", '{"id": "W1", "display_name": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "open_access": {"is_oa": true}, "best_oa_location": {"license": "cc-by", "pdf_url": "u"}, "authorships": [{"author": {"display_name": "K"}}]}'), "openalex").first()
    assert o.abstract_original == "a b a" and not o.license_unknown and o.authors == ["K"] and o.oa_url == "u"
    d = payloads.normalize(raw("doaj", '{"id": "1", "bibjson": {"title": "T", "year": "2026", "month": "3", "identifier": [{"type": "doi", "id": "10.1234/a"}, {"type": "DOI", "id": "10.1234/b"}], "link": [{"type": "fulltext", "url": "f"}, {"type": "x", "url": "l"}]}}'), "doaj").first()
    assert (d.doi, d.publication_date, d.oa_url, d.landing_url) == ("10.1234/b", date(2026, 3, 1), "f", "l")
    law = payloads.normalize(raw("law_go_kr", '{"법령명한글": "군사법원법", "법령ID": "9", "공포일자": "20260101", "시행일자": "20260701", "법령상세링크": "/x"}'), "law_openapi").first()
    assert (law.official_identifier, law.publication_date, law.source_modified_date, law.landing_url) == ("law:law:9", date(2026, 1, 1), date(2026, 7, 1), "https://www.law.go.kr/x")
    with pytest.raises(ValueError):
        payloads.normalize(raw("x", "{}"), "unknown")
    for name in payloads.NORMALIZERS:
        assert payloads.normalize(raw("s", "{}", "[]", "no json"), name).count() == 0, name


def test_xml_and_envelopes(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2601.1</id><title>A</title><published>2026-01-02</published><author><name>K</name></author><category term='cs.CL'/></entry><entry><id>x</id><title>B</title></entry></feed>"
    pages = spark.createDataFrame([("arxiv", 0, atom)], "source_id string, seq bigint, xml string")
    got = payloads.normalize(readers.atom_entries(pages), "arxiv").orderBy("title_original").collect()
    assert [r.title_original for r in got] == ["A", "B"] and got[0].official_identifier == "arxiv:2601.1" and got[0].authors == ["K"] and got[0].download_url == "http://arxiv.org/pdf/2601.1"
    oai = "<OAI><record><header><identifier>oai:1</identifier><datestamp>2026-02-03</datestamp></header><metadata><dc><title>군사법 연구</title><creator>김</creator><identifier>10.1234/k</identifier><identifier>http://p</identifier></dc></metadata></record><record><header status=\"deleted\"/></record></OAI>"
    rows = payloads.normalize(readers.oai_records(spark.createDataFrame([("kci", 0, oai)], "source_id string, seq bigint, xml string")), "kci").collect()
    assert len(rows) == 1 and rows[0].doi == "10.1234/k" and rows[0].landing_url == "http://p" and rows[0].language == "ko"
    flat = readers.flat_xml_records(spark.createDataFrame([("law", 0, "<L><law><법령명한글><![CDATA[군법]]></법령명한글><법령ID>7</법령ID></law></L>")], "source_id string, seq bigint, xml string"), "law")
    assert payloads.normalize(flat, "law_openapi").first().official_identifier == "law:law:7"
    envelope = '{"api": [{"head": [{"list_total_count": 2}, {"RESULT": {"CODE": "0"}}]}, {"row": [{"BOOKNM": "국회 보고서", "PDFFILEURL": "http://h/v?doc_id=77", "INSERTDT": "2026-01-05"}]}]}'
    df = spark.createDataFrame([("nars", 0, envelope), ("nars", 1, "junk")], "source_id string, seq bigint, p string").select("source_id", "seq", F.explode(readers.envelope_rows("p")).alias("payload"), F.expr(readers._NO_QUERY))
    r = payloads.assembly(df, {"download_url": "pdffileurl", "publication_date": "INSERTDT"}, "NARS", "http://n/{id}").first()
    assert (r.title_original, r.official_identifier, r.landing_url, r.publication_date) == ("국회 보고서", "nars:77", "http://n/77", date(2026, 1, 5))


def test_whole_dataflow(spark):
    docs = spark.createDataFrame([(i, f"Document number {i} is from that place. " * 6, "en", "src1") for i in range(20)], "doc_id long, text string, lang string, source string")
    resources = resource_from_documents(docs)
    resources = resources.unionByName(resources.where("seq < 5").withColumn("seq", F.col("seq") + 100).withColumn("resource_id", F.concat(F.lit("again-"), "resource_id")))
    facts = resources.select("resource_id", F.lit("allowed").alias("policy"), F.lit("http://x/a.pdf").alias("oa_candidate"), F.struct(F.lit(True).alias("valid"), F.lit("").alias("error_code")).alias("link"), F.struct(F.lit(True).alias("valid")).alias("match"), F.struct(F.lit(True).alias("valid"), F.lit(False).alias("quarantine")).alias("file"), F.lit(False).alias("file_known"), F.lit(False).alias("text_known"))
    out = process(resources.withColumn("license", F.lit("CC BY")), facts, C.DEMO, F.lit(TODAY))
    verdicts = {r.resource_id: r.verdict for r in out.collect()}
    assert sum(v == "NEW" for v in verdicts.values()) == 20 and sum(v == "DUPLICATE" for v in verdicts.values()) == 5
    assert tally(out).first().n_new == 20 and out.where("relevance_score not between 0 and 100").count() == 0


def test_streams(spark, tmp_path):
    rows = [(i % 7, datetime(2024, 1, 1, i % 24)) for i in range(40)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = incremental.read_stream(spark, f"{tmp_path}/in", "k int, ts timestamp")
    incremental.run_once(incremental.first_seen(stream, ["k"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    incremental.run_once(incremental.first_seen(incremental.read_stream(spark, f"{tmp_path}/in", "k int, ts timestamp"), ["k"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
