from datetime import date

from pyspark.sql import functions as F

from folioforge.functions import dates as D
from folioforge.functions import text as T
from folioforge.functions import urls as U


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_doi(spark):
    raw = ["https://doi.org/10.2139/ssrn.4567890", "http://dx.doi.org/10.2139/SSRN.4567890", "doi:10.2139/ssrn.4567890", "  10.2139/ssrn.4567890.  ", "없는DOI", None]
    assert column(spark, raw, T.normalize_doi) == ["10.2139/ssrn.4567890"] * 4 + ["", ""]


def test_dates(spark):
    raw = ["2026-08-22", "2026.08.22", "20260822", "2026년 8월 22일", "2026-08", "2026", "", None, "2026-02-31", "2026/13/40", "Sat, 22 Aug 2026 09:00:00 +0900", "2026-08-22T23:30:00+09:00", "0000-01-01"]
    want = [date(2026, 8, 22)] * 4 + [date(2026, 8, 1), date(2026, 1, 1), None, None, date(2026, 2, 28), date(2026, 12, 31), None, date(2026, 8, 22), None]
    assert column(spark, raw, D.parse_date) == want
    assert column(spark, [[2026, 8, 22], [2026], [2026, 2, 30], [], None], D.date_from_parts, "array<int>") == [date(2026, 8, 22), date(2026, 1, 1), None, None, None]


def test_recency(spark):
    today = F.lit(date(2026, 8, 22))
    raw = [date(2026, 9, 1), date(2026, 8, 1), date(2026, 6, 1), date(2026, 3, 1), date(2025, 10, 1), date(2024, 1, 1), date(2015, 1, 1), None]
    assert column(spark, raw, lambda c: D.recency(c, today), "date") == [1.0, 1.0, 0.85, 0.7, 0.55, 0.35, 0.15, 0.4]


def test_document_types_and_language(spark):
    raw = ["군사법원법 일부개정법률", "대법원 2026도1234 판결", "군사재판 실무제요", "arXiv preprint on legal AI", "Impact of rules", None, ""]
    assert column(spark, raw, T.document_type) == ["법령", "판례", "실무제요", "프리프린트", "법령", "기타", "기타"]
    assert column(spark, ["군사법 review", "military law", "123", "", None, "가 abcd efgh"], T.language) == ["ko", "en", "", "", "", "en"]


def test_titles_hashes_and_works(spark):
    assert column(spark, ["ＡＩ-based  Law!", "에이_비", None], T.normalize_title) == ["ai based law", "에이_비", ""]
    a, b, c = column(spark, ["군사법원의  증거능력", "군사법원의 증거능력 ", ""], T.text_sha256)
    assert a == b and c == ""
    df = spark.createDataFrame([("10.1234/x", "kci:1", "A  b"), ("", "kci:1", "A b"), ("", "", "A  b!"), ("", "", "a b")], "d string, i string, t string")
    got = [r.w for r in df.select(T.work_id(F.col("d"), F.col("i"), T.normalize_title(F.col("t")), F.lit(2026)).alias("w")).collect()]
    assert got[:2] == ["doi:10.1234/x", "id:kci:1"] and got[2] == got[3] and got[2].startswith("title:") and len(got[2]) == 22


def test_arrays(spark):
    index = [{"law": [1], "the": [0, 3], "of": [2]}, None]
    assert column(spark, index, T.abstract_from_index, "map<string,array<int>>") == ["the law of the", None]
    assert column(spark, [[" A", "a", "", "B ", "b"]], T.distinct_ignoring_case, "array<string>") == [["A", "B"]]
    assert column(spark, ["Kim A; Lee B and Park C, Choi", None], T.authors_from_string) == [["Kim A", "Lee B", "Park C", "Choi"], []]


def test_markup_and_masks(spark):
    assert column(spark, ["<html><TITLE x>a <b>b</b>\n</title>", "none", None], T.page_title) == ["a  b", "", ""]
    assert column(spark, ["<p>a<i>b</i></p>  c"], T.strip_tags) == ["a b c"]
    assert column(spark, ["abcd", "abcdefgh"], T.mask_secret) == ["****", "ab****gh"]
    assert column(spark, ["GET /x?apikey=SECRET123&y=1 token: abc", "Authorization: Bearer aaa.bbb"], T.mask_secrets) == ["GET /x?apikey=***&y=1 token: ***", "Authorization: Bearer ***"]
    assert column(spark, ["<a href='x'>&\"</a>"], T.html_escape) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"]


def test_file_names(spark):
    df = spark.createDataFrame([(date(2026, 8, 22), "KCI", "군사재판절차 개선방안"), (date(2026, 8, 22), "a:b", '??'), (date(2026, 1, 2), "x", "y" * 200)], "d date, s string, t string")
    got = [r.n for r in df.select(T.build_filename(F.col("d"), F.col("s"), F.col("t")).alias("n")).collect()]
    assert got == ["260822_KCI_군사재판절차_개선방안.pdf", "260822_AB_무제.pdf", "260102_X_" + "y" * 80 + ".pdf"]


def test_urls(spark):
    raw = ["https://x/;jsessionid=ABC123", "https://x/?token=xyz", "https://x/tempfile/1", "https://x/?id=100", None]
    assert column(spark, raw, U.is_ephemeral) == [True, True, True, False, False]
    assert column(spark, ["https://www.riss.kr/DetailView.do?p=1&control_no=ABC123", ""], U.riss_control_number) == ["ABC123", ""]
    assert column(spark, ["https://papers.ssrn.com/sol3/papers.cfm?abstract_id=4567890", "10.2139/ssrn.123", "x"], U.ssrn_abstract_id) == ["4567890", "123", ""]
    df = spark.createDataFrame([("application/pdf", "", "x"), ("", 'attachment; filename="a.hwpx"', "x"), ("", "", "http://h/a.docx?x=1"), (None, None, None)], "c string, d string, u string")
    assert [r.e for r in df.select(U.extension(F.col("c"), F.col("d"), F.col("u")).alias("e")).collect()] == [".pdf", ".hwpx", ".docx", ".pdf"]
