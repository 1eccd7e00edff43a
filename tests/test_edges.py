import json
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.operators import report
from folioforge.sources import captured, config, files, payloads


def pdf(pages, packed=True):
    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages):
        body = b"BT /F1 12 Tf 10 700 Td (" + text.replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj T* [(Sec) -20 (ond)] TJ ET"
        data = zlib.compress(body) if packed else body
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (i + 5, len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


def compound(name, data):
    """A compound file with one stream BodyText/<name> of 4096 bytes or more."""
    data += b"\0" * (max(4096, -(-len(data) // 512) * 512) - len(data))
    n = len(data) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(title, kind, left, right, child, start, size):
        raw = (title + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3L", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<LQ", start, size)

    none = 0xFFFFFFFF
    directory = entry("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0) + entry("BodyText", 1, none, none, 2, 0, 0) + entry(name, 2, none, none, none, 2, len(data)) + b"\0" * 128
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<2L", 1, 1) + b"\0" * 4 + struct.pack("<5L", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109L", 0, *[none] * 108) + struct.pack("<128L", *fat) + directory + data


def test_pdf_and_hwp_text(spark):
    text = "군사법원의 증거능력 판단 기준에 관한 연구 " * 5
    raw = text.encode("utf-16-le")
    record = struct.pack("<L", 67 | (0xFFF << 20)) + struct.pack("<L", len(raw)) + raw
    packer = zlib.compressobj(0, zlib.DEFLATED, -15)
    rows = [
        (pdf(["A (first) page of some length that is long enough", "Another page of the same paper, also long"]), ".pdf"), (pdf(["plain text of a page that is not packed at all"], False), ".pdf"),
        (compound("Section0", packer.compress(record) + packer.flush()), ".hwp"), (b"broken", ".hwp"), (pdf(["x"]), ".pdf"), (None, ".pdf"),
    ]
    got = files.extract_text(spark.createDataFrame(rows, "content binary, suffix string").coalesce(1)).collect()
    assert got[0].pages[0].startswith("A (first) page") and got[0].pages[0].endswith("Second") and len(got[0].pages) == 2 and not got[0].failed
    assert not got[1].failed and text.strip() in got[2].text and [g.failed for g in got[3:]] == [True, True, True]
    assert got[3].reason.startswith("ValueError") and got[4].reason == "needs_ocr"


def test_captured_source(spark, tmp_path):
    for source, docs in (("zenodo", [{"id": 1, "metadata": {"title": "A"}}, {"id": 2, "metadata": {"title": "B", "access_right": "open", "license": "cc-by-4.0"}}]), ("core", [{"id": 3, "title": "C"}])):
        (tmp_path / source).mkdir()
        (tmp_path / source / "0.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    spark.dataSource.register(captured.CapturedSource)
    raw = spark.read.format("captured").option("path", str(tmp_path)).load()
    assert spark.read.format("captured").option("path", str(tmp_path)).option("source", "core").load().count() == 1
    assert raw.count() == 3 and raw.where("source_id = 'core'").count() == 1 and raw.select("source_id", "seq").distinct().count() == 3
    got = payloads.normalize(raw.where("source_id = 'zenodo'"), "zenodo").orderBy("title_original").collect()
    assert [(r.official_identifier, r.license_unknown) for r in got] == [("zenodo:1", True), ("zenodo:2", False)]


def test_registry(spark):
    registry = {
        "defaults": {"priority": 2, "access_methods": []},
        "sources": [{"source_id": "a", "access_methods": [{"type": "HTML", "endpoint": "h"}, {"type": "OPEN_API", "endpoint": "o", "credential_env_var": "KEY", "verified": True}]}, {"source_id": "b", "enabled": False}],
    }
    sources = config.sources_from(spark, registry)
    assert sources.where("source_id = 'a'").select(config.preferred_method(F.col("access_methods"))["type"]).first()[0] == "OPEN_API"
    none = spark.createDataFrame([], "name string")
    got = {(r.source_id, r.type): (r.status, r.source_usable) for r in config.method_status(sources, none).collect()}
    assert got == {("a", "HTML"): ("usable", True), ("a", "OPEN_API"): ("no_credential", True), ("b", None): ("no_endpoint", False)}
    assert tuple(config.registry_counts(sources).first()) == (2, 1, 1, 1)
    for bad in ({"sources": []}, {"sources": [{"source_id": "a"}, {"source_id": "a"}]}):
        with pytest.raises(ValueError):
            config.sources_from(spark, bad)
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and config.dotted({"a": {"b": 3}}, "a.b") == 3 and config.dotted({}, "a.b", 7) == 7


def test_reports(spark):
    rows = [(f"r{i}", "", f"t<{i}>", "P1" if i == 0 else "P4", 90 - i, "NEW" if i < 3 else "UPDATED", True, "s", "f" if i < 2 else "", "01") for i in range(50)]
    df = spark.createDataFrame(rows, "resource_id string, title_ko string, title_original string, priority_level string, relevance_score int, outcome string, license_unknown boolean, summary_ko string, file_path string, topic_primary string")
    counts = report.briefing_counts(df, spark.createDataFrame([("x",)], "source_id string"))
    assert tuple(counts.first()) == (1, 0, 3, 47, 1) and report.should_send(counts)
    assert "t&lt;0&gt;" in report.cards(df).first().html and "라이선스 불명확" in report.cards(df).first().html
    rest = report.rest_list(df).first()
    assert rest.more == 9 and rest.lines.split("\n")[0] == "- t<1>" and len(rest.lines.split("\n")) == 40
    topics = spark.createDataFrame([("01",), ("02",)], "topic_id string")
    assert {tuple(r) for r in report.library_stats(topics, df).collect()} == {("01", 2), ("02", 0)}
    md = spark.createDataFrame([("## 요지\nhead\n\n## 핵심\n- a\n- b",)], "m string")
    assert md.select(report.markdown_section(F.col("m"), "핵심")).first()[0] == "- a\n- b" and md.select(report.markdown_section(F.col("m"), "없음")).first()[0] == ""


def test_requests_and_caps(spark):
    df = spark.createDataFrame([("GET", "http://a/1", ""), ("GET", "http://a/1", ""), ("GET", "http://a/2", ""), ("GET", "http://B/1", "k")], "method string, url string, headers string")
    assert sorted((r.host, r.turn) for r in report.request_plan(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert report.registered(df, spark.createDataFrame([("http://a/",)], "endpoint string")).count() == 3 and report.retry_delays(6) == [2, 4, 8, 16, 32, 60]
    items = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "source_id string, seq int")
    assert report.emit_cap(items, 2).count() == 3 and report.emit_cap(items, 0).count() == 6
    log = spark.createDataFrame([("token=abc", datetime(2026, 1, 1))], "message string, t timestamp")
    assert report.safe_log(log).first().message == "token=***"
