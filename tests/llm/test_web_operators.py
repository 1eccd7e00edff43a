import hashlib
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.llm.common import Tables
from folioforge.llm.queries import URL_RULES
from folioforge.llm.urlfilter import judge_urls, rule_table
from folioforge.llm.wacz import ZipReader, ZipWriter, archive_and_read, read_archives, write_archives

PAGE = "page_id long, url string, html string, host int, rule string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGE).repartition(3)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules(spark, limit):
    urls = [
        "http://example.com/en/1", "https://www.example.com/en/x?y#z", "http://a.www.EXAMPLE.com/en/", "http://example.com", "http://example.com?x", "http://x.net/es/a", "http://x.net/esp",
        "http://net/fr/", "http://example.org/en/", "no scheme", "", None, "http://notexample.com/en/", "http://example.com/en", "x://y://z.com/", "http://example.com:80/en/", "http://.com/", "://com/",
    ]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[0], None)]
    got = judge_urls(pages(spark, rows), rule_table(spark, URL_RULES), broadcast_rules=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(q), q, a) for a, q in URL_RULES if (host == q.split("/")[0] or host.endswith("." + q.split("/")[0])) and path.startswith("/" + q.split("/", 1)[1])]
        best = max(fits) if fits else (0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), r
    assert judge_urls(pages(spark, []), rule_table(spark, URL_RULES)).count() == 0
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in judge_urls(pages(spark, rows), none, "block").collect()} == {"block"}


def test_rules_that_end_within_a_segment_and_contradict(spark):
    rules = spark.createDataFrame([("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", "/xy/longer", "allow"), (None, "/", "block")], "host string, path string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages(spark, [(1, "http://a.com/xy/longer/z", ""), (2, "http://b.a.com/xz", ""), (3, "http://a.com/y", "")]), rules).collect()}
    assert got == {1: ("com/xy/longer", "allow"), 2: ("a.com/x", "block"), 3: (None, "allow")}


class File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("wide", [False, True])
def test_packages_are_zips(wide):
    out = io.BytesIO()
    z = ZipWriter(out, wide)
    for name, parts in (("a/b.bin", [b"hello ", b"world"]), ("é.txt", [b"x" * 1000]), ("empty", [])):
        z.begin(name)
        for p in parts:
            z.write(p)
        z.end()
    z.close()
    other = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert other.testzip() is None and other.namelist() == ["a/b.bin", "é.txt", "empty"] and other.read("a/b.bin") == b"hello world"
    own = ZipReader(File(out.getvalue()))
    assert own.member("a/b.bin") == b"hello world" and own.member("empty") == b"" and own.range(own.start("é.txt") + 5, 3) == b"xxx"


def test_reader_takes_foreign_zips_and_refuses_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"123")
        z.writestr("packed", b"4" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    own = ZipReader(File(out.getvalue()))
    assert own.member("stored") == b"123"
    with pytest.raises(ValueError):
        own.member("packed")
    for raw in (b"", b"not a zip" * 9, out.getvalue()[:-30]):
        with pytest.raises(ValueError):
            ZipReader(File(raw))
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
    assert len(ZipReader(File(many.getvalue())).members) == 66_000


def test_round_trip(spark):
    big = "z" * 200
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" + "é" * i) for i in range(60)] + [(100 + i, "http://dup/", big) for i in range(30)]
    rows += [(200, None, None), (201, "http://x/\r\nSet: 1 ü", "short"), (202, "u", "short"), (None, "u", big), (100, "again", big), (203, "u", "h\r\n\r\n\r\nPK\x05\x06" * 30)]
    got = archive_and_read(pages(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0], r[2])
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        visits = html == big and i != 100
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visits else "response", 100 if visits else None))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert archive_and_read(pages(spark, [])).count() == 0


def test_packages_roll_and_payloads_come_back(spark):
    rows = [(i, f"http://h/{i}", f"{i} " + "".join(chr(97 + (i * j * j + j // 7) % 26) for j in range(3000))) for i in range(100)]
    folder, made = write_archives(pages(spark, rows), Tables(spark, "t"), roll=5000, zip64=True)
    assert made.count() > 6 and made.agg(F.sum("records")).first()[0] == 100
    assert {(r.page_id, bytes(r.payload).decode()) for r in read_archives(folder, made, True).collect()} == {(r[0], r[2]) for r in rows}
    assert read_archives(folder, made).rdd.getNumPartitions() == made.count()  # a task a package
    assert read_archives(folder, made, most_tasks=3).rdd.getNumPartitions() == 3
