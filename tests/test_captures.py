"""Captures, chains of pages, existence checks, late rows of a stream, files placed under their names."""

import hashlib
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.operators import dedup, scan
from folioforge.operators.chains import token_chains
from folioforge.operators.exists import blocks_for, bloom_filter, existing, may_exist, merged
from folioforge.operators.state import Scratch
from folioforge.sources.captured import read_captured, stream_captured, write_captured
from folioforge.sources.placing import COLUMNS, PlacedFiles
from folioforge.streaming.late import version_stream


def test_chains(spark):
    rows = [
        ("a", 1, "", "t2"), ("a", 2, "t2", "t3"), ("a", 3, "t3", ""), ("a", 4, "t2", "t9"),  # whole, with a repeat
        ("b", 1, None, "t2"), ("b", 3, "t3", "t4"), ("b", 4, "t4", None),  # the second is missing
        ("c", 1, "", "t2"), ("c", 2, "t2", "t3"),  # not finished
        ("d", 1, "x", "y"), ("d", 2, "y", "z"), ("d", 3, "z", "x"), ("d", 4, "q", "q"),  # circles
        ("e", 1, "", ""),
    ] + [("long", k, f"t{k}" if k else "", f"t{k + 1}") for k in range(70)]
    pages = spark.createDataFrame(rows, "harvest string, page_id long, token string, next string")
    got = {(x.harvest, x.page_id): (x.start, x.place, x.state) for x in token_chains(pages, Scratch(spark)).collect()}
    assert len(got) == len(rows)
    assert [got["a", k] for k in (1, 2, 3, 4)] == [(1, 0, "complete"), (1, 1, "complete"), (1, 2, "complete"), (None, None, "repeat")]
    assert [got["b", k] for k in (1, 3, 4)] == [(1, 0, "unfinished"), (3, 0, "gap"), (3, 1, "gap")]
    assert [got["c", k] for k in (1, 2)] == [(1, 0, "unfinished"), (1, 1, "unfinished")]
    assert all(got["d", k] == (None, None, "circle") for k in (1, 2, 3, 4)) and got["e", 1] == (1, 0, "complete")
    assert all(got["long", k] == (0, k, "unfinished") for k in range(70))
    assert token_chains(pages.limit(0), Scratch(spark)).count() == 0


def test_existence_asks_the_filter_first(spark):
    stored = spark.range(0, 60_000, 3).withColumnRenamed("id", "k").withColumn("k", F.col("k").cast("string"))
    asked = spark.range(0, 200_000).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    blocks = blocks_for(30_000)
    one, two = bloom_filter(stored.where("length(k) < 5"), "k", blocks), bloom_filter(stored.where("length(k) >= 5"), "k", blocks)
    both = Scratch(spark).put(merged(one, two))
    assert both.count() <= blocks and sorted(both.collect()) == sorted(bloom_filter(stored, "k", blocks).collect())
    through = may_exist(asked, "k", both, blocks).count()
    assert 20_000 <= through < 24_000  # a tenth of what is asked would go to the join
    assert existing(asked, "k", stored, both, blocks).count() == 20_000
    assert may_exist(asked, "k", both.limit(0), blocks).count() == 0


def test_captures_are_pruned_split_and_streamed(spark, tmp_path):
    path = f"file://{tmp_path}/captured"
    items = spark.createDataFrame([(s, f'{{"n": {k}}}', date(2026, 1, 1 + k % 5)) for s in ("kci", "core") for k in range(40)], "source_id string, payload string, d date")
    write_captured(items.repartition(1), path, F.col("d"))
    some = read_captured(spark, path, F.expr("source_id = 'kci' and day >= date'2026-01-04'"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan
    got = some.select("source_id", "payload", "seq").collect()
    assert len(got) == 16 and {x.source_id for x in got} == {"kci"} and len({x.seq for x in got}) == 16
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for n in (80, 82):  # the second time only what has come since
        stream = stream_captured(spark, path, 3).select("source_id", "payload", "day")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == n
        write_captured(spark.createDataFrame([("new", "{}", date(2026, 2, 1)), ("new", "[]", date(2026, 2, 2)), ("new", " ", date(2026, 2, 2))], "source_id string, payload string, d date"), path, F.col("d"))


def test_answers_not_modified(spark):
    rows = [("u", 1, 200, "a", "one"), ("u", 2, 304, "a", None), ("u", 3, 200, "b", "two"), ("u", 4, 304, "a", None), ("u", 5, 304, "b", None), ("u", 6, 200, "a", "three"), ("u", 7, 304, "a", None), ("v", 1, 304, "a", None), ("u", 8, 404, None, "gone")]
    captures = spark.createDataFrame([(u, datetime(2026, 1, d), s, t, b) for u, d, s, t, b in rows], "url string, at timestamp, status int, tag string, body string")
    got = {(x.url, x["at"].day): (x.body, x.stale) for x in scan.answered(captures).collect()}
    assert got == {("u", 1): ("one", False), ("u", 2): ("one", False), ("u", 3): ("two", False), ("u", 4): ("one", False), ("u", 5): ("two", False), ("u", 6): ("three", False), ("u", 7): ("three", False), ("v", 1): (None, True), ("u", 8): ("gone", False)}


def test_late_rows_are_judged_as_in_order(spark, tmp_path):
    """Rows come in any order within the look-back: verdicts are those of the fold over all of them."""
    r = random.Random(7)
    start = datetime(2026, 1, 1)
    rows = [(r.choice("abc"), k, r.choice((None, date(2026, 1, r.randint(1, 28)))), start + timedelta(hours=k)) for k in range(90)]
    late = sorted(rows, key=lambda x: x[3] + timedelta(hours=r.randint(0, 40)))  # within two days
    kinds = "k string, seq long, m date, ts timestamp"
    for n in range(0, 90, 30):
        spark.createDataFrame(late[n : n + 30], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        version_stream(stream, "k", "m", "seq", "ts", "2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {x.seq: (x.verdict, x.base) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {x.seq: (x.verdict, x.base) for x in dedup.version_fold(spark.createDataFrame(rows, kinds), "k", "m", "seq").collect()}
    last = max(x[3] for x in late[:90]) - timedelta(days=2)
    due = {x[1] for x in rows if x[3] <= last}
    assert len(got) >= len(due) - 30 and len(got) > 25 and all(want[s] == v for s, v in got.items())


def test_files_are_placed_or_nothing_is(spark, tmp_path):
    spark.dataSource.register(PlacedFiles)
    big = os.urandom(9 << 20)
    (tmp_path / "origin.bin").write_bytes(big)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("law/2026/a.pdf", None, bytearray(b"A"), sha(b"A"), False), ("law/2026/b.pdf", f"file://{tmp_path}/origin.bin", None, sha(big), False), ("c.exe", None, bytearray(b"MZ"), None, True), ("empty.pdf", None, None, None, False)]
    write = lambda rows, tasks=1: spark.createDataFrame(rows, COLUMNS).repartition(tasks).write.format("placed").mode("append").option("path", f"file://{tmp_path}/library").option("quarantine", f"file://{tmp_path}/away").save()
    write(rows, 3)
    files = lambda d: {os.path.relpath(os.path.join(a, f), tmp_path / d): (tmp_path / d / a / f).read_bytes() for a, _, names in os.walk(tmp_path / d) for f in names}
    assert files("library") == {"law/2026/a.pdf": b"A", "law/2026/b.pdf": big, "empty.pdf": b""} and files("away") == {"c.exe": b"MZ"}
    before = sorted(files("library"))
    with pytest.raises(Exception, match="Mismatch"):
        write([("new.pdf", None, bytearray(b"N"), sha(b"N"), False), ("bad.pdf", None, bytearray(b"B"), sha(b"other"), False)])
    with pytest.raises(Exception, match="no name"):
        write([("../out.pdf", None, bytearray(b"N"), None, False)])
    assert sorted(files("library")) == before and not [x for x in os.listdir(tmp_path / "library") if x.startswith("_staging")]
    assert not (tmp_path / "out.pdf").exists()


def test_works_keep_filled_titles(spark):
    from folioforge.operators.store import works

    rows = [("w", "10.1/a", "Title", ["Kim"], date(2020, 1, 1), datetime(2020, 1, 1), datetime(2020, 1, 1)), ("w", "", "", ["Lee"], date(2021, 1, 1), datetime(2021, 1, 1), datetime(2021, 1, 1)), ("v", "", "", [], None, datetime(2021, 1, 1), datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "work_id string, doi string, title_original string, authors array<string>, publication_date date, first_seen_at timestamp, last_seen_at timestamp")
    got = {x.work_id: (x.doi, x.title, x.title_norm, x.first_author) for x in works(df).collect()}
    assert got == {"w": ("10.1/a", "Title", "title", "Kim"), "v": (None, None, None, None)}


def test_plain_functions_of_any_length(spark):
    from folioforge.functions.text import distinct_ignoring_case
    from folioforge.operators.summarize import sentences
    from folioforge.sources.payloads import dig

    words = ["b", " A", "a ", "", "B", "c", None, "C"] + [f"x{k}" for k in range(500)] * 2
    got = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>").select(distinct_ignoring_case(F.col("w")).alias("d")).collect()
    assert got[0].d == ["b", "A", "c"] + [f"x{k}" for k in range(500)] and got[1].d == [] and got[2].d is None
    text = "첫 문장은 스물다섯 글자를 넘어야 하므로 조금 길게 쓴다。　둘째 문장도 스물다섯 글자를 넘어야 하므로 조금 길게 쓴다."
    assert len(spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s")).first().s) == 2
    deep = '{"a": [{"b": {"c": [[{"d": 1}], 2]}}], "x": "plain", "l": ["one", "two"]}'
    row = spark.createDataFrame([(deep,)], "p string").select(F.parse_json("p").alias("__v")).select(dig("a.b.c").alias("c"), dig("x").alias("x"), dig("l").alias("l"), dig("no.such").alias("n"), dig(".".join("abcdefghijklmnop")).alias("long")).first()
    assert (row.x, row.l) == ("plain", "one") and not row.n and not row.long
