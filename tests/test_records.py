"""Stored indexes, manifests of several runs, plug-ins, paging and matching, on small tables."""

from datetime import date

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import dedup, hooks, policy, scan, search, store
from folioforge.sources import payloads


def test_stored_index_grows(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "id string, text string")
    path = f"{tmp_path}/index"
    store_ = lambda rows, mode: search.store_index(search.build_index(docs(rows), "id", ["text"]), path, mode)
    store_([("a", "alpha foo_bar"), ("b", "beta Café")], "overwrite")
    store_([("c", "alpha alpha gamma")], "append")
    find = lambda q: [r.id for r in search.search(search.stored_index(spark, path), q).collect()]
    assert find("alpha") == ["c", "a"] and find("foo_bar") == ["a"] and find("cafe") == ["b"] and find('"alpha gamma"') == ["c"] and find("bet*") == ["b"]
    plan = search._of_terms(search.stored_index(spark, path)[0], ["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_manifest_keeps_what_was_written_first(spark, tmp_path):
    path = f"{tmp_path}/m"
    rows = lambda n: spark.createDataFrame([("a", n)], "resource_id string, n int")
    store.write_manifest(rows(2), path, "r2", "2026-08-22", "2026-08-22T09:00:00")
    store.write_manifest(rows(1), path, "r1", "2026-08-22", "2026-08-22T08:00:00")
    assert [(r.resource_id, r.n) for r in store.read_manifest(spark, path, "resource_id string, n int").collect()] == [("a", 1)]


def test_hooks(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("",), (None,)], "t string")

    def hook(t):
        if t == "bad":
            raise ValueError
        return t.upper()

    assert [r.o for r in hooks.with_text_hook(df, "t", "o", hook, "t").collect()] == ["A", "bad", "", None]
    counts = spark.createDataFrame([(0, 0, 0)], "n_new int, n_updated int, n_failed int")
    sent = []
    assert not hooks.notify(counts, sent.append) and hooks.notify(counts, sent.append, True) and len(sent) == 1


def test_fuzzy_match_contains_and_years(spark):
    schema = "resource_id string, title string, year int, author string"
    stored = spark.createDataFrame([("s1", "new study of military courts in korea", 2024, "kim"), ("s2", "study of military courts in korea new", 2023, ""), ("s3", "other thing", None, "")], schema)
    arriving = [("i1", "study of military courts in korea new", 2024, "kim"), ("i2", "study of military courts in korea new", None, "lee"), ("i3", "other thing", 2020, "x"), ("i4", "unknown", 2020, "x"), ("i5", "", None, "")]
    got = {r.in_id: r.match_id for r in dedup.fuzzy_match(spark.createDataFrame(arriving, schema), stored).collect()}
    assert got == {"i1": "s1", "i2": "s2", "i3": "s3"}


def test_versions_within_a_hot_key(spark):
    rows = [("k", (i * 37) % 101, i) for i in range(300)] + [("l", None, 300), ("l", 5, 301)]
    df = spark.createDataFrame(rows, "key string, day int, seq int").repartition(4)
    got = {r.seq: (r.verdict, r.base) for r in dedup.version_fold(df, "key", "day", "seq", 8).collect()}
    most, base = rows[0][1], 0
    for _, day, i in rows[1:300]:
        assert got[i] == (("NEW_VERSION" if day > most else "DUPLICATE"), base), i
        if day > most:
            most, base = day, i
    assert got[0] == ("NEW", None) and got[300] == ("NEW", None) and got[301] == ("DUPLICATE", 300)


def test_download_links_of_any_ending(spark):
    d = policy.access_decision(F.lit("allowed"), F.lit("DIRECT_FILE"), F.lit(True), F.lit("https://www.go.kr/file/download.do?id=1"), F.lit(""))
    assert spark.range(1).select(d.alias("d")).first().d.allowed


def test_passive_and_merged_maps(spark):
    raw = spark.createDataFrame([("riss", 1, '{"a": [{"b": [" x "]}]}', None)], "source_id string, seq bigint, payload string, query struct<canonical_ko:string,language:string,terms:array<string>,dictionary_version:string,query_string:string>")
    for name in ("riss", "ssrn", "unpaywall"):
        assert payloads.normalize(raw, name).count() == 0
    assert raw.withColumn("__v", F.try_parse_json("payload")).select(payloads.dig("a.b")).first()[0] == "x"
    assert payloads.merged_fields("prism", {"title": "t", "publisher": ""}) == {k: v for k, v in (payloads.PRESETS["prism"] | {"title": "t"}).items() if k != "publisher"}
    docs = spark.createDataFrame([("r2", "d", 1), ("r1", "d", 2), ("r3", "", 3), ("r4", "", 4)], "resource_id string, doi string, n int")
    assert {r.resource_id for r in payloads.first_seen(docs, "doi").collect()} == {"r1", "r3", "r4"}


def test_known_secrets_and_windows(spark):
    df = spark.createDataFrame([("key hunter22 &KEY=abc x", date(2026, 1, 1)), (None, None)], "m string, d date")
    assert [r[0] for r in df.select(T.mask_secrets(F.col("m"), ["hunter22", "abc"])).collect()] == ["key *** &KEY=*** x", None]
    assert scan.within(df, F.lit("2026-02-01").cast("date"), F.lit("2026-03-01").cast("date"), "d").count() == 1
