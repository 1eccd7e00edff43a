import collections

import corpus_pipeline
import __spark_entry__


def test_stages_and_whole_run(spark, documents, prose, tmp_path):
    passage = prose(5000, 80)
    rows = [(i, prose(i, 120 + i), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, prose(3, 123) + f" tail{i}", "en", "s1") for i in range(10)]  # near copies of document 3
    rows += [(200 + i, prose(600 + i, 100) + "\n" + passage, "en", "s2") for i in range(6)]
    rows += [(300, None, "en", "s3"), (301, "12 34 !!", None, None)]
    documents(rows).drop("size", "key", "label").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_level_bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            out.write.parquet(f"{tmp_path}/{name}.parquet")
            out = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name], docs = out.collect(), out
    ids = lambda n: [r.doc_id for r in seen[n]]
    assert sorted(ids("language_id")) == sorted(i for i, *_ in rows if i < 300)
    assert sorted(ids("minhash_near_dedup")) == sorted([*range(80), *range(200, 206)])
    assert sum(passage in r.text for r in seen["substring_dedup"]) == 1 and len(seen["substring_dedup"]) == 86
    assert max(collections.Counter(ids("mix_to_weights")).values()) <= 3
    assert collections.Counter(ids("byte_level_bpe")) == collections.Counter(ids("mix_to_weights"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen["byte_level_bpe"])


def test_one_row_stays_of_each_group(spark, documents, prose):
    a, b, c = prose(1, 150), prose(2, 150), prose(3, 150)
    rows = [(None, a), (None, a), (None, a + " tail"), (7, b), (7, b + " tail"), (7, b), (8, b), (9, c, "en", "x"), (9, c, "en", "y"), (10, prose(4, 90)), (None, prose(5, 90)), (None, None), (None, "")]
    left = corpus_pipeline.minhash_near_dedup(spark, documents(rows).drop("size", "key", "label"), "").collect()
    texts = [r.text or "" for r in left]
    assert [sum(t.startswith(x) for t in texts) for x in (a, b, c)] == [1, 1, 1]
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [None, 7, 9, 10, None, None, None]))


def test_stages_with_equal_rows_and_none(spark, documents):
    rows = [(7, "one two three", "en", "a")] * 30 + [(8, "w " * 60, "en", "b"), (None, "", "en", "b"), (None, "", "en", "b"), (None, None, None, None)]
    docs = documents(rows)
    taken = corpus_pipeline.mix_to_weights(spark, docs, "").collect()
    words = lambda s: sum(len((r.text or "").split()) for r in taken if r.source == s)
    assert abs(words("a") - 50) <= 2 and abs(words("b") - 100) <= 30
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), "").count() == 0


def test_stages_take_any_schema(spark, documents, prose):
    """Maps, names with dots and names that the operators use pass through every stage but the last."""
    odd = {"a.b": "'dot'", "m": "map('k', doc_id)", "lang_pred": "'mine'", "score": "1", "rejected": "true", "tag": "'t'", "cls": "2", "s p": "array(1)", "order": "0"}
    rows = [(k % 9, prose(k % 7, 60)) for k in range(40)] + [(None, prose(1, 60)), (None, None), (3, "")]
    docs = documents(rows).drop("size", "key", "label").selectExpr("*", *(f"{v} as `{k}`" for k, v in odd.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r["a.b"] == "dot" and r["m"] == {"k": r.doc_id} and r["lang_pred"] == "mine" and r["order"] == 0 for r in got), name
    assert corpus_pipeline.byte_level_bpe(spark, docs, "").count() == len(rows)


def test_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
