"""Work that is done once: index building, export sheets."""

import datetime
import time

from pyspark.sql import functions as F

from folioforge.operators import index
from folioforge.operators.state import Catalogue


def test_a_long_text_is_indexed_in_time_of_its_length(spark, tmp_path):
    """20,000 different words: comparing each with all others takes minutes."""
    docs = spark.range(3).select(F.col("id").cast("string"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i)), " ").alias("text"))
    catalogue, begun = Catalogue(spark, f"file://{tmp_path}/c"), time.perf_counter()
    plans = []

    def work(run):
        append = run.append
        run.append = lambda name, df, by=None: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), append(name, df, by))
        index.add_documents(run, docs, ["text"], chars=None)

    catalogue.run("1", work)
    assert time.perf_counter() - begun < 60
    assert dict(plans)["postings"].count("Exchange ") == 1  # blocks: one shuffle
    assert [r.id for r in index.top(catalogue, "w7", 2).collect()] == ["0", "1"]
    assert catalogue.table("dictionary").where("field = ''").count() == 20_000


def test_export_sheets_are_counted_in_one_pass(spark):
    """Before: the scores were computed again for each sheet, and once more in the pushed filter of P1 and P2."""
    from folioforge.plans.queries import QUERIES

    plan = QUERIES["q_export_sheets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_texts_are_searched_in_one_pass_as_an_index_is(spark, tmp_path):
    """Before: every clause and figure of a search read and cut all texts again."""
    from folioforge.operators import search
    from folioforge.plans.queries import QUERIES

    rows = [(i, f"alpha beta {'gamma beta ' * (i % 4)}{'delta alpha beta' if i % 3 else 'omega'}", "beta" if i % 5 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, title string")
    stored = search.build_index(docs, "doc_id", ["body", "title"])
    for query in ("alpha beta", '"alpha beta"', "gam* NOT omega", "gamma OR delta", "title:beta omega", "missing", "NOT beta", "alpha NOT gamma"):
        got = [(r.id, round(r.score, 9)) for r in search.search_texts(docs, "doc_id", ["body", "title"], query, 7).collect()]
        assert got == [(r.id, round(r.score, 9)) for r in search.search(stored, query, 7).collect()], query
    assert "Generate" not in QUERIES["q_search_bm25"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_titles_meet_within_their_block(spark):
    """All links that a comparison of all titles finds.  Before, titles met on tokens of all blocks, and normalising
    them was done again at each use."""
    import random

    from folioforge.operators.dedup import fuzzy_links

    random.seed(7)
    words = [f"w{i}" for i in range(30)]
    made = []
    for i in range(240):
        t = ["same", "beginning"] * (i % 2) + random.sample(words, random.randint(1, 14)) if i % 3 or not made else random.choice(made)[:]
        if i % 3 == 0:
            t = [*t[: random.randint(len(t) - 1, len(t))], *random.sample(words, random.randint(0, 1))] or ["x"]
        made.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    got = fuzzy_links(spark.createDataFrame(rows, "i long, t string"), "i", "t")
    reps = {}
    for i, t in rows:
        reps.setdefault(t, i)
    want = {(reps[t], i, 1.0) for i, t in rows if reps[t] != i}
    for a, i in reps.items():
        for b, j in reps.items():
            x, y = set(a.split()), set(b.split())
            if i < j and a[:12] == b[:12] and len(x & y) / len(x | y) >= 0.85:
                want.add((i, j, round(len(x & y) / len(x | y), 6)))
    assert {(r.left_id, r.right_id, round(r.similarity, 6)) for r in got.collect()} == want and len(want) > 20
    assert got._jdf.queryExecution().executedPlan().toString().count("split(") == 0  # tokens are written once


def test_title_pairs_are_all_pairs(spark, tmp_path, monkeypatch):
    """Before: copies of a title met only its least row, and near titles only between their least rows."""
    from folioforge.operators import dedup
    from folioforge.plans.queries import QUERIES

    monkeypatch.setattr(dedup, "PORTION", 4)
    titles = ["same beginning " + " ".join(f"w{k}" for k in range(j, 20)) for j in range(4)] + ["other", ""]
    rows = [(i, titles[(i * i + i // 7) % 6]) for i in range(90)]
    spark.createDataFrame([(i, t + "\nbody") for i, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, a in rows:
        for j, b in rows:
            x, y = set(a.split()), set(b.split())
            if i < j and a and b and a[:12] == b[:12] and len(x & y) / len(x | y) >= 0.85:
                want[i, j] = round(len(x & y) / len(x | y), 6)
    got = QUERIES["q_title_jaccard_pairs"](spark, str(tmp_path)).collect()
    assert {(r.left_id, r.right_id): r.similarity for r in got} == want and len(got) == len(want) and len(set(want.values())) > 2


def test_equal_queries_of_several_topics_come_in_one_order(spark):
    from folioforge.operators import expand

    rows = [("term", ["t"], [], [], [], [], str(i % 7), 1, [], True) for i in range(40)]
    for layout in (rows, rows[::-1], sorted(rows, key=lambda r: int(r[6]) % 3)):
        got = expand.build_queries(spark.createDataFrame(layout, expand.TERM_SCHEMA).repartition(3), "ko", 8)
        assert [(r.topic_id, r.ord) for r in got.orderBy("ord").collect()] == [(t, i + 1) for i, t in enumerate("00000011")]


def test_only_wanted_rows_are_summarised(spark):
    from folioforge.operators.summarize import summarize

    text = "This is the first sentence of a text. And this is the second sentence of it."
    rows = spark.createDataFrame([(1, text, text, False), (2, text, text, False)], "i int, fulltext string, abstract_original string, text_extract_failed boolean")
    got = {r.i: (r.summary_basis, len(r.key_points)) for r in summarize(rows, F.col("i") == 1).collect()}
    assert got == {1: ("FULLTEXT", 2), 2: ("FULLTEXT", 0)}


def test_a_chain_of_arrivals_is_folded_in_few_rounds(spark):
    """Before: rounds began with all arrivals accepted, and each settled one more row of this chain."""
    from folioforge.operators.arrivals import fold_arrivals
    from folioforge.operators.state import Scratch

    fields = "seq long, resource_id string, source_id string, doi string, official_identifier string, title_original string, title_ko string, authors array<string>, publication_date date, source_modified_date date, file_sha256 string, work_id string"
    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    rows = [(i, f"r{i}", "s", "10.1/a" if i % 2 else "10.1/b", "", "", "", [], None, day(50 if i < 2 else 60 if i == 20 else i), "", "") for i in range(24)]
    arrivals, scratch = spark.createDataFrame(rows, fields), Scratch(spark)
    got = fold_arrivals(arrivals, arrivals.limit(0).withColumn("last_seen_at", F.lit(None).cast("timestamp_ntz")), scratch, fuzzy=False)
    want = {(i, "NEW" if i < 2 else "NEW_VERSION" if i == 20 else "DUPLICATE", None if i < 2 else "r20" if i == 22 else f"r{i % 2}") for i in range(24)}
    assert {(r.seq, r.verdict, r.match_id) for r in got.collect()} == want
    assert scratch.count <= 8


def test_key_points_are_the_best_ranked_sentences(spark):
    """Before: summaries counted tokens by interpreted lambdas, the larger part of a run's time."""
    import random

    from folioforge.operators import summarize as M

    random.seed(3)
    words = ["alpha", "Beta", "the", "and", "가나", "그리고", "\u212aelvin", "\u0130stanbul", "x1", "은행", "gamma-ray", "Ünal"]
    rows = [(i, [" ".join(random.choices(words if i % 5 else words[8:9], k=random.randint(1, 9))) for _ in range(random.randint(0, 25))]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, kept array<string>")
    want = F.transform(F.slice(M.ranked_sentences(F.col("kept")), 1, M.POINTS), lambda x: x["pos"])
    assert df.where(~want.eqNullSafe(M.best_sentences(F.col("kept"), M.POINTS))).count() == 0
    plan = M.summarize(spark.createDataFrame([("a", "b", False)], "fulltext string, abstract_original string, text_extract_failed boolean"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_blocks_are_made_where_tiles_are_read(spark, tmp_path):
    """Before: every word of a document was a row of its own that was shuffled and sorted."""
    import random

    random.seed(11)
    words = ["a", "b", "déjà", "가나", "zz", "x1"]
    rows = [(str(i), " ".join(random.choices(words, k=i % 40)), None if i % 3 else " ".join(random.choices(words, k=3))) for i in range(400)]
    catalogue, plans = Catalogue(spark, f"file://{tmp_path}/c"), []

    def work(run):
        append = run.append
        run.append = lambda name, df, by=None: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), append(name, df, by))
        index.add_documents(run, spark.createDataFrame(rows, "id string, body string, title string"), ["body", "title"])

    catalogue.run("1", work)
    want = {}
    for i, *texts in rows:
        for field, text in zip(("body", "title"), texts, strict=True):
            for at, w in enumerate((text or "").replace("é", "e").replace("à", "a").split()):
                want.setdefault((field, w, i, sum(len((t or "").split()) for t in texts)), []).append(at)
    got, tiles = {}, set()
    for r in catalogue.table("postings").collect():
        assert r.n == len(r.ids) and r.most == max(r.counts) and r.shortest == min(r.lengths) and r.counts == [len(x) for x in r.places] and r.n <= index.TILE
        got |= {(r.field, r.term, i, n): list(x) for i, n, x in zip(r.ids, r.lengths, r.places, strict=True)}
        tiles.add(r.tile)
    assert got == want and len(tiles) > 2
    assert "Generate" not in dict(plans)["postings"]
