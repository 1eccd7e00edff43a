"""Versioned tables, folds over state, the record chain, and the index that changes."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioforge.operators import dedup, index
from folioforge.operators.arrivals import fold_arrivals
from folioforge.operators.ordered import last_before, place
from folioforge.operators.search import build_index, search
from folioforge.operators.state import Catalogue, Conflict, Scratch
from folioforge.operators.store import file_names


@pytest.fixture
def catalogue(spark, tmp_path):
    return Catalogue(spark, f"file://{tmp_path}/state")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v int, written long")


def test_versions_readers_and_killed_runs(spark, catalogue):
    one = catalogue.begin("r1")
    one.append("t", rows(spark, ("a", 1, 1), ("b", 1, 1)))
    assert catalogue.versions() == []  # nothing is seen before the commit
    assert one.commit() == 1
    pinned = catalogue.table("t")
    killed = catalogue.begin("r2")
    killed.append("t", rows(spark, ("a", 9, 2)))
    killed.replace("other", rows(spark))
    del killed  # dies before its commit
    assert catalogue.table("t").count() == 2 and catalogue.versions() == [1]
    with pytest.raises(KeyError):
        catalogue.table("other")
    two = catalogue.begin("r3")
    two.append("t", rows(spark, ("a", 2, 2)))
    two.commit()
    assert sorted(r.v for r in two.catalogue.begin("x").current("t", "k").collect()) == [1, 2]
    assert pinned.count() == 2 and catalogue.table("t", 1).count() == 2 and catalogue.table("t").count() == 3
    assert len(catalogue.vacuum()) == 2 and catalogue.table("t").count() == 3


def test_runs_are_done_once_and_conflicts_are_found(spark, catalogue):
    append = lambda run: run.append("items", rows(spark, ("a", 1, 0)))
    assert catalogue.run("r1", append) == 1 and catalogue.run("r1", append) == 1
    assert catalogue.table("items").count() == 1
    a, b, c = catalogue.begin("a"), catalogue.begin("b"), catalogue.begin("c")
    for run in (a, b):
        run.append("items", rows(spark, (run.run_id, 1, 0)))
    c.table("items")
    c.replace("sums", rows(spark, ("s", 1, 0)))
    assert (a.commit(), b.commit()) == (2, 3)  # appends go on top of each other
    with pytest.raises(Conflict):
        c.commit()
    assert catalogue.table("items").count() == 3 and "sums" not in catalogue._entry(3)["tables"]
    tries = []

    def reads(run):
        if not tries:
            catalogue.run("d", append)
        tries.append(run.table("items").count())
        run.replace("sums", rows(spark, ("s", tries[-1], 0)))

    catalogue.run("c", reads)
    assert tries == [3, 4] and catalogue.table("sums").first().v == 4
    catalogue.compact("items", None)
    assert len(catalogue._entry(max(catalogue.versions()))["tables"]["items"]["folders"]) == 1 and catalogue.table("items").count() == 4


def test_last_before_with_hot_keys(spark):
    r = random.Random(1)
    events = [(r.choice("aaaab"), o, f"e{o}") for o in range(0, 400, r.choice((1, 2)))] + [(None, 3, "n")]
    wanted = [(r.choice(("a", "b", "c", None)), o) for o in range(420)]
    e, w = spark.createDataFrame(events, "k string, o long, v string"), spark.createDataFrame(wanted, "k string, o long")
    expected = sorted((o, k or "", max(((eo, v) for ek, eo, v in events if ek == k and eo < o), default=(0, None))[1] if k else None) for k, o in wanted)
    for hot in (10, 100_000):
        assert sorted((x.o, x.k or "", x.v) for x in last_before(w, e, "k", "o", "v", hot).collect()) == expected


def test_place(spark):
    bounds = [1, 3, 3, 7, 20, 21, 40]
    got = spark.range(50).select("id", place(bounds, F.col("id")).alias("p")).collect()
    assert all(x.p == sum(b < x.id for b in bounds) for x in got)


def test_version_fold_with_hot_keys(spark):
    r = random.Random(2)
    data = [(i, r.choice("aaaaab"), r.choice((None, date(2024, 1, 1 + r.randrange(28))))) for i in range(300)]
    df = spark.createDataFrame(data, "seq long, k string, m date")
    assert sorted(dedup.version_fold(df, "k", "m", "seq", hot=20).collect()) == sorted(dedup.version_fold(df, "k", "m", "seq").collect())


def test_fuzzy_match_of_a_title_that_many_hold(spark):
    """A thousand holders of one title with years and authors, known and unknown, on both sides."""
    r = random.Random(3)
    make = lambda n: [(f"{n}{i:04d}", "the same long title of all", r.choice((None, 2020, 2021)), r.choice(("", "kim", "lee", f"a{i}"))) for i in range(1000)]
    mine, theirs = make("i")[:300], make("s")
    fits = lambda a, b: (a[2] is None or b[2] is None or a[2] == b[2]) and (not a[3] or not b[3] or a[3] == b[3])
    table = lambda x: spark.createDataFrame(x, "resource_id string, title string, year int, author string")
    got = {x.in_id: x.match_id for x in dedup.fuzzy_match(table(mine), table(theirs)).collect()}
    assert got == {a[0]: min(b[0] for b in theirs if fits(a, b)) for a in mine}


RESOURCES = "seq long, resource_id string, source_id string, doi string, official_identifier string, title_original string, title_ko string, authors array<string>, publication_date date, source_modified_date date, file_sha256 string, work_id string, last_seen_at timestamp_ntz"


def loop(arrivals, stored):
    """The fold as a loop over records: (resource_id, verdict, match_id, matched_by)."""
    have = [dict(x, seen=(x["last_seen_at"], x["seq"])) for x in sorted(stored, key=lambda x: x["seq"])]
    clock, out = datetime(2030, 1, 1), []
    tokens = lambda x: set((x["title_original"] or "").lower().split())

    def by_title(x):
        for y in have:
            a, b = tokens(x), tokens(y)
            if not a or not b or len(a & b) < 0.85 * len(a | b) or x["title_original"].lower()[:12] not in y["title_original"].lower():
                continue
            if x["publication_date"] and y["publication_date"] and x["publication_date"].year != y["publication_date"].year:
                continue
            if x["authors"] and y["authors"] and x["authors"][0].lower() != y["authors"][0].lower():
                continue
            return y
        return None

    for x in sorted(arrivals, key=lambda x: x["seq"]):
        found, by = None, None
        latest = lambda ys: max(ys, key=lambda y: y["seen"], default=None)
        if x["doi"] and (found := latest([y for y in have if y["doi"] == x["doi"]])):
            by = "doi"
        elif x["official_identifier"] and (found := latest([y for y in have if (y["source_id"], y["official_identifier"]) == (x["source_id"], x["official_identifier"])])):
            by = "official_identifier"
        elif found := by_title(x):
            by = "title+year"
        verdict = "NEW"
        if found:
            later = x["source_modified_date"] and found["source_modified_date"] and x["source_modified_date"] > found["source_modified_date"]
            other = x["file_sha256"] and found["file_sha256"] and x["file_sha256"] != found["file_sha256"]
            verdict = "NEW_VERSION" if later or other else "DUPLICATE"
        if verdict == "DUPLICATE":
            found["seen"] = (clock, x["seq"])
        else:
            have.append(dict(x, seen=(clock, x["seq"])))
        out.append((x["resource_id"], verdict, found and found["resource_id"], by))
    return sorted(out)


@pytest.mark.parametrize("seed", (0, 2))
def test_arrivals_fold_as_a_loop_does(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta".split())

    def record(i, n):
        title = r.choice(["", f"study of {word()} {word()} law", f"study of {word()} {word()} law"])
        return {
            "seq": i, "resource_id": f"{n}{i:03d}", "source_id": r.choice("st"), "doi": r.choice(["", "", f"10.1/{r.randrange(9)}"]), "official_identifier": r.choice(["", f"x{r.randrange(9)}"]), "title_original": title, "title_ko": "",
            "authors": r.choice([[], ["Kim"], ["Lee"]]), "publication_date": r.choice([None, date(2020, 1, 1), date(2021, 1, 1)]), "source_modified_date": r.choice([None, date(2024, 1, r.randint(1, 9))]), "file_sha256": r.choice(["", "", "f1", "f2"]), "work_id": "", "last_seen_at": datetime(2024, 1, 1 + i % 20, i % 24),
        }

    stored, arrivals = [record(i, "s") for i in range(25)], [record(100 + i, "a") for i in range(70)]
    table = lambda x: spark.createDataFrame(x, RESOURCES)
    got = fold_arrivals(table(arrivals), table(stored), Scratch(spark), hot=(5, 1000, 1000)[seed]).collect()
    assert sorted((x.resource_id, x.verdict, x.match_id, x.matched_by) for x in got) == loop(arrivals, stored)


def test_index_after_changes_scores_as_one_built_afresh(spark, catalogue):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["common"] * 20 + ["pre1", "pre2"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 60)))
    docs = {f"d{i:03d}": (text(), text()) for i in range(400)}
    table = lambda x: spark.createDataFrame([(i, *t) for i, t in x.items()], "id string, title string, body string")
    catalogue.run("1", lambda run: index.add_documents(run, table(docs), ["title", "body"]))
    changed = {i: (text(), text()) for i in list(docs)[:60]} | {f"n{i}": (text(), "") for i in range(30)}
    catalogue.run("2", lambda run: index.add_documents(run, table(changed), ["title", "body"]))
    gone = list(docs)[50:90]
    catalogue.run("3", lambda run: index.remove_documents(run, spark.createDataFrame([(i,) for i in [*gone, "never there"]], "id string")))
    left = {i: t for i, t in (docs | changed).items() if i not in gone}
    fresh = build_index(table(left), "id", ["title", "body"])

    def same(query, k=15):
        want, told = search(fresh, query, k).collect(), {}
        got = index.top(catalogue, query, k, tiles=1, told=told).collect()
        assert [(x.id, round(x.score, 9)) for x in got] == [(x.id, round(x.score, 9)) for x in want], query
        return told

    queries = ["common", "w1 w2", "w3 OR w4", "common NOT w5", "title:w6", "pre*", '"common common"', "absent", "w1 absent OR w2"]
    for q in queries:
        same(q)
    index.merge_segments(catalogue, "m")
    for q in queries[:5]:
        same(q)
    told = same("w1", 3)
    assert told["opened"] < told["blocks"]  # not all blocks were opened
    assert index.top(catalogue, "", 3).count() == 0


def test_index_of_nothing(spark, catalogue):
    none = spark.createDataFrame([], "id string, title string")
    catalogue.run("1", lambda run: index.add_documents(run, none, ["title"]))
    assert index.top(catalogue, "a", 3).count() == 0
    odd = spark.createDataFrame([("a", None), (None, "x"), ("b", ""), ("c", "x y x"), ("c", "x y x")], "id string, title string")
    catalogue.run("2", lambda run: index.add_documents(run, odd, ["title"]))
    assert [x.id for x in index.top(catalogue, "x", 3).collect()] == ["c"]


def test_file_names_match_library_rules(spark):
    rows = spark.createDataFrame([(1, "a", "x.pdf", "1111111122"), (2, "a", "x.pdf", "2222222233"), (3, "b", "x.pdf", "33")], "o int, f string, n string, d string")
    assert [x.stored_name for x in file_names(rows, "f", "n", "o", "d").orderBy("o").collect()] == ["x.pdf", "x__22222222.pdf", "x.pdf"]
