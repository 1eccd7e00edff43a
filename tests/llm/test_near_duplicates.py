import random
import re
from itertools import combinations

import numpy as np

from folioforge.llm.chunks import cut_points, repeated_spans, without_repeats
from folioforge.llm.common import Tables
from folioforge.llm.components import connected_components
from folioforge.llm.minhash import set_classes, near_duplicates, part_keys, part_slots, radius_for
from folioforge.llm.shingles import MinHash, shingle_set, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = root(a), root(b)
            if x != y:
                x, y = sorted((x, y), key=lambda i: rows[i][0])
                least[y] = x
    return {(r[0], len(sets[i]), rows[root(i)][0]) for i, r in enumerate(rows)}


def edited(text, at, n):
    w = text.split(" ")
    return " ".join(w[:at] + [f"new{at}x{k}" for k in range(n)] + w[at + n :])


def test_components_and_counts_equal_brute_force(documents, prose):
    rows = [(i, prose(i, 60 + i)) for i in range(1, 25)]
    for i in range(12):  # chains of copies, each a little further from the first
        rows.append((100 + i, edited(rows[-1][1] if i else rows[0][1], 5 * i, 2)))
    rows += [(200 + i, edited(rows[3][1], 7 * i % 50, 1 + i % 9)) for i in range(30)]
    rows += [(300 + i, rows[5][1].upper() if i % 2 else rows[5][1]) for i in range(20)]
    rows += [(400, "one"), (401, "one two"), (402, "One  TWO"), (403, ""), (404, " \t\n"), (405, "é É"), (406, "é É")]
    got = near_duplicates(documents(rows), width=3, percent=85, block=7).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty_tables(documents, spark):
    text = "a b c d e f g h"
    rows = [(None, text), (7, text), (7, text), (7, "other words than these here"), (8, None), (9, None), (None, "quite alone in this table")]
    got = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(documents(rows), 3, 85).collect()), key=str)
    assert got == sorted([(None, 7, False, 6), (7, 7, True, 6), (7, 7, True, 6), (7, 7, True, 3), (8, 8, True, 0), (9, 9, True, 0), (None, None, True, 3)], key=str)
    assert near_duplicates(documents([]), 3, 85).count() == 0


def test_every_pair_within_the_radius_shares_a_slot():
    rng = np.random.default_rng(3)
    radius = radius_for(64, 85)
    slots = part_slots(64, radius // 2 + 1, radius)
    base = rng.integers(0, 2**16, 64, dtype=np.uint16)
    for _ in range(300):
        other = base.copy()
        other[rng.choice(64, radius, replace=False)] += 1
        keys = part_keys(np.stack([base, other]), slots)
        assert (keys[0] == keys[1]).any()


def test_signature_distance_follows_similarity():
    sign, rng = MinHash(64), np.random.default_rng(5)
    far = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = np.sort(both[:925]), np.sort(np.concatenate((both[:850], both[925:])))
        far.append((sign(a) != sign(b)).sum())
    assert abs(np.mean(far) - 64 * 0.15) < 1 and max(far) <= radius_for(64, 85)


def test_words_and_shingles():
    assert len(word_hashes("a\tb\x0bc  d\n")) == 4 and len(word_hashes("a\xa0b")) == 1
    assert (word_hashes("ABC É") == word_hashes("abc É")).all() and (word_hashes("É") != word_hashes("é")).all()
    assert len(shingle_set("x y x y x y", 2)) == 2 and len(shingle_set("x y", 3)) == 1 and len(shingle_set(None, 3)) == 0
    assert len(shingle_set("w " * 100_000, 3)) == 1


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 300), (200, 300), (200, 50)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long"), Tables(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[k] for k in (100, 200, 300, 50)} == {50} and got[1050] == 1000


def test_chunks_resist_shifts(prose):
    text = prose(1, 3000)
    chunks = lambda t: [t[a:b] for a, b in zip(c, c[1:])] if (c := cut_points(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)).tolist()) else []
    assert "".join(chunks(text)) == text and max(map(len, chunks(text))) <= 255
    moved = chunks(text[:500] + "inserted words " + text[500:])
    assert len(set(chunks(text)) - set(moved)) <= 3
    assert max(map(len, chunks("x" * 5000))) <= 255 and chunks("") == []


def test_chunks_of_text_without_blanks_resist_shifts(documents):
    r = random.Random(5)
    make = lambda n: "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(n))
    chunks = lambda t: [t[a:b] for a, b in zip(c, c[1:])] if (c := cut_points(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)).tolist()) else []
    text = make(5000)
    assert "".join(chunks(text)) == text and max(map(len, chunks(text))) <= 255
    assert len(set(chunks(text)) - set(chunks(text[:500] + "\u4e01" + text[500:]))) <= 3
    assert all(len(chunks(c * 5000)) <= 100 for c in map(chr, range(0x21, 0x2000)))
    passages = [make(300) for _ in range(20)]
    rows = [(k, make(40 + k) + p + make(77)) for k, p in enumerate(passages)] + [(100 + k, make(131 + 3 * k) + p + make(50)) for k, p in enumerate(passages)]
    assert len({s.doc_id for s in repeated_spans(documents(rows)).collect()}) >= 19


def test_repeated_passages_are_found_and_cut(documents, prose):
    passages = [prose(1000 + k, 55) for k in range(20)]
    rows = [(i, prose(i, 150) + "\n" + passages[i % 20] + "\n" + prose(500 + i, 150)) for i in range(60)]
    rows += [(900 + i, prose(700 + i, 200) + " Released under the MIT License.") for i in range(20)]
    docs = documents(rows)
    spans = repeated_spans(docs).collect()
    text = dict(rows)
    assert {r.doc_id for r in spans} <= set(range(20, 60)) and len({r.doc_id for r in spans}) >= 38
    for r in spans:
        assert r.source_doc_id < r.doc_id and r.span_end - r.span_start >= 90
        piece = text[r.doc_id][r.span_start : r.span_end]
        assert piece.strip() in passages[r.doc_id % 20]
    kept = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert all(kept[i].text == text[i] for i in (*range(20), *range(900, 920)))
    assert sum(passages[i % 20] in kept[i].text for i in range(20, 60)) <= 2
    assert all(r.n_chars == len(r.text) for r in kept.values()) and without_repeats(docs).columns == docs.columns


def test_chunk_cases(documents, prose):
    long = prose(4, 200)
    rows = [(None, long), (3, long), (3, long), (4, None), (5, ""), (6, long), (6, "x " + long)]
    got = {(r.doc_id, r.text_tag, r.span_start) for r in repeated_spans(documents(rows)).collect()}
    assert {g[0] for g in got} == {None, 6} and len({g for g in got if g[0] == 6}) == 2
    left = sorted(((r.doc_id, r.text) for r in without_repeats(documents(rows)).collect()), key=str)
    assert [t for i, t in left if i == 3] == [long, long] and (4, None) in left and (5, "") in left and (None, "") in left
    assert repeated_spans(documents([])).count() == 0 and without_repeats(documents([])).count() == 0


def test_sets_with_one_hash_are_told_apart(spark):
    """Two classes that share a 64-bit name by chance get names of their own."""
    rows = [(1, 11, 5, 100, 7, b"a"), (2, 12, 5, 100, 7, b"a"), (3, 13, 4, 100, 8, b"b"), (4, 14, 4, 200, 9, b"c"), (5, 15, 0, None, None, None)]
    feats = spark.createDataFrame(rows, "doc_id long, text_tag long, n_shingles long, cls long, mark long, sig binary")
    feats, classes = set_classes(feats, Tables(spark, "test"))
    got = sorted((r.least, r.tag, r.n, bytes(r.sig)) for r in classes.collect())
    assert got == [(1, 11, 5, b"a"), (3, 13, 4, b"b"), (4, 14, 4, b"c")] and feats.count() == 5
    by = {r.doc_id: r.cls for r in feats.collect()}
    assert by[1] == by[2] != by[3] and by[4] == 200 and by[5] is None
