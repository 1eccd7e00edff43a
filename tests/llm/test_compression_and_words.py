"""Main text, vector codes and spelling variants against plain Python."""

import hashlib
import html
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import spelling
from folioforge.llm.common import Tables
from folioforge.llm.maintext import extract_main_text, main_text
from folioforge.llm.spelling import near_words, one_edit, spelling_variants
from folioforge.llm.vectorcodes import Tree, compress_vectors, decoded, filter_entries, train_codebooks

# ---- main text

ARTICLE = ["A title", "First paragraph of the text, with as many words as it takes to be one of some length.", "Short.", "The last one."]
EXPECTED = "\n\n".join(ARTICLE)
TITLE, FIRST, SHORT, LAST = ARTICLE
BODY = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SHORT}<p>{LAST}"
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul>'


@pytest.mark.parametrize(
    "page",
    [
        f"<nav>{LINKS}</nav><article>{BODY}</article><footer>&copy; someone</footer>",
        f"<header><h1>The site</h1>{LINKS}</header><main>{BODY}</main><aside><p>{FIRST}</p></aside>",
        f"<header>{LINKS}</header><article><header><h1>{TITLE}</h1></header><p>{FIRST}</p><p>{SHORT}</p><p>{LAST}</p><footer>Tags</footer></article>",
        f'<div class="top-nav">{LINKS}</div><div class="wrap has-sidebar"><div class="content">{BODY}</div><div id="sidebar"><p>{FIRST}</p></div></div>',
        f'<article>{BODY}</article><section class="comments"><article><p>{FIRST}</p></article><article class="comment">Me too</article></section>',
        f'<form id="aspnet"><div class="cookie-notice">We use cookies</div><article>{BODY}</article><div class="newsletter"><p>{FIRST}</p></div></form>',
        f"<div>{LINKS}</div><div>{BODY}</div><div>{LINKS}</div>",
        f'<article><h1>{TITLE}</h1><p>{FIRST}</p><div class="ad"><p>{FIRST}</p></div><form><p>Your name</p><input></form><p>{SHORT}</p><p>{LAST}</p></article>',
        f"<article>{BODY}<script>var a = '</p><p>no</p>';</script><style>p {{}}</style><noscript><p>On!</p></noscript></article>",
        f"<article>{BODY}</article><foot",
        f"<nav>{LINKS}<article>{BODY}</article>",
        f'<article>{BODY}<p hidden>no</p><p style="display: none">no</p><!-- <p>no</p> --></article><div>{FIRST}</div>',
        f"<table><tr><td>{LINKS}<td>{BODY}</table>",
    ],
)
def test_article_between_other_parts(page):
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}") == EXPECTED


def test_references_white_space_and_odd_markup():
    assert main_text("<article><p>a &amp;&lt;b&gt;&nbsp; c\n\t d<br>e&#x41;&#66; &amp x &am</p></article>") == "a &<b> c d eAB & x &am"
    assert main_text('<article><p title="a > b">x < y</p><P>Z</P></article>') == "x < y\n\nZ"
    assert main_text("<article><p>one<ul><li>two<li>three</ul>four</article>") == "one\n\ntwo\n\nthree\n\nfour"
    assert main_text("") == main_text("<p></p>") == main_text("<!-- no end <p>a</p>") == main_text("<nav><a>x</a></nav>") == ""
    assert main_text("no markup") == "no markup"


def test_short_articles_and_deep_or_long_pages():
    assert main_text("<nav>" + LINKS * 40 + "</nav><article><p>Hm.</p></article>") == "Hm."
    assert main_text("<article>" + "<b>" * 20_000 + "deep" + "</article>") == "deep"
    long = "word " * 400_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_main_text_of_a_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (None, None, None, "x"), (3, "v", "", None), (1, "u", f"<article>{BODY}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(extract_main_text(pages).collect(), key=str)
    assert [tuple(r) for r in out] == sorted([(1, "u", EXPECTED, len(EXPECTED)), (None, None, "", 0), (3, "v", "", 0), (1, "u", EXPECTED, len(EXPECTED))], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_main_text_of_random_pages():
    """Pages put together from parts with and without a known article."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéñ&<") for _ in range(r.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    parts = [lambda: f"<nav>{LINKS}</nav>", lambda: f"<aside><p>{html.escape(line(40))}</p></aside>", lambda: f'<div class="advert">{html.escape(line(30))}</div>', lambda: f"<form><label>{html.escape(line(3))}</label></form>", lambda: '<div id="comments"><p>' + html.escape(line(50)) + "</p></div>", lambda: f"<!-- {line(4).replace('-', '')} -->", lambda: f"<footer>{html.escape(line(12))}</footer>"]
    for _ in range(200):
        blocks = [line(r.choice((1, 3, 30))) for _ in range(r.randint(1, 6))]
        body = "".join((r.choice(parts)() if r.random() < 0.3 else "") + f"<p>{html.escape(b)}{r.choice(('</p>', ''))}" for b in blocks)
        page = "".join(r.choice(parts)() for _ in range(3)) + f"<article>{body}</article>" + "".join(r.choice(parts)() for _ in range(3))
        assert main_text(page) == "\n\n".join(blocks)


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows by comparing all with all."""
    rows = [(k, [int(np.floor(256 * x)) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in sorted(rows)[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (square(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            found = {}
            for _, v, _ in rows:
                found.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(found[k]) for c in zip(*found[k])) if k in found else e for k, e in enumerate(books[p])]
    coded = [(k, [nearest(cut(v, p), books[p]) for p in range(parts)], v, label) for k, v, label in rows]
    errors = [sum(square(cut(v, p), books[p][c[p]]) for p in range(parts)) for _, c, v, _ in coded]
    labels = Counter()
    for e, (*_, label) in zip(errors, coded):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, "".join(f"{x:02x}" for x in c), e, labels[label], digest) for e, (k, c, _, label) in zip(errors, coded))


EMBEDDINGS = "vec_id long, embedding array<float>, label int, code string, error double"


def test_vector_codes_equal_plain_lloyd(spark):
    r = random.Random(5)
    rows = [(k, [r.choice((-0.5, 0.25, r.uniform(-1, 1))) for _ in range(32)], r.choice((None, 1, 2))) for k in range(300)]
    rows += [(k + 300, rows[k][1], 1) for k in range(40)]  # ties and copies
    odd = [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [None] + [0.0] * 31, 1), (903, [float("inf")] * 32, None)]
    vectors = spark.createDataFrame([(*x, "c", 1.0) for x in rows + odd], EMBEDDINGS).repartition(5)
    got = sorted(tuple(x) for x in compress_vectors(vectors).collect())
    assert got == plain_codes([(k, np.array(v, dtype=np.float32).tolist(), label) for k, v, label in rows])


def test_vector_codes_of_few_rows_and_odd_sizes(spark):
    one = spark.createDataFrame([(7, [0.5, 1.0], None, "c", 1.0), (None, [0.5, 2.0], None, "c", 1.0), (8, [1.0], 3, "c", 1.0), (9, [], 3, "c", 1.0), (10, [1e30, -1e30], 3, "c", 1.0)], EMBEDDINGS)
    got = {x["vec_id"]: (x["code"], x["error"], x["label_error"]) for x in compress_vectors(one, parts=2).collect()}
    assert got == {7: ("0000", 0, 0), 10: ("0101", 0, 0), None: ("0002", 0, 0)}
    assert compress_vectors(one.limit(0)).count() == 0
    assert compress_vectors(one.where("vec_id = 9")).count() == 0
    assert len({x["codebooks_sha256"] for x in compress_vectors(one, parts=2).collect()}) == 1
    assert decoded("01", np.array([[[0, 0], [256, -256]]])) == [1.001953125, -0.998046875]


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("folioforge.llm.vectorcodes.BROADCAST_ROWS", 2)
    rows = [(k, [k / 7.0, 1.0 - k], (k % 5) or None, "c", 1.0) for k in range(150)]
    got = sorted(tuple(x) for x in compress_vectors(spark.createDataFrame(rows, EMBEDDINGS), parts=2, entries=8).collect())
    assert got == plain_codes([(a, np.array(b, dtype=np.float32).tolist(), c) for a, b, c, *_ in rows], 2, 8)


def test_filtering_assigns_whole_subtrees():
    r = np.random.default_rng(6)
    points = np.concatenate((r.integers(-50, 50, (4000, 4)), r.integers(900, 950, (4000, 4))))
    entries = np.concatenate((r.integers(-50, 50, (9, 4)), [[925] * 4, [0] * 4, [0] * 4]))
    tree, found, ranges = Tree(points), np.full(len(points), -1), 0
    for first, end, entry in filter_entries(tree, entries):
        for a, b, e in zip(first, end, entry):
            assert (found[tree.order[a:b]] == -1).all()
            found[tree.order[a:b]] = e
            assert (tree.sums[b] - tree.sums[a] == points[tree.order[a:b]].sum(axis=0)).all()
            ranges += 1
    assert (found == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert ranges < 4200  # the far half of the points went in one go


def test_unused_entries_stay(spark):
    vectors = spark.createDataFrame([(k, [1.0, 2.0], 1, "c", 1.0) for k in range(5)], EMBEDDINGS)
    assert train_codebooks(vectors, parts=1, entries=3).tolist() == [[[256, 512]] * 3]


# ---- spelling


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return plain_forms({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def plain_near(words):
    return {w: sorted((-words[v], v) for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1) for w in words}


def plain_forms(words):
    near = plain_near(words)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * words[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def variants(r, base, n):
    """n words within a few edits of ``base``."""
    out = set()
    while len(out) < n:
        w = list(base)
        for _ in range(r.randint(1, 2)):
            k = r.randrange(len(w))
            r.choice((lambda: w.insert(k, r.choice("abé")), lambda: w.pop(k), lambda: w.__setitem__(k, r.choice("abé"))))()
        if len(w) >= 7:
            out.add("".join(w))
    return out


def test_spelling_variants_equal_plain_python(documents):
    r = random.Random(8)
    names = ["Grammatik", "bababababa", "ÜBERaus×ig", "aaaaaaaa", "abababab", "kurz", "conception", "inception"]
    words = names * 30 + [w for n in ("bababababa", "grammatik", "aaaaaaaa") for w in variants(r, n, 40)] * 2
    rows = [(k, " ".join(r.choice(words) for _ in range(400)) + "\n") for k in range(40)] + [(None, None), (41, ""), (None, "Grammatik, grammatik; 12"), (3, "grammatik " * 50)]
    got = sorted(tuple(x) for x in spelling_variants(documents(rows)).collect())
    want = plain_variants(rows)
    assert got == want and any(x[2] != x[1] != None for x in want)  # noqa: E711
    assert spelling_variants(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 25, 1])
def test_near_words_with_hot_halves(spark, hot, monkeypatch):
    """Hundreds of words that share a half, whose half is split or not, in many shards or few."""
    r = random.Random(9)
    words = {w: r.randint(2, 9) for w in variants(r, "abbaabba", 250) | variants(r, "grammatik", 60) | {"grammatik", "abbaabba", "unrelated"}}
    tables = Tables(spark, "test")
    table = tables.put("words", spark.createDataFrame(list(words.items()), "word string, n long"))
    monkeypatch.setattr(spelling, "MOST_HOT", 1_000_000)
    got = {x["word"]: (x["n_near"], x["best_n"], x["best"]) for x in near_words(table, tables, shard=200, hot=hot).collect()}
    near = plain_near(words)
    assert got == {w: (len(near[w]), -near[w][0][0] if near[w] else None, near[w][0][1] if near[w] else None) for w in words}


def test_one_edit():
    r = random.Random(10)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) == 1)
