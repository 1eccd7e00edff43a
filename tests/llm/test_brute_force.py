"""Operators and pipeline stages without SQL, against plain Python on small tables."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
import xxhash

from folioforge.llm.bpe import parse_ranks
from folioforge.llm.chunks import cut_points, repeated_spans, without_repeats
from folioforge.llm.langid import fit, held_out, predict, vector

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(text, least=90):
    """(start, end, text) from each chunk on, as long as it takes for a passage."""
    cuts = cut_points(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)).tolist()
    ends = [(a, next((b for b in cuts if b - a >= least), None)) for a in cuts[:-1]]
    return [(a, b, text[a:b]) for a, b in ends if b]


def tag_of(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def spans(rows):
    """(doc_id, tag, start, end, source, source start): rows of (doc_id, text), by dictionaries of runs."""
    first = {}
    for doc, text in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0], tag_of(r[1]))):
        for a, _, c in runs(text):
            first.setdefault(c, (doc, tag_of(text), a))
    out = set()
    for doc, text in rows:
        tag, ways = tag_of(text), {}
        for a, b, c in runs(text) if text else []:
            source, its, at = first[c]
            if (source, its) == (doc, tag):
                continue
            found = ways.setdefault((source, its, at - a), [])
            if found and a <= found[-1][1]:
                found[-1][1] = b
            else:
                found.append([a, b])
        reached = 0
        last = lambda source: (source is None, source or 0)
        for a, _, _, _, _, b, source, away in sorted((a, -b, last(source), its, away, b, source, away) for (source, its, away), found in ways.items() for a, b in found):
            if b > reached:
                out.add((doc, tag, a, b, source, a + away))
                reached = b
    return out


def corpus(prose, seed):
    r = random.Random(seed)
    passages = [prose(900 + i, r.randint(40, 120)) for i in range(6)] + ["漢字仮名交文" * 5 + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(400))]
    rows = []
    for i in range(60):
        parts = [prose(100 * seed + i, r.randint(10, 150))] + r.sample(passages, r.randint(0, 2))
        r.shuffle(parts)
        rows.append((i, r.choice(["\n", " ", ""]).join(parts)))
    return rows + [(60, rows[3][1]), (61, rows[3][1]), (61, rows[5][1]), (62, None), (63, ""), (64, "x" * 3000), (65, "y" + "x" * 3000), (None, rows[7][1]), (None, rows[9][1] + " tail"), (None, "tail " + rows[9][1]), (None, "tail " + rows[9][1])]


def test_repeated_spans_equal_dictionaries(documents, prose):
    rows = corpus(prose, 3)
    got = {(r.doc_id, r.text_tag, r.span_start, r.span_end, r.source_doc_id, r.source_start) for r in repeated_spans(documents(rows)).collect()}
    assert got == spans(rows) and len(got) > 20
    texts = dict(rows[:60])
    for doc, _, a, b, source, at in got:  # every span is one passage that stands at its source
        if source in texts and doc in texts:
            assert texts[doc][a:b] == texts[source][at : at + b - a]


def test_texts_without_an_id_are_told_apart(documents, prose):
    """Thousands of rows without a doc_id: only those that hold the passage lose it."""
    passage = prose(1, 60)
    rows = [(1, passage + " first")] + [(None, f"{passage} row {k}") for k in range(20)] + [(None, prose(50 + k, 30)) for k in range(3000)]
    left = [r.text for r in without_repeats(documents(rows).select("doc_id", "text")).where("doc_id is null").collect()]
    assert sorted(t for t in left if not t.startswith(passage[:40]) and "row" not in t[-8:]) == sorted(t for d, t in rows[21:])
    assert sum(len(t) < 120 for t in left) >= 20
    alone = [r.text for r in without_repeats(documents(rows[1:21]).select("doc_id", "text")).collect()]
    assert sorted(len(t) > 200 for t in alone) == [False] * 19 + [True]  # without ids they are documents of their own


def test_language_is_that_of_the_nearest_centroid(documents, spark):
    r = random.Random(4)
    parts = {"en": "the and ing tion er on".split(), "fr": "eau le oi ment qu".split(), "de": "sch und ein ung ver".split()}
    rows = []
    for i in range(240):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 60))), lang))
    docs = documents(rows + [(1000, "кириллица " * 20, None)])
    model = fit(docs, ~held_out())
    for x in predict(docs, model).collect():
        cells, values = vector(x.text, model.idf)
        cosine = model.centroids[:, cells] @ values
        assert x.lang_pred == model.langs[int(cosine.argmax())] and abs(x.score - min(1, max(0, float(cosine.max())))) < 1e-4


def near_groups(rows, width=5, percent=80):
    """Smallest doc_id of each row's group by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                name = [min(name[i], name[j]) if n in (name[i], name[j]) else n for n in name]
    return name


def test_pipeline_stages(spark, documents, prose):
    rows = corpus(prose, 5)[:60] + [(100 + i, prose(500, 150) + f" tail{i}") for i in range(8)] + [(200, None), (201, "")]
    docs = documents(rows).drop("size", "key", "label")
    pick = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())

    kept = corpus_pipeline.language_id(spark, docs, "")
    judged = predict(docs, fit(docs, ~held_out())).where("not rejected")
    assert pick(kept) == pick(judged)

    name = near_groups(rows)
    one = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert pick(one) == sorted((d, t or "") for k, (d, t) in enumerate(rows) if name[k] == k)

    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    gone = collections.defaultdict(list)
    for d, _, a, b, *_ in spans(rows):
        gone[d].append((a, b))
    left = lambda d, t: "".join(c for k, c in enumerate(t or "") if not any(a <= k < b for a, b in gone[d]))
    assert pick(cut) == sorted((d, left(d, t)) for d, t in rows)

    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_to_weights(spark, docs, "").collect())
    words = {d: len(WORD.findall(t or "")) for d, t in rows}
    total = sum(words.values())
    taken = sum(words[d] * n for d, n in mixed.items())  # one source: its target is its size
    assert max(mixed.values()) <= 3 and abs(taken - total) <= max(words.values()) / 2

    ranks = parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows)
    for r in corpus_pipeline.byte_level_bpe(spark, docs, "").collect():
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert list(r.token_ids) == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
