"""Language ID against TF-IDF, spherical k-means and radii written out in plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

from folioforge.llm.langid import fit, held_out, predict

CELLS, BITS = 4096, 0xFFFFFFFF
CLASSES, MIDDLE = (8, 16, 32, 64, 128, 256, 1 << 30), (6, 11, 23, 45, 91, 181, 256)


def cells(text):
    c = [ord(x) for x in f" {text.lower()} "]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B) & BITS for a, b in zip(c, c[1:])]
    three = [(x * 0xC2B2AE35 + b * 0x27D4EB2F) & BITS for x, b in zip(two, c[2:])]
    mixed = lambda x: (((x ^ (x >> 15)) * 0x2C1B3C6D) & BITS) >> 20
    return Counter(map(mixed, two)) + Counter(map(mixed, three))


def unit(v):
    length = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / length for k, x in v.items()} if length else v


def vector(text, idf):
    return unit({k: (1 + math.log(n)) * idf[k] for k, n in cells(text).items()})


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def clustered(texts, idf, clusters=4, rounds=12, slack=0.7):
    """(centres, radius by length class) of distinct texts of one language."""
    texts = sorted(set(texts), key=lambda t: (int(hashlib.md5(t.encode()).hexdigest()[:15], 16), t))
    x = [vector(t, idf) for t in texts]
    rng = np.random.Generator(np.random.PCG64(11))
    seeds = [int(rng.integers(len(x)))]
    while len(seeds) < min(clusters, len(x)):
        far = [max(1e-9, 1 - max(dot(v, x[s]) for s in seeds)) ** 2 for v in x]
        seeds.append(int(rng.choice(len(x), p=np.array(far) / sum(far))))
    centres = [x[s] for s in seeds]
    for _ in range(rounds):
        own = [max(range(len(centres)), key=lambda k: (dot(v, centres[k]), -k)) for v in x]
        for k in range(len(centres)):
            if k in own:
                total = Counter()
                for v, o in zip(x, own):
                    if o == k:
                        for c, w in v.items():
                            total[c] += w
                centres[k] = unit(total)
    best, size = [max(dot(v, c) for c in centres) for v in x], [len(cells(t)) for t in texts]
    kind = [next(i for i, top in enumerate(CLASSES) if n <= top) for n in size]
    radius = []
    for c in range(len(CLASSES)):
        reach = next((a for a in range(len(CLASSES)) if sum(abs(k - c) <= a for k in kind) >= 20), None)
        near = [b * (math.sqrt(min(1, MIDDLE[c] / n)) if k > c else 1) for b, n, k in zip(best, size, kind) if reach is not None and abs(k - c) <= reach]
        radius.append(slack * min(near) if near else None)
    return centres, radius


def test_languages_by_hand(spark, documents):
    r = random.Random(21)
    parts = {"en": "the and ing tion er on th".split(), "fr": "eau le oi ment qu ou".split(), "de": "sch und ein ung ver ö".split()}
    text = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, r.randint(1, 40)), lang) for i in range(150) for lang in [r.choice(list(parts))]]
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(10)]  # copies count in documents, once in the fit
    rows += [(900, "кириллица " * 9, None), (901, None, "en"), (902, "12 34", "en"), (903, "你好世界", None), (904, "a", None)]
    docs = documents(rows)
    model = fit(docs, ~held_out())

    kept = [(t, lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 5]
    df = Counter(c for t, _ in kept for c in cells(t))
    idf = [math.log((1 + len(kept)) / (1 + df[c])) + 1 for c in range(CELLS)]
    assert np.allclose(model.idf, idf)
    plain = {lang: clustered([t for t, x in kept if x == lang and any(c.isalpha() for c in t)], idf) for lang in parts}
    for lang, (centres, radius) in plain.items():
        mine = [k for k, x in enumerate(model.langs) if x == lang]
        assert len(mine) == len(centres) == 4
        for c in centres:
            dense = np.array([c.get(k, 0.0) for k in range(CELLS)])
            assert min(np.abs(model.centroids[k] - dense).max() for k in mine) < 1e-3
        for k in mine:
            assert all(abs(a - b) < 1e-3 for a, b in zip(model.radius[k], radius) if b is not None)

    sure = 0
    for x in predict(docs, model).collect():
        if x.text is None or not any(c.isalpha() for c in x.text):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        v = vector(x.text, idf)
        ranked = sorted(((dot(v, c), lang) for lang, (centres, _) in plain.items() for c in centres), reverse=True)
        assert abs(x.score - min(1, ranked[0][0])) < 1e-3
        if ranked[0][0] - max(s for s, lang in ranked if lang != ranked[0][1]) > 1e-3:
            sure += 1
            assert x.lang_pred == ranked[0][1]
            bound = plain[x.lang_pred][1][next(i for i, top in enumerate(CLASSES) if len(cells(x.text)) <= top)]
            if bound is not None and abs(ranked[0][0] - bound) > 1e-3:
                assert x.rejected == (ranked[0][0] < bound)
    assert sure > 140
