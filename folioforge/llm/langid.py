"""Language identification: nearest of several centroids per language, with distance-based rejection.

A text is a vector of its character 2- and 3-grams (lower case, hashed into ``_DIM`` cells), weighted
by (1 + log tf) * idf and scaled to length 1.  Each language has ``clusters`` centroids from seeded
spherical k-means.  A text gets the language of the centroid with the largest cosine; a text whose
cosine is below its centroid's radius, learned from held-in texts of its length, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, gives_back, named

_DIM = 4096
_LETTER = regex.compile(r"\p{L}")
#: Upper bounds of the length classes (distinct n-grams) that have a radius of their own.
_LENGTHS = (8, 16, 32, 64, 128, 256, 1 << 30)
#: A length inside each class, to which cosines of longer texts are scaled.
_MIDDLE = (6, 11, 23, 45, 91, 181, 256)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of a text's n-grams, word borders counted as blanks."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), dtype=np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    count = np.bincount(np.concatenate(((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20))), minlength=_DIM)
    cells = np.flatnonzero(count)
    return cells, count[cells]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, count = grams(text)
    v = (1 + np.log(count)) * idf[cells]
    length = np.sqrt(v @ v)
    return cells, (v / length if length else v).astype(np.float32)


@dataclass
class Model:
    """langs[i] is the language of centroids[i]; radius[i, k] its least cosine at length class k."""

    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); ``und`` for a text without a letter."""
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0, True
        cells, v = vector(text, self.idf)
        near = self.centroids[:, cells] @ v
        best = int(near.argmax())
        cosine = float(near[best])
        return self.langs[best], min(1.0, max(0.0, cosine)), cosine < self.radius[best, np.searchsorted(_LENGTHS, len(cells))]


@gives_back
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each cell, one row a cell and task; cell -1 counts the documents."""
    df, n = np.zeros(_DIM, dtype=np.int64), 0
    for b in batches:
        for text in b.column(0):
            df[grams(text.as_py())[0]] += 1
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, _DIM)), pa.array(np.append(n, df))], ["cell", "n"])


def _clusters(idf: np.ndarray, clusters: int, rounds: int, slack: float):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["place", "text"], ignore_index=True)
        x = np.zeros((len(sample), _DIM), dtype=np.float32)
        size = np.zeros(len(sample), dtype=np.int64)
        for i, text in enumerate(sample["text"]):
            cells, v = vector(text, idf)
            x[i, cells], size[i] = v, len(cells)
        rng = np.random.Generator(np.random.PCG64(11))
        seeds = [int(rng.integers(len(x)))]
        while len(seeds) < min(clusters, len(x)):  # farthest-first by chance, as k-means++ does
            far = np.maximum(1e-9, 1 - (x @ x[seeds].T).max(axis=1)) ** 2
            seeds.append(int(rng.choice(len(x), p=far / far.sum())))
        centers = x[seeds]
        for _ in range(rounds):
            own = (x @ centers.T).argmax(axis=1)
            for k in range(len(centers)):
                if (own == k).any():
                    centers[k] = x[own == k].sum(axis=0)
            centers /= np.maximum(1e-9, np.linalg.norm(centers, axis=1, keepdims=True))
        near = x @ centers.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        kind = np.searchsorted(_LENGTHS, size)
        radius = np.zeros((len(centers), len(_LENGTHS)), dtype=np.float32)
        for c in range(len(_LENGTHS)):
            # Texts of the nearest classes stand in where a class has few: a cosine grows with the root of the length.
            away = np.abs(kind - c)
            reach = np.flatnonzero(np.cumsum(np.bincount(away, minlength=len(_LENGTHS))) >= 20)
            if not len(reach):
                radius[:, c] = np.nan
                continue
            use = away <= reach[0]
            scale = np.where(kind > c, np.sqrt(np.minimum(1, _MIDDLE[c] / np.maximum(1, size))), 1)
            radius[:, c] = slack * (best * scale)[use].min()
        return pd.DataFrame({"lang": sample["lang"].iloc[0], "center": [v.tobytes() for v in centers], "radius": [r.tobytes() for r in radius]})

    return fit


def fit(docs: DataFrame, learn: Column, per_language: int = 600, clusters: int = 4, rounds: int = 12, slack: float = 0.7) -> Model:
    """Learns from rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    Document frequencies count all such rows.  Clusters are fitted on a bounded sample: of each language
    the ``per_language`` distinct texts whose MD5 comes first (all, if it has fewer); so a fit holds
    per_language vectors, and the driver ``clusters`` centroids a language, of which none is left out.  A
    centroid's radius at a length class is ``slack`` times the least cosine that the sample's texts of
    that class have with their centroids.  A class with under 20 texts takes in those of the nearest
    classes, longer ones scaled down by the root of the length; a language with under 20 texts in all
    takes the least radius of the other languages (no rejection if all are so small).
    """
    tables = Tables(docs.sparkSession, "langid")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learn.alias("learn")).where("learn and text is not null and lang is not null").select("text", "lang")
    counts = rows.select("text").mapInArrow(_document_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(_DIM + 1)
    for r in counts.collect():  # _DIM + 1 rows
        found[r["cell"]] = r["n"]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    lettered = rows.where("text rlike '\\\\p{L}'")
    h = F.xxhash64("text").alias("h")
    place = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("place")
    texts = tables.put("texts", lettered.groupBy("lang", h, place).count())  # copies are combined before the shuffle
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in sizes.collect()}
    if not sizes:
        tables.clear("texts")
        return Model([], np.zeros((0, _DIM), np.float32), np.zeros((0, len(_LENGTHS)), np.float32), idf)
    # Of large languages only texts whose MD5 lies low enough for some 2 * per_language distinct ones to come
    # are looked at; the bound of a language that has fewer than per_language below it is doubled.
    texts = texts.where(F.col("lang").isin(list(sizes)))
    below = {lang: min(1 << 60, (2 * per_language << 60) // n) for lang, n in sizes.items()}
    while True:
        bound = F.create_map(*[F.lit(v) for kv in below.items() for v in kv])[F.col("lang")]
        got = {r["lang"]: r["count"] for r in texts.where(F.col("place") <= bound).groupBy("lang").count().collect()}
        few = [lang for lang, n in sizes.items() if got.get(lang, 0) < min(n, per_language)]
        if not few:
            break
        below |= {lang: min(1 << 60, max(1, 2 * below[lang])) for lang in few}
    sample = texts.where(F.col("place") <= bound).select("lang", "place", "h")
    sample = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))).where(F.col("k") <= per_language)
    sample = tables.put("sample", sample.select(F.col("lang").alias("__l"), "h"))  # per_language rows a language at most
    low = lettered.where(F.col("lang").isin(list(sizes))).where(place <= bound)
    picked = low.select("lang", "text", place).join(F.broadcast(sample), (F.xxhash64("text") == F.col("h")) & (F.col("lang") == F.col("__l"))).dropDuplicates(["lang", "h"])
    fitted = picked.select("lang", "text", "place").groupBy("lang").applyInPandas(_clusters(idf, clusters, rounds, slack), "lang string, center binary, radius binary")
    got = fitted.orderBy("lang", "center").collect()
    tables.clear("texts", "sample")
    radius = np.stack([np.frombuffer(r["radius"], np.float32) for r in got])
    least = np.nanmin(np.vstack([radius, np.where(np.isnan(radius).all(axis=0), 0, np.inf)[None]]), axis=0)
    radius = np.where(np.isnan(radius), least, radius).astype(np.float32)
    return Model([r["lang"] for r in got], np.stack([np.frombuffer(r["center"], np.float32) for r in got]), radius, idf)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``__ff_lang``: lang_pred, score (cosine, 0 to 1) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("__ff_lang", judge(F.col("text").cast("string")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected; prediction reads only the text.

    Defined cases: a text that is null or has no letter, and any text when no language was learned, is
    ``und`` with score 0 and rejected.  Other columns and repeated rows pass unchanged, but for columns of
    these three names, which are replaced.  No shuffle."""
    kept = named(docs.drop("lang_pred", "score", "rejected"))
    return judged(docs, model).select(*kept, "__ff_lang.lang_pred", "__ff_lang.score", "__ff_lang.rejected")


def held_out() -> Column:
    """A fifth of all rows by doc_id: the CRC-32 of its decimal text, modulo 5, is 0 (null: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
