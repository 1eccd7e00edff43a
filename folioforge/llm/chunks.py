"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The gear hash of a position is the sum of a mixed value of each of the last 16 code points, each
shifted by its distance (modulo 2**16), so it depends on those 16 alone; it is computed for a whole
text by four doubling steps.  Where it falls under a bound, a chunk ends at the next word's start, or
where none follows within 32 code points (text without blanks), right there; a chunk never exceeds 255
code points, and one that would is cut where the hash is least.  Cuts depend only on nearby text, so an
insertion moves chunks but changes none beyond its neighbours.

Chunks are short, and what is deduplicated by digest is, from each chunk on, the shortest run of chunks that
is as long as a passage has to be.  So a passage is found wherever it holds one such run, and what is found
stands as a whole at its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, gives_back, named, pieces, small_enough, text_tag

LONGEST = 255
#: How far after a hit of the hash a word's start is looked for.
_NEAR = 32
#: Hits so close to the one before make no cut of their own where there is no word start.
_APART = 8
_LAST = 2**63 - 1
_BLANK = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)


def cut_points(chars: np.ndarray, mean: int = 28) -> np.ndarray:
    """Chunk borders of a text given as code points, 0 and its length included."""
    n = len(chars)
    if not n:
        return np.zeros(1, dtype=np.int64)
    h = ((chars * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    blank = (chars <= 0x20) & ((chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D)))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    hits = np.flatnonzero(h < np.uint16(min(0xFFFF, 0x10000 // max(1, mean - 4))))
    at = np.searchsorted(starts, hits, side="right")
    after = np.append(starts, n + _NEAR + 1)[at]
    near = after - hits <= _NEAR
    first = np.diff(hits, prepend=-_APART - 1) > _APART  # of a run of one code point that hits, not each
    cuts = np.unique(np.concatenate(([0], after[near], hits[~near & first] + 1, [n])))
    wide = np.flatnonzero(np.diff(cuts) > LONGEST)
    if len(wide):
        more = []
        for k in wide:
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            while hi - lo > LONGEST:
                a, b = np.searchsorted(starts, (lo + LONGEST // 4, lo + LONGEST), side="right")
                may = starts[a:b] if b > a else np.arange(lo + LONGEST // 4 + 1, lo + LONGEST + 1)
                lo = int(may[h[may - 1].argmin()])
                more.append(lo)
        cuts = np.unique(np.concatenate((cuts, more)))
    return cuts


def run_ends(cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest run of chunks with ``least`` code points, from each chunk that has so many left."""
    at = np.searchsorted(cuts, cuts[:-1] + least)
    there = at < len(cuts)
    return cuts[:-1][there], cuts[at[there]]


def _run_rows(mean: int, least: int):
    """Of rows (doc, tag, text): d1, d2: a run's 128-bit digest; place: its start and length (12 bits)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, 2):
            digests, numbers, places = [], [], []
            for text in whole.column(2).to_pylist():
                raw = text.encode("utf-32-le")
                start, end = run_ends(cut_points(np.frombuffer(raw, dtype=np.uint32), mean), least)
                view = memoryview(raw)
                digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip((start * 4).tolist(), (end * 4).tolist())]
                places.append((start << 12) | (end - start))
                numbers.append(len(start))
            two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            doc, tag = (pa.array(np.repeat(whole.column(c).to_numpy(), numbers)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), doc, tag, pa.array(np.concatenate(places).astype(np.int64))], ["d1", "d2", "doc", "tag", "place"])

    return run


def _start(place: str) -> F.Column:
    return F.shiftrightunsigned(F.col(place), 12).cast("int")


def repeated_spans(docs: DataFrame, mean: int = 28, least: int = 90) -> DataFrame:
    """Passages that an earlier document also has: (doc_id, text_tag, span_start, span_end,
    source_doc_id, source_start, n_runs), offsets in code points, one row a passage.

    A run of chunks of ``least`` code points or more (the shortest from its chunk on) is a repeat if another
    document has an equal one (by 128-bit digest) and is the earlier one: a smaller doc_id, or the same and a
    smaller text_tag.  Repeats that touch or overlap, and lie in the document where they occur first as they do
    here, form one span, so that a span is one passage of ``least`` code points or more that stands at source_*.
    Spans of different sources may overlap; one that lies within another is left out.

    Defined cases: null or empty texts have no chunks.  A null doc_id counts as the largest.  Rows that
    share a doc_id, or have none, are documents of their own if their texts differ: text_tag, a 64-bit hash
    of the text, tells them apart.  Rows equal in doc_id and text are one document, which never repeats itself.
    A text may be as long as a string can be; a task holds one at a time, at about 40 bytes a code point.  An
    empty table gives no rows; other columns are ignored.

    Shuffles: runs by digest, once to find each digest's first owner (combined before the shuffle)
    and once for the join with owners; then the repeats, combined first so that copies of a row go no further.
    The owners are a written table, so that both sides of the join are shuffled for it alone and AQE splits
    hot digests.  A document's own spans are the only group that a task gathers.
    """
    if not 0 < least <= 3800:
        raise ValueError("passages of 1 to 3800 code points can be asked for")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    texts = docs.select(own, F.col("text").cast("string").alias("text")).where("length(text) > 0").select("doc", text_tag(), "text")
    runs = texts.mapInArrow(_run_rows(mean, least), "d1 long, d2 long, doc long, tag long, place long")
    first = runs.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tag", "place")).alias("f"), F.max(F.struct("doc", "tag")).alias("last")).where("f.doc <> last.doc or f.tag <> last.tag")
    first = Tables(docs.sparkSession, "owners").put("first", first.select("d1", "d2", F.col("f.doc").alias("src"), F.col("f.tag").alias("src_tag"), F.col("f.place").alias("src_place")))
    again = runs.join(first, ["d1", "d2"]).where("doc <> src or tag <> src_tag").select("doc", "tag", _start("place").alias("s"), F.col("place").bitwiseAND(4095).cast("int").alias("n"), "src", "src_tag", _start("src_place").alias("ss"))
    again = again.dropDuplicates(["doc", "tag", "s"])  # copies of a row
    way = ["doc", "tag", "src", "src_tag", "away"]  # runs that lie in the document as they do in their source
    again = again.withColumn("away", F.col("ss") - F.col("s"))
    by = Window.partitionBy(*way).orderBy("s")
    again = again.withColumn("island", F.sum(F.when(F.col("s") <= F.lag(F.col("s") + F.col("n")).over(by), 0).otherwise(1)).over(by))
    spans = again.groupBy(*way, "island").agg(F.min("s").alias("span_start"), F.max(F.col("s") + F.col("n")).alias("span_end"), F.count(F.lit(1)).alias("n_runs"))
    reached = F.max("span_end").over(Window.partitionBy("doc", "tag").orderBy("span_start", F.desc("span_end"), "src", "src_tag", "away").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("reached", reached).where("reached is null or span_end > reached")
    back = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return spans.select(back("doc").alias("doc_id"), F.col("tag").alias("text_tag"), "span_start", "span_end", back("src").alias("source_doc_id"), (F.col("span_start") + F.col("away")).alias("source_start"), "n_runs")


def without_repeats(docs: DataFrame, mean: int = 28, least: int = 90, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut out of the texts, n_chars (where there is
    such a column) counted anew; rows whose whole text goes stay, with an empty text.  All columns
    and rows are kept in the order of ``docs``' schema."""
    tables = Tables(docs.sparkSession, "chunks")
    spans = repeated_spans(docs, mean, least)
    by = Window.partitionBy("doc_id", "text_tag").orderBy("span_start", "span_end")
    reached = F.max("span_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("part", F.when(F.col("span_start") <= reached, 0).otherwise(1)).withColumn("part", F.sum("part").over(by))
    spans = spans.groupBy("doc_id", "text_tag", "part").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))  # what overlaps goes once
    cuts = spans.groupBy("doc_id", "text_tag").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("__ff_cuts"))
    cuts = tables.put("cuts", cuts.select(F.col("doc_id").alias("__ff_id"), F.col("text_tag").alias("__ff_tag"), "__ff_cuts"))
    side = F.broadcast(cuts) if small_enough(cuts, broadcast_rows) else cuts
    out = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["__ff_id"]) & (F.xxhash64(F.col("text").cast("string")) == side["__ff_tag"]), "left")
    before = F.concat(F.array(F.lit(0)), F.col("__ff_cuts.span_end"))
    after = F.concat(F.col("__ff_cuts.span_start"), F.array(F.length("text")))
    text = F.when(F.col("__ff_cuts").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(before, after, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), ""))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__ff_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*named(docs))
