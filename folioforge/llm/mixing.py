"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Tables, small_enough, text_or_empty

#: A document's place in its source's order is 60 bits of an MD5; the first 12 give its slice.
_SLICES = 4096


def n_words(text: str = "text") -> Column:
    """Number of words (runs without blanks) of a text; 0 for null."""
    plain = F.trim(F.regexp_replace(text_or_empty(text), BLANKS, " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def ranked_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, size) with weight 1, 2 .. ``cycle``, repeating, by code point of the source, null last.

    Ranks come from counts of ranges: a source's first two code points give its range, so a window
    orders one range of names, not all of them.
    """
    part = F.when(F.col("source").isNull(), F.lit("\U0010ffff" * 3)).otherwise(F.substring("source", 1, 2))
    sizes = sizes.withColumn("__part", part)
    ranges = sizes.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ranges = ranges.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("__before")
    return sizes.join(ranges, "__part").withColumn("weight", (rank % cycle + 1).cast("double")).drop("__part", "__before")


def water_fill(sources: DataFrame, total: float, cap: float) -> tuple[DataFrame, int]:
    """Targets for (source, size, weight): total * weight / sum of weights, clamped at cap * size, the
    excess shared by weight among sources not clamped, until none is above its clamp.  Each round is
    one aggregation of two numbers; a clamped source stays clamped, so the rounds end."""
    limit = F.col("size") * F.lit(float(cap))
    level, rounds, clamped = 0.0, 0, -1
    while True:
        hit = F.lit(False) if rounds == 0 else F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.sum(F.when(hit, limit).otherwise(0.0)).alias("used"), F.sum(F.when(hit, 0.0).otherwise(F.col("weight"))).alias("w"), F.count(F.when(hit, 1)).alias("n")
        ).first()
        rounds += 1
        if row["n"] == clamped or not row["w"]:
            if not row["w"] and rounds > 1:
                level = float("inf")
            break
        clamped, level = row["n"], max(level, (total - row["used"]) / row["w"])
    target = limit if level == float("inf") else F.least(limit, F.col("weight") * F.lit(level))
    return sources.withColumn("target", target), rounds


def fill_up(open_: DataFrame, tables: Tables) -> DataFrame:
    """(__s, order, copy) of the documents of ``open_`` (__s, order, copy, size, short) that fit into what a source is
    short of, taken in the order of the hash until no document of a source fits.

    A pass takes documents up to half of what is missing, or where none is so small, up to all of it, until
    the next would be too much; so two passes at least halve what is missing, or leave nothing that fits.
    """
    taken = None
    while True:
        open_ = tables.put("open", open_.where("size <= short"))
        if not open_.limit(1).count():
            return taken if taken is not None else open_.select("__s", "order", "copy")
        low = F.col("size") <= F.col("short") / 2
        slices = open_.groupBy("__s", F.shiftright("order", 48).cast("int").alias("slice")).agg(F.first("short").alias("short"), F.sum(F.when(low, F.col("size")).otherwise(0)).alias("low"), F.sum("size").alias("words"))
        slices = slices.withColumn("halved", F.max("low").over(Window.partitionBy("__s")) > 0).withColumn("words", F.when(F.col("halved"), F.col("low")).otherwise(F.col("words")))
        before = F.sum("words").over(Window.partitionBy("__s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        slices = slices.withColumn("missing", F.col("short") - F.coalesce(before, F.lit(0))).where("missing > 0")
        slices = slices.select(F.col("__s").alias("__slice_s"), F.col("slice").alias("__slice"), "halved", "missing")
        rows = open_.join(slices, F.col("__s").eqNullSafe(F.col("__slice_s")) & (F.shiftright("order", 48).cast("int") == F.col("__slice"))).where(~F.col("halved") | low)
        sums = F.sum("size").over(Window.partitionBy("__s", "__slice").orderBy("order", "copy"))
        now = tables.put("now", rows.withColumn("sums", sums).where("sums <= missing").select("__s", "order", "copy", "size"))
        taken = now.select("__s", "order", "copy") if taken is None else taken.union(now.select("__s", "order", "copy"))
        got = now.groupBy(F.col("__s").alias("__got_s")).agg(F.sum("size").alias("got"))
        keys = now.select(F.col("__s").alias("__now_s"), F.col("order").alias("__now"), F.col("copy").alias("__now_copy"))
        rest = open_.join(keys, F.col("__s").eqNullSafe(F.col("__now_s")) & (F.col("order") == F.col("__now")) & (F.col("copy") == F.col("__now_copy")), "left_anti")
        rest = rest.join(got, F.col("__s").eqNullSafe(F.col("__got_s")), "left").withColumn("short", F.col("short") - F.coalesce("got", F.lit(0)))
        open_ = rest.select("__s", "order", "copy", "size", "short")


def mix_sources(docs: DataFrame, cap: float = 3.0, seed: int = 17, cycle: int = 3, weights: DataFrame | None = None, fill: bool = True, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats, __row, __copy) for every row of ``docs``: how
    often the mix takes each document.

    size counts a document's words.  Sources share all sizes by weight (``weights``: source, weight;
    else 1, 2, 3 by code point), none above ``cap`` times its own size.  Each document is taken
    floor(target / source_size) times, and in the order of a seeded hash documents are taken once
    more while the source stays within its target, those that are too long for what is missing left
    out, until none fits; what is then missing is filled by the one other document whose size is
    nearest to it, if that brings the source nearer to its target.  So taken misses target by at most
    half of the smallest document that isn't taken once more.  Without ``fill``, the first document
    that is too long ends the order.

    Defined cases: a null or empty text has size 0 and adds nothing; a null source is one source,
    ranked last; sources without words have target 0.  Rows that repeat a doc_id are rows of their
    own, told apart by their texts; rows equal in both share __row, are numbered by __copy from 1 and
    taken one after another, so some of them may be taken once more than others.  A document longer
    than its source misses is left out, however long.  An empty table gives no rows; other columns are
    ignored.

    Plan: texts are read once and never shuffled; the order within a source is cut into ``_SLICES``
    hash ranges, so running sums are taken over slice totals and over the documents of one slice, and
    a source with a third of all rows is spread over all tasks.  The table of slices is broadcast up to
    ``broadcast_rows`` (counted first) and joined by a shuffle beyond.
    """
    tables = Tables(docs.sparkSession, "mix")
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    rows = tables.put("rows", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), key.alias("order")))
    rows = rows.withColumn("slice", F.shiftright("order", 48).cast("int"))
    slices = tables.put("slices", rows.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    sizes = slices.groupBy("source").agg(F.sum("words").alias("size"))
    if weights is None:
        weighted = ranked_weights(sizes, cycle)
    else:
        w = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double"))
        weighted = sizes.join(w, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighted = tables.put("weighted", weighted)
    total = weighted.agg(F.sum("size")).first()[0] or 0
    targets, _ = water_fill(weighted, float(total), cap)
    targets = tables.put("targets", targets.select(F.col("source").alias("__s"), F.col("size").alias("source_size"), "target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    by_slice = slices.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("whole", whole)
    by_slice = by_slice.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("missing", F.col("missing") - F.coalesce(F.sum("words").over(w), F.lit(0)))
    by_slice = tables.put("by_slice", by_slice.select(F.col("source").alias("__s"), F.col("slice").alias("__slice"), "source_size", "target", "whole", "missing"))
    side = F.broadcast(by_slice) if small_enough(by_slice, broadcast_rows) else by_slice.hint("merge")
    out = rows.join(side, F.col("source").eqNullSafe(F.col("__s")) & (F.col("slice") == F.col("__slice")))
    order = Window.partitionBy("__s", "__slice").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("missing") - F.coalesce(F.sum("size").over(order), F.lit(0))
    extra = F.when((F.col("size") > 0) & (left >= F.col("size")), 1).otherwise(0)
    copy = F.row_number().over(Window.partitionBy("__s", "__slice", "order").orderBy(F.desc("extra")))
    out = out.withColumn("extra", extra).withColumn("copy", copy)
    out = tables.put("first", out.select("doc_id", "size", "__s", "source_size", "target", "whole", "order", "copy", "extra"))
    keys = ["__s", "order", "copy"]

    def open_rows(out: DataFrame) -> DataFrame:
        """Documents that may be taken once more, with what their source is short of."""
        short = out.groupBy("__s").agg((F.first("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("size"))).alias("short")).where("short > 0")
        short = short.withColumnRenamed("__s", "__short_s")
        return out.where(f"extra = 0 and size > 0 and whole + 1 <= {cap}").join(short, F.col("__s").eqNullSafe(F.col("__short_s"))).select(*keys, "size", "short")

    def same(side: DataFrame, mark: str):
        return out["__s"].eqNullSafe(side[f"__{mark}_s"]) & (out["order"] == side[f"__{mark}"]) & (out["copy"] == side[f"__{mark}_copy"])

    if fill:
        more = fill_up(open_rows(out), tables)
        more = tables.put("more", more.select(F.col("__s").alias("__more_s"), F.col("order").alias("__more"), F.col("copy").alias("__more_copy")))
        tables.clear("open", "now")
        out = out.join(more, same(more, "more"), "left").withColumn("extra", F.when(F.col("__more").isNotNull(), 1).otherwise(F.col("extra")))
        out = tables.put("filled", out.drop(*more.columns))
        tables.clear("first", "more")
    last = open_rows(out).where("size < 2 * short").groupBy("__s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("short")).alias("miss"), "order", "copy")).alias("last"))
    last = tables.put("last", last.select(F.col("__s").alias("__last_s"), F.col("last.order").alias("__last"), F.col("last.copy").alias("__last_copy")))
    out = out.join(last, same(last, "last"), "left")
    repeats = (F.col("whole") + F.col("extra") + F.col("__last").isNotNull().cast("long")).alias("repeats")
    out = out.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats, F.col("order").alias("__row"), F.col("copy").alias("__copy"))
    tables.clear("rows", "slices", "weighted", "targets", "by_slice")
    return out
