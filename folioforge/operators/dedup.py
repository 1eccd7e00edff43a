"""Duplicates and versions: keyed lookups, the sequential fold as windows, blocked fuzzy titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, jaccard, normalize_title, title_tokens
from .ordered import HOT_ROWS, handed_on, sliced, slices_before
from .state import Scratch
from .store import source_map

FUZZY = 0.85


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The row of each non-empty key seen last; equal times by the smallest ``tie``."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    w = Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def version_fold(df: DataFrame, key: str, modified: str, order: str, hot: int = HOT_ROWS) -> DataFrame:
    """verdict of each row of a key in arrival order: the first is NEW; a later one is NEW_VERSION if it
    was modified after all before it and the first has a date, else DUPLICATE.  base is the row that it
    is compared with: the last accepted one.

    One shuffle by key for keys of up to ``hot`` rows; larger ones are spread over slices of their order,
    and a slice starts with what the earlier slices of its key hand over (a row a key and slice)."""
    df, hot_keys = sliced(df, key, order, hot)
    w = Window.partitionBy(key, "__at").orderBy(order)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    most, head, first = F.max(modified).over(prior), F.first(modified).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w) == 1
    if hot_keys:
        before = slices_before(key)
        facts = {"__max": F.max(modified), "__head": F.min_by(F.struct(F.col(modified).alias("m")), order)}
        df = handed_on(df, key, facts, {"__most": F.max("__max").over(before), "__start": F.first("__head").over(before)})
        most, first = F.greatest(F.col("__most"), most), F.col("__start").isNull() & first
        head = F.when(F.col("__start").isNull(), head).otherwise(F.col("__start.m"))
    df = df.withColumns({"__top": most, "__first": head, "__is": first})
    df = df.withColumn("verdict", F.when(F.col("__is"), "NEW").when(F.col("__first").isNotNull() & (F.col(modified) > F.col("__top")), "NEW_VERSION").otherwise("DUPLICATE"))
    accepted = F.when(F.col("verdict") != "DUPLICATE", F.col(order))
    base = F.max(accepted).over(prior)
    if hot_keys:
        df = handed_on(df, key, {"__last": F.max(accepted)}, {"__base": F.max("__last").over(slices_before(key))})
        base = F.coalesce(base, F.col("__base"))
    return df.withColumn("base", base).drop("__at", "__most", "__start", "__top", "__first", "__is", "__base")


#: Rows of a title that stand in one portion: pairs are made portion by portion.
PORTION = 256


def _near_titles(rows: DataFrame, block: int, threshold: float, put) -> tuple[DataFrame, DataFrame]:
    """Different titles of ``rows`` (i, title) with their least row, number of rows and tokens (title, rep, n, w), and
    what is near among them: (left_id < right_id, similarity) of least rows.

    Titles of a block meet on their tokens that are rarest in it: two sets of that similarity share one of their
    first n - ceil(threshold * n) + 1.  Of the first that they share, the sizes and the places say how much they can
    share at most; what could be enough is confirmed on all tokens, which travel only then."""
    least = put(rows.groupBy("title").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("w", title_tokens(F.col("title"))).where(F.size("w") > 0))
    each = least.select("rep", F.left("title", F.lit(block)).alias("b"), F.size("w").alias("size"), F.explode("w").alias("t"))
    # Tokens that no other title of the block has come first in the order, and nothing meets on them.
    ranked = each.join(each.groupBy("b", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["b", "t"])
    ranked = ranked.groupBy("rep", "b", "size").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("o")).withColumn("alone", F.col("size") - F.size("o"))
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int") + 1 - F.col("alone")
    keyed = ranked.where(keep > 0).select("rep", "b", "size", "alone", F.posexplode(F.slice("o", F.lit(1), keep)).alias("at", "x"))
    keyed = put(keyed.select("rep", "b", "size", (F.col("size") - F.col("at") - F.col("alone")).alias("rest"), F.col("x.t").alias("t")))
    x, y = keyed.alias("x"), keyed.alias("y")
    enough = F.least("x.rest", "y.rest") >= F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-9)
    met = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.rep") < F.col("y.rep")) & enough).select(F.col("x.rep").alias("left_id"), F.col("y.rep").alias("right_id")).distinct()
    near = met.join(least.select(F.col("rep").alias("left_id"), F.col("w").alias("a")), "left_id").join(least.select(F.col("rep").alias("right_id"), F.col("w").alias("b")), "right_id")
    near = near.select("left_id", "right_id", jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)
    return least, near


def fuzzy_pairs(df: DataFrame, identity: str, title: str, block: int = 12, threshold: float = FUZZY, author: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """All pairs (left_id < right_id, similarity) of normalised titles that share their first ``block``
    characters and have a token Jaccard of ``threshold`` or more.  ``author``: where both are filled,
    they must agree.

    Titles are compared once, however many rows hold them.  The pairs of their rows, as many as the square of a
    title's rows, are made from pairs of portions of ``PORTION`` rows, which are dealt over all tasks: a task holds
    two portions at a time, whatever the size of a title."""
    put = (scratch or Scratch(df.sparkSession)).put
    one = F.struct(F.col(identity).alias("i"), F.col(author).alias("a")) if author else F.struct(F.col(identity).alias("i"))
    rows = put(df.select(F.col(identity).alias("i"), F.col(title).alias("title"), one.alias("x")).where("title <> ''"))
    least, near = _near_titles(rows, block, threshold, put)
    least = least.select("title", "rep", "n", F.ceil(F.col("n") / PORTION).cast("int").alias("k"))
    held = rows.join(least, "title").select("rep", "x", F.pmod(F.xxhash64("i"), "k").cast("int").alias("p"))
    held = put(held.groupBy("rep", "p").agg(F.collect_list("x").alias("xs")))
    counts = least.select("rep", "k")
    met = near.join(counts.toDF("left_id", "lk"), "left_id").join(counts.toDF("right_id", "rk"), "right_id")
    met = met.select("left_id", "right_id", "similarity", "lk", "rk").union(least.where("n > 1").select("rep", "rep", F.lit(1.0), "k", "k"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("lk") - 1)).alias("lp")).select("*", F.explode(F.sequence(F.lit(0), F.col("rk") - 1)).alias("rp")).where("left_id <> right_id or lp <= rp")
    both = met.join(held.toDF("left_id", "lp", "ls"), ["left_id", "lp"]).join(held.toDF("right_id", "rp", "rs"), ["right_id", "rp"])
    dealt = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left_id", "lp", "right_id", "rp")  # a number, so few bytes that become many rows are not put together
    itself = (F.col("left_id") == F.col("right_id")) & (F.col("lp") == F.col("rp"))
    pairs = dealt.select(itself.alias("itself"), "similarity", "rs", F.explode("ls").alias("l")).select("itself", "similarity", "l", F.explode("rs").alias("r")).where("l.i <> r.i and (not itself or l.i < r.i)")
    pairs = pairs.where("l.a = '' or r.a = '' or lower(l.a) = lower(r.a)") if author else pairs
    return pairs.select(F.least("l.i", "r.i").alias("left_id"), F.greatest("l.i", "r.i").alias("right_id"), "similarity")


def fuzzy_links(df: DataFrame, identity: str, title: str, block: int = 12, threshold: float = FUZZY, scratch: Scratch | None = None) -> DataFrame:
    """Links (left_id < right_id, similarity) of normalised titles that share their first ``block`` characters and
    have a token Jaccard of ``threshold`` or more: between the least rows of different titles, and of each
    further row of a title (1.0) to its least.  So a title that many rows hold costs a row each."""
    put = (scratch or Scratch(df.sparkSession)).put
    rows = put(df.select(F.col(identity).alias("i"), F.col(title).alias("title")).where("title <> ''"))
    least, near = _near_titles(rows, block, threshold, put)
    same = rows.join(least.select("title", "rep"), "title").where("i <> rep").select(F.col("rep").alias("left_id"), F.col("i").alias("right_id"), F.lit(1.0).alias("similarity"))
    return near.union(same)


def tiered_match(incoming: DataFrame, stored: DataFrame, tiers: list[tuple[str, list[str]]], identity: str = "resource_id", seen: str = "last_seen_at", itself: bool = False) -> DataFrame:
    """``incoming`` with match_id and matched_by from the first tier (name, key columns) whose keys, all
    filled, are stored; a row never matches itself, unless ``itself``.  Later tiers only join what is still unmatched by
    a coalesce, one left join to one row a key each."""
    out = incoming.withColumns({"match_id": F.lit(None).cast("string"), "matched_by": F.lit(None).cast("string")})
    for name, keys in tiers:
        side = latest_per_key(stored, keys, seen, identity).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(identity).alias("__id"))
        on: Column = F.col("match_id").isNull()
        if not itself:
            on = on & (F.col("__id") != F.col(identity))
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        out = out.join(side, on, "left").withColumns({"matched_by": F.coalesce("matched_by", F.when(F.col("__id").isNotNull(), name)), "match_id": F.coalesce("match_id", "__id")})
        out = out.drop("__id", *[f"__{k}" for k in keys])
    return out


METADATA_TIERS = [("doi", ["doi"]), ("official_identifier", ["source_id", "official_identifier"])]
CONTENT_TIERS = [("file_sha256", ["file_sha256"]), ("text_sha256", ["text_sha256"])]


def resolve_arrivals(df: DataFrame, order: str = "seq", modified: str = "source_modified_date") -> DataFrame:
    """Sequential dedup of one batch by DOI, else (source, identifier): verdict and base of each row;
    rows without a key are NEW."""
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), "doi")).when(
        F.coalesce("official_identifier", F.lit("")) != "", F.concat(F.lit("id:"), "source_id", F.lit(":"), "official_identifier")
    )
    df = df.withColumn("__key", F.coalesce(key, F.concat(F.lit("row:"), F.col(order).cast("string"))))
    return version_fold(df, "__key", modified, order).drop("__key")


#: Fixed value: so many characters of an incoming title are looked for in stored ones.
PREFIX = 12


def title_pairs(incoming: DataFrame, stored: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(a, b, similarity) of distinct normalised titles of ``incoming`` and ``stored`` (column title) where b
    contains the first ``PREFIX`` characters of a and their tokens have a Jaccard of ``threshold`` or more.

    No cross join: tokens are ordered from the rarest on; two sets of that similarity share one of their
    first n - ceil(threshold * n) + 1 tokens, so titles meet on those; what meets is confirmed on the whole
    titles."""

    def titles(df: DataFrame) -> DataFrame:
        return df.where("title <> ''").select("title").distinct().withColumn("w", title_tokens(F.col("title")))

    mine, theirs = titles(incoming), titles(stored)
    seen = mine.select(F.explode("w").alias("t")).unionAll(theirs.select(F.explode("w"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def keyed(side: DataFrame, name: str) -> DataFrame:
        ranked = side.select("title", F.size("w").alias("size"), F.explode("w").alias("t")).join(seen, "t")
        ranked = ranked.groupBy("title", "size").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("o"))
        keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int") + 1
        return ranked.select(F.col("title").alias(name), F.explode(F.slice("o", F.lit(1), keep)).alias("x")).select(name, F.col("x.t").alias("t"))

    met = keyed(mine, "a").join(keyed(theirs, "b"), "t").select("a", "b").distinct()
    alike = jaccard(title_tokens(F.col("a")), title_tokens(F.col("b")))
    return met.where(F.contains(F.col("b"), F.left("a", F.lit(PREFIX)))).withColumn("similarity", alike).where(F.col("similarity") >= threshold)


def fuzzy_match(incoming: DataFrame, stored: DataFrame, threshold: float = FUZZY, identity: str = "resource_id", met: DataFrame | None = None) -> DataFrame:
    """(in_id, match_id, similarity): for rows of ``incoming`` with a title the least stored row whose title
    contains the first ``PREFIX`` characters of theirs, whose year is the same or one unknown, whose tokens
    have a Jaccard of ``threshold`` or more, and whose first author, if both have one, is the same.  Both
    are (identity, title, year, author), titles normalised, authors in lower case.  ``met``: their
    ``title_pairs``, if known."""
    met = title_pairs(incoming, stored, threshold) if met is None else met
    # A title's holders are reduced to the least one of each year and author, each year, each author, and of all; an
    # arriving row asks for what fits it: a known year for itself and the unknown one (''), an unknown one for any (*).
    # So a title that many rows hold on both sides costs each of them four keys, not each other.
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = lambda ys, ws: F.explode(F.flatten(F.transform(ys, lambda y: F.transform(ws, lambda w: F.struct(y.alias("y"), w.alias("w"))))))
    asks = lambda c: F.when(said(c) == "", F.array(F.lit("*"))).otherwise(F.array(said(c), F.lit("")))
    holds = lambda c: F.array(said(c), F.lit("*"))
    left = incoming.select(F.col(identity).alias("in_id"), F.col("title").alias("a"), pairs(asks("year"), asks("author")).alias("k")).join(met, "a").select("in_id", "similarity", "b", "k.y", "k.w")
    right = stored.where("title <> ''").select(F.col("title").alias("b"), pairs(holds("year"), holds("author")).alias("k"), F.col(identity).alias("id")).groupBy("b", "k.y", "k.w").agg(F.min("id").alias("match_id"))
    fits = left.join(right, ["b", "y", "w"])
    return fits.groupBy("in_id").agg(F.min("match_id").alias("match_id"), F.min_by("similarity", "match_id").alias("similarity"))


def check_metadata(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` with match_id, matched_by and verdict against stored resources: by DOI, else by source
    and identifier, else by title and year (``fuzzy_match``); the first tier that finds a row decides.
    A match is a NEW_VERSION if it was modified later or has another file, else a DUPLICATE; a new version
    gets version_of and, where the stored row has one, its work_id.

    Both have resource_id, source_id, doi, official_identifier, title_original, title_ko, authors,
    publication_date, source_modified_date, file_sha256, work_id; ``stored`` also last_seen_at.  Rows
    without a match are NEW.  Empty keys never match."""
    out = tiered_match(incoming, stored, METADATA_TIERS, itself=True)
    said = lambda df: df.select("resource_id", normalize_title(first_filled(F.col("title_original"), F.col("title_ko"))).alias("title"), F.year("publication_date").alias("year"), F.lower(F.coalesce(F.get("authors", 0), F.lit(""))).alias("author"))
    rest = fuzzy_match(said(out.where("match_id is null")), said(stored)).select("in_id", F.col("match_id").alias("__fuzzy"))
    out = out.join(rest, out["resource_id"] == rest["in_id"], "left").withColumns({"matched_by": F.coalesce("matched_by", F.when(F.col("__fuzzy").isNotNull(), "title+year")), "match_id": F.coalesce("match_id", "__fuzzy")})
    side = stored.select(F.col("resource_id").alias("__id"), F.col("source_modified_date").alias("__modified"), F.col("file_sha256").alias("__sha"), F.col("work_id").alias("__work"))
    out = out.join(side, F.col("match_id") == F.col("__id"), "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    later = F.coalesce(F.col("source_modified_date") > F.col("__modified"), F.lit(False)) | (filled("file_sha256") & filled("__sha") & (F.col("file_sha256") != F.col("__sha")))
    verdict = F.when(F.col("match_id").isNull(), "NEW").when(later, "NEW_VERSION").otherwise("DUPLICATE")
    out = out.withColumn("verdict", verdict)
    new = F.col("verdict") == "NEW_VERSION"
    return out.withColumns({"version_of": F.when(new, F.col("match_id")).otherwise(""), "work_id": F.when(new & filled("__work"), F.col("__work")).otherwise(F.col("work_id"))}).drop("in_id", "__fuzzy", "__id", "__modified", "__sha", "__work")


def check_content(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` with match_id, matched_by and verdict by the file's hash, else the text's; a row never
    matches itself."""
    return tiered_match(incoming, stored, CONTENT_TIERS).withColumn("verdict", F.when(F.col("match_id").isNull(), "NEW").otherwise("DUPLICATE"))


def merged_sources(matched: DataFrame) -> DataFrame:
    """(resource_id, source_id, url, role) that duplicates bring to the resources that they repeat."""
    return source_map(matched.where("verdict = 'DUPLICATE'").select(F.col("match_id").alias("resource_id"), "source_id", "landing_url", "download_url", "oa_url")).distinct()


def title_classes(df: DataFrame, identity: str, title: str) -> DataFrame:
    """(identity, class_id): rows of equal, non-empty titles are one class, named by its least row."""
    rows = df.where(F.col(title) != "").select(identity, title)
    return rows.join(rows.groupBy(F.col(title).alias("__t")).agg(F.min(identity).alias("class_id")), F.col(title) == F.col("__t")).select(identity, "class_id")
