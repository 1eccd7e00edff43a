"""Arrivals in their order, against stored records and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, normalize_title
from .dedup import fuzzy_match, title_pairs, version_fold
from .ordered import HOT_ROWS, last_before
from .state import Scratch

#: What a record is compared by and named by once it is there.
_FACTS = ["target", "doi_key", "id_key", "modified", "sha", "work"]


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _comparable(df: DataFrame, *more: str | Column) -> DataFrame:
    """Records reduced to what decides a verdict."""
    return df.select(
        F.col("resource_id").alias("target"), *more, F.when(_filled("doi"), F.concat(F.lit("doi:"), "doi")).alias("doi_key"),
        F.when(_filled("official_identifier"), F.concat(F.lit("id:"), "source_id", F.lit("\x1f"), "official_identifier")).alias("id_key"), F.col("source_modified_date").alias("modified"),
        F.when(_filled("file_sha256"), F.col("file_sha256")).alias("sha"), F.when(_filled("work_id"), F.col("work_id")).alias("work"),
        normalize_title(first_filled(F.col("title_original"), F.col("title_ko"))).alias("title"), F.year("publication_date").alias("year"), F.lower(F.coalesce(F.get("authors", 0), F.lit(""))).alias("author"),
    )


def _supposed(mine: DataFrame, heads: DataFrame, hot: int) -> DataFrame:
    """(row, hit) if every arrival were looked for by the first of its keys alone: the fold of a key's dates in one
    pass.  Rows without keys are accepted."""
    key, stored = F.coalesce("doi_key", "id_key"), -(2**62)
    rows = mine.select("row", key.alias("k"), "modified").where("k is not null")
    folded = version_fold(rows.union(heads.select(F.lit(stored).alias("row"), "k", "fact.modified")), "k", "modified", "row", hot)
    again = folded.where((F.col("verdict") == "DUPLICATE") & (F.col("row") != stored)).select("row", "k", "base")
    old, new = heads.select("k", F.col("fact.target").alias("__old")), mine.select(F.col("row").alias("base"), F.col("target").alias("__new"))
    again = again.join(old, "k", "left").join(new, "base", "left").select("row", F.coalesce("__new", "__old").alias("__hit"))
    return mine.select("row", "target").join(again, "row", "left").select("row", F.coalesce("__hit", "target").alias("hit"))


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("row", "hit").cast("decimal(20,0)"))).first())


def fold_arrivals(arrivals: DataFrame, stored: DataFrame, scratch: Scratch, hot: int = HOT_ROWS, fuzzy: bool = True) -> DataFrame:
    """(resource_id, verdict, match_id, matched_by, version_of, work_id) of every arrival, as a loop would give
    it that takes them by ``seq`` and stores what isn't a duplicate before it takes the next.

    A record is looked for by DOI, else by source and identifier, else by title, year and author
    (``fuzzy_match``), among stored records and accepted arrivals before it; of several the one seen last, by
    title the one that was there first.  A duplicate counts as a sight of what it repeats.  A match is a
    NEW_VERSION if it was modified later or has another file, else a DUPLICATE.

    What a row finds depends on verdicts of rows before it, so verdicts are taken in rounds: the first goes by what
    holds if each row is looked for by one key alone (``_supposed``), each later one by what the round before said.
    A round settles all rows whose finds were settled, so rounds end when nothing changes, and what stays as it is
    has one solution, wherever rounds begin: after as many as the longest chain of verdicts that hang on each other
    over more than one key or title.  A round shuffles narrow rows by key; only keys of arrivals are read from
    ``stored``.

    Both are resources with seq (stored ones: smaller for records stored earlier), resource_id, source_id, doi,
    official_identifier, title_original, title_ko, authors, publication_date, source_modified_date,
    file_sha256, work_id; ``stored`` also last_seen_at.  Null and empty keys never match; arrivals of one
    resource_id are told apart by seq, which is unique; empty tables match nothing."""
    mine = scratch.put(_comparable(arrivals, "seq", F.col("seq").alias("row")))
    total = 4 * mine.count()
    theirs = _comparable(stored, F.col("seq").cast("long").alias("seq"), F.col("last_seen_at").alias("seen"))
    facts, keys = F.struct(*_FACTS), F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.col(k).alias("k")) for i, k in enumerate(("doi_key", "id_key"))])).alias("x")
    asks = scratch.put(mine.select("row", "seq", keys).select("row", "seq", "x.tier", "x.k").where("k is not null"))
    held = theirs.select("seen", "seq", facts.alias("fact"), keys).select("seen", "seq", "fact", "x.k")
    heads = held.join(asks.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.max_by("fact", F.struct("seen", "seq")).alias("fact"))
    known = mine.select(facts.alias("fact"))
    titled = mine.where("title <> ''").select(F.col("row").alias("resource_id"), "target", "title", "year", "author")
    if fuzzy:
        place = F.struct(F.col("seq"), facts.alias("fact"))
        old = theirs.where("title <> ''").select(place.alias("resource_id"), "title", "year", "author")
        old = scratch.put(fuzzy_match(titled, old).select(F.col("in_id").alias("row"), F.col("match_id.fact").alias("old")))
        met = scratch.put(title_pairs(titled, titled))
        known = known.union(old.select("old"))
    heads = scratch.put(heads)
    known = scratch.put(known.union(heads.select("fact")).select(F.col("fact.target").alias("hit"), "fact").groupBy("hit").agg(F.min("fact").alias("fact")))
    state = scratch.put(_supposed(mine, heads, hot))
    mark = _mark(state)
    while True:
        seen = state.join(known, "hit").select(F.col("row").alias("seq"), "fact")
        events = seen.select("seq", F.explode(F.array("fact.doi_key", "fact.id_key")).alias("k"), "fact")
        late = heads.select(F.col("k").alias("__k"), F.col("fact").alias("__old"))
        found = last_before(asks, events, "k", "seq", "fact", hot, total)
        found = found.join(late, found["k"] == late["__k"], "left").select("row", "tier", F.coalesce("fact", "__old").alias("fact")).where("fact is not null")
        found = found.groupBy("row").agg(F.min_by(F.struct("tier", "fact"), "tier").alias("f"))
        found = mine.join(found, "row", "left").select(mine["row"], "target", "seq", "title", "year", "author", "modified", "sha", "work", "f.tier", "f.fact")
        if fuzzy:
            found = scratch.put(found)
            rest = found.where("fact is null and title <> ''").select(F.col("row").alias("resource_id"), "title", "year", "author")
            accepted = titled.join(state, (titled["resource_id"] == state["row"]) & (titled["target"] == state["hit"]), "left_semi")
            accepted = accepted.select(F.struct(F.col("resource_id").alias("row"), "target").alias("resource_id"), "title", "year", "author")
            # The first of all that fit: if it came before the row, it is the one; if not, none did.
            own = fuzzy_match(rest, accepted, met=met).where("match_id.row < in_id").select(F.col("in_id").alias("row"), F.col("match_id.target").alias("hit"))
            own = own.join(known, "hit").select("row", F.col("fact").alias("new"))
            named = rest.select(F.col("resource_id").alias("row")).join(old, "row", "left").join(own, "row", "left").select("row", F.coalesce("old", "new").alias("named"))
            found = found.join(named, "row", "left").withColumns({"tier": F.coalesce("tier", F.when(F.col("named").isNotNull(), 2)), "fact": F.coalesce("fact", "named")}).drop("named")
        later = F.coalesce(F.col("modified") > F.col("fact.modified"), F.lit(False)) | F.coalesce(F.col("sha") != F.col("fact.sha"), F.lit(False))
        found = scratch.put(found.withColumn("verdict", F.when(F.col("fact").isNull(), "NEW").when(later, "NEW_VERSION").otherwise("DUPLICATE")))
        state = found.select("row", F.when(F.col("verdict") == "DUPLICATE", F.col("fact.target")).otherwise(F.col("target")).alias("hit"))
        new = _mark(state)
        if new == mark or not new[0]:
            break
        mark = new
    by = F.get(F.array(*map(F.lit, ("doi", "official_identifier", "title+year"))), F.col("tier"))
    version = F.col("verdict") == "NEW_VERSION"
    return found.select(
        F.col("target").alias("resource_id"), "seq", "verdict", F.col("fact.target").alias("match_id"), by.alias("matched_by"), F.when(version, F.col("fact.target")).otherwise("").alias("version_of"),
        F.coalesce(F.when(version, F.col("fact.work")), F.col("work"), F.lit("")).alias("work_id"),
    )
