"""Document fingerprints: a Merkle tree over sections, paragraphs and their blocks, in native SQL.

A text is cut at empty lines into sections, a section at line ends into paragraphs, a paragraph into
blocks of ``BLOCK`` code points.  A paragraph's digest is the SHA-256 of its text, a section's that of
its paragraphs' digests, the root's that of its sections' digests, each with its level's prefix.  Cutting
loses nothing, so roots are equal exactly if texts are.  A fingerprint is

    root : sections joined by ";", each its paragraphs joined by ",", each 8 hex digits of every block

so two fingerprints tell where texts differ without the texts: down to a block, within paragraphs that
still line up, wherever those moved.
"""

from __future__ import annotations

from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty

BLOCK = 32
_LEAST, _MOST = -(2**63), 2**63 - 1


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _leaf(block: Column) -> Column:
    return F.substring(F.md5(block.cast("binary")), 1, 8)


def sections(text: Column) -> Column:
    return F.split(text, "\n\n", -1)


def merkle_root(text: Column) -> Column:
    """Hex SHA-256 root of a text's tree."""
    paragraph = lambda p: _sha(F.concat(F.lit("p"), p))
    section = lambda s: _sha(F.concat(F.lit("s"), F.array_join(F.transform(F.split(s, "\n", -1), paragraph), "")))
    return _sha(F.concat(F.lit("r"), F.array_join(F.transform(sections(text), section), "")))


def leaves(text: Column) -> Column:
    """The blocks' digests as in a fingerprint."""
    cut = rf"(?s).{{1,{BLOCK}}}"
    paragraph = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(cut), F.lit(0)), _leaf), "")
    return F.array_join(F.transform(sections(text), lambda s: F.array_join(F.transform(F.split(s, "\n", -1), paragraph), ",")), ";")


def fingerprint(text: Column) -> Column:
    return F.concat(merkle_root(text), F.lit(":"), leaves(text))


def _blocks(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.substring(fp, 66, 2**31 - 1), "[,;]+", ""), F.lit(".{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of blocks that two fingerprints have in common (Dice); 1 for equal roots."""
    x, y = _blocks(a), _blocks(b)
    total = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of sections of ``a`` that ``b`` has nowhere, by the digests of their blocks: the walk ends
    at equal roots, and at sections that are there, moved or not.  ``locate_edits`` goes on to paragraphs."""
    of = lambda f: F.split(F.substring(f, 66, 2**31 - 1), ";", -1)
    lacking = lambda x, gone: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.array_contains(gone, F.get(x, i)))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    found = let(of(a), lambda x: let(F.array_except(x, of(b)), lambda gone: F.when(F.size(gone) == 0, F.array().cast("array<int>")).otherwise(lacking(x, gone))))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(found)


def _tree(text: Column) -> Column:
    """(root, sections: array of (digest, paragraphs: array of digests)); the root is that of ``merkle_root``."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    paragraphs = lambda s: F.transform(F.split(s, "\n", -1), lambda p: _sha(F.concat(F.lit("p"), p)))
    section = lambda s: let(paragraphs(s), lambda ps: F.struct(_sha(F.concat(F.lit("s"), F.array_join(ps, ""))).alias("digest"), ps.alias("paragraphs")))
    root = lambda x: _sha(F.concat(F.lit("r"), F.array_join(x["digest"], "")))
    return let(F.transform(sections(text), section), lambda x: F.struct(root(x).alias("root"), x.alias("sections")))


def merkle_trees(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections) for every row of ``docs`` (doc_id, text): all digests of the tree above the
    blocks, to be stored and walked by ``locate_edits``.  Narrow: no shuffle.  A null text counts as empty,
    which is one empty paragraph in one section; null and repeated doc_ids are passed on."""
    return docs.select("doc_id", _tree(text_or_empty()).alias("t")).select("doc_id", "t.root", "t.sections")


def locate_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where two versions of documents differ, from their ``merkle_trees`` alone: (doc_id, side, section,
    paragraph), a row for each paragraph of the old version that the new one lacks (side "old") or the
    other way round ("new"), places from 0.

    The walk goes down level by level: documents with equal roots end there; of the others, sections
    whose digest the other version also has, at whatever place, end there; of the rest, paragraphs.  So
    an inserted or moved section marks no other one.  A document whose versions differ in order or
    repeats alone gives one row with null section and paragraph for each side.

    Defined cases: a doc_id that only one side has differs in all its paragraphs; null is a doc_id; rows
    that share a doc_id are taken together.  Empty tables give no rows.  Each level is an equi-join of
    digests; documents are never gathered, so a text of any length and a hot doc_id are split by digest.
    """

    def lacks(x: DataFrame, y: DataFrame, digest: str) -> DataFrame:
        y = y.select(F.col("doc_id").alias("__id"), F.col(digest).alias("__digest")).distinct()
        return x.join(y, x["doc_id"].eqNullSafe(y["__id"]) & (x[digest] == y["__digest"]), "left_anti")

    # (doc_id, root) of both sides: ids with a root that one side lacks
    roots = [x.select("doc_id", "root") for x in (old, new)]
    changed = lacks(*roots, "root").union(lacks(*reversed(roots), "root")).select(F.col("doc_id").alias("__changed")).distinct()
    down = [x.join(changed, x["doc_id"].eqNullSafe(changed["__changed"]), "left_semi").select("doc_id", F.posexplode("sections").alias("section", "s")) for x in (old, new)]
    down = [x.select("doc_id", "section", "s.digest", "s.paragraphs") for x in down]
    down = [lacks(x, y, "digest").select("doc_id", "section", F.posexplode("paragraphs").alias("paragraph", "digest")) for x, y in (down, reversed(down))]
    found = [lacks(x, y, "digest").select("doc_id", F.lit(side).alias("side"), "section", "paragraph") for x, y, side in ((*down, "old"), (*reversed(down), "new"))]
    found = found[0].union(found[1])
    ids = found.select(F.col("doc_id").alias("__found")).distinct()
    alike = changed.join(ids, changed["__changed"].eqNullSafe(ids["__found"]), "left_anti")
    none = F.lit(None).cast("int")
    return found.union(alike.select(F.col("__changed").alias("doc_id"), F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), none.alias("section"), none.alias("paragraph")))


def _longs(values: list[int | None]) -> Column:
    return F.array(*[F.lit(b) for b in values]).cast("array<bigint>")


def _below(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted ``bounds`` are less than (``key``, ``tie``): by their keys, in blocks of
    about the root of their number and then within one block, so that a row meets some 90 of 2,047
    bounds; and where bounds share the row's key, by their ties."""
    if not bounds:
        return F.lit(0)
    keys = [k for k, _ in bounds]
    step = isqrt(len(keys)) + 1
    less = lambda values, x: F.size(F.filter(values, lambda b: b < x))
    blocks = less(_longs(keys[step - 1 :: step]), key) * step
    below = blocks + less(F.slice(_longs(keys), blocks + 1, F.lit(step)), key)
    hot = {k: [t for x, t in bounds if x == k and t < _MOST] for k in keys}
    hot = {k: ties for k, ties in hot.items() if ties}
    if not hot:
        return below
    ties = F.create_map(*[x for k, t in hot.items() for x in (F.lit(k).cast("long"), _longs(t))])
    return below + F.coalesce(less(ties[key], tie), F.lit(0))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with next_<column> from the next row by descending doc_id; the
    last row is followed by the first.

    No global sort in one task: quantiles of doc_id (at most 2,048 longs to the driver, whatever the
    rows) give ranges; a window orders one range, and each range's first row also goes, marked, to
    the range before it.  Null doc_ids come last; rows that repeat a doc_id are ordered by their
    columns; a doc_id at several quantiles is ordered by a hash of the first column before, and split
    into as many ranges of that hash.  Only rows equal in both stay together.
    """
    n = min(2048, buckets or 2 * shuffle_partitions(docs.sparkSession))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    docs = docs.select("doc_id", *columns, key.alias("__key"))
    q = docs.select(F.percentile_approx("__key", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else None
    bounds = []
    for k, times in sorted(Counter(q or []).items()):
        bounds += [(k, _LEAST + i * (2**64 // times)) for i in range(1, times)] + [(k, _MOST)]
    hot = sorted({k for k, t in bounds if t < _MOST})
    tie = F.when(F.col("__key").isin(hot), F.xxhash64(columns[0])) if hot else F.lit(0)  # texts are hashed for hot doc_ids alone
    docs = docs.withColumn("__tie", F.coalesce(tie, F.lit(0)).cast("long"))
    docs = docs.withColumn("__part", (F.lit(len(bounds)) - _below(bounds, F.col("__key"), F.col("__tie"))).cast("int"))
    greatest = F.struct(F.max("__key"), F.max("__tie")) if not hot else F.max(F.struct("__key", "__tie"))
    first = sorted((r["__part"], *r["k"]) for r in docs.groupBy("__part").agg(greatest.alias("k")).collect())  # a row a range
    if not first:
        return docs.select("doc_id", *columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    heads, before = {p: (k, t) for p, k, t in first}, {p: q for (p, _, _), (q, _, _) in zip(first, [first[-1], *first[:-1]])}
    at = lambda values: F.get(_longs([values.get(p) for p in range(len(bounds) + 1)]), F.col("__part"))
    leads = (at({p: k for p, (k, _) in heads.items()}) == F.col("__key")) & (at({p: t for p, (_, t) in heads.items()}) == F.col("__tie"))
    guest = F.when(leads, at(before).cast("int"))
    places = F.array(F.struct(F.col("__part").alias("part"), F.lit(0).alias("guest")), F.struct(guest.alias("part"), F.lit(1).alias("guest")))
    docs = docs.withColumn("__at", F.explode(F.filter(places, lambda x: x["part"].isNotNull())))
    order = Window.partitionBy("__at.part").orderBy("__at.guest", F.desc("__key"), F.desc("__tie"), *columns)
    docs = docs.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return docs.where("__at.guest = 0").select("doc_id", *columns, *[f"next_{c}" for c in columns])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    changed_sections) for every row of ``docs`` (doc_id, text).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document by descending doc_id.  near_* is the likeness of the fingerprint to the edited
    text's and to the next document's.

    Defined cases: a null text counts as empty; two empty texts are alike (1), an empty and another
    are not (0).  A single row is its own next.  Null doc_ids come last, repeated ones in the order of
    their texts, or where one doc_id has a large part of all rows, of a hash of them.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    docs = with_next(docs.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    n = F.length("text").cast("long")
    part = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - part), F.substring(F.col("next_text"), F.lit(1), part))
    docs = docs.select("doc_id", n.alias("n_chars"), F.col("fp").alias("fingerprint"), edited.alias("edited"), "next_fp")
    docs = docs.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return docs.select(
        "doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        F.array_join(changed_sections(F.col("fingerprint"), F.col("edited_fingerprint")).cast("array<string>"), ",").alias("changed_sections"),
    )
