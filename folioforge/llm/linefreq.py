"""Quality rules: cross-document line frequency, beside counts of one text.  Native SQL.

Lines are normalised (lower case, blanks squeezed) and hashed; the documents of a host that have a
line are counted, each document once.  Lines above the host's limit are boilerplate: they are removed,
and a document that keeps too little is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Tables, small_enough, text_or_empty


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, within one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def repeated_window_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    A window is its 64-bit hash with the lowest bits replaced by its place (as few as the text's length
    needs); sorting brings equal windows together without a shuffle, and neighbours of one hash are compared
    word by word.  Marked places, sorted, cover min(3, distance to the next) words each.
    """

    def count(w):
        bits = F.length(F.bin(F.size(w)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def of(m):
            windows = F.transform(
                F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))
            )
            same = lambda a, b: a.bitwiseXOR(b) <= m
            word = lambda a, i: F.get(w, (a.bitwiseAND(m) + i).cast("int"))
            alike = lambda a, b: (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))
            unsigned = lambda a, b: (a.bitwiseXOR(b) >= 0) & same(a, b) & alike(a, b)
            marked = lambda s: F.filter(s, lambda x, k: F.coalesce(unsigned(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(unsigned(x, F.get(s, k + 1)), F.lit(False)))
            places = _let(F.sort_array(windows), lambda s: F.sort_array(F.transform(marked(s), lambda x: x.bitwiseAND(m))))
            return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b))

        return _let(mask, of)

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(count(w)))


def text_counts(text: Column) -> dict[str, Column]:
    """Counts of one text, each an expression over it: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words."""
    plain = _normal(text)
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_window_words(words),
    }


def line_frequency_rules(
    docs: DataFrame, limit: int = 50, share: float = 0.002, least_words: int = 50, least_part: float = 0.3, broadcast_lines: int = 200_000
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_lines, n_removed_words) for every row of ``docs`` (doc_id, text, source).

    source stands for the host.  A line is removed if more than max(limit, share * documents of the
    host) documents of its host have it; rows equal in doc_id and text are one document.  base_failed: n_words < 50 or 100 * n_repeat_words > 50 *
    n_words.  kept: not base_failed, and at least ``least_words`` words and ``least_part`` of all words
    remain.

    Defined cases: a null or empty text has no lines and fails by its words.  A null source is a host of
    its own.  Rows with one doc_id and other texts, or without a doc_id, are documents of their own (a 64-bit
    hash of the text tells them apart); equal rows count once and get equal results.  An empty table gives no rows; other columns are ignored.

    Plan: texts are never shuffled.  Of copies (counted by doc_id, hash and host, combined before the shuffle)
    hashes of lines are, to keep one of each; where there are none that step is left out.  Lines go through a
    shuffle once, combined by (host, hash) before it.  Boilerplate lines are broadcast up to ``broadcast_lines`` (counted first); more are joined by
    (host, hash), where AQE splits a line that a third of all rows have.
    """
    tables = Tables(docs.sparkSession, "lines")
    docs = docs.select("doc_id", text_or_empty().alias("text"), F.col("source").cast("string").alias("source"))
    key = F.xxhash64("text").alias("tag")
    line = F.transform(
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: _let(_normal(x), lambda y: F.struct(F.xxhash64(F.lower(y)).alias("h"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n"))),
    )
    document = ["doc_id", "tag", "source"]
    copies = tables.put("copies", docs.groupBy("doc_id", key, "source").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    copies = copies.select(*[F.col(c).alias(f"c_{c}") for c in document], "rows")
    copied = F.broadcast(copies) if small_enough(copies, broadcast_lines) else copies
    same = lambda df, side, mark: df["doc_id"].eqNullSafe(side[f"{mark}_doc_id"]) & (df["tag"] == side[f"{mark}_tag"]) & df["source"].eqNullSafe(side[f"{mark}_source"])

    own = docs.select("doc_id", key, "source", F.array_distinct(F.transform(line, lambda x: x["h"])).alias("hs"))
    double = copies.agg(F.sum("rows")).first()[0]
    if double:  # of copies one row counts
        one = own.join(copied, same(own, copied, "c")).groupBy(*document).agg(F.first("hs").alias("hs"))
        own = own.join(copied, same(own, copied, "c"), "left_anti").unionByName(one)
    own = own.select("source", F.explode("hs").alias("h"))
    hosts = docs.select("source", F.lit(1).alias("n")).unionByName(copies.select(F.col("c_source").alias("source"), (1 - F.col("rows")).cast("int").alias("n")))
    hosts = hosts.groupBy("source").agg(F.sum("n").alias("docs")).select(F.col("source").alias("host"), F.greatest(F.lit(limit), F.col("docs") * share).alias("most"))
    often = own.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    often = tables.put("often", often.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where("n > most").select("host", "h"))
    side = F.broadcast(often) if small_enough(often, broadcast_lines) else often
    lines = docs.select("doc_id", key, "source", F.explode(line).alias("x")).select(*document, F.col("x.h").alias("lh"), F.col("x.n").alias("words"))
    hit = lines.join(side, F.col("source").eqNullSafe(side["host"]) & (F.col("lh") == side["h"]))
    gone = hit.groupBy(*document).agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words")).select(*[F.col(c).alias(f"g_{c}") for c in document], "lines", "words")
    out = docs.select("doc_id", key, "source", *[c.alias(n) for n, c in text_counts(F.col("text")).items()])
    out = out.join(gone, same(out, gone, "g"), "left")
    rows = F.lit(1)
    if double:
        out = out.join(copied, same(out, copied, "c"), "left")
        rows = F.coalesce("rows", F.lit(1))
    removed = F.floor(F.coalesce("words", F.lit(0)) / rows).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = F.col("n_words") - removed
    kept = ~failed & (rest >= least_words) & (rest >= F.col("n_words") * least_part)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.floor(F.coalesce("lines", F.lit(0)) / rows).cast("long").alias("n_removed_lines"), removed.alias("n_removed_words"))
