"""Spelling variant grouping: words one edit apart, found by automata over halves of words.

If two words differ by one edit, one half of the one stands unchanged in the other: its first half at the
start or its second half at the end.  Shards hold the halves of all words in Aho-Corasick automata.  A
shard scans every word that can hold one of its halves, keeps the hits whose offset and lengths fit, and
verifies the distance.  A word's shards follow from its own prefixes and suffixes of the lengths that halves
of words as long, one longer or one shorter have, so each word goes to four shards at most, wherever the
other word is, and none goes to all.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, gives_back, small_enough, text_or_empty

#: A run of letters; Java and Python read it alike.
LETTERS = r"[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Halves a shard has room for, on average.
SHARD = 8_000
#: Words with one and the same half from which that half is split further.
HOT = 20_000
#: Hot halves that are known to every task: no more of them are split.
MOST_HOT = 20_000
#: Words of one half and length up to which they are compared one by one.
FEW = 12


def word_counts(docs: DataFrame, typos: int = 31) -> DataFrame:
    """(word, n): how often each word occurs in all texts.  A run of letters, lower-cased, loses one letter
    where ``typos`` divides the CRC-32 of ``<doc_id>:<run>``: that makes spelling variants of a known rate."""
    run = F.explode(F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    runs = runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % typos == 0, less).otherwise(F.col("run")).alias("word"))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _own(before: Column, rest: Column) -> Column:
    """A word's two halves, each after a sign of its side."""
    n = F.length(rest)
    half = F.floor(n / 2).cast("int")
    return F.array(F.concat(before, F.lit("<"), F.left(rest, half)), F.concat(before, F.lit(">"), F.right(rest, n - half)))


def _probes(before: Column, rest: Column) -> Column:
    """The halves that words of one length more or less or the same can share with this word."""
    n = F.length(rest)
    ends = lambda k: F.greatest(F.floor(k / 2), F.lit(0)).cast("int")
    return F.array(*(F.concat(before, F.lit("<"), F.left(rest, ends(n + k))) for k in (-1, 1)), *(F.concat(before, F.lit(">"), F.right(rest, ends(n + k))) for k in (0, 2)))


def _beyond(key: Column, word: Column) -> Column:
    """What a word has besides the half that ``key`` names."""
    size = F.length(key) - 1
    return F.when(key.startswith("<"), F.substring(word, size + 1, F.length(word))).otherwise(F.left(word, F.length(word) - size))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


class _Bucket:
    """The words of a shard that share a half: (the other half, the word, its n), by the other half's length.
    Many of one length are found by what is left of them without one letter, few are compared one by one."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[str, str, int]]] = defaultdict(list)
        self.without: dict[int, dict] = {}

    def _shortened(self, length: int) -> dict:
        if length not in self.without:
            found = self.without[length] = defaultdict(list)
            for entry in self.by_length[length]:
                for k in range(length):
                    found[k, entry[0][:k] + entry[0][k + 1 :]].append(entry)
        return self.without[length]

    def near(self, rest: str) -> Iterator[tuple[str, str, int]]:
        n = len(rest)
        for length in (n - 1, n, n + 1):
            some = self.by_length.get(length, ())
            if len(some) <= FEW:
                yield from (e for e in some if one_edit(rest, e[0]))
            elif length == n - 1:
                whole = self._whole(length)
                for s in {rest[:k] + rest[k + 1 :] for k in range(n)}:
                    yield from whole.get(s, ())
            elif length == n:
                short = self._shortened(length)
                for k in range(n):
                    yield from (e for e in short.get((k, rest[:k] + rest[k + 1 :]), ()) if e[0] != rest)
            else:
                short = self._shortened(length)
                yield from {e[1]: e for k in range(length) for e in short.get((k, rest), ())}.values()

    def _whole(self, length: int) -> dict:
        if -length not in self.without:
            found = self.without[-length] = defaultdict(list)
            for entry in self.by_length[length]:
                found[entry[0]].append(entry)
        return self.without[-length]


def _halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def _place(of: str, first: bool, other: str, rest: str, hot: frozenset[str], shards: int) -> int:
    """The one shard that reports a pair that shares a half: the half's, or if that half is split, the one of
    the half of what is beyond that both words have; the first if both."""
    key = ("<" if first else ">") + of
    if key in hot:
        a, b = _halves(other)
        key += "<" + a if rest.startswith(a) else ">" + b
    return zlib.crc32(key.encode()) % shards


def _search(shards: int, hot: frozenset[str]):
    """Of rows (shard, word, n) in the order of shard and word: (word, n_near, best_n, best), what a shard
    knows of the word's near words."""

    def of_shard(shard: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
        buckets: dict[tuple[bool, str], _Bucket] = defaultdict(_Bucket)
        for word, n in zip(words, counts):
            for first, (half, other) in ((True, _halves(word)), (False, _halves(word)[::-1])):
                key = ("<" if first else ">") + half
                keys = [key] if key not in hot else [f"{key}<{_halves(other)[0]}", f"{key}>{_halves(other)[1]}"]
                if any(zlib.crc32(k.encode()) % shards == shard for k in keys):
                    buckets[first, half].by_length[len(other)].append((other, word, n))
        automaton = ahocorasick.Automaton()
        for _, half in buckets:
            automaton.add_word(half, half)
        if not len(automaton):
            return
        automaton.make_automaton()
        for word in words:
            near, best, last = 0, (0, ""), len(word) - 1
            for end, half in automaton.iter(word):
                for first, fits in ((True, end + 1 == len(half)), (False, end == last)):
                    if not fits or (bucket := buckets.get((first, half))) is None:
                        continue
                    rest = word[len(half) :] if first else word[: len(word) - len(half)]
                    for other, found, n in bucket.near(rest):
                        if not first and word.startswith(other):
                            continue  # both halves are whole: the first one's shard reports it
                        if _place(half, first, other, rest, hot, shards) == shard:
                            near += 1
                            best = min(best, (-n, found))
            if near:
                yield word, near, -best[0], best[1]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, words: list, counts: list) -> Iterator[pa.RecordBatch]:
            found = list(of_shard(shard, words, counts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

        now, words, counts = None, [], []
        for batch in batches:
            for shard, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if words:
                        yield from out(now, words, counts)
                    now, words, counts = shard, [], []
                if not words or words[-1] != word:  # a word may come to a shard by several halves
                    words.append(word)
                    counts.append(n)
        if words:
            yield from out(now, words, counts)

    return run


def near_words(words: DataFrame, tables: Tables, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, best_n, best) of all rows of ``words`` (a written table of word, n): how many words
    are one edit away, and the one of them with the largest n (ties: the smallest in code-point order).

    A half that more than ``hot`` words share (counted, combined before the shuffle) is split once more by
    the halves of what these words have beyond it.  Pairs are never written: a shard sends a row a word.
    """
    word = F.col("word")
    total = words.count()
    shards = max(1, 4 * total // shard)
    own = words.select(F.explode(_own(F.lit(""), word)).alias("key")).groupBy("key").count()
    split = own.where(F.col("count") > max(hot, total // MOST_HOT)).select("key").limit(2 * MOST_HOT).collect()
    split = frozenset(r["key"] for r in split)
    routes = words.select("word", "n", F.explode(_probes(F.lit(""), word)).alias("key"))
    if split:
        listed = F.broadcast(words.sparkSession.createDataFrame([(k,) for k in sorted(split)], "hot string"))
        routes = routes.join(listed, routes["key"] == listed["hot"], "left")
        finer = _probes(F.col("key"), _beyond(F.col("key"), word))
        routes = routes.select("word", "n", F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(finer)).alias("key"))
    at = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(shards)).cast("int")
    routes = routes.select(at.alias("shard"), "word", "n").repartition("shard").sortWithinPartitions("shard", "word")
    found = tables.put("near", routes.mapInArrow(_search(shards, split), "word string, n_near long, best_n long, best string"))
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = none.union(found.select("word", F.lit(None).cast("long"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best"))))
    both = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return both.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of a table of (word, form): the last word that forms lead to, by pointer doubling.  A form
    occurs more often than its word, so forms never lead round."""
    now = tables.put("roots", forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("__word"), F.col("root").alias("__next"))
        step = tables.put("roots", now.join(up, now["root"] == up["__word"], "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        more = not step.where("moved").isEmpty()
        now = step.drop("moved")
        if not more:
            return now


def spelling_variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, times: int = 10, typos: int = 31) -> DataFrame:
    """Words of all texts and what they are variants of: (word, form, root, n, n_near, form_n).

    Words have at least ``least_chars`` letters and ``least_n`` occurrences.  n_near counts the words one edit
    away; form is the one of them with the largest n, if that is at least ``times`` the word's own, else null;
    root is the word that forms lead to, the word itself if it has no form.

    Defined cases: null and empty texts have no words, texts without a doc_id are hashed with an empty one,
    repeated rows count each time, texts may be as long as a string can be, an empty table gives no rows,
    other columns are ignored.

    Shuffles: occurrences (combined first), four rows a word to the shards, a row a word and shard back.  A
    task holds a shard: some ``SHARD`` rows of words, whatever the vocabulary's size.
    """
    if times < 2 or least_chars < 4:
        raise ValueError("forms must occur at least twice as often as their variants, and halves need two letters")
    tables = Tables(docs.sparkSession, "spelling")
    words = tables.put("words", word_counts(docs, typos).where((F.length("word") >= least_chars) & (F.col("n") >= least_n)))
    near = near_words(words, tables)
    fits = F.col("best_n") >= times * F.col("n")
    near = tables.put("forms", near.select("word", F.when(fits, F.col("best")).alias("form"), "n", "n_near", F.when(fits, F.col("best_n")).alias("form_n")))
    last = roots(near.where("form is not null"), tables)
    last = last.select(F.col("word").alias("__word"), "root")
    if small_enough(last, 200_000):
        last = F.broadcast(last)
    out = near.join(last, near["word"] == last["__word"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
