"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, confirmation on full sets.

1. Every text becomes its set of word shingles (64-bit hashes).  Equal sets form one *class*, so
   exact copies, however many, cost one row from here on.
2. A class gets a signature of ``symbols`` b-bit minima (b = 16).  Two sets of similarity s differ in
   Binomial(symbols, 1 - s) of them.  ``radius`` is the distance that a pair at the threshold itself
   exceeds with a probability below ``miss``; more similar pairs exceed it far more rarely.
3. The signature is cut into ``parts``.  By pigeonhole two signatures within ``radius`` differ in at
   most radius // parts symbols of one part, so enumerating a part's errors (leaving out each choice
   of that many symbols) gives keys of which every such pair shares one: no pair within the radius
   is missed, however large its bucket.
4. Buckets are not expanded into pairs.  Each member is first compared with its bucket's least
   member; pairs within the radius are confirmed on the full sets and joined into components.  Then
   only buckets that still hold different components are searched, and only across components: pairs
   inside one component cannot change the result.  Each pair is confirmed in the first bucket that it
   shares, links found there merge components at once, and only those links come out, so neither rows
   nor confirmed pairs grow with the square of a group that is linked.  Large buckets are cut into
   blocks of bounded size; a task holds two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, gives_back, pieces, small_enough, text_tag
from .components import connected_components
from .shingles import MinHash, shingle_set


def radius_for(symbols: int, percent: int, miss: float = 2e-6) -> int:
    """The least distance that a pair of similarity percent/100 exceeds with probability < miss."""
    p, tail, r = 1 - percent / 100, 1.0, -1
    while tail >= miss and r < symbols:
        r += 1
        tail -= comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
    return r


def part_slots(symbols: int, parts: int, radius: int) -> np.ndarray:
    """One row a key: which symbols it covers, for every part and every choice of ``radius // parts``
    symbols left out of it."""
    edges = np.linspace(0, symbols, parts + 1).astype(int)
    rows = []
    for lo, hi in zip(edges, edges[1:]):
        for gone in combinations(range(lo, hi), min(radius // parts, hi - lo)):
            row = np.zeros(symbols, dtype=bool)
            row[sorted({*range(lo, hi)} - {*gone})] = True
            rows.append(row)
    return np.array(rows)


def part_keys(sig: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """All keys of each signature (rows x symbols): a 64-bit hash of what each slot covers."""
    out = np.empty((len(sig), len(slots)), dtype=np.uint64)
    for k, row in enumerate(slots):
        h = np.full(len(sig), k + 1, dtype=np.uint64)
        for c in np.flatnonzero(row):
            h = (h ^ sig[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = h
    return out


def _features(width: int, symbols: int):
    """Of rows (doc_id, text_tag, text): their set's size, its two hashes and its signature."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(symbols)
        for b in pieces(batches, 2, rows=1000):
            n, cls, mark, sig = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                cls.append(_set_hash(s, 0))
                mark.append(_set_hash(s, 1))
                sig.append(sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(mark, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_tag", "n_shingles", "cls", "mark", "sig"])

    return run


#: Odd factors of the two hashes of a set.
_FACTORS = np.array([[0xD6E8FEB86659FD93, 0xA0761D6478BD642F], [0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]], dtype=np.uint64)


def _set_hash(s: np.ndarray, which: int) -> int | None:
    """One of two 64-bit hashes of a set; None for the empty set."""
    if not len(s):
        return None
    a, b = _FACTORS[which]
    with np.errstate(over="ignore"):
        spread = s * a
        spread ^= spread >> np.uint64(29)
        x = np.bitwise_xor.reduce(spread * b) ^ (np.add.reduce(spread ^ b) * b) ^ np.uint64(len(s))
    return int(x.astype(np.int64))


def set_classes(feats: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(feats, classes): one row of classes for each distinct set, with its least document.  A class is
    named by a 64-bit hash of the set; sets that share it by chance, told apart by a second one (mark),
    get names of their own."""
    own = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("least"), "text_tag")
    found = [F.min(own).alias("f"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high")]
    flat = ["cls", "f.least", F.col("f.text_tag").alias("tag"), "sig", "n", "low", "high"]
    classes = tables.put("classes", feats.where("cls is not null").groupBy("cls").agg(*found).select(flat))
    odd = classes.where("low <> high").select(F.col("cls").alias("odd"))
    if not odd.isEmpty():
        feats = feats.join(odd, feats["cls"] == odd["odd"], "left")
        feats = tables.put("feats", feats.withColumn("cls", F.when(F.col("odd").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", "mark"))).drop("odd"))
        classes = tables.put("classes", feats.where("cls is not null").groupBy("cls").agg(*found).select(flat))
    return feats, classes


def _keys(slots: np.ndarray):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1)
                keys = part_keys(sig, slots)
                slot = np.tile(np.arange(len(slots), dtype=np.int16), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(slot), pa.array(np.repeat(b.column(0).to_numpy(), len(slots)))], ["key", "slot", "cls"])

    return run


def _sets(width: int):
    """The sets of classes from their texts, of rows (cls, text)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, rows=500):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((shingle_set(text, width).tobytes() for text in b.column(1).to_pylist()), pa.binary())], ["cls", "members"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _confirmed(percent: int):
    """Of rows (a, b, in_a, in_b) the pairs (a, b) whose sets are as similar."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(pieces(batches, 2), 3):
            sets = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(c)] for c in (2, 3)]
            inter = np.array([_overlap(x, y) for x, y in zip(*sets)], dtype=np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(*sets)], dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(100 * inter >= percent * (total - inter)))

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by (key, i, j), in tables of whole runs of equal ones, with the run of each row;
    slices are bounded by the bytes of a column, tables by those and one run."""
    kept = None
    for batch in chain(pieces(batches, column), [None]):
        have = [x for x in (kept, batch) if x is not None and x.num_rows]
        if not have:
            continue
        t = pa.Table.from_batches(have).combine_chunks()
        col = lambda n: t.column(n).to_numpy()  # noqa: E731, B023
        starts = np.concatenate(([True], (col("key")[1:] != col("key")[:-1]) | (col("i")[1:] != col("i")[:-1]) | (col("j")[1:] != col("j")[:-1])))
        end = t.num_rows if batch is None else int(np.flatnonzero(starts)[-1])  # the last run may go on
        if end:
            yield t.slice(0, end), np.cumsum(starts)[:end]
        kept = t.slice(end).combine_chunks().to_batches()[0] if end < t.num_rows else None


def _near_in_runs(t: pa.Table, run: np.ndarray, covers: np.ndarray, radius: int, percent: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, d): rows that the row d places on in their run is near to by size and signature, from another
    component and, where a run has two blocks, block, and for whom the run's key is the first that both share.
    Compares all runs at once for d = 1, 2 .. while any run is that long; ``labels`` may change meanwhile."""
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(t.num_rows, -1)
    slot, block, n, two = t.column("slot").to_numpy(), t.column("block").to_numpy(), t.column("n").to_numpy(), t.column("i").to_numpy() != t.column("j").to_numpy()
    here = np.arange(len(run))
    for d in range(1, len(run)):
        here = here[here + d < len(run)]
        here = here[run[here] == run[here + d]]
        if not len(here):
            break
        x = here[(labels[here] != labels[here + d]) & (~two[here] | (block[here] != block[here + d]))]
        x = x[100 * np.minimum(n[x], n[x + d]) >= percent * np.maximum(n[x], n[x + d])]
        for at in range(0, len(x), 20_000):
            y = x[at : at + 20_000]
            differ = sig[y] != sig[y + d]
            near = differ.sum(axis=1) <= radius
            y, differ = y[near], differ[near]
            y = y[((differ.astype(np.float32) @ covers) == 0).argmax(axis=1) == slot[y]]
            if len(y):
                yield y, d


def _close(slots: np.ndarray, radius: int, percent: int):
    """Of rows sorted by (key, i, j) those that are near to another of their run by signature."""
    covers = slots.T.astype(np.float32)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in _whole_runs(batches, 4):
            near = np.zeros(t.num_rows, dtype=bool)
            for y, d in _near_in_runs(t, runs, covers, radius, percent, t.column("label").to_numpy()):
                near[y] = near[y + d] = True
            yield from t.filter(pa.array(near)).to_batches()

    return run


def _links_across(slots: np.ndarray, radius: int, percent: int):
    """Links between different components in each run of rows with equal (key, i, j); the rows come
    sorted by these.  Pairs that are near by signature are confirmed on the sets, and a link merges its
    components within the run before the search goes on."""
    covers = slots.T.astype(np.float32)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in _whole_runs(batches, 9):
            cls, label, members = t.column("cls").to_numpy(), t.column("label").to_numpy().copy(), t.column("members").combine_chunks()
            set_of = lambda r: np.frombuffer(members[int(r)].as_buffer(), dtype=np.uint64)  # noqa: B023, E731  where it lies
            ends, out = np.append(np.flatnonzero(runs[1:] != runs[:-1]) + 1, len(runs)), []
            for rows, d in _near_in_runs(t, runs, covers, radius, percent, label):
                for r in rows.tolist():
                    a, b = label[r], label[r + d]
                    if a == b:
                        continue
                    one, other = set_of(r), set_of(r + d)
                    inter = _overlap(one, other)
                    if 100 * inter >= percent * (len(one) + len(other) - inter):
                        out.append((cls[r], cls[r + d]))
                        k = int(np.searchsorted(ends, r, side="right"))
                        own = label[ends[k - 1] if k else 0 : ends[k]]
                        own[own == b] = a
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, symbols: int = 64, parts: int | None = None, block: int = 2000, block_shingles: int = 2_000_000, broadcast_rows: int = 500_000
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_tag, __label) for every row of ``docs`` (doc_id, text).

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id that a row reaches over links, itself included; kept is
    doc_id = component_id.  __label tells components apart whose component_id is null (null without words).

    Defined cases: a text that is null, empty or without words has the empty set and is linked with
    nothing, so it is its own component.  A null doc_id counts as the largest; a component of such rows
    alone has a null component_id and its rows are kept.  Rows that repeat a doc_id are told apart by
    their texts (text_tag, a 64-bit hash); equal rows are one document and share its verdict.  An empty
    table gives no rows; other columns are ignored.  Links are confirmed on the full sets, in which a
    shingle is its 64-bit hash; sets are one class if two 64-bit hashes of them are equal.  Memory: a task
    holds some megabytes of texts, or two blocks of sets.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "minhash")
    radius = radius_for(symbols, percent)
    slots = part_slots(symbols, parts or radius // 2 + 1, radius)  # one error a part
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("text_tag"), F.col("text").cast("string").alias("text"))

    feats = tables.put("feats", docs.mapInArrow(_features(width, symbols), "doc_id long, text_tag long, n_shingles long, cls long, mark long, sig binary"))
    feats, classes = set_classes(feats, tables)

    keys = classes.select("cls", "sig").mapInArrow(_keys(slots), "key long, slot short, cls long")
    shared = keys.groupBy("key").agg(F.min("cls").alias("center"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("size")).where("center <> last").select("key", "center", "size")
    members = tables.put("members", keys.join(shared, "key"))

    side = lambda end: classes.select(F.col("cls").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("n").alias(f"n_{end}"), F.col("least").alias(f"least_{end}"), F.col("tag").alias(f"tag_{end}"))
    sized = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def sets_of(wanted: DataFrame, rows: int) -> DataFrame:
        """(cls, members) of at most ``rows`` classes (cls, least, tag), from the texts that they come from."""
        wanted = tables.put("wanted", wanted.distinct(), rows)
        by = F.broadcast(wanted) if small_enough(wanted, broadcast_rows) else wanted
        texts = docs.join(by, (F.coalesce(docs["doc_id"], F.lit(2**63 - 1)) == by["least"]) & (docs["text_tag"] == by["tag"])).select("cls", "text")
        return tables.put("sets", texts.mapInArrow(_sets(width), "cls long, members binary").dropDuplicates(["cls"]))

    unequal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    words = lambda c: F.regexp_extract_all(F.hex(c), F.lit("(....)"), F.lit(1))
    first = members.where("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b")).distinct()
    first = first.join(side("a"), "a").join(side("b"), "b").where(sized).where(unequal(words("sig_a"), words("sig_b")) <= radius)
    first = tables.put("first", first.select("a", "b", "least_a", "tag_a", "least_b", "tag_b"))
    sets = sets_of(first.select(F.col("a").alias("cls"), F.col("least_a").alias("least"), F.col("tag_a").alias("tag")).union(first.select("b", "least_b", "tag_b")), 2 * first.count())
    both = first.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("members").alias("in_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("members").alias("in_b")), "b")
    links = tables.put("links", both.mapInArrow(_confirmed(percent), "a long, b long"))
    tables.clear("wanted", "sets", "first")
    labels = tables.put("labels", connected_components(links, tables), 2 * links.count())

    own_label = F.coalesce("label", "cls").alias("label")
    labelled = members.select("key", "slot", "cls").join(labels, F.col("cls") == F.col("node"), "left").select("key", "slot", "cls", own_label)
    labelled = labelled.join(classes.select("cls", "n", "least", "tag"), "cls")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("weight") / block_shingles)).cast("int").alias("blocks")
    rest = labelled.join(open_keys.select("key", blocks), "key").join(classes.select("cls", "sig"), "cls").withColumn("block", F.pmod(F.hash("cls"), "blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "slot", "cls", "label", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "least", "tag")
    kinds = "key long, slot short, cls long, label long, sig binary, block int, i int, j int, n long, least long, tag long"
    by_run = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    # Most rows of open buckets are near to none of another component: sets travel for those alone that are.
    close = tables.put("close", by_run(rest).mapInArrow(_close(slots, radius, percent), kinds))
    sets = sets_of(close.select("cls", "least", "tag"), close.count())
    close = close.drop("least", "tag").join(sets, "cls").select("key", "slot", "cls", "label", "sig", "block", "i", "j", "n", "members")
    found = by_run(close).mapInArrow(_links_across(slots, radius, percent), "a long, b long")
    more = tables.put("more", found)
    tables.clear("members", "close", "wanted", "sets")

    if more.limit(1).count():
        labels = tables.put("labels", connected_components(links.union(more), tables), 2 * (links.count() + more.count()))
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "least", own_label)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = tables.put("named", named.join(least, "label").select("cls", "component_id", "label"))
    out = feats.where("cls is not null").select("doc_id", "n_shingles", "cls", "text_tag").join(named, "cls").select("doc_id", "n_shingles", F.when(F.col("component_id") < 2**63 - 1, F.col("component_id")).alias("component_id"), "text_tag", F.col("label").alias("__label"))
    out = out.union(feats.where("cls is null").select("doc_id", "n_shingles", "doc_id", "text_tag", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_tag", "__label")
    tables.clear("classes", "links", "labels", "cc", "more")
    return out
