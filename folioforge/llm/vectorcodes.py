"""Vector code compression: product quantisation trained by a filtering Lloyd iteration.

A vector of integers is cut into equal parts, and each part position has a codebook.  In a round every
partition builds a kd-tree over its parts of each position; a node knows its bounding box and the sum
and count of what lies below it.  Codebook entries go down the tree; a node drops those that are farther
than its best entry from every point of its box, and where one entry is left the whole subtree is assigned
to it at once, by its cached sum and count (Kanungo et al., 2002).  All arithmetic is in whole numbers,
so results don't depend on partitions or their order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, gives_back, small_enough

#: Vectors that trees are built over at a time: what a task holds.
BLOCK = 32_768
#: Points below which a node is not split.
LEAF = 24
#: Label sums up to which they are broadcast.
BROADCAST_ROWS = 100_000


class Tree:
    """A balanced kd-tree over the rows of ``points``, level by level in arrays: of level k, node j has the
    rows ``order[cuts[k][j]:cuts[k][j + 1]]``, and its children are nodes 2 j and 2 j + 1 of the next level."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.order, self.cuts, self.low, self.high = np.arange(n), [np.array([0, n])], [], []
        while True:
            cuts, own = self.cuts[-1], points[self.order]
            self.low.append(np.minimum.reduceat(own, cuts[:-1]))
            self.high.append(np.maximum.reduceat(own, cuts[:-1]))
            sizes = np.diff(cuts)
            if sizes.max() <= leaf or sizes.min() < 2:
                break
            widest = (self.high[-1] - self.low[-1]).argmax(axis=1)
            node = np.repeat(np.arange(len(sizes)), sizes)
            self.order = self.order[np.lexsort((own[np.arange(n), widest[node]], node))]
            self.cuts.append(np.append(np.stack((cuts[:-1], cuts[:-1] + sizes // 2), axis=1).ravel(), n))
        self.points = points[self.order]
        self.sums = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), self.points.cumsum(axis=0)))


def largest(dimension: int) -> int:
    """The bound that whole components are held within, so that sums of squares fit into 64 bits."""
    return math.isqrt(2**62 // max(1, dimension)) // 4


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def filter_entries(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Assigns all points: (first, end, entry) arrays of ranges of ``tree.points`` and their entries.  The
    nearest entry wins, of equally near ones the one with the lower index."""
    k = np.arange(len(entries))
    nodes, left = np.array([0]), np.ones((1, len(k)), dtype=bool)
    for level, cuts in enumerate(tree.cuts):
        low, high = tree.low[level][nodes], tree.high[level][nodes]
        far = np.iinfo(np.int64).max
        best = np.where(left, _squares(2 * entries[None], (low + high)[:, None]), far).argmin(axis=1)
        near = entries[best]
        corner = np.where(entries[None] > near[:, None], high[:, None], low[:, None])  # where an entry does best against the node's best
        mine, other = _squares(entries[None], corner), _squares(near[:, None], corner)
        left &= (mine < other) | ((mine == other) & (k <= best[:, None]))
        alone = left.sum(axis=1) == 1
        done = nodes[alone]
        yield cuts[done], cuts[done + 1], best[alone]
        nodes, left = nodes[~alone], left[~alone]
        if level + 1 < len(tree.cuts):
            nodes, left = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(left, 2, axis=0)
    sizes = cuts[nodes + 1] - cuts[nodes]
    at = np.repeat(cuts[nodes] - np.append(0, sizes.cumsum()[:-1]), sizes) + np.arange(sizes.sum())
    may = np.repeat(np.arange(len(nodes)), sizes)
    for a in range(0, len(at), 4096):
        some = at[a : a + 4096]
        d = np.where(left[may[a : a + 4096]], _squares(tree.points[some][:, None], entries[None]), far)
        yield some, some + 1, d.argmin(axis=1)


def _whole(vectors: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, components): which vectors have values and finite components only, and those, as whole numbers, flat."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    ends = sizes.cumsum()
    usable = (bad[ends] == bad[ends - sizes]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    return usable, np.clip(np.floor(np.nan_to_num(x[np.repeat(usable, sizes)], nan=0.0) * scale), -largest(dimension), largest(dimension)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int, scale: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows whose vector can be used and has ``dimension`` components, some ``BLOCK`` at a time, with their components."""
    rows, parts, size = [], [], 0
    for batch in batches:
        vectors = batch.column(0)
        vectors = vectors.filter(pc.equal(pc.list_value_length(vectors), dimension))
        kept = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(0)), dimension), False))
        usable, x = _whole(vectors, dimension, scale)
        rows.append(kept.filter(pa.array(usable)).select(list(range(1, batch.num_columns))))
        parts.append(x.reshape(-1, dimension))
        size += len(parts[-1])
        if size >= BLOCK:
            yield pa.Table.from_batches(rows), np.concatenate(parts)
            rows, parts, size = [], [], 0
    if size:
        yield pa.Table.from_batches(rows), np.concatenate(parts)


def _sums(books: np.ndarray, scale: int):
    """Of a partition: (part, entry, n, sums) of what its trees assign to each entry."""
    parts, k, width = books.shape

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64)
        for _, x in _blocks(batches, parts * width, scale):
            for p in range(parts):
                tree = Tree(x[:, p * width : (p + 1) * width])
                for first, end, entry in filter_entries(tree, books[p]):
                    np.add.at(n[p], entry, end - first)
                    np.add.at(sums[p], entry, tree.sums[end] - tree.sums[first])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, scale: int):
    """Adds to each row its code and its error."""
    parts, _, width = books.shape

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches, parts * width, scale):
            code, error = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                tree, found = Tree(own), np.empty(len(x), dtype=np.int64)
                for first, end, entry in filter_entries(tree, books[p]):
                    sizes = end - first
                    at = np.repeat(first - np.append(0, sizes.cumsum()[:-1]), sizes) + np.arange(sizes.sum())
                    found[tree.order[at]] = np.repeat(entry, sizes)
                code[:, p] = found
                error += _squares(own, books[p][found])
            text = code.tobytes().hex()
            step = 2 * parts
            out = rows.append_column("code", pa.array([text[a : a + step] for a in range(0, len(text), step)])).append_column("error", pa.array(error))
            yield from out.to_batches(max_chunksize=10_000)

    return run


def train_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> np.ndarray | None:
    """Codebooks as whole numbers, (parts, entries, width): the parts of the ``entries`` vectors with the
    smallest keys, after so many rounds.  None where no vector can be used.

    A round is one pass over the vectors, without a shuffle of them: a partition sends at most
    parts x entries sums, Spark adds them up, and the driver gets the totals.  The first ``entries``
    vectors are all else that it sees.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    heads = vectors.where(x.isNotNull() & fine & (F.size(x) >= parts) & (F.size(x) % parts == 0)).select(F.col(key).alias("k"), x.alias("x"))
    first = heads.orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    dimension = len(first[0]["x"])
    start = np.array([r["x"] for r in first if len(r["x"]) == dimension])
    books = np.clip(np.floor(start * scale), -largest(dimension), largest(dimension)).astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(rounds):
        sums = vectors.select(vector).mapInArrow(_sums(books, scale), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        for r in total.collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """Codes of all usable vectors: (``key``, code, error, label_error, codebooks_sha256).  code has two hex
    digits a part, error the squared distance to what the code stands for, label_error its sum over the rows
    of equal label (nulls together), codebooks_sha256 the digest of the trained codebooks.

    Defined cases: rows whose vector is null or holds null or non-finite components go, and so do those that
    have another number of components than the first kept one, or a number that ``parts`` does not divide
    (their parts can't be compared).  With fewer vectors than ``entries`` codebooks are smaller.  Null keys
    count as largest, equal keys are ordered by their vectors.  Whole components beyond ``largest(dimension)``
    (2**26 for 64 components) count as that bound.  Repeated rows count each time; an empty table gives no rows; other columns are ignored.

    A task holds ``BLOCK`` vectors at a time.  Label sums are combined before their shuffle and joined by a
    broadcast up to ``BROADCAST_ROWS``; beyond it both sides are spread over slices of the key, so a label
    with a third of all rows meets its sum in many tasks.
    """
    spark = vectors.sparkSession
    books = train_codebooks(vectors, parts, entries, rounds, scale, vector, key)
    kinds = f"`{key}` {vectors.schema[key].dataType.simpleString()}, `{label}` {vectors.schema[label].dataType.simpleString()}, code string, error long"
    if books is None:
        return spark.createDataFrame([], f"`{key}` {vectors.schema[key].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    tables = Tables(spark, "vector-codes")
    coded = tables.put("coded", vectors.select(vector, key, label).mapInArrow(_codes(books, scale), kinds))
    sums = tables.put("labels", coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    slices = 1
    if small_enough(sums, BROADCAST_ROWS):
        sums = F.broadcast(sums.withColumn("__slice", F.lit(0)))
    else:
        slices = 64
        sums = sums.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    coded = coded.withColumn("__part", F.pmod(F.xxhash64(key, "code"), F.lit(slices)).cast("int"))
    out = coded.join(sums, coded[label].eqNullSafe(sums["__label"]) & (coded["__part"] == sums["__slice"]))
    return out.select(key, "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray, scale: int = 256) -> list[float]:
    """The vector that a code stands for: the middles of its components' steps."""
    return [(float(x) + 0.5) / scale for p, e in enumerate(bytes.fromhex(code)) for x in books[p][e]]
