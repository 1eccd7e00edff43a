"""Existence checks: a stored Bloom filter is asked before a join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block; a key sets one bit in each, all in one block.
WORDS = 8
#: Rows of a filter, 64 bytes each, up to which it is broadcast: 64 MB.
BROADCAST_ROWS = 1_000_000
FILTER = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))


def blocks_for(keys: int, bits: int = 12) -> int:
    """Blocks of a filter for so many keys at ``bits`` bits each (12: some 1 % pass falsely)."""
    return max(1, math.ceil(keys * bits / (64 * WORDS)))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.shiftrightunsigned(g, 6 * i).bitwiseAND(63).cast("int")
    return F.pmod(h, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)) for i in range(WORDS)]


def bloom_filter(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column, a row a block: bits are joined before the shuffle, so a task sends a row a block
    at most.  Null keys are not in it."""
    block, bits = _places(F.col(key), blocks)
    named = rows.where(F.col(key).isNotNull()).select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return _joined(named)


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several with the same number of blocks: a run's is added to the stored one."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return _joined(out)


def may_exist(rows: DataFrame, key: str, stored_filter: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and some 1 % of the others."""
    block, bits = _places(F.col(key), blocks)
    side = stored_filter.withColumnRenamed("block", "__block")
    hit = block == F.col("__block")
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return rows.join(F.broadcast(side), hit, "left_semi")


def existing(rows: DataFrame, key: str, stored: DataFrame, stored_filter: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key is in ``stored`` (same column name).  A filter of up to ``BROADCAST_ROWS`` rows is asked
    first, so that only what passes is shuffled for the join; a larger one isn't, and all rows are."""
    some = may_exist(rows, key, stored_filter, blocks) if blocks <= BROADCAST_ROWS else rows
    return some.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
