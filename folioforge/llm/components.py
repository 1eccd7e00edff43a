"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _toward_least(links: DataFrame, larger: bool) -> DataFrame:
    """One step: each node hands its least neighbour to its neighbours above itself (``larger``) or
    to those below.  Rows per node are first reduced to a minimum, so no neighbourhood is gathered;
    the join on a hub's key is an ordinary shuffle join, which AQE splits where it is skewed."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m") if larger else F.col("m"))
    met = both.join(least, both["a"] == least["n"])
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b: long), label the least node that it
    reaches.  Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no
    longer change; only two numbers a round reach the driver.  A round's table has one file for so
    many links as ``Tables`` puts into one (a round never makes more links than it got)."""
    now = tables.put("cc", links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = mark(now)
    while before[0]:
        old = list(tables.paths["cc"])
        now = tables.put("cc", _toward_least(_toward_least(now, True), False), before[0])
        after = mark(now)
        tables.paths["cc"], keep = old, tables.paths["cc"][-1:]
        tables.clear("cc")
        tables.paths["cc"] = keep
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()
