"""Pages that name their next one by a token: their order, gaps, circles and ends, without walking them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import Scratch


def token_chains(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(harvest, page_id, start, place, state) of captured pages (harvest, page_id, token: what the page was
    asked with, empty for a first one; next: the token that it names, empty at the end).

    A page follows the one of its harvest that names its token (of several the least page_id; of pages with one
    token the least is the chain's, the others are ``repeat``).  start is the first page of its chain, place
    counts from 0.  state: ``complete`` if the chain runs from a first page to an end, ``unfinished`` if its last
    page names a token that no page has, ``gap`` if it begins in the middle, ``circle`` where pages lead round (start
    and place null).  Null tokens count as empty.

    Pointer doubling: each round a page's pointer jumps as far again, so a chain of n pages takes log2(n)
    rounds of one join by page; pages in a circle are those whose pointers never reach a start."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pages.select("harvest", "page_id", text("token").alias("token"), text("next").alias("next"))
    first = rows.groupBy("harvest", "token").agg(F.min("page_id").alias("own"))
    rows = scratch.put(rows.join(first, ["harvest", "token"]))
    chain = rows.where("page_id = own").drop("own")
    before = chain.where("next <> ''").groupBy("harvest", F.col("next").alias("token")).agg(F.min("page_id").alias("before"))
    after = chain.select("harvest", F.col("token").alias("next"), F.lit(True).alias("there"))
    chain = scratch.put(chain.join(before, ["harvest", "token"], "left").join(after, ["harvest", "next"], "left").withColumn("before", F.when(F.col("token") != "", F.col("before"))))
    now = scratch.put(chain.select("harvest", "page_id", F.col("before").alias("up"), F.coalesce("before", "page_id").alias("start"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place")))
    most = now.groupBy("harvest").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, most).bit_length()):
        there = now.select(F.col("harvest").alias("h"), F.col("page_id").alias("p"), F.col("up").alias("up2"), F.col("start").alias("start2"), F.col("place").alias("place2"))
        on = (now["harvest"] == there["h"]) & (now["up"] == there["p"])
        now = scratch.put(now.join(there, on, "left").select("harvest", "page_id", F.col("up2").alias("up"), F.coalesce("start2", "start").alias("start"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place")))
        if now.where("up is not null").isEmpty():
            break
    placed = now.select("harvest", "page_id", F.when(F.col("up").isNull(), F.col("start")).alias("start"), F.when(F.col("up").isNull(), F.col("place")).alias("place"))
    placed = placed.join(chain.select("harvest", "page_id", "token", F.when(F.col("next") == "", "end").when(F.col("there").isNull(), "open").alias("last")), ["harvest", "page_id"])
    heads = placed.where("start is not null").groupBy("harvest", "start").agg(F.max(F.when(F.col("page_id") == F.col("start"), F.col("token"))).alias("head"), F.max_by("last", "place").alias("tail"))
    placed = placed.join(heads, ["harvest", "start"], "left")
    state = F.when(F.col("start").isNull(), "circle").when(F.col("head") != "", "gap").when(F.col("tail") == "end", "complete").when(F.col("tail") == "open", "unfinished").otherwise("circle")
    out = placed.select("harvest", "page_id", "start", "place", state.alias("state"))
    none = rows.where("page_id <> own").select("harvest", "page_id", F.lit(None).cast(out.schema["start"].dataType), F.lit(None).cast("long"), F.lit("repeat"))
    return out.union(none)
