"""A corpus pipeline over ``documents``: language ID, near-duplicate removal, substring dedup, mixing to
target weights, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.

Defined for every stage: further columns may have any name and type (maps and names with dots too) and pass
unchanged; an empty table gives no rows; texts may be as long as a string can be; rows without a doc_id are
told apart by their texts.  What a stage does with null and empty texts and repeated rows, it says itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.bpe import encode_and_decode
from folioforge.llm.chunks import without_repeats
from folioforge.llm.common import Tables, named, ship_package, small_enough, text_or_empty, text_tag
from folioforge.llm.langid import fit, held_out, judged
from folioforge.llm.minhash import near_duplicates
from folioforge.llm.mixing import mix_sources


#: Rows up to which a table of (doc_id, tag) is broadcast, some 16 MB; beyond it texts are shuffled.
BROADCAST_ROWS = 500_000


def _table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is counted to be small."""
    df = Tables(spark, "stage").put("rows", df)
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def _in_order(docs: DataFrame) -> Column:
    """What rows equal in doc_id and text are ordered by: all their columns as text, whatever their types."""
    return F.struct(*named(docs)).cast("string")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; lang becomes the prediction.  Texts that are null or
    have no letter go, all do if no row has a language to learn from; repeated rows are judged alike."""
    ship_package(spark)
    kept = judged(docs, fit(docs, ~held_out())).where("not __ff_lang.rejected")
    return kept.withColumn("lang", F.col("__ff_lang.lang_pred")).select(*named(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (5-word shingles, similarity 0.8) the smallest doc_id; of several
    rows with that doc_id, or of a group without one, the one with the least text tag, of equal texts one.
    Texts that are null or have no word are near nothing and all stay."""
    ship_package(spark)
    found = Tables(spark, "stage").put("found", near_duplicates(docs, width=5, percent=80))
    kept = found.where("kept and __label is not null")
    tied = kept.groupBy("__label").agg(F.min("text_tag").alias("least"), F.max("text_tag").alias("most")).where("least <> most")
    kept = kept.join(tied, "__label", "left")
    later, stay = kept.where("text_tag <> least"), kept.where("text_tag = coalesce(least, text_tag)")
    gone = _table(spark, found.where(~F.col("kept")).select("doc_id", "text_tag").union(later.select("doc_id", "text_tag")).distinct().toDF("__ff_id", "__ff_tag"))
    same = lambda side: docs["doc_id"].eqNullSafe(side["__ff_id"]) & (text_tag() == side["__ff_tag"])
    copies = _table(spark, stay.groupBy("doc_id", "text_tag").count().where("count > 1").select(F.col("doc_id").alias("__ff_id"), F.col("text_tag").alias("__ff_tag")))
    one = docs.join(copies, same(copies)).groupBy("__ff_id", "text").agg(F.min_by(F.struct(*named(docs)), _in_order(docs)).alias("row")).select("row.*")
    return docs.join(gone, same(gone), "left_anti").join(copies, same(copies), "left_anti").union(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of all documents but the first that has them.  No row goes: null and empty texts stay
    as they are, and so do equal rows, which near-dedup has made one."""
    ship_package(spark)
    return without_repeats(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it: 0 to 3 rows.  Rows equal in doc_id and text are
    taken alike, or where some of them are taken once more, in the order of their other columns.  Texts that
    are null or have no word are taken as often as their source's other rows, or not at all in a source without words."""
    ship_package(spark)
    mixed = mix_sources(docs).select(F.col("doc_id").alias("__ff_id"), F.col("__row").alias("__ff_row"), F.col("__copy").alias("__ff_copy"), F.col("repeats").alias("__ff_repeats"))
    mixed = Tables(spark, "stage").put("mixed", mixed)
    keys = mixed.groupBy("__ff_id", "__ff_row").agg(F.min("__ff_repeats").alias("least"), F.max("__ff_repeats").alias("most")).where("most > 0")
    alike = _table(spark, keys.where("least = most").select("__ff_id", "__ff_row", F.col("most").alias("__ff_repeats")))
    unlike = _table(spark, keys.where("least < most").select("__ff_id", "__ff_row"))
    known = F.concat_ws(":", F.lit("17"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    row = F.conv(F.substring(F.md5(known), 1, 15), 16, 10).cast("long")
    same = lambda side: docs["doc_id"].eqNullSafe(side["__ff_id"]) & (row == side["__ff_row"])
    copy = F.row_number().over(Window.partitionBy("__ff_id", "__ff_row").orderBy(_in_order(docs))).alias("__ff_copy")
    counted = docs.join(unlike, same(unlike)).select(*named(docs), F.col("__ff_id").alias("__id"), F.col("__ff_row").alias("__row"), copy)
    one = mixed.where("__ff_repeats > 0")
    counted = counted.join(one, counted["__id"].eqNullSafe(one["__ff_id"]) & (counted["__row"] == one["__ff_row"]) & (counted["__ff_copy"] == one["__ff_copy"]))
    out = docs.join(alike, same(alike)).select(*named(docs), "__ff_repeats").union(counted.select(*named(docs), "__ff_repeats"))
    return out.withColumn("__ff_time", F.explode(F.sequence(F.lit(1), F.col("__ff_repeats").cast("int")))).select(*named(docs))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of the text decoded from them; null counts as empty."""
    ship_package(spark)
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, memory=0.2)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_to_weights", mix_to_weights),
    ("byte_level_bpe", byte_level_bpe),
]

#: Clusters, signatures and merges have no SQL form; tests/llm/test_brute_force.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
