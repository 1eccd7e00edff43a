"""A run over stored state: what arrives is folded against what is there, and all of it committed at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import score as S
from ..operators.arrivals import fold_arrivals
from ..operators.index import add_documents
from ..operators.ordered import last_before
from ..operators.policy import DOWNLOAD_SCORE, SUMMARY_SCORE, acquire, adopt, apply_license
from ..operators.runs import run_tally
from ..operators.state import Catalogue, Run, Scratch
from ..operators.store import enrich, file_names, insert_ignore, source_map, topic_bridge
from ..operators.summarize import markdown, summarize
from ..schema import RESOURCE_COLUMNS

#: Columns of the stored resources: a record's own, its place in the order of arrival, and the version that wrote it.
STORED = ", ".join(f"{c} {k}" for c, k in RESOURCE_COLUMNS.items()) + ", seq long, written long"
FILES = "file_sha256 string, resource_id string, file_path string, file_size long, written long"
SOURCES = "resource_id string, source_id string, url string, role string, written long"
ITEMS = "run_id string, source_id string, resource_id string, outcome string, access_mode string, detail string"
ERRORS = "run_id string, source_id string, resource_id string, error_code string, url string"


def content_tier(df: DataFrame, stored: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` (records that came as far as their file, with file_hash, text_hash, extract_failed, own_path) with
    same_file and same_text: struct<target, path> of the record whose file or text they repeat, the last one
    before them, stored or arriving; path is where its file lies."""
    for column, hashed, name in (("file_hash", "file_sha256", "same_file"), ("text_hash", "text_sha256", "same_text")):
        asks = F.when((F.coalesce(F.col(column), F.lit("")) != ""), F.col(column))
        if name == "same_text":
            asks = F.when(F.col("same_file").isNull() & ~F.coalesce(F.col("extract_failed"), F.lit(False)), asks)
        df = scratch.put(df.withColumn("k", asks))
        wanted = df.select(F.col("k").alias("__k")).where("__k is not null").distinct()
        old = stored.where(F.col(hashed) != "").join(wanted, F.col(hashed) == F.col("__k"), "left_semi").groupBy(F.col(hashed).alias("__k"))
        old = old.agg(F.max_by(F.struct(F.col("resource_id").alias("target"), F.col("file_path").alias("path")), F.struct("last_seen_at", "seq")).alias("__old"))
        first = df.where("k is not null").groupBy(F.col("k").alias("__k")).agg(F.min_by("own_path", "seq").alias("__path"))
        df = last_before(df, df.select("k", "seq", F.struct(F.col("resource_id").alias("target")).alias("__last")), "k", "seq", "__last")
        df = df.join(old, df["k"] == old["__k"], "left").drop("__k").join(first, df["k"] == first["__k"], "left").drop("__k")
        path = F.coalesce(F.col("__old.path"), F.col("__path"))
        found = F.coalesce(F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.target").alias("target"), path.alias("path"))), F.when(F.col("__old").isNotNull(), F.struct(F.col("__old.target").alias("target"), path.alias("path"))))
        df = df.withColumn(name, found).drop("k", "__old", "__path", "__last")
    return df


def record_run(
    run: Run, arrivals: DataFrame, facts: DataFrame, lookups: DataFrame, taxonomy: C.Taxonomy, today: Column, now: Column, download: bool = True, threshold: int = DOWNLOAD_SCORE, summary_from: int = SUMMARY_SCORE, fuzzy: bool = True, index: bool = True
) -> DataFrame:
    """Takes ``arrivals`` (resources with a seq) into the run's catalogue and writes, for its commit: resources,
    topics, files, source_map, run_items, errors, and the search index.  Gives the outcome of each arrival.

    In the order of the chain: licence and adoption, bibliographic ``lookups`` by DOI, identity against state
    and arrivals before (``fold_arrivals``), first classification and score, the full-text cascade over
    captured ``facts`` (by resource_id: policy, link, match, download, file, file_hash, file_size, text_hash,
    extract_failed, fulltext ...), the content tier, second classification and score, summary.  Duplicates
    leave their URLs with the record that they repeat and count as a sight of it."""
    spark, version = arrivals.sparkSession, run.base + 1
    scratch = Scratch(spark)
    stored = scratch.put(run.current("resources", "resource_id", STORED))
    after = stored.agg(F.max("seq")).first()[0]
    df = enrich(adopt(apply_license(arrivals)), lookups).withColumn("seq", F.col("seq") + F.lit(0 if after is None else after + 1))
    df = scratch.put(df)
    folded = scratch.put(fold_arrivals(df, stored, scratch, fuzzy=fuzzy))
    df = df.drop("work_id", "version_of").join(folded.drop("resource_id"), "seq")
    df = df.withColumns({"status": F.when(F.col("verdict") == "NEW_VERSION", "UPDATED").otherwise("NEW"), "first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": now})
    df = S.score(C.classify(df.where("verdict <> 'DUPLICATE'"), taxonomy), today)
    df = df.drop("text_extract_failed", *[c for c in facts.columns if c != "resource_id"]).join(facts, "resource_id", "left").withColumns({"file_known": F.lit(False), "text_known": F.lit(False)})
    df = acquire(df, enabled=download, threshold=threshold)
    folder = F.concat_ws("/", F.col("topic_primary"), F.date_format(today, "yyyy"))
    name = T.build_filename(F.col("publication_date"), F.col("source_id"), T.best_title(F.col("title_ko"), F.col("title_original")))
    df = scratch.put(df.withColumns({"reached": F.col("outcome") == "downloaded", "__folder": folder, "__name": name}))
    came = file_names(df.where("reached"), "__folder", "__name", "seq", "file_hash").withColumn("own_path", F.concat_ws("/", "__folder", "stored_name"))
    same = content_tier(came.select("resource_id", "seq", "file_hash", "text_hash", "extract_failed", "own_path"), stored, scratch).select("seq", "own_path", "same_file", "same_text")
    df = df.drop("outcome", "log_code", "error_code", "access_mode").join(same, "seq", "left")
    df = acquire(df.withColumns({"file_known": F.col("same_file").isNotNull(), "text_known": F.col("same_text").isNotNull()}), enabled=download, threshold=threshold)
    got = F.col("access_mode") == "DOWNLOADED"
    df = df.withColumns(
        {
            "file_path": F.when(got, F.col("own_path")).otherwise(F.coalesce("same_file.path", "same_text.path", F.lit(""))), "file_sha256": F.when(F.col("reached"), F.col("file_hash")).otherwise(F.lit("")),
            "text_sha256": F.when(F.col("reached") & F.col("same_file").isNull() & ~F.coalesce("extract_failed", F.lit(False)), F.col("text_hash")).otherwise(F.lit("")),
            "file_size": F.when(F.col("reached"), F.col("file_size")).otherwise(F.lit(0)), "text_extract_failed": got & F.coalesce("extract_failed", F.lit(False)),
            "downloaded_at": F.when(got, now), "fulltext": F.when(got & ~F.coalesce("extract_failed", F.lit(False)), F.col("fulltext")), "repeats": F.coalesce("same_file.target", "same_text.target"),
        }
    )
    df = summarize(S.score(C.classify(df, taxonomy, fulltext=True), today), F.col("relevance_score") >= summary_from)
    df = scratch.put(df.withColumn("summary_ko", F.when(F.col("relevance_score") >= summary_from, markdown(df)).otherwise("")))

    kept = {c: F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k) for c, k in RESOURCE_COLUMNS.items()}
    fresh = df.select(*[v.alias(c) for c, v in kept.items()], F.col("seq").cast("long").alias("seq"), F.lit(version).cast("long").alias("written"))
    again = folded.where("verdict = 'DUPLICATE'").join(scratch.put(adopt(apply_license(arrivals)).select("resource_id", "source_id", "landing_url", "download_url", "oa_url", (F.col("seq") + F.lit(0 if after is None else after + 1)).alias("seq"))).drop("resource_id"), "seq")
    met = again.select(F.col("match_id").alias("resource_id"), "source_id", "landing_url", "download_url", "oa_url").union(df.where("repeats is not null").select("repeats", "source_id", "landing_url", "download_url", "oa_url"))
    met = scratch.put(met)
    touched = stored.join(met.select("resource_id").distinct(), "resource_id", "left_semi").withColumns({"last_seen_at": now.cast(RESOURCE_COLUMNS["last_seen_at"]), "written": F.lit(version).cast("long")})
    run.append("resources", fresh.unionByName(touched))
    run.append("topics", topic_bridge(df).withColumn("written", F.lit(version).cast("long")))
    files = fresh.where("access_mode = 'DOWNLOADED'").select("file_sha256", "resource_id", "file_path", "file_size", "written")
    run.append("files", insert_ignore(run.table("files", FILES).limit(0), files.join(run.table("files", FILES).select("file_sha256"), "file_sha256", "left_anti").select(*files.columns), ["file_sha256"], ["resource_id"]))
    urls = source_map(df).union(source_map(met)).distinct().withColumn("written", F.lit(version).cast("long"))
    keys = ["resource_id", "source_id", "url"]
    fresh_urls = urls.groupBy(*keys).agg(F.min("role").alias("role"), F.first("written").alias("written")).select("resource_id", "source_id", "url", "role", "written")
    run.append("source_map", fresh_urls.join(run.table("source_map", SOURCES).select(*keys), keys, "left_anti").select(*fresh_urls.columns))
    outcome = folded.where("verdict = 'DUPLICATE'").join(again.select("seq", "source_id"), "seq").select("seq", "source_id", F.col("match_id").alias("resource_id"), F.lit("DUPLICATE").alias("outcome"), F.lit(None).cast("string").alias("access_mode"), F.concat(F.lit("matched_by="), "matched_by").alias("detail"), "match_id", "matched_by")
    outcome = outcome.union(df.select("seq", "source_id", "resource_id", "status", "access_mode", F.concat(F.lit("score="), "relevance_score", F.lit(" topic="), "topic_primary"), F.coalesce("match_id", "repeats"), F.coalesce("matched_by", F.when(F.col("same_file").isNotNull(), "file_sha256").when(F.col("same_text").isNotNull(), "text_sha256"))))
    outcome = scratch.put(outcome)
    items = outcome.select(F.lit(run.run_id).alias("run_id"), "source_id", "resource_id", "outcome", "access_mode", "detail")
    loaded = outcome.where("access_mode = 'DOWNLOADED'").select(F.lit(run.run_id), "source_id", "resource_id", F.lit("DOWNLOADED"), "access_mode", F.lit(""))
    run.append("run_items", items.union(loaded))
    run.append("errors", df.where("log_code is not null").select(F.lit(run.run_id).alias("run_id"), "source_id", "resource_id", F.col("log_code").alias("error_code"), F.coalesce("download_url", F.lit("")).alias("url")))
    run.append("tallies", run_tally(outcome).withColumn("run_id", F.lit(run.run_id)))
    if index:
        add_documents(run, df.select(F.col("resource_id").alias("id"), "title_original", "title_ko", "abstract_original", F.coalesce("fulltext", F.lit("")).alias("fulltext")), ["title_original", "title_ko", "abstract_original", "fulltext"])
    return outcome


def recorded(catalogue: Catalogue, run_id: str, *args, **options) -> int:
    """``record_run`` as one committed run, tried again where another run came between; a run that has
    committed is not done twice."""
    return catalogue.run(run_id, lambda run: record_run(run, *args, **options))
