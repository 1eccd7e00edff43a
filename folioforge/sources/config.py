"""Registries of sources, topics and search terms from YAML, as small DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expand import TERM_SCHEMA

SOURCE_SCHEMA = (
    "source_id string, name string, connector string, enabled boolean, priority int, language string, download_policy string, rate_limit double, lookback_days int, "
    "access_methods array<struct<type:string,endpoint:string,auth_type:string,credential_env_var:string,verified:boolean>>"
)
#: Kinds of access in order of preference.
PREFERENCE = ["OPEN_API", "OAI_PMH", "RSS", "BULK", "FILE", "HTML"]


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dicts merged at every depth."""
    return {k: deep_merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def dotted(config: dict, path: str, default: Any = None) -> Any:
    """A value by its dotted path."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def _load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def sources_from(spark: SparkSession, config: dict) -> DataFrame:
    """The source registry: defaults merged into each source; repeated ids and empty lists are errors."""
    rows = [deep_merge(config.get("defaults") or {}, s) for s in config.get("sources") or []]
    ids = [r["source_id"] for r in rows]
    if not ids or len(set(ids)) < len(ids):
        raise ValueError("no sources" if not ids else f"repeated source_id: {sorted({i for i in ids if ids.count(i) > 1})}")
    method = lambda m: {k: m.get(k) for k in ("type", "endpoint", "auth_type", "credential_env_var", "verified")}
    table = [
        (r["source_id"], r.get("name"), r.get("connector"), bool(r.get("enabled", True)), int(r.get("priority", 3)), r.get("language"), r.get("download_policy"), float(r.get("rate_limit", 0.5)), int(r.get("lookback_days", 3)), [method(m) for m in r.get("access_methods") or []])
        for r in rows
    ]
    return spark.createDataFrame(table, SOURCE_SCHEMA)


def terms_from(spark: SparkSession, config: dict) -> DataFrame:
    """The dictionary of search terms."""
    names = [c.split()[0] for c in TERM_SCHEMA.split(", ")]
    terms = config.get("terms") or []
    if not terms:
        raise ValueError("no search terms")
    return spark.createDataFrame([tuple(t.get(n) for n in names) for t in terms], TERM_SCHEMA)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return sources_from(spark, _load(path))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return terms_from(spark, _load(path))


def preferred_method(methods: Column) -> Column:
    """Of an array of access methods the one whose kind is preferred most."""
    rank = lambda m: F.when(F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), m["type"]) > 0, F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), m["type"])).otherwise(99)
    return F.get(F.array_sort(F.transform(methods, lambda m, i: F.struct(rank(m).alias("r"), i.alias("i"), m.alias("m")))), 0)["m"]


def method_status(sources: DataFrame, credentials: DataFrame) -> DataFrame:
    """A row an access method with its status (usable, no_endpoint, no_credential), and whether its source
    is usable by any; ``credentials``: name of each variable that is set."""
    rows = sources.select("source_id", "enabled", F.posexplode_outer("access_methods").alias("ord", "m"))
    have = F.broadcast(credentials.select(F.col("name").alias("__have")).distinct())
    rows = rows.join(have, F.col("m.credential_env_var") == F.col("__have"), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    status = F.when(text("m.endpoint") == "", "no_endpoint").when((text("m.credential_env_var") != "") & F.col("__have").isNull(), "no_credential").otherwise("usable")
    rows = rows.select("source_id", "enabled", "ord", F.col("m.type").alias("type"), status.alias("status"))
    usable = rows.groupBy("source_id").agg(F.bool_or(F.col("status") == "usable").alias("source_usable"))
    return rows.join(usable, "source_id")


def registry_counts(sources: DataFrame) -> DataFrame:
    """Sources, enabled ones, and verified and unverified access methods."""
    methods = F.coalesce("access_methods", F.array().cast(sources.schema["access_methods"].dataType))
    verified = F.size(F.filter(methods, lambda m: F.coalesce(m["verified"], F.lit(False))))
    return sources.agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("enabled").alias("n_enabled"), F.sum(verified).alias("n_verified"), F.sum(F.size(methods) - verified).alias("n_unverified"))
