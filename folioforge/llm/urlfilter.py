"""URL filters: host-suffix and path-prefix expressions, joined by short hash prefixes.  Native SQL.

Every URL is expanded into the expressions that a rule could have written: each suffix of its host's
labels with each prefix of its path.  Expressions meet rules on the first 32 bits of a SHA-256; what
meets is confirmed on the full digest and on the text itself, and the longest confirmed rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_enough

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there up to ``?``, ``#`` or the end.  Both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (host, path, action) from pairs of an action and ``host/path``."""
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], a) for a, r in rules]
    return spark.createDataFrame(rows, "host string, path string, action string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = 100_000, salts: int = 16) -> DataFrame:
    """``pages`` with host, path, rule and verdict, columns of the same names replaced.

    A rule (host, path, action: allow or block) fits its host and all subdomains if the URL's path
    starts with the rule's.  The rule with the most characters wins; of equally long ones that with the
    longer host; of the same rule stated twice, block.  Without a rule the verdict is ``default`` and
    rule is null.

    Defined cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule and
    gets the default.  Rules with a null part are ignored; an empty rule table gives the default for
    all.  Repeated rows are judged alike; an empty table gives no rows.

    Plan: only distinct URLs are expanded (copies of a URL are combined before the shuffle), and only
    into suffixes with as many labels and prefixes as long as some rule has.  Up to ``broadcast_rules``
    rules (counted first) are broadcast; more are joined on (hash prefix, salt), every rule written
    once a salt, so that an expression that a third of all URLs share is spread over ``salts`` tasks.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).where("r_host is not null and r_path is not null and r_action is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))  # block > allow
    text = F.concat("r_host", "r_path")
    rules = rules.select("r_host", "r_action", text.alias("r_text"), F.sha2(text, 256).alias("r_digest"), F.length("r_path").alias("n"), F.size(F.split("r_host", "\\.")).alias("m")).withColumn("r_short", F.substring("r_digest", 1, 8))
    shape = rules.agg(F.sort_array(F.collect_set("n")).alias("n"), F.sort_array(F.collect_set("m")).alias("m")).first()  # bounded by the longest rule
    lengths, labels = (F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>") for xs in (shape["n"], shape["m"]))

    urls = pages.select(F.col("url").cast("string").alias("u")).where("instr(u, '://') > 0").distinct()
    host, path = host_and_path(F.col("u"))
    urls = urls.select("u", F.split(host, "\\.").alias("l"), path.alias("p"))
    suffixes = F.transform(F.filter(labels, lambda m: m <= F.size("l")), lambda m: F.array_join(F.slice("l", F.size("l") - m + 1, m), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    each = F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    tried = urls.select("u", each.alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    if small_enough(rules, broadcast_rules):
        met = tried.join(F.broadcast(rules), tried["short"] == rules["r_short"])
    else:
        rules = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tried = tried.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
        met = tried.join(rules, (tried["short"] == rules["r_short"]) & (tried["salt"] == rules["r_salt"]))
    fits = met.where("digest = r_digest and expression = r_text")
    best = F.max_by(F.struct("r_text", "r_action"), F.struct(F.length("r_text"), F.length("r_host")))
    found = fits.groupBy("u").agg(best.alias("best")).select(F.col("u").alias("__ff_url"), "best")
    host, path = host_and_path(F.col("url").cast("string"))
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.join(found, pages["url"].cast("string") == found["__ff_url"], "left")
    return out.select(*own, host.alias("host"), path.alias("path"), F.col("best.r_text").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict"))
