"""Topic classification by keywords: per-row folds over literal arrays, no explode and no join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Weights, thresholds and special topics.
STRONG, WEAK, TITLE = 3.0, 1.0, 2.0
MIN_SHARE, MARGIN, FULLTEXT_CHARS = 0.25, 0.15, 20_000
MULTI, UNCLASSIFIED = "90_복수주제", "99_미분류_검토필요"
#: Topics that a source hints at, and the bonus.
HINTS = {
    "law_go_kr": "05_형사_수사_사법",
    "kicj": "05_형사_수사_사법",
    "jpri": "05_형사_수사_사법",
    "ioj": "05_형사_수사_사법",
    "humanrights": "06_헌법_인권",
    "kida": "03_국방정책_행정법",
    "arxiv": "08_AI_법률AI_디지털법",
}
HINT_BONUS, CURRENT_BONUS, MODEL_WEIGHT = 1.5, 1.0, 3.0


@dataclass(frozen=True)
class Topic:
    topic_id: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """Topics in registry order; the special ones take no part in scoring."""

    topics: tuple[Topic, ...] = field(default_factory=tuple)

    def classifiable(self) -> list[Topic]:
        return [t for t in self.topics if t.topic_id not in (MULTI, UNCLASSIFIED)]

    @classmethod
    def from_yaml(cls, path: str) -> Taxonomy:
        import yaml

        with open(path, encoding="utf-8") as f:
            rows = yaml.safe_load(f)["topics"]
        return cls(tuple(Topic(r["topic_id"], tuple(r.get("keywords_strong") or ()), tuple(r.get("keywords_weak") or ())) for r in rows))


def _keyword_score(title: Column, body: Column, keywords: tuple[str, ...], weight: float) -> Column:
    if not keywords:
        return F.lit(0.0)
    literal = F.array(*[F.lit(k.lower()) for k in keywords])
    hit = lambda k: F.when(F.contains(title, k), weight * TITLE).when(F.contains(body, k), weight).otherwise(0.0)
    return F.aggregate(literal, F.lit(0.0), lambda acc, k: acc + hit(k))


def topic_scores(taxonomy: Taxonomy, title: Column, body: Column) -> Column:
    """array<struct<topic, ord, score>> of topics with a score, in registry order.  title and body are
    lower-cased; a keyword counts once, double in the title."""

    def rows(x: Column) -> Column:
        score = lambda t: _keyword_score(x["title"], x["body"], t.strong, STRONG) + _keyword_score(x["title"], x["body"], t.weak, WEAK)
        return F.array(*[F.struct(F.lit(t.topic_id).alias("topic"), F.lit(i).alias("ord"), score(t).alias("score")) for i, t in enumerate(taxonomy.classifiable())])

    return F.filter(let(F.struct(title.alias("title"), body.alias("body")), rows), lambda x: x["score"] > 0)


def adjusted(scores: Column, current: Column | None, source: Column | None, model: Column | None = None) -> Column:
    """Bonuses: the current topic if it scored; the source's hinted topic, added if need be; a model's
    map of topic to value."""
    if current is not None:
        scores = F.transform(scores, lambda x: F.struct(x["topic"].alias("topic"), x["ord"].alias("ord"), (x["score"] + F.when(x["topic"] == current, CURRENT_BONUS).otherwise(0.0)).alias("score")))
    if source is not None:
        hinted = F.element_at(F.create_map(*[F.lit(v) for kv in HINTS.items() for v in kv]), source) if HINTS else F.lit(None)
        scores = _plus(scores, F.when(hinted.isNotNull(), F.array(F.struct(hinted.alias("topic"), F.lit(HINT_BONUS).alias("score")))), 1000)
    if model is not None:
        scores = _plus(scores, F.transform(F.map_entries(model), lambda e: F.struct(e["key"].alias("topic"), (e["value"] * MODEL_WEIGHT).alias("score"))), 2000)
    return scores


def _plus(scores: Column, more: Column, ord_from: int) -> Column:
    more = F.coalesce(more, F.array().cast("array<struct<topic:string,score:double>>"))

    def added(scores: Column, more: Column) -> Column:
        of = lambda t: F.aggregate(F.filter(more, lambda m: m["topic"] == t), F.lit(0.0), lambda a, m: a + m["score"])
        known = F.transform(scores, lambda x: F.struct(x["topic"].alias("topic"), x["ord"].alias("ord"), (x["score"] + of(x["topic"])).alias("score")))
        new = F.filter(more, lambda m: ~F.exists(scores, lambda x: x["topic"] == m["topic"]))
        return F.concat(known, F.transform(new, lambda m, i: F.struct(m["topic"].alias("topic"), (i + ord_from).alias("ord"), m["score"].alias("score"))))

    return let(scores, lambda s: let(more, lambda m: added(s, m)))


def decide(scores: Column) -> Column:
    """struct<topic_primary, topics, topic_confidence>: the best share of all scores, unclassified below
    MIN_SHARE, several topics where others come within MARGIN of it."""

    def ranked(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x["score"])
        return let(total, lambda t: F.sort_array(F.transform(s, lambda x: F.struct((-x["score"] / t).alias("minus"), x["ord"].alias("ord"), x["topic"].alias("topic")))))

    def body(r: Column) -> Column:
        top = -F.get(r, 0)["minus"]
        near = F.filter(r, lambda x: top + x["minus"] <= MARGIN)
        primary = F.when(F.size(r) == 0, UNCLASSIFIED).when(top < MIN_SHARE, UNCLASSIFIED).when(F.size(near) > 1, MULTI).otherwise(F.get(r, 0)["topic"])
        chosen = F.when((top >= MIN_SHARE) & (F.size(near) > 1), near).otherwise(F.slice(r, 1, 3))
        return F.struct(primary.alias("topic_primary"), F.transform(chosen, lambda x: x["topic"]).alias("topics"), F.round(F.coalesce(top, F.lit(0.0)), 4).alias("topic_confidence"), F.coalesce(top, F.lit(0.0)).alias("share"))

    return let(let(scores, ranked), body)


def classify(df: DataFrame, taxonomy: Taxonomy, fulltext: bool = False, model: Column | None = None) -> DataFrame:
    """Adds topic_primary, topics and topic_confidence to resources; with ``fulltext`` (second pass) its
    first 20,000 characters count too, and the topic of the first pass gets its bonus."""
    title = F.lower(F.trim(F.concat_ws(" ", F.coalesce("title_ko", F.lit("")), F.coalesce("title_original", F.lit("")))))
    parts = [F.coalesce("abstract_original", F.lit("")), F.concat_ws(" ", F.coalesce("keywords", F.array().cast("array<string>")))]
    if fulltext:
        parts.append(F.left(F.coalesce("fulltext", F.lit("")), F.lit(FULLTEXT_CHARS)))
    df = df.withColumns({"__title": title, "__body": F.lower(F.concat_ws(" ", *parts))})
    current = F.col("topic_primary") if fulltext and "topic_primary" in df.columns else None
    scores = adjusted(topic_scores(taxonomy, F.col("__title"), F.col("__body")), current, F.col("source_id"), model)
    df = df.withColumn("__decision", decide(scores))
    keep = [c for c in df.columns if c not in ("topic_primary", "topics", "topic_confidence", "__title", "__body", "__decision")]
    return df.select(*keep, "__decision.topic_primary", "__decision.topics", "__decision.topic_confidence")


#: A small taxonomy of function words for the synthetic documents, one topic a language.
DEMO = Taxonomy(
    (
        Topic("en", ("that", "from"), ("ther", "erin")),
        Topic("fr", ("dans", "avec"), ("ment",)),
        Topic("de", ("nicht", "sich"), ("keit",)),
        Topic("es", ("para",), ("ción",)),
    )
)
