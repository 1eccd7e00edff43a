"""Extractive summaries: sentences as arrays, token frequencies as one map a document; no shuffle."""

from __future__ import annotations

import heapq
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, let, text_of

#: Marks of sentences, words that don't count.
PRACTICAL = ["실무", "적용", "시사점", "제언", "개선", "쟁점", "판단", "기준", "절차", "필요", "해석", "문제", "practice", "implication", "recommend", "should", "framework"]
EDUCATION = ["교육", "훈련", "사례", "교재", "커리큘럼", "학습", "교수", "training", "education", "curriculum", "case study"]
CAVEATS = ["한계", "제한", "다만", "그러나", "유의", "주의", "limitation", "however", "caveat"]
STOPWORDS = [
    "그리고", "그러나", "또한", "이는", "이를", "위한", "대한", "통해", "있는", "있다",
    "한다", "하는", "된다", "되는", "the", "and", "for", "this", "that", "with", "from",
    "are", "was", "were", "have", "has", "その", "이러한", "따라", "관한", "경우",
]
SHORTEST, LONGEST, POINTS, FULLTEXT_CHARS, LEAD, LEAD_BONUS = 25, 400, 5, 40_000, 0.2, 0.15
_BREAK = r"(?U)(?<=[.!?。])\s+|(?<=다\.)\s+|\n+"


def basis(fulltext: Column, failed: Column, abstract: Column) -> Column:
    return F.when((text_of(fulltext) != "") & ~F.coalesce(failed, F.lit(False)), "FULLTEXT").when(text_of(abstract) != "", "ABSTRACT").otherwise("METADATA_ONLY")


def sentences(text: Column) -> Column:
    """Cleaned sentences of 25 to 400 characters that aren't just numbers."""
    cleaned = F.transform(F.split(text_of(text), _BREAK), clean_whitespace)
    return F.filter(cleaned, lambda s: F.length(s).between(SHORTEST, LONGEST) & ~s.rlike(r"^[0-9\s.\-–—]+$"))


def tokens(sentence: Column) -> Column:
    """Words of two Hangul syllables or three letters, repeats kept."""
    found = F.regexp_extract_all(F.lower(sentence), F.lit("[가-힣]{2,}|[A-Za-z]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def ranked_sentences(kept: Column) -> Column:
    """array<struct<minus, pos, sentence>>, best first: mean frequency of a sentence's tokens relative to
    the most frequent token, plus a bonus in the first fifth; ties by position."""

    def rank(s: Column) -> Column:
        parts = F.transform(s, lambda x, i: F.struct(x.alias("s"), i.alias("i"), tokens(x).alias("t")))

        def weigh(p: Column) -> Column:
            # All tokens sorted, so that equal ones stand together: a run's length is its token's frequency.  What each
            # token weighs is then sorted by sentence, and each sentence's run summed up: no look-up, n log n in all.
            every = F.sort_array(F.flatten(F.transform(p, lambda x: F.transform(x["t"], lambda t: F.struct(t.alias("t"), x["i"].alias("i"))))))

            def counted(e: Column) -> Column:
                length = lambda b, k, at: F.coalesce(F.get(b, k + 1), F.size(e)) - at
                counts = let(starts(e, "t"), lambda b: F.flatten(F.transform(b, lambda at, k: F.array_repeat(length(b, k, at), length(b, k, at)))))
                return let(counts, lambda c: let(F.sort_array(F.zip_with(e, c, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n")))), lambda w: scored(w, F.array_max(c))))

            def scored(w: Column, peak: Column) -> Column:
                def one(b: Column, at: Column, k: Column) -> Column:
                    n, i = F.coalesce(F.get(b, k + 1), F.size(w)) - at, F.get(w, at)["i"]
                    total = F.aggregate(F.slice(w, at + 1, n), F.lit(0).cast("long"), lambda a, x: a + x["n"])
                    bonus = F.when(i < F.size(s) * F.lit(LEAD), LEAD_BONUS).otherwise(0.0)
                    return F.struct((-(total.cast("double") / peak / n + bonus)).alias("minus"), i.alias("pos"), F.get(p, i)["s"].alias("sentence"))

                return F.sort_array(let(starts(w, "i"), lambda b: F.transform(b, lambda at, k: one(b, at, k))))

            plain = F.transform(p, lambda x: F.struct(F.lit(0.0).alias("minus"), x["i"].alias("pos"), x["s"].alias("sentence")))
            return let(every, lambda e: F.when(F.size(e) == 0, plain).otherwise(counted(e)))

        return let(parts, weigh)

    return let(kept, rank)


_TOKEN, _STOP = re.compile("[가-힣]{2,}|[A-Za-z]{3,}"), frozenset(STOPWORDS)


def _best(kept: list[str], limit: int) -> list[int]:
    said = [[t for t in _TOKEN.findall(s.lower()) if t not in _STOP] for s in kept]
    counts = Counter(t for ts in said for t in ts)
    if not counts:
        return list(range(min(limit, len(kept))))
    peak, lead = max(counts.values()), len(kept) * LEAD
    scored = ((-(sum(map(counts.__getitem__, ts)) / peak / len(ts) + (LEAD_BONUS if i < lead else 0.0)), i) for i, ts in enumerate(said) if ts)
    return [i for _, i in heapq.nsmallest(limit, scored)]


def best_sentences(kept: Column, limit: int) -> Column:
    """Places (from 0) of the ``limit`` best of ``ranked_sentences``: the same weights, counted in a table of a
    document's tokens in Python."""

    @F.arrow_udf("array<int>")
    def places(rows):
        import pyarrow as pa

        return pa.array([_best(x.as_py() or [], limit) for x in rows], pa.list_(pa.int32()))

    return places(kept)


def starts(rows: Column, field: str) -> Column:
    """Where runs of an equal field begin in a sorted array of structs."""
    return F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (F.get(rows, i - 1)[field] != x[field]), i)), lambda i: i.isNotNull())


def having(kept: Column, markers: list[str], limit: int) -> Column:
    """The first sentences that contain any marker."""
    literal = F.array(*[F.lit(m) for m in markers])
    return F.slice(F.filter(kept, lambda s: let(F.lower(s), lambda low: F.exists(literal, lambda m: F.contains(low, m)))), 1, limit)


def headline(sentence: Column) -> Column:
    return F.when(F.length(sentence) <= 160, sentence).otherwise(F.concat(F.left(sentence, F.lit(157)), F.lit("…")))


def summarize(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds summary_basis, headline, key_points, practical_meaning, education_points and caveats from
    fulltext (first 40,000 characters) or the abstract; nulls where only metadata are known.  ``wanted``: rows
    that are summarised, if not all; the others get their basis alone."""
    kind = basis(F.col("fulltext"), F.col("text_extract_failed"), F.col("abstract_original"))
    body = F.when(kind == "FULLTEXT", F.left("fulltext", F.lit(FULLTEXT_CHARS))).when(kind == "ABSTRACT", F.col("abstract_original")).otherwise("")
    body = body if wanted is None else F.when(wanted, body).otherwise("")
    df = df.withColumns({"summary_basis": kind, "__kept": sentences(body)}).withColumn("__best", best_sentences(F.col("__kept"), POINTS))
    points = F.transform("__best", lambda i: F.get("__kept", i))
    return df.withColumns(
        {
            "headline": headline(F.get(points, 0)),
            "key_points": points,
            "practical_meaning": F.get(having(F.col("__kept"), PRACTICAL, 1), 0),
            "education_points": having(F.col("__kept"), EDUCATION, 2),
            "caveats": F.get(having(F.col("__kept"), CAVEATS, 1), 0),
        }
    ).drop("__kept", "__best")


def markdown(df: DataFrame) -> Column:
    """Summary sections as text, empty ones skipped."""
    bullets = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.lit("- "), s)), "\n")
    section = lambda title, c: F.when(text_of(c) != "", F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws("\n\n", section("요지", df["headline"]), section("핵심", bullets(df["key_points"])), section("실무", df["practical_meaning"]), section("교육", bullets(df["education_points"])), section("한계", df["caveats"]))


def page_of(pages: Column, sentence: Column) -> Column:
    """Number (from 1) of the first page that contains a sentence's first 60 characters; null without."""
    head = F.lower(F.left(sentence, F.lit(60)))
    return F.nullif(F.array_position(F.transform(pages, lambda p: F.contains(F.lower(p), head)), True), F.lit(0))


#: What a summary says where the text says nothing.
NO_PRACTICE, NO_CAVEAT = "원문에서 실무 적용에 관한 명시적 서술을 찾지 못했습니다.", "원문에 명시된 제한사항은 확인되지 않았습니다."
NO_TEXT, ONLY_METADATA = "원문·초록을 확보하지 못해 내용 분석을 수행하지 않았습니다.", "서지정보만으로 판단한 결과이므로 원문 확인이 필요합니다."
SCOPES = {"ABSTRACT": "초록 기준 (원문 전체 미분석)", "METADATA_ONLY": "제목·키워드·서지정보 기준"}


def evidence_scope(kind: Column, pages: Column, points: Column) -> Column:
    """Which pages (array of texts) a summary of the full text rests on, else what it rests on."""
    at = F.filter(F.transform(points, lambda s: page_of(pages, s)), lambda p: p.isNotNull())
    count = F.size(F.coalesce(pages, F.array().cast("array<string>"))).cast("string")
    range_ = F.concat(F.lit("원문 "), count, F.lit("쪽 중 "), F.array_min(at).cast("string"), F.lit("~"), F.array_max(at).cast("string"), F.lit("쪽 기준"))
    out = F.when(F.size(at) > 0, range_).otherwise(F.concat(F.lit("원문 전체 "), count, F.lit("쪽 기준")))
    return F.when(kind == "FULLTEXT", out).when(kind == "ABSTRACT", SCOPES["ABSTRACT"]).otherwise(SCOPES["METADATA_ONLY"])


def summary_record(df: DataFrame) -> DataFrame:
    """``summarize`` with every part filled: fallbacks where the text has no such sentence, a summary of
    the metadata where there is no text, and evidence_scope.  Also reads title_original, title_ko,
    publisher, source_id, publication_date, document_type, topic_primary and pages (array of texts)."""
    df = summarize(df)
    title = F.coalesce(F.nullif(F.col("title_ko"), F.lit("")), F.nullif(F.col("title_original"), F.lit("")), F.lit("(제목 없음)"))
    by = F.coalesce(F.nullif(F.col("publisher"), F.lit("")), F.col("source_id"))
    teach = F.array(F.concat(F.lit("'"), F.left(title, F.lit(60)), F.lit("' 는 "), F.col("topic_primary"), F.lit(" 분야 교육자료의 배경지식·참고문헌으로 활용할 수 있습니다.")))
    bare = F.col("summary_basis") == "METADATA_ONLY"
    facts = F.array(F.concat(F.lit("발행기관: "), by), F.concat(F.lit("발행일: "), F.coalesce(F.col("publication_date").cast("string"), F.lit("미상"))), F.concat(F.lit("문서유형: "), F.col("document_type")))
    scope = evidence_scope(F.col("summary_basis"), F.col("pages"), F.col("key_points"))
    return df.withColumns(
        {
            "evidence_scope": scope,
            "headline": F.when(bare, F.concat(by, F.lit(" 발간 '"), title, F.lit("'"))).otherwise(F.coalesce("headline", title)),
            "key_points": F.when(bare, facts).otherwise(F.col("key_points")),
            "practical_meaning": F.when(bare, NO_TEXT).otherwise(F.coalesce("practical_meaning", F.lit(NO_PRACTICE))),
            "education_points": F.when(bare | (F.size("education_points") == 0), teach).otherwise(F.col("education_points")),
            "caveats": F.when(bare, ONLY_METADATA).otherwise(F.coalesce("caveats", F.lit(NO_CAVEAT))),
        }
    )
