"""Text functions of catalogue records, as Column -> Column.  Null counts as an empty string."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Document types and the substrings that give them, tested in this order.
DOCUMENT_TYPES = [
    ("법령", ["법률", "시행령", "시행규칙", "법령", "act", "statute", "decree"]),
    ("판례", ["판례", "판결", "선고", "case law", "judgment", "precedent"]),
    ("실무제요", ["실무제요", "실무편람", "handbook"]),
    ("매뉴얼", ["매뉴얼", "manual", "가이드북", "guidebook", "guide"]),
    ("지침", ["지침", "훈령", "예규", "guideline", "directive"]),
    ("연구보고서", ["연구보고서", "정책연구", "research report", "report", "working paper"]),
    ("학술논문", ["논문", "journal", "article", "학회지", "연구논문"]),
    ("정책자료", ["정책", "policy", "brief", "이슈페이퍼"]),
    ("프리프린트", ["preprint", "프리프린트", "arxiv", "ssrn"]),
    ("간행물", ["간행물", "뉴스레터", "newsletter", "bulletin", "계간", "월간"]),
]
OTHER_TYPE = "기타"
_DOI = r"(?i)10\.[0-9]{4,9}/[-._;()/:a-z0-9]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC: the one text function without a built-in.  ASCII rows skip nothing but cost."""
    return _nfkc(c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: what stands inside a lambda is computed at every call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether some needle is a substring.  One native expression, no regular expression."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def first_contained(c: Column, needles: list[str]) -> Column:
    """The first needle in list order that is a substring; null without one."""
    out = F.lit(None).cast("string")
    for n in reversed(needles):
        out = F.when(F.contains(c, F.lit(n)), n).otherwise(out)
    return out


def normalize_doi(c: Column) -> Column:
    """The first DOI in a string, in lower case, without trailing ``.,;``; empty without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(text_of(c)), _DOI, 0)), "[.,;]+$", "")


def doi_url(c: Column) -> Column:
    return F.when(text_of(c) == "", "").otherwise(F.concat(F.lit("https://doi.org/"), c))


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def normalize_text(c: Column, unicode_form: bool = True) -> Column:
    """Compatibility form, lower case, blanks squeezed.  ``unicode_form=False`` stays in the JVM, for
    text that is known to be in that form."""
    c = text_of(c)
    return clean_whitespace(F.lower(nfkc(c) if unicode_form else c))


def text_sha256(c: Column, unicode_form: bool = True) -> Column:
    n = normalize_text(c, unicode_form)
    return F.when(n == "", "").otherwise(F.sha2(n, 256))


def normalize_title(c: Column, unicode_form: bool = True) -> Column:
    """As ``normalize_text``, punctuation (but ``_``) turned into blanks."""
    c = text_of(c)
    return clean_whitespace(F.regexp_replace(F.lower(nfkc(c) if unicode_form else c), r"(?U)[^\w\s가-힣]", " "))


def title_tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def strip_tags(c: Column) -> Column:
    return clean_whitespace(F.regexp_replace(text_of(c), "<[^>]+>", " "))


def page_title(html: Column) -> Column:
    """Content of the first <title>, inner tags as blanks; empty without one."""
    inner = F.regexp_replace(F.regexp_extract(text_of(html), "(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


def document_type(*texts: Column) -> Column:
    """The first type with a substring in the texts, lower-cased and joined by blanks."""
    hay = F.lower(F.array_join(F.filter(F.array(*texts), lambda t: F.coalesce(t, F.lit("")) != ""), " "))
    out = F.lit(OTHER_TYPE)
    for name, needles in reversed(DOCUMENT_TYPES):
        out = F.when(contains_any(hay, needles), name).otherwise(out)
    return out


def language(c: Column) -> Column:
    """ko if Hangul syllables are at least a quarter of ASCII letters (and one), en else; empty without
    either."""
    hangul = F.length(F.regexp_replace(text_of(c), "[^가-힣]+", ""))
    latin = F.length(F.regexp_replace(text_of(c), "[^A-Za-z]+", ""))
    return F.when((hangul == 0) & (latin == 0), "").when(hangul >= F.greatest(F.lit(1), F.floor(latin / 4)), "ko").otherwise("en")


def work_id(doi: Column, identifier: Column, normalized_title: Column, year: Column) -> Column:
    basis = F.concat(text_of(normalized_title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return (
        F.when(text_of(doi) != "", F.concat(F.lit("doi:"), doi))
        .when(text_of(identifier) != "", F.concat(F.lit("id:"), identifier))
        .otherwise(F.concat(F.lit("title:"), F.left(F.sha2(basis, 256), F.lit(16))))
    )


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def mask_secret(c: Column) -> Column:
    """Stars but for two characters at each end; all stars up to four characters."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2))))


#: Names whose values are credentials in URLs, and other shapes of them; the first group stays.
SECRET_SHAPES = [
    r"""(?i)(api[_-]?key=|serviceKey=|access_token=|&key=|token=|OC=)[^&\s"']+""",
    r"(?i)(Bearer\s+)\S+",
    r"""(?i)((?:api[_-]?key|servicekey|auth_?key|access_?token|token|secret|password|passwd|pwd)\s*[=:]\s*)[^\s&"',;*]+""",
    r"(?i)(authorization\s*[:=]\s*(?:basic|token)?\s*)(?!bearer)[A-Za-z0-9._~+/=-]+",
    r"(https?://[^/\s:@]+:)[^@\s/]+(?=@)",
]


def mask_secrets(c: Column, known: list[str] = ()) -> Column:
    """Values that look like credentials replaced by ***, keys kept; ``known`` values (of six characters
    or more) wherever they stand."""
    for shape in SECRET_SHAPES:
        c = F.regexp_replace(c, shape, "$1***")
    for value in sorted({v.strip() for v in known if len(v.strip()) >= 6}, key=len, reverse=True):
        c = F.replace(c, F.lit(value), F.lit("***"))
    return c


def best_title(ko: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(ko, F.lit("")), F.nullif(original, F.lit("")), F.lit("(제목 없음)"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; empty without one."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def filename_part(c: Column) -> Column:
    """Without control and reserved characters, blanks as single ``_``, ends trimmed of ``._-``."""
    c = F.regexp_replace(text_of(c), r"[\x00-\x1f\x7f]", "")
    c = F.regexp_replace(c, r'[\\/:*?"<>|]', "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", "_"), "_+", "_")
    return F.regexp_replace(c, "^[._-]+|[._-]+$", "")


#: Names that a file system reserves, the title's share of a file name and its longest length.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{n}{i}" for n in ("COM", "LPT") for i in range(1, 10))]
TITLE_CHARS, NAME_CHARS, UNTITLED, NO_SOURCE = 80, 160, "무제", "UNKNOWN"


def build_filename(day: Column, source: Column, title: Column, extension: str = ".pdf", longest: int = TITLE_CHARS, suffix: Column | None = None, whole: int = NAME_CHARS) -> Column:
    """yyMMdd_SOURCE_title[__suffix].ext: at most ``longest`` characters of the title, reserved names with
    ``_`` before them; of a name over ``whole`` characters the title is cut, to 8 at least."""
    name = F.left(filename_part(title), F.lit(longest))
    name = F.when(name == "", UNTITLED).when(F.upper(name).isin(RESERVED_NAMES), F.concat(F.lit("_"), name)).otherwise(name)
    origin = F.upper(filename_part(source))
    head = F.concat(F.date_format(day, "yyMMdd"), F.lit("_"), F.when(origin == "", NO_SOURCE).otherwise(origin), F.lit("_"))
    tail = F.lit("") if suffix is None else F.when(text_of(suffix) == "", "").otherwise(F.concat(F.lit("__"), suffix))
    over = F.length(head) + F.length(name) + F.length(tail) + len(extension) - whole
    name = F.when(over > 0, F.left(name, F.greatest(F.lit(8), F.length(name) - over))).otherwise(name)
    return F.concat(head, name, tail, F.lit(extension))


def authors_from_string(c: Column) -> Column:
    """Names split at ``;``, ``,``, ``·`` or the word and."""
    return F.filter(F.transform(F.split(text_of(c), r"[;,·]|\band\b"), clean_whitespace), lambda x: x != "")


def authors_from_structs(c: Column) -> Column:
    """Names of an array of structs with any of name, display_name, given, family."""
    return F.filter(F.transform(c, lambda a: clean_whitespace(F.coalesce(F.nullif(a["name"], F.lit("")), F.nullif(a["display_name"], F.lit("")), F.concat_ws(" ", a["given"], a["family"])))), lambda x: x != "")


def abstract_from_index(c: Column) -> Column:
    """Text of an inverted index (word to positions): words by position, then by word."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def distinct_ignoring_case(c: Column) -> Column:
    """Trimmed strings in order, the first spelling of each kept, empty ones dropped."""
    some = F.transform(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))

    def first(rows: Column) -> Column:  # sorted by spelling without case, so that equal ones stand together
        kept = F.filter(F.transform(rows, lambda r, i: F.when((i == 0) | (F.get(rows, i - 1)["k"] != r["k"]), F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r.isNotNull())
        return F.transform(F.array_sort(kept), lambda r: r["x"])

    return F.get(F.transform(F.array(F.array_sort(some)), first), 0)


def json_block(c: Column) -> Column:
    """The outermost ``{...}`` of a text as VARIANT, null if it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))
