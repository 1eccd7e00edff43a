"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NL = "chr(10)"


def _join(items: str, separator: str) -> str:
    return f"array_to_string({items}, '{separator}')"


def _fingerprint(t: str, block: int) -> str:
    parts = f"string_split({t}, {_NL} || {_NL})"
    lines = f"string_split(s, {_NL})"
    section = _join(f"list_transform({lines}, lambda p: sha256('p' || p))", "")
    root = "sha256('r' || " + _join(f"list_transform({parts}, lambda s: sha256('s' || {section}))", "") + ")"
    blocks = _join(f"list_transform(regexp_extract_all(p, '(?s).{{1,{block}}}'), lambda b: left(md5(b), 8))", "")
    leaves = _join(f"list_transform({parts}, lambda s: " + _join(f"list_transform({lines}, lambda p: {blocks})", ",") + ")", ";")
    return f"{root} || ':' || {leaves}"


def _likeness(a: str, b: str) -> str:
    blocks = lambda f: f"list_distinct(regexp_extract_all(regexp_replace(substr({f}, 66), '[,;]+', '', 'g'), '.{{8}}'))"
    x, y = blocks(a), blocks(b)
    return f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END::DOUBLE"


def fingerprints(block: int) -> str:
    x, y = "string_split(substr(fingerprint, 66), ';')", "string_split(substr(edited_fingerprint, 66), ';')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
    n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) nx, length(t) n FROM d),
    e AS (SELECT doc_id, n, t, nx, left(t, n - n // 3) || left(nx, n // 3) e FROM n),
    f AS (SELECT doc_id, n n_chars, sha256(e) edited_sha256, {_fingerprint("t", block)} fingerprint, {_fingerprint("e", block)} edited_fingerprint, {_fingerprint("nx", block)} nf FROM e)
    SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness("fingerprint", "edited_fingerprint")} near_edited, {_likeness("fingerprint", "nf")} near_next,
      array_to_string(list_filter(range(0, len({x})), lambda i: left(fingerprint, 64) <> left(edited_fingerprint, 64) AND NOT list_contains({y}, ({x})[i + 1])), ',') changed_sections FROM f"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS}) size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT ord FROM documents),
s AS (SELECT source, sum(size)::DOUBLE size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 w FROM d GROUP BY source),
r AS (SELECT *, 3 * size / w r, sum(size) OVER () total, sum(3 * size) OVER o - 3 * size used, sum(w) OVER () - (sum(w) OVER o - w) rest FROM s WINDOW o AS (ORDER BY 3 * size / w, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - used) / rest, r) FILTER ((total - used) / rest <= r) level FROM r),
t AS (SELECT source s, size source_size, least(3 * size, w * level) target, CASE WHEN size > 0 THEN floor(least(3 * size, w * level) / size) ELSE 0 END whole FROM s, l),
p AS (SELECT d.*, source_size, target, whole, target - whole * source_size - coalesce(sum(d.size) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) leftover FROM d JOIN t ON source IS NOT DISTINCT FROM s),
x AS (SELECT *, CASE WHEN size > 0 AND leftover >= size THEN 1 ELSE 0 END extra FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY source, ord ORDER BY extra DESC) cp FROM x),
m AS (SELECT source ms, any_value(target) - sum((whole + extra) * size) short FROM q GROUP BY source),
f(source, ord, cp, size, short, took) AS (SELECT source, ord, cp, size, short, FALSE FROM q JOIN m ON source IS NOT DISTINCT FROM ms WHERE short > 0 AND extra = 0 AND size > 0 AND whole + 1 <= 3 AND size <= short
  UNION ALL SELECT source, ord, cp, size, short - coalesce(sum(CASE WHEN t THEN size END) OVER (PARTITION BY source), 0), t FROM (
    SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY ord, cp ROWS UNBOUNDED PRECEDING) <= short t FROM (
      SELECT *, NOT bool_or(size <= short / 2) OVER (PARTITION BY source) OR size <= short / 2 fits FROM f WHERE NOT took AND size <= short))),
y AS (SELECT q.doc_id, q.source, q.ord, q.cp, q.size, source_size, target, whole, CASE WHEN e.ord IS NOT NULL THEN 1 ELSE extra END extra FROM q LEFT JOIN (SELECT * FROM f WHERE took) e ON q.source IS NOT DISTINCT FROM e.source AND q.ord = e.ord AND q.cp = e.cp),
n AS (SELECT source ns, any_value(target) - sum((whole + extra) * size) short FROM y GROUP BY source),
c AS (SELECT y.source cs, arg_min(ROW(ord, cp), ROW(abs(size - short), ord, cp)) co FROM y JOIN n ON y.source IS NOT DISTINCT FROM ns WHERE short > 0 AND extra = 0 AND size > 0 AND whole + 1 <= 3 AND size < 2 * short GROUP BY y.source)
SELECT doc_id, size, source_size::BIGINT source_size, round(target, 6) target, (size * (whole + extra + CASE WHEN co IS NOT NULL THEN 1 ELSE 0 END))::BIGINT taken FROM y LEFT JOIN c ON source IS NOT DISTINCT FROM cs AND ROW(ord, cp) = co"""


def url_filter(rules: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{a}', '{r}')" for a, r in rules)
    return f"""WITH r(action, rule) AS (VALUES {values}), q AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path, row_number() OVER () k FROM q),
    f AS (SELECT k, arg_max(rule, ROW(length(rule), length(split_part(rule, '/', 1)))) rule, arg_max(action, ROW(length(rule), length(split_part(rule, '/', 1)))) action
      FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY k)
    SELECT page_id, host, path, rule, coalesce(action, 'allow') verdict FROM p LEFT JOIN f USING (k)"""


LINES = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, source, coalesce(text, '') t, {_WORDS} ws, string_split(coalesce(text, ''), {_NL}) ls FROM documents),
g AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] g FROM d, unnest(range(1, len(ws) - 1)) u(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY r, g) n FROM g),
v AS (SELECT r, count(DISTINCT p) n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) p FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, doc_id, t, source, l FROM d, unnest(ls) u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
y AS (SELECT r, count(*) - count(DISTINCT l) n_dup_lines FROM l GROUP BY r),
k AS (SELECT r, doc_id, md5(t) t, source, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) k FROM l),
h AS (SELECT source hs, count(DISTINCT (coalesce(doc_id::VARCHAR, '-'), md5(t))) docs FROM d GROUP BY source),
o AS (SELECT source os, k ok FROM k JOIN h ON source IS NOT DISTINCT FROM hs GROUP BY source, k, docs HAVING count(DISTINCT (coalesce(doc_id::VARCHAR, '-'), t)) > greatest(50, docs * 0.002)),
z AS (SELECT r, count(*) lines, sum(len(k) - len(replace(k, ' ', '')) + 1) words FROM k JOIN o ON source IS NOT DISTINCT FROM os AND k = ok GROUP BY r),
a AS (SELECT doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
  coalesce(n_repeat_words, 0) n_repeat_words, coalesce(lines, 0)::BIGINT n_removed_lines, coalesce(words, 0)::BIGINT n_removed_words FROM d LEFT JOIN v USING (r) LEFT JOIN y USING (r) LEFT JOIN z USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.3 * n_words kept FROM a"""

ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') h, min(page_id) OVER (PARTITION BY coalesce(html, '')) first FROM pages)
SELECT page_id, strlen(h)::BIGINT payload_bytes, sha256(h) payload_digest, CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END refers_to FROM p"""


def licenses(phrases: dict[tuple[str, ...], str], templates: dict[str, str]) -> str:
    """Templates as regular expressions over the words, each after a blank."""
    import re

    def pattern(markup: str) -> str:
        out = ""
        for k, piece in enumerate(re.split(r"<<(.*?)>>", markup)):
            if k % 2 == 0:
                out += "".join(f" {w}" for w in re.findall(r"[a-z0-9]+", piece.lower()))
            else:
                kind = piece.split(";")[0]
                out += "(?:" if kind == "beginOptional" else ")?" if kind == "endOptional" else "(?: [^ ]+)" + {".*": "*", ".+": "+"}[piece.split("match=")[1]]
        return out + " "

    places = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))})" for p in phrases)
    base = " || ".join(f"CASE WHEN contains(t, ' {' '.join(p)} ') THEN ['{label}'] ELSE []::VARCHAR[] END" for p, label in phrases.items())
    own = " || ".join(f"CASE WHEN regexp_matches(t, '{pattern(m)}') THEN ['{label}'] ELSE []::VARCHAR[] END" for label, m in templates.items())
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
    t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' t FROM d), l AS (SELECT doc_id, w, {places} p, {base} b, {own} o FROM t)
    SELECT doc_id, len(w) n_words, len(p) n_base, list_min(p) - 1 first_word, list_max(p) - 1 last_word, array_to_string(list_sort(list_distinct(b)), ',') base_labels,
      array_to_string(list_sort(list_distinct(b || o)), ',') labels, CASE WHEN len(o) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE score FROM l"""


NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], chr(1)) g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
f AS (SELECT a x, b y FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT f.y, r.c FROM r JOIN f ON f.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) n_shingles, min(c) component_id, doc_id = min(c) kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


#: Of the pages' own markup: what is no article, what ends a block, and the character references in use.
_NO_ARTICLE = ["<head>.*?</head>", "<nav>.*?</nav>", "<!--.*?(?:-->|$)", '<div class="ad">.*?</div>', "<footer>.*?(?:</footer>|$)", "<script>.*?</script>", "<style>.*?</style>"]
_REFERENCES = {"quot": '"', "lt": "<", "gt": ">", "copy": "©", "middot": "·", "amp": "&"}


def main_text() -> str:
    t = "coalesce(html, '')"
    for part in _NO_ARTICLE:
        t = f"regexp_replace({t}, '{part}', '', 'gs')"
    block = f"regexp_replace(b, '(?s)<br>', ' ', 'g')"  # noqa: F541
    block = f"regexp_replace({block}, '(?s)<(?:/?[a-zA-Z][^>]*)(?:>|$)', '', 'g')"
    for name, sign in _REFERENCES.items():
        block = f"regexp_replace({block}, '&{name};?', '{sign}', 'g')"
    block = f"trim(regexp_replace({block}, '\\s+', ' ', 'g'))"
    return rf"""WITH p AS (SELECT page_id, url, regexp_extract({t}, '(?s)<article>(.*?)(?:</article>|$)', 1) t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(t, '(?:</?(?:p|h1)>)+'), lambda b: {block}), lambda b: b <> '') b FROM p)
SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') text, length(coalesce(array_to_string(b, chr(10) || chr(10)), ''))::BIGINT n_chars FROM b"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    nearest = lambda k: f"""d{k} AS (SELECT r, part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM p JOIN b{k} USING (part)),
a{k} AS (SELECT r, part, arg_min(e, ROW(d, e)) e, min(d) d FROM d{k} GROUP BY r, part)"""  # noqa: E731
    steps = []
    for k in range(rounds):
        steps.append(f"""{nearest(k)},
s{k} AS (SELECT part, e, j, sum(x[j])::BIGINT s, count(*) n FROM a{k} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) u(j) GROUP BY part, e, j),
m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) m FROM s{k} GROUP BY part, e),
b{k + 1} AS (SELECT part, e, coalesce(m, c) c FROM b{k} LEFT JOIN m{k} USING (part, e))""")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) v, row_number() OVER () r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, v, i part, v[i * (len(v) // {parts}) + 1:(i + 1) * (len(v) // {parts})] x FROM k, unnest(range({parts})) u(i)),
b0 AS (SELECT part, e, x c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, v) - 1 e FROM p) WHERE e < {entries}),
{", ".join(steps)},
{nearest(rounds)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) code, sum(d)::BIGINT error FROM a{rounds} GROUP BY r),
l AS (SELECT label, sum(error)::BIGINT label_error FROM o JOIN k USING (r) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN k USING (r) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"""


#: CRC-32 is linear: a byte's share depends on its value and its distance from the end alone (table m), the length's on the length (table c).
SPELLING = rf"""WITH RECURSIVE b(v, i, x) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT v, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM b WHERE i < 8),
t AS (SELECT v, x::BIGINT x FROM b WHERE i = 8),
m(k, v, x) AS (SELECT 0, v, x FROM t UNION ALL SELECT k + 1, m.v, xor(t.x, m.x >> 8) FROM m JOIN t ON t.v = m.x & 255 WHERE k < 120),
c(k, x) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT k + 1, xor(t.x, c.x >> 8) FROM c JOIN t ON t.v = c.x & 255 WHERE k < 120),
r AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) w FROM documents) GROUP BY doc_id, w),
i AS (SELECT *, row_number() OVER () i, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) h FROM r),
y AS (SELECT i, len(h) // 2 - 1 - j k, ('0x' || h[2 * j + 1:2 * j + 2])::BIGINT v FROM i, unnest(range(len(h) // 2)) u(j)),
z AS (SELECT i, bit_xor(x) x FROM y JOIN m USING (k, v) GROUP BY i),
f AS (SELECT w, n, xor(xor(z.x, c.x), 4294967295) h FROM i JOIN z USING (i) JOIN c ON c.k = len(i.h) // 2),
words AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END word, sum(n)::BIGINT n FROM f GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
s AS (SELECT word, n, q, left(word, q - 1) || substr(word, q + 1) s FROM words, unnest(range(1, length(word) + 1)) u(q)),
e AS (SELECT a.word a, b.word b, b.n n FROM s a JOIN s b ON a.s = b.s AND a.q = b.q AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM (SELECT DISTINCT word, s FROM s) a JOIN words b ON b.word = a.s
  UNION ALL SELECT b.word, a.word, a.n FROM (SELECT DISTINCT word, s, n FROM s) a JOIN words b ON b.word = a.s),
g AS (SELECT a, count(*) n_near, arg_min(b, ROW(-n, b)) b, max(n) m FROM e GROUP BY a),
o AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN m >= 10 * n THEN b END form, CASE WHEN m >= 10 * n THEN m END form_n FROM words LEFT JOIN g ON word = a),
v(word, root) AS (SELECT word, word FROM o UNION ALL SELECT v.word, o.form FROM v JOIN o ON o.word = v.root WHERE o.form IS NOT NULL)
SELECT o.word, o.form, v.root, o.n, o.n_near, o.form_n FROM o JOIN v ON v.word = o.word JOIN o l ON l.word = v.root WHERE l.form IS NULL"""
