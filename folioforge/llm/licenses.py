"""License scans: phrases of names, and template markup compiled into token automata.

A template's words must occur as written (letter case and punctuation aside), but for
``<<beginOptional>>..<<endOptional>>``, which may be missing, and ``<<var;match="..">>``, in whose place
words may stand that the expression fully matches, as they are compared: in lower case, with one blank
between.  A template compiles into a nondeterministic automaton over words, determinised lazily over the
words that the templates know; one pass over a text finds the templates that match somewhere in it.
"""

from __future__ import annotations

import re
import re._constants as sre_constants
import re._parser as sre
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEXTS

#: The names counted as base places, with their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder;match=.+>> nor the names of <<var;name=contributors;match=.+>> may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY <<var;name=holders;match=.+>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;match=.+>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _header(name: str, version: str) -> str:
    """The grant of the FSF's standard header."""
    return (
        f"redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> "
        f"<<beginOptional>>either<<endOptional>> version {version}"
    )


#: Wordings of public licences, of their standard headers and of the usual notices that name them.
TEMPLATES = {
    "apache-2.0": "<<beginOptional>>Licensed under the<<endOptional>> Apache License<<beginOptional>>,<<endOptional>> Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use <<var;name=work;match=.+>> except in compliance with the License. You may obtain "
    "a copy of the License at <<var;name=address;match=.+>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_3 + _BSD_END,
    "cc-by-nc-4.0": "<<beginOptional>>Licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC 4.0",
    "gpl-2.0-header": _header("General Public License", "2"),
    "gpl-3.0": "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License<<beginOptional>>,<<endOptional>> "
    "<<beginOptional>>as published by the Free Software Foundation,<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-3.0-header": _header("General Public License", "3"),
    "isc": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=author;match=.+>> DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=liable;match=.+>> BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
    "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1-header": _header("Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _header("Lesser General Public License", "3"),
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"<<var;name=software;original=Software;match=.+>>\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all "
    "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=liable;match=.*>> BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "<<beginOptional>>Released under<<endOptional>> the MIT License",
    **TEXTS,
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_IS_WORD = bytes(int(0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80) for c in range(256))
_MARK = re.compile(r"<<(.*?)>>")
_MATCH = re.compile(r"""match=(?:"([^"]*)"|([^;>]*))""")
_MAX_STATES = 50_000


def words(text: str) -> list[str]:
    """Words of a text after A-Z were lower-cased."""
    return _WORD.findall(text.translate(_LOWER))


def count_words(text: str) -> int:
    """len(words(text)), by its bytes."""
    if not text:
        return 0
    flag = np.frombuffer(text.encode("utf-8").translate(_IS_WORD), dtype=np.int8)
    return int(flag[0]) + int(np.count_nonzero(flag[1:] > flag[:-1]))


class Expression:
    """A replaceable region's expression as a nondeterministic automaton over characters, to be fed word by
    word with blanks between.  Case is ignored; look-around and back-references are errors."""

    def __init__(self, pattern: str):
        self.moves: list[list[tuple]] = []  # by state: (test of a character, state)
        self.free: list[list[int]] = []
        self.start = self._state()
        self.end = self._build(sre.parse(pattern, re.IGNORECASE | re.DOTALL), self.start)

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _build(self, items, at: int) -> int:
        for kind, value in items:
            name = str(kind)
            if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN", "CATEGORY"):
                to = self._state()
                self.moves[at].append((_tester(name, value), to))
                at = to
            elif name == "SUBPATTERN":
                at = self._build(value[-1], at)
            elif name == "BRANCH":
                to = self._state()
                for branch in value[1]:
                    own = self._state()
                    self.free[at].append(own)
                    self.free[self._build(branch, own)].append(to)
                at = to
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, body = value
                for _ in range(least):
                    at = self._build(body, at)
                to = self._state()
                if most == sre_constants.MAXREPEAT:
                    again = self._state()
                    self.free[at].append(again)
                    self.free[self._build(body, again)].append(again)
                    self.free[again].append(to)
                else:
                    self.free[at].append(to)
                    for _ in range(most - least):
                        at = self._build(body, at)
                        self.free[at].append(to)
                at = to
            elif name != "AT":
                raise ValueError(f"{name} in an expression")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.free[s]
        return frozenset(seen)

    def feed(self, states: frozenset[int], text: str) -> frozenset[int]:
        for c in text:
            states = self.closure([to for s in states for test, to in self.moves[s] if test(c)])
            if not states:
                break
        return states


def _tester(name: str, value):
    if name == "ANY":
        return lambda c: True
    if name in ("LITERAL", "NOT_LITERAL"):
        own = {chr(value).lower(), chr(value).upper()}
        return lambda c: (c in own) == (name == "LITERAL")
    if name == "CATEGORY":
        kind = str(value).removeprefix("CATEGORY_")
        test = {"DIGIT": str.isdigit, "SPACE": str.isspace, "WORD": lambda c: c.isalnum() or c == "_"}[kind.removeprefix("NOT_")]
        return lambda c: test(c) != kind.startswith("NOT_")
    parts, negated = [], False
    for kind, v in value:
        if str(kind) == "NEGATE":
            negated = True
        elif str(kind) == "RANGE":
            parts.append(lambda c, lo=chr(v[0]), hi=chr(v[1]): lo <= c <= hi or lo <= c.upper() <= hi)
        else:
            parts.append(_tester(str(kind), v))
    return lambda c: any(p(c) for p in parts) != negated


class TokenAutomata:
    """Templates as one lazily determinised automaton over words; its alphabet is the templates' words and "any
    other word", and within a replaceable region whose expression looks at the text, that word itself.

    A state is (place, None), or (place, (characters' states, whether a word has been read)) within such a region.
    A region of any words (``.+``, ``.*`` or none given) is a loop, however many they are; ``var_words`` bounds it."""

    def __init__(self, templates: dict[str, str], var_words: int | None = None):
        self.var_words = var_words
        self.moves: list[dict[str | None, list[int]]] = []  # by place: word, or None for any, to places
        self.free: list[list[int]] = []  # by place: places reached without a word
        self.regions: dict[int, tuple[Expression, int]] = {}  # by place: the expression that begins there, its end
        self.accepts: dict[int, str] = {}
        self.must: dict[str, list[str]] = {}
        starts = []
        for label, markup in sorted(templates.items()):
            at = self._state()
            starts.append(at)
            open_, runs = [], [[]]
            for k, piece in enumerate(_MARK.split(markup)):
                if k % 2 == 0:
                    for w in words(piece):
                        to = self._state()
                        self.moves[at].setdefault(w, []).append(to)
                        at = to
                        if not open_:
                            runs[-1].append(w)
                    continue
                kind = piece.split(";")[0].strip()
                if kind == "beginOptional":
                    open_.append(at)
                elif kind == "endOptional":
                    self.free[open_.pop()].append(at)
                elif kind == "var":
                    found = _MATCH.search(piece)
                    at = self._region(at, (found[1] if found[1] is not None else found[2].strip()) if found else ".+")
                else:
                    raise ValueError(f"unknown mark {piece!r} in {label}")
                runs.append([])
            if open_:
                raise ValueError(f"an optional part of {label} isn't closed")
            self.accepts[at] = label
            self.must[label] = max(runs, key=len)
        self.runs = [f" {' '.join(m)} " for m in self.must.values()]
        self.rarest = {max(m, key=len) for m in self.must.values() if m}
        self.known = {w for m in self.moves for w in m if w is not None}
        self.start = self._closure([(s, None) for s in starts])
        self._forget()

    def _state(self) -> int:
        self.moves.append({})
        self.free.append([])
        return len(self.moves) - 1

    def _region(self, at: int, pattern: str) -> int:
        end = self._state()
        if pattern in (".+", ".*") and self.var_words is not None:
            for k in range(self.var_words + 1):
                if k or pattern == ".*":
                    self.free[at].append(end)
                if k < self.var_words:
                    to = self._state()
                    self.moves[at].setdefault(None, []).append(to)
                    at = to
        elif pattern in (".+", ".*"):
            loop = self._state()
            self.moves[at].setdefault(None, []).append(loop)
            self.moves[loop].setdefault(None, []).append(loop)
            self.free[loop].append(end)
            if pattern == ".*":
                self.free[at].append(end)
        else:
            self.regions[at] = Expression(pattern), end
        return end

    def _closure(self, states) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            place, inside = s
            if inside is None:
                todo += [(t, None) for t in self.free[place]]
                if place in self.regions:
                    e, _ = self.regions[place]
                    todo.append((place, (e.closure([e.start]), False)))
            else:
                e, end = self.regions[place]
                if e.end in inside[0]:
                    todo.append((end, None))
        return frozenset(seen)

    def _forget(self) -> None:
        self.table: dict[tuple[frozenset, str | None], tuple[frozenset, frozenset[str]]] = {}
        self.reads: dict[frozenset, bool] = {}

    def _looks(self, now: frozenset) -> bool:
        """Whether a region's expression has to see the next word itself."""
        if now not in self.reads:
            self.reads[now] = any(inside is not None for _, inside in now)
        return self.reads[now]

    def _next(self, now: frozenset, word: str | None):
        to = []
        for place, inside in now:
            if inside is None:
                to += [(t, None) for key in {word if word in self.known else None, None} for t in self.moves[place].get(key, ())]
            elif word is not None and (fed := self.regions[place][0].feed(inside[0], f" {word}" if inside[1] else word)):
                to.append((place, (fed, True)))
        found = self._closure([*to, *self.start])  # a match may begin at each word
        if len(self.table) > _MAX_STATES:
            self._forget()
        self.table[now, word] = out = found, frozenset(self.accepts[p] for p, inside in found if inside is None and p in self.accepts)
        return out

    def labels(self, tokens: list[str]) -> set[str]:
        """Templates that match a run of these words."""
        now, out = self.start, set()
        for t in tokens:
            w = t if t in self.known or self._looks(now) else None
            now, accepted = self.table.get((now, w)) or self._next(now, w)
            if accepted:
                out |= accepted
        return out

    def candidates(self, spaced: str) -> bool:
        """Whether a text, as words between blanks, has all of some template's longest fixed run."""
        return any(run in spaced for run in self.runs)


def scan(text: str | None, automata: TokenAutomata, phrases: dict[tuple[str, ...], str] = PHRASES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    text = text or ""
    low = text.translate(_LOWER) if not text.isascii() else text.lower()
    if not any(p[-1] in low for p in phrases) and not any(w in low for w in automata.rarest):
        return count_words(text), 0, None, None, "", "", 0.0
    tokens = _WORD.findall(low)
    places, base = [], set()
    for p, label in phrases.items():
        for i in range(len(tokens) - len(p) + 1):
            if tokens[i + len(p) - 1] == p[-1] and tuple(tokens[i : i + len(p)]) == p:
                places.append(i)
                base.add(label)
    own = automata.labels(tokens) if automata.candidates(f" {' '.join(tokens)} ") else set()
    return len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest
    start (null without one).  labels joins the phrases' labels and those of matching templates; score
    is 1 with a template, 0.5 with phrases only, else 0.

    Defined cases: a null or empty text has no words and no labels.  doc_id is passed on, null and
    repeated ones too; an empty table gives no rows; other columns are ignored.  Narrow: no shuffle."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = TokenAutomata(templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [scan(t.as_py(), automata) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
