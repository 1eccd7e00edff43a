"""Byte-level BPE as a transducer over bytes, and a streaming decoder.

Encoding.  The encoding of a byte string is the only sequence of tokens in which every two neighbours
are *compatible*, that is, merging the bytes of the two gives back just these two.  So encoding needs
no merge loop: a nondeterministic transducer walks a trie of all tokens, and where a token ends that is
compatible with the one before, it may emit it and return to the root.  ``MergeTransducer``
determinises this machine lazily.  A wrong hypothesis dies when its trie path ends, so what must be held
back is bounded by the longest tokens.

Decoding.  ``Utf8Decoder`` takes bytes in pieces of any size.  A state machine over the lead byte and
the continuation bytes still due finds where the last whole character ends; the rest waits.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import batched, chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, pieces

_MAX_STATES, _MAX_PAIRS, _MAX_PIECES, _MAX_PIECE, _BLOCK = 300_000, 1_000_000, 300_000, 64, 4096
#: Fixed value: the pattern of the vocabularies that this module is tuned for; others work, slower.
_KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, Tokenizer] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a decimal number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class MergeTransducer:
    """The lazily determinised transducer of a table of merge ranks.

    A state is the set of live hypotheses (trie node, token before it).  Each move also gives the one
    token that may end there: the last token of the encoding of all bytes so far.
    """

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        self.ranks, self.most_states, self.most_pairs = ranks, int(_MAX_STATES * memory), int(_MAX_PAIRS * memory)
        self.tokens = {i: t for t, i in ranks.items()}
        self.step: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.ends: dict[int, int] = {}  # node -> token
        self.depth = [0]
        for token, i in ranks.items():
            at = 0
            for byte in token:
                to = self.step.get(at << 8 | byte)
                if to is None:
                    to = self.step[at << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.ends[at] = i
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self._forget(((0, -1),))

    def _forget(self, state: tuple) -> int:
        """Drops all states but the first and ``state``; gives its new number."""
        first = ((0, -1),)
        self.sets = [first] if state == first else [first, state]
        self.states = {s: i for i, s in enumerate(self.sets)}
        self.moves: dict[int, int] = {}  # (state << 8 | byte) -> state << 24 | token that ends
        return len(self.sets) - 1

    def merged(self, raw: bytes, down_to: int = 1) -> list[bytes]:
        """The encoding by the definition: join the neighbours of least rank, leftmost first, until
        none can be joined or so many parts are left.  For single tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = self.ranks.get
        while len(parts) > down_to:
            found = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == 1 << 60:
                break
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _sides(self, token: int) -> tuple | None:
        """What stands at a token's left and right border while it is merged: (bytes, rank at which
        it was made, rank at which it is joined); None for a token that merging doesn't give."""
        if token in self.edges:
            return self.edges[token]
        raw = self.tokens[token]
        out: list[list] = []
        if len(raw) > 1 and (len(two := self.merged(raw, 2)) != 2 or self.ranks.get(two[0] + two[1]) is None):
            self.edges[token] = None
            return None
        for side in (0, -1):
            chain_, part, gone = [], raw, 1 << 60
            while len(part) > 1:
                made = self.ranks[part]
                chain_.append((part, made, gone))
                part, gone = self.merged(part, 2)[side], made
            chain_.append((part, -1, gone))
            out.append(chain_)
        self.edges[token] = tuple(out)
        return self.edges[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives just a and b: no part that stands at the right
        border of a may be joined with one at the left border of b before its own token takes it."""
        right = self._sides(b)
        if a < 0 or right is None:
            return right is not None
        left = self._sides(a)
        if left is None:
            return False
        rank = self.ranks.get
        for x, made_x, gone_x in left[1]:
            for y, made_y, gone_y in right[0]:
                if made_x < gone_y and made_y < gone_x and (r := rank(x + y)) is not None and r < gone_x and r <= gone_y:
                    return False
        return True

    def _move(self, state: int, byte: int) -> int:
        live, ended = [], -1
        for node, last in self.sets[state]:
            to = self.step.get(node << 8 | byte)
            if to is None:
                continue
            live.append((to, last))
            token = self.ends.get(to)
            if token is not None and ended < 0:
                pair = (last + 1) << 24 | token
                fits = self.pairs.get(pair)
                if fits is None:
                    if len(self.pairs) > self.most_pairs:
                        self.pairs.clear()
                    fits = self.pairs[pair] = self.compatible(last, token)
                if fits:
                    ended = token
        if ended < 0:
            raise ValueError("the ranks lack single bytes")
        live.append((0, ended))
        key = tuple(live)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.sets)
            self.sets.append(key)
        found = self.moves[state << 8 | byte] = to << 24 | ended
        return found

    def _final(self, state: int, n: int, ended: list[int]) -> int:
        """The last place among n bytes at which every live hypothesis has a border."""
        tokens = self.tokens
        starts = {n - self.depth[node] for node, _ in self.sets[state]}
        while len(starts) > 1:
            far = max(starts)
            starts.remove(far)
            starts.add(far - len(tokens[ended[far - 1]]))
        return starts.pop()

    def _back(self, ended: list[int], n: int) -> list[int]:
        out, tokens = [], self.tokens
        while n:
            token = ended[n - 1]
            out.append(token)
            n -= len(tokens[token])
        out.reverse()
        return out

    def encode(self, raw: bytes) -> list[int]:
        """Token ids of a byte string, in time linear in its length.  What it holds back is bounded:
        after each block of bytes the tokens that all hypotheses share are given out."""
        out: list[int] = []
        state, ended = 0, []
        for at in range(0, len(raw), _BLOCK):
            if len(self.sets) > self.most_states:
                state = self._forget(self.sets[state])
            moves = self.moves.get
            for byte in raw[at : at + _BLOCK]:
                found = moves(state << 8 | byte) or self._move(state, byte)
                ended.append(found & 0xFFFFFF)
                state = found >> 24
            if at + _BLOCK < len(raw):
                n = self._final(state, len(ended), ended)
                out += self._back(ended, n)
                del ended[:n]
        return out + self._back(ended, len(ended))


class Tokenizer:
    """Splits a text by a pattern and runs each match through the transducer, as a vocabulary file's
    library would without special tokens: a match that is itself a token stays whole."""

    def __init__(self, raw: bytes, pattern: str, memory: float = 1.0):
        self.transducer = MergeTransducer(parse_ranks(raw), memory)
        self.find = _finder(pattern)
        size = max(self.transducer.tokens) + 1
        self.bytes_of = [self.transducer.tokens.get(i, b"") for i in range(size)]
        self.text_of = [str(i) for i in range(size)]
        self.known = _Pieces(self.transducer, int(_MAX_PIECES * memory))

    @classmethod
    def load(cls, raw: bytes, pattern: str, memory: float = 1.0) -> Tokenizer:
        """One instance a process and vocabulary, so its states outlive a task."""
        key = hashlib.sha256(raw + f"{pattern}{memory}".encode()).hexdigest()
        if key not in _loaded:
            _loaded[key] = cls(raw, pattern, memory)
        return _loaded[key]

    def encode(self, text: str) -> list[int]:
        self.known.trim()
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int], replace: bool = False) -> str:
        return "".join(self.stream(ids, replace=replace))

    def stream(self, ids: Iterable[int], step: int = 16_384, replace: bool = False) -> Iterator[str]:
        """The text in pieces, each as soon as its characters are whole; ``step`` ids are held at a time.
        Ids whose bytes are no UTF-8, or end within a character, are a ValueError, or U+FFFD with ``replace``."""
        decoder = Utf8Decoder(replace)
        for some in batched(ids, step):
            yield decoder.feed(b"".join(map(self.bytes_of.__getitem__, some)))
        yield decoder.end()


def _finder(pattern: str):
    """``findall`` of the pattern.  Python's own engine is about twice as fast as that of ``regex``;
    it takes over for texts of the Basic Multilingual Plane, with \\p{L}, \\p{N} and \\s written out
    as the ranges of characters that ``regex`` gives them, and the alternatives in an equal order."""
    full = regex.compile(pattern).findall
    if pattern != _KNOWN_PATTERN:
        return full
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    letter, number, space = (_ranges(regex.findall(c, every)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    fast = re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    return lambda text: fast(text) if len(text.encode("utf-16-le")) == 2 * len(text) else full(text)


def _ranges(chars: list[str]) -> str:
    out, codes = [], sorted(map(ord, chars))
    begun = codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            out.append(f"\\u{begun:04x}-\\u{a:04x}")
            begun = b
    return "".join(out)


class _Pieces(dict):
    """Matches already encoded, in two generations, the older dropped when the younger is full, so
    that frequent ones stay; long ones are not kept."""

    def __init__(self, transducer: MergeTransducer, most: int):
        self.transducer, self.most = transducer, most
        self.older: dict[str, tuple[int, ...]] = {}

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        raw = piece.encode("utf-8")
        ids = tuple(self.transducer.encode(raw))
        if len(ids) > 1 and raw in self.transducer.ranks:
            ids = (self.transducer.ranks[raw],)
        if len(piece) <= _MAX_PIECE:
            self[piece] = ids
        return ids


def _utf8_states() -> list[list[int]]:
    """The next state by state and byte, -1 where the byte can't follow.  0: between characters; 1, 2, 3:
    so many continuation bytes are due; 4 to 7: after E0, ED, F0 and F4, whose next byte is restricted."""
    steps = [[-1] * 256 for _ in range(8)]
    for state, low, high, to in (
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2),
        (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
        (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ):
        steps[state][low : high + 1] = [to] * (high + 1 - low)
    return steps


_UTF8 = _utf8_states()


class Utf8Decoder:
    """UTF-8 in pieces cut anywhere: ``state`` of ``_UTF8``, ``rest`` the bytes of the character begun.

    What is no UTF-8 is an error (``replace`` false), or each longest part that could begin a character,
    or else each byte, becomes one U+FFFD.  The states take the bytes of characters that pieces share;
    between them, whole runs are decoded at once, and by the states again where that finds a fault.
    """

    def __init__(self, replace: bool = False):
        self.rest, self.state, self.replace = b"", 0, replace

    def _fault(self, raw: bytes, what: str) -> str:
        self.rest, self.state = b"", 0
        if not self.replace:
            raise ValueError(f"{what}: {raw.hex()}")
        return "\ufffd"

    def _step(self, byte: int) -> str:
        to = _UTF8[self.state][byte]
        if to < 0:
            if self.state:
                return self._fault(self.rest, "a character is cut short") + self._step(byte)
            return self._fault(bytes([byte]), "no character begins so")
        self.rest, self.state = self.rest + bytes([byte]), to
        if to:
            return ""
        char, self.rest = self.rest.decode("utf-8"), b""
        return char

    def feed(self, raw: bytes) -> str:
        out, at = [], 0
        while self.state and at < len(raw):
            out.append(self._step(raw[at]))
            at += 1
        begun = next((k for k in range(len(raw) - 1, max(at, len(raw) - 3) - 1, -1) if raw[k] >= 0xC0), len(raw))
        try:
            out.append(raw[at:begun].decode("utf-8"))
        except UnicodeDecodeError:
            out += map(self._step, raw[at:begun])
        out += map(self._step, raw[begun:])
        return "".join(out)

    def end(self) -> str:
        return self._fault(self.rest, "the bytes end within a character") if self.state else ""


def _digests(raw: bytes, pattern: str, with_ids: bool, memory: float):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer.load(raw, pattern) if memory >= 1 else Tokenizer(raw, pattern, memory)  # small ones go with the task
        names = t.text_of.__getitem__
        for b in pieces(batches, 1, rows=500):
            ids, n, digest, back = [], [], [], []
            for text in b.column(1):
                own = t.encode(text.as_py() or "")
                n.append(len(own))
                digest.append(hashlib.sha256(",".join(map(names, own)).encode()).hexdigest())
                h = hashlib.sha256()
                for piece in t.stream(own):
                    h.update(piece.encode())
                back.append(h.hexdigest())
                if with_ids:
                    ids.append(pa.array(own, pa.int32()))
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x))
                flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names_out.append("token_ids")
            yield pa.RecordBatch.from_arrays(out, names_out)

    return run


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True, memory: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) for every row of ``docs``.

    ``vocabulary`` is a file of ranks that the driver reads and hands to the tasks (a fixed size, under
    1 MB here).  Each text is encoded whole, its ids decoded again as a stream; the digests are of the
    decimal ids joined by commas and of the decoded bytes.  Narrow: no shuffle.

    Defined cases: a null text counts as empty: no tokens, the digests of nothing.  doc_id is passed
    on as it is, null and repeated ones too.  An empty table gives no rows; other columns are ignored.
    Memory: one batch of texts, and bounded tables of states and of known matches: some 450 MB a worker,
    times ``memory``, which trades it against time and changes no result.
    """
    raw = Path(vocabulary).read_bytes()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests(raw, pattern, with_ids, memory), schema)
