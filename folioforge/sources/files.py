"""Text of PDF and HWP 5 files, with the standard library alone; whatever fails is marked, never raised."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .readers import CHARS_A_PAGE, TEXT_CHARS

_STREAM = re.compile(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]\s*TJ|T\*|\bTd\b|\bTD\b|\bET\b", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SPACE = re.compile(r"[ \t]+")


def _unescaped(raw: bytes) -> str:
    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pdf_pages(raw: bytes) -> list[str]:
    """Text of a PDF's content streams that show text, one a page; simple encodings only."""
    pages = []
    for m in _STREAM.finditer(raw):
        data = m[1]
        if b"FlateDecode" in m[0][: m[0].find(b"stream")]:
            data = zlib.decompressobj().decompress(data)
        if b"BT" not in data:
            continue
        out = []
        for shown in _SHOWN.finditer(data):
            token = shown[0]
            out.append("".join(_unescaped(x) for x in _LITERAL.findall(token)) if token[:1] in b"([" else "\n")
        text = _SPACE.sub(" ", "".join(out)).strip()
        if text:
            pages.append(re.sub(r"\n+", "\n", text))
    return pages


def ole_streams(raw: bytes) -> dict[str, bytes]:
    """Streams of a compound file by their path."""
    if raw[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("not a compound file")
    size = 1 << struct.unpack_from("<H", raw, 30)[0]
    small = 1 << struct.unpack_from("<H", raw, 32)[0]
    n_fat, start_dir = struct.unpack_from("<L", raw, 44)[0], struct.unpack_from("<L", raw, 48)[0]
    cutoff, start_mini, _, start_difat, n_difat = struct.unpack_from("<5L", raw, 56)
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    difat = list(struct.unpack_from("<109L", raw, 76))
    while n_difat and start_difat < 0xFFFFFFFC:
        more = struct.unpack(f"<{size // 4}L", sector(start_difat))
        difat, start_difat, n_difat = difat + list(more[:-1]), more[-1], n_difat - 1
    fat = [x for i in difat[:n_fat] if i < 0xFFFFFFFC for x in struct.unpack(f"<{size // 4}L", sector(i))]

    def chain(start: int, table: list[int]) -> list[int]:
        out = []
        while start < 0xFFFFFFFC and len(out) <= len(table):
            out.append(start)
            start = table[start]
        return out

    whole = lambda start: b"".join(map(sector, chain(start, fat)))
    directory, entries = whole(start_dir), []
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        length, kind = struct.unpack_from("<HB", e, 64)
        entries.append((e[: max(0, length - 2)].decode("utf-16-le", "replace"), kind, *struct.unpack_from("<3L", e, 68), struct.unpack_from("<L", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]))
    mini = whole(entries[0][5])
    mini_fat = [x for i in chain(start_mini, fat) for x in struct.unpack(f"<{size // 4}L", sector(i))]
    out: dict[str, bytes] = {}

    def walk(i: int, path: str) -> None:
        todo = [i]
        seen = set()
        while todo:
            i = todo.pop()
            if i >= len(entries) or i in seen:
                continue
            seen.add(i)
            name, kind, left, right, child, start, length = entries[i]
            todo += [left, right]
            if kind == 1:
                walk(child, f"{path}{name}/")
            elif kind == 2:
                data = whole(start) if length >= cutoff else b"".join(mini[k * small : (k + 1) * small] for k in chain(start, mini_fat))
                out[path + name] = data[:length]

    walk(entries[0][4], "")
    return out


def hwp_text(raw: bytes) -> str:
    """Printable text of an HWP 5 file's body sections."""
    out = []
    for name, data in sorted(ole_streams(raw).items()):
        if name.startswith("BodyText/"):
            try:
                data = zlib.decompress(data, -15)
            except zlib.error:
                pass  # stored without compression
            at = 0
            while at + 4 <= len(data):
                head = struct.unpack_from("<L", data, at)[0]
                tag, length, at = head & 0x3FF, head >> 20, at + 4
                if length == 0xFFF:
                    length, at = struct.unpack_from("<L", data, at)[0], at + 4
                if tag == 67:  # paragraph text
                    text = data[at : at + length].decode("utf-16-le", "replace")
                    out.append("".join(c for c in text if c.isprintable() or c in "\n\t"))
                at += length
    return "\n".join(out)


def extract(raw: bytes | None, suffix: str) -> tuple[str, list[str], bool, str]:
    """(text, pages, failed, reason)."""
    try:
        pages = pdf_pages(raw or b"") if suffix == ".pdf" else [hwp_text(raw or b"")] if suffix == ".hwp" else []
    except Exception as e:  # noqa: BLE001  a damaged file is a result, not a failed job
        return "", [], True, f"{type(e).__name__}: {e}"[:200]
    text = "\n".join(pages)[:TEXT_CHARS]
    thin = len(text) < CHARS_A_PAGE * max(1, len(pages))
    return text, pages, thin, "needs_ocr" if thin else ""


@F.pandas_udf(StructType().add("text", "string").add("pages", ArrayType(StringType())).add("failed", "boolean").add("reason", "string"))
def _extracted(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(c, s) for c, s in zip(content, suffix)], columns=["text", "pages", "failed", "reason"])


def extract_text(files: DataFrame) -> DataFrame:
    """Files (content, suffix) with text, pages, failed and reason added."""
    own = [c for c in files.columns if c not in ("text", "pages", "failed", "reason")]
    return files.withColumn("__x", _extracted("content", "suffix")).select(*own, "__x.*")
