"""Text out of PDF files: page by page, with the fonts' own tables from codes to characters.

A file is cut into its objects, those inside object streams among them; pages follow the page tree, and each finds its fonts in
its own resources or its parents'. A font's ToUnicode table becomes intervals of codes, looked up by binary search. Fonts
without one, and strings before any font, are read as Latin-1 or UTF-16 with a mark. Each file is read by itself in one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TOKEN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)|/([^\s/<>\[\]()]+)\s+[-+.\d]+\s+Tf\b|(T\*|T[dD]\b|'|\"|ET\b)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def _unhex(digits: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _raw(token: bytes) -> bytes:
    """The bytes that a string token stands for."""
    if token[:1] == b"<":
        return _unhex(token[1:-1])
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)


def _plain(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class CodeMap:
    """A font's codes as intervals (first code, last code, text of the first): later codes count up its last character."""

    def __init__(self, cmap: bytes):
        widths = [len(_unhex(h)) for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.DOTALL) for h in _HEX.findall(part)]
        found = []
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
            codes = _HEX.findall(part)
            found += [(_number(a), _number(a), _target(b)) for a, b in zip(codes[::2], codes[1::2])]
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
            for low, high, one, many in re.findall(rb"<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", part, re.DOTALL):
                if many:
                    found += [(_number(low) + k, _number(low) + k, _target(h)) for k, h in enumerate(_HEX.findall(many))]
                else:
                    found.append((_number(low), _number(high), _target(one)))
        self.width = max(widths, default=1)
        self.intervals = sorted(found, key=lambda x: x[0])
        self.firsts = [x[0] for x in self.intervals]

    def text(self, raw: bytes) -> str:
        out = []
        for at in range(0, len(raw), self.width):
            code = int.from_bytes(raw[at : at + self.width], "big")
            k = bisect_right(self.firsts, code) - 1
            if k >= 0 and code <= self.intervals[k][1]:
                first, _, target = self.intervals[k]
                out.append(target if code == first or not target else target[:-1] + chr(min(ord(target[-1]) + code - first, 0x10FFFF)))
            elif self.width == 1:
                out.append(chr(code))
        return "".join(out)


def _number(digits: bytes) -> int:
    return int.from_bytes(_unhex(digits), "big")


def _target(digits: bytes) -> str:
    return _unhex(digits).decode("utf-16-be", "replace")


def stream_of(body: bytes) -> bytes | None:
    """An object's stream, inflated if it can be."""
    m = _STREAM.search(body)
    if m is None:
        return None
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return m[1]


def objects(data: bytes) -> dict[int, bytes]:
    """Object bodies by number, the last of a number; objects in object streams have no stream of their own."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (inner := stream_of(body)) is not None and (first := re.search(rb"/First\s+(\d+)", body)):
            head, at = inner[: int(first[1])].split(), int(first[1])
            if all(h.isdigit() for h in head):
                starts = sorted((at + int(b), int(a)) for a, b in zip(head[::2], head[1::2]))
                for (start, number), (end, _) in zip(starts, [*starts[1:], (len(inner), 0)]):
                    found.setdefault(number, inner[start:end])
    return found


def _reference(body: bytes, key: bytes) -> int | None:
    m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
    return int(m[1]) if m else None


def _references(body: bytes, key: bytes) -> list[int]:
    """One reference or a list of them."""
    m = re.search(rb"/" + key + rb"\s*\[(.*?)\]", body, re.DOTALL)
    return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else [n for n in [_reference(body, key)] if n is not None]


def pages(found: dict[int, bytes]) -> list[int]:
    """Page objects in the order of the page tree; those that it does not reach follow in the file's order."""
    listed = [n for n, b in found.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    trees = [n for n, b in found.items() if re.search(rb"/Type\s*/Pages\b", b)]
    inner = {k for n in trees for k in _references(found[n], b"Kids")}
    out, todo, seen = [], [n for n in trees if n not in inner][::-1], set()
    while todo:
        n = todo.pop()
        if n not in seen and n in found:
            seen.add(n)
            todo += _references(found[n], b"Kids")[::-1] if n in trees else []
            out += [n] if n in listed else []
    return out + [n for n in listed if n not in seen]


def fonts_of(found: dict[int, bytes], page: int, maps: dict[int, CodeMap]) -> dict[bytes, CodeMap]:
    """The tables of a page's fonts by the names that its contents use."""
    n, depth = page, 0
    while n is not None and n in found and depth < 64:
        resources = found.get(_reference(found[n], b"Resources"), found[n])
        fonts = found.get(_reference(resources, b"Font"))
        inline = re.search(rb"/Font\s*<<(.*?)>>", resources, re.DOTALL)
        if fonts is not None or inline:
            named = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts if fonts is not None else inline[1])
            return {name: maps[int(number)] for name, number in named if int(number) in maps}
        n, depth = _reference(found[n], b"Parent"), depth + 1
    return {}


def shown(content: bytes, fonts: dict[bytes, CodeMap]) -> list[str]:
    """The lines that a content stream shows: text moves end a line, changes of font do not."""
    lines, font, now = [], None, ""
    for block in re.findall(rb"\bBT\b(.*?\bET\b)", content, re.DOTALL):
        for string, name, move in _TOKEN.findall(block):
            if string:
                now += font.text(_raw(string)) if font else _plain(_raw(string))
            elif name:
                font = fonts.get(name)
            elif move:
                lines, now = lines + [now.strip()] * bool(now.strip()), ""
    return lines


def pdf_strings(data: bytes) -> str:
    """Text of a PDF: its pages in order, then streams with text that no page names, such as forms."""
    found = objects(data)
    maps = {}
    for n, body in found.items():
        held = found.get(_reference(body, b"ToUnicode"))
        if held is not None and (cmap := stream_of(held)) is not None:
            maps[n] = CodeMap(cmap)
    lines, used, every = [], set(), {}
    for page in pages(found):
        fonts = fonts_of(found, page, maps)
        every = fonts | every
        contents = _references(found[page], b"Contents")
        used |= set(contents)
        # a page's streams are one content, wherever it is cut
        lines += shown(b"\n".join(stream_of(found[n]) or b"" for n in contents if n in found), fonts)
    inside = [m.span() for m in _OBJECT.finditer(data)]
    rest = [stream_of(body) for n, body in found.items() if n not in used]
    if not inside:
        rest = [stream_of(m[0]) for m in _STREAM.finditer(data)]
    for content in rest:
        if content is not None and re.search(rb"\bBT\b", content) and b"begincmap" not in content:
            lines += shown(content, every)
    return "\n".join(lines)


def pdf_text(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [pdf_strings(bytes(c)) if c is not None else "" for c in frame["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
