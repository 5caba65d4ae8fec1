"""The text layer of simple PDF files, page by page, with quality gates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from ..functions.quality import page_stamp

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]\s*TJ|\bT\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]|\bET\b", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _unescape(raw: bytes) -> str:
    raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
    raw = re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    out = []
    for m in _SHOW.finditer(content):
        op = m[0]
        if op.endswith((b"Tj", b"'")):
            out.append(_unescape(_STRING.search(op)[1]))
        elif op.endswith(b"TJ"):
            out += [_unescape(s) if n == b"" else (" " if float(n) < -200 else "") for s, n in _STRING.findall(op)]
        else:
            out.append("\n")
    return re.sub(r"\n\s*\n+", "\n", "".join(out)).strip()


def _stream_of(body: bytes, unpack: bool = True) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if unpack and b"FlateDecode" in m[1]:
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return b""
    return m[2]


def _objects(raw: bytes) -> dict[int, bytes]:
    if b"/Encrypt" in raw:
        raise ValueError("encrypted PDF")
    objects = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:
            packed = _stream_of(body)
            head = re.search(rb"/First\s+(\d+)", body)
            if head:
                first = int(head[1])
                numbers = [int(x) for x in packed[:first].split()]
                places = numbers[1::2] + [len(packed) - first]
                for n, a, b in zip(numbers[::2], places, places[1:]):
                    objects[n] = packed[first + a : first + b]
    return objects


def _page_bodies(objects: dict[int, bytes]) -> list[bytes]:
    return [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", body)]


def pages(raw: bytes) -> list[str]:
    """The text of each page in order; pages whose fonts need a character map come out garbled.  An encrypted file is an error."""
    objects = _objects(raw)
    out = []
    for body in _page_bodies(objects):
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        out.append(_shown(b"\n".join(_stream_of(objects.get(int(n), b"")) for n in _REF.findall(m[1])))) if m else out.append("")
    return out


def page_images(raw: bytes, least: int = 100_000) -> list[bytes | None]:
    """The largest image of each page in order, as it is stored; None for a page without one of `least` pixels."""
    objects = _objects(raw)
    out: list[bytes | None] = []
    for body in _page_bodies(objects):
        held = body + b"".join(objects.get(int(n), b"") for m in re.findall(rb"/Resources\s+(\d+)\s+\d+\s+R", body) for n in [m])
        held += b"".join(objects.get(int(n), b"") for n in re.findall(rb"/XObject\s+(\d+)\s+\d+\s+R", held))
        best, size = None, least - 1
        for n in _REF.findall(held):
            image = objects.get(int(n), b"")
            shape = [re.search(rb"/" + k + rb"\s+(\d+)", image) for k in (b"Width", b"Height")]
            if re.search(rb"/Subtype\s*/Image\b", image) and all(shape) and int(shape[0][1]) * int(shape[1][1]) > size:
                best, size = _stream_of(image, b"DCTDecode" not in image), int(shape[0][1]) * int(shape[1][1])
        out.append(best)
    return out


def recognised(raw: bytes, recognise: Callable[[bytes, str], str], lang: str) -> str:
    """The text of the page images in order; '' if of more than two pages fewer than half have any."""
    texts = [recognise(x, lang).strip() if x else "" for x in page_images(raw)]
    some = sum(map(bool, texts))
    return "" if len(texts) > 2 and 2 * some < len(texts) else "\n\n".join(t for t in texts if t)


def best_text(raw: bytes, backends: dict[str, Callable] | None = None, lang: str = "eng") -> str:
    """The first good text of a PDF: its text layer, an external tool, its page images recognised, its pages drawn and recognised.

    Backends: "pdf_text" (bytes and language to text), "image" (an image and language to
    text) and "pdf_pages" (bytes and dots per inch to images of all pages).  The tool's text
    needs 100 bytes and must not be a watermark, garbled or repeat itself; recognised images need more than 100 bytes.
    """
    found = text(raw)
    backends = backends or {}
    if not found and "pdf_text" in backends:
        other = backends["pdf_text"](raw, lang)
        found = other if len(other.encode()) >= 100 and good(other.split("\x0c"), other) else ""
    if not found and "image" in backends:
        other = recognised(raw, backends["image"], lang)
        found = other if len(other.encode()) > 100 else ""
    if not found and "image" in backends and "pdf_pages" in backends:
        found = "\n\n".join(t for x in backends["pdf_pages"](raw, 200) if (t := backends["image"](x, lang).strip()))
    return found


def watermarked(texts: list[str]) -> bool:
    """Whether over 80 % of neighbouring pages are one and the same but for what changes from page to page."""
    stamps = [s for s in map(page_stamp, texts) if len(s.encode()) > 20]
    same = sum(a == b for a, b in zip(stamps, stamps[1:]))
    return len(stamps) > 1 and same / (len(stamps) - 1) > 0.8


def garbled(text: str) -> bool:
    """As `quality.is_garbled`."""
    if not text:
        return False
    odd = sum(c == "�" or c == "\x7f" or (ord(c) < 32 and c not in "\n\r\t") for c in text)
    return odd / len(text) > 0.3 or sum(not c.isspace() for c in text) / len(text) < 0.05


def good(found: list[str], whole: str) -> bool:
    """Whether pages are neither a watermark nor garbled nor one and the same lines."""
    lines = [x for x in map(str.strip, whole.split("\n")) if x]
    repeats = len(whole.encode()) >= 100 and len(lines) >= 3 and 1 - len(set(lines)) / len(lines) > 0.6
    return not (watermarked(found) or garbled(whole) or repeats)


def text(raw: bytes) -> str:
    """The text layer; '' where it is only a watermark, garbled or repeats itself, so that another reader can be tried."""
    found = pages(raw)
    whole = "\n\n".join(p for p in found if p)
    return whole if good(found, whole) else ""
