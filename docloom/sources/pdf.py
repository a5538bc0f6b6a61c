"""Text and title of simple PDF files, with the standard library alone.

Reads objects (also those in object streams), the page tree, and the text operators of page contents in simple fonts or with
ToUnicode maps. Encrypted files and other compressions raise; give another parser for those.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_TOKEN = re.compile(rb"(" + _STRING + rb")|<([0-9A-Fa-f\s]*)>|\[((?:" + _STRING + rb"|[^\]])*)\]|/([^\s/<>\[\]()]+)|([A-Za-z'\"*]+)|(-?[\d.]+)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] == b"\n" else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _decode(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _stream(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return None
    head = body[: m.start()]
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(m[1])
    if b"/Filter" in head:
        raise ValueError("unsupported PDF compression")
    return m[1]


def objects(content: bytes) -> dict[int, bytes]:
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    if b"/Encrypt" in content:
        raise ValueError("PDF is encrypted")
    found = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        data, first = _stream(body) or b"", int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = [int(x) for x in data[:first].split()]
        for i in range(0, len(numbers), 2):
            end = numbers[i + 3] if i + 3 < len(numbers) else len(data) - first
            found[numbers[i]] = data[first + numbers[i + 1] : first + end]
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _maps(found: dict[int, bytes], page: bytes) -> dict[bytes, dict[bytes, str]]:
    """ToUnicode maps of the page's fonts by name."""
    fonts = {}
    for source in [page, *(found.get(n, b"") for n in _refs(page, b"Resources"))]:
        inner = re.search(rb"/Font\s*<<(.*?)>>", source, re.S)
        bodies = [inner[1]] if inner else [found.get(n, b"") for n in _refs(source, b"Font")]
        for body in bodies:
            for name, number in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", body):
                for n in _refs(found.get(int(number), b""), b"ToUnicode"):
                    fonts[name] = _cmap(_stream(found.get(n, b"")) or b"")
    return fonts


def _cmap(data: bytes) -> dict[bytes, str]:
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(int(a, 16), int(b, 16) + 1):
                out[k.to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + k - int(a, 16))
    return out


def _shown(raw: bytes, fonts: dict[bytes, str] | None) -> str:
    if not fonts:
        return _decode(raw)
    width = len(next(iter(fonts)))
    return "".join(fonts.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _text(data: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out, held, name, current = [], [], b"", None
    for m in _TOKEN.finditer(data):
        literal, hexes, array, named, operator, number = m.groups()
        if literal is not None:
            held.append(_string(literal[1:-1]))
        elif hexes is not None:
            held.append(bytes.fromhex((re.sub(rb"\s", b"", hexes).decode() + "0")[: (len(re.sub(rb"\s", b"", hexes)) + 1) // 2 * 2]))
        elif array is not None:
            for part in _TOKEN.finditer(array):
                if part[1] is not None:
                    held.append(_string(part[1][1:-1]))
                elif part[2] is not None:
                    held.append(bytes.fromhex(part[2].decode()))
                elif part[6] is not None and float(part[6]) < -200:
                    held.append(b" ")
        elif named is not None:
            name = named
        elif operator is not None:
            if operator in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET") and out and out[-1] != "\n":
                out.append("\n")
            if operator == b"Tf":
                current = fonts.get(name)
            if operator in (b"Tj", b"TJ", b"'", b'"'):
                out += [" " if raw == b" " else _shown(raw, current) for raw in held]
            held = []
    return "".join(out).strip()


def pages(content: bytes) -> list[str | None]:
    """Text of each page in order, None where a page shows none."""
    found = objects(content)
    root = next((n for n, b in found.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    todo, order, met = _refs(found.get(root, b""), b"Pages"), [], set()
    while todo:
        n = todo.pop(0)
        if n in met:
            continue
        met.add(n)
        body = found.get(n, b"")
        if re.search(rb"/Type\s*/Page\b", body):
            order.append(body)
        else:
            todo = _refs(body, b"Kids") + todo
    if not order:
        raise ValueError("PDF has no pages")
    out = []
    for page in order:
        data = b"\n".join(_stream(found.get(n, b"")) or b"" for n in _refs(page, b"Contents"))
        out.append(_text(data, _maps(found, page)) or None)
    return out


def title(content: bytes) -> str | None:
    """The title of the document information, None where there is none."""
    found = objects(content)
    m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    infos = [found.get(int(m[1]), b"")] if m else [b for b in found.values() if b"/Title" in b and b"/Type" not in b]
    for body in infos:
        t = re.search(rb"/Title\s*(?:(" + _STRING + rb")|<([0-9A-Fa-f]*)>)", body, re.S)
        if t:
            return _decode(_string(t[1][1:-1]) if t[1] is not None else bytes.fromhex(t[2].decode())).strip() or None
    return None
