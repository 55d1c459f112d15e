"""PDF: pages of text, lines and rectangles written, and the text, metadata and version of simple files read.

The reader knows cross-reference tables and streams of objects packed by Flate, and fonts of one byte a character;
other files give what can be found, never an error. Passwords are not supported.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column

from loomtext.functions.udf import scalar

PAGE = "array<struct<width:double,height:double,items:array<struct<kind:string,text:string,x:double,y:double,x2:double,y2:double,size:double>>>>"
INFO = "struct<text:string,numpages:int,info:map<string,string>,version:string>"
_MM = 72 / 25.4


def _escape(s: str) -> bytes:
    return b"(" + s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def pdf_bytes(pages: list[dict], info: dict[str, str] | None = None) -> bytes:
    """Pages in millimetres from the lower left: items of kind text (x, y, size), line or rect (x, y, x2, y2)."""
    if not pages:
        raise ValueError("a document needs a page")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for p in pages:
        ops = []
        for i in p["items"]:
            x, y = i["x"] * _MM, i["y"] * _MM
            if i["kind"] == "text":
                ops.append(b"BT /F1 %.2f Tf %.2f %.2f Td %s Tj ET" % (i.get("size") or 12, x, y, _escape(i["text"])))
            elif i["kind"] == "line":
                ops.append(b"%.2f %.2f m %.2f %.2f l S" % (x, y, i["x2"] * _MM, i["y2"] * _MM))
            elif i["kind"] == "rect":
                ops.append(b"%.2f %.2f %.2f %.2f re S" % (x, y, i["x2"] * _MM - x, i["y2"] * _MM - y))
            else:
                raise ValueError(f"unknown item: {i['kind']}")
        body = zlib.compress(b"\n".join(ops))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (p["width"] * _MM, p["height"] * _MM, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    objects.append(b"<< " + b" ".join(b"/%s %s" % (k.encode(), _escape(v)) for k, v in (info or {}).items()) + b" >>")
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(objects), start)
    return bytes(out)


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_SHOW = re.compile(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:TJ|Tj|'|\")|(-?[\d.]+)\s+(-?[\d.]+)\s+(Td|TD)|(T\*)|(\bET\b)|(?:-?[\d.]+\s+){5}(-?[\d.]+)\s+(Tm)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1]


def _page_text(content: bytes) -> str:
    out: list[str] = []
    for m in _SHOW.finditer(content):
        if m[1]:
            out.append("".join(_string(s) for s in _STRING.findall(m[1])))
        elif (m[4] and float(m[3])) or m[5] or m[6] or m[8]:
            if out and not out[-1].endswith("\n"):
                out.append("\n")
    return "".join(out).strip("\n")


def read_pdf(data: bytes, max_pages: int = 0) -> dict:
    """Text with a form feed between pages, number of pages, information and version; empty where nothing is found."""
    version = re.match(rb"%PDF-(\d\.\d)", data)
    objects = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:
            first, inner = re.search(rb"/First\s+(\d+)", body), _stream(body)
            if first and inner:
                numbers = [int(x) for x in inner[: int(first[1])].split()]
                starts = numbers[1::2] + [len(inner) - int(first[1])]
                for k, n in enumerate(numbers[0::2]):
                    objects.setdefault(n, inner[int(first[1]) + starts[k] : int(first[1]) + starts[k + 1]])
    refs = lambda key, body: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)) else []
    pages: list[bytes] = []

    def walk(n: int, depth: int = 0) -> None:
        body = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in refs(b"Kids", body) if depth < 50 else ():
                walk(k, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(body)

    for body in objects.values():
        if re.search(rb"/Type\s*/Catalog\b", body):
            for n in refs(b"Pages", body):
                walk(n)
            break
    texts = [_page_text(b"\n".join(_stream(objects.get(n, b"")) for n in refs(b"Contents", p))) for p in (pages[:max_pages] if max_pages else pages)]
    info: dict[str, str] = {}
    if m := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data):
        info = {k.decode(): _string(v) for k, v in re.findall(rb"/(\w+)\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", objects.get(int(m[1]), b""))}
    return {"text": "\f".join(texts), "numpages": len(pages), "info": info, "version": version[1].decode() if version else "unknown"}


def generate(pages: Column) -> Column:
    """A PDF of an array of pages (width, height, items)."""
    return scalar(lambda ps: pdf_bytes([p.asDict(True) if hasattr(p, "asDict") else p for p in ps]), "binary")(pages)


def parse(data: Column, max_pages: int = 0) -> Column:
    return scalar(lambda b: read_pdf(bytes(b), max_pages), INFO)(data)
