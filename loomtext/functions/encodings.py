"""Character sets: labels, lossy decoding and encoding with replacement."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.udf import scalar

# Labels that have rules of their own.
_OWN = {
    "utf8": "utf-8", "utf-8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf16le": "utf-16le", "utf-16le": "utf-16le", "utf-16": "utf-16le", "utf16": "utf-16le", "ucs2": "utf-16le", "ucs-2": "utf-16le",
    "latin1": "latin1", "latin-1": "latin1", "iso-8859-1": "latin1", "iso8859-1": "latin1", "binary": "latin1", "windows-1252": "cp1252", "cp1252": "cp1252", "win1252": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252",
}
_OTHERS = ["shift_jis", "euc-jp", "iso-2022-jp", "gbk", "gb18030", "gb2312", "big5", "euc-kr", "koi8-r", "koi8-u", "macintosh", "ibm866", "windows-874", *(f"windows-{n}" for n in range(1250, 1259)), *(f"iso-8859-{n}" for n in range(2, 17) if n != 12)]
_PYTHON = {"macintosh": "mac_roman", "windows-874": "cp874", **{f"windows-{n}": f"cp{n}" for n in range(1250, 1259)}, "shift-jis": "shift_jis", "sjis": "shift_jis"}


def resolve(label: str) -> str | None:
    """The name that a label stands for, None if unknown."""
    low = label.strip().lower()
    if low in _OWN:
        return _OWN[low]
    if low in _OTHERS or low in _PYTHON:
        return _PYTHON.get(low, low)
    return None


def exists(label: Column) -> Column:
    known = [*_OWN, *_OTHERS, *_PYTHON]
    return F.lower(F.trim(label)).isin(known)


def _encode(text: str, name: str) -> bytes:
    if name == "utf-16le":
        return text.encode("utf-16-le", "surrogatepass")
    if name in ("latin1", "cp1252"):
        # Each UTF-16 unit that has no byte becomes a question mark.
        return "".join(c if ord(c) < 1 << 16 else "\udc00\udc00" for c in text).encode(name, "replace")
    return text.encode(name, "replace" if name != "utf-8" else "surrogatepass")


def _decode(data: bytes, name: str) -> str:
    if name == "utf-16le":
        return data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    if name == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
    return data.decode(name, "replace")


def encode(text: Column, label: str) -> Column:
    name = resolve(label)
    if name is None:
        raise ValueError(f"Encoding not recognized: '{label}'")
    if name == "utf-8":
        return F.encode(text, "utf-8")
    if name == "utf-16le":
        return F.encode(text, "UTF-16LE")
    return scalar(lambda t: _encode(t, name), "binary")(text)


def decode(data: Column, label: str) -> Column:
    """Never fails: bytes without meaning become U+FFFD."""
    name = resolve(label)
    if name is None:
        raise ValueError(f"Encoding not recognized: '{label}'")
    codecs.lookup("latin-1" if name == "latin1" else name)
    return scalar(lambda b: _decode(bytes(b), name), "string")(data)
