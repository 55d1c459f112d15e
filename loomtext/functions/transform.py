"""Text transformations: slugs, chunks for retrieval, diffs, JSON merge."""

from __future__ import annotations

import io
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column

from loomtext.functions.udf import scalar

# Letters that decomposition leaves whole.
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i"}


def slug_text(text: str, sep: str = "-") -> str:
    """Marks off Latin letters, lower case, runs of letters and digits joined by sep. Other scripts keep their letters' base forms."""
    s = "".join(_LETTERS.get(c, c) for c in text)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return sep.join(re.findall(r"[a-z0-9]+", s))


def slugify(text: Column, sep: str = "-") -> Column:
    return scalar(lambda t: slug_text(t, sep), "string")(text)


#: Boundaries from the coarsest to the finest: paragraphs, lines, sentences, words.
_LEVELS = [re.compile(p) for p in (r"(?:\r?\n){2,}", r"\r?\n", r"(?<=[.!?])\s+", r"\s+")]
_MARKDOWN = [re.compile(p, re.M) for p in (r"^(?=# )", r"^(?=## )", r"^(?=#{3,6} )", r"^(?:-{3,}|\*{3,}|_{3,})\s*$")]


def chunk_text(text: str, size: int = 1000, overlap: int = 0, markdown: bool = False) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest boundary that lets them fit, and trimmed.

    With overlap, a chunk starts with the last whole parts of the one before, up to that many characters.
    """
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    levels = _MARKDOWN + _LEVELS if markdown else _LEVELS

    def parts(s: str, level: int) -> list[str]:
        if len(s) <= size:
            return [s]
        if level == len(levels):
            return [s[i : i + size] for i in range(0, len(s), size)]
        cut, at = [], 0
        for m in levels[level].finditer(s):
            # White space stays with the part before it.
            end = m.end() if m.end() > m.start() else m.start()
            if end > at:
                cut.append(s[at:end])
                at = end
        cut.append(s[at:])
        return [p for c in cut if c for p in parts(c, level + 1)]

    out: list[str] = []
    held: list[str] = []
    room = 0  # characters of held
    for p in parts(text, 0):
        edge = len(p) - len(p.rstrip())
        # As long as the first part has a character that stays, trimming takes the edges of the outermost parts alone.
        lead = len(held[0]) - len(held[0].lstrip()) if held else 0
        solid = held and lead < len(held[0]) and edge < len(p)
        if held and (room + len(p) - lead - edge if solid else len(("".join(held) + p).strip())) > size:
            out.append("".join(held).strip())
            keep: list[str] = []
            kept = 0
            while held and kept + len(held[-1]) <= overlap and len(("".join([held[-1], *keep]) + p).strip()) <= size:
                kept += len(held[-1])
                keep.insert(0, held.pop())
            held, room = keep, kept
        held.append(p)
        room += len(p)
    out.append("".join(held).strip())
    return [c for c in out if c]


def split_text(text: Column, size: int = 1000, overlap: int = 0, markdown: bool = False) -> Column:
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    return scalar(lambda t: chunk_text(t, size, overlap, markdown), "array<string>")(text)


class _Reach:
    """How far d edits reach in u on the diagonal 2 * i - d, for each i of 0 to d: a row for each d.

    Rows grow with d, so only every STEP-th is held; those between are made again when the way back needs them.
    """

    STEP = 256

    def __init__(self, u: np.ndarray, w: np.ndarray):
        self.u, self.w, self.held, self.block, self.first = u, w, {}, [], -1

    def after(self, last: np.ndarray | None) -> np.ndarray:
        if last is None:
            x = np.zeros(1, np.int64)
        else:
            x = np.empty(len(last) + 1, np.int64)
            x[0], x[-1] = last[0], last[-1] + 1
            x[1:-1] = np.where(last[:-1] < last[1:], last[1:], last[:-1] + 1)
        d = len(x) - 1
        y = x - (2 * np.arange(d + 1) - d)
        at = np.flatnonzero((x < len(self.u)) & (y < len(self.w)))
        at = at[self.u[x[at]] == self.w[y[at]]]
        while len(at) > 8:
            x[at] += 1
            y[at] += 1
            at = at[(x[at] < len(self.u)) & (y[at] < len(self.w))]
            at = at[self.u[x[at]] == self.w[y[at]]]
        for i in at.tolist():
            # Few long runs of equal items: compared in pieces that double.
            a, b, piece = int(x[i]), int(y[i]), 16
            while True:
                p, q = self.u[a : a + piece], self.w[b : b + piece]
                n = min(len(p), len(q))
                differ = np.flatnonzero(p[:n] != q[:n])
                same = int(differ[0]) if len(differ) else n
                a, b = a + same, b + same
                if same < piece:
                    break
                piece *= 2
            x[i] = a
        return x

    def edits(self) -> int:
        """The least number of edits."""
        row, d, goal = None, 0, len(self.u) - len(self.w)
        while True:
            row = self.after(row)
            if d % self.STEP == 0:
                self.held[d] = row
            if abs(goal) <= d and (goal + d) % 2 == 0 and row[(goal + d) // 2] >= len(self.u):
                return d
            d += 1

    def row(self, d: int) -> np.ndarray:
        first = d - d % self.STEP
        if first != self.first:
            self.first, self.block = first, [self.held[first]]
        while len(self.block) <= d - first:
            self.block.append(self.after(self.block[-1]))
        return self.block[d - first]


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Shortest edit script by Myers' greedy algorithm, a row of diagonals at a time: runs (kind, a from, a to, b from, b to); deletions before insertions."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x_end, y_end = len(a) - tail - head, len(b) - tail - head
    u, w = a[head : head + x_end], b[head : head + y_end]
    code: dict[str, int] = {}
    reach = _Reach(np.array([code.setdefault(c, len(code)) for c in u], np.int64), np.array([code.setdefault(c, len(code)) for c in w], np.int64))
    ops, x, y = [], x_end, y_end
    for d in range(reach.edits(), 0, -1):
        last, i = reach.row(d - 1), (x - y + d) // 2
        down = i == 0 or i < d and last[i - 1] < last[i]
        px = int(last[i] if down else last[i - 1])
        py = px - (2 * i - d) - (1 if down else -1)
        same = x - px - (not down)
        ops += "=" * same
        ops.append("+" if down else "-")
        x, y = px, py
    ops += "=" * x
    ops = ["="] * head + ops[::-1] + ["="] * tail
    out: list[tuple[str, int, int, int, int]] = []
    i = j = at = 0
    while at < len(ops):
        to = at
        while to < len(ops) and (ops[to] == "=") == (ops[at] == "="):
            to += 1
        run = ops[at:to]
        dels, adds = run.count("-"), run.count("+")
        if ops[at] == "=":
            out.append(("=", i, i + len(run), j, j + len(run)))
            i, j = i + len(run), j + len(run)
        else:
            if dels:
                out.append(("-", i, i + dels, j, j))
            if adds:
                out.append(("+", i + dels, i + dels, j, j + adds))
            i, j = i + dels, j + adds
        at = to
    return out


def _lines(s: str, ends: str = "") -> list[str]:
    """Lines with their ends: line feeds and carriage returns, or line feeds alone. Other separators (form feed, U+0085, U+2028) end none."""
    return list(io.StringIO(s, newline=ends))


def _units(kind: str, s: str) -> list[str]:
    if kind == "chars":
        return list(s)
    if kind == "words":
        return re.findall(r"\s+|[^\s]+", s)
    lines = _lines(s) if kind == "lines" else [x.rstrip() + "\n" for x in _lines(s)]
    if kind == "trimmed" and lines:
        lines[-1] = lines[-1][:-1]
    return lines


def hunks(kind: str, old: str, new: str) -> list[dict]:
    a, b = _units(kind, old), _units(kind, new)
    return [{"value": "".join(b[y1:y2] if op == "+" else a[x1:x2]), "added": op == "+", "removed": op == "-"} for op, x1, x2, y1, y2 in edit_script(a, b)]


def offsets(kind: str, old: str, new: str) -> list[dict]:
    """The hunks as byte ranges of old and new."""
    out, i, j = [], 0, 0
    for h in hunks(kind, old, new):
        n = len(h["value"].encode())
        di, dj = (0 if h["added"] else n), (0 if h["removed"] else n)
        out.append({"kind": 1 if h["added"] else 2 if h["removed"] else 0, "old_start": i, "old_end": i + di, "new_start": j, "new_end": j + dj})
        i, j = i + di, j + dj
    return out


def patch_text(name: str, old: str, new: str, old_header: str = "", new_header: str = "", context: int = 3) -> str:
    """A unified diff."""
    a, b = _lines(old, "\n"), _lines(new, "\n")
    script = edit_script(a, b)
    head = f"--- {name}{chr(9) + old_header if old_header else ''}\n+++ {name}{chr(9) + new_header if new_header else ''}\n"
    rows: list[tuple[str, str, int, int]] = []
    for op, x1, x2, y1, y2 in script:
        lines = b[y1:y2] if op == "+" else a[x1:x2]
        rows += [(" " if op == "=" else op, line, x1 + (i if op != "+" else 0), y1 + (i if op != "-" else 0)) for i, line in enumerate(lines)]
    changed = [i for i, r in enumerate(rows) if r[0] != " "]
    out, at = [head], 0
    while at < len(changed):
        first = max(0, changed[at] - context)
        last = changed[at]
        while at < len(changed) and changed[at] - last <= 2 * context:
            last = changed[at]
            at += 1
        part = rows[first : last + context + 1]
        n_old, n_new = sum(r[0] != "+" for r in part), sum(r[0] != "-" for r in part)
        span = lambda start, n: f"{start + 1 if n else start}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{span(part[0][2], n_old)} +{span(part[0][3], n_new)} @@\n")
        for sign, line, _, _ in part:
            out.append(sign + (line if line.endswith("\n") else line + "\n\\ No newline at end of file\n"))
    return "".join(out)


_HUNK = "array<struct<value:string,added:boolean,removed:boolean>>"
_OFFSET = "array<struct<kind:int,old_start:int,old_end:int,new_start:int,new_end:int>>"


def diff(old: Column, new: Column, kind: str = "lines") -> Column:
    """Hunks by chars, words, lines or trimmed lines."""
    if kind not in ("chars", "words", "lines", "trimmed"):
        raise ValueError(f"unknown diff kind: {kind}")
    return scalar(lambda a, b: hunks(kind, a, b), _HUNK)(old, new)


def diff_offsets(old: Column, new: Column, kind: str = "lines") -> Column:
    return scalar(lambda a, b: offsets(kind, a, b), _OFFSET)(old, new)


def create_patch(old: Column, new: Column, name: str = "file") -> Column:
    return scalar(lambda a, b: patch_text(name, a, b), "string")(old, new)


# Keys that a merge never takes.
_UNSAFE = ("__proto__", "constructor", "prototype")


def merge_values(a, b, arrays: str = "concat"):
    """b over a: objects key by key, arrays one after another (or b's), else b, null too."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = dict(a)
        for k, v in b.items():
            if k not in _UNSAFE:
                out[k] = merge_values(out[k], v, arrays) if k in out else v
        return out
    if isinstance(a, list) and isinstance(b, list) and arrays == "concat":
        return a + b
    return b


@lru_cache(1)
def _encoder():
    return json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def merge_json(a: Column, b: Column, arrays: str = "concat") -> Column:
    """Deep merge of two JSON texts; keys come out sorted."""
    return scalar(lambda x, y: _encoder()(merge_values(json.loads(x), json.loads(y), arrays)), "string")(a, b)


def merge_all_json(items: Column, arrays: str = "concat") -> Column:
    """Left fold over an array of JSON texts; {} for none."""

    def fold(xs):
        out: object = {}
        for i, x in enumerate(xs):
            out = json.loads(x) if i == 0 else merge_values(out, json.loads(x), arrays)
        return _encoder()(out)

    return scalar(fold, "string")(items)
