"""Token ids of whole texts by the tokenizers library, one call for each distinct word.

Words are parted at ASCII white space only. Every tokenizer file whose pattern never joins white space to other
characters, and whose normalizer works on characters and combining marks, gives the ids of a text as the ids of its
words one after another; `per_word` checks that a file is of this kind, and other files get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from loomtext.llm.common import column_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Distinct words whose ids a worker keeps at most, from one chunk to the next; others are looked up anew.
KEEP = 800_000


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def per_word(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm = [n["type"] for n in (j.get("normalizer") or {}).get("normalizers", [])]
    pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0] if pre else {}
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
        and not any(a["lstrip"] or a["rstrip"] or a["normalized"] or set(a["content"]) & set(" \t\n\r\f\v") for a in j["added_tokens"])
        and j.get("post_processor") is None
    )


@lru_cache(4)
def _mark(path: str) -> tuple[str, int]:
    """An added token that starts with <, and its id."""
    with open(path, encoding="utf-8") as f:
        return next(((a["content"], a["id"]) for a in json.load(f)["added_tokens"] if a["content"][0] == "<" and not a["single_word"]), ("", -1))


#: Letters that stay letters whatever the normalizer does, and so one piece. U+0130 does not: its lower case has a mark.
_ONE_PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+").fullmatch


@lru_cache(4)
def _ends(path: str) -> np.ndarray:
    """Which ids end a word; empty for files without word ends."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix")
    if not end:
        return np.empty(0, bool)
    out = np.zeros(max(model["vocab"].values()) + 1, bool)
    out[[i for k, i in model["vocab"].items() if k.endswith(end)]] = True
    return out


def rows_of(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered `index` one after another, and their lengths; list i is values[offsets[i]:offsets[i + 1]]."""
    n = offsets[index + 1] - offsets[index]
    ends = np.cumsum(n)
    at = np.repeat(offsets[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)
    return values[at], n


class Index(dict):
    """Numbers of words; one not met before gets the next, and is noted in new with the word whose ids begin its own.

    An ASCII word has the ids of its lower case, and a comma or full stop behind a letter or digit is a piece of its
    own; so only the lower case without it goes to the library."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.base: list[int] = []
        self.tail: list[int] = []

    def __missing__(self, word: bytes) -> int:
        base, tail, number = word, 0, -1
        if word.isascii() and b"<" not in word:
            base = word.lower()
            if base[-1] in b",." and base[-2:-1].isalnum():
                base, tail = base[:-1], base[-1]
            if base != word:
                number = self[base]
        self[word] = i = len(self)
        self.new.append(word)
        self.base.append(number)
        self.tail.append(tail)
        return i


class Words:
    """Ids by distinct word, grown chunk by chunk."""

    def __init__(self, path: str):
        self.path, self.index, self.offsets, self.values = path, Index(), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.chunks = np.zeros(0, np.int32)

    def used(self, index: np.ndarray) -> None:
        """Notes that one more chunk has these words."""
        self.chunks = np.pad(self.chunks, (0, len(self.index) - len(self.chunks)))
        self.chunks += np.bincount(index, minlength=len(self.chunks)) > 0

    def prune(self) -> None:
        """Forgets the words that one chunk alone had; all, if too many are left."""
        stay = np.flatnonzero(self.chunks > 1)
        if len(stay) > KEEP // 2:
            stay = stay[:0]
        words = list(self.index)
        self.values, n = rows_of(self.offsets, self.values, stay)
        self.offsets, self.chunks = np.concatenate([[0], np.cumsum(n)]), self.chunks[stay]
        self.index = Index()
        self.index.update(zip([words[i] for i in stay.tolist()], range(len(stay)), strict=True))

    def add(self) -> None:
        """Ids of the new words. Runs of words go to the library as one text each, parted by an added token, which it finds before all else."""
        x, known = self.index, len(self.offsets) - 1
        base, tail, whole = np.array(x.base), np.array(x.tail), np.array(x.base) < 0
        words = [w for w, b in zip(x.new, x.base, strict=True) if b < 0]
        x.new, x.base, x.tail = [], [], []
        t, (mark, mark_id) = tokenizer(self.path), _mark(self.path)
        # Words that are one piece each come first: they end where a token ends a word. Others are parted by the mark,
        # and those that may hold an added token go alone.
        text = [w.decode() for w in words]
        ends = _ends(self.path)
        one = [bool(len(ends)) and _ONE_PIECE(w) is not None for w in text]
        order = np.argsort(~np.array(one, bool), kind="stable")
        n_plain = sum(one)
        plain, other = [text[i] for i in order[:n_plain]], [text[i] for i in order[n_plain:]]
        alone = [i for i, w in enumerate(other) if "<" in w or not mark]
        runs, at = [], 0
        for i in [*alone, len(other)]:
            runs += [other[j : min(j + 400, i)] for j in range(at, i, 400)] + [other[i : i + 1]]
            at = i + 1
        runs = runs if runs[-1] else runs[:-1]
        found, lengths = [], []
        for i in range(0, len(plain), 20_000):
            part = [" ".join(plain[j : min(j + 400, i + 20_000)]) for j in range(i, min(i + 20_000, len(plain)), 400)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in t.encode_batch_fast(part, add_special_tokens=False)])
            found.append(ids)
            lengths.append(np.diff(np.flatnonzero(ends[ids]), prepend=-1))
        for i in range(0, len(runs), 50):
            part = runs[i : i + 50]
            for r, e in zip(part, t.encode_batch_fast([mark.join(r) for r in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                if len(r) == 1:
                    found.append(ids)
                    lengths.append([len(ids)])
                    continue
                cut = np.flatnonzero(ids == mark_id)
                lengths.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                found.append(np.delete(ids, cut))
        # Rows for the words that the library saw, then each new word as one of all rows, and its mark.
        offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate([np.empty(0, np.int64), *lengths]))])
        place = np.empty(len(whole), np.int64)
        place[np.flatnonzero(whole)[order]] = known + np.arange(len(order))
        row = np.where(whole, place, np.where(base < known, base, place[np.maximum(base - known, 0)]))
        ids, n = rows_of(offsets, np.concatenate([self.values, *found]), row)
        for c in b",.":
            has = tail == c
            more = t.encode(chr(c), add_special_tokens=False).ids
            for i in more:
                ids = np.insert(ids, np.cumsum(n)[has], i)
                n = n + has
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(n)])
        self.values = np.concatenate([self.values, ids.astype(np.uint32)])


_kept: dict[str, Words] = {}


def encode_texts(col: pa.ChunkedArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of each; null counts as empty."""
    buf, offsets = column_bytes(col)
    raw = buf.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    if not per_word(path):
        found = [e.ids for e in tokenizer(path).encode_batch_fast([x.decode("utf-8") for x in texts], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
    w = _kept.get(path)
    if w is None:
        w = _kept[path] = Words(path)
    elif len(w.index) > KEEP:
        w.prune()
    split = [x.split() for x in texts]
    counts = list(map(len, split))
    index = np.fromiter(map(w.index.__getitem__, chain.from_iterable(split)), np.int32, sum(counts))
    if w.index.new:
        w.add()
    w.used(index)
    del split
    ids, n = rows_of(w.offsets, w.values, index)
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    return ids, np.diff(ends)
