"""BPE encoding and decoding through a pair occurrence index.

The distinct words of a chunk of a partition become one array of symbols in linked lists. The index maps each pair
of neighbours that has a merge rank to all its positions. Active ranks are taken in ascending order: all positions
of a pair merge at once, and the lists of the pairs that this makes to their left and right get the new positions.
Each word ends as if it had been merged alone, as every symbol is made by one merge: pairs made by rank r have
ranks above r.

Defined results: null counts as empty, and an empty text has no ids and decodes to ""; repeated rows get equal
results; other columns are kept by `encode` (new columns ids and n_tokens replace old ones of that name).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import column_bytes, freeing, text_chunks
from loomtext.llm.tokens import rows_of, tokenizer

#: Bytes of text whose distinct words are merged at once.
CHUNK = 16 << 20
_K = np.int64(1 << 21)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the kind that has word ends: NFC, lower case, a pattern that drops white space, byte symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, split = j["model"], j["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in j["normalizer"]["normalizers"]], [p["type"] for p in j["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: a tokenizer of another kind")
        if split["behavior"] != "Removed" or not split["invert"] or j["pre_tokenizer"]["pretokenizers"][1].get("add_prefix_space"):
            raise ValueError(f"{path}: a pattern of another kind")
        # For ASCII. \s means Unicode's white space there; the regex module's \s has U+001C to U+001F besides.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # Other texts go through the file's own normalizer and pre-tokenizer, whose Unicode tables are the library's.
        t = tokenizer(path)
        self.normalize, self.split = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]) + 1)
        for k, v in vocab.items():
            self.tokens[v] = k
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        for k, v in self.special.items():
            self.tokens[v] = k
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in pairs), strict=True))
        self.left, self.right, self.made = a, b, c
        order = np.argsort(a * _K + b)
        self.keys, self.ranks = (a * _K + b)[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none."""
        key = left.astype(np.int64) * _K + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def pieces(self, word: bytes) -> list[bytes | int]:
        """What the pattern finds in a word without ASCII white space, normalized, as UTF-8; ids of added tokens as they are."""
        s = word.decode("utf-8")
        if self.specials is not None and "<" in s and (found := list(self.specials.finditer(s))):
            out, at = [], 0
            for m in found:
                out += [*self.plain(s[at : m.start()]), self.special[m[0]]]
                at = m.end()
            return out + self.plain(s[at:])
        return self.plain(s)

    def plain(self, s: str) -> list[bytes]:
        if s.isascii():
            return [x.encode() for x in self.pattern.findall(s.lower())]
        byte = self.byte
        return [bytes([byte[c] for c in x]) for x, _ in self.split(self.normalize(s))]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of the left symbol of each pair, by rank."""

    def __init__(self) -> None:
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, r in zip(cuts[:-1], cuts[1:], ranks[cuts[:-1]].tolist(), strict=True):
            if r in self.lists:
                self.lists[r].append(positions[a:b])
            else:
                self.lists[r] = [positions[a:b]]
                heapq.heappush(self.active, r)

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.active)
        found = self.lists.pop(r)
        return r, found[0] if len(found) == 1 else np.concatenate(found)


def merge(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces (none empty) one after another, and the n + 1 offsets."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    n = len(raw)
    starts = np.concatenate([[0], ends[:-1]]) if len(pieces) else np.empty(0, np.int64)
    sym = np.full(n + 1, -2, np.int32)
    sym[:n] = v.inner[raw]
    sym[ends - 1] = v.last[raw[ends - 1]]
    # Position n stands for no neighbour; its symbol is in no pair.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = after[n] = n
    before[starts] = n
    index = PairIndex()
    first = v.rank(sym[:n], sym[after[:n]])
    at = np.flatnonzero(first >= 0)
    if len(at):
        index.add(first[at], at.astype(np.int32))
    while index.active:
        r, at = index.pop()
        a, b = v.left[r], v.right[r]
        if a == b:
            at = np.unique(at)
        at = at[(sym[at] == a) & (sym[after[at]] == b)]
        if a == b and len(at) > 1:
            # In a run of equal symbols, the pairs from its start on that do not share a symbol.
            head = np.concatenate([[True], after[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        nxt = after[gone]
        sym[at], sym[gone], after[at], before[nxt] = v.made[r], -1, nxt, at
        around = np.concatenate([before[at], at])
        new = v.rank(sym[around], sym[after[around]])
        has = new >= 0
        if has.any():
            index.add(new[has], around[has])
    alive = np.flatnonzero(sym[:n] >= 0)
    return sym[alive], np.searchsorted(alive, np.concatenate([starts, [n]]))


class Encoded:
    """Ids of the distinct words of some texts."""

    def __init__(self, texts: list[bytes], v: Vocabulary):
        words: set[bytes] = set()
        for x in texts:
            words.update(x.split())
        pieces: dict[bytes, int] = {}
        single: list[int | list] = []
        self.words = {w: i for i, w in enumerate(words)}
        for w in words:
            found = [pieces.setdefault(p, len(pieces)) if isinstance(p, bytes) else (p,) for p in v.pieces(w)]
            single.append(found[0] if len(found) == 1 and isinstance(found[0], int) else found)
        ids, offsets = merge(list(pieces), v)
        self.single, self.ids, self.offsets, self.tokens = single, ids, offsets, v.tokens

    def word_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids by word, and the offsets."""
        # Added tokens get lists of their own behind those of the pieces.
        n, extra = len(self.offsets) - 1, []
        flat, counts = [], []
        for x in self.single:
            x = [x] if isinstance(x, int) else x
            counts.append(len(x))
            for p in x:
                if isinstance(p, tuple):
                    extra.append(p[0])
                    p = n + len(extra) - 1
                flat.append(p)
        offsets = np.concatenate([self.offsets, self.offsets[-1] + np.arange(1, len(extra) + 1)])
        values = np.concatenate([self.ids, np.array(extra, np.int32)])
        ids, lengths = rows_of(offsets, values, np.array(flat, np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return ids, ends


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    """As a tokenizer without a decoder does: the tokens with spaces between, special ones too."""
    return " ".join([v.tokens[i] for i in ids])


def _texts(col: pa.ChunkedArray) -> list[bytes]:
    buf, offsets = column_bytes(col)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode_column(texts: list[bytes], path: str) -> tuple[list[np.ndarray], Encoded]:
    """Ids of each text."""
    e = Encoded(texts, vocabulary(path))
    values, offsets = e.word_ids()
    out = []
    for x in texts:
        index = np.fromiter(map(e.words.__getitem__, x.split()), np.int64)
        out.append(rows_of(offsets, values, index)[0])
    return out, e


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK // 2) -> DataFrame:
    """Columns `keep` of docs (all by default) with ids (array of int) and n_tokens."""
    rest = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    keep = rest if keep is None else keep
    schema = docs.select(*keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, text, chunk):
            ids = encode_column(_texts(t[text]), tokenizer_path)[0]
            out = t.select(keep).append_column("ids", pa.array(ids, pa.list_(pa.int32()))).append_column("n_tokens", pa.array([len(i) for i in ids], pa.int64()))
            del ids, t
            yield from out.to_batches(max_chunksize=1000)
            del out

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(freeing(run), schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()))


def decode_ids(df: DataFrame, tokenizer_path: str, *, ids: str = "ids") -> DataFrame:
    """df with decoded: the text that its ids stand for; null for null."""
    rest = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for b in batches:
            found = [None if x is None else decode(x, v) for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "decoded"])

    return df.select(*rest).mapInArrow(freeing(run), df.select(*rest).schema.add("decoded", T.StringType()))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text that they decode to.

    Both are put together from those of the words: ids and tokens are joined by one space each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer_path)
        for t in text_chunks(batches, "text", CHUNK):
            texts = _texts(t["text"])
            e = Encoded(texts, v)
            values, offsets = e.word_ids()
            values, ends = values.tolist(), offsets.tolist()
            number, token = [b"%d" % i for i in range(len(v.tokens))], [x.encode() for x in v.tokens]
            as_ids, as_text = {}, {}
            for w, i in e.words.items():
                ids = values[ends[i] : ends[i + 1]]
                if ids:
                    as_ids[w] = b" ".join([number[i] for i in ids])
                    as_text[w] = b" ".join([token[i] for i in ids])
            blank = len(as_ids) < len(e.words)
            counts, sha_ids, sha_text = [], [], []
            for x in texts:
                words = x.split()
                if blank:
                    words = [w for w in words if w in as_ids]
                all_ids = b" ".join(map(as_ids.__getitem__, words))
                counts.append(all_ids.count(b" ") + 1 if all_ids else 0)
                sha_ids.append(hashlib.sha256(all_ids).hexdigest())
                sha_text.append(hashlib.sha256(b" ".join(map(as_text.__getitem__, words))).hexdigest())
            out = pa.table({"doc_id": t["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": sha_ids, "decoded_sha256": sha_text})
            # Before the next chunk is read, nothing of this one is held.
            del texts, e, values, offsets, ends, as_ids, as_text
            yield from out.to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freeing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
