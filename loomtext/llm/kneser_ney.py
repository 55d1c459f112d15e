"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Tokens are words (A-Z as a-z) and one end for each text; a text's first context is a begin mark. A first count finds
the words, known by 64 bits of hash, and numbers them; a pair is then the exact numbers of its words. Counts are summed
within partitions first, then by hash buckets of the pair, so a frequent word spreads over all buckets; a last step
brings the buckets' sums for each word together, by ranges of its number. All write sorted hash arrays, or arrays by
number, to the shared folder, which workers map into memory. Of the corpus, the driver gets the number of words in each
of WORD_FILES files at most, and one row of totals.

To score, a chunk of texts asks for its distinct pairs: they are shuffled to the buckets that hold them, each of which
maps its file once and sends the counts back to the chunk, under a hash of the chunk's pairs. Should the chunks be cut
otherwise when the texts are read again, they look their pairs up themselves.

The order is two, see the README: at the tool's disk limit of 4 times the input, order three takes more.

Defined results: null texts count as empty; each text has its end token; rows with null doc_id train; repeated rows
count each time and score alike; with an empty training set each token has probability 1; other columns are ignored.
More than 2**32 - 2 distinct words raise an error.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import column_bytes, freeing, mix64, packed, text_chunks, unpacked, word_hashes
from loomtext.llm.files import local_path, read_file, write_file
from loomtext.session import shuffles_removed, workspace

END = np.uint64(0x68E31DA4C2B2AE3D)
#: Bytes of texts of a task that are counted together, that are scored together, and of text for each bucket.
GATHER, CHUNK, BUCKET = 16 << 20, 4 << 20, 8 << 20
LEAST_BUCKETS, WORD_FILES = 48, 16_384
_32 = np.uint64(32)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def token_hashes(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the n + 1 offsets of the texts."""
    words, offsets = word_hashes(*column_bytes(col))
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def pair_keys(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << _32 | number.astype(np.uint64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64) for v in values)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def word_bucket(codes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of 32-bit codes."""
    return (codes.astype(np.uint64) * np.uint64(n)) >> _32


def pair_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(keys) >> _32) * np.uint64(n)) >> _32


def _numbers(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4" if not len(x) or x.max() < 1 << 32 else "<u8").tobytes(), 1)


def _from_numbers(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<u8" if len(raw) == 8 * n else "<u4").astype(np.int64)


SENT = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.list_(pa.binary()))])
SENT_DDL = "kind string, bucket int, keys binary, sums array<binary>"


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(SENT.types)], schema=SENT)


def split_rows(kind: str, keys: np.ndarray, values: list[np.ndarray], bucket: np.ndarray, width: int) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order].astype(np.int64)) != 0])).tolist() if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        part = order[a:b]
        yield kind, int(bucket[part[0]]), packed(keys[part], width), [_numbers(v[part]) for v in values]


def gathered(table: pa.Table, kind: str, n_values: int, width: int) -> tuple[np.ndarray, ...]:
    keys, values = [], [[] for _ in range(n_values)]
    for k, key, sums in zip(table["kind"].to_pylist(), table["keys"].to_pylist(), table["sums"].to_pylist(), strict=True):
        if k == kind:
            keys.append(unpacked(key, width))
            for v, s in zip(values, sums, strict=True):
                v.append(_from_numbers(s, len(keys[-1])))
    none = np.empty(0, f"<u{width}")
    return summed(np.concatenate([none, *keys]), *(np.concatenate([np.empty(0, np.int64), *v]) for v in values))


def arrays_to_bytes(**arrays: np.ndarray) -> bytes:
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        data = a.tobytes()
        head[k] = [a.dtype.str, len(a), at]
        pad = -len(data) % 64
        parts += [data, bytes(pad)]
        at += len(data) + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return np.uint64(len(text)).tobytes() + text + b"".join(parts)


@lru_cache(20_000)
def _mapped(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(local_path(path), np.uint8, "r")
    return _arrays(data)


def _arrays(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int(data[:8].view(np.uint64)[0])
    return {k: data[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(bytes(data[8 : 8 + size])).items()}


def load_arrays(path: str, keep: bool = True) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped (and kept so for the next call), or read where the shared folder is not a file system that Python sees."""
    if local_path(path) is None:
        return _arrays(np.frombuffer(read_file(path), np.uint8))
    return _mapped(path) if keep else _mapped.__wrapped__(path)


def found(keys: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted queries are in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(query), np.int64), np.zeros(len(query), bool)
    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
    return at, keys[at] == query


@dataclass(frozen=True)
class Vocabulary:
    """The words of a corpus by ranges of their hash, one file each; a word's number is its file's base and its place there."""

    path: str
    bases: tuple[int, ...]
    tokens: int
    distinct: int

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown) and counts of sorted distinct word hashes."""
        number, count = np.full(len(w), -1), np.zeros(len(w), np.int64)
        for b, a, z in _runs(word_bucket(w >> _32, len(self.bases))):
            try:
                f = load_arrays(f"{self.path}/words-{b:06d}")
            except FileNotFoundError:  # no training word fell there
                continue
            at, ok = found(f["words"], w[a:z])
            number[a:z] = np.where(ok, at + self.bases[b], -1)
            count[a:z] = np.where(ok, f["counts"][at], 0)
        return number, count

    def tokens_of(self, col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number and count of each token, the number of the token before (`distinct` for the begin mark), and the offsets of the texts."""
        seq, offsets = token_hashes(col)
        w, place = np.unique(seq, return_inverse=True)
        number, count = (x[place] for x in self.find(w))
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[offsets[:-1]] = self.distinct
        return number, count, before, offsets


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    buckets: int
    types: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_left: float

    @property
    def path(self) -> str:
        return self.vocabulary.path

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of keys with counts 1 to 4; halves of the counts where there are too few to tell."""
    if min(n[:3]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(x if 0 < x < k + 1 else (k + 1) / 2 for k, x in enumerate(d))  # type: ignore[return-value]


def _count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5]


def _least(x: np.ndarray) -> np.ndarray:
    """x in as few bytes as hold its largest value."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def by_bucket(rows: DataFrame, n: int) -> DataFrame:
    """rows shuffled by bucket into as many tasks as there are buckets: more of them for a larger corpus, not larger ones."""
    return rows.repartition(n, "bucket").groupBy("bucket")


def vocabulary(docs: DataFrame, path: str, n: int) -> Vocabulary:
    """Counts the words of docs (text) into n files."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seqs, held
            w, c = counted(np.concatenate(seqs))
            seqs, held = [], 0
            return sent_batch(list(split_rows("word", w, [c], word_bucket(w >> _32, n), 8)))

        for t in text_chunks(batches, "text"):
            seqs.append(token_hashes(t["text"])[0])
            held += t["text"].nbytes
            if held >= GATHER:
                yield flush()
        if seqs:
            yield flush()

    def words(key: tuple, t: pa.Table) -> pa.Table:
        w, c = gathered(t, "word", 1, 8)
        write_file(f"{path}/words-{key[0].as_py():06d}", arrays_to_bytes(words=w, counts=_least(c)))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "distinct": pa.array([len(w)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    sizes = np.zeros(n, np.int64)
    tokens = 0
    with shuffles_removed(docs.sparkSession):
        files = by_bucket(docs.mapInArrow(freeing(count), SENT_DDL), n).applyInArrow(freeing(words), "bucket int, distinct long, tokens long").collect()  # WORD_FILES rows at most
    for r in files:
        sizes[r.bucket] = r.distinct
        tokens += r.tokens
    return Vocabulary(path, tuple((np.cumsum(sizes) - sizes).tolist()), tokens, int(sizes.sum()))


def train(docs: DataFrame, *, text: str = "text", path: str | None = None) -> Model:
    """Counts all texts of docs; the model's files are below path, in the shared folder if None."""
    docs = docs.select(F.col(text).alias("text"))
    path = path or workspace(docs.sparkSession, "kneser-ney")
    n = max(LEAST_BUCKETS, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    voc = vocabulary(docs, path, min(n, WORD_FILES))
    all_numbers, ranges = voc.distinct + 1, len(voc.bases)
    if all_numbers >= 1 << 32:
        raise ValueError(f"{voc.distinct} distinct words; numbers of pairs have 32 bits for each")
    number_bucket = lambda x: x.astype(np.uint64) * np.uint64(ranges) // np.uint64(all_numbers)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held
            k, c = counted(np.concatenate(keys))
            keys, held = [], 0
            return sent_batch(list(split_rows("pair", k, [c], pair_bucket(k, n), 8)))

        for t in text_chunks(batches, "text"):
            number, _, before, _ = voc.tokens_of(t["text"])
            keys.append(pair_keys(before, number))
            held += t["text"].nbytes
            if held >= GATHER:
                yield flush()
        if keys:
            yield flush()

    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        k, c = gathered(t, "pair", 1, 8)
        write_file(f"{path}/pairs-{bucket:06d}", arrays_to_bytes(keys=k, counts=_least(c)))
        # Contexts: tokens after them, and how many of the distinct ones came once, twice and more often.
        w, *sums = summed(k >> _32, c, c == 1, c == 2, c > 2)
        rows = list(split_rows("context", w, sums, number_bucket(w), 8))
        w, types = counted(k & np.uint64(0xFFFFFFFF))
        rows += split_rows("after", w, [types], number_bucket(w), 8)
        rows.append(("total", bucket % ranges, b"", [_numbers(_count_of_counts(c))]))
        return pa.Table.from_batches([sent_batch(rows)])

    def lower(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        low, high = -(-bucket * all_numbers // ranges), -(-(bucket + 1) * all_numbers // ranges)
        out = np.zeros((5, high - low), np.int64)
        w, *sums = gathered(t, "context", 4, 8)
        out[:4, w.astype(np.int64) - low] = sums
        w, types = gathered(t, "after", 1, 8)
        out[4, w.astype(np.int64) - low] = types
        write_file(f"{path}/lower-{bucket:06d}", arrays_to_bytes(**{k: _least(x) for k, x in zip(LOWER, out, strict=True)}))
        n_pairs = sum(_from_numbers(s[0], 4) for k, s in zip(t["kind"].to_pylist(), t["sums"].to_pylist(), strict=True) if k == "total") + np.zeros(4, np.int64)
        row = [int(types.sum()), *n_pairs.tolist(), *_count_of_counts(types).tolist(), int((types > 2).sum())]
        return pa.table({f"n{i}": pa.array([x], pa.int64()) for i, x in enumerate(row)})

    sent = by_bucket(docs.mapInArrow(freeing(count), SENT_DDL), n).applyInArrow(freeing(pairs), SENT_DDL)
    sums = by_bucket(sent, ranges).applyInArrow(freeing(lower), ", ".join(f"n{i} long" for i in range(10)))
    with shuffles_removed(docs.sparkSession):
        types, *n_of, more = (x or 0 for x in sums.agg(*(F.sum(f"n{i}") for i in range(10))).first())
    d = discounts(n_of[4:])
    left = (d[0] * n_of[4] + d[1] * n_of[5] + d[2] * more) / types if types else 1.0
    return Model(voc, n, types, discounts(n_of[:4]), d, left)


#: Arrays of each word by number: tokens after it; distinct ones that came once, twice, more often; distinct ones before it.
LOWER = ("total", "once", "twice", "more", "types")


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


class Scorer:
    def __init__(self, m: Model):
        self.m = m

    def words(self, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """For sorted distinct numbers (-1: unknown): lower-order probability, and as a context its sum and the weight left."""
        m, n, everything = self.m, len(number), self.m.vocabulary.distinct + 1
        types, total, left = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
        ranges, (d1, d2, d3) = len(m.vocabulary.bases), m.discounts
        skip = int(np.searchsorted(number, 0))
        for b, a, z in _runs(number[skip:].astype(np.uint64) * np.uint64(ranges) // np.uint64(everything)):
            a, z = a + skip, z + skip
            try:
                f = load_arrays(f"{m.path}/lower-{b:06d}")
            except FileNotFoundError:  # nothing was trained
                continue
            at = number[a:z] - -(-b * everything // ranges)
            types[a:z], total[a:z] = f["types"][at], f["total"][at]
            left[a:z] = np.where(total[a:z] > 0, (d1 * f["once"][at] + d2 * f["twice"][at] + d3 * f["more"][at]) / np.maximum(total[a:z], 1), 1.0)
        lower = _discounted(types, m.lower_discounts) / m.types if m.types else np.zeros(n)
        return lower + m.lower_left / everything, total, left

    def bucket_counts(self, bucket: int, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs of one bucket."""
        try:
            f = load_arrays(f"{self.m.path}/pairs-{bucket:06d}")
        except FileNotFoundError:
            return np.zeros(len(keys), np.int64)
        at, ok = found(f["keys"], keys)
        return np.where(ok, f["counts"][at], 0).astype(np.int64)

    def by_bucket(self, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of sorted distinct pairs by bucket, and (bucket, from, to) of each bucket's part in it."""
        bucket = pair_bucket(keys, self.m.buckets)
        order = np.argsort(bucket, kind="stable")
        return order, list(_runs(bucket[order]))

    def pairs(self, keys: np.ndarray, replies: str | None = None) -> np.ndarray:
        """Counts of sorted distinct pairs: as sent to their chunk, or looked up where there is no reply."""
        order, parts = self.by_bucket(keys)
        out = np.zeros(len(keys), np.int64)
        try:
            if replies is None:
                raise FileNotFoundError
            got = load_arrays(reply_path(replies, chunk_name(keys)), keep=False)["counts"]
        except FileNotFoundError:
            got = np.concatenate([np.empty(0, np.int64), *(self.bucket_counts(b, keys[order[a:z]]) for b, a, z in parts)])
        out[order] = got
        return out

    def asked(self, before: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose pair may have been seen, the distinct pairs of these, and the place of each among them."""
        known = np.flatnonzero((before >= 0) & (number >= 0))
        return known, *np.unique(pair_keys(before[known], number[known]), return_inverse=True)

    def texts(self, col: pa.ChunkedArray, replies: str | None = None) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score and score."""
        m = self.m
        if not len(col):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
        number, c, before, offsets = m.vocabulary.tokens_of(col)
        known, keys, place = self.asked(before, number)
        high = np.zeros(len(number))
        high[known] = _discounted(self.pairs(keys, replies), m.discounts)[place]
        w, place = np.unique(np.concatenate([number, before]), return_inverse=True)
        lower, total, left = self.words(w)
        own, ctx = place[: len(number)], place[len(number) :]
        p = np.where(total[ctx] > 0, high / np.maximum(total[ctx], 1), 0.0) + left[ctx] * lower[own]
        base = np.log10((c + 1) / (m.tokens + m.vocabulary.distinct + 1))
        add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731 - each text has a token, its end
        return np.diff(offsets), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def _planes(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def chunk_name(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def reply_path(folder: str, chunk: int) -> str:
    name = f"{chunk & (1 << 64) - 1:016x}"
    return f"{folder}/{name[:2]}/{name}"


def ask(docs: DataFrame, model: Model) -> str:
    """Sends the distinct pairs of each chunk of docs (text) to the buckets that hold them, and the counts back; returns the folder of the replies."""
    folder = workspace(docs.sparkSession, "kneser-ney-replies")
    pa_rows = lambda rows, names, kinds: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    names, kinds = ["chunk", "bucket", "data"], (pa.int64(), pa.int32(), pa.binary())

    def requests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for t in text_chunks(batches, "text", CHUNK):
            number, _, before, _ = model.vocabulary.tokens_of(t["text"])
            _, keys, _ = s.asked(before, number)
            order, parts = s.by_bucket(keys)
            chunk = chunk_name(keys)
            yield pa_rows([(chunk, b, packed(keys[order[a:z]])) for b, a, z in parts], names, kinds)

    def answers(key: tuple, t: pa.Table) -> pa.Table:
        s, bucket = Scorer(model), key[0].as_py()
        rows = [(c, bucket, _planes(s.bucket_counts(bucket, unpacked(d)))) for c, d in zip(t["chunk"].to_pylist(), t["data"].to_pylist(), strict=True)]
        return pa.Table.from_batches([pa_rows(rows, names, kinds)])

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        # Chunks alike in all pairs have one name; one of their replies is enough.
        parts = dict(zip(t["bucket"].to_pylist(), t["data"].to_pylist(), strict=True))
        counts = [_from_planes(parts[b]) for b in sorted(parts)]
        write_file(reply_path(folder, key[0].as_py()), arrays_to_bytes(counts=_least(np.concatenate(counts))))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64())})

    sent = by_bucket(docs.select("text").mapInArrow(freeing(requests), "chunk long, bucket int, data binary"), model.buckets)
    replies = sent.applyInArrow(freeing(answers), "chunk long, bucket int, data binary")
    with shuffles_removed(docs.sparkSession):
        replies.repartition(model.buckets, "chunk").groupBy("chunk").applyInArrow(freeing(gather), "chunk long").agg(F.count("*")).first()
    return folder


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() if len(x) else []
    for a, z in zip(cuts, [*cuts[1:], len(x)], strict=False):  # none of no keys
        yield int(x[a]), a, z


def score(docs: DataFrame, model: Model, *, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    replies = ask(rows, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for t in text_chunks(batches, "text", CHUNK):
            n, known, base, own = s.texts(t["text"], replies)
            columns = [t["doc_id"], t["held_out"], n, known, np.full(len(n), model.tokens), base, own, np.exp(-own / n * np.log(10))]
            yield from pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], schema=schema).to_batches()

    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame) -> DataFrame:
    """Trains on the documents whose crc32(doc_id) mod 7 is not 2, and scores all of them."""
    held = fold(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.where(~held)), held_out=held)
