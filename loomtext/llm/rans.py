"""Token files in static range asymmetric numeral systems.

A file holds the ids of documents in ascending doc_id order. Its frequency table is shared by all of its blocks;
each block encodes up to BLOCK ids on its own, over LANES interleaved states, so that a step of a block is one
array operation. The checkpoint table at the end gives, for each block, where its bytes begin, the number of its
first id, its lanes and two checksums (of its bytes and of its ids); a reader can start at any of them.

Layout: magic | frequency table | document index | blocks | JSON footer | footer length (u32) | magic.

Defined results: null or empty texts have the end id alone; null doc_ids come first; rows with one doc_id follow
one another by a hash of their text, and equal rows in any order, as they are alike; other columns are ignored; an
empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import freeing, text_chunks
from loomtext.llm.files import read_file, write_file
from loomtext.llm.tokens import encode_texts
from loomtext.session import stored, workspace

MAGIC = b"LTRANS01"
LANES, BLOCK, FILE_TOKENS = 1024, 1 << 18, 1 << 22
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts (all above 0) scaled to sum 2**bits, 1 at least; what rounding leaves goes to the largest."""
    total, size = int(counts.sum()), 1 << bits
    f = np.maximum(1, counts.astype(np.float64) * size / total).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    left = size - int(f.sum())
    if left > 0:
        f[order[0]] += left
    for i in order if left < 0 else ():
        take = min(-left, int(f[i]) - 1)
        f[i] -= take
        left += take
        if not left:
            break
    return f


def encode_block(sym: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int, lanes: int) -> bytes:
    """sym: numbers in the frequency table. The states, then the words in the order in which a decoder wants them."""
    x = np.full(lanes, LOW, np.uint64)
    shift, top, out = np.uint64(bits), np.uint64(63 - bits), []
    f_all, c_all = freq[sym], start[sym]
    for at in range((len(sym) - 1) // lanes * lanes, -1, -lanes):
        f, c = f_all[at : at + lanes], c_all[at : at + lanes]
        y = x[: len(f)]
        over = y >= (f << top)
        if over.any():
            out.append(y[over].astype(np.uint32))
            y[over] >>= _32
        q = y // f
        x[: len(f)] = (q << shift) + (y - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(out))


def decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, bits: int, lanes: int) -> np.ndarray:
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out, at_word = np.empty(n, slots.dtype), 0
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    for at in range(0, n, lanes):
        y = x[: min(lanes, n - at)]
        slot = y & mask
        s = slots[slot]
        out[at : at + lanes] = s
        y = freq[s] * (y >> shift) + slot - start[s]
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = (y[under] << _32) | words[at_word : at_word + len(under)]
            at_word += len(under)
        x[: len(y)] = y
    if at_word != len(words) or not (x == LOW).all():
        raise ValueError("a block does not end in its first state")
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    sym = (np.cumsum(counts > 0) - 1).astype(np.int32)[ids]
    bits = max(16, int(len(present)).bit_length() + 2)
    freq = frequencies(counts[present], bits)
    start = np.cumsum(freq) - freq
    parts = [MAGIC, zlib.compress(present.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)]
    known = np.array([d is not None for d in doc_ids], bool)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes() + np.asarray(lengths, "<i8").tobytes()
    parts.append(zlib.compress(index, 6))
    f, c, at, checkpoints = freq.astype(np.uint64), start.astype(np.uint64), sum(map(len, parts)), []
    for first in range(0, len(ids), BLOCK):
        part = sym[first : first + BLOCK]
        lanes = int(min(LANES, max(1, len(part) // 64)))
        data = encode_block(part, f, c, bits, lanes)
        checkpoints.append([at, len(data), first, len(part), lanes, zlib.crc32(data), _crc(ids[first : first + BLOCK])])
        parts.append(data)
        at += len(data)
    footer = json.dumps({"bits": bits, "symbols": len(present), "tokens": len(ids), "docs": len(doc_ids), "table": len(parts[1]), "index": len(parts[2]), "checkpoints": checkpoints}).encode()
    return b"".join([*parts, footer, np.uint32(len(footer)).tobytes(), MAGIC])


class TokenFile:
    """A reader; blocks can be decoded in any order and apart from one another."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file")
        size = int(np.frombuffer(data, "<u4", 1, len(data) - 12)[0])
        self.data, self.meta = data, json.loads(data[len(data) - 12 - size : len(data) - 12])
        m = self.meta
        table = np.frombuffer(zlib.decompress(data[8 : 8 + m["table"]]), "<u4").reshape(2, -1)
        self.symbols, freq = table[0].astype(np.uint32), table[1].astype(np.int64)
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) < 1 << 16 else np.uint32), freq)
        raw, n = zlib.decompress(data[8 + m["table"] : 8 + m["table"] + m["index"]]), m["docs"]
        known = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, 8 * n))[:n]
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n), known, strict=True)]
        self.lengths = np.frombuffer(raw[8 * n + (n + 7) // 8 :], "<i8")

    def block(self, i: int) -> np.ndarray:
        at, size, _, n, lanes, crc_data, crc_ids = self.meta["checkpoints"][i]
        data = self.data[at : at + size]
        if zlib.crc32(data) != crc_data:
            raise ValueError(f"block {i}: its bytes have changed")
        ids = self.symbols[decode_block(data, n, self.freq, self.start, self.slots, self.meta["bits"], lanes)]
        if _crc(ids) != crc_ids:
            raise ValueError(f"block {i}: its ids have changed")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.meta["checkpoints"]))] or [np.empty(0, np.uint32)])


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str, *, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes all texts into files below out_dir; returns their manifest (part, seq, path, docs, tokens), in file order by (part, seq).

    Texts are dealt out by ranges of doc_id and sorted within them; each task turns its range into files of about
    FILE_TOKENS ids, so memory does not depend on the size of a range.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, rows = TaskContext.get().partitionId(), 0, []
        doc_ids, lengths, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal doc_ids, lengths, held, size, seq
            path = f"{out_dir}/part-{part:06d}-{seq:06d}.ltrans"
            write_file(path, encode_file(doc_ids, np.concatenate(lengths), np.concatenate(held)))
            rows.append((part, seq, path, len(doc_ids), size))
            doc_ids, lengths, held, size, seq = [], [], [], 0, seq + 1

        for t in text_chunks(batches, "text", 8 << 20):
            ids, n = encode_texts(t["text"], tokenizer_path)
            ids = np.insert(ids, np.cumsum(n), end_id).astype(np.uint32)
            doc_ids += t["doc_id"].to_pylist()
            lengths.append(n + 1)
            held.append(ids)
            size += len(ids)
            if size >= FILE_TOKENS:
                flush()
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("part", "seq", "path", "docs", "tokens"))}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ordered.mapInArrow(freeing(write), "part int, seq int, path string, docs long, tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, *, digest: bool = False) -> DataFrame:
    """Documents in the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, and ids, or with digest their crc32."""
    # Ids before a file: those of the tasks before its own (a row for each task that wrote), and of its task's files before it.
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    files = manifest.withColumn("own", before(Window.partitionBy("part").orderBy("seq"))).join(F.broadcast(parts), "part")
    files = files.select("path", (F.col("base") + F.col("own")).alias("first")).repartition(max(2, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    kind = pa.uint32() if digest else pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", kind)])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["first"].to_pylist(), strict=True):
                f = TokenFile(read_file(path))
                ids, ends = f.ids(), np.cumsum(f.lengths)
                starts = ends - f.lengths
                for at in range(0, len(ends), 10_000):
                    a, z = starts[at : at + 10_000], ends[at : at + 10_000]
                    parts = [ids[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                    last = pa.array(map(_crc, parts), pa.int64()) if digest else pa.array([p.astype(np.int64) for p in parts], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[at : at + 10_000], pa.int64()), pa.array(a + base), pa.array(z - a), last], schema=schema)

    return files.mapInArrow(freeing(read), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2) -> DataFrame:
    """Writes token files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_files(docs, tokenizer_path, workspace(docs.sparkSession, "tokens"), end_id=end_id)
    return read_token_files(manifest, digest=True)
