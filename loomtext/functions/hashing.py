"""xxHash with a seed of choice (0 by default; the built-in xxhash64 fixes 42), digests as hex or signed longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.udf import scalar


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(kind: str, seed: int):
    def run(data: bytes):
        import xxhash

        b = bytes(data)
        if kind == "xxh32":
            return xxhash.xxh32_intdigest(b, seed)
        if kind == "xxh64":
            return _signed(xxhash.xxh64_intdigest(b, seed))
        if kind == "xxh3_64":
            return _signed(xxhash.xxh3_64_intdigest(b, seed))
        return xxhash.xxh3_128_hexdigest(b, seed)

    return run


def xxh32(data: Column, seed: int = 0) -> Column:
    """Unsigned 32 bits as a long."""
    return scalar(_digest("xxh32", seed), "long")(data.cast("binary"))


def xxh64(data: Column, seed: int = 0) -> Column:
    """64 bits as a signed long."""
    return scalar(_digest("xxh64", seed), "long")(data.cast("binary"))


def xxh3_64(data: Column, seed: int = 0) -> Column:
    return scalar(_digest("xxh3_64", seed), "long")(data.cast("binary"))


def xxh3_128(data: Column, seed: int = 0) -> Column:
    """32 hex digits."""
    return scalar(_digest("xxh3_128", seed), "string")(data.cast("binary"))


def as_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def chunks(data: Column, size: int) -> Column:
    """Consecutive parts of `size` bytes, the last may be shorter; none of empty data."""
    if size < 1:
        raise ValueError("chunk size must be greater than 0")
    n = F.octet_length(data)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(data, i + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<binary>")).when(data.isNotNull(), parts)


def hash_chunks(df: DataFrame, data: str, size: int, kind: str = "xxh64", seed: int = 0) -> DataFrame:
    """A row for each chunk: df's other columns, chunk (from 0) and digest."""
    fn = {"xxh32": xxh32, "xxh64": xxh64, "xxh3_64": xxh3_64}[kind]
    rest = [c for c in df.columns if c != data]
    rows = df.select(*rest, F.posexplode(chunks(F.col(data).cast("binary"), size)).alias("chunk", "_part"))
    return rows.select(*rest, "chunk", fn(F.col("_part"), seed).alias("digest"))


def hash_stream(df: DataFrame, key: str, order: str, data: str, kind: str = "xxh64", seed: int = 0) -> DataFrame:
    """(key, digest) of each key's parts in order, one update for each: what an incremental hasher gives."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        import xxhash

        h = {"xxh32": xxhash.xxh32, "xxh64": xxhash.xxh64, "xxh3_64": xxhash.xxh3_64, "xxh3_128": xxhash.xxh3_128}[kind](seed=seed)
        for x in t.sort_by("_o")["_d"].to_pylist():
            h.update(x or b"")
        if kind == "xxh3_128":
            return pa.table({"_k": t["_k"][:1], "digest": pa.array([h.hexdigest()])})
        return pa.table({"_k": t["_k"][:1], "digest": pa.array([_signed(h.intdigest()) if kind != "xxh32" else h.intdigest()], pa.int64())})

    t = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(data).cast("binary").alias("_d"))
    kind_of_key = t.schema["_k"].dataType.simpleString()
    return t.groupBy("_k").applyInArrow(run, f"_k {kind_of_key}, digest {'string' if kind == 'xxh3_128' else 'long'}").withColumnRenamed("_k", key)
