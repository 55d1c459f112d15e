"""File types by magic bytes, as one CASE expression over the first bytes of a binary column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset, bytes, extension, media type. Longer and more specific ones come first.
SIGNATURES = [
    (0, "89504E470D0A1A0A", "png", "image/png"), (0, "FFD8FF", "jpg", "image/jpeg"), (0, "474946", "gif", "image/gif"), (8, "57454250", "webp", "image/webp"),
    (0, "49492A00", "tif", "image/tiff"), (0, "4D4D002A", "tif", "image/tiff"), (0, "424D", "bmp", "image/bmp"), (0, "00000100", "ico", "image/vnd.microsoft.icon"),
    (0, "38425053", "psd", "image/vnd.adobe.photoshop"), (0, "25504446", "pdf", "application/pdf"), (0, "504B0304", "zip", "application/zip"), (0, "504B0506", "zip", "application/zip"),
    (0, "1F8B08", "gz", "application/gzip"), (0, "425A68", "bz2", "application/x-bzip2"), (0, "FD377A585A00", "xz", "application/x-xz"), (0, "377ABCAF271C", "7z", "application/x-7z-compressed"),
    (0, "526172211A07", "rar", "application/vnd.rar"), (0, "28B52FFD", "zst", "application/zstd"), (257, "7573746172", "tar", "application/x-tar"), (0, "53514C69746520666F726D6174203300", "sqlite", "application/vnd.sqlite3"),
    (0, "0061736D", "wasm", "application/wasm"), (0, "7F454C46", "elf", "application/x-executable"), (0, "4D5A", "exe", "application/vnd.microsoft.portable-executable"), (0, "CAFEBABE", "class", "application/java"),
    (4, "66747970", "mp4", "video/mp4"), (0, "1A45DFA3", "mkv", "video/x-matroska"), (8, "41564920", "avi", "video/x-msvideo"), (0, "494433", "mp3", "audio/mpeg"),
    (0, "FFFB", "mp3", "audio/mpeg"), (0, "4F676753", "ogg", "audio/ogg"), (0, "664C6143", "flac", "audio/x-flac"), (8, "57415645", "wav", "audio/x-wav"),
    (0, "4D546864", "midi", "audio/midi"), (0, "774F4646", "woff", "application/font-woff"), (0, "774F4632", "woff2", "application/font-woff"), (0, "0001000000", "ttf", "application/font-sfnt"),
    (0, "4F54544F00", "otf", "application/font-sfnt"), (0, "D0CF11E0A1B11AE1", "doc", "application/msword"), (0, "7B5C727466", "rtf", "application/rtf"), (0, "50415231", "parquet", "application/vnd.apache.parquet"),
]
PREFIX = 4096


def file_type(data: Column) -> Column:
    """Struct of ext and mime; null for data of no known type. Only the first bytes are looked at, and turned to hex once."""
    pair = lambda ext, mime: F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"))

    def of(head: Column) -> Column:
        match = lambda at, magic: F.substring(head, 2 * at + 1, F.lit(len(magic))) == magic
        first, *rest = ((match(at, m) & match(0, "52494646") if at == 8 else match(at, m), pair(e, t)) for at, m, e, t in SIGNATURES)
        return reduce(lambda c, x: c.when(*x), rest, F.when(*first))

    return F.get(F.transform(F.array(F.hex(F.substring(data, 1, F.lit(300)))), of), 0)


def needed_prefix(data: Column) -> Column:
    return F.substring(data, 1, F.lit(PREFIX))
