"""CSV as the format has it here: all fields strings, empty ones empty and never null, doubled quotes."""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions.udf import scalar


def _byte(name: str, value: str | int | None) -> str | None:
    if value is None:
        return None
    n = value if isinstance(value, int) else ord(value) if len(value) == 1 else -1
    if not 0 <= n <= 255:
        raise ValueError(f"{name} must be a single byte (0-255), got {value}")
    return chr(n)


def _options(delimiter, quote, escape, comment, trim, flexible) -> dict[str, str]:
    o = {"sep": _byte("delimiter", delimiter), "quote": _byte("quote_char", quote), "escape": _byte("escape_char", escape) or _byte("quote_char", quote), "comment": _byte("comment", comment), "mode": "PERMISSIVE" if flexible else "FAILFAST", "multiLine": "true", "inferSchema": "false", "enforceSchema": "true", "ignoreLeadingWhiteSpace": str(trim).lower(), "ignoreTrailingWhiteSpace": str(trim).lower()}
    return {k: v for k, v in o.items() if v is not None}


def read(spark: SparkSession, path: str, *, has_headers: bool = True, delimiter: str | int = ",", quote: str | int = '"', escape: str | int | None = None, comment: str | int | None = None, trim: bool = False, flexible: bool = False) -> DataFrame:
    """A file, or many, as a table of strings named by the header (or _c0, _c1, ...). Rows of other lengths fail unless flexible."""
    return spark.read.options(**_options(delimiter, quote, escape, comment, trim, flexible), header=str(has_headers).lower()).csv(path).na.fill("")


def write(df: DataFrame, path: str, *, delimiter: str | int = ",") -> None:
    """CSV files with header, quotes where a field needs them, null as empty."""
    df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").options(header="true", sep=_byte("delimiter", delimiter), escape='"', emptyValue="").csv(path)


def _rows(text: str, delimiter: str, quote: str, comment: str | None, trim: bool) -> list[list[str]]:
    lines = io.StringIO(text, newline="")
    source = (x for x in lines if not x.startswith(comment)) if comment else lines
    rows = [r for r in _csv.reader(source, delimiter=delimiter, quotechar=quote, doublequote=True) if r]
    return [[f.strip() for f in r] for r in rows] if trim else rows


def parse_rows(text: str, *, has_headers: bool = True, delimiter: str | int = ",", quote: str | int = '"', comment: str | int | None = None, trim: bool = False, flexible: bool = False) -> list[list[str]]:
    rows = _rows(text, _byte("delimiter", delimiter), _byte("quote_char", quote), _byte("comment", comment), trim)
    if not flexible and any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("a record has another number of fields than the first one")
    return rows[1:] if has_headers else rows


def parse(text: Column, **options) -> Column:
    """A column of CSV texts as arrays of rows; the header row is left out unless has_headers=False."""
    parse_rows("", **options)
    return scalar(lambda t: parse_rows(t, **options), "array<array<string>>")(text)


def parse_with_headers(text: Column, **options) -> Column:
    """Rows as maps; of columns with one name the last counts, fields beyond the header are left out."""

    def run(t: str):
        rows = parse_rows(t, **{**options, "has_headers": False, "flexible": True})
        return [dict(zip(rows[0], r, strict=False)) for r in rows[1:]] if rows else []

    return scalar(run, "array<map<string,string>>")(text)


def stringify(rows: Column, delimiter: str = ",") -> Column:
    """An array of rows as CSV text, lines ended by a line feed."""
    line = lambda r: F.concat(F.array_join(F.transform(r, lambda v: tx.csv_field(v, delimiter)), delimiter), F.lit("\n"))
    return F.array_join(F.transform(rows, line), "")


def stringify_objects(objects: Column, columns: Column | None = None, delimiter: str = ",") -> Column:
    """An array of maps as CSV text with header; columns are the sorted keys of the first one unless given; missing values are empty."""
    names = F.array_sort(F.map_keys(F.get(objects, 0))) if columns is None else columns
    rows = F.transform(objects, lambda o: F.transform(names, lambda k: F.coalesce(F.try_element_at(o, k), F.lit(""))))
    return F.when(F.size(objects) == 0, F.lit("")).otherwise(stringify(F.concat(F.array(names), rows), delimiter))


def count_rows(text: Column, **options) -> Column:
    return F.size(parse(text, **options)).cast("long")


def parse_to_json(text: Column, **options) -> Column:
    """Rows as a JSON array of arrays of strings."""
    return F.to_json(parse(text, **options))
