"""Compression, ZIP archives and XLSX workbooks in binary columns."""

from __future__ import annotations

import gzip as _gzip
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.udf import scalar

#: Output that decompression gives at most; 0 for no bound.
LIMIT = 256 << 20


def _inflate(data: bytes, wbits: int, limit: int) -> bytes:
    d = zlib.decompressobj(wbits)
    out = d.decompress(data, limit + 1 if limit else 0)
    if limit and len(out) > limit:
        raise ValueError(f"output exceeds {limit} bytes")
    return out + d.flush()


def _deflate(data: bytes, wbits: int, level: int) -> bytes:
    c = zlib.compressobj(min(9, level), zlib.DEFLATED, wbits)
    return c.compress(data) + c.flush()


def deflate(data: Column, level: int = 6) -> Column:
    return scalar(lambda b: _deflate(b, 15, level), "binary")(data.cast("binary"))


def inflate(data: Column, limit: int = LIMIT) -> Column:
    return scalar(lambda b: _inflate(b, 15, limit), "binary")(data)


def deflate_raw(data: Column, level: int = 6) -> Column:
    return scalar(lambda b: _deflate(b, -15, level), "binary")(data.cast("binary"))


def inflate_raw(data: Column, limit: int = LIMIT) -> Column:
    return scalar(lambda b: _inflate(b, -15, limit), "binary")(data)


def gzip(data: Column, level: int = 6) -> Column:
    return scalar(lambda b: _gzip.compress(b, min(9, level), mtime=0), "binary")(data.cast("binary"))


def ungzip(data: Column, limit: int = LIMIT) -> Column:
    return scalar(lambda b: _inflate(b, 31, limit), "binary")(data)


def zstd_compress(data: Column, level: int = 3, dictionary: bytes | None = None) -> Column:
    def run(b):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(level=level, dict_data=d).compress(bytes(b))

    return scalar(run, "binary")(data.cast("binary"))


def zstd_decompress(data: Column, dictionary: bytes | None = None) -> Column:
    def run(b):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        with zstandard.ZstdDecompressor(dict_data=d).stream_reader(io.BytesIO(bytes(b))) as r:
            out = r.read(LIMIT + 1) if dictionary else r.read()
        if dictionary and len(out) > LIMIT:
            raise ValueError(f"output exceeds {LIMIT} bytes")
        return out

    return scalar(run, "binary")(data)


def train_dictionary(samples: DataFrame, data: str, size: int = 112_640, rows: int = 10_000) -> bytes:
    """A zstd dictionary from `rows` samples at most, those with the smallest hashes."""
    import zstandard

    b = F.col(data).cast("binary")
    picked = [bytes(r.b) for r in samples.select(b.alias("b")).where("b is not null").orderBy(F.xxhash64("b")).limit(rows).collect()]
    return zstandard.train_dictionary(size, picked).as_bytes()


def zip_entries(data: Column, contents: bool = False) -> Column:
    """The entries of a ZIP archive: name, sizes, whether a folder, compression, and with contents the bytes of files."""
    kind = "array<struct<name:string,size:long,compressed_size:long,is_dir:boolean,compression:string,data:binary>>"

    def run(b):
        out = []
        with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
            for i in z.infolist():
                if contents and i.file_size > LIMIT:
                    raise ValueError(f"{i.filename}: output exceeds {LIMIT} bytes")
                how = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}.get(i.compress_type, str(i.compress_type))
                out.append({"name": i.filename, "size": i.file_size, "compressed_size": i.compress_size, "is_dir": i.is_dir(), "compression": how, "data": z.read(i) if contents and not i.is_dir() else None})
        return out

    return scalar(run, kind)(data)


def zip_read(data: Column, name: str) -> Column:
    """One entry's bytes; null if there is none of the name."""

    def run(b):
        with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
            return z.read(name) if name in z.namelist() else None

    return scalar(run, "binary")(data)


def extract_all(df: DataFrame, data: str) -> DataFrame:
    """A row for each file in each archive: df's other columns, name and data."""
    rest = [c for c in df.columns if c != data]
    e = df.select(*rest, F.explode(zip_entries(F.col(data), contents=True)).alias("_e"))
    return e.where("not _e.is_dir").select(*rest, F.col("_e.name").alias("name"), F.col("_e.data").alias("data"))


def zip_write(df: DataFrame, archive: str, name: str, data: str, method: str = "deflate", level: int = 6) -> DataFrame:
    """(archive, data): one ZIP archive for each value of `archive`, entries in order of name."""
    how = zipfile.ZIP_STORED if method == "store" else zipfile.ZIP_DEFLATED

    def run(t: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", how, compresslevel=level) as z:
            for r in t.sort_by("n").to_pylist():
                z.writestr(zipfile.ZipInfo(r["n"]), r["d"] or b"", how, level)
        return pa.table({"a": t["a"][:1], "data": pa.array([out.getvalue()], pa.binary())})

    t = df.select(F.col(archive).alias("a"), F.col(name).alias("n"), F.col(data).cast("binary").alias("d"))
    return t.groupBy("a").applyInArrow(run, f"a {t.schema['a'].dataType.simpleString()}, data binary").withColumnRenamed("a", archive)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
CELL = "struct<kind:string,text:string,number:double,bool_value:boolean>"
#: Number formats that show serial numbers as dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> dict:
    kind, v = c.get("t", "n"), c.find("m:v", _NS)
    text = v.text if v is not None else None
    cell = {"kind": "empty", "text": None, "number": None, "bool_value": None}
    if kind == "inlineStr":
        return cell | {"kind": "string", "text": "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))}
    if text is None:
        return cell
    if kind == "s":
        return cell | {"kind": "string", "text": shared[int(text)]}
    if kind == "str":
        return cell | {"kind": "string", "text": text}
    if kind == "b":
        return cell | {"kind": "bool", "bool_value": text == "1"}
    if kind == "e":
        return cell | {"kind": "error", "text": text}
    if int(c.get("s", "0")) in dates:
        return cell | {"kind": "date", "number": float(text), "text": text}
    return cell | {"kind": "number", "number": float(text)}


def read_sheets(data: bytes) -> list[dict]:
    """Sheets by name, with rows of cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{{{_NS['m']}}}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            dates = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", "0")) in _DATE_FORMATS | own}
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = targets[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", _NS):
                while "r" in row.attrib and len(rows) < int(row.get("r")) - 1:
                    rows.append([])
                cells: list[dict] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [{"kind": "empty", "text": None, "number": None, "bool_value": None}] * (at - len(cells))
                    cells.append(_cell(c, shared, dates))
                rows.append(cells)
            # A sheet is a rectangle: rows are filled up to the widest.
            width = max(map(len, rows), default=0)
            for cells in rows:
                cells += [{"kind": "empty", "text": None, "number": None, "bool_value": None}] * (width - len(cells))
            out.append({"name": s.get("name"), "rows": rows})
        return out


def xlsx_sheets(data: Column) -> Column:
    """All sheets of a workbook: name, and rows of cells (kind, text, number, bool_value)."""
    return scalar(lambda b: read_sheets(bytes(b)), f"array<struct<name:string,rows:array<array<{CELL}>>>>")(data)


def xlsx_cells(df: DataFrame, data: str) -> DataFrame:
    """A row for each cell: df's other columns, sheet, row_idx, col_idx, cell."""
    rest = [c for c in df.columns if c != data]
    s = df.select(*rest, F.explode(xlsx_sheets(F.col(data))).alias("_s"))
    r = s.select(*rest, F.col("_s.name").alias("sheet"), F.posexplode("_s.rows").alias("row_idx", "_r"))
    return r.select(*rest, "sheet", "row_idx", F.posexplode("_r").alias("col_idx", "cell"))


def xlsx_objects(data: Column, sheet: str | None = None) -> Column:
    """Rows of a sheet (the first by default) as maps by header; a header that is no text is 'column', cells beyond are 'colN'."""

    def show(c: dict) -> str:
        if c["kind"] == "number":
            return f"{c['number']:g}" if c["number"] != int(c["number"]) else str(int(c["number"]))
        return str(c["bool_value"]).lower() if c["kind"] == "bool" else c["text"] or ""

    def run(b):
        sheets = [s for s in read_sheets(bytes(b)) if sheet is None or s["name"] == sheet]
        if not sheets:
            raise ValueError(f"no sheet {sheet}")
        head, *rows = sheets[0]["rows"] or [[]]
        names = [c["text"] if c["kind"] == "string" else "column" for c in head]
        return [{names[i] if i < len(names) else f"col{i}": show(c) for i, c in enumerate(r)} for r in rows]

    return scalar(run, "array<map<string,string>>")(data)


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheets(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of strings, numbers and booleans; other values are left out."""
    if any(len(rows) > 1 << 20 or any(len(r) > 1 << 14 for r in rows) for _, rows in sheets):
        raise ValueError("row or column index out of range")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

    def cell(r: int, c: int, v) -> str:
        ref = f"{_letters(c)}{r + 1}"
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if isinstance(v, str) else ""

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), head + text, zipfile.ZIP_DEFLATED)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        put("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        put("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        for i, (_, rows) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def xlsx_write(df: DataFrame, workbook: str, sheet: str, order: str) -> DataFrame:
    """(workbook, data): a workbook for each value, its sheets with a header of df's other columns and rows in order."""
    columns = [c for c in df.columns if c not in (workbook, sheet, order)]

    def run(t: pa.Table) -> pa.Table:
        sheets: dict[str, list[list]] = {}
        for r in t.sort_by([(sheet, "ascending"), (order, "ascending")]).to_pylist():
            sheets.setdefault(r[sheet], [columns]).append([r[c] if isinstance(r[c], (str, int, float, bool)) or r[c] is None else str(r[c]) for c in columns])
        return pa.table({workbook: t[workbook][:1], "data": pa.array([write_sheets(list(sheets.items()))], pa.binary())})

    schema = T.StructType([df.schema[workbook], T.StructField("data", T.BinaryType())])
    return df.groupBy(workbook).applyInArrow(run, schema)


def sheet_from_objects(name: str, objects: list[dict]) -> bytes:
    """A workbook of one sheet: the header is the union of the objects' keys in order of first sight, missing values are empty."""
    names = list(dict.fromkeys(k for o in objects for k in o))
    return write_sheets([(name, [names, *([o.get(k) for k in names] for o in objects)] if objects else [])])


def xlsx_from_objects(objects: Column, name: str = "Sheet1") -> Column:
    """An array of maps of texts as a workbook."""
    return scalar(lambda rows: sheet_from_objects(name, [dict(r) for r in rows]), "binary")(objects)


def archive_files(spark, path: str) -> DataFrame:
    """Files as rows: path and content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def iter_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, z.read(i)
