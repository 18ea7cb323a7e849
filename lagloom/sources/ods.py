"""OpenDocument spreadsheets: sheets as rows of text, and rows as a sheet.

``format("ods")`` reads (path, row_no, cells) of one sheet of each file (option ``sheet`` names it), a task per file. It
writes one file where the path ends in .ods or .fods, and else a folder of files, some for each task. :func:`read_ods` reads through Spark's own binary files, from any store that Spark reaches.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import uuid
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import CELL_KINDS, normal_header, parsed_minutes
from .i18n import HEADERS

# Names, media type and limits of the OpenDocument format.
SPACES = {
    "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0",
    "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0",
    "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0",
    "style": "urn:oasis:names:tc:opendocument:xmlns:style:1.0",
    "number": "urn:oasis:names:tc:opendocument:xmlns:datastyle:1.0",
    "manifest": "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0",
}
MIME = "application/vnd.oasis.opendocument.spreadsheet"
MOST_ROWS = 1_048_576
#: A repeated cell or row stands for so many at most.
MOST_REPEATS = 4096
#: Rows of a file in a folder that is written: a task that reads holds one file's.
FILE_ROWS = 50_000
SCHEMA = "path string, row_no int, cells array<string>"


@functools.cache
def _name(short: str) -> str:
    space, _, local = short.partition(":")
    return f"{{{SPACES[space]}}}{local}"


# ---- reading
def _shown(cell: ET.Element) -> str:
    """The cell's own paragraphs; those of a comment in it are not its text."""
    lines = ("".join(child.itertext()).strip() for child in cell if child.tag == _name("text:p"))
    return " ".join(filter(None, lines))


def _clock(duration: str) -> str | None:
    """Hours and minutes of PT8H30M5S."""
    if not re.fullmatch(r"PT([\d.]+[HMS])+", duration):
        return None
    part = {unit: int(float(n)) for n, unit in re.findall(r"([\d.]+)([HMS])", duration)}
    return f"{part.get('H', 0):02d}:{part.get('M', 0):02d}"


def _number(value: str) -> str | None:
    try:
        x = float(value)
    except ValueError:
        return None
    return f"{x:.0f}" if x.is_integer() else repr(x)


#: Value type -> the attribute that holds the value, and how it reads; None leaves it to the text shown.
_TYPED = {
    "date": ("office:date-value", lambda v: v.partition("T")[0]),
    "time": ("office:time-value", _clock),
    "float": ("office:value", _number),
    "percentage": ("office:value", _number),
    "currency": ("office:value", _number),
    "boolean": ("office:boolean-value", str),
}


def _value(cell: ET.Element) -> str:
    attribute, read = _TYPED.get(cell.get(_name("office:value-type")), ("office:value", lambda v: None))
    return read(cell.get(_name(attribute)) or "") or _shown(cell)


def _times(element: ET.Element, attribute: str) -> int:
    found = re.fullmatch(r"\s*([+-]?\d+)\s*", element.get(_name(attribute)) or "")
    return sorted((1, int(found[1]), MOST_REPEATS))[1] if found else 1


def _content(data: bytes) -> io.BytesIO:
    """The content of a package, or of a flat file as it is."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return io.BytesIO(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return io.BytesIO(z.read("content.xml"))


def runs(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, int, int, int, str]]:
    """(row, rows, column, columns, text) of a sheet's cells that aren't blank, in order, as the file is read.

    A run is one value over some columns, in some rows. Blank cells only move the column on, and a blank
    row counts once however often it is repeated, so that no blank is ever expanded.
    """
    names, chosen, row = [], False, 0
    for event, element in ET.iterparse(_content(data), ("start", "end")):
        if event == "start":
            if element.tag == _name("table:table"):
                names.append(element.get(_name("table:name")))
                chosen = names[-1] == sheet if sheet is not None else len(names) == 1
        elif element.tag == _name("table:table"):
            if chosen:
                return
            element.clear()
        elif element.tag == _name("table:table-row"):
            if chosen:
                column, found = 0, []
                for cell in element.iterfind(_name("table:table-cell")):
                    wide = _times(cell, "table:number-columns-repeated")
                    if text := _value(cell):
                        found.append((column, wide, text))
                    column += wide
                rows = _times(element, "table:number-rows-repeated") if found else 1
                yield from ((row, rows, *run) for run in found)
                row += rows
            element.clear()
    if not names:
        raise ValueError("the file has no sheet")
    raise ValueError(f"no sheet {sheet!r}; the file has {', '.join(map(str, names))}")


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """Rows of a sheet up to its last cell, each up to its own last cell."""
    out: list[list[str]] = []
    first = 0
    for row, rows, column, wide, text in runs(data, sheet):
        if len(out) < row + rows:
            first = row
            out += [[] for _ in range(row + rows - len(out))]
        for line in out[first : row + rows]:
            line += [""] * (column - len(line)) + [text] * wide
    return out


# ---- writing
def _added(parent: ET.Element, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
    child = ET.SubElement(parent, _name(tag), {_name(k.replace("__", ":").replace("_", "-")): v for k, v in attributes.items()})
    child.text = text
    return child


def cell_kind(text: str) -> str:
    return next((kind for kind, look in CELL_KINDS.items() if re.fullmatch(look, text)), "string" if text else "blank")


def _cell(value) -> str:
    text = "" if value is None else str(value)
    stripped = text.strip()
    kind = cell_kind(stripped)
    if kind == "blank":
        return "<table:table-cell/>"
    if kind == "string":
        held = ""
    elif kind == "date":
        held = f'table:style-name="date" office:date-value="{stripped}" '
    elif kind == "time":
        hours, _, minutes = stripped.partition(":")
        held = f'table:style-name="time" office:time-value="PT{int(hours):02d}H{minutes}M00S" '
    else:
        held = f'office:value="{stripped}" '
    return f'<table:table-cell {held}office:value-type="{kind}"><text:p>{escape(text if kind == "string" else stripped, quote=False)}</text:p></table:table-cell>'


def write_document(out, rows: Iterator[Iterable], sheet: str = "diary") -> None:
    """Writes a minimal valid package: ``mimetype`` first and stored, then manifest, styles and content, row by row."""
    for prefix, uri in SPACES.items():
        ET.register_namespace(prefix, uri)
    root = ET.Element(_name("office:document-content"), {_name("office:version"): "1.2"})
    styles = _added(root, "office:automatic-styles")
    shown = {"date": ("-", ("year", "month", "day")), "time": (":", ("hours", "minutes"))}
    for kind, (mark, parts) in shown.items():
        data = _added(styles, f"number:{kind}-style", style__name=f"{kind}-parts")
        for i, part in enumerate(parts):
            if i:
                _added(data, "number:text", mark)
            _added(data, f"number:{part}", number__style="long")
        style = _added(styles, "style:style", style__name=kind, style__family="table-cell")
        style.set(_name("style:data-style-name"), f"{kind}-parts")
    book = _added(_added(root, "office:body"), "office:spreadsheet")
    table = _added(book, "table:table", table__name=sheet)
    _added(table, "text:p", "rows")  # the place of the rows; it has the root declare their prefix
    manifest = ET.Element(_name("manifest:manifest"), {_name("manifest:version"): "1.2"})
    for path, kind in (("/", MIME), ("content.xml", "text/xml"), ("styles.xml", "text/xml")):
        entry = _added(manifest, "manifest:file-entry", manifest__media_type=kind)
        entry.set(_name("manifest:full-path"), path)
    empty = ET.Element(_name("office:document-styles"), {_name("office:version"): "1.2"})
    told = lambda element: ET.tostring(element, encoding="UTF-8", xml_declaration=True)
    before, _, after = told(root).rpartition(b"<text:p>rows</text:p>")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", MIME, zipfile.ZIP_STORED)
        z.writestr("META-INF/manifest.xml", told(manifest))
        z.writestr("styles.xml", told(empty))
        with z.open("content.xml", "w", force_zip64=True) as f:
            f.write(before)
            for some in iter(lambda: list(itertools.islice(rows, 1000)), []):
                f.write("".join(f"<table:table-row>{''.join(map(_cell, r))}</table:table-row>" for r in some).encode())
            f.write(after)


def document(rows: Iterable[Iterable], sheet: str = "diary") -> bytes:
    """A sheet's package in memory."""
    out = io.BytesIO()
    write_document(out, iter(rows), sheet)
    return out.getvalue()


# ---- the data source
def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self):
        from pyarrow import fs

        system, path = _filesystem(self.path)
        if system.get_file_info(path).type != fs.FileType.Directory:
            return [InputPartition(path)]
        files = system.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.lower().endswith((".ods", ".fods"))] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with _filesystem(self.path)[0].open_input_file(partition.value) as f:
            data = f.read()
        for i, cells in enumerate(sheet_rows(data, self.sheet)):
            yield partition.value, i, cells


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.sheet, self.names, self.overwrite = options["path"], options.get("sheet", "diary"), schema.names, overwrite
        self.folder, self.run = not self.path.lower().endswith((".ods", ".fods")), uuid.uuid4().hex

    def write(self, rows):
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        if not self.folder:
            return _Written([self._file(system, path, self._most(rows))])
        system.create_dir(path, recursive=True)
        task, files = TaskContext.get().partitionId(), []
        # the first task's file has the names even without rows
        while (some := list(itertools.islice(rows, FILE_ROWS))) or not (task or files):
            files.append(self._file(system, f"{path.rstrip('/')}/part-{task:06d}-{len(files):06d}-{self.run}.ods", some))
        return _Written(files)

    def _most(self, rows):
        for n, r in enumerate(rows, 2):
            if n > MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write to a folder")
            yield r

    def _file(self, system, path: str, rows) -> str:
        with system.open_output_stream(path) as f:
            write_document(f, itertools.chain([self.names], rows), self.sheet)
        return path

    def commit(self, messages):
        if self.folder and self.overwrite:
            self._remove(lambda name: self.run not in name)

    def abort(self, messages):
        if self.folder:
            self._remove(lambda name: self.run in name)

    def _remove(self, which) -> None:
        from pyarrow import fs

        system, path = _filesystem(self.path)
        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.endswith(".ods") and which(f.base_name):
                system.delete_file(f.path)


class OdsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ods"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OdsSource)


def sheets(spark: SparkSession, path: str, sheet: str | None = None, titles: list[str] | None = None) -> DataFrame:
    """(path, row_no, cells) of a sheet of each file under a path, which may be a folder or a pattern.

    With ``titles`` a file whose first row is another is an error.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = sheet_rows(data, sheet)
                if titles is not None and rows and rows[0] != titles:
                    raise ValueError(f"{file} has the columns {rows[0]}, not {titles}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row_no", "cells"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, SCHEMA)


def canonical(titles: list[str], lang: str) -> dict[str, int]:
    """Canonical column name -> position; of equal names the last wins."""
    alias = HEADERS.get(lang, {})
    return {alias.get(n := normal_header(t or ""), n) or f"column_{i}": i for i, t in enumerate(titles)}


def filled(*cells) -> F.col:
    """Whether any of some texts is more than blanks."""
    return F.regexp_replace(F.concat_ws("", *cells), r"\s+", "") != ""


def read_ods(spark: SparkSession, path: str, sheet: str | None = None, lang: str = "en") -> DataFrame:
    """Rows of the sheet of one file, or of a folder's files with the same columns, in order of their names.

    The first row gives canonical column names; blank rows go.
    """
    raw = sheets(spark, path, sheet)
    first = raw.where("row_no = 0").take(1)
    if not first:
        return spark.createDataFrame([], "line_no int")
    names = canonical(first[0]["cells"], lang)
    cols = [F.coalesce(F.get("cells", i), F.lit("")).alias(n) for n, i in names.items()]
    rows = sheets(spark, path, sheet, first[0]["cells"]).where((F.col("row_no") > 0) & filled("cells"))
    return rows.select(F.struct("path", "row_no").alias("row_no"), *cols).transform(numbered)


def numbered(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """line_no from 2 on over rows that are not blank, in the order of row_no.

    Without ``by`` the rows are those of one diary file: as many as a person writes.
    """
    order = Window.partitionBy(*by).orderBy("row_no") if by else Window.orderBy("row_no")
    return df.withColumn("line_no", F.row_number().over(order) + 1).drop("row_no")


def typed(df: DataFrame) -> DataFrame:
    """Dates as dates, times as minutes, columns whose every value is a number as doubles; "" as null."""
    names = [c for c in df.columns if c not in ("date", "time", "line_no")]
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in names}
    counts = df.agg(*(F.count(blank[c]).alias(f"n_{c}") for c in names), *(F.count(blank[c].try_cast("double")).alias(f"d_{c}") for c in names)).first()
    out = [blank[c].try_cast("double").alias(c) if counts[f"n_{c}"] == counts[f"d_{c}"] > 0 else blank[c].alias(c) for c in names]
    if "date" in df.columns:
        out.append(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date"))
    if "time" in df.columns:
        out.append(parsed_minutes(F.col("time")).alias("time"))
    return df.select(*out)
