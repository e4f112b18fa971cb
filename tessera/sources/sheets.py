"""Workbooks of sheets (SRC-08, SNK-03): cells from the parts of an XLSX archive, and the parts from cells.

A workbook is read as a sparse grid: a row for each cell that has a value, with its place. Texts stand in a table that the
cells share; a merged area has its value in its first cell, or on demand in all. Tables come from the grid by expressions.
"""

from __future__ import annotations

import io
import itertools
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import archives

#: Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WORKSHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Sheets of the asset template and their columns in order; rows begin below two lines of headings.
ASSETS = {
    "Земельные участки": "num inventory_num name_accounting name_egrn address cad_number area land_category permitted_use group_common group owner status right_type extract_number extract_date book_value book_date encumbrances cadastral_value market_value".split(),
    "Здания, сооружения": "num inventory_num name_accounting object_type name_egrn address cad_number area purpose floors_total underground_floors wall_material year_built year_used land_cad_number group_common group owner status right_type extract_number extract_date book_value_initial book_date book_value_residual book_date_residual encumbrances cadastral_value market_value".split(),
}
ASSETS_FROM = 3
#: Cells of a batch, and texts of a workbook's table of shared ones.
_CELLS, _SHARED = 10_000, 100_000
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CELL = "archive string, sheet string, row int, col int, value string"


def letters(col: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def place(reference: str) -> tuple[int, int]:
    """B3 -> (3, 2)."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference)
    if not m:
        raise ValueError(f"not a cell: {reference!r}")
    col = 0
    for c in m[1]:
        col = 26 * col + ord(c) - 64
    return int(m[2]), col


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ElementTree.Element) -> str:
    """The text of a shared or inline string; its readings aside are left out."""
    return "".join(t.text or "" for part in e for t in ([part] if _local(part) == "t" else part if _local(part) == "r" else []) if _local(t) == "t")


class _Unordered(Exception):
    """Rows of a sheet that don't come in order."""


def _elements(z: zipfile.ZipFile, name: str, *tags: str) -> Iterator[ElementTree.Element]:
    """Elements of a part as they end; what has been told is let go."""
    with z.open(name) as f:
        above: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if _local(e) in tags:
                yield e
                if above:
                    above[-1].clear()


def _row_cells(r: ElementTree.Element, at_row: int, shared: list[str]) -> tuple[int, dict[tuple[int, int], str]]:
    """The number of a row and its cells that have a value."""
    at_row, at_col = int(r.get("r", at_row + 1)), 0
    grid: dict[tuple[int, int], str] = {}
    for c in r.iter(f"{{{MAIN}}}c"):
        row, at_col = place(c.get("r")) if c.get("r") else (at_row, at_col + 1)
        inside = {_local(e): e for e in c}
        kind, value = c.get("t", "n"), inside["v"].text if "v" in inside else None
        if kind == "s":
            value = shared[int(value)] if value is not None else None
        elif kind == "inlineStr":
            value = _said(inside["is"]) if "is" in inside else None
        elif kind == "b":
            value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
        if value is not None and value != "":
            grid[row, at_col] = value
    return at_row, grid


def cells(z: zipfile.ZipFile, fill: bool = False, whole: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of a workbook; booleans as TRUE and FALSE, errors as they are written.

    One row is held at a time, and the table of shared texts; a whole sheet where merged areas are filled, or if `whole`: that is
    needed where rows don't come in order, which is an error otherwise.
    """
    whole = whole or fill
    shared = [_said(e) for e in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
        target, name = targets[sheet.get(f"{{{RELATIONS}}}id")], sheet.get("name")
        grid: dict[tuple[int, int], str] = {}
        at_row, last = 0, (0, 0)
        for e in _elements(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", "row", "mergeCell"):
            if e.tag == f"{{{MAIN}}}row":
                at_row, found = _row_cells(e, at_row, shared)
                if whole:
                    grid |= found
                    continue
                for at in sorted(found):
                    if at <= last:
                        raise _Unordered
                    last = at
                    yield name, *at, found[at]
            elif fill and e.tag == f"{{{MAIN}}}mergeCell":
                (top, left), (bottom, right) = map(place, e.get("ref").split(":"))
                value = grid.get((top, left))
                if value is not None:
                    grid |= {(r, c): value for r in range(top, bottom + 1) for c in range(left, right + 1)}
        yield from ((name, r, c, v) for (r, c), v in sorted(grid.items()))


def _put(name: str, raw: bytes, fill: bool, whole: bool, file) -> None:
    """The cells of a workbook as batches of a stream in a file."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    schema = pa.schema([(c.split()[0], k) for c, k in zip(_CELL.split(", "), kinds, strict=True)])
    with pa.ipc.new_stream(file, schema) as out, zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = cells(z, fill, whole)
        while rows := list(itertools.islice(found, _CELLS)):
            out.write_batch(pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kinds[0]), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], schema=schema))


def read_cells(files: DataFrame, path: str, content: str, fill: bool = False) -> DataFrame:
    """SRC-08: (archive, sheet, row, col, value) of XLSX files. A file that can't be read is one row without a sheet; value tells why.

    Cells leave a task once the whole workbook has been read; until then they stand in a temporary file, not in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch["archive"].to_pylist(), batch["data"], strict=True):
                raw = raw.as_py() or b""
                with tempfile.TemporaryFile() as file:
                    try:
                        try:
                            _put(name, raw, fill, False, file)
                        except _Unordered:
                            file.seek(0)
                            file.truncate()
                            _put(name, raw, fill, True, file)
                    except (KeyError, ValueError, IndexError, TypeError, AttributeError, EOFError, NotImplementedError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
                        row = (name, None, None, None, f"not readable: {e}")
                        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")])
                        continue
                    file.seek(0)
                    with pa.ipc.open_stream(file) as read:
                        yield from read

    return files.select(F.col(path).cast("string").alias("archive"), F.col(content).alias("data")).mapInArrow(run, _CELL)


def table_rows(grid: DataFrame, sheet: str, columns: dict[str, int], first: int, needed: str) -> DataFrame:
    """SRC-08: (archive, row, columns...) of a sheet from row `first` on; columns by place (from 1); rows without the needed one fall away."""
    mine = grid.where((F.col("sheet") == sheet) & (F.col("row") >= first))
    byname = mine.groupBy("archive", "row").agg(*(F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for n, i in columns.items()))
    return byname.where(F.coalesce(F.trim(needed), F.lit("")) != "")


def asset_rows(grid: DataFrame, sheet: str) -> DataFrame:
    """SRC-08: the rows of one of the asset template's sheets; rows without a cadastral number fall away."""
    return table_rows(grid, sheet, {n: i for i, n in enumerate(ASSETS[sheet], 1)}, ASSETS_FROM, "cad_number")


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of workbooks from their cells in order; a row of a sheet is written when it ends."""
    space = lambda t: ' xml:space="preserve"' if t != t.strip() else ""
    book: archives.Chunks | None = None
    sheets: list[str] = []
    shared: dict[str, int] = {}
    areas: list[str] = []
    body: list[str] = []
    now = sheet = row = part = None

    def end_row() -> None:
        if body:
            part.write(f'<row r="{row}">{"".join(body)}</row>'.encode())
            body.clear()

    def end_sheet() -> None:
        end_row()
        tail = f'<mergeCells count="{len(areas)}">{"".join(areas)}</mergeCells>' if areas else ""
        part.write(f"</sheetData>{tail}</worksheet>".encode())
        part.close()
        areas.clear()

    def end_book() -> pa.RecordBatch:
        end_sheet()
        with book.part("xl/sharedStrings.xml") as f:
            f.write(f'{_HEAD}<sst xmlns="{MAIN}" uniqueCount="{len(shared)}">'.encode())
            f.writelines(f"<si><t{space(t)}>{escape(t)}</t></si>".encode() for t in shared)
            f.write(b"</sst>")
        listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
        book.put("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{listed}</sheets></workbook>'.encode())
        related = "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        related += f'<Relationship Id="rId{len(sheets) + 1}" Type="{RELATIONS}/sharedStrings" Target="sharedStrings.xml"/>'
        book.put("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">{related}</Relationships>'.encode())
        book.put("_rels/.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode())
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{WORKSHEET}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{WORKSHEET}.sheet.main+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{WORKSHEET}.sharedStrings+xml"/>'
        book.put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>'.encode())
        return book.close()

    for batch in batches:
        for name, in_sheet, in_row, col, value, numeric, until in zip(*(batch[c].to_pylist() for c in ("archive", "sheet", "row", "col", "value", "numeric", "until")), strict=True):
            if book is None or name != now:
                if book is not None:
                    yield end_book()
                book, now, sheet = archives.Chunks(name), name, None
                sheets, shared = [], {}
            if in_sheet != sheet or not sheets:
                if sheets:
                    end_sheet()
                sheet, row = in_sheet, None
                sheets.append(sheet)
                part = book.part(f"xl/worksheets/sheet{len(sheets)}.xml")
                part.write(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            if in_row != row:
                end_row()
                row = in_row
                if book.size() >= archives.CHUNK:
                    yield book.chunk()
            at = f"{letters(col)}{row}"
            if numeric:
                body.append(f'<c r="{at}"><v>{escape(value)}</v></c>')
            elif value in shared or len(shared) < _SHARED:
                body.append(f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            else:
                body.append(f'<c r="{at}" t="inlineStr"><is><t{space(value)}>{escape(value)}</t></is></c>')
            if until:
                areas.append(f'<mergeCell ref="{at}:{until}"/>')
    if book is not None:
        yield end_book()


def grid_of(df: DataFrame, archive: str, sheet: str, order: list, columns: list[str], at: int = 1) -> DataFrame:
    """Cells of a table: a heading, then its rows in order, for each archive; `at` tells which sheet of the archive it is."""
    from pyspark.sql import Window

    kinds = dict(df.dtypes)
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(archive).orderBy(*order)) + 1)
    cell = lambda i, c: F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value"), F.lit(kinds[c] not in ("string", "date", "boolean") and not kinds[c].startswith("timestamp")).alias("numeric"))
    rows = numbered.select(F.col(archive).cast("string").alias("archive"), F.col("_row").alias("row"), F.inline(F.array(*(cell(i, c) for i, c in enumerate(columns, 1))))).where("value is not null")
    head = df.select(F.col(archive).cast("string").alias("archive")).distinct().select("archive", F.lit(1).alias("row"), F.inline(F.array(*(F.struct(F.lit(i).alias("col"), F.lit(c).alias("value"), F.lit(False).alias("numeric")) for i, c in enumerate(columns, 1)))))
    return head.unionByName(rows).select("archive", F.lit(sheet).alias("sheet"), F.lit(at).alias("ord"), "row", "col", "value", "numeric", F.lit(None).cast("string").alias("until"))


def write_workbooks(grid: DataFrame) -> DataFrame:
    """SNK-03: (archive, chunk, data): an XLSX file of each archive's cells (sheet, ord, row, col, value, numeric, until).

    until: the last cell of an area that this one is merged over. Cells come in order and leave as chunks, so that no workbook is
    held; texts beyond the table of shared ones stand in their cells. Each workbook is written by one task, as the format asks
    for; it ends at 1,048,576 rows of a sheet.
    """
    rows = grid.select(F.col("archive").cast("string").alias("archive"), "ord", "sheet", "row", "col", "value", "numeric", "until")
    return archives.by_archive(rows, "ord", "sheet", "row", "col").mapInArrow(_workbooks, archives.CHUNKS)
