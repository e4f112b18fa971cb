"""Word documents (SRC-07, SNK-07): tables as cells from the parts of a DOCX archive, and documents from paragraphs and tables."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.archives import read_entries, zip_entries

#: Names of the format.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CELL = "archive string, table int, row int, col int, value string"
_W = f"{{{WORD}}}"


def _text(e: ElementTree.Element) -> str:
    """The text below an element: a line for each paragraph, tabs and breaks as such; tables inside cells aside."""
    lines = []
    for p in e.findall(f"{_W}p"):
        runs = ("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        lines.append("".join(runs))
    return "\n".join(lines).strip()


def table_cells(document: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, col, value), all from 1. A cell over several columns has its value in each; one that goes on from above has that one's."""
    for number, table in enumerate(ElementTree.fromstring(document).iter(f"{_W}tbl"), 1):
        above: dict[int, str] = {}
        for row, r in enumerate(table.findall(f"{_W}tr"), 1):
            col, now = 1, {}
            for c in r.findall(f"{_W}tc"):
                facts = c.find(f"{_W}tcPr")
                span = facts.find(f"{_W}gridSpan") if facts is not None else None
                merge = facts.find(f"{_W}vMerge") if facts is not None else None
                goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
                for _ in range(int(span.get(f"{_W}val", "1")) if span is not None else 1):
                    value = above.get(col, "") if goes_on else _text(c)
                    if merge is not None:
                        now[col] = value
                    if value:
                        yield number, row, col, value
                    col += 1
            above = now


def read_tables(files: DataFrame, path: str, content: str) -> DataFrame:
    """SRC-07: (archive, table, row, col, value) of DOCX files. A file that can't be read is one row without a table; value tells why."""
    entries = read_entries(files.select(F.col(path).alias("archive"), F.lit(0).alias("chunk"), F.col(content).alias("data")))
    main = entries.where("path = 'word/document.xml' or path is null").select("archive", "content", "problem")
    # an archive without the part is told too
    lacking = entries.groupBy("archive").agg(F.bool_or(F.coalesce(F.col("path") == "word/document.xml", F.lit(True))).alias("_has")).where("not _has").select("archive", F.lit(None).cast("binary").alias("content"), F.lit("not readable: no document").alias("problem"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for archive, raw, problem in zip(batch["archive"].to_pylist(), batch["content"], batch["problem"].to_pylist(), strict=True):
                try:
                    rows = [(archive, None, None, None, problem)] if problem else [(archive, *c) for c in table_cells(raw.as_py())]
                except (ElementTree.ParseError, ValueError) as e:
                    rows = [(archive, None, None, None, f"not readable: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")])

    return main.unionByName(lacking).mapInArrow(run, _CELL)


def rows_by_keyword(grid: DataFrame, wanted: dict[str, list[str]], heading: int = 1) -> DataFrame:
    """SRC-24, SRC-07: (archive, table, row, columns...) of tables below their heading row.

    A column is the first one whose heading contains the first keyword that any contains; tables without one of them have NULL
    there, tables without any have no rows.
    """
    keys = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("rank"), F.lit(w).alias("word")) for n, words in wanted.items() for i, w in enumerate(words)))
    heads = grid.where(F.col("row") == heading).select("archive", "table", "col", F.inline(F.filter(keys, lambda k: F.contains(F.lower("value"), k["word"]))))
    found = heads.groupBy("archive", "table", "name").agg(F.min(F.struct("rank", "col")).alias("c")).select("archive", "table", "name", "c.col")
    cells = grid.where(F.col("row") > heading).join(found, ["archive", "table", "col"])
    return cells.groupBy("archive", "table", "row").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted))


def _run(value: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{escape(value)}</w:t></w:r>'


def _document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Parts of one document from its blocks in order: a paragraph (text) or a table (rows)."""
    body = []
    for text, rows in zip(*(pdf.sort_values("ord")[c] for c in ("text", "rows")), strict=True):
        if rows is None:
            body.append("".join(f"<w:p>{_run(line)}</w:p>" for line in (text or "").split("\n")))
            continue
        width = max((len(r) for r in rows), default=0)
        told = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(f'<w:p>{_run(line)}</w:p>' for line in (v or '').split(chr(10)))}</w:tc>" for v in [*r, *[""] * (width - len(r))]) + "</w:tr>" for r in rows)
        body.append(f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * width}</w:tblGrid>{told}</w:tbl><w:p/>")
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{KIND}"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{WORD}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    return pd.DataFrame({"archive": pdf["archive"].iloc[0], "path": list(parts), "content": [p.encode() for p in parts.values()]})


def write_documents(blocks: DataFrame) -> DataFrame:
    """SNK-07: (archive, chunk, data): a DOCX file of each archive's blocks (archive, ord, text, rows array of arrays of texts)."""
    parts = blocks.select("archive", "ord", "text", "rows").groupBy("archive").applyInPandas(_document, "archive string, path string, content binary")
    return zip_entries(parts, "archive", "path", "content", manifest=False)
