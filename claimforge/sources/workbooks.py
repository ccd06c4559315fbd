"""Workbooks as a data source: ``spark.read.format("workbook").option("sheet", name).load(path)``, a partition a sheet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from claimforge.session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass
class Sheet(InputPartition):
    file: str
    name: str
    part: str


def _store(path: str):
    """The file system of a path, in whatever store pyarrow knows, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n


class WorkbookReader(DataSourceReader):
    """Plans a partition for each sheet; reads rows one by one, so only the table of shared strings is held."""

    def __init__(self, options):
        self.path, self.sheet = options.get("path"), options.get("sheet")
        if not self.path:
            raise ValueError("workbook: no path")

    def partitions(self) -> list[Sheet]:
        import xml.etree.ElementTree as ET
        import zipfile

        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith((".xlsx", ".xlsm"))]
        found = []
        for file in sorted(files):
            with store.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                parts = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                    target = parts[sheet.get(_LINK)]
                    found.append(Sheet(file, sheet.get("name"), target[1:] if target.startswith("/") else f"xl/{target}"))
        return [s for s in found if self.sheet in (None, s.name)]

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        import xml.etree.ElementTree as ET
        import zipfile

        if partition is None:  # no sheet at all
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                with z.open("xl/sharedStrings.xml") as strings:
                    for _, item in ET.iterparse(strings):
                        if item.tag == f"{_MAIN}si":
                            shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                            item.clear()
            line = 0
            with z.open(partition.part) as sheet:
                for _, row in ET.iterparse(sheet):
                    if row.tag != f"{_MAIN}row":
                        continue
                    line = int(row.get("r") or line + 1)
                    cells: dict[int, str | None] = {}
                    for cell in row.iter(f"{_MAIN}c"):
                        at = _column(cell.get("r")) if cell.get("r") else max(cells, default=0) + 1
                        value = cell.findtext(f"{_MAIN}v")
                        if cell.get("t") == "inlineStr":
                            value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                        elif value is not None and cell.get("t") == "s":
                            value = shared[int(value)]
                        cells[at] = value
                    yield partition.file, partition.name, line, [cells.get(k) for k in range(1, max(cells, default=0) + 1)]
                    row.clear()


class WorkbookSource(DataSource):
    """``file, sheet, line, cells``; options ``path`` (a workbook, or a folder of them) and ``sheet`` (a name; all sheets if none)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, line int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``workbook`` known to the session."""
    ship(spark)
    spark.dataSource.register(WorkbookSource)
