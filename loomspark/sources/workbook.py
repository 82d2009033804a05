"""Workbook ingest.

``.xlsx`` files are zip archives of XML.  No spreadsheet library is installed, so the first
worksheet is decoded with the standard library inside ``mapInPandas``: each task decodes the files
of its partition and emits one long table of cells (path, row_no, col_name, value) for *all*
workbooks.  A sheet is read event by event and leaves in batches of ``BATCH_CELLS`` cells: a task
holds its shared strings and one batch, never a whole sheet.

Cell texts: strings (also in runs of rich text), booleans as True / False, whole numbers without a
point, other numbers as the shortest text of the double.  The style table tells dates from numbers:
a number under a date format is a date and time counted from the workbook's epoch (1900 or 1904), one
below 1 a time of day, one under an elapsed-time format a duration.  Errors and texts that stand for
a missing value (``MISSING``) are no cells.  Merged cells keep their value in the top-left cell,
formulas contribute their cached value.

Header rule: a *master* workbook has its header on row 1; a *mapping* workbook has three
metadata rows, the header on row 4 and data from row 5.  A file that cannot be decoded
yields no cells and an error row, and does not stop the batch: it is read through once before
anything of it is emitted.
"""
from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import path_stem, safe_table_name

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS_SCHEMA = "path string, row_no long, col_no long, col_name string, value string, error string"
BATCH_CELLS = 20_000

# fixed values: built-in numbers of date and time formats, and texts that stand for a missing value
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))
MISSING = frozenset((
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null"))
ELAPSED_FORMAT = 46


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not "A" <= ch <= "Z":
            break
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _workbook(z: zipfile.ZipFile) -> tuple[str, dt.datetime]:
    """The member that holds the first sheet, and day 0 of the workbook's dates."""
    root = ET.fromstring(z.read("xl/workbook.xml"))
    props = root.find(f"{_MAIN}workbookPr")
    late = props is not None and props.get("date1904", "0").lower() in ("1", "true")
    epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    rid = root.find(f"{_MAIN}sheets/{_MAIN}sheet").get(f"{_REL}id")
    for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return (target if target.startswith("xl/") else "xl/" + target), epoch
    return "xl/worksheets/sheet1.xml", epoch


def format_kind(code: str) -> str | None:
    """What a number format shows: ``date`` (also times), ``elapsed`` or None for numbers.  Literals, escaped
    characters, fills and bracketed colours or conditions say nothing."""
    bare = re.sub(r'"[^"]*"|\\.|[_*].', "", code.split(";")[0])
    if re.search(r"(?i)\[(?:h+|m+|s+)\]", bare):
        return "elapsed"
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    return "date" if re.search(r"(?i)[ymdhs]", bare) and not re.fullmatch(r"(?i)\s*general\s*", bare) else None


def _styles(z: zipfile.ZipFile) -> list[str | None]:
    """The kind of number that each cell style shows."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): format_kind(f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    known = {n: "date" for n in DATE_FORMATS} | {ELAPSED_FORMAT: "elapsed"} | own
    return [known.get(int(x.get("numFmtId", "0"))) for x in root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")]


def _text(item: ET.Element) -> str:
    """The text of a string item: its own and that of its rich-text runs, without phonetic hints."""
    return "".join(t.text or "" for part in item for t in (
        (part,) if part.tag == f"{_MAIN}t" else part.iterfind(f"{_MAIN}t") if part.tag == f"{_MAIN}r" else ()))


def _elements(z: zipfile.ZipFile, member: str, holder: str, tag: str) -> Iterator[ET.Element]:
    """The elements ``tag`` right below ``holder``, one at a time; each is forgotten when the next is asked for."""
    above = None
    with z.open(member) as f:
        for event, el in ET.iterparse(f, events=("start", "end")):
            if event == "start" and el.tag == _MAIN + holder:
                above = el
            elif event == "end" and el.tag == _MAIN + tag and above is not None:
                yield el
                above.clear()


def _date_text(serial: float, kind: str, epoch: dt.datetime) -> str:
    day, part = divmod(serial, 1)
    rest = dt.timedelta(milliseconds=round(part * 86_400_000))
    if kind == "elapsed":
        return str(dt.timedelta(days=day) + rest)
    if 0 <= serial < 1 and not rest.days:
        return str((dt.datetime.min + rest).time())
    if 1 <= serial < 60 and epoch.year < 1904:  # that calendar has a 29 February 1900
        day += 1
    return str(epoch + dt.timedelta(days=day) + rest)


def _number_text(raw: str, kind: str | None, epoch: dt.datetime) -> str:
    raw = raw.strip()
    whole = re.fullmatch(r"[+-]?[0-9]+", raw) is not None
    if kind is not None:
        try:
            return _date_text(float(raw), kind, epoch)
        except OverflowError:  # no date of this calendar
            pass
    value = int(raw) if whole else float(raw)
    return str(int(value)) if whole or (value == value and abs(value) != float("inf") and value == int(value)) else str(value)


def sheet_rows(data: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, {column index: text}) of the first worksheet, row by row; rows without a cell too."""
    z = zipfile.ZipFile(io.BytesIO(data))
    member, epoch = _workbook(z)
    kinds = _styles(z)
    shared = [_text(si) for si in _elements(z, "xl/sharedStrings.xml", "sst", "si")] \
        if "xl/sharedStrings.xml" in z.namelist() else []
    row_no = 0
    for row in _elements(z, member, "sheetData", "row"):
        row_no = int(row.get("r", row_no + 1))
        out, col = {}, -1
        for c in row.iterfind(f"{_MAIN}c"):
            ref = c.get("r")
            col = _col_index(ref) if ref else col + 1
            kind = c.get("t", "n")
            v = c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                inline = c.find(f"{_MAIN}is")
                text = _text(inline) if inline is not None else ""
            elif v is None or v.text is None or kind == "e":
                continue
            elif kind == "s":
                text = shared[int(v.text)]
            elif kind == "b":
                text = "True" if v.text.strip() == "1" else "False"
            elif kind == "str":
                text = v.text
            elif kind == "d":
                day = v.text.strip()
                text = str(dt.time.fromisoformat(day)) if re.match(r"[0-9]{2}:", day) else str(
                    dt.datetime.fromisoformat(day.removesuffix("Z")))
            else:
                style = int(c.get("s", "0"))
                text = _number_text(v.text, kinds[style] if style < len(kinds) else None, epoch)
            if text not in MISSING:
                out[col] = text
        yield row_no, out


class _Names:
    """Header texts by column: blanks become 'Unnamed: i'; repeats get '.1', '.2' (as pandas does).  Columns
    beyond the header are named when they are first met."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.seen: dict[str, int] = {}

    def widen(self, width: int, header: dict[int, str]) -> list[tuple[int, str]]:
        """Name all columns below ``width``; return the new ones."""
        new = []
        for i in range(len(self.names), width):
            n = header.get(i, "")
            n = n if n.strip() else f"Unnamed: {i}"
            if n in self.seen:
                self.seen[n] += 1
                n = f"{n}.{self.seen[n]}"
            else:
                self.seen[n] = 0
            self.names.append(n)
            new.append((i, n))
        return new


def sheet_cells(data: bytes, header_row: int) -> Iterator[tuple[int, int, str, str | None]]:
    """(row from 1 below the header, column, its name, text); row 0 names each column once, with no text."""
    names, header, before, read = _Names(), {}, 0, False
    for row_no, cells in sheet_rows(data):
        width = max(cells, default=-1) + 1
        if row_no < header_row:
            before = max(before, width)
            continue
        if row_no == header_row:
            header, read = cells, True
        if not read or row_no == header_row:  # (a sheet whose header row is missing has blank names)
            read = True
            width = max(width, before)
        for i, n in names.widen(width, header):
            yield 0, i, n, None
        if row_no > header_row:
            for i, text in cells.items():
                yield row_no - header_row, i, names.names[i], text
    for i, n in names.widen(before, header):
        yield 0, i, n, None


def _decode_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "row_no", "col_no", "col_name", "value", "error"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"row_no": "Int64", "col_no": "Int64"})
    for pdf in batches:
        for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
            data, header_row, out = bytes(content), 4 if kind == "mapping" else 1, []
            try:
                for _ in sheet_rows(data):  # a file that breaks off later must not leave some of its cells
                    pass
            except Exception as exc:  # noqa: BLE001 — one bad file must not stop the batch
                yield frame([(path, None, None, None, None, f"{type(exc).__name__}: {exc}")])
                continue
            for cell in sheet_cells(data, header_row):
                out.append((path, *cell, None))
                if len(out) >= BATCH_CELLS:
                    yield frame(out)
                    out = []
            yield frame(out)


def read_workbook_cells(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, kind, content) → long cell table for all workbooks.  Row 0 names
    every column, also those without a value and of sheets without data."""
    return files.select("path", "kind", "content").mapInPandas(_decode_partition, CELLS_SCHEMA)


def workbook_files(spark, roots: dict[str, str], folder_filter: str | None = None) -> DataFrame:
    """S1 with contents: {kind: root} (kind is 'mapping' or 'master')."""
    frames = []
    for kind, root in roots.items():
        root_name = root.rstrip("/").split("/")[-1]
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.xlsx").load(root))
        parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
        frames.append(df.select(F.regexp_replace("path", "^file:", "").alias("path"), "content",
                                F.col("modificationTime").alias("file_mtime"), F.lit(kind).alias("kind"),
                                F.when(parent == root_name, F.lit(root_name)).otherwise(parent).alias("source_folder")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if folder_filter:
        out = out.where(F.lower("path").contains(folder_filter.lower()))
    return out


def workbook_table(cells: DataFrame, path: str) -> DataFrame:
    """One workbook as an all-string table (S3 shape): pivot of its cells in column order."""
    one = cells.where((F.col("path") == path) & F.col("error").isNull())
    header = [r["col_name"] for r in one.select("col_no", "col_name").distinct().orderBy("col_no").collect()]
    data = one.where("row_no > 0")
    return data.groupBy("row_no").pivot("col_name", header).agg(F.first("value")).orderBy("row_no").drop("row_no")


def ingest(files: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Q21: decode changed workbooks and build registry entries.

    Returns (cells, entries).  Files whose (path, mtime) equals the registry's are
    skipped (T1).  entries: table_name, source_folder, file_path, columns, row_count,
    file_mtime, status (loaded / error)."""
    todo = files
    if registry is not None:
        seen = registry.select(F.col("file_path").alias("path"), "file_mtime")
        todo = files.join(seen, ["path", "file_mtime"], "left_anti")
    cells = read_workbook_cells(todo)
    return cells, registry_entries(todo, cells)


def registry_entries(todo: DataFrame, cells: DataFrame) -> DataFrame:
    """One registry entry per file of ``todo`` from its cells."""
    per_file = cells.groupBy("path").agg(
        F.count_distinct(F.when(F.col("row_no") > 0, F.col("row_no"))).alias("row_count"),
        F.array_sort(F.collect_set(F.struct("col_no", "col_name"))).alias("_cols"),  # bounded by sheet width
        F.max("error").alias("error"))
    return (todo.select("path", "source_folder", "file_mtime").join(per_file, "path", "left").select(
        safe_table_name(F.col("source_folder"), path_stem("path")).alias("table_name"),
        "source_folder", F.col("path").alias("file_path"),
        F.transform("_cols", lambda s: s["col_name"]).alias("columns"),
        F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), "file_mtime",
        F.when(F.col("error").isNotNull(), "error").otherwise("loaded").alias("status")))


def ingest_counts(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: how many of ``files`` were loaded, skipped as unchanged, or could not be decoded."""
    done = entries.groupBy("file_path").agg(F.first("status").alias("status"))
    return files.select(F.col("path").alias("file_path")).join(done, "file_path", "left").agg(
        F.count_if(F.col("status") == "loaded").alias("loaded"), F.count_if(F.col("status").isNull()).alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"))
