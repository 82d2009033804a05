"""Workbook decoding: number formats, epochs, string forms, streamed sheets."""
import datetime as dt
import io
import subprocess
import sys
import zipfile

import pytest

from loomspark.sources import workbook as WB

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheet, shared="", styles="", props=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} {RNS}>{props}<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="/xl/worksheets/sheet1.xml" Type="x"/></Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/>'
          '<numFmt numFmtId="166" formatCode="[h]:mm:ss"/><numFmt numFmtId="167" formatCode="[Red]#,##0;[Blue]-0"/>'
          '<numFmt numFmtId="168" formatCode="General"/></numFmts>'
          '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="165"/>'
          '<xf numFmtId="166"/><xf numFmtId="167"/><xf numFmtId="168"/><xf numFmtId="46"/></cellXfs>')


def numbers(pairs, props=""):
    cells = "".join(f'<c s="{s}"><v>{v}</v></c>' for v, s in pairs)
    rows = dict(WB.sheet_rows(book(f"<row>{cells}</row>", styles=STYLES, props=props)))
    return [rows[1].get(i) for i in range(len(pairs))]


def test_dates_times_and_numbers_are_told_apart_by_their_style():
    assert numbers([(45292, 1), (45292.5, 2), (0.75, 3), (45292, 0), (45292, 4), (45292, 6), (45292, 7), (99, 99)]) == [
        "2024-01-01 00:00:00", "2024-01-01 12:00:00", "18:00:00", "45292", "45292", "45292", "45292", "99"]
    assert numbers([(1.5, 5), (0.25, 8), (2.000001, 1), (45292.000011574, 1)]) == [
        "1 day, 12:00:00", "6:00:00", "1900-01-02 00:00:00.086000", "2024-01-01 00:00:01"]
    assert numbers([(1, 1), (59, 1), (61, 1), (0, 1), (1e9, 1)]) == [
        "1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "00:00:00", "1000000000"]


def test_1904_epoch():
    props = '<workbookPr date1904="1"/>'
    assert numbers([(0.5, 1), (1, 1), (43830, 2)], props) == ["12:00:00", "1904-01-02 00:00:00", "2024-01-01 00:00:00"]
    day = dt.datetime(2024, 1, 1) - dt.datetime(1904, 1, 1)
    assert day.days == 43830


def test_number_texts():
    pairs = [("5.0", 0), ("1E3", 0), ("0.1", 0), ("-2.50", 0), ("12345678901234567890", 0), ("1E+20", 0), (" 7 ", 0)]
    assert numbers(pairs) == ["5", "1000", "0.1", "-2.5", "12345678901234567890", "100000000000000000000", "7"]


@pytest.mark.parametrize("code,kind", [
    ("yyyy-mm-dd", "date"), ("h:mm AM/PM", "date"), ("[$-409]d/m/yy", "date"), ("[mm]:ss", "elapsed"), ("0.00E+00", None),
    ('0 "mins"', None), ("[Red]0", None), ("#,##0_m", None), ("General", None), ("0;yyyy", None), ("\\d0", None)])
def test_format_kinds(code, kind):
    assert WB.format_kind(code) == kind


def test_string_forms_and_missing_values():
    shared = "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si><si><t>NA</t></si><si><t/></si><si><t> pad </t></si>"
    sheet = ('<row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="F2" t="s"><v>3</v></c><c t="b"><v>1</v></c></row>'
             '<row r="5"><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="str"><v>formula</v></c>'
             '<c t="e"><v>#DIV/0!</v></c><c t="d"><v>2024-01-01T10:00:00</v></c><c t="d"><v>2024-01-02</v></c><c t="s"><v>2</v></c>'
             '<c t="d"><v>10:30:00</v></c><c/></row><row/>')
    assert list(WB.sheet_rows(book(sheet, shared))) == [
        (2, {1: "rich text", 5: " pad ", 6: "True"}),
        (5, {0: "inline", 1: "formula", 3: "2024-01-01 10:00:00", 4: "2024-01-02 00:00:00", 6: "10:30:00"}), (6, {})]


def inline(row, texts):
    return f'<row r="{row}">' + "".join(f'<c r="{chr(65 + i)}{row}" t="inlineStr"><is><t>{t}</t></is></c>'
                                        for i, t in enumerate(texts) if t is not None) + "</row>"


def test_headers_of_wide_rows_and_metadata():
    sheet = inline(1, ["meta", None, None, None, "x"]) + inline(4, ["a", "a", " "]) + inline(5, ["1"]) + inline(
        6, [None] * 6 + ["far"]) + inline(7, ["a"])
    cells = list(WB.sheet_cells(book(sheet), 4))
    names = {c[1]: c[2] for c in cells if c[0] == 0}
    assert names == {0: "a", 1: "a.1", 2: "Unnamed: 2", 3: "Unnamed: 3", 4: "Unnamed: 4", 5: "Unnamed: 5", 6: "Unnamed: 6"}
    assert [c for c in cells if c[0]] == [(1, 0, "a", "1"), (2, 6, "Unnamed: 6", "far"), (3, 0, "a", "a")]
    no_header = list(WB.sheet_cells(book(inline(1, ["m", "m"]) + inline(6, ["v"])), 4))
    assert [c for c in no_header if c[0]] == [(2, 0, "Unnamed: 0", "v")] and len(no_header) == 3
    assert list(WB.sheet_cells(book(""), 1)) == []


def test_broken_files_leave_no_cells(spark):
    good = book(inline(1, ["h"]) + inline(2, ["v"]))
    cut = book(inline(1, ["h"]) + "".join(inline(i, ["v"]) for i in range(2, 60_000)) + '<row r="70000"><c t="s"><v>9</v></c></row>')
    files = spark.createDataFrame([("ok", "master", bytearray(good)), ("cut", "master", bytearray(cut)),
                                   ("no zip", "master", bytearray(b"x"))], "path string, kind string, content binary")
    rows = WB.read_workbook_cells(files).groupBy("path").agg({"value": "count", "error": "max"}).collect()
    got = {r["path"]: (r["count(value)"], r["max(error)"]) for r in rows}
    assert got["ok"] == (1, None) and got["cut"][0] == 0 and "IndexError" in got["cut"][1] and got["no zip"][0] == 0


MEMORY = """
import io, resource, sys, zipfile
sys.path[:0] = [{repo!r}, {repo!r} + "/tests"]
from loomspark.sources import workbook as WB
from test_workbook import NS, book
raw = io.BytesIO(book("<row/>"))
out = io.BytesIO()
with zipfile.ZipFile(raw) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
    for name in src.namelist():
        if "sheet1" not in name:
            z.writestr(name, src.read(name))
    with z.open("xl/worksheets/sheet1.xml", "w") as f:
        f.write(f"<worksheet {{NS}}><sheetData>".encode())
        for i in range(0, 1_000_000, 1000):
            f.write("".join(f'<row r="{{k + 1}}"><c r="A{{k + 1}}"><v>{{k}}</v></c><c t="str"><v>row {{k}}</v></c></row>'
                            for k in range(i, i + 1000)).encode())
        f.write(b"</sheetData></worksheet>")
import pandas as pd
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
n = last = 0
for frame in WB._decode_partition(iter([pd.DataFrame({{"path": ["p"], "kind": ["master"], "content": [out.getvalue()]}})])):
    n, last = n + len(frame), max(last, len(frame))
print(n, last, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, before)
"""


def test_a_sheet_of_a_million_rows_stays_small():
    import os
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", MEMORY.format(repo=repo)], cwd=repo, capture_output=True, text=True, timeout=300)
    n, last, peak, _ = map(int, done.stdout.split())
    assert n == 2 * 999_999 + 2 and last <= WB.BATCH_CELLS and peak < 300, (n, last, peak)
