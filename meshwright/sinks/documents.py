"""Documents as files: JSON, CSV with a byte order mark, Markdown tables, checksums and archives, workbooks.

These are small results: counts, libraries, reports. A table goes through the driver only by its caller's
choice; large ones are written with DataFrame.write.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from pathlib import Path
from string import ascii_uppercase
from typing import Any
from xml.etree.ElementTree import Element, SubElement, tostring
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a published library must not hold, and what stands in for folders.
PRIVATE_KEYS = ["examples", "source_svg_examples", "source_xml_examples"]
FOLDER_KEYS, MASK = ["svg_directory", "xml_directory"], "<source dataset not bundled>"


def write_json(path: str | Path, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> Any:
    """Tolerates a byte order mark."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def json_documents(df: DataFrame, key: str, path: str) -> None:
    """One line of JSON for each row, in a folder for each key: a document a drawing, written by the executors."""
    df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).write.partitionBy(key).text(path)


def cell(value: Any) -> Any:
    """Nested values as JSON, nothing as an empty cell."""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else "" if value is None else value


def write_csv(path: str | Path, rows: list[dict[str, Any]], fields: list[str] | None = None) -> None:
    """With a byte order mark and a header. Without fields they are the first row's, and no rows make no file."""
    if fields is None and not rows:
        return
    fields = fields or list(rows[0])
    out = io.StringIO()
    writer = csv.DictWriter(out, fields, extrasaction="ignore", restval="")
    writer.writeheader()
    writer.writerows({k: cell(r.get(k)) for k in fields} for r in rows)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(out.getvalue(), encoding="utf-8-sig", newline="")


def markdown_table(header: list[str], rows: list[list[Any]], most: int | None = None) -> str:
    lines = [header, ["---"] * len(header), *rows[:most]]
    return "\n".join("| " + " | ".join(str(cell(x)).replace("|", "\\|").replace("\n", " ") for x in line) + " |" for line in lines) + "\n"


def checksums(paths: list[str | Path]) -> str:
    """A line for each file: its SHA-256, two spaces and its name."""
    return "".join(f"{hashlib.sha256(Path(p).read_bytes()).hexdigest()}  {Path(p).name}\n" for p in paths)


def digests(spark, path: str) -> DataFrame:
    """(path, sha256) of all files under a path, by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def archive(path: str | Path, files: list[str | Path]) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, Path(f).name)


def sanitised(value: Any) -> Any:
    """A copy without evidence that names sources, at any depth, and with folders masked."""
    if isinstance(value, dict):
        return {k: MASK if k in FOLDER_KEYS else sanitised(v) for k, v in value.items() if k not in PRIVATE_KEYS}
    return [sanitised(v) for v in value] if isinstance(value, list) else value


def with_profile(library: dict[str, Any], name: str, profile: dict[str, Any], version: str) -> dict[str, Any]:
    """A copy of a library with one recognition profile set and the others kept."""
    return library | {"profile_extension_version": version, "recognition_profiles": library.get("recognition_profiles", {}) | {name: profile}}


def column_name(index: int) -> str:
    """A, B, ... Z, AA for 1, 2, ... 26, 27: names of one letter come first, then those of two, and so on."""
    letters, width, first = ascii_uppercase, 1, 1
    while index >= first + len(letters) ** width:
        first += len(letters) ** width
        width += 1
    return "".join(letters[(index - first) // len(letters) ** k % len(letters)] for k in range(width - 1, -1, -1))


#: Characters that XML can't hold.
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _sheet(rows: list[list[Any]], lists: dict[str, list[str]]) -> str:
    """A header that stays in view, a filter over all columns, and cells that take one of a list."""
    sheet = Element("worksheet", xmlns=_MAIN)
    view = SubElement(SubElement(sheet, "sheetViews"), "sheetView", workbookViewId="0")
    SubElement(view, "pane", ySplit="1", topLeftCell="A2", activePane="bottomLeft", state="frozen")
    data = SubElement(sheet, "sheetData")
    for r, row in enumerate(rows, 1):
        line = SubElement(data, "row", r=str(r))
        for k, value in enumerate(row, 1):
            at = SubElement(line, "c", r=f"{column_name(k)}{r}")
            match value:
                case bool():
                    at.set("t", "b")
                    SubElement(at, "v").text = "01"[value]
                case int() | float():
                    SubElement(at, "v").text = repr(value)
                case _:
                    at.set("t", "inlineStr")
                    text = SubElement(SubElement(at, "is"), "t", {"xml:space": "preserve"})
                    text.text = _UNPRINTABLE.sub("", str(cell(value)))
    wide, long = max(map(len, rows), default=1), max(len(rows), 1)
    SubElement(sheet, "autoFilter", ref=f"A1:{column_name(max(wide, 1))}{long}")
    if lists:
        checks = SubElement(sheet, "dataValidations", count=str(len(lists)))
        for at, values in lists.items():
            check = SubElement(checks, "dataValidation", type="list", allowBlank="1", sqref=at)
            SubElement(check, "formula1").text = f'"{",".join(values)}"'
    return tostring(sheet, encoding="unicode", xml_declaration=False)


def write_workbook(path: str | Path, sheets: dict[str, list[list[Any]]], lists: dict[str, dict[str, list[str]]] | None = None) -> None:
    """An Office Open XML workbook. lists: for a sheet, ranges and the values their cells may take."""
    numbers = range(1, len(sheets) + 1)
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in numbers)
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'
        + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets, strict=True))
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="{_PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        + "</Relationships>",
    }
    for i, (name, rows) in zip(numbers, sheets.items(), strict=True):
        parts[f"xl/worksheets/sheet{i}.xml"] = xml + _sheet(rows, (lists or {}).get(name, {}))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
