"""Class dictionaries from CSV, XML and XLSX files: small files, read on the driver through Spark's file systems."""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import SparkSession

from shoalgrid.operators.classify import ClassEntry

FIELDS = ("broad_lower", "broad_upper", "fine_lower", "fine_upper", "slope_lower", "slope_upper", "depth_lower", "depth_upper")
#: Element names of the bounds in XML records, in the order of FIELDS.
TAGS = ("SSB_LowerBounds", "SSB_UpperBounds", "LSB_LowerBounds", "LSB_UpperBounds", "Slope_LowerBounds", "Slope_UpperBounds", "Depth_LowerBounds", "Depth_UpperBounds")


class DictionaryError(ValueError):
    """A class dictionary that cannot be used."""


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise DictionaryError(f"{path} is not one file")
    return bytes(rows[0]["content"])


def _number(x: str | None) -> float | None:
    return None if x is None or not str(x).strip() else float(x)


def _entry(code: str, name: str, bounds: list[str | None], where: str) -> ClassEntry:
    try:
        return ClassEntry(int(float(code)), str(name).strip(), **{f: _number(v) for f, v in zip(FIELDS, bounds)})
    except ValueError as e:
        raise DictionaryError(f"{where}: {e}") from e


def parse_csv(raw: bytes) -> list[ClassEntry]:
    """Ten columns by position under a header with ``Class`` and ``Zone``; further ones are passed over."""
    text = raw.decode("utf-8-sig")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if any(x.strip() for x in r)]
    if not rows or len(rows[0]) < 10 or not {"Class", "Zone"} <= {h.strip() for h in rows[0]}:
        raise DictionaryError("the header must name Class, Zone and eight bounds")
    if len(rows) == 1:
        raise DictionaryError("the dictionary holds no class")
    out = []
    for k, r in enumerate(rows[1:], 2):
        if len(r) < 10:
            raise DictionaryError(f"row {k} has {len(r)} cells, 10 are needed")
        out.append(_entry(r[0], r[1], r[2:10], f"row {k}"))
    return out


def parse_xml(raw: bytes) -> list[ClassEntry]:
    out = []
    for k, rec in enumerate(ET.fromstring(raw).iter("ClassRec"), 1):
        text = lambda tag: (rec.findtext(tag) or "").strip() or None  # noqa: B023, E731
        if text("Class") is None or text("Zone") is None:
            raise DictionaryError(f"record {k} lacks Class or Zone")
        out.append(_entry(text("Class"), text("Zone"), [text(t) for t in TAGS], f"record {k}"))
    if not out:
        raise DictionaryError("the dictionary holds no class")
    return out


def parse_xlsx(raw: bytes) -> list[ClassEntry]:
    """First sheet; rows whose first cell is no number are passed over."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ET.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    out, wide = [], 0
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        wide = max(wide, len(row.findall("m:c", ns)))  # the header's width: trailing cells of a class may be left out
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.findall("m:c", ns)):
            ref = "".join(x for x in c.get("r", "") if x.isalpha())
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref))) - 1 if ref else k
            v = c.findtext("m:v", namespaces=ns)
            cells[at] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v is not None else v
        try:
            float(cells.get(0) or "")
        except ValueError:
            continue
        if wide < 10 and max(cells) < 9:
            raise DictionaryError("a class needs ten columns")
        out.append(_entry(cells[0], cells.get(1) or "", [cells.get(k) for k in range(2, 10)], f"row {row.get('r')}"))
    if not out:
        raise DictionaryError("the dictionary holds no class")
    return out


def read_dictionary(spark: SparkSession, path: str) -> list[ClassEntry]:
    kind = path.rsplit(".", 1)[-1].lower()
    parse = {"csv": parse_csv, "xml": parse_xml, "xlsx": parse_xlsx}.get(kind)
    if not parse:
        raise TypeError(f"dictionaries are .csv, .xml or .xlsx, not .{kind}")
    return parse(read_bytes(spark, path))
