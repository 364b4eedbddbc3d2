"""Workbooks (zipped spreadsheet XML) as a Spark data source, read and written in parallel.

Reading: one partition per worksheet. A worksheet holds at most 1,048,576 rows by
its format and is streamed, never held; a task keeps the workbook's shared strings.
Without the option ``sheet`` the first worksheet of every workbook is read and the
driver opens none of them; a name reads the worksheet of that name; ``*`` reads all,
for which the driver reads each workbook's list of worksheets.

Columns are found by the names in the first row that holds a value. A column that a
worksheet lacks raises ValueError; columns that the schema lacks are ignored, of
repeated names the first counts. Rows without any value are skipped. Empty cells and
error cells are null. A value that its column's type cannot hold is null, or raises
with the option ``mode`` set to FAILFAST. Numbers become text as they are shown in
general format (17850, 2.55). Days count from 1900 or 1904, as the workbook says, to
the nearest millisecond. An empty folder gives no rows.

Worksheets are parsed in pieces of whole rows. Cells as programs commonly write them are
found by one pattern and become Arrow columns; a piece that holds anything else goes
through an XML parser, as does the rest of a worksheet with comments or other markup.

Writing: every task streams its Arrow batches into workbooks of their own, the next one where
a worksheet is full. Files of failed attempts stay below ``_attempts`` and go when the
job ends; only those of committed tasks are moved into the folder.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Context, Decimal, InvalidOperation
from functools import cache, cached_property
from itertools import batched, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "workbook"
ATTEMPTS = "_attempts"
SHEET_ROWS = 1_048_576  # fixed by the format
SUFFIXES = (".xlsx", ".xlsm")
UNSAFE = "[\\x00-\\x08\\x0b-\\x1f\\ud800-\\udfff\\ufffe\\uffff]"  # what XML cannot hold, and line ends it alters
PIECE = 1 << 20  # bytes of a worksheet parsed at a time
DAY = 86_400_000  # milliseconds
ALTERED = "[&<>\\x00-\\x08\\x0b-\\x1f\\x{fffe}\\x{ffff}]|_x"  # what ``_safe`` changes in valid UTF-8
WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}  # bits
# Fixed values of the format: namespaces, part names and relation types.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


# A cell (column, kind, value, inline text), a row's start or a row's end, as programs commonly write them.
TOKEN = re.compile(
    rb'<c r="([A-Z]++)[0-9]++"(?: s="[0-9]*+")?+(?: t="([A-Za-z]++)")?+'
    rb"(?:>(?:<f(?: [^<>]*)?(?:/>|>[^<]*+</f>))?+"
    rb"(?:<v>([^<]*+)</v>|<is><t(?: [^<>]*+)?+>([^<]*+)</t></is>)?+</c>|/>)|<(/?+row)(?: [^<>]*+)?+>"
)


# --- values --------------------------------------------------------------------


def _shown(number: str) -> str:
    """A stored number as text: whole numbers without a point, others in their shortest form."""
    if number.removeprefix("-").isdigit():
        return number
    value = float(number)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _moments(texts: pa.Array, epoch_1904: bool) -> pa.Array:
    """``_moment`` of serial days; ArrowInvalid where one is no number or no moment."""
    serial = texts.cast(pa.float64()).fill_null(0).to_numpy()
    if not (np.abs(serial) < 2_900_000).all():
        raise pa.ArrowInvalid("not a serial day")
    base = [np.datetime64(day, "ms").astype(np.int64) for day in ("1904-01-01", "1899-12-31", "1899-12-30")]
    start = base[0] if epoch_1904 else np.where(serial < 60, base[1], base[2])
    moment = np.rint(serial * DAY).astype(np.int64) + start
    least, most = (np.datetime64(day, "ms").astype(np.int64) for day in ("0001-01-01", "9999-12-31"))
    if not ((moment >= least) & (moment < most)).all():
        raise pa.ArrowInvalid("not a moment")
    return pa.array(moment * 1000, mask=texts.is_null().to_numpy(zero_copy_only=False))


def _moment(value: str, number: bool, epoch_1904: bool) -> datetime:
    if not number:
        return datetime.fromisoformat(value).replace(tzinfo=None)
    serial = float(value)
    if epoch_1904:
        base = datetime(1904, 1, 1)
    else:  # the format counts a 29 February 1900, day 60, that never was
        base = datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    return base + timedelta(milliseconds=round(serial * DAY))


def converter(kind: T.DataType, epoch_1904: bool) -> Callable[[str, str], object]:
    """A function of (cell kind, text) to a value of the column's type; it raises ValueError.

    Cell kinds are ``n`` for numbers, ``b`` for truth values and ``t`` for text.
    """
    if isinstance(kind, T.StringType):
        shown = {"n": _shown, "b": lambda value: "TRUE" if value == "1" else "FALSE", "t": str}
        return lambda cell, value: shown[cell](value)
    if isinstance(kind, T.BooleanType):
        words = {"1": True, "0": False, "true": True, "false": False}

        def truth(cell: str, value: str) -> bool:
            if cell == "n":
                return float(value) != 0
            return words[value.strip().lower()]

        return truth
    if type(kind) in WHOLE:
        limit = 1 << (WHOLE[type(kind)] - 1)

        def whole(cell: str, value: str) -> int:
            number = Decimal(value.strip())
            if number != number.to_integral_value() or not -limit <= number < limit:
                raise ValueError(f"{value} does not fit {kind.simpleString()}")
            return int(number)

        return whole
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda cell, value: float(value)
    if isinstance(kind, T.DecimalType):
        step, room = Decimal(1).scaleb(-kind.scale), Context(prec=80)

        def exact(cell: str, value: str) -> Decimal:
            number = Decimal(value.strip()).quantize(step, context=room)
            if number.adjusted() >= kind.precision - kind.scale and number:
                raise ValueError(f"{value} does not fit {kind.simpleString()}")
            return number

        return exact
    if isinstance(kind, T.TimestampNTZType):
        return lambda cell, value: _moment(value, cell == "n", epoch_1904)
    if isinstance(kind, T.DateType):
        return lambda cell, value: _moment(value, cell == "n", epoch_1904).date()
    raise ValueError(f"workbooks hold no values of type {kind.simpleString()}")


# --- reading -------------------------------------------------------------------


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _children(stream, parent: str) -> Iterator[ElementTree.Element]:
    """The children of the named element of an XML stream, piece by piece; read ones are let go."""
    opened: list[ElementTree.Element] = []

    def make(tag: str, attributes: dict[str, str]) -> ElementTree.Element:
        element = ElementTree.Element(tag, attributes)
        if tag.endswith(parent):
            opened.append(element)
        return element

    parser = ElementTree.XMLParser(target=ElementTree.TreeBuilder(element_factory=make))
    while piece := stream.read(1 << 16):
        parser.feed(piece)
        if opened:
            done = opened[0][:-1]  # the last child may not have ended yet
            yield from done
            del opened[0][: len(done)]
    parser.close()
    if opened:
        yield from opened[0]


def _listed(texts: pa.Array, chosen: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The texts with the chosen ones changed."""
    if not pc.any(chosen).as_py():
        return texts
    return pc.replace_with_mask(texts, chosen, pa.array(map(change, texts.filter(chosen).to_pylist()), pa.string()))


def _unescaped(text: str) -> str:
    return ElementTree.fromstring(f"<t>{text}</t>").text


def _plain(text: str) -> str:
    """Undo the format's escapes of characters that XML cannot hold."""
    if "_x" not in text:
        return text
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda match: chr(int(match[1], 16)), text)


def _string(element: ElementTree.Element) -> str:
    """The text of a string, its formatted runs joined, without phonetic hints."""
    parts = []
    for child in element:
        if child.tag.endswith("}t"):
            parts.append(child.text or "")
        elif child.tag.endswith("}r"):
            parts.extend(run.text or "" for run in child if run.tag.endswith("}t"))
    return _plain("".join(parts))


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id -> (last word of the type, part name) of what a part refers to."""
    folder, name = posixpath.split(part)
    listing = posixpath.join(folder, "_rels", f"{name}.rels")
    if listing not in archive.namelist():
        return {}
    with archive.open(listing) as stream:
        return {
            entry.get("Id"): (
                entry.get("Type").rsplit("/", 1)[-1],
                posixpath.normpath(posixpath.join("/", folder, entry.get("Target"))).lstrip("/"),
            )
            for entry in ElementTree.parse(stream).getroot()
            if entry.get("TargetMode") != "External"
        }


class Workbook:
    """One open workbook."""

    def __init__(self, stream) -> None:
        self.archive = zipfile.ZipFile(stream)
        main = [part for kind, part in _relations(self.archive, "").values() if kind == "officeDocument"]
        self.part = main[0] if main else "xl/workbook.xml"
        self.related = _relations(self.archive, self.part)
        with self.archive.open(self.part) as listing:
            root = ElementTree.parse(listing).getroot()
        self.epoch_1904 = False
        self.sheets: dict[str, str] = {}
        for element in root.iter():
            if _name(element) == "workbookPr":
                self.epoch_1904 = element.get("date1904") in ("1", "true")
            elif _name(element) == "sheet":
                links = [value for key, value in element.attrib.items() if key.endswith("}id")]
                kind, part = self.related.get(links[0] if links else None, ("", ""))
                if kind == "worksheet":  # others hold charts or macros
                    self.sheets[element.get("name")] = part

    @cached_property
    def strings(self) -> pa.Array:
        for kind, part in self.related.values():
            if kind == "sharedStrings":
                with self.archive.open(part) as stream:
                    found = (list(map(_string, some)) for some in batched(_children(stream, "sst"), 4096))
                    chunks = [pa.array(some, pa.large_string()) for some in found]
                return pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())
        return pa.array([], pa.large_string())

    def rows(self, sheet: str) -> Iterator[dict[int, tuple[str, str]]]:
        """Column number -> (cell kind, text) of every row that holds a value."""
        with self.archive.open(self.sheets[sheet]) as stream:
            yield from filter(None, map(self._row, _children(stream, "sheetData")))

    def _row(self, row: ElementTree.Element) -> dict[int, tuple[str, str]]:
        prefix, cells, column = row.tag[: -len("row")], {}, -1
        for cell in row.findall(f"{prefix}c"):
            reference = cell.get("r")
            column = _column(reference.rstrip("0123456789")) if reference else column + 1
            found = _cell(cell, prefix, self.strings)
            if found is not None:
                cells[column] = found
        return cells

    def pieces(self, sheet: str, columns: list[int]) -> Iterator[tuple[int, list[tuple[pa.Array, pa.Array]]]]:
        """(rows, cell kinds and texts of each column) of the rows that hold a value, piece by piece."""
        done = 0
        with self.archive.open(self.sheets[sheet]) as stream:
            head, opening = b"", None
            while opening is None and (piece := stream.read(PIECE)):
                head += piece
                opening = re.search(rb"<sheetData(?: [^<>]*)?>", head)
            ended = common = opening is not None and _common(head[: opening.end()])
            if common:
                head, rest = head[: opening.end()], head[opening.end() :]
                ended = head.endswith(b"/>")
            while common and not ended:
                piece = stream.read(PIECE)
                rest += piece
                end = rest.find(b"</sheetData")
                ended = end >= 0 or not piece
                end = end if end >= 0 else rest.rfind(b"</row>") + len(b"</row>") if b"</row>" in rest else 0
                some, rest = rest[:end], rest[end:]
                common = b"<!" not in some and b"<?" not in some and (not ended or rest.startswith(b"</sheetData"))
                if common and some:
                    found = self._tokens(some, columns) or self._listed(_elements(head + some), columns)
                    done += found[0]
                    yield found
            while common and stream.read(PIECE):  # to the end, where the archive checks its sum
                pass
        if not common:
            for some in batched(islice(self.rows(sheet), done, None), 4096):
                yield self._taken(some, columns)

    def _listed(self, rows: list[ElementTree.Element], columns: list[int]):
        return self._taken([cells for cells in map(self._row, rows) if cells], columns)

    def _taken(self, rows: Sequence[dict[int, tuple[str, str]]], columns: list[int]):
        cells = [[row.get(column, (None, None)) for row in rows] for column in columns]
        return len(rows), [tuple(pa.array([cell[i] for cell in some], pa.string()) for i in (0, 1)) for some in cells]

    def _tokens(self, piece: bytes, columns: list[int]):
        """What ``pieces`` yields of whole rows, or None where they hold more than common cells."""
        if b"\r" in piece:
            piece = piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        parts = TOKEN.split(piece)
        if b"".join(parts[::6]).strip(b" \t\n"):
            return None
        letters, kinds, values, inline, edges = (pa.array(parts[i::6], pa.binary()) for i in range(1, 6))
        kinds = kinds.cast(pa.string()).fill_null("n")
        within = pc.equal(kinds, "inlineStr")
        texts = pc.if_else(within, inline, values)
        worded = pc.is_in(kinds, pa.array(["inlineStr", "s", "str", "d"]))
        held = pc.and_(pc.and_(texts.is_valid(), pc.not_equal(kinds, "e")),
                       pc.or_(worded, pc.greater(pc.binary_length(texts).fill_null(0), 0)))
        token = np.flatnonzero(held.to_numpy(zero_copy_only=False))
        number = np.cumsum(pc.equal(edges, b"row").fill_null(False).to_numpy(zero_copy_only=False))[token]
        filled, number = np.unique(number, return_inverse=True)
        letters = letters.take(pa.array(token)).dictionary_encode()
        names = [_column(name.decode()) for name in letters.dictionary.to_pylist()]
        place = letters.indices.to_numpy()
        found = []
        for column in columns:
            chosen = np.full(len(filled), -1)
            if column in names:
                mine = place == names.index(column)
                chosen[number[mine]] = token[mine]  # of repeated cells the last
            chosen = pa.array(chosen, mask=chosen < 0)
            found.append(self._resolved(kinds.take(chosen), texts.take(chosen).cast(pa.string())))
        return len(filled), found

    def _resolved(self, kinds: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Texts without entities, escapes and references to shared strings."""
        texts = _listed(texts, pc.match_substring(texts, "&").fill_null(False), _unescaped)
        shared = pc.equal(kinds, "s").fill_null(False)
        if pc.any(shared).as_py():
            known = self.strings.take(texts.filter(shared).cast(pa.int64())).cast(pa.string())
            texts = pc.replace_with_mask(texts, shared, known)
        own = pc.is_in(kinds, pa.array(["inlineStr", "str", "d"]))
        texts = _listed(texts, pc.and_(own, pc.match_substring(texts, "_x").fill_null(False)), _plain)
        return pc.if_else(pc.and_(kinds.is_valid(), pc.or_(own, shared)), "t", kinds), texts


def _common(head: bytes) -> bool:
    """Whether a worksheet's XML up to its rows is plain UTF-8 without comments or declarations."""
    declared = re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding=[\"']([^\"']*)", head)
    return b"<!" not in head and (declared is None or declared[1].lower() in (b"utf-8", b"us-ascii"))


def _elements(xml: bytes) -> list[ElementTree.Element]:
    """The rows of a worksheet's beginning."""
    opened: list[ElementTree.Element] = []

    def make(tag: str, attributes: dict[str, str]) -> ElementTree.Element:
        element = ElementTree.Element(tag, attributes)
        if tag.endswith("sheetData"):
            opened.append(element)
        return element

    ElementTree.XMLParser(target=ElementTree.TreeBuilder(element_factory=make)).feed(xml)
    return opened[0][:]


@cache
def _column(letters: str) -> int:
    """The number of a column: A is 0, AA is 26; there are at most 16,384."""
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _cell(cell: ElementTree.Element, prefix: str, strings: pa.Array) -> tuple[str, str] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{prefix}is")
        return None if inline is None else ("t", _string(inline))
    text = cell.findtext(f"{prefix}v")
    if text is None or kind == "e":
        return None
    if kind == "s":
        return "t", strings[int(text)].as_py()
    if kind in ("str", "d"):
        return "t", _plain(text)
    return (kind, text) if text else None


@dataclass
class SheetPartition(InputPartition):
    """One worksheet; without a name the first of its workbook."""

    file: str
    sheet: str | None


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.sheet, self.mode = options.get("sheet"), options.get("mode", "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError(f"unknown mode {self.mode}")
        for field in schema.fields:
            converter(field.dataType, False)  # raises before any task starts

    def partitions(self) -> list[SheetPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            files = [root]
        else:
            entries = system.get_file_info(fs.FileSelector(root))
            files = sorted(
                entry.path
                for entry in entries
                if entry.type == fs.FileType.File
                and entry.base_name.lower().endswith(SUFFIXES)
                and not entry.base_name.startswith(("_", ".", "~"))
            )
        if self.sheet != "*":
            return [SheetPartition(file, self.sheet) for file in files]
        found = []
        for file in files:
            with system.open_input_file(file) as stream:
                found += [SheetPartition(file, name) for name in Workbook(stream).sheets]
        return found

    def read(self, partition: SheetPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as stream:
            book = Workbook(stream)
            name = partition.sheet or next(iter(book.sheets), None)
            if name not in book.sheets:
                raise ValueError(f"{partition.file} has no worksheet {name}")
            titles = {}
            for column, (kind, text) in sorted(next(book.rows(name), {}).items()):
                titles.setdefault(_shown(text) if kind == "n" else text, column)
            missing = [field.name for field in self.schema.fields if field.name not in titles]
            if missing:
                raise ValueError(f"{partition.file}, {name}: no column {', '.join(missing)}")
            columns = [titles[field.name] for field in self.schema.fields]
            schema, skipped = to_arrow_schema(self.schema), 0  # the row of titles is skipped
            for rows, cells in book.pieces(name, columns):
                begin, skipped = (1 - skipped, 1) if rows else (0, skipped)
                if rows > begin:
                    arrays = [
                        self._array(kinds.slice(begin), texts.slice(begin), field.dataType, kept.type, book.epoch_1904)
                        for (kinds, texts), field, kept in zip(cells, self.schema.fields, schema)
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def _array(self, kinds: pa.Array, texts: pa.Array, kind: T.DataType, kept: pa.DataType, epoch_1904: bool) -> pa.Array:
        """A column of cells; what Arrow does not convert alike is converted value by distinct value."""
        if isinstance(kind, T.StringType) and pc.all(pc.equal(kinds, "t")).as_py() is not False:
            return texts.cast(kept)
        try:
            if isinstance(kind, T.DecimalType):
                return texts.cast(kept)
            if isinstance(kind, T.TimestampNTZType) and pc.all(pc.equal(kinds, "n")).as_py() is not False:
                return _moments(texts, epoch_1904).cast(kept)
        except pa.ArrowInvalid:
            pass  # more digits than the column has, or no number
        convert = converter(kind, epoch_1904)
        pairs = pc.binary_join_element_wise(kinds, texts, " ").dictionary_encode()
        values = [self._value(tuple(pair.split(" ", 1)), convert) for pair in pairs.dictionary.to_pylist()]
        return pa.array(values, kept).take(pairs.indices)

    def _value(self, cell: tuple[str, str] | None, convert: Callable[[str, str], object]):
        if cell is None:
            return None
        try:
            return convert(*cell)
        except (ValueError, KeyError, InvalidOperation, OverflowError):
            if self.mode == "FAILFAST":
                raise ValueError(f"value {cell[1]!r} does not fit its column") from None
            return None


# --- writing -------------------------------------------------------------------


def _safe(text: str) -> str:
    """XML text; characters that XML cannot hold, and what looks like their escape, are escaped."""
    if "_x" in text:
        text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    if not text.isprintable():
        text = re.sub(UNSAFE, lambda match: f"_x{ord(match[0]):04X}_", text)
    return escape(text)


def _letters(column: int) -> str:
    name = ""
    while column >= 0:
        name, column = chr(65 + column % 26) + name, column // 26 - 1
    return name


def _serials(column: pa.Array) -> pa.Array:
    """Serial days of dates and moments as text."""
    days = pa.types.is_date(column.type)
    steps, unit = (column.cast(pa.int32()), "D") if days else (column.cast(pa.timestamp("us")).cast(pa.int64()), "us")
    value = steps.fill_null(0).to_numpy().astype(np.int64)
    start, early, march = (
        np.datetime64(day, unit).astype(np.int64) for day in ("1899-12-30", "1899-12-31", "1900-03-01")
    )
    value -= np.where(value < march, early, start)
    serial = value if days else value / (DAY * 1000)
    return pa.array(serial, mask=column.is_null().to_numpy(zero_copy_only=False)).cast(pa.string())


def _cells(letters: str, numbers: pa.Array, column: pa.Array) -> pa.Array:
    """The cells of a column, empty text for null."""
    kind, opening, closing = column.type, '"><v>', "</v></c>"
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column.validate(full=True)  # as text, which is what XML holds
        texts = _listed(column.cast(pa.string()), pc.match_substring_regex(column, ALTERED).fill_null(False), _safe)
        opening, closing = '" t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
    elif pa.types.is_boolean(kind):
        texts, opening = pc.if_else(column, "1", "0"), '" t="b"><v>'
    elif pa.types.is_timestamp(kind):
        texts, opening = _serials(column), '" s="2"><v>'
    elif pa.types.is_date(kind):
        texts, opening = _serials(column), '" s="1"><v>'
    elif pa.types.is_floating(kind):
        texts = pa.array([None if value is None else repr(value) for value in column.to_pylist()], pa.string())
    else:
        texts = column.cast(pa.string())
    cells = pc.binary_join_element_wise(f'<c r="{letters}', numbers, opening, texts, closing, "")
    if pa.types.is_floating(kind):
        error = pc.binary_join_element_wise(f'<c r="{letters}', numbers, '" t="e"><v>#NUM!</v></c>', "")
        cells = pc.if_else(pc.is_finite(column), cells, error)
    return cells.fill_null("")


def _fixed_parts(sheet: str) -> dict[str, str]:
    """Everything but the worksheet: content types, relations, the list of sheets, date styles."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{SHEET_TYPE}.sheet.main+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{SHEET_TYPE}.styles+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{SHEET_TYPE}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" '
        f'Type="{RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATED}"><sheets>'
        f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
        f'<Relationship Id="rId1" Type="{RELATED}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="rId2" Type="{RELATED}/styles" Target="styles.xml"/></Relationships>',
        # Cell style 1 shows a date, style 2 a date and time.
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts>'
        '<fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/>'
        '<xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    return {name: head + text for name, text in parts.items()}


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: Mapping[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.sheet = options.get("sheet", "Sheet1")
        self.sheet_rows = int(options.get("sheetRows", SHEET_ROWS))
        if not 2 <= self.sheet_rows <= SHEET_ROWS:
            raise ValueError(f"sheetRows must lie between 2 and {SHEET_ROWS}")
        self.titles = [field.name for field in schema.fields]
        self.job = uuid.uuid4().hex
        for field in schema.fields:
            converter(field.dataType, False)

    def _attempts(self, root: str) -> str:
        return f"{root}/{ATTEMPTS}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(self._attempts(root), recursive=True)
        names, batches = [], (batch for batch in iterator if batch.num_rows)
        batch = next(batches, None)
        while batch is not None:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            with (
                system.open_output_stream(f"{self._attempts(root)}/{name}") as stream,
                zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive,
            ):
                for part, text in _fixed_parts(self.sheet).items():
                    archive.writestr(part, text)
                with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    batch = self._sheet(sheet, batch, batches)
            names.append(name)
        return WrittenFiles(names)

    def _sheet(self, sheet, batch: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        """Fill one worksheet; the first rows that found no room, or None."""
        letters = [_letters(column) for column in range(len(self.titles))]

        def write(first: int, columns: list[pa.Array], rows: int) -> None:
            numbers = pa.array(range(first, first + rows), pa.int64()).cast(pa.string())
            cells = [_cells(letter, numbers, column) for letter, column in zip(letters, columns)]
            lines = pc.binary_join_element_wise('<row r="', numbers, '">', *cells, "</row>\n", "")
            sheet.write(memoryview(lines.buffers()[2])[: pc.sum(pc.binary_length(lines)).as_py()])

        sheet.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        write(1, [pa.array([title]) for title in self.titles], 1)
        number = 2
        while batch is not None and number <= self.sheet_rows:
            some = batch.slice(0, self.sheet_rows + 1 - number)
            write(number, some.columns, some.num_rows)
            number += some.num_rows
            left = batch.slice(some.num_rows)
            batch = left if left.num_rows else next(batches, None)
        sheet.write(b"</sheetData></worksheet>")
        return batch

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        before = [
            entry.path
            for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True))
            if self.overwrite and entry.base_name.lower().endswith(SUFFIXES)
        ]
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{self._attempts(root)}/{name}", f"{root}/{name}")
        for path in before:
            system.delete_file(path)
        self._forget(system, root)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        self._forget(*fs.FileSystem.from_uri(self.path))

    def _forget(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._attempts(root)).type == fs.FileType.Directory:
            system.delete_dir(self._attempts(root))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        raise ValueError("state the schema of a workbook; types are not inferred")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


def read_workbooks(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """A workbook, or all workbooks of a folder, on any store that pyarrow opens."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format(FORMAT).schema(schema).options(**options).load(path)


def write_workbooks(frame: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write a folder of workbooks; ``sheet`` names their worksheet, ``sheetRows`` lowers its size."""
    frame.sparkSession.dataSource.register(WorkbookSource)
    frame.write.format(FORMAT).mode(mode).options(**options).save(path)
