"""Text of files by format, with the standard library; unknown extensions give an empty text."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions whose files are text as they are.
PLAIN = frozenset("txt log".split())
SOURCE = frozenset("py js ts jsx tsx java c h cpp hpp cs go rs rb php swift kt scala sh bat ps1 sql json xml yaml yml toml ini cfg conf properties env md rst html htm css scss less csv tsv vue lua pl r".split())
MOST_ROWS, MOST_COLS = 10_000, 256


def decode(raw: bytes) -> str:
    """By byte order mark, else UTF-8, else GBK, else Latin-1; line ends become \\n."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return _lines(raw.decode(name, "replace"))
    for name in ("utf-8", "gbk"):
        try:
            return _lines(raw.decode(name))
        except UnicodeDecodeError:
            continue
    return _lines(raw.decode("latin-1"))


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _docx(raw: bytes) -> str:
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"word/[^/]+\.xml", n))
        for name in sorted(names, key=lambda n: n != "word/document.xml"):
            for p in ElementTree.fromstring(z.read(name)).iter():
                if _local(p.tag) == "p":
                    text = "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(x.tag), "") for x in p.iter()).strip()
                    out += [text] if text else []
    return "\n".join(out)


def _pptx(raw: bytes) -> str:
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        texts = lambda name: [x.text for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "t" and (x.text or "").strip()]
        found = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in found:
            out += [f"--- 幻灯片 {number} ---", *texts(name)]
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            out += [f"[备注] {t}" for t in texts(notes)] if notes in z.namelist() else []
    return "\n".join(out)


def _xlsx(raw: bytes) -> str:
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        files = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for title, (_, name) in zip(names, files, strict=False):
            out.append(f"--- 工作表: {title} ---")
            rows = [r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"]
            for row in rows[:MOST_ROWS]:
                cells = []
                for c in list(row)[:MOST_COLS]:
                    value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() else value)
                line = "\t".join(x for x in cells if x)
                out += [line] if line else []
    return "\n".join(out)


def _odf(raw: bytes, sheet: bool) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    if sheet:
        rows = ("\t".join("".join(c.itertext()) for c in r if _local(c.tag) == "table-cell") for r in root.iter() if _local(r.tag) == "table-row")
        return "\n".join(x for x in rows if x.strip())
    return "\n".join("".join(p.itertext()) for p in root.iter() if _local(p.tag) in ("p", "h"))


def _eml(raw: bytes) -> str:
    mail = BytesParser(policy=policy.default).parsebytes(raw)
    body = mail.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()
    return "\n".join([f"主题: {mail['subject'] or ''}", f"发件人: {mail['from'] or ''}", text])


def _ole(raw: bytes) -> str:
    """Runs of printable UTF-16 in an OLE file's streams."""
    runs = re.findall(rb"(?:[\x20-\x7e\t]\x00|[\x00-\xff][\x4e-\x9f]){2,}", raw)
    return "\n".join(r.decode("utf-16-le", "ignore") for r in runs)


def _office(raw: bytes) -> str:
    if not raw.startswith(b"PK"):
        return ""
    names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
    kind = next((f for start, f in (("word/", _docx), ("ppt/", _pptx), ("xl/", _xlsx)) if any(n.startswith(start) for n in names)), None)
    return kind(raw) if kind else ""


FORMATS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "xlsm": _xlsx, "odt": lambda r: _odf(r, False), "ods": lambda r: _odf(r, True), "eml": _eml, "doc": _ole, "ppt": _ole, "wps": _office, "et": _office, "dps": _office}


def _pdf(raw: bytes) -> str:
    try:
        import pypdf
    except ImportError:
        return ""
    return "\n".join(p.extract_text() for p in pypdf.PdfReader(io.BytesIO(raw)).pages)


def extract(extension: str, raw: bytes, in_archive: bool = False) -> str:
    """An extractor's failure falls back to the bytes as text; unknown extensions are text only within archives."""
    extension = extension.lower().lstrip(".")
    try:
        if extension == "pdf":
            return _pdf(raw)
        if extension in FORMATS:
            return FORMATS[extension](raw)
    except Exception:  # noqa: BLE001  any broken file
        return raw.decode("utf-8", "ignore")
    return decode(raw) if in_archive or extension in PLAIN or extension in SOURCE else ""


def extract_text(extension: Column, raw: Column, extra: dict[str, Callable[[bytes], str]] | None = None) -> Column:
    """The text of files; ``extra``: further extractors by extension, before the known ones."""
    own = {k.lower().lstrip("."): f for k, f in (extra or {}).items()}

    def one(extension: str, raw: bytes) -> str:
        try:
            return own[extension.lower()](raw) if extension.lower() in own else extract(extension, raw)
        except Exception:  # noqa: BLE001  any broken file
            return raw.decode("utf-8", "ignore")

    def run(extension: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([one(e or "", bytes(r)) if r is not None else "" for e, r in zip(extension, raw, strict=True)])

    return F.pandas_udf(run, T.StringType())(extension, raw)


class Entry(NamedTuple):
    """A file in an archive: its name there, size, time, and how to read it."""

    name: str
    size: int
    mtime: float
    read: Callable[[], bytes]


def _zip(raw: bytes, password: str | None) -> Iterator[Entry]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    for e in z.infolist():
        if not e.is_dir():
            yield Entry(e.filename, e.file_size, dt.datetime(*e.date_time).timestamp(), lambda e=e: z.read(e, password.encode() if password else None))


def _rar(raw: bytes, password: str | None) -> Iterator[Entry]:
    import rarfile

    r = rarfile.RarFile(io.BytesIO(raw))
    for e in r.infolist():
        if not e.is_dir():
            yield Entry(e.filename, e.file_size, e.mtime.timestamp() if e.mtime else 0.0, lambda e=e: r.read(e, password))


def _seven(raw: bytes, password: str | None) -> Iterator[Entry]:
    import py7zr

    with py7zr.SevenZipFile(io.BytesIO(raw), password=password) as z:
        held = {e.filename: e for e in z.list() if not e.is_directory}
        data = z.read(list(held))
    for name, e in held.items():
        yield Entry(name, e.uncompressed, e.creationtime.timestamp() if e.creationtime else 0.0, lambda name=name: data[name].read())


#: Readers of archives by extension: (bytes, password) to entries. rar and 7z need rarfile and py7zr; without them such archives give an error row.
READERS: dict[str, Callable[[bytes, str | None], Iterator[Entry]]] = {"zip": _zip, "rar": _rar, "7z": _seven}


def is_archive(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(sorted(READERS))


def archive_entries(archives: DataFrame, extensions: tuple[str, ...] | None = None, most: int = 5000, most_bytes: int = 50 << 20, password: str | None = None, readers: dict[str, Callable] | None = None) -> DataFrame:
    """A row per entry of archives (path, raw): path 'archive!inner', name, extension, size, archive_path, content, errors, inner_path, mtime.

    The reader goes by the path's extension, zip where it has none; ``readers`` adds to READERS or replaces them. An archive
    that can't be opened, or has more entries than ``most``, gives a row with errors 1. Nested archives aren't opened.
    """
    known = READERS | (readers or {})
    names = ["path", "name", "extension", "size", "archive_path", "content", "errors", "inner_path", "mtime"]

    def failed(path: str) -> tuple:
        return path, path.rpartition("/")[2], "", 0, path, "", 1, None, None

    def rows(path: str, raw: bytes):
        reader, made = known.get(path.rpartition(".")[2].lower(), known["zip"]), 0
        try:
            for e in reader(raw, password):
                if made >= most:
                    yield failed(path)
                    return
                made += 1
                name = e.name.replace("\\", "/").rpartition("/")[2]
                own = name.rpartition(".")[2].lower() if "." in name else ""
                if extensions is not None and own not in extensions:
                    continue
                try:
                    data = e.read() if e.size <= most_bytes else b""
                except Exception:  # noqa: BLE001  a broken or locked entry: the libraries' errors have no common class
                    data = b""
                yield f"{path}!{e.name}", name, own, e.size, path, extract(own, data, True), 0, e.name, e.mtime
        except Exception:  # noqa: BLE001  as above, of the archive itself, or no library for it
            yield failed(path)

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch["path"], batch["raw"], strict=True):
                yield pd.DataFrame(list(rows(path, bytes(raw or b""))), columns=names)

    schema = "path string, name string, extension string, size long, archive_path string, content string, errors int, inner_path string, mtime double"
    return archives.select("path", "raw").mapInPandas(run, schema)
