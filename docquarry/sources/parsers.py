"""Files to text: one parser per family, chosen by the suffix; read in bulk with the binaryFile source."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import ConfigurationError, FileHandlingError, ParsingError

TEXT_SUFFIXES = frozenset(
    ".txt .md .markdown .rst .tex .log .tsv .rtf .xml .yaml .yml .toml .ini .cfg .conf .properties .env .py .pyw .ipynb .js .jsx .ts .tsx .mjs .c .h .cpp .hpp .cc .cxx .hh .cs .java .kt .kts .scala .go .rs .rb .php .pl .pm .r .jl .lua .swift "
    ".m .mm .sh .bash .zsh .fish .ps1 .bat .cmd .sql .css .scss .sass .less .vue .svelte .astro .dart .ex .exs .erl .hrl .hs .ml .mli .fs .fsx .clj .cljs .lisp .el .scm .vb .vbs .asm .s .f .f90 .pas .d .nim .zig .v .sv .vhd .vhdl .proto .graphql "
    ".gradle .cmake .make .mk .dockerfile .gitignore .gitattributes .editorconfig .diff .patch .srt .vtt .bib .org .adoc .textile .po .pot .tf .hcl .nix .sol .cu .cl .glsl".split()
)
STRUCTURED_SUFFIXES = frozenset((".pdf", ".docx", ".html", ".htm", ".pptx", ".msg", ".csv", ".json", ".xlsx", ".xls"))
SUPPORTED_SUFFIXES = TEXT_SUFFIXES | STRUCTURED_SUFFIXES


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as e:
        raise ParsingError(f"not UTF-8: {e}") from e


def parse_json(data: bytes) -> str:
    try:
        return json.dumps(json.loads(_utf8(data)), indent=2, ensure_ascii=False)
    except ValueError as e:
        raise ParsingError(f"not JSON: {e}") from e


def _row(number: int, header: list[str] | None, cells: list) -> str | None:
    named = []
    for k, cell in enumerate(cells):
        value = "" if cell is None else str(cell).strip()
        if value:
            named.append(f"{header[k] if header and k < len(header) else f'Col_{k}'}={value}")
    return f"Row {number}: " + " | ".join(named) if named else None


def parse_csv(data: bytes) -> str:
    text = _utf8(data)
    try:
        dialect: type[csv.Dialect] | str = csv.Sniffer().sniff(text[:1024])
        has_header = csv.Sniffer().has_header(text[:1024])
    except csv.Error:
        dialect, has_header = "excel", True
    rows = list(csv.reader(io.StringIO(text), dialect))
    header = [h.strip() for h in rows.pop(0)] if has_header and rows else None
    return "\n".join(r for k, cells in enumerate(rows, 1) if (r := _row(k, header, cells)))


class _Text(HTMLParser):
    SKIP = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self._open = 0

    def handle_starttag(self, tag, attrs):
        self._open += tag in self.SKIP

    def handle_endtag(self, tag):
        if tag in self.SKIP and self._open:
            self._open -= 1

    def handle_data(self, data):
        if not self._open and (s := data.strip()):
            self.found.append(s)


def html_text(html: str | None) -> str:
    """Text nodes, stripped, one a line; none from scripts, styles and comments."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.found)


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParsingError(f"not an Office file: {e}") from e


def parse_docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with _zip(data) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in (body.findall(f"{w}p") if body is not None else [])).strip()


def parse_pptx(data: bytes) -> str:
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    out = []
    with _zip(data) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))
        for name in slides:
            for shape in ElementTree.fromstring(z.read(name)).iter(f"{p}sp"):
                out.append("\n".join("".join(t.text or "" for t in q.iter(f"{a}t")) for q in shape.iter(f"{a}p")))
    return "\n".join(out).strip()


def parse_xlsx(data: bytes) -> str:
    """Every sheet: its name, then its rows by the first row's headers; the first data row is 2."""
    m, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with _zip(data) as z:
        strings = ["".join(t.text or "" for t in x.iter(f"{m}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        places = {x.get("Id"): x.get("Target", "").lstrip("/").removeprefix("xl/") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + places[sheet.get(f"{r}id")])).iter(f"{m}row"):
                cells: list = []
                for c in row.findall(f"{m}c"):
                    column = 0
                    for letter in filter(str.isalpha, c.get("r", "")):
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (max(column, len(cells) + 1) - len(cells))
                    v = c.find(f"{m}v")
                    cells[column - 1 if column else -1] = strings[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{m}t")) or None
                rows.append(cells)
            header = [str(h or "").strip() or f"Col_{k}" for k, h in enumerate(rows[0])] if rows else []
            sheets.append("\n".join([f"--- Sheet: {sheet.get('name')} ---", *(x for k, cells in enumerate(rows[1:], 2) if (x := _row(k, header, cells)))]))
    return "\n\n".join(sheets)


def parse_pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ConfigurationError("PDF files need pypdf") from e
    out = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  one broken page doesn't cost the others
            continue
    return "\n".join(out).strip()


def parse_msg(data: bytes) -> str:
    try:
        import extract_msg
    except ImportError as e:
        raise ConfigurationError("MSG files need extract_msg") from e
    try:
        m = extract_msg.Message(io.BytesIO(data))
    except Exception as e:
        raise ParsingError("the content is encrypted" if "encrypted" in str(e).lower() else f"not a message: {e}") from e
    body = m.body or html_text((m.htmlBody or b"").decode("utf-8", "replace"))
    parts = [f"# {m.subject}", f"From: {m.sender}", f"To: {m.to}", f"Date: {m.date}", "", body]
    return "\n".join([*parts, *(attachment_text(x.longFilename or x.shortFilename or "", x.data) for x in m.attachments)])


def attachment_text(name: str, data: bytes) -> str:
    """The first 300 characters of a text attachment, or a line about another one."""
    if os.path.splitext(name)[1].lower() not in TEXT_SUFFIXES | {".csv", ".json", ".html", ".htm"}:
        return f"[Attachment {name}: {len(data)} bytes]"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return f"[Attachment {name}]\n{text[:300]}{'...' if len(text) > 300 else ''}"


_PARSERS = {".pdf": parse_pdf, ".docx": parse_docx, ".pptx": parse_pptx, ".msg": parse_msg, ".csv": parse_csv, ".json": parse_json, ".xlsx": parse_xlsx, ".xls": parse_xlsx, ".html": lambda b: html_text(_utf8(b)), ".htm": lambda b: html_text(_utf8(b))}


def parse_bytes(path: str, data: bytes) -> str:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SUPPORTED_SUFFIXES:
        raise ConfigurationError(f"Unsupported file type extension: '{suffix}' for file: {path}")
    try:
        return _PARSERS.get(suffix, _utf8)(data)
    except (ConfigurationError, ParsingError):
        raise
    except Exception as e:
        raise ParsingError(f"{path}: {e}") from e


def parse_document(path: str) -> str:
    if not os.path.isfile(path):
        raise FileHandlingError(f"not a file: {path}")
    with open(path, "rb") as f:
        return parse_bytes(path, f.read())


def _parsed(batches):
    for batch in batches:
        texts, errors = [], []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                texts.append(parse_bytes(path, data or b""))
                errors.append(None)
            except (ConfigurationError, FileHandlingError) as e:
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("file_hash"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file_path", "file_hash", "text", "error"])


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(file_path, file_hash, text, error) of all files below path; what can't be parsed has an error and no text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "content").mapInArrow(_parsed, "file_path string, file_hash string, text string, error string")


def html_column(df: DataFrame, html: str, into: str = "text") -> DataFrame:
    """df with the text of a column of HTML instead of it."""
    rest = [c for c in df.columns if c != html]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array([html_text(x) for x in batch.column(html).to_pylist()], pa.string())], names=[*rest, into])

    return df.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", `{into}` string")


def csv_rows(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(order, line): a table's rows as 'Row i: H=V | ...', i by the order; blank cells are left out."""
    from pyspark.sql.window import Window

    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string")))) for c in columns]
    i = F.row_number().over(Window.orderBy(order))
    return df.select(order, F.concat(F.lit("Row "), i, F.lit(": "), F.concat_ws(" | ", *cells)).alias("line"))
