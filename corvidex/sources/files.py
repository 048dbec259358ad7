"""Files as documents: a distributed scan, ignore and size rules, text extraction by format.

Extraction follows the formats' own specifications. Packaged formats (ZIP with
XML inside) share one walker that is told, per format, which members to read in
which order, which elements make a line, a cell and a break, and how lines join.
"""

from __future__ import annotations

import codecs
import importlib.util
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email import message_from_bytes, policy
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex, strip

# fixed values: suffixes and the document type they stand for
TYPES = {
    ".md": "markdown", ".markdown": "markdown",
    ".txt": "text", ".text": "text", ".rst": "text", ".org": "text", ".log": "text", ".csv": "text", ".tsv": "text", ".json": "text", ".yaml": "text", ".yml": "text", ".toml": "text", ".xml": "text",
    ".ini": "text", ".cfg": "text", ".tex": "text", ".latex": "text", ".bib": "text", ".nfo": "text", ".adoc": "text", ".asciidoc": "text", ".properties": "text",
    ".html": "html", ".htm": "html", ".xhtml": "html", ".srt": "text", ".vtt": "text", ".eml": "email", ".odt": "odt", ".ods": "ods", ".odp": "odp", ".epub": "epub",
    ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".rtf": "rtf",
}
# fixed values: suffixes of program text, read only if asked for
CODE = tuple(
    """.py .pyi .pyw .js .jsx .ts .tsx .mjs .cjs .css .scss .sass .less .vue .svelte .c .h .cpp .cxx .cc .hpp .hxx .java .kt .kts .scala .groovy .gradle .cs .fs .vb .go .rs .zig .rb .php .pl .pm
    .sh .bash .zsh .fish .ps1 .bat .cmd .hs .lhs .ml .mli .ex .exs .erl .clj .cljs .el .lisp .cl .scm .rkt .sql .graphql .gql .proto .r .jl .lua .nim .dart .swift .m .mm .v .sv .vhd .vhdl .tf .hcl
    .cmake .mk .asm .s .ipynb""".split()
)
# fixed values: formats that need a package, and its name for installing
NEEDS = {".pdf": ("pymupdf", "pymupdf")}
# fixed values: the elements at whose end a line ends, those whose content is not text, the mail headers shown, the ignore file and the index's own folder
BLOCKS = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"))
UNSEEN = frozenset(("script", "style"))
HEADERS = ("Subject", "From", "Date")
IGNORE_FILE, OWN_FOLDER = ".corvidexignore", ".corvidex"


def supported(code: bool = False) -> dict[str, str]:
    """Suffix to type of what can be extracted here; program text on request."""
    ready = {s: t for s, t in TYPES.items() if s not in NEEDS or importlib.util.find_spec(NEEDS[s][0])}
    return ready | (dict.fromkeys(CODE, "code") if code else {})


def unavailable() -> dict[str, str]:
    """Suffixes that lack a package, with the package to install."""
    return {s: hint for s, (module, hint) in NEEDS.items() if not importlib.util.find_spec(module)}


def plain_text(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


class _Events(HTMLParser):
    """The document as (event, value) in order of appearance."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag))

    def handle_startendtag(self, tag, attrs):
        self.seen += [("open", tag), ("close", tag)]

    def handle_endtag(self, tag):
        self.seen.append(("close", tag))

    def handle_data(self, data):
        self.seen.append(("text", data))


def html_text(html: str) -> str:
    """Visible text: scripts, styles and comments left out, a line break where a block element ends, at most one blank line.

    Data is unseen from the start of a script or style to the next end of either; entities are decoded, titles stay.
    """
    events = _Events(html).seen
    pieces, stack = [], []  # the stack holds unseen elements; any one's end empties it, as they do not nest
    for kind, value in events:
        if value in UNSEEN and kind != "text":
            stack = [value] if kind == "open" else []
        elif kind == "text" and not stack:
            pieces.append(value)
        elif kind == "close" and value in BLOCKS:
            pieces.append("\n")
    out, breaks = [], 0
    for line in "".join(pieces).split("\n"):
        breaks = breaks + 1 if line == "" else 0
        if breaks < 2:
            out.append(line)
    return "\n".join(out).strip()


# fixed values: lines of a subtitle file that are not spoken: numbers, times, its header, notes
CUES = r"^(\d+|[\d:.,\->]+\s*-->.*|WEBVTT.*|NOTE(\W.*)?)$"


def subtitle_lines(text: Column) -> Column:
    """Subtitles without what is not spoken, as a Column."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(CUES)), "\n")


def mail_text(data: bytes) -> str:
    """The headers, a blank line, the plain body, else the visible text of the HTML one."""
    mail = message_from_bytes(data, policy=policy.default)
    part = mail.get_body(preferencelist=("plain", "html"))
    body = "" if part is None else part.get_content()
    if part is not None and part.get_content_subtype() == "html":
        body = html_text(body)
    head = "".join(f"{name}: {mail[name]}\n" for name in HEADERS if mail[name])
    return f"{head}\n{body}".strip()


@dataclass(frozen=True)
class Package:
    """How the text of a packaged XML format is laid out; names are local, namespaces aside."""

    members: str  # pattern of the members to read, in order of the numbers in their names
    line: str  # the element that makes a line
    cell: str = ""  # the element that makes a cell of it, else the line's own text counts
    between: str = "\n\n"
    text: str = ""  # only text in this element counts
    group: str = ""  # lines of one such element are one block, joined by line breaks


PACKAGES = {
    ".odt": Package(r"content\.xml", "p"),
    ".odp": Package(r"content\.xml", "p"),
    ".ods": Package(r"content\.xml", "table-row", cell="table-cell", between="\n"),
    ".docx": Package(r"word/document\.xml", "p", text="t"),
    ".pptx": Package(r"ppt/slides/slide\d+\.xml", "p", text="t", group="txBody"),
}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _within(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _text(e: ElementTree.Element, only: str) -> str:
    return "".join(e.itertext()) if not only else "".join(x.text or "" if _local(x) == only else "\n" if _local(x) == "br" else "\t" if _local(x) == "tab" else "" for x in e.iter())


def _numbered(names: list[str], pattern: str) -> list[str]:
    chosen = [n for n in names if re.fullmatch(pattern, n)]
    return sorted(chosen, key=lambda n: [int(x) for x in re.findall(r"\d+", n)])


def package_text(data: bytes, how: Package) -> str:
    lines = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in _numbered(z.namelist(), how.members):
            root = ElementTree.fromstring(z.read(name))
            for block in _within(root, how.group) if how.group else [root]:
                own = ["\t".join(_text(c, how.text) for c in _within(x, how.cell)) if how.cell else _text(x, how.text) for x in _within(block, how.line)]
                lines += ["\n".join(own).strip()] if how.group else own
    return how.between.join(x for x in lines if x.strip())


def book_text(data: bytes) -> str:
    """Every page of an EPUB, in the order of the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [html_text(plain_text(z.read(n))) for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(filter(None, pages))


def workbook_text(data: bytes) -> str:
    """All sheets of a workbook in its order, a line per row, cells at their columns; formulas count by their stored value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_text(x, "t") for x in _within(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        lines = []
        for name in _sheets(z):
            for row in _within(ElementTree.fromstring(z.read(name)), "row"):
                cells: dict[int, str] = {}
                for c in _within(row, "c"):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) or len(cells) + 1
                    value = next((x.text or "" for x in _within(c, "v")), "")
                    kind = c.get("t")
                    cells[at] = shared[int(value)] if kind == "s" and value else _text(c, "t") if kind == "inlineStr" else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
                lines.append("\t".join(cells.get(i, "") for i in range(1, max(cells, default=0) + 1)).strip())
    return "\n".join(filter(None, lines))


def _sheets(z: zipfile.ZipFile) -> list[str]:
    """The sheets in the workbook's own order, by its relations; without those, by number."""
    try:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        order = [target[v] for s in _within(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet") for k, v in s.attrib.items() if k.endswith("}id")]
        return [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in order]
    except KeyError:
        return _numbered(z.namelist(), r"xl/worksheets/sheet\d+\.xml")


# groups of an RTF file that hold no text of the document (of the specification's destinations)
_RTF_APART = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf footnote listtable listoverridetable rsidtbl generator themedata datastore latentstyles xmlnstbl filetbl revtbl fldinst".split())
_RTF_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "cell": "|", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def rich_text(data: bytes) -> str:
    """The text of an RTF file: control words resolved, groups that hold none of the document's text left out."""
    page = "cp1252"
    stack: list[tuple[bool, int]] = []
    hidden, skip, owed = False, 1, 0  # skip: characters that stand in for a Unicode one; owed: how many of them are still to come
    out: list[str] = []
    for word, number, byte, sign, brace, text in _RTF.findall(data.decode("latin-1")):
        shown = ""
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            hidden, skip = stack.pop() if stack else (False, 1)
        elif word == "ansicpg" and number:
            try:
                page = codecs.lookup(f"cp{number}").name
            except LookupError:
                pass
        elif word == "uc":
            skip = int(number or 1)
        elif word == "u" and number:
            shown, owed = chr(int(number) % 0x10000), skip
            out.append("" if hidden else shown)
            continue
        elif word in _RTF_APART:
            hidden = True
        elif word in _RTF_SIGNS:
            shown = _RTF_SIGNS[word]
        elif sign == "*":
            hidden = True
        elif sign in ("{", "}", "\\"):
            shown = sign
        elif sign == "~":
            shown = "\xa0"
        elif byte:
            shown = bytes([int(byte, 16)]).decode(page, "replace")
        elif text:
            shown = text
        if owed and shown:
            shown, owed = shown[owed:], max(0, owed - len(shown))
        if not hidden:
            out.append(shown)
    joined = "".join(out)
    return joined.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def pdf_text(data: bytes) -> str:
    import pymupdf

    with pymupdf.open(stream=data, filetype="pdf") as doc:
        return "\n\n".join(t for t in (page.get_text() for page in doc) if t.strip())


READERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys((".html", ".htm", ".xhtml"), lambda data: html_text(plain_text(data))), ".eml": mail_text, ".epub": book_text, ".xlsx": workbook_text, ".rtf": rich_text, ".pdf": pdf_text,
    **{s: (lambda data, how=how: package_text(data, how)) for s, how in PACKAGES.items()},
}


def extract(suffix: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file's bytes by its lower-cased suffix."""
    try:
        return READERS.get(suffix, plain_text)(data), None
    except Exception as e:  # a broken file is reported with its row, it does not end the job
        return None, f"{type(e).__name__}: {e}"[:300]


def ignored(path: Column, name: Column, patterns: list[str]) -> Column:
    """Whether a relative path matches an ignore pattern: a glob on path or file name; a pattern ending in ``/`` is a prefix."""
    out = F.lit(False)
    for p in patterns:
        out |= path.startswith(p) if p.endswith("/") else path.rlike(glob_to_regex(p)) | name.rlike(glob_to_regex(p))
    return out


def read_ignore_file(text: str) -> list[str]:
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def ignore_patterns(folder: str) -> list[str]:
    """The patterns of the folder's ignore file, else of its parent's."""
    at = Path(folder.removeprefix("file:"))
    return next((read_ignore_file(f.read_text(errors="replace")) for f in (at / IGNORE_FILE, at.parent / IGNORE_FILE) if f.is_file()), [])


def size_ok(size: Column, path: Column, max_mb: float, allow: list[str] = ()) -> Column:
    """Whether a file may be read: at most ``max_mb`` mebibytes, of any size where that is not positive or the path is allowed."""
    return (size <= int(max_mb * 1024 * 1024)) | path.isin(list(allow)) if max_mb > 0 else F.lit(True)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_mb: float = 10, allow: list[str] = (), code: bool = False) -> DataFrame:
    """(path, size_bytes, type, text, error, content_hash) of the supported files below ``root``; rules apply before bytes are read.

    ``path`` is relative to ``root``. Without ``ignore`` the ignore file's
    patterns hold; the index's own folder is always left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = "/" + root.removeprefix("file:").strip("/") + "/"
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.when(plain.startswith(top), plain.substr(F.lit(len(top) + 1), F.length(plain))).otherwise(plain)
    files = files.withColumn("rel", rel).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    types = supported(code)
    patterns = list(ignore) if ignore is not None else ignore_patterns(root)
    keep = F.col("suffix").isin(list(types)) & ~ignored(F.col("rel"), F.element_at(F.split("rel", "/"), -1), patterns) & ~F.col("rel").startswith(OWN_FOLDER + "/")
    keep &= size_ok(F.col("length"), F.col("rel"), max_mb, [*allow, *(a.removeprefix(top) for a in allow)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [extract(s, bytes(c)) for s, c in zip(b["suffix"], b["content"])]
            yield pd.DataFrame({"path": b["rel"], "size_bytes": b["length"], "suffix": b["suffix"], "type": b["suffix"].map(types), "text": [g[0] for g in got], "error": [g[1] for g in got]})

    out = files.where(keep).select("rel", "length", "suffix", "content").mapInPandas(read, "path string, size_bytes long, suffix string, type string, text string, error string")
    text = F.when(F.col("suffix").isin(".srt", ".vtt"), subtitle_lines(F.col("text"))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("content_hash", F.md5("text")).drop("suffix")


def counts_by_suffix(spark: SparkSession, root: str) -> DataFrame:
    """(ext, n) of all files below ``root``, supported or not; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
