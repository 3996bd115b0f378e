"""Office packages: documents, sheets and slides, with limits against hostile archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import XMLPullParser

from .plain import Sink

ON_DISK = INFLATED = 64 << 20
ENTRIES, DEPTH, STEP = 8192, 4096, 1 << 16


class Package:
    def __init__(self, raw: bytes):
        if len(raw) > ON_DISK:
            raise ValueError("too large a file")
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        if len(self.zip.namelist()) > ENTRIES:
            raise ValueError("too many parts")
        self.left = INFLATED

    def parts(self, folder: str, stem: str) -> list[str]:
        """Parts such as slide1.xml, by number."""
        found = [(int(m[1]), n) for n in self.zip.namelist() if (m := re.fullmatch(rf"{re.escape(folder)}/{stem}(\d+)\.xml", n))]
        return [n for _, n in sorted(found)]

    def events(self, name: str) -> Iterator[tuple[str, str, object]]:
        """(start or end, local name, element) of a part; nothing is kept after its end."""
        parser, depth = XMLPullParser(("start", "end")), 0
        with self.zip.open(name) as f:
            while chunk := f.read(STEP):
                self.left -= len(chunk)
                if self.left < 0:
                    raise ValueError("too much content")
                parser.feed(chunk)
                for kind, e in parser.read_events():
                    depth += 1 if kind == "start" else -1
                    if depth > DEPTH:
                        raise ValueError("nested too deep")
                    yield kind, e.tag.rsplit("}", 1)[-1], e
                    if kind == "end" and e.tag.rsplit("}", 1)[-1] in ("p", "c", "si", "row", "sp"):
                        e.clear()


def paragraphs(package: Package, name: str, sink: Sink) -> None:
    """One line a paragraph: runs of text, tabs and breaks."""
    line: list[str] = []
    for kind, tag, e in package.events(name):
        if kind == "end" and tag == "t":
            line.append(e.text or "")
        elif kind == "end" and tag == "tab":
            line.append("\t")
        elif kind == "end" and tag in ("br", "cr"):
            line.append("\n")
        elif kind == "end" and tag == "p":
            sink.line("".join(line))
            line = []
            if sink.full:
                return


def docx(raw: bytes) -> str:
    package, sink = Package(raw), Sink()
    paragraphs(package, "word/document.xml", sink)
    return sink.text()


def pptx(raw: bytes) -> str:
    package, sink = Package(raw), Sink()
    for name in package.parts("ppt/slides", "slide"):
        paragraphs(package, name, sink)
        if sink.full:
            break
    return sink.text()


def shared_strings(package: Package) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in package.zip.namelist():
        own: list[str] = []
        phonetic = 0
        for kind, tag, e in package.events("xl/sharedStrings.xml"):
            if tag == "rPh":
                phonetic += 1 if kind == "start" else -1
            elif kind == "end" and tag == "t" and not phonetic:
                own.append(e.text or "")
            elif kind == "end" and tag == "si":
                out.append("".join(own))
                own = []
    return out


def xlsx(raw: bytes) -> str:
    """Sheets by number; a row a line, its filled cells between tabs."""
    package, sink = Package(raw), Sink()
    strings = shared_strings(package)
    for name in package.parts("xl/worksheets", "sheet"):
        row: list[str] = []
        value, inline = "", []
        for kind, tag, e in package.events(name):
            if kind != "end":
                continue
            if tag == "v":
                value = e.text or ""
            elif tag == "t":
                inline.append(e.text or "")
            elif tag == "c":
                cell = "".join(inline) or value
                if e.get("t") == "s":
                    cell = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
                if cell.strip():
                    row.append(cell)
                value, inline = "", []
            elif tag == "row":
                if row:
                    sink.line("\t".join(row))
                row = []
                if sink.full:
                    return sink.text()
    return sink.text()
