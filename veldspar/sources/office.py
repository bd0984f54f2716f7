"""Office files as blocks, read from the XML parts of their archives; no library is needed.

A block is (page, label, kind, text): kind is text, table, notes or image, and an image's text is the path of its part.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows and columns of a sheet that are read, unless more is asked for; what is beyond is reported.
MOST_ROWS, MOST_COLUMNS = 5000, 200

# Beginnings of paragraph styles, in lower case, and the marks they get.
STYLE_MARKS = {
    "heading 1": "# ",
    "title": "# ",
    "heading 2": "## ",
    "heading 3": "### ",
    "heading 4": "#### ",
    "list": "- ",
    "bullet": "- ",
}


@dataclass(frozen=True)
class Block:
    page: int
    label: str
    kind: str
    text: str


class Package:
    """Parts of an archive and how they refer to each other."""

    def __init__(self, data: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.archive.namelist())

    def part(self, name: str) -> ElementTree.Element:
        raw = self.archive.read(name)
        if b"<!ENTITY" in raw:
            raise ValueError("entities are not expanded")
        return ElementTree.fromstring(raw)

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Of a part's relations: id to type and target part."""
        folder, _, file = name.rpartition("/")
        path = f"{folder}/_rels/{file}.rels"
        if path not in self.names:
            return {}
        return {x.get("Id", ""): (x.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, x.get("Target", ""))).lstrip("/")) for x in self.part(path)}


def table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table under the first of them."""
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def docx(data: bytes) -> Iterator[Block]:
    """Paragraphs by their styles, tables, and images in the order of the body; images of no paragraph come last."""
    package = Package(data)
    main = "word/document.xml"
    styles = {}
    if "word/styles.xml" in package.names:
        for style in package.part("word/styles.xml").iter(f"{W}style"):
            name = style.find(f"{W}name")
            styles[style.get(f"{W}styleId")] = (name.get(f"{W}val") if name is not None else "") or ""
    links = package.links(main)
    seen: set[str] = set()
    body = package.part(main).find(f"{W}body")

    def said(paragraph: ElementTree.Element) -> str:
        return "".join(_run_text(run) for run in paragraph.iter(f"{W}r"))

    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            style = child.find(f"{W}pPr/{W}pStyle")
            ident = style.get(f"{W}val", "") if style is not None else ""
            name = styles.get(ident, ident).lower()
            text = said(child)
            mark = next((m for begin, m in STYLE_MARKS.items() if (name == begin if begin == "title" else name.startswith(begin))), "")
            if text.strip():
                yield Block(0, "", "text", mark + text)
            for blip in child.iter(f"{A}blip"):
                target = links.get(blip.get(f"{R}embed", ""), ("", ""))[1]
                if target:
                    seen.add(target)
                    yield Block(0, "", "image", target)
        elif child.tag == f"{W}tbl":
            rows = [["\n".join(said(p) for p in cell.iter(f"{W}p")).strip().replace("\n", " ") for cell in row.findall(f"{W}tc")] for row in child.findall(f"{W}tr")]
            if rows:
                yield Block(0, "", "table", table(rows))
    for kind, target in links.values():
        if kind == "image" and target not in seen:
            yield Block(0, "", "image", target)


def _run_text(run: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in run)


def pptx(data: bytes) -> Iterator[Block]:
    """Slides in their order: shapes, those in groups too, tables, pictures, and the speaker's notes."""
    package = Package(data)
    main = "ppt/presentation.xml"
    links = package.links(main)
    order = [links[x.get(f"{R}id", "")][1] for x in package.part(main).iter(f"{P}sldId") if x.get(f"{R}id", "") in links]
    for i, name in enumerate(order):
        label, own = f"Slide {i + 1}", package.links(name)
        tree = package.part(name).find(f"{P}cSld/{P}spTree")
        for shape in _shapes(tree if tree is not None else ElementTree.Element("none")):
            if shape.tag == f"{P}pic":
                blip = next(shape.iter(f"{A}blip"), None)
                target = own.get(blip.get(f"{R}embed", ""), ("", ""))[1] if blip is not None else ""
                if target:
                    yield Block(i, label, "image", target)
            elif (grid := next(shape.iter(f"{A}tbl"), None)) is not None:
                yield Block(i, label, "table", table([[" ".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in cell.iter(f"{A}p")).strip() for cell in row.findall(f"{A}tc")] for row in grid.findall(f"{A}tr")]))
            elif text := _frame(shape):
                yield Block(i, label, "text", text)
        for kind, target in own.values():
            if kind == "notesSlide" and target in package.names:
                bodies = [s for s in package.part(target).iter(f"{P}sp") if (ph := s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body"]
                notes = "\n".join(_frame(s, marks=False) for s in bodies).strip()
                if notes:
                    yield Block(i, label, "notes", f"> **Notes:** {notes}")


def _shapes(group: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in group:
        if child.tag == f"{P}grpSp":
            yield from _shapes(child)
        elif child.tag in (f"{P}sp", f"{P}pic", f"{P}graphicFrame"):
            yield child


def _frame(shape: ElementTree.Element, marks: bool = True) -> str:
    lines = []
    for paragraph in shape.iter(f"{A}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{A}t"))
        properties = paragraph.find(f"{A}pPr")
        level = int(properties.get("lvl", "0")) if properties is not None else 0
        if text:
            lines.append("  " * (level - 1) + f"- {text}" if marks and level else text)
    return "\n".join(lines)


def xlsx(data: bytes, rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> Iterator[Block]:
    """Sheets in their order as tables; a sheet's rows or columns beyond the bounds are told of in a block of their own."""
    package = Package(data)
    main = "xl/workbook.xml"
    links = package.links(main)
    shared = []
    if "xl/sharedStrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in x.iter(f"{S}t")) for x in package.part("xl/sharedStrings.xml").findall(f"{S}si")]
    for i, sheet in enumerate(package.part(main).iter(f"{S}sheet")):
        name, label = links.get(sheet.get(f"{R}id", ""), ("", ""))[1], f"Sheet: {sheet.get('name', '')}"
        if name not in package.names:
            continue
        found: dict[int, dict[int, str]] = {}
        beyond = [0, 0]
        for n, row in enumerate(package.part(name).iter(f"{S}row")):
            at = int(row.get("r", n + 1)) - 1
            for k, cell in enumerate(row.findall(f"{S}c")):
                column = _column(cell.get("r", "")) if cell.get("r") else k
                if at < rows and column < columns:
                    found.setdefault(at, {})[column] = _value(cell, shared).replace("|", "\\|").replace("\n", " ")
                else:
                    beyond = [max(beyond[0], at + 1), max(beyond[1], column + 1)]
        last = max((r for r, cells in found.items() if any(c.strip() for c in cells.values())), default=-1)
        if last >= 0:
            width = 1 + max(max(cells, default=0) for cells in found.values())
            grid = [[found.get(r, {}).get(c, "") for c in range(width)] for r in range(last + 1)]
            if not any(c.strip() for c in grid[0]):
                grid.insert(0, [f"col{c + 1}" for c in range(width)])
            yield Block(i, label, "table", table(grid))
        if any(beyond):
            yield Block(i, label, "text", f"(cut to {rows} rows and {columns} columns; the sheet reaches row {max(beyond[0], last + 1)}, column {beyond[1]})")
        for kind, target in package.links(name).values():
            if kind == "drawing":
                for part, image in package.links(target).values():
                    if part == "image":
                        yield Block(i, label, "image", image)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{S}v") or ""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if kind == "b":
        return "True" if value == "1" else "False"
    return value


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "xlsm": xlsx}


def blocks(data: bytes, kind: str) -> list[Block]:
    return list(READERS[kind](data))


def markdown(found: list[Block]) -> str:
    """Blocks as one text: a heading where a labelled page begins; images are left to recognition."""
    out, label = [], ""
    for block in found:
        if block.label and block.label != label:
            out.append(f"### {block.label}")
            label = block.label
        if block.kind != "image":
            out.append(block.text)
    return "\n\n".join(out)
