"""Readers: files of many kinds as rows of text, with what failed as a column rather than an absent row."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from html.parser import HTMLParser
from xml.dom import minidom

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.cleaning import bare
from veldspar.sources import office

#: Characters of a text and rows of a table that are read, unless more is asked for; a file that was cut says so in its note.
MOST_CHARS, MOST_ROWS = 2_000_000, 5000
#: Which reader takes which extension; what is absent here is an error row. ``register`` adds readers.
FORMATS: dict[str, str] = {
    **dict.fromkeys(("txt", "text", "md", "markdown", "rst", "log", "ini", "cfg", "toml", "py", "js", "ts", "sql", "sh", "tex"), "text"),
    **dict.fromkeys(("csv", "tsv"), "csv"),
    **dict.fromkeys(("json", "jsonl", "xml", "yaml", "yml"), "structured"),
    **dict.fromkeys(("html", "htm", "xhtml"), "html"),
    **dict.fromkeys(("eml",), "email"),
    **dict.fromkeys(("rtf",), "rtf"),
    **dict.fromkeys(("docx", "pptx", "xlsx", "xlsm"), "office"),
    **dict.fromkeys(("pdf", "xls", "png", "jpg", "jpeg", "tif", "tiff"), "binary"),
}
#: Readers by name: from the bytes of a file and its extension to its text and, where it was cut, a note.
Reader = Callable[[bytes, str, int, int], tuple[str, str | None]]
READERS: dict[str, Reader] = {}


def register(name: str, extensions: Sequence[str], reader: Reader) -> None:
    """Let ``reader`` take files of some extensions, in place of those that took them before."""
    READERS[name] = reader
    FORMATS.update(dict.fromkeys((e.lower().lstrip(".") for e in extensions), name))


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def decode(data: bytes) -> str:
    """UTF-8 or UTF-16 (with or without a mark), else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def sniff(text: str, lines: int = 50) -> str:
    """The delimiter under which most of the first lines have the same number of cells, two at least; the comma if none does."""
    head = "\n".join(text.split("\n", lines)[:lines])

    def agreeing(delimiter: str) -> tuple[int, int]:
        widths = Counter(len(r) for r in csv.reader(io.StringIO(head), delimiter=delimiter) if any(c.strip() for c in r))
        return max(((n, w) for w, n in widths.items() if w > 1), default=(0, 0))

    return max(",;\t|", key=agreeing)


def csv_markdown(text: str, most: int = MOST_ROWS) -> str:
    """A delimited table as Markdown: uneven rows go, and of the others the first ``most`` stay."""
    return _csv(text, most)[0]


def _csv(text: str, most: int) -> tuple[str, str | None]:
    rows = csv.reader(io.StringIO(text), delimiter=sniff(text))
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return "", None
    width = len(rows[0])
    cell = lambda c: c.strip().replace("|", "\\|").replace("\n", " ")
    header = [cell(c) or f"col{i + 1}" for i, c in enumerate(rows[0])]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([cell(c) for c in r]) for r in rows[1:] if len(r) == width]
    note = f"{len(body) - most} rows beyond the first {most} left out" if len(body) > most else None
    return "\n".join([line(header), line(["---"] * width), *body[:most]]), note


def structured_text(text: str, kind: str, most: int = MOST_CHARS) -> str:
    """JSON, XML and YAML (with its library) evenly laid out in a fenced block; anything else, or what can't be parsed, as it stands."""
    try:
        if kind in ("json",):
            text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        elif kind == "xml":
            if "<!ENTITY" in text:
                raise ValueError("entities are not expanded")
            text = "\n".join(x for x in minidom.parseString(text.encode()).toprettyxml(indent="  ").split("\n") if x.strip())
        elif kind == "yaml":
            import yaml

            text = yaml.safe_dump(yaml.safe_load(text), allow_unicode=True, sort_keys=False)
    except Exception:  # a file that can't be parsed is still read
        pass
    return f"```{kind}\n{text[:most].strip()}\n```"


def email_text(data: bytes) -> str:
    """Headers as bold labels, then the preferred body."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    lines = [f"**{h}:** {message[h]}" for h in ("From", "To", "Cc", "Bcc", "Subject", "Date") if message[h]]
    body = message.get_body(preferencelist=("plain", "html"))
    content = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        content = html_markdown(content)
    return "\n".join(lines) + "\n\n" + content.strip()


def rtf_text(text: str) -> str:
    """Text of an RTF file: control words and groups of data dropped, paragraphs as line feeds."""
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    text = re.sub(r"\\tab\b ?", "\t", text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", text)
    return re.sub(r"[{}]", "", text).strip()


class _Markdown(HTMLParser):
    # Tags whose content goes, and tags that part blocks.
    SKIP = frozenset({"script", "style", "noscript", "head", "meta", "link", "svg", "iframe", "form", "button"})
    BLOCKS = frozenset({"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote", "figure", "figcaption", "dl", "dt", "dd", "table", "tr"})
    MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre = 0, 0
        self.lists: list[list] = []
        self.link: list[tuple[str, int]] = []
        self.rows: list[list[str]] = []
        self.cell: int | None = None

    def _break(self, n: int = 2) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += tag not in ("meta", "link")
        elif self.skip:
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self._break(1)
            depth = "  " * max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.out.append(f"{depth}{self.lists[-1][1]}. ")
            else:
                self.out.append(f"{depth}- ")
        elif tag == "br":
            self._break(1)
        elif tag == "hr":
            self._break()
            self.out.append("---")
            self._break()
        elif tag == "pre":
            self._break()
            self.out.append("```\n")
            self.pre += 1
        elif tag in self.MARKS:
            if not (tag == "code" and self.pre):
                self.out.append(self.MARKS[tag])
        elif tag == "a":
            self.link.append((dict(attrs).get("href") or "", len(self.out)))
        elif tag in ("td", "th"):
            self.cell = len(self.out)
        elif tag in self.BLOCKS:
            if tag == "table":
                self.rows = []
            if tag == "tr":
                self.rows.append([])
            elif self.cell is None:
                self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - (tag not in ("meta", "link")))
        elif self.skip:
            return
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```")
            self._break()
        elif tag in self.MARKS:
            if not (tag == "code" and self.pre):
                self.out.append(self.MARKS[tag])
        elif tag == "a" and self.link:
            target, at = self.link.pop()
            text = "".join(self.out[at:]).strip()
            del self.out[at:]
            self.out.append(f"[{text}]({target})" if target and text else text)
        elif tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.out[self.cell :]).split()).replace("|", "\\|")
            del self.out[self.cell :]
            self.cell = None
            if self.rows:
                self.rows[-1].append(text)
        elif tag == "table":
            rows = [r for r in self.rows if r]
            if rows:
                wide = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
                self._break()
                self.out.append("\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]))
            self.rows = []
            self._break()
        elif tag in self.BLOCKS or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            if self.cell is None:
                self._break()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.pre:
            self.out.append(data)
        else:
            text = " ".join(data.split())
            if text or (data and self.out and not self.out[-1].endswith(("\n", " "))):
                self.out.append((" " if data[:1].isspace() else "") + text + (" " if text and data[-1:].isspace() else ""))


def html_markdown(source: str) -> str:
    """HTML as Markdown: headings, nested lists, code, emphasis, links and tables; scripts, styles and forms go."""
    parser = _Markdown()
    try:
        parser.feed(source or "")
        parser.close()
    except Exception:  # what the walker can't read is still read without its tags
        return bare(source).strip()
    text = "".join(parser.out)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ \t]{2,}", " ", text))
    text = re.sub(r"\n[ \t]+(?=[^\s\-0-9])", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def extract(data: bytes, name: str) -> tuple[str | None, str | None]:
    """Text of a file and what went wrong, one of them null."""
    return extract_noted(data, name)[:2]


def extract_noted(data: bytes, name: str, most_chars: int = MOST_CHARS, most_rows: int = MOST_ROWS) -> tuple[str | None, str | None, str | None]:
    """Text of a file, what went wrong, and what was left out of it."""
    kind = name.rpartition(".")[2].lower()
    reader = READERS.get(FORMATS.get(kind, ""))
    if reader is None:
        return None, f"unsupported extension: {kind}", None
    try:
        text, note = reader(data, kind, most_chars, most_rows)
        return text, None, note
    except ImportError as e:
        return None, f"no library for {kind}: {e.name}", None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:200], None


def _cut(text: str, most: int) -> tuple[str, str | None]:
    return text[:most], f"{len(text) - most} characters beyond the first {most} left out" if len(text) > most else None


def _structured(data: bytes, kind: str, chars: int, rows: int) -> tuple[str, str | None]:
    text = decode(data)
    return structured_text(text, {"yml": "yaml"}.get(kind, kind), chars), _cut(text, chars)[1]


def _office(data: bytes, kind: str, chars: int, rows: int) -> tuple[str, str | None]:
    found = list(office.xlsx(data, rows)) if kind in ("xlsx", "xlsm") else office.blocks(data, kind)
    cuts = [b.text for b in found if b.kind == "text" and b.text.startswith("(cut to ")]
    return office.markdown(found), "; ".join(cuts) or None


def _binary(data: bytes, kind: str, chars: int, rows: int) -> tuple[str, str | None]:
    """PDF by a library that may be absent; images and old office files need a connector."""
    if kind != "pdf":
        raise ValueError("images and old office files need a connector")
    import pypdf

    return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages), None


READERS |= {
    "text": lambda data, kind, chars, rows: _cut(decode(data), chars),
    "csv": lambda data, kind, chars, rows: _csv(decode(data), rows),
    "structured": _structured,
    "html": lambda data, kind, chars, rows: (html_markdown(decode(data)), None),
    "email": lambda data, kind, chars, rows: (email_text(data), None),
    "rtf": lambda data, kind, chars, rows: (rtf_text(decode(data)), None),
    "office": _office,
    "binary": _binary,
}


def read_files(spark: SparkSession, path: str, most_chars: int = MOST_CHARS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Files below ``path`` in any supported format: path, filename, format, text, error, note (what was left out).

    Files are listed and read by Spark, so the path may be in any store it knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]+)\z", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    files = files.withColumn("format", F.try_element_at(known, suffix))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [extract_noted(c, n, most_chars, most_rows) for c, n in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=["path", "filename", "format", "text", "error", "note"])

    return files.select("path", "filename", "format", "content").mapInArrow(run, "path string, filename string, format string, text string, error string, note string")


def read_remote(files: DataFrame, send: Callable[[bytes, str], Mapping[str, str]], fallback: bool = True) -> DataFrame:
    """Files (path, filename, content) read by a remote service, and where it fails, unless ``fallback`` is off, by the readers here.

    ``send`` gives the service's answer, of which markdown is taken before text. Returns path, filename, text, error, reader.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for name, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    answer = send(content, name)
                    rows.append((answer.get("markdown") or answer.get("text") or "", None, "remote"))
                except Exception as e:  # one file that fails doesn't end the task
                    rows.append((*extract(content, name), "local") if fallback else (None, f"{type(e).__name__}: {e}"[:200], "remote"))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["path", "filename", "text", "error", "reader"])

    return files.select("path", "filename", "content").mapInArrow(run, "path string, filename string, text string, error string, reader string")


def pages_markdown(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, html) as Markdown, in Arrow batches: page_id, markdown."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_markdown)

    return pages.select("page_id", run(F.coalesce("html", F.lit(""))).alias("markdown"))
