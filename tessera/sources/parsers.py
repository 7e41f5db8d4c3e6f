"""Binary formats to Markdown, with the standard library only; OCR, and another PDF reader, are pluggable."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from xml.etree import ElementTree

from . import binary

SLIDE_TEXT, PAGE_TEXT, IMAGE_SIDE = 50, 100, 800


class Ocr(Protocol):
    """Text recognised in an image; the default recognises nothing."""

    def recognise(self, image: bytes) -> str: ...


#: Page texts of a PDF; set by the deployment in place of the reader here.
PDF_PAGES: Callable[[bytes], list[str]] | None = None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag one by one; what has been read is let go, so the member's size doesn't matter."""
    with z.open(name) as f:
        for _, node in ElementTree.iterparse(f):
            if _local(node.tag) == tag:
                yield node
                node.clear()


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def enough(text: str, least: int) -> bool:
    return len(re.sub(r"\s+", "", text or "")) > least


def docx(data: bytes, ocr: Ocr | None = None) -> str:
    if data.startswith(binary.OLE_MAGIC):
        return "\n\n".join(binary.word_text(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        paragraphs = [_text(p) for p in _elements(z, "word/document.xml", "p")]
    return "\n\n".join(p for p in paragraphs if p)


def xlsx(data: bytes, ocr: Ocr | None = None) -> str:
    """The first sheet, a line per row, cells joined by bars."""
    if data.startswith(binary.OLE_MAGIC):
        return "\n".join(" | ".join(row) for row in binary.sheet_rows(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_text(s) for s in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        lines = []
        for row in _elements(z, first, "row"):
            cells = []
            for c in (c for c in row if _local(c.tag) == "c"):
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                kind = c.get("t")
                cells.append(_text(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value)
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def pptx(data: bytes, ocr: Ocr | None = None) -> str:
    if data.startswith(binary.OLE_MAGIC):
        return "\n\n".join(f"## Slide {k}\n{body}" for k, body in enumerate(binary.slide_texts(data), 1))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for k, name in enumerate(slides, 1):
            body = "\n".join(filter(None, (_text(p) for p in _xml(z, name).iter() if _local(p.tag) == "p")))
            if ocr and not enough(body, SLIDE_TEXT):
                rels = f"ppt/slides/_rels/{name.rpartition('/')[2]}.rels"
                if rels in z.namelist():
                    images = [r.get("Target", "") for r in _xml(z, rels) if r.get("Type", "").endswith("/image")]
                    body = "\n".join([body, *(ocr.recognise(z.read("ppt/" + t.removeprefix("../"))) for t in images)]).strip()
            out.append(f"## Slide {k}\n{body}")
    return "\n\n".join(out)


def pdf(data: bytes, ocr: Ocr | None = None) -> str:
    """Pages with their text; where a page has too little and OCR is on, what its images show."""
    if PDF_PAGES:
        return "\n\n".join(f"## Page {k}\n{p}" for k, p in enumerate(PDF_PAGES(data), 1))
    file = binary.Pdf(data)
    out = []
    for k, page in enumerate(file.pages(), 1):
        body = file.text(page)
        if ocr and not enough(body, PAGE_TEXT):
            body = "\n".join(filter(None, (ocr.recognise(fit(x)) for x in file.images(page)))) or body
        out.append(f"## Page {k}\n{body}")
    return "\n\n".join(out)


def image(data: bytes, ocr: Ocr | None = None) -> str:
    return ocr.recognise(fit(data)) if ocr else ""


def fit(data: bytes) -> bytes:
    """An image brought within IMAGE_SIDE for OCR; formats that aren't decoded here stay as they are."""
    pixels = binary.png_pixels(data)
    if pixels is None:
        return data
    height, width = pixels.shape[:2]
    size = fitted(width, height)
    return data if size == (width, height) else binary.png_of(binary.scaled(pixels, *size))


def fitted(width: int, height: int, side: int = IMAGE_SIDE) -> tuple[int, int]:
    """The size of an image brought within side x side, its aspect kept; small images stay."""
    if width <= side and height <= side:
        return width, height
    scale = min(side / width, side / height)
    return max(1, int(width * scale)), max(1, int(height * scale))


Parser = Callable[[bytes, "Ocr | None"], str]
REGISTRY: dict[str, Parser] = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "pdf": pdf, "jpg": image, "png": image}


def register(fmt: str, parser: Parser) -> None:
    """Use parser for a format, now and in later plans of this session."""
    REGISTRY[fmt] = parser


def parse(fmt: str, path: str, data: bytes, ocr: Ocr | None = None) -> tuple[str, str | None]:
    """(body, error); archives and unknown formats are empty, an unreadable file is empty with its error."""
    if fmt not in REGISTRY:
        return "", None
    name = path.rpartition("/")[2]
    if fmt in ("jpg", "png"):
        return (f"## Image {name}\n{image(data, ocr)}" if ocr else name), None
    try:
        return REGISTRY[fmt](data, ocr), None
    except Exception as e:  # one bad file must not end the scan; its error is a column
        return "", f"{type(e).__name__}: {e}"[:500]
