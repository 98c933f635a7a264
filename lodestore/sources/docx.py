"""DOCX text: paragraphs and headings of word/document.xml."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from ..errors import DocumentTooLarge

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def heading_level(style: str, outline: str | None) -> int:
    """1..9 from a 'Heading N' style or an outline level; 0 for body text."""
    m = re.fullmatch(r"(?i)heading([1-9])", style.replace(" ", ""))
    if m:
        return int(m[1])
    if outline is not None and outline.isdigit() and int(outline) < 9:
        return int(outline) + 1
    return 0


def docx_blocks(data: bytes, most: int = 0) -> list[tuple[int, str]]:
    """(heading level or 0, text) per paragraph; the decompressed size is limited too."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open("word/document.xml") as part:
        xml = part.read(most + 1) if most > 0 else part.read()
    if most > 0 and len(xml) > most:
        raise DocumentTooLarge("word/document.xml")
    out: list[tuple[int, str]] = []
    text: list[str] = []
    style, outline = "", None
    for event, node in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        tag = node.tag.removeprefix(_W)
        if event == "start":
            if tag == "p":
                text, style, outline = [], "", None
            continue
        if tag == "t":
            text.append(node.text or "")
        elif tag in ("br", "cr"):
            text.append("\n")
        elif tag == "tab":
            if not any(c.tag == _W + "tab" and _W + "val" in c.attrib for c in [node]):
                text.append("\t")
        elif tag == "pStyle":
            style = node.get(_W + "val", "")
        elif tag == "outlineLvl":
            outline = node.get(_W + "val")
        elif tag == "p":
            level = heading_level(style, outline)
            out.append((level, "".join(text)) if level else (0, "".join(text) + "\n"))
            node.clear()
    return out
