"""Word documents as pages, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Characters of a page where the document marks none; the least text that a residue must have.
PAGE_CHARS, FLOOR = 3000, 24
NOTES = {"footnoteReference": ("word/footnotes.xml", "footnote"), "endnoteReference": ("word/endnotes.xml", "endnote"), "commentReference": ("word/comments.xml", "comment")}


def _text(node, notes: dict | None = None) -> str:
    """Text of a node: deleted and hidden runs are labelled, notes follow where they are referred to, breaks are \\f."""
    out = []
    for x in node:
        tag = x.tag.removeprefix(W)
        if tag == "del":
            out.append(f"<<struck: {''.join(t.text or '' for t in x.iter(W + 'delText'))}>>")
        elif tag == "r":
            text = _text(x, notes)
            hidden = x.find(f"{W}rPr/{W}vanish") is not None
            out.append(f"<<hidden: {text}>>" if hidden and text.strip() else text)
        elif tag in ("t", "delText"):
            out.append(x.text or "")
        elif tag == "tab":
            out.append("\t")
        elif tag == "br":
            out.append("\f" if x.get(W + "type") == "page" else "\n")
        elif tag == "lastRenderedPageBreak":
            out.append("\f")
        elif tag in NOTES and notes is not None:
            out.append(f" [{NOTES[tag][1]}: {notes.get((tag, x.get(W + 'id')), '')}]")
        elif tag == "tbl":
            rows = [" | ".join(" ".join(_text(p, notes) for p in c.iter(W + "p")).strip() for c in r.iter(W + "tc")) for r in x.iter(W + "tr")]
            out.append("\n".join(rows) + "\n")
        elif tag == "p":
            out.append(_text(x, notes) + "\n")
        elif tag not in ("rPr", "pPr", "sectPr"):
            out.append(_text(x, notes))
    return "".join(out)


def read_docx(content: bytes) -> list[str]:
    """Pages of a Word file: by its page breaks, else by an estimate of characters; headers and footers and what no page holds
    come last."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        notes = {}
        for tag, (part, kind) in NOTES.items():
            if part in names:
                for n in ElementTree.fromstring(z.read(part)).iter(W + kind):
                    notes[tag, n.get(W + "id")] = _text(n).strip()
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        text = _text(body, notes) if body is not None else ""
        pages = text.split("\f") if "\f" in text else _estimate(text)
        extra = [_text(ElementTree.fromstring(z.read(n))).strip() for n in sorted(names) if re.fullmatch(r"word/(header|footer)\d*\.xml", n)]
    held = _bare("".join(pages))
    residue = [x for x in dict.fromkeys(extra) if len(_bare(x)) >= FLOOR and _bare(x) not in held]
    pages = [p.strip() for p in pages] + residue
    lost = missing(units_of(content), pages)  # whatever the walk didn't reach
    return pages + (["\n".join(lost)] if lost else [])


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def _estimate(text: str) -> list[str]:
    pages, now = [], ""
    for line in text.splitlines(keepends=True):
        if now and len(now) + len(line) > PAGE_CHARS:
            pages.append(now)
            now = ""
        now += line
    return [*pages, now]


def missing(units: list[str], pages: list[str]) -> list[str]:
    """Fragments of units (of FLOOR letters or digits at least) that no page holds, spaces, punctuation and case aside. A unit that is
    missing as a whole is halved by words until a half is there, is a single word or has no more than FLOOR letters."""
    hay, out = _bare("".join(pages)), []
    stack = [u.split() for u in reversed(units) if len(_bare(u)) >= FLOOR]
    while stack:
        words = stack.pop()
        bare = _bare("".join(words))
        if not bare or bare in hay:
            continue
        if len(bare) <= FLOOR or len(words) < 2:
            out.append(" ".join(words))
        else:
            half = len(words) // 2
            stack += [words[half:], words[:half]]
    return out


def units_of(content: bytes) -> list[str]:
    """Every run of text in the parts of a Word file that hold content, deleted text included; fields' instructions aside."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if re.fullmatch(r"word/[^/]+\.xml", name) and not re.search(r"(styles|settings|fontTable|numbering|webSettings|theme\d*)\.xml$", name):
                out += [t.text for t in ElementTree.fromstring(z.read(name)).iter() if t.tag in (W + "t", W + "delText") and t.text and t.text.strip()]
    return out


def docx_pages(files: DataFrame) -> DataFrame:
    """doc_id, page_num, text and error of the pages of files (doc_id, content); a file that can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    out += [(doc, n, t, None) for n, t in enumerate(read_docx(bytes(content)), 1)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    out.append((doc, 1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "text", "error"])

    return files.select("doc_id", F.col("content")).mapInPandas(run, "doc_id string, page_num int, text string, error string")
