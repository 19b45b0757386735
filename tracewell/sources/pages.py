"""Pages of PDF files and of images, by functions that the caller supplies for what needs a library of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of a text layer from which on a PDF's page is taken as it is.
LAYER = 120
PAGES = "doc_id string, page_num int, text string, text_source string, route string, image binary, error string"


def pdf_pages(files: DataFrame, read: Callable[[bytes], list[tuple[str, list[str]]]], render: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """Pages of PDF files (doc_id, content). read gives each page's text layer and comments, render a page's image.

    A layer of LAYER characters or more is the text; else the page goes to OCR with its image. Comments follow the text. A file that
    can't be read is one page with its error; others are not touched by it."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    found = read(bytes(content))
                except Exception as e:  # noqa: BLE001  the file's, not the run's
                    out.append((doc, 1, None, None, None, None, str(e)))
                    continue
                for n, (layer, comments) in enumerate(found, 1):
                    layer = (layer or "").strip()
                    whole = len(layer) >= LAYER
                    notes = "".join(f"\n[comment: {c}]" for c in comments)
                    error, image = None, None
                    if not whole and render is not None:
                        try:
                            image = render(bytes(content), n)
                        except Exception as e:  # noqa: BLE001
                            error = str(e)
                    out.append((doc, n, (layer + notes).strip() or None, "embedded" if whole else None, None if whole else "vlm", image, error))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "text", "text_source", "route", "image", "error"])

    return files.select("doc_id", "content").mapInPandas(pages, PAGES)


def image_pages(files: DataFrame, normalise: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """One page for each image (doc_id, content), to be read by OCR: upright and cleaned by normalise, where it is given."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    out.append((doc, 1, None, None, "ocr", normalise(bytes(content)) if normalise else bytes(content), None))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, 1, None, None, "ocr", bytes(content), str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "text", "text_source", "route", "image", "error"])

    return files.select("doc_id", "content").mapInPandas(pages, PAGES)
