"""Words that OCR found, made lines and pages, and which pages need another reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A page goes by its OCR from so many words and so much mean confidence on.
MIN_WORDS, MIN_CONFIDENCE = 25, 82
MOST_SPACES = 8


def lines_of(words: pd.DataFrame) -> str:
    """Text of a page's words (text, left, top, width, height): rows by their middles, gaps as spaces."""
    words = words.assign(mid=words["top"] + words["height"] / 2).sort_values(["mid", "left"])
    height = float(sorted(words["height"])[len(words) // 2]) if len(words) else 0.0
    near, wide = max(6.0, 0.6 * height), max(4.0, 0.5 * height)
    rows: list[list] = []
    for w in words.itertuples():
        if rows and abs(w.mid - sum(x.mid for x in rows[-1]) / len(rows[-1])) <= near:
            rows[-1].append(w)
        else:
            rows.append([w])
    out = []
    for row in rows:
        row.sort(key=lambda w: w.left)
        text, end = "", None
        for w in row:
            if end is not None:
                text += " " * max(1, min(MOST_SPACES, int((w.left - end) / wide)))
            text, end = text + w.text, w.left + w.width
        out.append(text)
    return "\n".join(out)


def read_pages(words: DataFrame) -> DataFrame:
    """doc_id, page_num, text, ocr_words and ocr_conf from words (doc_id, page_num, text, left, top, width, height, conf)."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(page["doc_id"].iloc[0], page["page_num"].iloc[0], lines_of(page), len(page), float(page["conf"].mean()))], columns=["doc_id", "page_num", "text", "ocr_words", "ocr_conf"])

    return words.groupBy("doc_id", "page_num").applyInPandas(run, "doc_id string, page_num int, text string, ocr_words int, ocr_conf double")


def route(pages: DataFrame) -> DataFrame:
    """pages with route: ocr where there is enough of it, else vlm."""
    good = (F.coalesce("ocr_words", F.lit(0)) >= MIN_WORDS) & (F.coalesce("ocr_conf", F.lit(0.0)) >= MIN_CONFIDENCE)
    return pages.withColumn("route", F.when(good, "ocr").otherwise("vlm"))


def transcribe(pages: DataFrame, read, column: str = "image") -> DataFrame:
    """pages whose route is vlm and that have no text, read by a function of image bytes; each page's failure is its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, page, image in zip(frame["doc_id"], frame["page_num"], frame[column], strict=True):
                try:
                    out.append((doc, page, read(bytes(image)), None))
                except Exception as e:  # noqa: BLE001  the page's error is its result
                    out.append((doc, page, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "text", "error"])

    todo = pages.where("route = 'vlm' and text is null").select("doc_id", "page_num", column)
    return todo.mapInPandas(run, "doc_id string, page_num int, text string, error string")
