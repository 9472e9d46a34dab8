"""Image and PDF work behind small protocols.

A backend is a picklable object whose methods take bytes and give rows; Spark calls it
in Arrow batches, a row per file or page.  Without a backend a step that needs one
raises; steps with nothing to do do not.
"""

from __future__ import annotations

from typing import Iterator, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "doc_id string, page_num int, page_width double, seq int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
BOX = "doc_id string, page_num int, seq int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string, page_width int"
PAGE = "doc_id string, page_num int, image binary"
INFO = "doc_id string, page_count int, metadata array<struct<key:string,value:string>>, error string"
#: What a backend may raise; a file that makes it raise is rejected with the message.
FAILED = "{}: {}"


class PdfBackend(Protocol):
    def info(self, content: bytes) -> tuple[int, dict[str, str]]: ...  # page count and metadata

    def blocks(self, content: bytes) -> Iterator[dict]: ...  # rows of BLOCK without doc_id

    def pages(self, content: bytes, dpi: int, first: int | None, last: int | None) -> Iterator[tuple[int, bytes]]: ...


class OcrBackend(Protocol):
    def languages(self) -> list[str]: ...

    def boxes(self, image: bytes, lang: str, psm: int = 3, oem: int = 3) -> Iterator[dict]: ...  # rows of BOX without doc_id, page_num


class ImageBackend(Protocol):
    def prepare(self, image: bytes, contrast: bool) -> bytes: ...


class PdfWriter(Protocol):
    def write(self, pages: list[list[dict]], header: str | None, footer: str | None) -> bytes: ...  # lines by output page


class MissingBackend(RuntimeError):
    pass


def available(ocr) -> bool:
    return ocr is not None and bool(ocr.languages())


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame with plain columns: objects, nullable ints, doubles."""
    kinds = {"int": "Int32", "double": "float64"}
    cols = [x.split(" ", 1) for x in schema.split(", ")]  # no comma and blank inside a type
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=kinds.get(t, object)) for n, t in cols})


def _told(e: Exception) -> str:
    return FAILED.format(type(e).__name__, e)


def inspect(pdfs: DataFrame, pdf: PdfBackend | None) -> DataFrame:
    """(doc_id, page_count, metadata, error): a row per file, also for files that cannot be read."""

    def run(frames):
        for f in frames:
            rows = []
            for d, c in zip(f.doc_id, f.content):
                if pdf is None:
                    raise MissingBackend("a PDF backend is needed to read PDFs")
                try:
                    n, meta = pdf.info(c)
                    rows.append({"doc_id": d, "page_count": n, "metadata": [{"key": str(k), "value": str(v)} for k, v in meta.items()]})
                except Exception as e:  # whatever a reader makes of a broken file
                    rows.append({"doc_id": d, "error": _told(e)})
            yield _frame(rows, INFO)

    return pdfs.select("doc_id", "content").mapInPandas(run, INFO)


def text_blocks(pdfs: DataFrame, pdf: PdfBackend | None) -> DataFrame:
    """Rows of BLOCK; a file that fails gives one row with its error and no page."""
    def run(frames):
        for f in frames:
            if len(f) and pdf is None:
                raise MissingBackend("a PDF backend is needed for text blocks")
            rows = []
            for d, c in zip(f.doc_id, f.content):
                try:
                    rows += [{"doc_id": d, **r} for r in pdf.blocks(c)]
                except Exception as e:  # as above
                    rows.append({"doc_id": d, "error": _told(e)})
            yield _frame(rows, BLOCK + ", error string")

    return pdfs.select("doc_id", "content").mapInPandas(run, BLOCK + ", error string")


def rasterize(pdfs: DataFrame, pdf: PdfBackend | None, *, dpi=300, first=None, last=None) -> DataFrame:
    """A row per page of the asked range; only these pages are drawn.  A file that fails gives one row with its error."""

    def run(frames):
        for f in frames:
            if len(f) and pdf is None:
                raise MissingBackend("a PDF backend is needed for page images")
            for d, c in zip(f.doc_id, f.content):
                try:
                    for n, image in pdf.pages(c, dpi, first, last):
                        yield _frame([{"doc_id": d, "page_num": n, "image": image}], PAGE + ", error string")
                except Exception as e:  # as above
                    yield _frame([{"doc_id": d, "error": _told(e)}], PAGE + ", error string")

    return pdfs.select("doc_id", "content").mapInPandas(run, PAGE + ", error string")


def prepare(pages: DataFrame, images: ImageBackend, *, contrast: bool = False) -> DataFrame:
    """Pages turned upright, in plain colour, with more contrast on request."""

    def run(frames):
        for f in frames:
            yield f.assign(image=[images.prepare(x, contrast) for x in f.image])

    return pages.select("doc_id", "page_num", "image").mapInPandas(run, PAGE)


def plain_text(pages: DataFrame, ocr: OcrBackend | None, *, lang="kan+eng", psm=3, oem=3) -> DataFrame:
    """(doc_id, page_num, text): recognised words of each page, line by line, without layout."""
    boxes = word_boxes(pages, ocr, lang=lang, psm=psm, oem=oem).filter("trim(text) <> ''")
    lines = boxes.groupBy("doc_id", "page_num", "block_num", "par_num", "line_num").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("ws"))
    line = F.array_join(F.transform("ws", lambda x: x["text"]), " ")
    each = lines.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", line.alias("t")))).alias("ls"))
    text = each.select("doc_id", "page_num", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"))
    return pages.select("doc_id", "page_num").join(text, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))


def word_boxes(pages: DataFrame, ocr: OcrBackend | None, *, lang="kan+eng", psm=3, oem=3) -> DataFrame:
    def run(frames):
        for f in frames:
            if len(f) and ocr is None:
                raise MissingBackend("an OCR backend is needed for scanned pages")
            rows = [{"doc_id": d, "page_num": n, **r} for d, n, x in zip(f.doc_id, f.page_num, f.image) for r in ocr.boxes(x, lang, psm, oem)] if len(f) else []
            yield _frame(rows, BOX)

    # Recognition costs far more than moving a page, so pages are dealt out evenly.
    return pages.select("doc_id", "page_num", "image").repartition("doc_id", "page_num").mapInPandas(run, BOX)
