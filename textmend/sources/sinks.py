"""Sinks: texts per page and document, JSON reports, printable HTML, page images.

Files are written by Spark's writers, partitioned so that each document or page can be
found by its path; nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout

#: Suffixes of a document's outputs, by download type.
OUTPUTS = {"pdf": "_corrected.pdf", "text": "_corrected.txt", "json": "_report.json"}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path.cast("string"), r"[^/\\]*$", 0), r"\.[^.]*$", "")


def key(path: Column) -> Column:
    """A document's own name in output folders: its stem and a hash of its whole path, so that equal file names stay apart."""
    return F.concat(stem(path), F.lit("-"), F.lower(F.lpad(F.hex(F.xxhash64(path.cast("string"))), 16, "0")))


def output_name(path: Column, suffix: str) -> Column:
    return F.concat(key(path), F.lit(suffix))


def page_name(n: Column, prefix: str = "page_", ext: str = ".txt") -> Column:
    return F.format_string(f"{prefix}%03d{ext}", n)


def write_pages(pages: DataFrame, path: str) -> None:
    """One folder per page, named like its file; the corrected text, or the raw one without."""
    text = F.coalesce("corrected_text", "raw_text")
    pages.select(key(F.col("doc_id")).alias("doc"), page_name(F.col("page_num")).alias("page"), text.alias("value")).write.mode("overwrite").partitionBy("doc", "page").text(path)


def write_combined(report: DataFrame, path: str) -> None:
    report.select(key(F.col("doc_id")).alias("doc"), F.col("full_text").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_reports(report: DataFrame, path: str) -> None:
    """Nested JSON, one line a document; characters stay as they are."""
    report.write.mode("overwrite").json(path)


def pretty(report: DataFrame) -> DataFrame:
    return report.select("doc_id", F.to_json(F.struct(*[c for c in report.columns]), {"pretty": "true"}).alias("json"))


def printable(lines: DataFrame) -> DataFrame:
    """(doc_id, html): lines in order with their alignment, a page break wherever the page changes."""
    css = F.when(F.col("alignment") == "C", "center").when(F.col("alignment") == "R", "right").otherwise("left")
    row = F.concat(F.when(F.col("new"), '<div class="page"></div>').otherwise(""), F.lit('<p style="text-align:'), css, F.lit('">'), T.escape_html(F.col("text")), F.lit("</p>"))
    arr = F.array_sort(F.collect_list(F.struct("page_num", "line_ord", row.alias("h"))))
    w = Window.partitionBy("doc_id").orderBy("page_num", "line_ord")
    runs = layout.page_runs(lines.withColumn("line_ord", F.row_number().over(w)))
    first = runs.withColumn("new", (F.col("run") > 1) & (F.col("run") != F.lag("run").over(Window.partitionBy("doc_id").orderBy("line_ord"))))
    body = F.array_join(F.transform(arr, lambda x: x["h"]), "\n")
    return first.groupBy("doc_id").agg(F.concat(F.lit('<meta charset="utf-8"><style>.page{page-break-before:always}</style>\n'), body).alias("html"))


def write_documents(lines: DataFrame, writer, path: str, *, header: str | None = None, footer: str | None = None) -> None:
    """Corrected documents by a ``PdfWriter``: (doc, content), a row per document, its lines by output page.

    A new output page begins wherever the page number changes.  Header and footer are the
    writer's to draw on each page; one that cannot show a line's script should raise.
    """
    w = Window.partitionBy("doc_id").orderBy("page_num", "line_ord")
    runs = layout.page_runs(lines.withColumn("line_ord", F.row_number().over(w)))
    rows = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_ord", "run", "text", "alignment"))).alias("ls"))

    def run(frames):
        for f in frames:
            out = []
            for ls in f.ls:
                pages: dict[int, list[dict]] = {}
                for x in ls:
                    pages.setdefault(int(x["run"]), []).append({"text": x["text"], "alignment": x["alignment"]})
                out.append(writer.write([pages[r] for r in sorted(pages)], header, footer))
            yield pd.DataFrame({"doc": f.doc, "content": out})

    rows.select(key(F.col("doc_id")).alias("doc"), "ls").mapInPandas(run, "doc string, content binary").write.mode("overwrite").parquet(path)


def write_images(pages: DataFrame, path: str) -> None:
    """Page images (doc_id, page_num, image) as binary rows under names like ``page_001.png``."""
    pages.select(key(F.col("doc_id")).alias("doc"), page_name(F.col("page_num"), ext=".png").alias("name"), "image").write.mode("overwrite").partitionBy("doc").parquet(path)


def find_output(files: DataFrame, kind: str) -> DataFrame:
    """The rows of (path) that a download of that kind would serve."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output type {kind!r}")
    return files.filter(F.endswith("path", F.lit(OUTPUTS[kind])))


def server_events(progress: DataFrame) -> DataFrame:
    """Progress rows as event-stream messages."""
    return progress.select(F.concat(F.lit("data: "), F.to_json(F.struct(*progress.columns)), F.lit("\n\n")).alias("value"))
