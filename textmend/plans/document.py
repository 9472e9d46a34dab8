"""Documents to reports: access path by kind of file, correction per line, rollups per page and document.

Digital PDFs, scanned PDFs and images reach one table of layout lines by different
ways; from there on all documents go through the same transforms.  Every page is a
row, so OCR and correction run in parallel and only the rollups shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import correct, layout
from ..operators.lexicon import Lexicon
from ..script import ScriptProfile
from ..sources import backends, sinks
from ..staging import stage


@dataclass
class Result:
    lines: DataFrame  # corrected layout lines with original_text and corrections
    corrections: DataFrame
    pages: DataFrame  # doc_id, page_num, raw_text, corrected_text, has_errors, corrections
    report: DataFrame  # one row per document, nested
    rejected: DataFrame  # documents without a way in, unreadable or over the page cap, with a reason
    images: DataFrame | None = None  # page images that were recognised


@dataclass
class Intake:
    lines: DataFrame  # layout lines of all documents that have any
    pages: DataFrame  # doc_id, page_num: pages of the report, blank ones included where they were drawn
    documents: DataFrame  # a row per file: doc_id, route (digital, scanned, image, rejected), page_count, metadata, error
    images: DataFrame  # doc_id, page_num, image

    @property
    def rejected(self) -> DataFrame:
        return self.documents.filter("route = 'rejected'").select("doc_id", "error")


class Engine:
    """A lexicon and a profile, ready to correct.  Nothing is global; make as many as needed."""

    def __init__(self, lexicon: Lexicon | DataFrame, profile: ScriptProfile, ocr=None, pdf=None, images=None):
        self.lexicon = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
        self.profile, self.ocr, self.pdf, self.images = profile, ocr, pdf, images

    def correct(self, df: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
        return correct.correct(df, self.lexicon, self.profile, id_col=id_col, text_col=text_col).texts()

    def suggest(self, words: DataFrame) -> DataFrame:
        return correct.suggest(words, self.lexicon, self.profile)

    def correct_lines(self, lines: DataFrame) -> DataFrame:
        """Layout lines with corrected text, original_text and corrections; layout columns stay."""
        lines = layout.with_defaults(lines)
        keep = [c for c in lines.columns if c not in {"text", "corrected", "has_errors", "total_words", "total_corrections", "accuracy_rate", "corrections"}]
        out = correct.correct(lines, self.lexicon, self.profile).texts([*keep, F.col("text").alias("original_text")])
        return out.drop("total_corrections", "accuracy_rate").withColumnRenamed("corrected", "text")

    def intake(self, files: DataFrame, *, lang: str = "kan+eng", dpi: int = 300, first: int | None = None, last: int | None = None, contrast: bool = False) -> Intake:
        """Files (path, content) by their way in: every file is in ``documents``, with a route or with an error."""
        doc = files.withColumn("doc_id", F.col("path"))
        pdfs, images = doc.filter(T.is_pdf(F.col("path"))), doc.filter(T.is_image(F.col("path")))
        other = doc.filter(~(T.is_pdf(F.col("path")) | T.is_image(F.col("path"))))
        info = stage(backends.inspect(pdfs, self.pdf))
        # Files over the cap are not read any further.
        sound = info.filter(F.col("error").isNull() & F.col("page_count").between(1, layout.MAX_PAGES)).select("doc_id")
        blocks = stage(backends.text_blocks(pdfs.join(sound, "doc_id", "left_semi"), self.pdf))
        ways = stage(layout.routes(info, blocks, self.profile))
        digital = layout.block_lines(blocks.filter("page_num IS NOT NULL").join(ways.filter("route = 'digital'").select("doc_id"), "doc_id", "left_semi"))
        scans = pdfs.join(ways.filter("route = 'scanned'").select("doc_id"), "doc_id", "left_semi")
        # Drawing and recognition are the dear steps: their results are written once.
        drawn = stage(backends.rasterize(scans, self.pdf, dpi=dpi, first=first, last=last))
        rasters = drawn.filter("error IS NULL").select("doc_id", "page_num", "image").unionByName(images.select("doc_id", F.lit(1).alias("page_num"), F.col("content").alias("image")))
        if self.images is not None:
            rasters = backends.prepare(rasters, self.images, contrast=contrast)
        scanned = layout.ocr_lines(stage(backends.word_boxes(rasters, self.ocr, lang=lang)))
        undrawn = drawn.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("draw_error"))
        none = F.lit(None).cast("string")
        ways = ways.join(undrawn, "doc_id", "left").withColumn("route", F.when(F.col("draw_error").isNotNull(), "rejected").otherwise(F.col("route"))).withColumn("error", F.coalesce("error", "draw_error")).drop("draw_error")
        single = lambda df, route, error: df.select("doc_id", F.lit(route).alias("route"), error.alias("error"))
        documents = ways.unionByName(single(images, "image", none), allowMissingColumns=True).unionByName(single(other, "rejected", F.lit("unsupported file type")), allowMissingColumns=True)
        documents = stage(documents)
        fine = documents.filter("route <> 'rejected'").select("doc_id")
        lines = digital.unionByName(scanned).join(fine, "doc_id", "left_semi")
        # Drawn pages count even if nothing was recognised on them.
        pages = digital.select("doc_id", "page_num").distinct().unionByName(rasters.select("doc_id", "page_num")).join(fine, "doc_id", "left_semi")
        return Intake(lines, pages, documents, rasters)

    def lines_of(self, files: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
        """(layout lines, rejected documents) of files (path, content)."""
        got = self.intake(files, **params)
        return got.lines, got.rejected

    def process(self, files: DataFrame, **params) -> Result:
        got = self.intake(files, **params)
        return self.report(got.lines, got.rejected, got.pages, got.documents.filter("route <> 'rejected'").select("doc_id"), got.images)

    def report(self, lines: DataFrame, rejected: DataFrame | None = None, pages: DataFrame | None = None, documents: DataFrame | None = None, images: DataFrame | None = None) -> Result:
        """Pages and documents of layout lines; ``pages`` and ``documents`` name those that have no line as well."""
        fixed = stage(self.correct_lines(lines))
        each = fixed.select("doc_id", "page_num", "line_ord", F.explode("corrections").alias("c")).select("doc_id", "page_num", "line_ord", "c.*")
        text = lambda c: F.array_join(F.transform("ls", lambda x: x[c]), "\n")
        ls = F.array_sort(F.collect_list(F.struct("line_ord", "original_text", "text", "corrections")))
        by_page = fixed.groupBy("doc_id", "page_num").agg(ls.alias("ls")).select(
            "doc_id", "page_num", text("original_text").alias("raw_text"), text("text").alias("corrected_text"), F.flatten(F.transform("ls", lambda x: x["corrections"])).alias("corrections")
        )
        none = F.array().cast(correct.CORRECTION)
        if pages is not None:
            by_page = pages.join(by_page, ["doc_id", "page_num"], "left").select("doc_id", "page_num", *[F.coalesce(c, F.lit("")).alias(c) for c in ("raw_text", "corrected_text")], F.coalesce("corrections", none).alias("corrections"))
        by_page = by_page.withColumn("has_errors", F.size("corrections") > 0)
        ps = F.array_sort(F.collect_list(F.struct("page_num", "raw_text", "corrected_text", "has_errors", "corrections")))
        grouped = by_page.groupBy("doc_id").agg(ps.alias("pages"))
        if documents is not None:
            grouped = documents.join(grouped, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(grouped.schema["pages"].dataType)))
        report = grouped.select(
            "doc_id", F.size("pages").alias("total_pages"), F.flatten(F.transform("pages", lambda x: x["corrections"])).alias("corrections_summary"), "pages",
            F.array_join(F.transform("pages", lambda x: x["corrected_text"]), "\n\n").alias("full_text"),
            F.struct(sinks.output_name(F.col("doc_id"), "_corrected.pdf").alias("pdf"), sinks.output_name(F.col("doc_id"), "_corrected.txt").alias("text"), sinks.output_name(F.col("doc_id"), "_report.json").alias("json")).alias("generated_files"),
        ).withColumn("total_corrections", F.size("corrections_summary"))
        nothing = fixed.sparkSession.createDataFrame([], "doc_id string, error string")
        return Result(fixed, each, by_page, report, nothing if rejected is None else rejected, images)
