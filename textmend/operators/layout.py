"""Page layout: word boxes and text blocks to ordered, aligned lines, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile

ROW_STEP = 12.0  # boxes whose tops fall into one step share a row
MAX_PAGES = 500


def align(left: Column, width: Column, page_width: Column, narrow: float) -> Column:
    """C for narrow and centred, R for what starts far right, else L."""
    centre = left + width / 2.0
    return F.when((width < narrow * page_width) & (F.abs(centre - page_width / 2.0) < 0.1 * page_width), "C").when(left > 0.55 * page_width, "R").otherwise("L")


def ocr_lines(boxes: DataFrame, *, by_paragraph: bool = False) -> DataFrame:
    """Word boxes to lines in reading order.

    ``boxes``: doc_id, page_num, seq, block_num, par_num, line_num, left, top, width,
    height, conf, text, page_width.  Words without text or with negative confidence go.
    Lines group by block and line (and paragraph, on request).
    """
    ok = boxes.withColumn("text", T.strip(F.col("text"))).filter((F.col("text") != "") & (F.col("conf") >= 0))
    keys = ["doc_id", "page_num", "block_num", *(["par_num"] if by_paragraph else []), "line_num"]
    words = F.array_sort(F.collect_list(F.struct("seq", "text")))
    g = ok.groupBy(*keys).agg(
        F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.max("page_width").alias("page_width"),
    )
    width = F.col("right") - F.col("left")
    w = Window.partitionBy("doc_id", "page_num").orderBy(F.bround(F.col("top") / ROW_STEP), "left", *keys[2:])
    return g.select(
        "doc_id", "page_num", F.row_number().over(w).alias("line_ord"), "text", align(F.col("left"), width, F.col("page_width"), 0.7).alias("alignment"),
        "top", "left", width.alias("width"), (F.col("bottom") - F.col("top")).alias("height"),
    )


def block_lines(blocks: DataFrame) -> DataFrame:
    """PDF text blocks (doc_id, page_num, page_width, seq, x0, y0, x1, y1, text, block_type) to lines.

    All lines of a block share its box and alignment; blank lines and other block types go.
    """
    b = blocks.filter(F.col("block_type") == 0)
    lines = b.select("*", F.posexplode(T.split_lines(T.strip(F.col("text")))).alias("i", "line"))
    lines = lines.withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    width = F.col("x1") - F.col("x0")
    w = Window.partitionBy("doc_id", "page_num").orderBy("seq", "i")
    return lines.select(
        "doc_id", "page_num", F.row_number().over(w).alias("line_ord"), F.col("line").alias("text"), align(F.col("x0"), width, F.col("page_width"), 0.6).alias("alignment"),
        F.col("y0").alias("top"), F.col("x0").alias("left"), width.alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
    )


def with_defaults(lines: DataFrame) -> DataFrame:
    """Layout lines with what is missing filled in: text '', alignment L, numbers 0, page 1."""
    have = set(lines.columns)
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c)
    rest = [c for c in lines.columns if c not in {"text", "alignment", "top", "left", "width", "height", "page_num"}]
    return lines.select(*rest, col("text", ""), col("alignment", "L"), *[col(c, 0) for c in ("top", "left", "width", "height")], col("page_num", 1))


def page_stats(pages: DataFrame, p: ScriptProfile) -> DataFrame:
    """(doc_id, page_count, total_chars, script_chars, is_searchable) from page texts (doc_id, page_num, text)."""
    chars = F.sum(F.length(T.strip(F.coalesce("text", F.lit("")))))
    script = F.sum(T.script_length(F.coalesce("text", F.lit("")), p))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), chars.alias("total_chars"), script.alias("script_chars"))
    c, s = F.col("total_chars"), F.col("script_chars")
    return g.withColumn("is_searchable", ((c > 50) & (s > 0.05 * c)) | (c > 200))


def routes(info: DataFrame, blocks: DataFrame, p: ScriptProfile, cap: int = MAX_PAGES) -> DataFrame:
    """info with total_chars, script_chars, is_searchable and route: digital, scanned or rejected (then with an error).

    ``info``: doc_id, page_count, error, one row per PDF; ``blocks``: text blocks, with an
    error in place of a page where they could not be read.  Every PDF has a row: one
    without any text counts 0 characters, is not searchable, and so is scanned.
    """
    pages = blocks.filter("page_num IS NOT NULL").groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    stats = page_stats(pages, p).drop("page_count")
    broken = blocks.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("block_error"))
    out = info.join(stats, "doc_id", "left").join(broken, "doc_id", "left")
    over = F.when(F.col("page_count") > cap, F.format_string(f"PDF has %d pages; the limit is {cap}", "page_count")).when(F.coalesce("page_count", F.lit(0)) < 1, "PDF has no pages")
    error = F.coalesce("error", over, "block_error")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    keep = [c for c in info.columns if c != "error"]
    out = out.select(*keep, n("total_chars"), n("script_chars"), F.coalesce("is_searchable", F.lit(False)).alias("is_searchable"), error.alias("error"))
    return out.withColumn("route", F.when(F.col("error").isNotNull(), "rejected").when(F.col("is_searchable"), "digital").otherwise("scanned"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num, text): a page's lines in order, one below the other."""
    arr = F.array_sort(F.collect_list(F.struct("line_ord", "text")))
    return lines.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(arr, lambda x: x["text"]), "\n").alias("text"))


def full_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, text): pages in order, parted by a blank line."""
    arr = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(F.transform(arr, lambda x: x["text"]), "\n\n").alias("text"))


def page_runs(lines: DataFrame) -> DataFrame:
    """Lines with run: a new output page wherever the page number changes from one line to the next."""
    w = Window.partitionBy("doc_id").orderBy("line_ord")
    new = F.coalesce((F.col("page_num") != F.lag("page_num").over(w)).cast("int"), F.lit(1))
    return lines.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: Percent of each stage of a document's progress, and of its bar.
STAGES = {"inspecting": 5, "rasterizing": 15, "extracting": 30, "correcting": 70, "exporting": 92, "finalizing": 98, "complete": 100}
BAR = {"inspecting": 25, "rasterizing": 35, "extracting": 60, "correcting": 88, "exporting": 95, "finalizing": 98, "complete": 100}


def ocr_percent(i: Column, n: Column) -> Column:
    return F.floor(15 + i / n * 70).cast("int")


def bar_percent(stage: Column, percent: Column) -> Column:
    out = F.greatest(F.lit(35), F.least(percent, F.lit(85)))
    for s, v in BAR.items():
        out = F.when(stage == s, v).otherwise(out)
    return out


def progress(pages: DataFrame) -> DataFrame:
    """Progress events of scanned documents, a row per page: (doc_id, page_num, stage, percent, bar)."""
    w = Window.partitionBy("doc_id")
    i = F.row_number().over(w.orderBy("page_num")) - 1
    pct = ocr_percent(i, F.count("*").over(w))
    return pages.select("doc_id", "page_num", F.lit("ocr").alias("stage"), pct.alias("percent")).withColumn("bar", bar_percent(F.col("stage"), F.col("percent")).cast("int"))
