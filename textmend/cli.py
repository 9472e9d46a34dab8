"""``python -m textmend.cli``: correct a text, a folder, or a file."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import lexicon
from .plans.document import Engine
from .script import KANNADA, LATIN
from .sources import files, sinks
from .staging import scope


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textmend")
    p.add_argument("file", nargs="?", help="a PDF or image")
    p.add_argument("--text", help="correct this text")
    p.add_argument("--batch", metavar="FOLDER", help="correct all supported files of a folder")
    p.add_argument("--dic", required=True, help="word list with affix flags")
    p.add_argument("--aff", help="affix rules")
    p.add_argument("--core", help="file of further words, one a line")
    p.add_argument("--profile", choices=("kannada", "latin"), default="kannada")
    p.add_argument("--lang", default="kan+eng")
    p.add_argument("--dpi", type=int, default=300)
    p.add_argument("--output-dir", default="output")
    p.add_argument("--no-pdf", action="store_true", help="write no printable pages")
    p.add_argument("--save-images", action="store_true")
    p.add_argument("--json", action="store_true", help="print the whole result")
    return p


def show(row: dict, as_json: bool) -> str:
    if as_json:
        return json.dumps(row, ensure_ascii=False, indent=2, default=str)
    lines = [row["corrected"], f"{row['total_corrections']} corrections in {row['total_words']} words, {row['accuracy_rate']} %"]
    return "\n".join(lines + [f"  {c['original']} -> {c['correction']} ({c['type']}, {c['edit_distance']})" for c in row["corrections"]])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ocr=None, pdf=None) -> int:
    with scope():
        return _run(argv, spark, ocr, pdf)


def _run(argv, spark, ocr, pdf) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("textmend").getOrCreate()
    p = {"kannada": KANNADA, "latin": LATIN}[a.profile]
    core = spark.read.text(a.core).selectExpr("trim(value) AS word").filter("word <> ''") if a.core else None
    engine = Engine(lexicon.load(spark, a.dic, p, a.aff, core), p, ocr, pdf)
    if a.text:
        out = engine.correct(files.from_texts(spark, [a.text])).first()  # one text, one row
        print(show(out.asDict(recursive=True), a.json))
        return 0
    if not (a.batch or a.file):
        parser().print_help()
        return 1
    found = files.read_folder(spark, a.batch) if a.batch else spark.read.format("binaryFile").load(a.file)
    result = engine.process(found, lang=a.lang, dpi=a.dpi)
    sinks.write_pages(result.pages, f"{a.output_dir}/pages")
    sinks.write_combined(result.report, f"{a.output_dir}/text")
    sinks.write_reports(result.report, f"{a.output_dir}/reports")
    if not a.no_pdf:
        sinks.printable(result.lines).write.mode("overwrite").parquet(f"{a.output_dir}/printable")
    if a.save_images and result.images is not None:
        sinks.write_images(result.images, f"{a.output_dir}/images")
    result.report.select("doc_id", "total_pages", "total_corrections").show(truncate=False)
    result.rejected.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
